"""Records that travel in blobs: dealt to buckets by task, in one or two levels, met a bucket at a time.

A record is a place in some arrays of equal length.  A task cuts its records by
bucket and sends one row a bucket that occurs, its arrays as binary columns, so
the cost follows the records and not the number of buckets.

With many buckets a chunk's blobs would shrink to single records.  Then records go
to coarse buckets first, and tasks there gather ``FLUSH`` bytes of them before they
deal them out again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import csr_gather

#: Buckets up to which records are dealt at once, and the number of coarse buckets beyond.
DIRECT, COARSE = 2048, 1024
#: Bytes of records that a task of the coarse level gathers.
FLUSH = 32 << 20

#: The column of bytes whose lengths are the records' ``size``.
RAGGED = "bytes"


def runs(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stable order by bucket, the buckets that occur, and the borders between them."""
    small = len(bucket) and 0 <= int(bucket.min()) and int(bucket.max()) < 1 << 16
    order = np.argsort(bucket.astype(np.uint16) if small else bucket, kind="stable")
    b = bucket[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(b)), bool), b[1:] != b[:-1])))
    return order, b[first], np.concatenate((first, [len(b)])).astype(np.int64)


def blobs(bucket: np.ndarray, kinds: dict, parts: dict) -> pa.RecordBatch:
    """One row a bucket that occurs: ``bucket`` and a binary column an array, of the given types."""
    order, which, ends = runs(bucket)
    columns = [pa.array(which.astype(np.int64))]
    for name, kind in kinds.items():
        if name == RAGGED:
            size = parts["size"].astype(np.int64)
            at = np.concatenate(([0], np.cumsum(size)))
            data = parts[name][csr_gather(at[:-1][order], size[order])]
            borders = np.concatenate(([0], np.cumsum(size[order])))[ends]
        else:
            data = np.ascontiguousarray(parts[name][order].astype(kind, copy=False))
            borders = ends * data.dtype.itemsize
        data = np.ascontiguousarray(data)
        cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(data)])
        columns.append(cells.cast(pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["bucket", *kinds])


def joined(t: pa.Table | pa.RecordBatch, kinds: dict) -> dict:
    """The arrays of all rows, end to end."""
    out = {}
    for name, kind in kinds.items():
        cells = [np.frombuffer(x.as_buffer(), kind) for x in t.column(name)]
        out[name] = np.concatenate(cells) if cells else np.zeros(0, kind)
    return out


class Deal:
    """An exchange of records over ``n`` buckets.  Whether it takes two levels is decided once, where the plan is made."""

    def __init__(self, kinds: dict, n: int):
        self.kinds, self.n, self.coarse, self.flush = kinds, n, (COARSE if n > DIRECT else 0), FLUSH
        self.wide = kinds | {"fine": np.int64}

    def sent(self, bucket: np.ndarray, parts: dict) -> pa.RecordBatch:
        """What a task sends: blobs by bucket, or, where buckets are many, by coarse bucket with the bucket of each record beside."""
        if not self.coarse:
            return blobs(bucket, self.kinds, parts)
        return blobs(bucket % self.coarse, self.wide, parts | {"fine": bucket})

    @property
    def schema(self) -> str:
        return "bucket long, " + ", ".join(f"{k} binary" for k in (self.wide if self.coarse else self.kinds))

    def met(self, df: DataFrame, run: Callable[[int, dict], pa.Table | pa.RecordBatch], out: str, squeeze: Callable | None = None) -> DataFrame:
        """``run(bucket, arrays)`` over all records of every bucket; ``df`` is what tasks sent.

        ``squeeze(bucket, arrays)`` may rewrite what a task of the coarse level has gathered.
        """
        kinds = self.kinds

        def whole(t: pa.Table) -> pa.Table:
            got = run(int(t["bucket"][0].as_py()), joined(t, kinds))
            return got if isinstance(got, pa.Table) else pa.Table.from_batches([got])

        if self.coarse:
            df = self._refined(df, squeeze)
        return df.groupBy("bucket").applyInArrow(whole, out)

    def _refined(self, df: DataFrame, squeeze: Callable | None) -> DataFrame:
        """The records of coarse buckets, gathered and dealt out to their buckets."""
        kinds, wide, most = self.kinds, self.wide, self.flush

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def flush() -> pa.RecordBatch:
                parts = {k: np.concatenate([h[k] for h in held]) for k in wide}
                bucket = parts.pop("fine")
                if squeeze:
                    bucket, parts = squeeze(bucket, parts)
                return blobs(bucket, kinds, parts)

            for batch in batches:
                for i in range(len(batch)):
                    row = {k: v.copy() for k, v in joined(batch.slice(i, 1), wide).items()}
                    held.append(row)
                    size += sum(v.nbytes for v in row.values())
                    if size >= most:
                        yield flush()
                        held, size = [], 0
            if held:
                yield flush()

        return df.repartition("bucket").mapInArrow(run, "bucket long, " + ", ".join(f"{k} binary" for k in kinds))
