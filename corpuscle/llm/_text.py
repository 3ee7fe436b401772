"""Vectorised text kernels over Arrow string buffers.

Every kernel works on one *chunk*: some whole documents laid end to end as
UTF-8 bytes.  A chunk holds about ``MAX_CHUNK`` bytes (a single longer document
is a chunk of its own), which bounds the memory of a Python worker whatever the
size of an Arrow batch.  A null text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes that a kernel handles at once.
MAX_CHUNK = 1 << 20

_U = np.uint64
_B = _U(0x9E3779B97F4A7C15 | 1)  # odd, so it has an inverse modulo 2**64
_B_INV = _U(pow(int(_B), -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64) | _U(1)

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = np.ones(256, dtype=bool)
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


@dataclass
class Chunk:
    """Whole documents: ``data[offsets[i]:offsets[i + 1]]`` is document ``i``."""

    ids: pa.Array
    data: np.ndarray
    offsets: np.ndarray
    null: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    null = np.asarray(col.is_null())
    if null.any():
        col = col.fill_null(b"")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8) if offs is not None and len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets, null


def rest() -> None:
    """Give unused memory back to the machine: a worker outlives its task, and the next one may need the room elsewhere."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def chunks(batches: Iterator[pa.RecordBatch], id_col: str = "doc_id", text_col: str = "text", size: int = MAX_CHUNK) -> Iterator[Chunk]:
    """Cut Arrow batches into chunks of whole documents."""
    for batch in batches:
        ids, (data, offsets, null) = batch.column(batch.schema.get_field_index(id_col)), _buffers(batch.column(batch.schema.get_field_index(text_col)))
        n, at = len(offsets) - 1, 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            lo, hi = int(offsets[at]), int(offsets[to])
            yield Chunk(ids.slice(at, to - at), data[lo:hi], offsets[at : to + 1] - lo, null[at:to])
            at = to
    rest()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """``base**0 .. base**(n - 1)``; those of a usual chunk's length are kept."""
    kept = _POWERS.get(int(base))
    if kept is not None and len(kept) >= n:
        return kept[:n]
    out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if n <= MAX_CHUNK + 1:
        _POWERS[int(base)] = out
    return out[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``p[i]`` is the polynomial hash of ``data[:i]``; see :func:`span_hash`."""
    p = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * _powers(len(data), _B), out=p[1:])
    return p


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes wherever they stand."""
    inv = _powers(len(p), _B_INV)
    return mix((p[ends] - p[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the maximal runs of ``table`` bytes; no word crosses documents."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = table[data]
    cuts = offsets[:-1][offsets[:-1] < n]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    first[cuts] = w[cuts]
    last[:-1] &= ~w[1:]
    ends = cuts[cuts > 0] - 1
    last[ends] = w[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles with their document numbers (repeats included).

    A document of fewer than ``k`` words (and at least one) has its whole word
    sequence as its only shingle.
    """
    per = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(per)))[:-1]
    mult = [_U(pow(0xA24BAED4963EE407, q + 1, 1 << 64)) for q in range(k)]
    n = len(h)
    out, owner = [], []
    if n >= k:
        s = np.zeros(n - k + 1, np.uint64)
        for q in range(k):
            s += mix(h[q : n - k + 1 + q] * mult[q])
        ok = doc[: n - k + 1] == doc[k - 1 :]
        out.append(mix(s)[ok])
        owner.append(doc[: n - k + 1][ok])
    for short in range(1, k):
        of = np.flatnonzero(per == short)
        if len(of):
            s = np.full(len(of), short, np.uint64)
            for q in range(short):
                s += mix(h[first[of] + q] * mult[q])
            out.append(mix(s ^ _U(0x5851F42D4C957F2D)))
            owner.append(of)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owner)


def shingle_sets(chunk: Chunk, k: int, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending: ``(hashes, offsets)`` with one run per document."""
    data = LOWER[chunk.data]
    s, e, doc = words(data, chunk.offsets, table)
    h, owner = shingles(span_hash(prefix_hash(data), s, e), doc, len(chunk), k)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(owner[order].astype(np.int32), kind="stable")]
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(chunk)))))


def csr_gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lens[i] - 1`` for all ``i``, end to end."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])), lens)
    out += np.arange(total)
    return out
