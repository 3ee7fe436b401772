"""Nearest neighbours by multi-index hashing over learned rotated binary codes (operator 2).

Codes.  Vectors are brought to one length by an extra component (so that the
largest inner product is the smallest angle), projected on principal axes and
rotated by iterative quantisation, once for every 64 bits; the signs are the
code of ``BITS`` bits.  The rotations are fitted on ``SAMPLE`` rows at most.

Index.  A code is cut into ``BITS / SUB`` substrings, and every row is posted once a
substring, under the key (substring number, value).  By the pigeonhole principle
a code within ``r`` bits of a query differs by ``r // m`` bits or fewer in one of the
``m`` substrings (by one less in all but the first ``r % m + 1``), so a query probes
the values that near its own, and what stands there holds every code within the
radius.  Only codes gathered by probing are compared with the query's whole code,
and only those within the radius are ranked by the exact inner product.

Radius.  It is learned from the sample: the radius that covers ``RECALL`` of the true
neighbours, where a sample of a part ``f`` of the table stands for ``top`` neighbours by
its nearest ``f * top`` (one at least).  Queries that find fewer than ``top`` rows probe
on with a larger radius, in the end with all bits.

Scale.  A unit of work is one range of values of one substring.  Ranges are as wide as
keeps ``MEMBERS`` rows in them on average, and a query goes to the ranges only that hold
values it probes, so the exchange grows with rows and probes, not with their
product.  A range that is hot all the same is dealt out to several units, and so are
its queries.  A unit returns its best ``top`` a query; the lists of a query are merged.
On vectors without any structure in 64 dimensions the radius that such recall asks
for makes every query probe a part of every range; the README has figures.

Results for odd input: vectors that are null, zero or hold a null, NaN or infinite
component take no part, nor do rows without a vec_id; vectors of another width are
a space of their own; ties go to the smaller vec_id; different rows with equal
vectors are all returned; rows that repeat a vec_id are one item, which scores by the
best of its vectors; a query with fewer candidates than ``top`` returns them all; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, table
from ._text import csr_gather
from ._vectors import matrix, sample, usable, usable_at_all, widths

#: Bits of a code and of a substring.
BITS, SUB = 128, 16
TABLES = BITS // SUB
#: Rows that the rotations and the radius are fitted on, at most.
SAMPLE = 8192
#: Part of the true neighbours that the radius covers.
RECALL = 0.95
#: Rows and queries of a unit.
MEMBERS, QUERIES = 16384, 4096
#: Lists of results of a merged group.
LISTS = 65536

SCHEMA = "query_id long, rank int, vec_id long, score double"


class Coder:
    """Learned rotated binary codes for inner products."""

    def __init__(self, x: np.ndarray, longest: float, bits: int = BITS, rounds: int = 40, seed: int = 5):
        self.longest = longest
        rng = np.random.default_rng(seed)
        z = self._level(x, False)
        values, axes = np.linalg.eigh(z.T @ z)
        axes = axes[:, np.argsort(-values, kind="stable")]
        self.maps = []
        left = bits
        while left:
            b = min(64, left, z.shape[1])
            v = z @ axes[:, :b]
            turn = np.linalg.qr(rng.normal(size=(b, b)))[0]
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
                turn = (u @ w).T
            self.maps.append(axes[:, :b] @ turn)
            left -= b

    def _level(self, x: np.ndarray, query: bool) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            return np.hstack((x / norm, np.zeros_like(norm)))
        y = x / self.longest
        return np.hstack((y, np.sqrt(np.maximum(0, 1 - (norm / self.longest) ** 2))))

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes as rows of ``BITS / SUB`` 16-bit substrings."""
        z = self._level(x, query)
        return np.packbits(np.hstack([z @ m >= 0 for m in self.maps]), axis=1, bitorder="little").view("<u2")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of the codes of ``a`` and ``b``, row by row."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(1, dtype=np.int64)


def learn_radius(coder: Coder, x: np.ndarray, top: int, n: int, recall: float = RECALL, queries: int = 512) -> int:
    """The radius that covers ``recall`` of the true neighbours of a table of ``n`` rows, from its sample ``x``."""
    q = x[: min(queries, len(x))]
    if len(x) < 2:
        return 0
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(max(1, math.ceil(top * len(x) / n)), len(x) - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return int(np.ceil(np.quantile(distances(np.repeat(coder.codes(q, True), k, axis=0), coder.codes(x)[near.reshape(-1)]), recall)))


def radii(radius: int) -> list[int]:
    """How far each substring is probed; -1: not at all."""
    return [radius // TABLES - (j > radius % TABLES) for j in range(TABLES)]


def masks(bits: int, radius: int) -> np.ndarray:
    """All values of ``bits`` bits with ``radius`` bits set at most."""
    if radius < 0:
        return np.zeros(0, np.int64)
    if radius >= bits:
        return np.arange(1 << bits, dtype=np.int64)
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.int64)


class Buckets:
    """One range of values of one substring: its rows by value."""

    def __init__(self, values: np.ndarray, start: int, low_bits: int):
        self.start, self.low_bits = start, low_bits
        local = values.astype(np.int64) - start
        self.order = np.argsort(local, kind="stable")
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(local, minlength=1 << low_bits))))
        self.by_high: dict[int, np.ndarray] = {}

    def probe(self, value: int, near: np.ndarray) -> np.ndarray:
        """Rows whose value differs from ``value`` by one of the masks ``near``."""
        low = (1 << self.low_bits) - 1
        high = (value ^ self.start) >> self.low_bits
        if high not in self.by_high:
            self.by_high[high] = near[near >> self.low_bits == high] & low
        at = self.by_high[high] ^ (value & low)
        lo = self.ends[at]
        return self.order[csr_gather(lo, self.ends[at + 1] - lo)]


def within(buckets: Buckets, codes: np.ndarray, query: np.ndarray, j: int, near: np.ndarray, radius: int) -> np.ndarray:
    """Rows gathered by probing substring ``j`` whose whole code is within the radius of the query's."""
    held = buckets.probe(int(query[j]), near)
    return held[distances(codes[held], query[None]) <= radius] if len(held) else held


def _search(rows: DataFrame, queries: DataFrame, sizes: DataFrame, dim: int, top: int, radius: int, high_bits: int, n_queries: int) -> DataFrame:
    """The ``top`` nearest rows within the radius of each query."""
    far, low_bits = radii(radius), SUB - high_bits
    near = {r: masks(SUB, r) for r in set(far)}
    # The ranges that a query visits: its own range's number, differing by no more bits than the substring may.
    steps = [(j, int(x)) for j, r in enumerate(far) if r >= 0 for x in masks(high_bits, min(r, high_bits))]
    steps = F.broadcast(rows.sparkSession.createDataFrame(pa.table({"step_j": pa.array([j for j, _ in steps], pa.int32()), "step": pa.array([x for _, x in steps], pa.int32())})))
    visits = queries.select("vec_id", "embedding", "code", F.posexplode("subs").alias("j", "sub")).join(steps, F.col("j") == F.col("step_j"))
    visits = visits.select("vec_id", "embedding", "code", "j", F.shiftright("sub", low_bits).bitwiseXOR(F.col("step")).alias("range"))
    v_sizes = visits.groupBy("j", "range").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("vb"))
    # One row a range that has rows: 524,288 at most, whatever the table.
    units = F.broadcast(cut(sizes.join(v_sizes, ["j", "range"]).select(F.col("j").alias("uj"), F.col("range").alias("ur"), "mb", "vb")))
    at = (F.col("j") == F.col("uj")) & (F.col("range") == F.col("ur"))
    block = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), F.col("vec_id")), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    n_lists = n_queries * max(1, len(far) and sum(len(masks(high_bits, min(r, high_bits))) for r in far if r >= 0))
    n_groups = max(1, -(-n_lists // LISTS))
    index = rows.select("vec_id", "embedding", "code", F.posexplode("subs").alias("j", "sub")).withColumn("range", F.shiftright("sub", low_bits)).join(units, at)
    index = index.select(F.lit(1).alias("side"), "vec_id", "embedding", "code", F.lit(0).alias("grp"), "j", "range", block(4, F.col("mb")).alias("m"), every("vb").alias("v"))
    asked = visits.join(units, at)
    asked = asked.select(F.lit(0).alias("side"), "vec_id", "embedding", "code", block(6, F.lit(n_groups)).alias("grp"), "j", "range", every("mb").alias("m"), block(3, F.col("vb")).alias("v"))

    def unit(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        q, s = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        names = ["grp", "query", "ids", "scores"]
        if not len(q) or not len(s):
            return pa.table({"grp": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in names[1:]}})
        j, start = int(q["j"][0].as_py()), int(q["range"][0].as_py()) << low_bits
        code = lambda x: np.frombuffer(b"".join(x["code"].to_pylist()), "<u2").reshape(-1, TABLES)
        qi, qx, qc = q["vec_id"].to_numpy(), matrix(q["embedding"], dim), code(q)
        si, sx, sc = s["vec_id"].to_numpy(), matrix(s["embedding"], dim), code(s)
        buckets, close = Buckets(sc[:, j], start, low_bits), near[far[j]]
        grp, out = q["grp"].to_numpy(), {}
        for k in np.argsort(qc[:, j], kind="stable").tolist():
            held = within(buckets, sc, qc[k], j, close, radius)
            held = held[si[held] != qi[k]]
            if not len(held):
                continue
            score, ids = (sx[held] * qx[k]).sum(1), si[held]
            best = np.lexsort((ids, -score))
            _, first = np.unique(ids[best], return_index=True)
            best = best[np.sort(first)[:top]]
            who, i, x = out.setdefault(int(grp[k]), ([], [], []))
            who.append(np.full(len(best), qi[k]))
            i.append(ids[best])
            x.append(score[best])
        cat = lambda n: pa.array([np.concatenate(v[n]).tobytes() for v in out.values()], pa.binary())
        return pa.table({"grp": pa.array(list(out), pa.int32()), "query": cat(0), "ids": cat(1), "scores": cat(2)})

    def merge(t: pa.Table) -> pa.Table:
        col = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t[c]])
        q, ids, score = col("query", np.int64), col("ids", np.int64), col("scores", np.float64)
        # An item found in several substrings, or by several rows, counts once, with its best score.
        order = np.lexsort((-score, ids, q))
        q, ids, score = q[order], ids[order], score[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        q, ids, score = q[new], ids[new], score[new]
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(q)), bool), q[1:] != q[:-1])))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate((first, [len(q)])))) + 1
        keep = rank <= top
        return pa.table({"query_id": q[keep], "rank": rank[keep].astype(np.int32), "vec_id": ids[keep], "score": score[keep]})

    best = asked.unionByName(index).groupBy("j", "range", "v", "m").applyInArrow(unit, "grp int, query binary, ids binary, scores binary")
    return best.groupBy("grp").applyInArrow(merge, SCHEMA)


def _nearest(rows: DataFrame, dim: int, top: int) -> DataFrame | None:
    """Neighbours among vectors of one width; None without a query."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    n, n_q, longest = rows.agg(F.count("*"), F.count_if("q"), F.max(norm)).first()
    if not n or not n_q:
        return None
    x = sample(rows, "vec_id", dim, SAMPLE)
    coder = Coder(x, longest)
    radius = learn_radius(coder, x, top, n)
    del x
    high_bits = min(SUB, max(0, math.ceil(math.log2(n / MEMBERS)))) if n > MEMBERS else 0

    def coded(query: bool):
        def run(batches):
            for batch in batches:
                codes = coder.codes(matrix(batch.column(1), dim), query) if len(batch) else np.zeros((0, TABLES), "<u2")
                subs = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * TABLES, pa.int32()), pa.array(codes.reshape(-1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), subs], ["vec_id", "embedding", "code", "subs"])

        return run

    shape = "vec_id long, embedding array<float>, code binary, subs array<int>"
    plain = lambda x: x.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    index = cut(plain(rows).mapInArrow(coded(False), shape))
    queries = cut(plain(rows.where("q")).mapInArrow(coded(True), shape))
    low_bits = SUB - high_bits
    sizes = index.select(F.posexplode("subs").alias("j", "sub")).groupBy("j", F.shiftright("sub", low_bits).alias("range")).agg(F.ceil(F.count("*") / (4 * MEMBERS)).cast("int").alias("mb"))
    sizes = cut(sizes)
    found = cut(_search(index, queries, sizes, dim, top, radius, high_bits, n_q))
    while radius < BITS:
        # Queries with too few rows within the radius probe on.
        full = found.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= min(top, n - 1)).select("id")
        rest = queries.join(full, F.col("vec_id") == F.col("id"), "left_anti")
        left = rest.count()
        if not left:
            break
        radius = min(BITS, radius + max(TABLES, radius // 2))
        more = _search(index, rest, sizes, dim, top, radius, high_bits, left)
        found = cut(found.join(full, F.col("query_id") == F.col("id"), "left_semi").unionByName(more))
    return found


def nearest(vectors: DataFrame, is_query: Column, top: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of every query's ``top`` nearest rows found."""
    rows = vectors.where("vec_id is not null").select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = cut(rows.where(usable_at_all()))
    found = [x for dim in widths(rows) if (x := _nearest(rows.where(usable(dim)), dim, top)) is not None]
    out = found[0] if found else vectors.sparkSession.createDataFrame([], SCHEMA)
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
