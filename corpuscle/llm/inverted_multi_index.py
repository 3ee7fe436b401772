"""Embedding near-dedup by an inverted multi-index (operator 9).

Index.  Vectors are brought to length 1 and cut into halves.  Each half has a
codebook of its own (k-means on ``SAMPLE`` rows at most); the pairs of centroids
form a product grid of cells, about ``CELL`` vectors each, and every vector lies
in the cell of its two nearest centroids.

Search.  A vector visits cells by rising sum of the two distances.  The number of
visits is learned: sample vectors are paired with ones turned by exactly the
threshold's angle in random directions, and visits grow until ``RECALL`` of the
pairs would be found from either side.  Closer pairs need fewer visits.

Verification.  In each cell the visitors are compared with the members by cosine in
double precision.  A pair that is found from both sides counts once, where its
smaller id is the visitor.  A unit of work returns one row a linked vector: its
number of links there and its root in the unit's spanning forest, never pairs.

Skew.  Equal vectors become one with a weight first.  A cell's members and visitors
are dealt out in blocks, so a hot cell becomes many units of bounded size.

Results for odd input: vectors that are null, zero or hold a null, NaN or infinite
component link with nothing and are kept; vectors of another width are a space of
their own; rows that repeat a vec_id are vectors of their own (equal ones link) and
each gets its row; rows without a vec_id are left out, having no identity; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import Forest, components
from ._spark import cut, table
from ._vectors import matrix, sample, usable, usable_at_all, widths

#: Rows that the codebooks are fitted on, at most.
SAMPLE = 8192
#: Vectors of a cell, on average.
CELL = 200
#: Part of the pairs at the very threshold that visits must find.
RECALL = 0.998
#: Members and visitors of a unit.
MEMBERS, VISITORS = 512, 4096
#: Cells of the grid up to which their sizes (20 bytes a cell) are broadcast.
SMALL = 200_000


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Grid:
    """Two codebooks and their product grid."""

    def __init__(self, x: np.ndarray, k: int, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.half = x.shape[1] // 2
        self.books = [_kmeans(x[:, : self.half], k, rng), _kmeans(x[:, self.half :], k, rng)]
        self.k = len(self.books[0])

    def visits(self, x: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` cells of each vector in multi-sequence order; the first is its own cell.

        The ``n`` smallest sums lie among the places (i, j) of the two sorted
        lists with (i + 1) * (j + 1) <= n, so only these are summed.
        """
        n = min(n, self.k * self.k)
        order, dist = [], []
        for part, book in zip((x[:, : self.half], x[:, self.half :]), self.books, strict=True):
            d = (part * part).sum(1)[:, None] + (book * book).sum(1) - 2 * (part @ book.T)
            o = np.argsort(d, axis=1, kind="stable")[:, :n]
            order.append(o)
            dist.append(np.take_along_axis(d, o, axis=1))
        wide = order[0].shape[1]
        i, j = (np.array(v) for v in zip(*((a, b) for a in range(wide) for b in range(wide) if (a + 1) * (b + 1) <= n), strict=True))
        sums = dist[0][:, i] + dist[1][:, j]
        cells = order[0][:, i].astype(np.int64) * self.k + order[1][:, j]
        best = np.argsort(sums, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(cells, best, axis=1)

    def learn_visits(self, x: np.ndarray, cosine: float, recall: float, seed: int = 11) -> int:
        """Visits by which ``recall`` of the pairs at the threshold are found from either side."""
        rng = np.random.default_rng(seed)
        x = x[:2000]
        turn = rng.normal(size=x.shape)
        turn -= (turn * x).sum(1)[:, None] * x
        turn /= np.linalg.norm(turn, axis=1)[:, None]
        y = cosine * x + math.sqrt(1 - cosine * cosine) * turn
        n = 4
        while n < self.k * self.k:
            a, b = self.visits(x, n), self.visits(y, n)
            if ((a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)).mean() >= recall:
                break
            n += max(1, n // 4)
        return min(n, self.k * self.k)


def _unit_length(x: np.ndarray) -> np.ndarray:
    # First by the largest component, so that no square overflows or vanishes.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links(reps: DataFrame, dim: int, cosine: float, n: int) -> DataFrame:
    """``node``, ``n`` and ``root`` rows of all units; ``reps`` has ``rep``, ``first_id``, ``weight`` and ``embedding``."""
    x = _unit_length(sample(reps, "first_id", dim, SAMPLE))
    grid = Grid(x, max(2, math.ceil(math.sqrt(n / CELL))))
    n_visits = grid.learn_visits(x, cosine, RECALL)
    del x

    def place(batches):
        for batch in batches:
            v = grid.visits(_unit_length(matrix(batch.column(2), dim)), n_visits) if len(batch) else np.zeros((0, 1), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(v), pa.list_(pa.int64()))], ["rep", "weight", "embedding", "visits"])

    placed = cut(reps.select("rep", "weight", "embedding").mapInArrow(place, "rep long, weight long, embedding array<float>, visits array<long>"))
    members = placed.withColumn("cell", F.col("visits")[0])
    visitors = placed.select("rep", "weight", "embedding", F.col("visits")[0].alias("home"), F.explode("visits").alias("cell"))
    sizes = members.groupBy("cell").count().select("cell", F.col("count").alias("m"), F.lit(0).alias("v")).unionByName(visitors.groupBy("cell").count().select("cell", F.lit(0).alias("m"), F.col("count").alias("v")))
    sizes = cut(sizes.groupBy(F.col("cell").alias("c")).agg(F.greatest(F.lit(1), F.ceil(F.sum("m") / MEMBERS)).cast("int").alias("mb"), F.greatest(F.lit(1), F.ceil(F.sum("v") / VISITORS)).cast("int").alias("vb")))
    sizes = F.broadcast(sizes) if grid.k * grid.k <= SMALL else sizes
    block = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), F.col("rep")), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = F.col("cell") == F.col("c")
    left = visitors.join(sizes, at).select(F.lit(0).alias("side"), "rep", "weight", "embedding", "home", F.lit(None).cast("array<long>").alias("visits"), "cell", block(1, F.col("vb")).alias("v"), every("mb").alias("m"))
    right = members.join(sizes, at).select(F.lit(1).alias("side"), "rep", "weight", "embedding", F.col("cell").alias("home"), "visits", "cell", block(2, F.col("mb")).alias("m"), every("vb").alias("v"))

    def unit(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        q, s = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        none = pa.table({c: pa.array([], pa.int64()) for c in ("node", "n", "root")})
        if not len(q) or not len(s):
            return none
        qi, si = q["rep"].to_numpy(), s["rep"].to_numpy()
        qx, sx = _unit_length(matrix(q["embedding"], dim)), _unit_length(matrix(s["embedding"], dim))
        a, b = np.nonzero(qx @ sx.T >= cosine - 1e-9)
        other = qi[a] != si[b]
        a, b = a[other], b[other]
        if not len(a):
            return none
        raw_q, raw_s = matrix(q["embedding"], dim), matrix(s["embedding"], dim)
        exact = np.concatenate([(u * w).sum(1) / (np.sqrt((u * u).sum(1)) * np.sqrt((w * w).sum(1))) for lo in range(0, len(a), 65536) for u, w in [(raw_q[a[lo : lo + 65536]], raw_s[b[lo : lo + 65536]])]])
        # The pair is also found the other way round if the member visits the visitor's cell.
        visits = matrix(s["visits"], len(s["visits"][0])).astype(np.int64)
        home = q["home"].to_numpy()
        back = np.concatenate([(visits[b[lo : lo + 65536]] == home[a[lo : lo + 65536], None]).any(1) for lo in range(0, len(a), 65536)])
        keep = (exact >= cosine) & ((qi[a] < si[b]) | ~back)
        a, b = a[keep], b[keep]
        ids, inv = np.unique(np.concatenate((qi[a], si[b])), return_inverse=True)
        x, y = inv[: len(a)], inv[len(a) :]
        count = np.bincount(x, s["weight"].to_numpy()[b], len(ids)) + np.bincount(y, q["weight"].to_numpy()[a], len(ids))
        forest = Forest(len(ids))
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            forest.join(i, j)
        return pa.table({"node": ids, "n": count.astype(np.int64), "root": ids[[forest.root(i) for i in range(len(ids))]]})

    return left.unionByName(right).groupBy("cell", "v", "m").applyInArrow(unit, "node long, n long, root long")


def _of_width(rows: DataFrame, dim: int, cosine: float) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of usable vectors of one width."""
    if dim == 1:
        # A zero beside the only component changes no cosine and gives the second half something to hold.
        rows, dim = rows.withColumn("embedding", F.concat("embedding", F.array(F.lit(0.0).cast("float")))), 2
    # A repeated vec_id may stand for several vectors, so distinct vectors get numbers of their own.
    reps = rows.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"))
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()))
    found = cut(links(reps, dim, cosine, reps.count()))
    total = found.groupBy("node").agg(F.sum("n").alias("n"))
    label = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = total.join(label.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left").select("node", "n", F.coalesce("label", "node").alias("label"))
    reps = cut(reps.join(named, F.col("rep") == F.col("node"), "left").select(F.col("embedding").alias("e"), "first_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("label", "rep").alias("label")))
    least = cut(reps.groupBy(F.col("label").alias("l")).agg(F.min("first_id").alias("component_id")))
    reps = cut(reps.join(least, F.col("label") == F.col("l")).select("e", "n", "component_id"))
    return rows.join(reps, F.col("embedding") == F.col("e")).select("vec_id", F.col("n").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every vector."""
    rows = vectors.where("vec_id is not null").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    out = rows.where(~usable_at_all()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for dim in widths(rows.where(usable_at_all())):
        out = out.unionByName(_of_width(rows.where(usable(dim)), dim, cosine))
    return out


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: The same by all pairs of one width, and the closure of the links; for small tables.
ORACLE_SQL = """
with recursive v as (select vec_id, embedding::double[] x from embeddings where vec_id is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from v a join v b on len(a.x) = len(b.x) and a.vec_id <> b.vec_id and case when len(a.x) = len(b.x) then list_cosine_similarity(a.x, b.x) else 0 end >= 0.9),
r(vec_id, other) as (select vec_id, vec_id from embeddings where vec_id is not null union select r.vec_id, l.b from r join l on r.other = l.a),
k as (select vec_id, min(other) component_id from r group by vec_id)
select k.vec_id, (select count(*) from l where l.a = k.vec_id)::bigint n_links, component_id, k.vec_id = component_id kept from k"""
