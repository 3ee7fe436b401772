"""Mixing sources to target weights by Pfair scheduling (operator 1).

Each source's documents, in a reproducible shuffle, form blocks of ``block``
documents.  Time is counted in block slots.  With target weight ``w`` a source's
block ``i`` (from 1) is released at slot ``floor((i - 1) / w)`` and due by slot
``ceil(i / w)``; in every slot the released block with the earliest deadline goes
next (ties by source).  At every moment each source has had less than one block
more or less than its weight times the time.

Weights are exact rationals (the given floats as they are), kept as whole parts of
a common total, so releases and deadlines have no rounding and the bound holds
against the targets themselves, however many sources and slots there are.

When a source runs out of blocks, a *phase* ends: the weights of the others are
scaled up to one and the next phase begins, each source going on with its next
block.  So every document is in the mixture exactly once (``until="all"``); with
``until="first"`` the mixture ends with the first phase, where the targets hold
throughout.

Scale.  The driver sees one count a source and schedules blocks, not documents,
with a heap: 32 bytes and a label a block of 16 documents (about 100 MB and the labels
for 46 million documents).  Documents get their place in
their source by counting in buckets of the shuffle's hash and adding up bucket
counts, in two levels; no source's rows ever meet in one task.

Results for odd input: documents without a source form a source of their own,
labelled null; sources without a target weight get the smallest given one; rows
without a doc_id are left out, having no place in the shuffle; repeated rows are
documents of their own, next to each other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, packed, table, unpacked

#: Slots of the schedule up to which it is broadcast.
SMALL = 200_000
#: Documents of a block.
BLOCK = 16
#: Documents of a bucket of the shuffle, and buckets of an upper bucket.
BUCKET, UPPER = 384, 256
#: Power of the sizes that gives the default targets: small sources are raised, large ones lowered.
ALPHA = 0.5


def whole_parts(weights: dict) -> dict:
    """Weights as whole parts in exactly their proportions."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    out = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*out.values())
    return {s: n // common for s, n in out.items()}


def schedule(parts: dict, left: dict) -> tuple[list, array, array]:
    """The source, release and deadline of each slot, by earliest deadline among the released blocks, until a source is used up."""
    total = sum(parts.values())
    waiting, ready = [(0, s, 1) for s in sorted(parts)], []
    out, releases, deadlines = [], array("q"), array("q")
    while True:
        while waiting and waiting[0][0] <= len(out):
            r, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i * total // parts[s]), s, i, r))
        d, s, i, r = heapq.heappop(ready)
        out.append(s)
        releases.append(r)
        deadlines.append(d)
        if i == left[s]:
            return out, releases, deadlines
        heapq.heappush(waiting, (i * total // parts[s], s, i + 1))


def phases(counts: dict, weights: dict, until: str = "all") -> list[dict]:
    """Phases until the sources' blocks are used up: weights, the first slot, each source's first block, and its slots."""
    left = {s: n for s, n in counts.items() if n}
    done = dict.fromkeys(left, 0)
    out, slot = [], 0
    while left:
        parts = whole_parts({s: weights[s] for s in left})
        order, releases, deadlines = schedule(parts, left)
        places = {s: array("q") for s in parts}
        for t, s in enumerate(order):
            places[s].append(t)
        used = {s: len(x) for s, x in places.items()}
        out.append({"parts": parts, "total": sum(parts.values()), "places": places, "releases": releases, "deadlines": deadlines, "slot": slot, "length": len(order), "first": {s: done[s] for s in parts}, "used": used})
        slot += len(order)
        for s, n in used.items():
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        if until == "first":
            break
    return out


def slots_table(plan: list[dict]) -> pa.Table:
    """A row a block: ``s``, ``b``, ``phase``, ``weight``, ``release``, ``deadline``, ``slot``."""
    parts = []
    for k, p in enumerate(plan):
        releases, deadlines = np.asarray(p["releases"]) + p["slot"], np.asarray(p["deadlines"]) + p["slot"]
        for s, places in p["places"].items():
            if not len(places):
                continue
            at, n = np.asarray(places), len(places)
            parts.append(
                pa.table(
                    {
                        "s": pa.repeat(pa.scalar(s[1] if s[0] else None, pa.string()), n),
                        "b": np.arange(p["first"][s], p["first"][s] + n, dtype=np.int64),
                        "phase": np.full(n, k, np.int32),
                        "weight": np.full(n, p["parts"][s] / p["total"]),
                        "release": releases[at],
                        "deadline": deadlines[at],
                        "slot": at + p["slot"],
                    }
                )
            )
    return pa.concat_tables(parts).combine_chunks()


def ordinals(docs: DataFrame, n: int, seed: int) -> DataFrame:
    """``doc_id``, ``source`` and ``ordinal`` (from 0) in the source's shuffle order."""
    buckets = max(1, -(-n // BUCKET))
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    # The upper 31 bits number the bucket, so that buckets follow the order of the hash.
    place = F.shiftrightunsigned(h, 33)
    rows = docs.select("doc_id", "source", h.alias("h"), F.floor(place * F.lit(buckets) / F.lit(float(1 << 31))).cast("long").alias("bucket"))
    rows = rows.withColumn("local", F.row_number().over(Window.partitionBy("bucket", "source").orderBy(F.shiftrightunsigned("h", 33), "h", "doc_id")) - 1)
    counts = cut(rows.groupBy("source", "bucket").agg(F.count("*").alias("n")).withColumn("upper", F.floor(F.col("bucket") / UPPER)))
    upper = counts.groupBy("source", "upper").agg(F.sum("n").alias("m"))
    upper = upper.select("source", "upper", (F.sum("m").over(Window.partitionBy("source").orderBy("upper")) - F.col("m")).alias("base"))
    within = F.sum("n").over(Window.partitionBy("source", "upper").orderBy("bucket")) - F.col("n")
    inner = counts.select("source", "upper", "bucket", within.alias("within"))
    start = inner.join(upper.withColumnRenamed("source", "s").withColumnRenamed("upper", "u"), inner["source"].eqNullSafe(F.col("s")) & (F.col("upper") == F.col("u")))
    start = cut(start.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.col("within") + F.col("base")).alias("start")))
    return rows.join(start, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select("doc_id", "source", (F.col("start") + F.col("local")).alias("ordinal"))


def mix(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, until: str = "all", seed: int = 29) -> DataFrame:
    """The mixture: ``doc_id``, ``source``, ``phase``, ``weight``, ``block`` (of the source, from 0), ``release``, ``deadline``, ``slot`` and ``position``.

    ``slot`` counts blocks over all phases, ``release`` and ``deadline`` too (the
    deadline of a phase's last period may lie past the phase's end); ``position``
    counts the document within its block.
    """
    spark = docs.sparkSession
    schema = "doc_id long, source string, phase int, weight double, block long, release long, deadline long, slot long, position int"
    docs = docs.where("doc_id is not null").select("doc_id", "source")
    sizes = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], schema)
    # None can't be sorted with strings: sources go by a pair.
    key = lambda s: (s is not None, s or "")
    if weights is None:
        weights = {s: n**ALPHA for s, n in sizes.items()}
    least = min(weights.values())
    target = {key(s): weights.get(s, least) for s in sizes}
    plan = phases({key(s): -(-n // block) for s, n in sizes.items()}, target, until)
    rows = ordinals(docs, sum(sizes.values()), seed).withColumn("block", F.floor(F.col("ordinal") / block))
    slots = spark.createDataFrame(slots_table(plan))
    # The schedule grows with the blocks: a small one is broadcast, others meet the rows by a shuffle, a block's documents a key.
    slots = F.broadcast(slots) if sum(p["length"] for p in plan) <= SMALL else slots
    rows = rows.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return rows.select("doc_id", "source", "phase", "weight", "block", "release", "deadline", "slot", F.pmod("ordinal", F.lit(block)).cast("int").alias("position"))


def places(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, seed: int = 29) -> DataFrame:
    """``mix_id``, ``mix_slot``, ``mix_position``: each doc_id's (first) place in the mixture; the same for the same ids and sources in any order."""
    plan = mix(docs, weights, block, "all", seed).groupBy(F.col("doc_id").alias("mix_id")).agg(F.min(F.struct("slot", "position")).alias("p"))
    return plan.select("mix_id", F.col("p.slot").alias("mix_slot"), F.col("p.position").alias("mix_position"))


def mixed_documents(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, seed: int = 29) -> DataFrame:
    """The documents in the mixture's order, with their columns: range by range of slots, and sorted within.

    Rows without a doc_id come last.
    """
    plan = places(docs, weights, block, seed).select("mix_id", (F.col("mix_slot") * block + F.col("mix_position")).alias("mix_at"))
    rows = packed(docs).join(plan, F.col("row.doc_id") == F.col("mix_id"), "left")
    # Many rows may lack an id, so a hash deals them to several ranges.
    rows = rows.select("row", F.coalesce("mix_at", F.lit(1 << 62)).alias("at"), F.xxhash64("row").alias("id"))
    return unpacked(rows.repartitionByRange("at", "id").sortWithinPartitions("at", "id"), docs.columns)


def with_places(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` (by ``doc_id``) with ``mix_slot`` and ``mix_position`` in the mixture of ``docs``, in its order; null, and last, without a doc_id."""
    rows = rows.join(places(docs), F.col("doc_id") == F.col("mix_id"), "left").drop("mix_id")
    order = [F.col("mix_slot").asc_nulls_last(), F.col("mix_position").asc_nulls_last(), F.col("doc_id"), F.xxhash64(*(c for c in rows.columns if c != "ids"))]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
