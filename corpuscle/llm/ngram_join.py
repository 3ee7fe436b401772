"""Exact Jaccard self-join of documents on word shingles by T-occurrence search (operator 3).

Two documents link when their sets of ``K``-word shingles have a Jaccard
similarity of at least ``SIMILARITY``.

1. *Classes.*  Documents with equal sets become one class, so exact copies cost
   nothing further.
2. *Routing.*  Shingles are ordered by hash.  The first ``PART`` of each set is
   posted to inverted lists.  If two sets of ``n`` and ``m`` shingles link, their
   first common shingles lie in both posted parts, ``need(n)`` of them at least.
   A set that shares fewer posted shingles than that with all others together
   cannot link with any and leaves, and each set drops its ``need - 1`` longest
   lists, which no link depends on.  What stays is mostly real near copies.
3. *Groups.*  Sets that still share a list form candidate groups (connected
   components over one star a list, never all pairs of a list).
4. *Search.*  Within a group each set is a T-occurrence query against an index of
   the group's shingles: the short lists are merged and counted, sets that reach
   the overlap less the number of long lists stay, and the long lists are probed
   by binary search (DivideSkip).  Large groups are dealt out in blocks.  First
   every block queries one block of hubs, which joins nearly all of a group of
   near copies in linear work; then only the sets outside the group's largest
   component query all blocks, pairs within one component being known already.

Nothing is sampled or capped: every pair of linked sets is in one group, and is
either compared or already connected.  Shingles are 64-bit hashes; a posted list
is a filter only, so a collision there costs a comparison and loses nothing.

Skew: lists travel as binary blobs, exact copies once a chunk; the number of buckets
follows the number of shingles, so a bucket's memory is bounded.  Shingles that
chunks hold many times over are *hot*: their lists are known to be shared and their
lengths are known from the counts of the first pass, so their postings skip the
buckets and no list meets in one task.  When lists are tied to stars, each part of
the classes ties its own first and hands on one class a list.  Groups are split into
blocks of at most ``BLOCK`` sets.

Results for odd input: texts that are null, empty or white space have an empty
set, link with nothing and are their own component; fewer than ``K`` words make
one shingle of the whole sequence; repeated rows are copies of each other, and rows
that repeat a doc_id with another text are documents of their own under that id;
rows without a doc_id are left out, having no identity; an empty table gives an
empty table; other columns are ignored.  Components are exact; pairs that are
connected already are not compared, so single links are not counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _deal
from ._graph import Forest, components
from ._spark import cut, packed, spent, table, unpacked
from ._text import MAX_CHUNK, chunks, csr_gather, mix, shingle_sets

#: Words of a shingle.
K = 5
#: Jaccard similarity from which sets link, in hundredths.
SIMILARITY = 75
#: Part of each set that is posted (in hundredths); at least what the prefix filter asks for.
PART = 40
#: Shingles posted beyond that part, so that short sets are posted whole.
MORE = 40
#: Postings of a bucket.
BUCKET = 1_000_000
#: Classes of one chunk that hold a shingle before the chunk counts it; counted classes that make it hot, and hot shingles at most.
OFTEN, HOT, HOT_LISTS = 4, 100_000, 100_000
#: Sets, and shingles, of a block of a group.
BLOCK, BLOCK_SHINGLES = 96, 1_000_000

_U = np.uint64
_C2 = _U(0xC2B2AE3D27D4EB4F)


def _least_overlap(n: np.ndarray) -> np.ndarray:
    return -(-SIMILARITY * n // 100)


def _overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Fewest common shingles of linked sets of ``n`` and ``m``."""
    return np.maximum(-(-SIMILARITY * (n + m) // (100 + SIMILARITY)), _least_overlap(np.maximum(n, m)))


def _posted(n: np.ndarray) -> np.ndarray:
    """How many shingles of a set of ``n`` are posted."""
    return np.minimum(n, np.maximum(-(-PART * n // 100) + MORE, n - _least_overlap(n) + 1))


def _need_of(n: int) -> int:
    """How many of its posted shingles a set of ``n`` finds posted by any set that it links with.

    The j-th common shingle of two sets stands among the first j + n - overlap of
    the one and j + m - overlap of the other, so it is posted by both while these
    stay within the posted parts.  Over the possible sizes m the least is at an
    end of their range, but for rounding.
    """
    low, high = max(1, -(-SIMILARITY * n // 100)), 100 * n // SIMILARITY
    m = np.arange(low, high + 1) if n <= 512 else np.array([low, high])
    both = _overlap(np.int64(n), m)
    least = min(int((_posted(np.int64(n)) - n + both).min()), int((_posted(m) - m + both).min()))
    return max(1, least if n <= 512 else least - 2)


def _need(n: np.ndarray) -> np.ndarray:
    sizes, inv = np.unique(n, return_inverse=True)
    return np.array([_need_of(int(x)) for x in sizes], np.int64)[inv]


def _class_keys(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits a set, as two signed numbers."""
    n = np.diff(offsets)
    keys = []
    for c in (_U(0x165667B19E3779F9), _C2):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h * c + c))))
        keys.append(mix(total[offsets[1:]] - total[offsets[:-1]] + n.astype(np.uint64)).view(np.int64))
    return keys[0], keys[1]


def _posted_part(h: np.ndarray, off: np.ndarray, n: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The posted shingles of the distinct sets of a chunk, and which document stands for the set of each."""
    _, first = np.unique(key, return_index=True)
    first = first[n[first] > 0]
    take = _posted(n[first])
    return h[csr_gather(off[first], take)], np.repeat(first, take)


def shingle_counts(docs: DataFrame, k: int = K) -> DataFrame:
    """``doc_id``, ``n_shingles``, the class keys ``k1``, ``k2`` of every document, and ``often``: shingles that many classes of a chunk hold, with counts, beside its first document."""

    least = OFTEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, size=2 * MAX_CHUNK):
            h, off = shingle_sets(c, k)
            n, (k1, k2) = np.diff(off), _class_keys(h, off)
            posted, _ = _posted_part(h, off, n, k1)
            posted, count = np.unique(posted, return_counts=True)
            many = count >= least
            often = np.stack((posted[many], count[many].astype(np.uint64)), axis=1).tobytes() if many.any() else None
            yield pa.RecordBatch.from_arrays([c.ids, pa.array(n), pa.array(k1), pa.array(k2), pa.array([often, *[None] * (len(c) - 1)], pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "often"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, often binary")


def hot_shingles(meta: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Hot shingles, ascending, and their counts: at most some multiple of ``HOT_LISTS``, whatever the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2) for x in batch.column(0)]
            both = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["h", "n"])

    counts = meta.where("often is not null").select("often").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    got = counts.where(F.col("n") >= max(HOT, total // HOT_LISTS)).collect()
    h = np.array([r["h"] for r in got], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["n"] for r in got], np.uint32)[order]


#: What a posting carries: its list, its class and the class's size; then the list's length too.
_POSTING = {"code": np.uint32, "key": np.int64, "size": np.uint32}
_LISTED = {"code": np.uint64, "key": np.int64, "size": np.uint32, "length": np.uint32}
_TIED = {"a": np.int64, "b": np.int64}
_HOT_BIT = _U(1 << 63)


def _part(key: np.ndarray, n: int) -> np.ndarray:
    return (mix(key.view(np.uint64)) % _U(n)).astype(np.int64)


def _post(docs: DataFrame, k: int, n: int, hot: np.ndarray, out: _deal.Deal) -> DataFrame:
    """Posted shingles by bucket, the buckets from ``n`` on for those that are hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, size=2 * MAX_CHUNK):
            h, off = shingle_sets(c, k)
            size, (key, _) = np.diff(off), _class_keys(h, off)
            h, own = _posted_part(h, off, size, key)
            key, size = key[own], size[own]
            bucket, code = ((h >> _U(32)) % _U(n)).astype(np.int64), (h & _U(0xFFFFFFFF)).astype(np.uint32)
            if len(hot) and len(h):
                at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                is_hot = hot[at] == h
                bucket[is_hot] = n + _part(key[is_hot], n)
                code[is_hot] = at[is_hot]
            if len(h):
                yield out.sent(bucket, {"code": code, "key": key, "size": size})

    return docs.select("doc_id", "text").mapInArrow(run, out.schema)


def _runs(low: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by ``low``, and the starts of equal runs; only runs of two classes or more stay."""
    packed = np.sort(low.astype(np.uint64) << _U(32) | np.arange(len(low), dtype=np.uint64))
    order, low = (packed & _U(0xFFFFFFFF)).astype(np.int64), packed >> _U(32)
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(low)), bool), low[1:] != low[:-1])))
    if not len(starts):
        return order, starts
    k = key[order]
    shared = np.minimum.reduceat(k, starts) != np.maximum.reduceat(k, starts)
    lens = np.diff(np.concatenate((starts, [len(low)])))
    order = order[np.repeat(shared, lens)]
    lens = lens[shared]
    return order, np.concatenate(([0], np.cumsum(lens)[:-1])).astype(np.int64) if len(lens) else lens


def _shared(n: int, hot_counts: np.ndarray, out: _deal.Deal):
    """Of a bucket's postings those that two classes share, with the lengths of their lists, dealt out by class."""

    def run(bucket: int, x: dict) -> pa.RecordBatch:
        code, key, size = x["code"], x["key"], x["size"]
        if bucket >= n:
            code, length = code.astype(np.uint64) | _HOT_BIT, hot_counts[code]
        else:
            order, starts = _runs(code, key)
            per = np.diff(np.concatenate((starts, [len(order)])))
            length = np.repeat(per, per).astype(np.uint32)
            code, key, size = code[order].astype(np.uint64) | _U(bucket << 32), key[order], size[order]
        order = np.lexsort((code, key))
        code, key, size, length = code[order], key[order], size[order], length[order]
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != code[:-1]) | (key[1:] != key[:-1])
        return out.sent(_part(key[keep], n), {"code": code[keep], "key": key[keep], "size": size[keep], "length": length[keep]})

    return run


def _enough(n: int, out: _deal.Deal):
    """The postings of the classes that share enough of theirs: ties within the part, and one class a list for its bucket.

    Of two linked sets the rarest common posting has ``need - 1`` others above it
    in the order of list lengths, so each class may leave out its ``need - 1``
    longest lists: common passages then tie no groups together.
    """

    def run(part: int, x: dict) -> pa.RecordBatch:
        order = np.lexsort((x["code"], x["length"], x["key"]))
        code, key, size = x["code"][order], x["key"][order], x["size"][order].astype(np.int64)
        _, first, inv, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        ok = np.arange(len(key)) - first[inv] <= count[inv] - _need(size)
        code, key = code[ok], key[ok]
        hub, ties = _ties(code, key)
        # A list goes on with its smallest class here; hot lists have no bucket of their own.
        code, key = code[hub], key[hub]
        bucket = np.where(code & _HOT_BIT, code & _U(0xFFFFFFFF), code >> _U(32)).astype(np.int64) % n
        own = np.full(len(ties), n + part)
        return out.sent(np.concatenate((bucket, own)), {"a": np.concatenate((code.view(np.int64), ties[:, 0])), "b": np.concatenate((key, ties[:, 1]))})

    return run


def _ties(code: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the smallest class of each list stands, and one star a list: every other class with it."""
    order = np.lexsort((key, code))
    c, k = code[order], key[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(c)), bool), c[1:] != c[:-1])))
    hub = np.repeat(k[first], np.diff(np.concatenate((first, [len(c)]))))
    away = hub != k
    return order[first], np.unique(np.stack((k[away], hub[away]), axis=1), axis=0)


def _stars(n: int):
    """The ties of a part, or one star a list of a bucket, as rows."""

    def run(bucket: int, x: dict) -> pa.Table:
        ties = np.stack((x["a"], x["b"]), axis=1) if bucket >= n else _ties(x["a"], x["b"])[1]
        return pa.table({"a": ties[:, 0], "b": ties[:, 1]})

    return run


def candidate_groups(docs: DataFrame, k: int, total: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``key`` (first class key) and ``grp`` of every class that may link with another."""
    n = max(64, -(-total * PART // (100 * BUCKET)))
    posting, listed, tied = (_deal.Deal(kinds, n) for kinds in (_POSTING, _LISTED, _TIED))
    lists = posting.met(_post(docs, k, n, hot[0], posting), _shared(n, hot[1], listed), listed.schema)
    stars = tied.met(listed.met(lists, _enough(n, tied), tied.schema), _stars(n), "a long, b long")
    return components(stars.distinct()).select(F.col("node").alias("key"), F.col("label").alias("grp"))


def divide_skip(sets: list[np.ndarray], queries: list[int], index: list[int], skip=lambda q, c: c, mu: float = 0.0085) -> Iterator[tuple[int, int]]:
    """Pairs (query, other) of positions in ``sets`` that link; each set is ascending and distinct.

    ``skip(q, candidates)`` returns the candidates still of interest.
    """
    if not index or not queries:
        return
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate([sets[i] for i in index])
    owner = np.repeat(np.array(index, np.int64), sizes[index])
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(tokens)), bool), tokens[1:] != tokens[:-1])))
    distinct, last = tokens[first], np.concatenate((first[1:], [len(tokens)]))
    for q in queries:
        s, n = sets[q], len(sets[q])
        if not n:
            continue
        at = np.minimum(np.searchsorted(distinct, s), len(distinct) - 1)
        at = at[distinct[at] == s]
        need = int(_least_overlap(np.int64(n)))
        if len(at) < need:
            continue
        length = last[at] - first[at]
        by_length = np.argsort(length, kind="stable")
        n_long = max(0, min(need - 1, int(need / (mu * math.log2(int(length[by_length[-1]]) + 1) + 1)), len(at) - 1))
        # Merge the short lists and count.
        short, long = at[by_length[: len(at) - n_long]], at[by_length[len(at) - n_long :]]
        lens = last[short] - first[short]
        gathered = owner[np.repeat(first[short] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(int(lens.sum()))]
        count = np.bincount(gathered, minlength=len(sets))
        found = np.flatnonzero(count >= max(1, need - n_long))
        found = found[(found != q) & (100 * sizes[found] >= SIMILARITY * n) & (SIMILARITY * sizes[found] <= 100 * n)]
        found = skip(q, found)
        if not len(found):
            continue
        overlap = count[found]
        # Probe the long lists for the few that are left.
        for j in long.tolist():
            held = owner[first[j] : last[j]]
            place = np.minimum(np.searchsorted(held, found), len(held) - 1)
            overlap = overlap + (held[place] == found)
        for c in found[100 * overlap >= SIMILARITY * (n + sizes[found] - overlap)].tolist():
            yield q, c


def _search(t: pa.Table) -> pa.Table:
    """Links of a unit as a spanning forest: role 0 is index and query, 1 index, 2 query; equal ``label`` means connected already."""
    ids, role = t["key"].to_numpy(), t["role"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, role = ids[order], role[order]
    sets = [np.frombuffer(t["tokens"][int(i)].as_buffer(), np.uint64) for i in order]
    forest = Forest(len(ids))
    known: dict[int, int] = {}
    for i, x in enumerate(np.array(t["label"].to_pylist(), object)[order]):
        if x is not None:
            forest.join(known.setdefault(x, i), i)
    skip = lambda q, c: c[[forest.root(int(x)) != forest.root(q) for x in c]] if len(c) else c
    a, b = [], []
    for q, c in divide_skip(sets, np.flatnonzero(role != 1).tolist(), np.flatnonzero(role != 2).tolist(), skip):
        if forest.join(q, c):
            a.append(int(ids[max(q, c)]))
            b.append(int(ids[min(q, c)]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _sets(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """``key`` and ``tokens`` (binary) of the members' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, at = batch.column(2).to_numpy(), 0
            for c in chunks([batch]):
                h, off = shingle_sets(c, k)
                key, _ = _class_keys(h, off)
                keep = np.flatnonzero(key == wanted[at : at + len(c)]).tolist()
                at += len(c)
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array([h[off[i] : off[i + 1]].tobytes() for i in keep], pa.binary())], ["key", "tokens"])

    wanted = members.select(F.col("rep").alias("doc_id"), "key").distinct()
    return docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "key").mapInArrow(run, "key long, tokens binary").dropDuplicates(["key"])


def links(docs: DataFrame, members: DataFrame, k: int = K) -> DataFrame:
    """``node`` and ``label``: the components of linked classes, by the smallest ``key`` of each.

    ``members`` has ``key``, ``rep``, ``n_shingles`` and ``grp`` of every class that may link.
    """
    size = cut(members.groupBy("grp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w")))
    size = size.select(F.col("grp").alias("g"), F.ceil(F.greatest(F.col("n") / BLOCK, F.col("w") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    n_bins = max(1, members.count() // BLOCK)
    placed = members.join(size, F.col("grp") == F.col("g")).select("key", "grp", "blocks", F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("blk"))
    placed = cut(placed)
    sets = cut(_sets(docs, members, k))
    nothing = F.lit(None).cast("long").alias("label")
    # Small groups share units; a large group's blocks each query the block of hubs.
    small = placed.where("blocks = 1").select("key", F.lit(-1).cast("long").alias("unit"), F.pmod(F.xxhash64("grp"), F.lit(n_bins)).cast("int").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("role"), nothing)
    large = placed.where("blocks > 1")
    hubs = large.where("blk = 0").select("key", F.col("grp").alias("unit"), F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("j"), F.lit(1).alias("role"), nothing)
    own = large.select("key", F.col("grp").alias("unit"), F.col("blk").alias("i"), F.lit(0).alias("j"), F.when(F.col("blk") == 0, 0).otherwise(2).alias("role"), nothing)

    def search(units: DataFrame) -> DataFrame:
        return sets.join(units, "key").groupBy("unit", "i", "j").applyInArrow(_search, "a long, b long")

    edges = cut(search(small.unionByName(hubs).unionByName(own)))
    found = components(edges)
    # What is outside the largest component of a large group queries the whole group.
    named = cut(large.join(found.withColumnRenamed("label", "label_"), F.col("key") == F.col("node"), "left").select("key", "grp", "blocks", "blk", F.coalesce("label_", "key").alias("label")))
    most = named.groupBy("grp", "label").count().groupBy("grp").agg(F.max(F.struct(F.col("count"), F.col("label"))).alias("x"), F.sum("count").alias("all"))
    most = cut(most.select(F.col("grp").alias("g"), F.col("x.label").alias("top"), F.ceil((F.col("all") - F.col("x.count")) / BLOCK).cast("int").alias("rests")).where("rests > 0"))
    if most.isEmpty():
        spent(sets)
        return found
    both = named.join(most, F.col("grp") == F.col("g"))
    rest = both.where("label <> top").select("key", F.col("grp").alias("unit"), F.pmod(F.xxhash64(F.lit(7), F.col("key")), "rests").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(2).alias("role"), "label")
    whole = both.select("key", F.col("grp").alias("unit"), F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("i"), F.col("blk").alias("j"), F.lit(1).alias("role"), "label")
    more = cut(search(rest.unionByName(whole)))
    spent(sets)
    if more.isEmpty():
        return found
    return components(found.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))


def near_duplicates(docs: DataFrame, k: int = K) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``class_id`` (smallest doc_id with the same set) of every document."""
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    meta = cut(shingle_counts(docs, k))
    total = meta.agg(F.sum("n_shingles")).first()[0] or 0
    hot = hot_shingles(meta, total)
    meta = meta.drop("often")
    classes = cut(meta.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles")))
    if total:
        groups = candidate_groups(docs, k, total, hot)
        members = cut(classes.join(groups, F.col("k1") == F.col("key")).select("key", "rep", "n_shingles", "grp"))
        found = links(docs, members, k)
        # Classes, not documents, are linked: an id with two texts may stand in two components.
        linked = cut(classes.select("k1", "rep").join(found, F.col("k1") == F.col("node")).select("node", "rep", "label"))
        least = cut(linked.groupBy(F.col("label").alias("l")).agg(F.min("rep").alias("first")))
        linked = linked.join(least, F.col("label") == F.col("l")).select("node", "first").distinct()
        classes = cut(classes.join(linked, F.col("k1") == F.col("node"), "left").select("k1", "k2", "rep", F.coalesce("first", "rep").alias("label")))
    else:
        classes = classes.withColumn("label", F.col("rep"))
    return meta.join(classes.select("k1", "k2", "rep", "label"), ["k1", "k2"], "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"))


def keep_first(docs: DataFrame, k: int = K) -> DataFrame:
    """One document of each group of linked ones, the smallest doc_id, with its columns; rows without a doc_id stay.

    Of rows that repeat a kept doc_id one stays, the first by the hash of its text.
    """
    found = near_duplicates(docs, k).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = packed(docs).withColumn("id", F.col("row.doc_id"))
    kept = rows.where("id is not null").join(found, F.col("id") == F.col("kept_id"), "left_semi")
    kept = kept.groupBy("id").agg(F.min_by("row", F.xxhash64("row.text")).alias("row"))
    return unpacked(kept.select("row").unionByName(rows.where("id is null").select("row")), docs.columns)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same by all pairs that share a shingle, and the closure of the links; for small tables.
ORACLE_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents where doc_id is not null),
s as (select distinct doc_id, array_to_string(w[i:i+{K - 1}], ' ') g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - {K - 1}) + 1)) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
c as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {SIMILARITY} * (x.n + y.n - c)),
r(doc_id, other) as (select doc_id, doc_id from w union select r.doc_id, l.b from r join l on r.other = l.a),
k as (select doc_id, min(other) component_id from r group by doc_id),
e as (select doc_id, coalesce(list(g order by g), []) x from w left join s using (doc_id) group by doc_id),
z as (select doc_id, case when len(list_filter(x, lambda v: v is not null)) = 0 then doc_id else min(doc_id) over (partition by x) end class_id from e)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, component_id, class_id from w left join n on w.doc_id = n.doc_id join k on w.doc_id = k.doc_id join z on w.doc_id = z.doc_id"""
