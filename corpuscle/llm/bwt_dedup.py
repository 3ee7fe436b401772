"""Removal of byte strings that an earlier document has, by merging Burrows-Wheeler transforms (operator 6).

A byte goes if a ``LENGTH``-byte string that covers it also starts in a document
with a smaller id.

1. *Anchors.*  Every window of ``LENGTH`` bytes names one of its ``SEED``-byte strings,
   the one with the least hash.  Equal windows name equal strings at equal places,
   so only windows whose anchor stands in two different texts can repeat.  Anchors
   (about one in sixteen bytes) meet in buckets; those of one text only drop out.
   Anchors choose what travels; they decide nothing.
2. *Strings.*  The bytes around each occurrence of the anchors that are left, as far
   as its windows reach, go to the anchor's bucket, equal strings of a chunk once.
3. *Merging.*  A bucket's distinct strings, but for those that share too few bytes around
   the anchor with any other, are cut into shards.  Each shard's suffixes
   are sorted and give its transform.  All transforms are merged at once by refining
   an interleave: one stable pass by symbol sorts it by more symbols, and the borders
   between different prefixes are carried along.  After ``LENGTH`` symbols the
   intervals without a border are the repeated strings (the common prefixes are that
   long); no suffix is sorted again.  Each interval's smallest document id decides
   about every window in it; a string that was not merged is its smallest document's.
4. *Removal.*  Windows found go back to their texts as bit masks.

A transform of the whole corpus would be one sequential object; cutting it by anchor
keeps shards bounded and loses nothing, since equal windows share their anchor.

Exact copies collapse to the smallest id before anything else (by two 64-bit hashes):
a copy of at least ``LENGTH`` bytes goes whole.

Skew: an anchor that several texts of a chunk hold is known to be shared, so these
texts skip the bucket and one of them stands for the chunk there; with many buckets
the same is done again over what a task of the coarse level gathers.  Equal strings of
a chunk travel once, and an occurrence is 24 bytes.

Results for odd input: a null text counts as empty; texts shorter than ``LENGTH``
bytes stay whole; rows that repeat a doc_id never remove anything from each other,
whether their texts are equal or not, and each gets its row; rows without a doc_id are
left out, having no order; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _deal
from ._spark import cut, table
from ._text import Chunk, chunks, csr_gather, prefix_hash, span_hash
from .ngram_join import _part, _runs

#: Bytes of a repeated string, and of an anchor.
LENGTH, SEED = 50, 20
#: Classes of windows by the bytes that they reach to the left of their anchor.
SIDES = (0, 8, 16, 24, LENGTH - SEED + 1)
#: Anchors of a bucket; bytes of text per bucket of strings; bytes of a shard.
BUCKET, STRINGS, SHARD = 1_000_000, 4 << 20, 1 << 19
#: Text bytes handled at once.
CHUNK = 2 << 20
#: Symbols by which suffixes are compared as one number.
AHEAD = 8
#: The symbol that ends a string; no UTF-8 text has this byte.
END = 0xFF

_U = np.uint64
_LOW = _U(0xFFFFFFFF)


def _seed_hash(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ``SEED`` bytes at each place: three overlapping words, multiplied and mixed."""
    n = len(data) - SEED + 1
    data = np.ascontiguousarray(data)
    word = lambda at: np.ndarray((n,), "<u8", data, at, (1,)).copy()
    h = word(0) * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(31)
    h += word(8)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    h += word(SEED - 8)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def anchors(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of anchors: hash, place, first and last window that names it, document."""
    data, n = chunk.data, len(chunk.data)
    span = LENGTH - SEED + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(np.uint64), none, none, none, none
    h = _seed_hash(data)
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    # A window counts if it ends within its document.
    per = np.maximum(0, np.diff(chunk.offsets) - LENGTH + 1)
    start = csr_gather(chunk.offsets[:-1], per)
    if not len(start):
        return none.astype(np.uint64), none, none, none, none
    place, doc = (low[start] & _LOW).astype(np.int64), np.repeat(np.arange(len(chunk), dtype=np.int32), per)
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.concatenate((first[1:] - 1, [len(start) - 1]))
    return h[place[first]], place[first], start[first], start[last], doc[first].astype(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``k1``, the text's hash."""
    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k1"))


def text_classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` and the two keys of each text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(101), text).alias("k2"))


#: What travels: an anchor and its text; an occurrence with its string, which comes with the first of a chunk only.
_ANCHOR = {"code": np.uint64, "key": np.int64}
_STRING = {"whole": np.uint64, "id": np.int64, "key": np.int64, "number": np.uint32, "left": np.uint8, "size": np.uint8, "bytes": np.uint8}


def _split(n: int):
    """Anchors of several texts at hand go to their texts' parts (buckets from ``n`` on); one text an anchor goes to the anchor's bucket."""

    def run(bucket: np.ndarray, x: dict) -> tuple[np.ndarray, dict]:
        known = bucket >= n
        code, key = x["code"][~known], x["key"][~known]
        order = np.argsort(code)
        code, key = code[order], key[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(code)), bool), code[1:] != code[:-1])))
        per = np.diff(np.concatenate((first, [len(code)])))
        more = np.repeat(per > 1, per)
        # Only anchors that stand more than once need a look at their texts.
        c, k = code[more], key[more]
        order = np.lexsort((k, c))
        c, k = c[order], k[order]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (k[1:] != k[:-1])
        c, k = c[new], k[new]
        other = c[1:] == c[:-1]
        several = np.concatenate((other, [False])) | np.concatenate(([False], other)) if len(c) else np.zeros(0, bool)
        c, k = c[several], k[several]
        out = {"code": np.concatenate((code[first], c, x["code"][known])), "key": np.concatenate((key[first], k, x["key"][known]))}
        return np.concatenate(((code[first] >> _U(32)).astype(np.int64), n + _part(k, n), bucket[known])), out

    return run


def _post(docs: DataFrame, n: int, to: _deal.Deal) -> DataFrame:
    """Anchors by bucket, with the texts' keys."""
    split = _split(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = batch.column(2).to_numpy(), 0
            for c in chunks([batch], size=CHUNK):
                key = keys[at : at + len(c)]
                at += len(c)
                h, _, _, _, doc = anchors(c)
                bucket = (h >> _U(32)) % _U(n)
                bucket, out = split(bucket.astype(np.int64), {"code": bucket << _U(32) | (h & _LOW), "key": key[doc]})
                if len(bucket):
                    yield to.sent(bucket, out)

    return docs.mapInArrow(run, to.schema)


def _shared(n: int, to: _deal.Deal):
    """Of a bucket's anchors those of two texts or more, by text."""

    def run(bucket: int, x: dict) -> pa.RecordBatch:
        code, key = x["code"], x["key"]
        if bucket < n:
            order, _ = _runs((code & _LOW).astype(np.uint32), key)
            code, key = code[order], key[order]
        return to.sent(_part(key, n), {"code": code, "key": key})

    return run


def _by_text(part: int, x: dict) -> pa.Table:
    """The shared anchors of each text."""
    order = np.lexsort((x["code"], x["key"]))
    key, found = x["key"][order], x["code"][order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    ends = np.concatenate((first[1:], [len(key)]))
    return pa.table({"key": key[first], "shared": pa.array([np.unique(found[a:b]).tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())})


def _strings(n_anchor_buckets: int, n_buckets: int, to: _deal.Deal):
    """The strings around shared anchors by bucket: each once a chunk, with all its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, shared, at = batch.column(2).to_numpy(), batch.column(3), 0
            for c in chunks([batch], size=CHUNK):
                h, place, lo, hi, doc = anchors(c)
                number = np.arange(len(h)) - np.searchsorted(doc, doc)
                code = (((h >> _U(32)) % _U(n_anchor_buckets)) << _U(32)) | (h & _LOW)
                keep = np.zeros(len(h), bool)
                ends = np.searchsorted(doc, np.arange(len(c) + 1))
                for i in range(len(c)):
                    a, b = ends[i], ends[i + 1]
                    if b > a:
                        s = np.frombuffer(shared[at + i].as_buffer(), np.uint64)
                        p = np.minimum(np.searchsorted(s, code[a:b]), len(s) - 1)
                        keep[a:b] = s[p] == code[a:b]
                key = keys[at : at + len(c)]
                at += len(c)
                h, place, lo, hi, doc, number = (x[keep] for x in (h, place, lo, hi, doc, number))
                if not len(h):
                    continue
                size = hi + LENGTH - lo
                whole = span_hash(prefix_hash(c.data), lo, lo + size)
                # Equal strings have equal anchors, so they share their bucket.
                bucket = (h % _U(n_buckets)).astype(np.int64)
                first = np.unique(whole, return_index=True)[1]
                first.sort()
                brought = np.zeros(len(h), np.uint8)
                brought[first] = size[first]
                yield to.sent(bucket, {"whole": whole, "id": np.asarray(c.ids)[doc], "key": key[doc], "number": number, "left": (place - lo).astype(np.uint8), "size": brought, "bytes": c.data[csr_gather(lo[first], size[first])]})

    return run


class Transform:
    """The Burrows-Wheeler transform of some strings, each ended by ``END``: symbols before the sorted suffixes, the suffixes' places and first ``AHEAD`` symbols."""

    def __init__(self, symbols: np.ndarray, places: np.ndarray, heads: np.ndarray):
        self.symbols, self.places, self.heads = symbols, places, heads

    @classmethod
    def of(cls, data: np.ndarray, depth: int, base: int = 0) -> Transform:
        """Of ``data`` (strings with their ends), sorted by ``depth`` symbols (16 to 64); places count from ``base``.

        Ranks by 8 symbols, then by twice as many from pairs of ranks.
        """
        n = len(data)
        padded = np.concatenate((data, np.full(8, END, np.uint8)))
        key = heads = np.ndarray((n,), ">u8", padded, 0, (1,)).astype(np.uint64)
        width = AHEAD
        while True:
            order = np.argsort(key)
            s = key[order]
            rank = np.empty(n, np.uint64)
            rank[order] = np.cumsum(np.concatenate(([True], s[1:] != s[:-1]))).astype(np.uint64)
            if width >= depth:
                break
            step = min(width, depth - width)
            ahead = np.zeros(n, np.uint64)
            ahead[: n - step] = rank[step:]
            key = rank << _U(32) | ahead
            width += step
        return cls(_pairs(data)[order], order + base, heads[order])


def _pairs(data: np.ndarray) -> np.ndarray:
    """The two symbols before each place, the strings taken as a ring."""
    return np.roll(data, 2).astype(np.uint16) << 8 | np.roll(data, 1)


def merge(parts: list[Transform], depth: int) -> tuple[Transform, np.ndarray]:
    """The transform of all parts, and the borders: where the first ``depth`` symbols differ from the suffix before.

    ``source`` says which transform each merged suffix comes from.  The first
    interleave merges the sorted runs by ``AHEAD`` symbols.  A stable pass by the two
    symbols before each suffix puts the suffixes two symbols longer in order, until
    they are sorted by ``depth`` (even) symbols.  ``block`` numbers the runs of equal
    prefixes so far.
    """
    given, heads = np.concatenate([p.symbols for p in parts]), np.concatenate([p.heads for p in parts])
    n = len(given)
    source = np.repeat(np.arange(len(parts), dtype=np.uint8 if len(parts) < 256 else np.uint16), [len(p.symbols) for p in parts])
    order = np.argsort(heads, kind="stable")
    source, heads = source[order], heads[order]
    border = np.ones(n, bool)
    np.not_equal(heads[1:], heads[:-1], out=border[1:])
    block = np.cumsum(border, dtype=np.int32)
    symbols = np.empty(n, np.uint16)
    for _ in range((depth - AHEAD) // 2):
        # Within each transform the suffixes keep their order.
        symbols[np.argsort(source, kind="stable")] = given
        order = np.argsort(symbols, kind="stable")
        s, k = symbols[order], block[order]
        border[:1] = True
        np.not_equal(s[1:], s[:-1], out=border[1:])
        border[1:] |= k[1:] != k[:-1]
        source = source[order]
        np.cumsum(border, out=block)
    at = np.argsort(source, kind="stable")
    symbols[at] = given
    places = np.empty(n, np.int64)
    places[at] = np.concatenate([p.places for p in parts])
    return Transform(symbols, places, np.zeros(0, np.uint64)), border


def repeated(strings: np.ndarray, sizes: np.ndarray, depth: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """Suffix places in sorted order and the number of the interval of equal ``depth``-symbol prefixes of each.

    ``strings`` holds strings of ``sizes`` bytes end to end; places count with one
    ending symbol after each string.
    """
    total = int(sizes.sum()) + len(sizes)
    data = np.full(total, END, np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
    data[csr_gather(starts, sizes)] = strings
    ends = starts + sizes + 1
    parts, lo = [], 0
    shard = min(shard, total // 2 + 1)
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + shard, side="right")))
        parts.append(Transform.of(data[starts[lo] : ends[hi - 1]], depth, int(starts[lo])))
        lo = hi
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole, border = merge(parts, depth)
    return whole.places, np.cumsum(border)


def _alike(text: np.ndarray, anchor: np.ndarray, left: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Strings that share some more bytes around their anchor with another string.

    Windows are told apart by how far they reach to the left of the anchor, in
    ``SIDES`` classes.  Those of a class have a core in common that all of them cover; a
    string whose cores all stand alone has no window in common with any other string,
    so it needn't be merged.
    """
    p, out = prefix_hash(text), np.zeros(len(size), bool)
    least = left - (size - LENGTH)
    for lo, hi in zip(SIDES[:-1], SIDES[1:], strict=True):
        some = np.flatnonzero((least < hi) & (left >= lo))
        _, inv, count = np.unique(span_hash(p, anchor[some] - lo, anchor[some] + LENGTH - hi + 1), return_inverse=True, return_counts=True)
        out[some] |= count[inv] > 1
    return out


def _found(bucket: int, x: dict) -> pa.Table:
    """Windows of a bucket's strings that an earlier document has, as masks by text."""
    brought = np.flatnonzero(x["size"])
    whole, size, left = x["whole"][brought], x["size"][brought].astype(np.int64), x["left"][brought].astype(np.int64)
    at = np.concatenate(([0], np.cumsum(size)))[:-1]
    # Equal strings are one; its smallest document stands for it.
    whole, first = np.unique(whole, return_index=True)
    at, size, left = at[first], size[first], left[first]
    which, ids, key, number = np.searchsorted(whole, x["whole"]), x["id"], x["key"], x["number"]
    least = np.full(len(whole), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    # The smallest document that has each window of each string: the string's own, or that of the window's interval.
    windows = size - LENGTH + 1
    w_at = np.concatenate(([0], np.cumsum(windows)))
    smallest = np.repeat(least, windows)
    like = np.flatnonzero(_alike(x["bytes"], at + left, left, size))
    if len(like):
        places, interval = repeated(x["bytes"][csr_gather(at[like], size[like])], size[like], LENGTH)
        starts = np.concatenate(([0], np.cumsum(size[like] + 1)))
        string = np.repeat(np.arange(len(like)), size[like] + 1)[places]
        offset = places - starts[string]
        window = offset < windows[like][string]
        w, interval = w_at[like[string[window]]] + offset[window], interval[window]
        # Intervals stand in order, so the least of each is a running segment.
        border = np.flatnonzero(np.concatenate((np.ones(min(1, len(interval)), bool), interval[1:] != interval[:-1])))
        low = np.minimum.reduceat(smallest[w], border)
        smallest[w] = np.repeat(low, np.diff(np.concatenate((border, [len(w)]))))
    # The windows of each occurrence that an earlier document has; most strings have none or all of one kind.
    top = np.maximum.reduceat(smallest, w_at[:-1])
    floor = np.minimum.reduceat(smallest, w_at[:-1])
    mask = np.where(top[which] < ids, (_U(1) << windows[which].astype(np.uint64)) - _U(1), _U(0))
    mine = np.flatnonzero((floor[which] < ids) & (top[which] >= ids))
    per = windows[which[mine]]
    if len(mine):
        w = csr_gather(w_at[which[mine]], per)
        first = np.concatenate(([0], np.cumsum(per)[:-1]))
        bit = np.arange(len(w)) - np.repeat(first, per)
        gone = smallest[w] < np.repeat(ids[mine], per)
        mask[mine] = np.bitwise_or.reduceat(gone.astype(np.uint64) << bit.astype(np.uint64), first)
    some = np.flatnonzero(mask)
    some = some[np.lexsort((number[some], key[some], ids[some]))]
    doc, key = ids[some], key[some]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))))
    ends = np.concatenate((first[1:], [len(doc)]))
    cut_up = lambda v: pa.array([v[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())
    return pa.table({"id": doc[first], "key": key[first], "number": cut_up(number[some]), "mask": cut_up(mask[some])})


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lengths, spans and the hash of what is left, from each document's masks."""
    for batch in batches:
        copy, numbers, masks, kept_texts, at = batch.column(2).to_pylist(), batch.column(3), batch.column(4), [], 0
        out = {"n_removed": [], "n_spans": [], "kept_sha256": []}
        for c in chunks([batch], size=CHUNK):
            gone = np.zeros(len(c.data) + 1, np.int32)
            touched = [i for i in range(len(c)) if masks[at + i].is_valid]
            if touched:
                h, _, lo, _, doc = anchors(c)
                ends = np.searchsorted(doc, np.arange(len(c) + 1))
                del h
                for i in touched:
                    number = np.concatenate([np.frombuffer(x, np.uint32) for x in numbers[at + i].as_py()]).astype(np.int64)
                    mask = np.concatenate([np.frombuffer(x, np.uint64) for x in masks[at + i].as_py()])
                    first = lo[ends[i] + number]
                    for bit in range(LENGTH - SEED + 1):
                        s = first[(mask >> _U(bit) & _U(1)).astype(bool)] + bit
                        np.add.at(gone, s, 1)
                        np.add.at(gone, s + LENGTH, -1)
            covered = np.cumsum(gone[:-1]) > 0
            for i in range(len(c)):
                a, b = int(c.offsets[i]), int(c.offsets[i + 1])
                x = covered[a:b] if not (copy[at + i] and b - a >= LENGTH) else np.ones(b - a, bool)
                out["n_removed"].append(int(x.sum()))
                out["n_spans"].append(int(x[:1].sum() + (x[1:] & ~x[:-1]).sum()))
                left = c.data[a:b][~x].tobytes()
                kept_texts.append(left)
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            at += len(c)
        n_bytes = [r + len(k) for r, k in zip(out["n_removed"], kept_texts, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(kept_texts, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (the remaining bytes) of every document."""
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    meta = cut(text_classes(docs))
    total = meta.agg(F.sum("n_bytes")).first()[0] or 0
    n_anchors, n_strings = max(64, total // (16 * BUCKET)), max(64, total // STRINGS)
    classes = cut(meta.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")))
    keyed = _keyed(docs)
    anchored, stringed = _deal.Deal(_ANCHOR, n_anchors), _deal.Deal(_STRING, n_strings)
    shared = anchored.met(_post(keyed, n_anchors, anchored), _shared(n_anchors, anchored), anchored.schema, _split(n_anchors))
    shared = cut(anchored.met(shared, _by_text, "key long, shared binary"))
    # Texts, not ids, are looked at: an id with several texts has several rows here.
    wanted = classes.join(shared, F.col("k1") == F.col("key")).select(F.col("rep").alias("id"), "key", "shared")
    here = (F.col("doc_id") == F.col("id")) & (F.col("k1") == F.col("key"))
    strings = keyed.join(wanted, here).select("doc_id", "text", "k1", "shared").mapInArrow(_strings(n_anchors, n_strings, stringed), stringed.schema)
    found = stringed.met(strings, _found, "id long, key long, number binary, mask binary")
    found = found.groupBy("id", "key").agg(F.collect_list("number").alias("number"), F.collect_list("mask").alias("mask"))
    copies = meta.join(classes, ["k1", "k2"]).where("doc_id <> rep").select(F.col("doc_id").alias("copy_id"), F.col("k1").alias("copy_key")).distinct()
    rows = keyed.join(found, here, "left").join(copies, (F.col("doc_id") == F.col("copy_id")) & (F.col("k1") == F.col("copy_key")), "left")
    rows = rows.select("doc_id", "text", F.col("copy_id").isNotNull().alias("copy"), "number", "mask")
    return rows.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
