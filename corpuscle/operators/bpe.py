"""Byte-level BPE on DataFrames: counting, training, encoding, decoding, the model's tables.

A pretoken is a string of bracketed hex symbols, ``<74><68>``; a merge is a string
replacement.  A model is a DataFrame ``(rank, a, b, merged, n)`` of hex strings.

Counting is distributed: texts become distinct pretokens with weighted counts.
Few merges are trained as a chain of DataFrames (:func:`merge_tables`).  Many are
trained by :func:`train` from all counted pretokens: on the driver with counts kept
up to date where there are ``max_words`` at most, else distributed, with several
merges a pass (:func:`train_spread`); the merges are the same.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .cleaning import once

MODEL = "rank int, a string, b string, merged string, n long"
#: Pairs that the driver sees in a distributed pass.
TOP = 512


def pretoken_counts(docs: DataFrame, weights: dict[str, int] | None = None, by: list[str] | None = None, whitespace: str = "space") -> DataFrame:
    """``pretoken`` and ``freq``: how often each stands, times its language's weight (1 where there is none)."""
    by = by or []
    rows = docs.select(*by, *(["lang"] if weights and "lang" not in by else []), F.explode(T.pretokens("text", whitespace)).alias("pretoken"))
    if not weights:
        return rows.groupBy(*by, "pretoken").agg(F.count("*").alias("freq"))
    counted = rows.groupBy(*by, *([] if "lang" in by else ["lang"]), "pretoken").agg(F.count("*").alias("n"))
    table = counted.sparkSession.createDataFrame(list(weights.items()), "w_lang string, weight long")
    joined = counted.join(F.broadcast(table), F.col("lang") == F.col("w_lang"), "left")
    return joined.groupBy(*by, "pretoken").agg(F.sum(F.col("n") * F.coalesce("weight", F.lit(1))).alias("freq"))


def with_symbols(words: DataFrame) -> DataFrame:
    return words.withColumn("symbols", T.symbols(F.col("pretoken")))


def pair_counts(words: DataFrame) -> DataFrame:
    """``a``, ``b``, ``n``: weighted counts of adjacent symbols, overlaps included; from ``symbols`` and ``freq``."""
    s = F.split(F.substring(F.col("symbols"), F.lit(2), F.length("symbols") - 2), "><")
    pairs = F.arrays_zip(F.slice(s, F.lit(1), F.size(s) - 1).alias("a"), F.slice(s, F.lit(2), F.size(s) - 1).alias("b"))
    return words.where(F.length("symbols") > 4).select("freq", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("freq").alias("n"))


def best_pair(pairs: DataFrame) -> tuple[str, str, int] | None:
    """The most frequent pair, ties to the smaller symbols; None below 2."""
    row = pairs.where("n >= 2").orderBy(F.desc("n"), "a", "b").limit(1).first()
    return (row["a"], row["b"], row["n"]) if row else None


def apply_merge(symbols: Column, a: str, b: str) -> Column:
    """Left to right, without overlaps."""
    return F.replace(symbols, F.lit(f"<{a}><{b}>"), F.lit(f"<{a}{b}>"))


def merge_tables(words: DataFrame, merges: int) -> list[tuple[str, str, int]]:
    """Merges trained with one aggregation each over distinct pretokens; for a few dozen."""
    words = with_symbols(words).select("freq", "symbols").persist()
    out = []
    try:
        for _ in range(max(0, merges)):
            found = best_pair(pair_counts(words.select("freq", reduce(lambda c, m: apply_merge(c, m[0], m[1]), out, F.col("symbols")).alias("symbols"))))
            if found is None:
                break
            out.append(found)
    finally:
        words.unpersist()
    return out


def train(words: DataFrame, vocab_size: int, min_count: int = 2, max_words: int = 2_000_000) -> list[tuple[str, str, int]]:
    """Merges up to ``vocab_size`` (256 bytes included) from all words: on the driver up to ``max_words`` of them, else distributed."""
    return train_symbols(with_symbols(words), vocab_size - 256, min_count, max_words)


def train_symbols(words: DataFrame, merges: int, min_count: float = 2, max_words: int = 2_000_000) -> list[tuple[str, str, int]]:
    """The merges of ``symbols`` and ``freq``."""
    words = once(words.select("symbols", "freq"))
    if words.count() > max_words:
        return train_spread(words, merges, min_count)
    rows = words.orderBy(F.desc("freq"), "symbols").toPandas()
    return train_local([(s[1:-1].split("><"), f) for s, f in zip(rows["symbols"], rows["freq"], strict=True) if s], merges, min_count)


def independent(top: list[tuple[str, str, float]], whole: bool, known: set[str]) -> list[tuple[str, str, float]]:
    """The first pairs of ``top`` that training one by one would merge too, in the same order and with the same counts.

    A pair keeps its count while no pair before it ends where it begins or begins
    where it ends.  A new pair (x, ab) is at most as frequent as (x, a), one (ab, y)
    as (b, y), so it comes later while none of these is as frequent as the pair in
    question.  A pair of two equal symbols, or one whose result is a symbol already,
    ends the pass.  Unless ``top`` is ``whole``, its last count may have more pairs.
    """
    out = []
    for k, (a, b, n) in enumerate(top):
        if out:
            rivals = [x for x in top[k:] if x[2] >= n * (1 - 1e-9)]
            if not whole and len(rivals) == len(top) - k or any(x[1] == c or x[0] == d for x in rivals for c, d, _ in out):
                break
        out.append((a, b, n))
        if a == b or a + b in known:
            break
        known.add(a + b)
    return out


def train_spread(words: DataFrame, merges: int, min_count: float = 2, few: int = 32) -> list[tuple[str, str, int]]:
    """The same merges with every word kept distributed: a pass counts the pairs of all words, and makes the merges that are independent.

    Up to ``few`` merges are made anew from ``words`` in each pass, so that no pass leaves a table behind.
    """
    out, known, whole = [], set(), words
    while len(out) < merges:
        top = pair_counts(words).where(F.col("n") >= min_count).orderBy(F.desc("n"), "a", "b").limit(TOP).collect()
        if not top:
            break
        found = independent([tuple(r) for r in top], len(top) < TOP, known)[: merges - len(out)]
        out += found
        known |= {a + b for a, b, _ in found}
        if merges <= few:
            words = whole.withColumn("symbols", encode_symbols(F.col("symbols"), out))
            continue
        words = words.withColumn("symbols", reduce(lambda c, m: apply_merge(c, m[0], m[1]), found, F.col("symbols")))
        words = once(words)
    return out


def train_local(words: list[tuple[list[str], float]], merges: int, min_count: float = 2) -> list[tuple[str, str, int]]:
    """The same merges from a list of (symbols, count)."""
    words = [[list(s), f] for s, f in words]
    count: dict[tuple[str, str], float] = defaultdict(int)
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for i, (s, f) in enumerate(words):
        for p in zip(s, s[1:]):
            count[p] += f
            where[p].add(i)
    heap = [(-n, p) for p, n in count.items()]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < merges:
        n, p = heapq.heappop(heap)
        if -n != count.get(p, 0):
            continue  # an old entry; the pair's present one is in the heap too
        if -n < min_count:
            break
        out.append((p[0], p[1], -n))
        joined, touched = p[0] + p[1], set()
        for i in where.pop(p):
            s, f = words[i]
            for q in zip(s, s[1:]):
                count[q] -= f
                touched.add(q)
            new, k = [], 0
            while k < len(s):
                if k + 1 < len(s) and s[k] == p[0] and s[k + 1] == p[1]:
                    new.append(joined)
                    k += 2
                else:
                    new.append(s[k])
                    k += 1
            words[i][0] = new
            for q in zip(new, new[1:]):
                count[q] += f
                where[q].add(i)
                touched.add(q)
        count.pop(p, None)
        for q in touched:
            if q != p and count[q] > 0:
                heapq.heappush(heap, (-count[q], q))
            elif count[q] <= 0:
                count.pop(q, None)
    return out


def model(spark: SparkSession, merges: list[tuple[str, str, int]]) -> DataFrame:
    return spark.createDataFrame([(i, a, b, a + b, int(n)) for i, (a, b, n) in enumerate(merges)], MODEL)


def merges_of(table: DataFrame) -> list[tuple[str, str, int]]:
    return [(r["a"], r["b"], r["n"]) for r in table.orderBy("rank").collect()]


def vocabulary(spark: SparkSession, merges: list[tuple[str, str, int]]) -> DataFrame:
    """``id`` and ``token`` (hex): the 256 bytes, then each merged token at its first appearance."""
    return spark.createDataFrame(list(enumerate(vocabulary_list(merges))), "id int, token string")


def missing_operands(merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """Symbols that merges use or make and the vocabulary lacks; empty for a closed model."""
    used = merges.select(F.explode(F.array("a", "b", F.concat("a", "b"))).alias("token")).distinct()
    return used.join(vocab, "token", "left_anti")


def encode_symbols(symbols: Column, merges: list[tuple[str, str, int]]) -> Column:
    """Few merges: replacements in rank order, which equals merging the lowest rank first."""
    return reduce(lambda c, m: apply_merge(c, m[0], m[1]), merges, symbols)


def encode_word(symbols: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    """Merge the pair of lowest rank, leftmost first, until none is left."""
    n = len(symbols)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    s = list(symbols)
    heap = [(rank[p], i) for i, p in enumerate(zip(s, s[1:])) if p in rank]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or rank.get((s[i], s[j])) != r:
            continue
        s[i] += s[j]
        alive[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (q := rank.get((s[k], s[after[k]]))) is not None:
                heapq.heappush(heap, (q, k))
    return [x for x, a in zip(s, alive, strict=True) if a]


def encoded_pretokens(words: DataFrame, merges: list[tuple[str, str, int]], few: int = 32) -> DataFrame:
    """``pretoken`` and ``tokens`` (hex) of distinct pretokens."""
    if len(merges) <= few:
        return words.select("pretoken", T.symbol_list(encode_symbols(T.symbols(F.col("pretoken")), merges)).alias("tokens"))
    rank = {}
    for i, (a, b, _) in enumerate(merges):
        rank.setdefault((a, b), i)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: encode_word(x[1:-1].split("><"), rank) if x else [])

    return words.select("pretoken", run(T.symbols(F.col("pretoken"))).alias("tokens"))


def encode(docs: DataFrame, merges: list[tuple[str, str, int]], whitespace: str = "space", few: int = 32) -> DataFrame:
    """``tokens`` (hex, in order) of every document, beside its columns.

    Few merges are replacements within the row.  Many are applied once a batch to
    its distinct pretokens; nothing is shuffled either way.
    """
    pieces = T.pretokens("text", whitespace)
    if len(merges) <= few:
        return docs.withColumn("tokens", F.flatten(F.transform(pieces, lambda t: T.symbol_list(encode_symbols(T.symbols(t), merges)))))
    rank = {}
    for i, (a, b, _) in enumerate(merges):
        rank.setdefault((a, b), i)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        known: dict[str, list[str]] = {}

        def of(t: str) -> list[str]:
            if t not in known:
                known[t] = encode_word([f"{b:02X}" for b in t.encode()], rank)
            return known[t]

        return s.map(lambda x: [y for t in x for y in of(t)])

    return docs.withColumn("tokens", run(pieces))


def vocabulary_list(merges: list[tuple[str, str, int]]) -> list[str]:
    """Tokens (hex) by id: the 256 bytes, then each merged token at its first appearance."""
    return list(dict.fromkeys([f"{b:02X}" for b in range(256)] + [a + b for a, b, _ in merges]))


def token_ids(tokens: Column, vocab: list[str], strict: bool = False) -> Column:
    """Ids of tokens; where the vocabulary lacks one, null, or with ``strict`` an error."""
    known = {t: i for i, t in enumerate(vocab)}

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        def of(x):
            if x is None:
                return None
            if strict and (lost := [t for t in x if t not in known]):
                raise ValueError(f"no such token: {lost[0]}")
            return [known.get(t) for t in x]

        return s.map(of)

    return run(tokens)


def encoded(text: Column, merges: list[tuple[str, str, int]], whitespace: str = "space") -> Column:
    """``tokens`` (hex) and ``ids`` of a text; a batch encodes each of its distinct pretokens once."""
    rank, number = {}, {t: i for i, t in enumerate(vocabulary_list(merges))}
    for i, (a, b, _) in enumerate(merges):
        rank.setdefault((a, b), i)

    @F.pandas_udf("tokens array<string>, ids array<int>")
    def run(s: pd.Series) -> pd.DataFrame:
        known: dict[str, tuple[list[str], list[int]]] = {}
        tokens, ids = [], []
        for pieces in s:
            t, n = [], []
            for piece in pieces:
                got = known.get(piece)
                if got is None:
                    word = encode_word([f"{b:02X}" for b in piece.encode()], rank)
                    got = known[piece] = (word, [number[x] for x in word])
                t += got[0]
                n += got[1]
            tokens.append(t)
            ids.append(n)
        return pd.DataFrame({"tokens": tokens, "ids": ids})

    return run(T.pretokens(text, whitespace))


def encode_report(docs: DataFrame, merges: list[tuple[str, str, int]]) -> DataFrame:
    """One row a document: tokens, ids, words, token_count, fertility, decoded and roundtrip_ok, over the stripped text."""
    rows = docs.withColumn("text", T.strip("text")).withColumn("_x", encoded(F.col("text"), merges))
    rows = rows.withColumn("tokens", F.col("_x.tokens")).withColumn("ids", F.col("_x.ids")).drop("_x")
    rows = rows.withColumn("words", T.word_count("text")).withColumn("token_count", F.size("tokens").cast("long")).withColumn("decoded", T.tokens_text(F.col("tokens")))
    rows = rows.withColumn("fertility", F.try_divide("token_count", "words")).withColumn("roundtrip_ok", T.visible("decoded") == T.visible("text"))
    return rows.withColumn("tokens_display", F.transform("tokens", T.byte_display))


def decode_ids(rows: DataFrame, vocab: DataFrame, key: str, ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` from arrays of ids, a row a row: no ids give the empty text, null gives null; an id that the vocabulary lacks raises.

    The vocabulary is one array beside the rows (as large as the vocabulary, whatever
    the table), so nothing is exploded or shuffled.
    """
    entries = vocab.agg(F.map_from_entries(F.collect_list(F.struct("id", "token"))).alias("m"), F.max("id").alias("top"))
    table = entries.select(F.transform(F.sequence(F.lit(0), "top"), lambda i: F.try_element_at("m", i)).alias("_vocab"))
    known = rows.select(key, F.col(ids).alias("_ids")).join(F.broadcast(table))

    def token(i: Column) -> Column:
        found = F.when(i >= 0, F.get("_vocab", i))
        return F.when(found.isNull(), F.raise_error(F.concat(F.lit("no such id: "), F.coalesce(i.cast("string"), F.lit("null"))))).otherwise(found)

    return known.select(key, T.tokens_text(F.transform("_ids", token)).alias("text"))


def decode_tokens(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``text`` from arrays of hex tokens, beside the columns."""
    return rows.withColumn("text", T.tokens_text(F.col(tokens)))
