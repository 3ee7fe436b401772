"""Piece vocabularies over characters: ``▁`` marks spaces, the alphabet comes from the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs
from . import bpe
from .cleaning import once

#: Fixed value: least number of characters that the alphabet may have.
ALPHABET = 2000


def alphabet(docs: DataFrame) -> DataFrame:
    """``ch`` and ``n``: the corpus's characters but the line end, with their counts."""
    return docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "")).alias("ch")).where("ch not in ('', '\n')").groupBy("ch").agg(F.count("*").alias("n"))


def piece_counts(docs: DataFrame, weights: dict[str, int] | None = None, form: str = "NFKC") -> DataFrame:
    """``piece`` and ``freq`` over lines in a normal form, weighted by language."""
    lines = docs.select("lang", F.explode(F.split(udfs.normaliser(form)(F.coalesce("text", F.lit(""))), "\n")).alias("text")).where(~T.is_blank("text"))
    weight = F.coalesce(*(F.when(F.col("lang") == k, F.lit(v)) for k, v in (weights or {}).items()), F.lit(1))
    rows = lines.select("lang", F.explode(T.metaspace("text")).alias("piece")).groupBy("lang", "piece").agg(F.count("*").alias("n"))
    return rows.groupBy("piece").agg(F.sum(F.col("n") * weight).alias("freq"))


def train(docs: DataFrame, vocab_size: int = 10000, weights: dict[str, int] | None = None, max_words: int = 2_000_000) -> tuple[list[str], list[tuple[str, str, int]]]:
    """Vocabulary and merges: the characters by code point, then merged pieces; single occurrences merge too.

    Characters train as hex of UTF-8, whose order is that of code points.
    """
    counts = once(piece_counts(docs, weights))
    chars = [r["ch"] for r in counts.select(F.explode(F.split("piece", "")).alias("ch")).where("ch <> ''").distinct().collect()]
    chars = sorted(chars)
    limit = max(len(chars) + 100, ALPHABET)
    vocab = chars[:limit]
    hexed = F.transform(F.filter(F.split("piece", ""), lambda c: c != ""), lambda c: F.hex(F.encode(c, "UTF-8")))
    words = counts.select(F.concat(F.lit("<"), F.array_join(hexed, "><"), F.lit(">")).alias("symbols"), "freq")
    text = lambda x: bytes.fromhex(x).decode()
    merges = [(text(a), text(b), n) for a, b, n in bpe.train_symbols(words, vocab_size - len(vocab), 1, max_words)]
    return list(dict.fromkeys(vocab + [a + b for a, b, _ in merges])), merges


def encode(texts: list[str], merges: list[tuple[str, str, int]]) -> list[list[str]]:
    """Pieces of a few texts."""
    rank = {}
    for i, (a, b, _) in enumerate(merges):
        rank.setdefault((a, b), i)
    out = []
    for t in texts:
        marked = t.replace(" ", "▁")
        cuts = [0, *(i for i, c in enumerate(marked) if c == "▁" and i), len(marked)]
        out.append([x for a, b in zip(cuts, cuts[1:]) if b > a for x in bpe.encode_word(list(marked[a:b]), rank)])
    return out
