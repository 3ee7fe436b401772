"""Writing: corpora, metadata, metrics, tokenizer documents, vocabularies, reports, runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs
from ..operators import bpe
from ..operators.fertility import THRESHOLD
from . import corpora


def write_corpus(docs: DataFrame, folder: str) -> None:
    """Texts by language, as text files."""
    docs.select("lang", "text").write.mode("overwrite").partitionBy("lang").text(folder)


def metadata(docs: DataFrame, normalization: str = "NFC") -> DataFrame:
    """``lang``, ``chars``, ``lines`` (line ends), ``normalization``."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.groupBy("lang").agg(F.sum(F.length(t)).cast("long").alias("chars"), F.sum(F.regexp_count(t, F.lit("\n"))).cast("long").alias("lines")).withColumn("normalization", F.lit(normalization))


def described(meta: DataFrame, languages: DataFrame, source: str = "") -> DataFrame:
    """Metadata with the fields of :data:`corpora.META`: also each language's label, code and page title."""
    named = languages.select(F.col("lang").alias("code"), "label", "title")
    rows = meta.join(F.broadcast(named), F.col("lang") == F.col("code"), "left")
    return rows.select(F.coalesce("label", "lang").alias("language"), F.col("lang").alias("code"), "title", F.lit(source).alias("source"), "chars", "lines", "normalization")


def write_metadata(docs: DataFrame, folder: str, source: str = "") -> None:
    """One JSON object a language, a line each; :func:`corpora.written_metadata` reads them."""
    described(metadata(docs), corpora.languages(docs.sparkSession), source).write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def metrics_document(rates: DataFrame, scores: DataFrame, vocab_size: int, passed: bool, failures: list[tuple[str, str]] = ()) -> DataFrame:
    """One JSON document from rates by language and their scores, with the keys that :func:`corpora.metrics` reads."""
    label = F.col("label") if "label" in rates.columns else F.col("lang")
    entry = F.struct(label.alias("label"), "tokens", "words", "faithful_units", F.col("fertility_u").alias("fertility"))
    per = rates.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", entry)))).alias("per_language"))
    missed = F.from_json(F.lit(json.dumps([{"sample": a, "decoded": b} for a, b in failures])), "array<struct<sample string, decoded string>>")
    over = F.filter(F.split("languages_over_threshold", ","), lambda x: x != "")
    fields = (
        F.lit(vocab_size).alias("vocab_size"),
        "per_language",
        "spread",
        "raw_score",
        F.col("penalty_factor").alias("hindi_penalty_factor"),
        F.col("adjusted_score").alias("hindi_adjusted_score"),
        F.lit(THRESHOLD).alias("fertility_threshold"),
        over.alias("languages_over_threshold"),
        F.lit("PASS" if passed else "FAIL").alias("faithful_roundtrip_gate"),
        missed.alias("gate_failures"),
    )
    return per.join(F.broadcast(scores)).select(F.to_json(F.struct(*fields)).alias("document"))


def tokenizer_document(spark: SparkSession, merges: list) -> DataFrame:
    """One JSON document of a byte-level BPE model; raises if a merge uses a token that the vocabulary lacks."""
    vocab = bpe.vocabulary(spark, merges)
    table = bpe.model(spark, merges)
    if not bpe.missing_operands(table, vocab).isEmpty():
        raise ValueError("a merge uses a token that the vocabulary lacks")
    shown = vocab.select(T.byte_display(F.col("token")).alias("key"), F.col("id").alias("value"))
    entries = shown.agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("value", "key"))), lambda x: F.struct(x["key"], x["value"]))).alias("vocab"))
    pairs = table.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "a", "b"))), lambda x: F.concat_ws(" ", T.byte_display(x["a"]), T.byte_display(x["b"]))).alias("merges"))
    level = F.struct(F.lit("ByteLevel").alias("type"), F.lit(False).alias("add_prefix_space"))
    return entries.join(F.broadcast(pairs)).select(F.to_json(F.struct(F.lit("1.0").alias("version"), F.lit("unicode-class").alias("pretokenizer"), level.alias("pre_tokenizer"), level.alias("decoder"), F.struct(F.lit("BPE").alias("type"), "vocab", "merges").alias("model"))).alias("document"))


def vocabulary_lines(vocab: DataFrame) -> DataFrame:
    """``id`` and ``line``: id, a tab and the token with what doesn't print escaped."""
    shown = udfs.display(T.hex_text(F.col("token")))
    return vocab.select("id", F.concat_ws("\t", F.col("id").cast("string"), shown).alias("line"))


def report_document(rates: DataFrame, scores: DataFrame, weights: dict, log: list[dict], vocab_size: int) -> DataFrame:
    """One JSON report: vocabulary size, weights, rates by language, scores, round log."""
    spark = rates.sparkSession
    table = spark.createDataFrame([(vocab_size, {k: float(v) for k, v in weights.items()}, [(x["round"], x["spread"], x["score"]) for x in log])], "vocab_size int, weights map<string,double>, round_log array<struct<round int, spread double, score double>>")
    per = rates.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", F.struct("tokens", "words", "fertility_w"))))).alias("per_language"))
    return table.join(F.broadcast(per)).join(F.broadcast(scores)).select(F.to_json(F.struct("vocab_size", "weights", "per_language", "spread", F.col("raw_score").alias("self_score"), "round_log")).alias("document"))


def run_id(config: str) -> str:
    """A reproducible id of a run: 12 hex digits of its configuration's hash."""
    import hashlib

    return hashlib.sha256(config.encode()).hexdigest()[:12]


def summary_lines(rates: DataFrame) -> DataFrame:
    """One line a language, cheapest first, four decimals."""
    text = F.format_string("%s: %,d tokens, %,d units, fertility %.4f", "lang", "tokens", "faithful_units", "fertility_u")
    return rates.orderBy("fertility_u", "lang").select(text.alias("line"))


def save_model(merges: DataFrame, path: str) -> None:
    merges.write.mode("overwrite").parquet(path)
