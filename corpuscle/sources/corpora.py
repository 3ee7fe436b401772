"""Reading: corpora by language, metadata, metrics, tokenizer documents, page extracts, pasted texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs

#: Languages by code with label and page title.
LANGUAGES = (("en", "English", "India"), ("hi", "Hindi", "भारत"), ("te", "Telugu", "భారతదేశం"), ("ta", "Tamil", "இந்தியா"))

META = "language string, code string, title string, source string, chars long, lines long, normalization string"
METRICS = "vocab_size int, per_language map<string, struct<label string, tokens long, faithful_units long, fertility double>>, spread double, raw_score double, hindi_penalty_factor double, hindi_adjusted_score double, fertility_threshold double, languages_over_threshold array<string>, faithful_roundtrip_gate string, gate_failures array<struct<sample string, decoded string>>"
TOKENIZER = "model struct<vocab: map<string, int>, merges: array<string>>, vocab map<string, int>, merges array<array<string>>"
_PAIRED = "model struct<vocab: map<string, int>, merges: array<array<string>>>"
EXTRACT = "query struct<pages: map<string, struct<title: string, extract: string, missing: string>>>"


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANGUAGES), "lang string, label string, title string")


def corpus(spark: SparkSession, folder: str, suffix: str = ".faithful.txt") -> DataFrame:
    """``lang`` and ``text``: one row a file ``<lang><suffix>``."""
    rows = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return rows.select(F.substring_index(name, ".", 1).alias("lang"), F.col("value").alias("text"))


def written_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``lang`` and ``text``: one row a line of what :func:`sinks.write_corpus` wrote."""
    return spark.read.schema("text string, lang string").text(folder).select("lang", "text")


def files(spark: SparkSession, folder: str, suffix: str = ".faithful.txt") -> DataFrame:
    """``path`` and ``length`` of the files with a suffix in a folder, at any depth, by path; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(folder).select("path", "length").orderBy("path")


def corpus_lines(spark: SparkSession, folder: str, suffix: str = ".faithful.txt") -> DataFrame:
    """``lang``, ``line_no`` (from 1), ``line``."""
    rows = corpus(spark, folder, suffix).select("lang", F.posexplode(T.lines("text")).alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no") + 1)


def corpus_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(META).option("pathGlobFilter", "*.meta.json").option("multiLine", True).json(folder)


def written_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The same of what :func:`sinks.write_metadata` wrote: an object a line."""
    return spark.read.schema(META).json(folder)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row a language of a metrics document, with its spread and scores."""
    doc = spark.read.schema(METRICS).option("multiLine", True).json(path)
    return doc.select(F.explode("per_language").alias("lang", "x"), "vocab_size", "spread", "raw_score", F.col("hindi_adjusted_score").alias("adjusted_score")).select("lang", "x.*", "vocab_size", "spread", "raw_score", "adjusted_score")


def tokenizer_vocab(docs: DataFrame, col: str = "document") -> DataFrame:
    """``id`` and ``token`` by id, from tokenizer documents of either layout."""
    x = F.from_json(F.col(col), TOKENIZER)
    paired = F.from_json(F.col(col), _PAIRED)
    vocab = F.coalesce(x["model"]["vocab"], paired["model"]["vocab"], x["vocab"])
    return docs.select(F.explode(F.map_entries(vocab)).alias("e")).select(F.col("e.value").alias("id"), F.col("e.key").alias("token"))


def tokenizer_merges(docs: DataFrame, col: str = "document") -> DataFrame:
    """``rank``, ``a``, ``b``: merges as ``"a b"`` strings or as pairs."""
    c = F.col(col)
    strings = F.from_json(c, "model struct<merges: array<string>>")["model"]["merges"]
    pairs_of = F.from_json(c, _PAIRED)["model"]["merges"]
    legacy = F.from_json(c, "merges array<array<string>>")["merges"]
    in_pairs = F.get_json_object(c, "$.model.merges[0][0]").isNotNull()
    pairs = F.coalesce(F.when(in_pairs, pairs_of), F.transform(strings, lambda m: F.split(m, " ", 2)), legacy)
    return docs.select(F.posexplode(pairs).alias("rank", "m")).select("rank", F.col("m")[0].alias("a"), F.col("m")[1].alias("b"))


def extracts(responses: DataFrame, col: str = "response", least: int = 200) -> DataFrame:
    """``text`` (NFC) and ``error`` of page-extract responses: no pages, a missing page and short texts are errors."""
    page = F.try_element_at(F.map_values(F.from_json(F.col(col), EXTRACT)["query"]["pages"]), F.lit(1))
    rows = responses.withColumn("_page", page)
    body = F.coalesce(F.col("_page")["extract"], F.lit(""))
    error = F.when(F.col("_page").isNull(), "no pages").when(F.col("_page")["missing"].isNotNull(), "missing").when(F.length(T.strip(body)) < least, "too short")
    return rows.withColumn("error", error).withColumn("text", F.when(error.isNull(), udfs.nfc(body))).drop("_page")


def read_through(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``(lang, title)`` that the cache has, with its text, and those it lacks."""
    return wanted.join(cache, ["lang", "title"]), wanted.join(cache, ["lang", "title"], "left_anti")


def refilled(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """The cache with the fetched ``(lang, title, text)`` that it lacks; texts that failed (null) aren't kept."""
    new = fetched.where("text is not null").select("lang", "title", "text").dropDuplicates(["lang", "title"])
    return cache.unionByName(new.join(cache, ["lang", "title"], "left_anti"))


def pasted(pastes: DataFrame, fallback: DataFrame, least: int = 200) -> DataFrame:
    """``lang``, ``text``: a pasted text of more than ``least`` characters, else the fallback's."""
    t = udfs.nfc(T.strip("text"))
    given = pastes.select(F.col("lang").alias("p_lang"), F.when(F.length(T.strip("text")) > least, t).alias("pasted"))
    return fallback.join(given, F.col("lang") == F.col("p_lang"), "left").select("lang", F.coalesce("pasted", "text").alias("text"))


def pages_markdown(pages: DataFrame) -> DataFrame:
    """``page_id`` and ``markdown`` of web pages."""
    return pages.select("page_id", udfs.html_to_markdown(F.col("html")).alias("markdown"))


def weight_arguments(arguments: str | Column) -> Column:
    """``"en=2 hi=3"`` as a map of whole numbers."""
    c = F.lit(arguments) if isinstance(arguments, str) else arguments
    return F.transform_values(F.str_to_map(c, F.lit(" "), F.lit("=")), lambda _, v: v.cast("int"))


def training_request(bodies: DataFrame, col: str = "body") -> DataFrame:
    """``vocab_size``, ``rounds`` (1 to 16), ``languages`` and ``texts`` of request bodies, with defaults."""
    x = F.from_json(F.coalesce(F.col(col), F.lit("{}")), "vocab_size int, rounds int, languages array<string>, texts map<string, string>")
    return bodies.select(
        F.coalesce(x["vocab_size"], F.lit(10000)).alias("vocab_size"),
        F.greatest(F.lit(1), F.least(F.lit(16), F.coalesce(x["rounds"], F.lit(10)))).alias("rounds"),
        F.coalesce(x["languages"], F.array(*(F.lit(c) for c, _, _ in LANGUAGES))).alias("languages"),
        F.coalesce(x["texts"], F.create_map().cast("map<string,string>")).alias("texts"),
    )
