"""One query an operator over the driver's tables, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs
from ..operators import bpe, cleaning, fertility, mixture
from ..sources import corpora, sinks

#: Merges that the queries train, and languages' weights in weighted counts.
MERGES = 12
WEIGHTS = {"en": 2, "fr": 3, "de": 5, "es": 2}
#: Weights that the grid tries for each language: those of the shipped tokenizer, and 1.
GRID = [1.0, 2.0, 3.0, 5.0]
#: Texts that the round trip must keep, beside lines of the corpus: numbers beside letters, joiners, marks, odd white space, other scripts.
SAMPLES = (
    "x2y 3.14 ½ Ⅻ 10\u00a0km",
    "क्\u200dष और ज़ो\u0301र",
    "tab\there\u3000wide  two",
    "naïve cafe\u0301 ﬁn ＡＢ",
    "`a_b` **c** [d](e) | f |",
    "👩\u200d💻 → ∑ €5",
)
LEXICON = ["idiot", "moron", "scum", "trash", "stupid", "loser", "pathetic", "worthless", "clown", "disgusting"]
THRESHOLDS = {"en": 4.0, "fr": 5.0, "de": 5.0, "es": 5.0}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _merges(docs: DataFrame, k: int = MERGES) -> list:
    return bpe.merge_tables(bpe.pretoken_counts(docs), k)


def corpus_alphabet(spark, sf_dir):
    """Distinct characters but the line end."""
    chars = _docs(spark, sf_dir).select(F.explode(F.split("text", "")).alias("ch")).distinct()
    return chars.where("ch not in ('', '\n')").select("ch", F.ascii("ch").alias("code_point")).orderBy("code_point")


def corpus_stats(spark, sf_dir):
    return sinks.metadata(_docs(spark, sf_dir))


def words_and_units(spark, sf_dir):
    rows = _docs(spark, sf_dir).groupBy("lang")
    return rows.agg(F.sum(T.word_count("text")).alias("words"), F.sum(T.unit_count("text")).alias("faithful_units"))


def visible_characters(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.length(T.visible("text")).cast("long").alias("visible"), F.length(T.strip("text")).cast("long").alias("stripped"), F.size(F.filter(T.lines("text"), lambda x: ~T.is_blank(x))).cast("long").alias("lines"))


def pretoken_summary(spark, sf_dir):
    counts = bpe.pretoken_counts(_docs(spark, sf_dir), by=["lang"])
    return counts.groupBy("lang").agg(F.sum("freq").alias("pretokens"), F.count("*").alias("distinct_pretokens"))


def weighted_pretokens(spark, sf_dir):
    return bpe.pretoken_counts(_docs(spark, sf_dir), WEIGHTS)


def pair_counts(spark, sf_dir):
    return bpe.pair_counts(bpe.with_symbols(bpe.pretoken_counts(_docs(spark, sf_dir))))


def bpe_merges(spark, sf_dir):
    return bpe.model(spark, _merges(_docs(spark, sf_dir)))


def bpe_vocabulary(spark, sf_dir):
    return bpe.vocabulary(spark, _merges(_docs(spark, sf_dir)))


def fertility_by_language(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return fertility.by_language(docs, _merges(docs))


def fertility_by_line(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return fertility.by_line(docs, _merges(docs))


def labelled_rates(spark, sf_dir):
    """Rates with their languages' labels and codes."""
    return fertility.with_labels(fertility_by_language(spark, sf_dir), corpora.languages(spark)).select("lang", "label", "code", "fertility_u")


def token_lookup(spark, sf_dir):
    """Tokens looked up in the vocabulary; a token that it lacks is an error."""
    docs = _docs(spark, sf_dir)
    merges = _merges(docs)
    rows = bpe.encode(docs, merges).withColumn("ids", bpe.token_ids(F.col("tokens"), bpe.vocabulary_list(merges), strict=True))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("id_sum"))


def fertility_score(spark, sf_dir):
    return fertility.score(fertility_by_language(spark, sf_dir), penalised="de")


def fertility_ranking(spark, sf_dir):
    rates = fertility_by_language(spark, sf_dir)
    whole = Window.partitionBy()
    return rates.select("lang", "fertility_u", F.rank().over(whole.orderBy("fertility_u")).alias("place"), (F.col("fertility_u") == F.min("fertility_u").over(whole)).alias("best"), (F.col("fertility_u") == F.max("fertility_u").over(whole)).alias("worst"))


def fertility_targets(spark, sf_dir):
    return fertility.meets_targets(fertility_by_language(spark, sf_dir).select(F.col("lang").alias("domain"), F.col("fertility_w").alias("rate")))


def domain_rates(spark, sf_dir):
    """Tokens by each domain's own measure: documents by language, web pages as code, event properties as JSON."""
    docs = _docs(spark, sf_dir)
    rows = docs.select(F.col("lang").alias("domain"), "text")
    rows = rows.unionByName(_table(spark, sf_dir, "pages").select(F.lit("code").alias("domain"), F.col("html").alias("text")))
    rows = rows.unionByName(_table(spark, sf_dir, "events").select(F.lit("json").alias("domain"), F.col("props").alias("text")))
    return fertility.by_domain(rows, _merges(docs))


def rebalanced_weights(spark, sf_dir):
    return fertility.rebalanced(fertility_by_language(spark, sf_dir), WEIGHTS)


def rebalancing_rounds(spark, sf_dir):
    log, best = fertility.training_rounds(_docs(spark, sf_dir), 256 + 64, 3)
    rows = spark.createDataFrame([(x["round"], x["spread"], x["score"], x["round"] == best["round"]) for x in log], "round int, spread double, score double, best boolean")
    return rows.withColumn("best_so_far", F.max("score").over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)))


def weight_grid(spark, sf_dir):
    """Every language at each weight of the grid, as many merges as in the re-balancing rounds."""
    found = fertility.grid_search(_docs(spark, sf_dir), 256 + 64, {x: GRID for x in WEIGHTS})
    return spark.createDataFrame([(x["weights"], x["spread"], x["score"]) for x in found], "weights map<string,double>, spread double, score double")


def trained_vocabulary(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return bpe.vocabulary(spark, bpe.train(bpe.pretoken_counts(docs), 512))


def encode_documents(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    rows = bpe.encode_report(docs, _merges(docs))
    return rows.select("doc_id", "token_count", "words", "fertility", "roundtrip_ok", F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("id_sum"))


def decode_documents(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    merges = _merges(docs)
    rows = bpe.encode_report(docs, merges).select("doc_id", "ids")
    return bpe.decode_ids(rows, bpe.vocabulary(spark, merges), "doc_id").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def merge_closure(spark, sf_dir):
    merges = _merges(_docs(spark, sf_dir))
    missing = bpe.missing_operands(bpe.model(spark, merges), bpe.vocabulary(spark, merges))
    return missing.agg(F.count("*").alias("missing"))


def roundtrip_gate(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    rows = docs.select("lang", "doc_id", F.posexplode(T.lines("text")).alias("line_no", "text")).where(~T.is_blank("text"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id", "line_no"))).where("r <= 40").select("text")
    samples = spark.createDataFrame([(x,) for x in SAMPLES], "text string")
    return fertility.gate(bpe.decode_tokens(bpe.encode(samples.unionByName(first), _merges(docs)).withColumn("source", F.col("text")).drop("text")).select(F.col("source").alias("text"), F.col("text").alias("decoded")))


def tokenizer_document(spark, sf_dir):
    return sinks.tokenizer_document(spark, _merges(_docs(spark, sf_dir)))


def vocabulary_lines(spark, sf_dir):
    return sinks.vocabulary_lines(bpe_vocabulary(spark, sf_dir))


def metaspace_pieces(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.metaspace("text")).cast("long").alias("pieces"), (T.metaspace_text(T.metaspace("text")) == F.col("text")).alias("lossless"))


def display_escapes(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.quote("url").alias("quoted"), F.sha2(T.html_escape("html"), 256).alias("escaped_sha256"))


def nfc_texts(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return cleaning.normalised(docs, "NFC").select("doc_id", F.sha2("text", 256).alias("nfc_sha256"), cleaning.joiners("text").alias("joiners"))


def nfkc_texts(spark, sf_dir):
    return cleaning.normalised(_docs(spark, sf_dir), "NFKC").select("doc_id", F.sha2("text", 256).alias("nfkc_sha256"))


def html_to_markdown(spark, sf_dir):
    return corpora.pages_markdown(_table(spark, sf_dir, "pages"))


def language_scores(spark, sf_dir):
    return cleaning.language_scores(_docs(spark, sf_dir)).select("doc_id", "n_de", "n_en", "n_es", "n_fr", "n_hi", "n_ta", "n_te", "n_bn", "n_romanised", "lang_pred", "mix_share")


def exact_duplicates(spark, sf_dir):
    return cleaning.exact_duplicates(_docs(spark, sf_dir))


def duplicate_groups(spark, sf_dir):
    return cleaning.exact_duplicates(_docs(spark, sf_dir)).groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def paragraph_duplicates(spark, sf_dir):
    return cleaning.paragraph_duplicates(_docs(spark, sf_dir)).select("doc_id", "pos", "copies", "kept")


def texts_without_repeats(spark, sf_dir):
    return cleaning.without_repeated_paragraphs(_docs(spark, sf_dir)).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def minhash_links(spark, sf_dir):
    return cleaning.minhash_links(_docs(spark, sf_dir))


def paragraph_links(spark, sf_dir):
    return cleaning.paragraph_links(_docs(spark, sf_dir))


def code_clones(spark, sf_dir):
    return cleaning.code_clones(_docs(spark, sf_dir))


def contaminated(spark, sf_dir):
    return cleaning.contaminated(_docs(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def decontaminated(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs.join(cleaning.contaminated(docs, _table(spark, sf_dir, "benchmark")).select("doc_id"), "doc_id", "left_anti").select("doc_id")


def quality_filter(spark, sf_dir):
    return cleaning.quality_filter(_docs(spark, sf_dir)).select("doc_id", "lang", "letters", "least", "kept")


def license_allowlist(spark, sf_dir):
    found = cleaning.license_of("text")
    return _docs(spark, sf_dir).select("doc_id", found.alias("license"), found.isin(*cleaning.ALLOWED).alias("allowed"))


def secret_scrub(spark, sf_dir):
    return cleaning.scrubbed(_docs(spark, sf_dir)).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "redactions")


def personal_data(spark, sf_dir):
    return cleaning.personal_data(_docs(spark, sf_dir))


def aadhaar_numbers(spark, sf_dir):
    return cleaning.aadhaar_numbers(_docs(spark, sf_dir))


def code_checks(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", cleaning.is_generated("text").alias("generated"), udfs.parses(F.col("text")).alias("parses"))


def written_documents(spark, sf_dir):
    return cleaning.without_generated(_docs(spark, sf_dir)).select("doc_id")


def masked_texts(spark, sf_dir):
    return cleaning.masked(_docs(spark, sf_dir)).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def toxicity_thresholds(spark, sf_dir):
    return cleaning.toxicity_thresholds(_docs(spark, sf_dir), LEXICON, THRESHOLDS)


def toxicity_audit(spark, sf_dir):
    rows = cleaning.toxicity_thresholds(_docs(spark, sf_dir), LEXICON, THRESHOLDS).where("flagged")
    return cleaning.audit_sample(rows, "lang", 20).select("doc_id", "lang")


def labelled_documents(spark, sf_dir):
    return cleaning.labelled(_docs(spark, sf_dir), _table(spark, sf_dir, "labels")).select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


def cleaning_funnel(spark, sf_dir):
    return cleaning.funnel(_docs(spark, sf_dir), _table(spark, sf_dir, "benchmark"), LEXICON, THRESHOLDS)


_TARGETS = (("en", 50.0), ("fr", 20.0), ("de", 20.0), ("es", 10.0))


def _mixture(spark, sf_dir):
    targets = spark.createDataFrame([(k, v / 100) for k, v in _TARGETS], "slice string, target double")
    return mixture.shares(_docs(spark, sf_dir).withColumn("words", T.word_count("text")), "lang", "words", targets)


def mixture_shares(spark, sf_dir):
    return _mixture(spark, sf_dir)


def mixture_sample(spark, sf_dir):
    return mixture.sample(_docs(spark, sf_dir), "lang", _mixture(spark, sf_dir)).select("doc_id", "lang")


def fine_tuning_shares(spark, sf_dir):
    targets = spark.createDataFrame([("user", 0.45), ("assistant", 0.45), ("system", 0.1)], "slice string, target double")
    return mixture.shares(_table(spark, sf_dir, "conversations").withColumn("turns", F.lit(1).cast("long")), "role", "turns", targets)


def fine_tuning_sample(spark, sf_dir):
    """Turns taken at the rates of :func:`fine_tuning_shares`."""
    turns = _table(spark, sf_dir, "conversations").withColumn("place", F.concat_ws(":", "conv_id", "turn"))
    return mixture.sample(turns, "role", fine_tuning_shares(spark, sf_dir), "place", "sft").select("conv_id", "turn", "role")


def recovery_rate(spark, sf_dir):
    return mixture.recovery_rate(_table(spark, sf_dir, "conversations"), "(?i)error|sorry|th")


def recoveries(spark, sf_dir):
    return mixture.recoveries(_table(spark, sf_dir, "conversations"), "(?i)error|sorry|th")


def annotator_quota(spark, sf_dir):
    return mixture.quota(_docs(spark, sf_dir), ["lang", "source"], 3, "doc_id").select("doc_id", "lang", "source", "pick")


def synthetic_cap(spark, sf_dir):
    return mixture.capped(_docs(spark, sf_dir).withColumn("synthetic", F.coalesce(F.col("source") == "src3", F.lit(False))), "synthetic")


def language_quality_bars(spark, sf_dir):
    rows = cleaning.labelled(_docs(spark, sf_dir), _table(spark, sf_dir, "labels")).where("quality is not null")
    scores = rows.groupBy(F.col("lang").alias("metric")).agg(F.avg(F.col("quality").cast("double")).alias("value"))
    table = spark.createDataFrame([("de", 0.8), ("en", 0.8), ("es", 0.8), ("fr", 0.8), ("hi", 0.8)], "metric string, bar double")
    return mixture.bars(scores, table)


def call_schema_accuracy(spark, sf_dir):
    return mixture.schema_accuracy(_table(spark, sf_dir, "events"), "props", "k int", "k")


def quality_by_source(spark, sf_dir):
    rows = cleaning.labelled(_docs(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return mixture.pivot(rows.withColumn("q", F.col("quality").cast("double")), "source", "lang", ["de", "en", "es", "fr"], "q")


def embedding_cost(spark, sf_dir):
    return fertility.embedding_cost(spark)


def vocabulary_budget(spark, sf_dir):
    return mixture.vocabulary_budget(spark)


def token_epochs(spark, sf_dir):
    words = _docs(spark, sf_dir).agg(F.sum(T.word_count("text")).cast("double").alias("unique_tokens"))
    n = F.try_divide(F.lit(1e6), "unique_tokens")
    return words.select(F.lit(1e6).alias("budget"), "unique_tokens", n.alias("epochs"), (n <= 2).alias("within_cap"))


def vocabulary_choice(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    counts = bpe.pretoken_counts(docs)
    rows = []
    words = docs.agg(F.sum(T.word_count("text")).alias("w")).first()["w"]
    merges = bpe.merge_tables(counts, MERGES)
    for k in (4, 8, MERGES):
        n = F.size(T.symbol_list(bpe.encode_symbols(T.symbols(F.col("pretoken")), merges[:k])))
        tokens = counts.agg(F.sum(F.col("freq") * n).alias("t")).first()["t"]
        rows.append((256 + k, tokens, bool(words) and tokens / words <= 6.0))
    options = spark.createDataFrame(rows, "vocab int, tokens long, meets boolean")
    return fertility.choose_vocabulary(options)
