"""Tokens per word and per unit, by language; spread, score, targets and re-balanced weights."""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import bpe, grid
from .cleaning import once

#: Tokens per unit from which a language counts as expensive, and bounds of one re-balancing step.
THRESHOLD, LOW, HIGH = 1.2, 0.6, 1.8


def by_language(docs: DataFrame, merges: list, few: int = 32) -> DataFrame:
    """``lang``, ``tokens``, ``words``, ``faithful_units``, ``fertility_w``, ``fertility_u``.

    Distinct pretokens are encoded once and counted by language, so the shuffle
    carries distinct pretokens, not texts.
    """
    counts = bpe.pretoken_counts(docs, by=["lang"])
    if len(merges) <= few:
        n = F.size(T.symbol_list(bpe.encode_symbols(T.symbols(F.col("pretoken")), merges)))
        tokens = counts.groupBy("lang").agg(F.sum(F.col("freq") * n).alias("tokens"))
    else:
        # Each distinct pretoken is encoded once, whatever the number of languages.
        known = bpe.encoded_pretokens(counts.select("pretoken").distinct(), merges, few).select(F.col("pretoken").alias("p"), F.size("tokens").alias("n"))
        tokens = counts.join(known, F.col("pretoken") == F.col("p")).groupBy("lang").agg(F.sum(F.col("freq") * F.col("n")).alias("tokens"))
    sizes = docs.groupBy("lang").agg(F.sum(T.word_count("text")).alias("words"), F.sum(T.unit_count("text")).alias("faithful_units"))
    joined = sizes.join(tokens.withColumnRenamed("lang", "t_lang"), F.col("lang").eqNullSafe(F.col("t_lang")), "left")
    tokens_ = F.coalesce("tokens", F.lit(0).cast("long"))
    return joined.select("lang", tokens_.alias("tokens"), "words", "faithful_units", F.try_divide(tokens_, "words").alias("fertility_w"), F.try_divide(tokens_, "faithful_units").alias("fertility_u"))


def by_line(docs: DataFrame, merges: list, few: int = 32) -> DataFrame:
    """The same with the tokens of non-blank lines, each encoded by itself, line ends left out."""
    rows = docs.select("lang", F.explode(T.lines("text")).alias("text")).where(~T.is_blank("text"))
    return by_language(rows, merges, few)


def with_labels(rates: DataFrame, languages: DataFrame) -> DataFrame:
    """Rates with ``label`` and ``code`` of their language; the code is its own label where the table lacks it."""
    named = languages.select(F.col("lang").alias("code"), "label")
    return rates.join(F.broadcast(named), F.col("lang") == F.col("code"), "left").withColumn("label", F.coalesce("label", "lang")).withColumn("code", F.col("lang"))


#: Syntactic units of JSON: marks, strings, numbers and names.
JSON_UNIT = r'[{}\[\]:,]|"(?:[^"\\]|\\.)*"|[^\s{}\[\]:,"]+'


def by_domain(rows: DataFrame, merges: list) -> DataFrame:
    """``domain``, ``tokens``, ``words``, ``characters``, ``json_units``, ``rate``: tokens by the measure of the domain's target.

    ``rows`` has ``domain`` and ``text``.  Code and LaTeX count by characters, JSON by
    syntactic units, other domains by words.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    sizes = rows.groupBy("domain").agg(F.sum(F.length(t)).cast("long").alias("characters"), F.sum(F.regexp_count(t, F.lit(JSON_UNIT))).cast("long").alias("json_units"))
    tokens = by_language(rows.withColumnRenamed("domain", "lang"), merges).select(F.col("lang").alias("d"), "tokens", "words")
    measure = {d: m for d, m, _ in TARGETS}
    kind = lambda m: F.col("domain").isin([d for d, x in measure.items() if x == m])
    rate = F.try_divide("tokens", F.when(kind("char"), F.col("characters")).when(kind("unit"), F.col("json_units")).otherwise(F.col("words")))
    return sizes.join(tokens, F.col("domain").eqNullSafe(F.col("d"))).select("domain", "tokens", "words", "characters", "json_units", rate.alias("rate"))


def score(rates: DataFrame, col: str = "fertility_u", penalised: str = "hi", threshold: float = THRESHOLD) -> DataFrame:
    """One row: spread, raw and adjusted score, penalty, mean, languages over the threshold; undefined is null."""
    f = F.col(col)
    one = rates.agg(
        (F.max(f) - F.min(f)).alias("spread"),
        F.avg(f).alias("mean_fertility"),
        F.max(F.when(F.col("lang") == penalised, f)).alias("p"),
        F.array_sort(F.collect_list(F.when(f > threshold, F.col("lang")))).alias("over"),
    )
    penalty = F.exp(F.greatest(F.lit(0.0), F.coalesce(F.col("p"), F.lit(0.0)) / threshold - 1))
    raw = F.try_divide(F.lit(1000.0), F.col("spread"))
    return one.select("spread", raw.alias("raw_score"), penalty.alias("penalty_factor"), (raw / penalty).alias("adjusted_score"), "mean_fertility", F.array_join("over", ",").alias("languages_over_threshold"))


def rebalanced(rates: DataFrame, weights: dict[str, float], col: str = "fertility_w") -> DataFrame:
    """``lang``, ``weight``: weights times the ratio to the mean within bounds, 1 at least, then divided by the smallest."""
    table = rates.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "w_lang string, old double")
    ratio = F.coalesce(F.try_divide(F.col(col), F.avg(col).over(Window.partitionBy())), F.lit(1.0))
    step = rates.join(F.broadcast(table), F.col("lang") == F.col("w_lang"), "left").select("lang", F.greatest(F.lit(1.0), F.coalesce("old", F.lit(1.0)) * F.least(F.lit(HIGH), F.greatest(F.lit(LOW), ratio))).alias("w"))
    return step.select("lang", (F.col("w") / F.min("w").over(Window.partitionBy())).alias("weight"))


#: Bytes of pretokens that the driver trains from; more stay distributed.
MAX_BYTES = 1_500_000


#: Distinct chunks that a task holds at once.
CHUNKS = 200_000


def chunks(docs: DataFrame) -> DataFrame:
    """``lang``, ``text`` and ``n``: words with the white space before them, counted in parts of a task.

    No pretoken reaches from a visible character to white space, so chunks have the pretokens of the texts.
    Python's white space is that of :data:`.text.SPACE`.
    """

    def run(batches):
        split, found = re.compile(r"\s*\S+|\s+").findall, defaultdict(Counter)
        for x in batches:
            for lang, text in zip(x["lang"], x["text"], strict=True):
                if text:
                    found[lang].update(split(text))
            if sum(map(len, found.values())) > CHUNKS:
                yield from rows(found)
                found.clear()
        yield from rows(found)

    def rows(found):
        for lang, counts in found.items():
            yield pd.DataFrame({"lang": pd.Series([lang] * len(counts), dtype=object), "text": list(counts), "n": list(counts.values())})

    return docs.select("lang", "text").mapInPandas(run, "lang string, text string, n long")


def counted(docs: DataFrame) -> tuple[DataFrame, dict]:
    """Pretokens counted by language, computed once, and the words of each language."""

    @F.pandas_udf("long")
    def size(s: pd.Series) -> pd.Series:
        return s.map(lambda x: len(x.split()) if x else 0)

    words = {r["lang"]: r["w"] for r in docs.groupBy("lang").agg(F.sum(size("text")).alias("w")).collect()}
    counts = bpe.pretoken_counts(chunks(docs), by=["lang", "n"]).groupBy("lang", "pretoken").agg(F.sum(F.col("n") * F.col("freq")).alias("freq"))
    return once(counts), words


def training_rounds(docs: DataFrame, vocab_size: int, rounds: int = 10, weights: dict[str, float] | None = None, max_words: int = 2_000_000, counts_: tuple[DataFrame, dict] | None = None, few: int = 32) -> tuple[list[dict], dict]:
    """Train, measure and re-balance; the log of all rounds and the best one (first on ties, no spread beats any).

    Pretokens are counted once by language; a round trains and measures from all of
    these counts, on the driver where there are ``max_words`` and ``MAX_BYTES`` at most, else
    distributed.  ``counts_`` has the counts (:func:`counted`) where they are known.
    """
    rounds = min(16, max(1, rounds))
    table, words = counts_ or counted(docs)
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("pretoken")), F.lit(0)).alias("bytes")).first()
    spread_out = size["n"] > max_words or size["bytes"] > MAX_BYTES
    if spread_out:
        langs = sorted(r["lang"] for r in table.select("lang").distinct().collect() if r["lang"] is not None)
    else:
        counts = table.orderBy(F.desc("freq"), "lang", "pretoken").toPandas()
        langs = sorted(x for x in counts["lang"].unique() if x is not None)
    weights = {x: float((weights or {}).get(x, 1.0)) for x in langs}
    log, best = [], None
    for k in range(1, rounds + 1):
        weight = F.coalesce(*(F.when(F.col("lang") == x, F.lit(w)) for x, w in weights.items()), F.lit(1.0))
        if spread_out and vocab_size - 256 <= few:
            # Counts of pairs are sums, so a pretoken's languages need not meet first.
            merges = bpe.train_spread(bpe.with_symbols(table).select("symbols", (F.col("freq") * weight).alias("freq")), vocab_size - 256)
            n = F.size(T.symbol_list(bpe.encode_symbols(T.symbols(F.col("pretoken")), merges)))
            tokens = {r["lang"]: r["t"] for r in table.groupBy("lang").agg(F.sum(F.col("freq") * n).alias("t")).collect()}
        elif spread_out:
            words_ = once(table.groupBy("pretoken").agg(F.sum(F.col("freq") * weight).alias("freq")))
            merges = bpe.train_spread(bpe.with_symbols(words_).select("symbols", "freq"), vocab_size - 256)
            known = bpe.encoded_pretokens(words_, merges).select("pretoken", F.size("tokens").alias("n"))
            tokens = {r["lang"]: r["t"] for r in table.join(known, "pretoken").groupBy("lang").agg(F.sum(F.col("freq") * F.col("n")).alias("t")).collect()}
        else:
            weighted = counts.assign(f=counts["freq"] * counts["lang"].map(weights).fillna(1.0)).groupby("pretoken", sort=True)["f"].sum()
            merges = bpe.train_local([([f"{b:02X}" for b in p.encode()], f) for p, f in weighted.items()], vocab_size - 256)
            rank = {}
            for i, (a, b, _) in enumerate(merges):
                rank.setdefault((a, b), i)
            n = {p: len(bpe.encode_word([f"{b:02X}" for b in p.encode()], rank)) for p in weighted.index}
            tokens = (counts["freq"] * counts["pretoken"].map(n)).groupby(counts["lang"]).sum()
        rate = {x: (float(tokens[x]) / words[x] if words.get(x) else None) for x in langs}
        known = [v for v in rate.values() if v is not None]
        spread = max(known) - min(known) if known else None
        value = 1000 / spread if spread else None
        log.append({"round": k, "spread": spread, "score": value})
        if best is None or (best["score"] is not None and (value is None or value > best["score"])):
            best = {"round": k, "score": value, "spread": spread, "weights": dict(weights), "merges": merges, "fertility": rate}
        mean = sum(known) / len(known) if known else 1.0
        stepped = {x: max(1.0, weights[x] * min(HIGH, max(LOW, (rate[x] or mean) / mean))) for x in langs}
        weights = {x: w / min(stepped.values()) for x, w in stepped.items()}
    return log, best


def grid_search(docs: DataFrame, vocab_size: int, choices: dict[str, list[float]]) -> list[dict]:
    """Spread of every combination of weights, the smallest first; languages without choices weigh 1.

    All combinations are trained at once from the same counts (:mod:`.grid`); one by
    one, distributed, where the vocabulary or the counted fragments are too large for that.
    """
    names = sorted(choices)
    combos = [dict(zip(names, x, strict=True)) for x in itertools.product(*(choices[x] for x in names))]
    counts_ = counted(docs)
    langs = sorted(r["lang"] for r in counts_[0].select("lang").distinct().collect() if r["lang"] is not None)
    weights = [{x: float(combo.get(x, 1.0)) for x in langs} for combo in combos]
    trained = grid.tokens(counts_[0], langs, max(0, vocab_size - 256), [tuple(w.values()) for w in weights])
    out = []
    for i, w in enumerate(weights):
        if trained is None:
            spread = training_rounds(docs, vocab_size, 1, w, counts_=counts_)[0][0]["spread"]
        else:
            known = [trained[i][x] / counts_[1][x] for x in langs if counts_[1].get(x)]
            spread = max(known) - min(known) if known else None
        out.append({"weights": w, "spread": spread, "score": 1000 / spread if spread else None})
    return sorted(out, key=lambda x: (x["spread"] is None, x["spread"] or 0.0, sorted(x["weights"].items())))


#: Targets by domain: measure, and the most tokens per word, character or syntactic unit.
TARGETS = (
    ("en", "word", 1.25),
    ("hi", "word", 1.35),
    ("hi-mix", "word", 1.45),
    ("bn", "word", 1.55),
    ("ta", "word", 1.55),
    ("te", "word", 1.55),
    ("mr", "word", 1.55),
    ("tier3", "word", 1.70),
    ("code", "char", 0.30),
    ("latex", "char", 0.35),
    ("json", "unit", 1.10),
)


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TARGETS), "domain string, measure string, target double")


def meets_targets(rates: DataFrame, default: float = 1.70) -> DataFrame:
    """``domain``, ``rate``, ``target``, ``meets`` for rows of ``domain`` and ``rate``; other domains get the last tier's target."""
    table = targets(rates.sparkSession).withColumnRenamed("domain", "d")
    joined = rates.join(F.broadcast(table), F.col("domain") == F.col("d"), "left").withColumn("target", F.coalesce("target", F.lit(default)))
    return joined.select("domain", "rate", "target", (F.col("rate") <= F.col("target")).alias("meets"))


def embedding_cost(spark: SparkSession, sizes=(65536, 131072, 262144), width: int = 6144, parameters: float = 40e9) -> DataFrame:
    """``vocab``, ``billions`` of embedding and output parameters, and their share of the model in percent."""
    rows = spark.createDataFrame([(v,) for v in sizes], "vocab long")
    cost = F.col("vocab") * F.lit(2.0 * width)
    return rows.select("vocab", F.round(cost / 1e9, 3).alias("billions"), F.round(cost / parameters * 100, 1).alias("percent"))


def choose_vocabulary(options: DataFrame) -> DataFrame:
    """The smallest ``vocab`` whose ``meets`` is true."""
    return options.where("meets").orderBy("vocab").limit(1)


def gate(rows: DataFrame) -> DataFrame:
    """Round-trip gate over ``text`` and ``decoded``: failures and whether all pass."""
    bad = T.visible("text") != T.visible("decoded")
    return rows.agg(F.count("*").alias("samples"), F.count_if(bad).alias("failures"), F.coalesce(F.bool_and(~bad), F.lit(True)).alias("passed"))


def gate_failures(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first failures, cut to 80 and 120 characters."""
    return rows.where(T.visible("text") != T.visible("decoded")).select(F.substring("text", 1, 80).alias("sample"), F.substring("decoded", 1, 120).alias("decoded")).orderBy("sample").limit(n)
