"""Mixtures, quotas and evaluation gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Shares of the pre-training mixture and of fine-tuning, in percent.
PRETRAINING = (("english_web", 34.0), ("code", 24.0), ("indic", 16.0), ("stem", 9.0), ("other_languages", 6.0), ("long_context", 3.0), ("synthetic", 8.0))
FINE_TUNING = (("agentic", 40.0), ("code", 25.0), ("indic", 20.0), ("reasoning", 10.0), ("safety", 5.0))
#: Parts of the vocabulary budget, and the budget.
VOCABULARY_PARTS = (("english", 46000), ("indic", 42000), ("code", 10000), ("other", 32000), ("bytes", 256), ("special", 600))
VOCABULARY_BUDGET = 131072


def shares(rows: DataFrame, slice_: str, amount: str, targets: DataFrame) -> DataFrame:
    """``slice``, ``amount``, ``share``, ``target``, ``rate``: what part of each slice to take so that shares meet targets.

    Rates are scaled so that the largest is 1; ``targets`` has ``slice`` and ``target``.
    """
    total = rows.groupBy(F.col(slice_).alias("slice")).agg(F.sum(amount).alias("amount"))
    joined = total.join(F.broadcast(targets.select(F.col("slice").alias("t_slice"), "target")), F.col("slice") == F.col("t_slice"), "left")
    whole = Window.partitionBy()
    share = F.col("amount") / F.sum("amount").over(whole)
    out = joined.select("slice", "amount", share.alias("share"), F.coalesce("target", F.lit(0.0)).alias("target"))
    out = out.withColumn("raw", F.coalesce(F.try_divide("target", "share"), F.lit(0.0)))
    return out.select("slice", "amount", "share", "target", F.coalesce(F.try_divide("raw", F.max("raw").over(whole)), F.lit(0.0)).alias("rate"))


def sample(rows: DataFrame, slice_: str, rates: DataFrame, key: str = "doc_id", seed: str = "mix") -> DataFrame:
    """Rows taken at their slice's rate by a fixed hash of the key."""
    h = T.hash60(F.concat(F.lit(seed), F.col(key).cast("string"))) / float(1 << 60)
    return rows.join(F.broadcast(rates.select(F.col("slice").alias("r_slice"), "rate")), F.col(slice_) == F.col("r_slice")).where(h < F.col("rate")).drop("r_slice", "rate")


def epochs(spark: SparkSession, budget: float, unique: float, cap: float) -> DataFrame:
    """How often unique tokens repeat within a budget, and whether that is within the cap."""
    row = spark.createDataFrame([(float(budget), float(unique), float(cap))], "budget double, unique_tokens double, cap double")
    n = F.try_divide("budget", "unique_tokens")
    return row.select("budget", "unique_tokens", n.alias("epochs"), (n <= F.col("cap")).alias("within_cap"))


def recoveries(turns: DataFrame, failed: str) -> DataFrame:
    """``conv_id``, ``turn``, ``recovered``: turns of the assistant that match ``failed``, and whether a later one of it doesn't."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.where("role = 'assistant'").withColumn("bad", F.coalesce(F.col("text"), F.lit("")).rlike(failed))
    rows = rows.withColumn("next_bad", F.lead("bad").over(w))
    return rows.where("bad").select("conv_id", "turn", F.coalesce(~F.col("next_bad"), F.lit(False)).alias("recovered"))


def recovery_rate(turns: DataFrame, failed: str, bar: float = 0.6) -> DataFrame:
    """One row: ``failures``, ``rate`` of those recovered from, and whether it reaches the bar (no failure does)."""
    rate = F.avg(F.col("recovered").cast("double"))
    return recoveries(turns, failed).agg(F.count("*").alias("failures"), rate.alias("rate"), F.coalesce(rate >= bar, F.lit(True)).alias("passed"))


def quota(rows: DataFrame, strata: list[str], n: int, key: str, seed: str = "quota") -> DataFrame:
    """``n`` rows of each stratum by a fixed hash, with their place ``pick``."""
    h = T.hash60(F.concat(F.lit(seed), F.col(key).cast("string")))
    return rows.withColumn("pick", F.row_number().over(Window.partitionBy(*strata).orderBy(h, key))).where(F.col("pick") <= n)


def capped(rows: DataFrame, flag: str, cap: float = 0.08) -> DataFrame:
    """Share of flagged rows, and whether it is within the cap."""
    share = F.avg(F.col(flag).cast("double"))
    return rows.agg(F.count("*").alias("total"), F.count_if(flag).alias("flagged"), share.alias("share"), (share <= cap).alias("within_cap"))


def bars(scores: DataFrame, table: DataFrame) -> DataFrame:
    """``metric``, ``value``, ``bar``, ``passed`` for every bar; a metric without a score fails."""
    joined = table.join(scores.withColumnRenamed("metric", "m"), F.col("metric") == F.col("m"), "left")
    return joined.select("metric", "value", "bar", F.coalesce(F.col("value") >= F.col("bar"), F.lit(False)).alias("passed"))


def all_passed(rows: DataFrame) -> DataFrame:
    return rows.agg(F.bool_and("passed").alias("passed"))


def schema_accuracy(rows: DataFrame, col: str, schema: str, required: str) -> DataFrame:
    """How many JSON strings parse by a schema and have the required field."""
    ok = F.from_json(F.col(col), schema).getField(required).isNotNull()
    return rows.agg(F.count("*").alias("calls"), F.count_if(ok).alias("valid"), F.avg(ok.cast("double")).alias("accuracy"))


def pivot(rows: DataFrame, index: str, column: str, values: list, measure: str) -> DataFrame:
    """Mean of ``measure`` by index and column."""
    return rows.groupBy(index).pivot(column, values).agg(F.avg(measure))


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of texts in two languages with the same alignment key."""
    return left.select(key, F.col("text").alias("text_a")).join(right.select(F.col(key).alias("k"), F.col("text").alias("text_b")), F.col(key) == F.col("k")).drop("k")


def vocabulary_budget(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(VOCABULARY_PARTS), "part string, entries long")
    return rows.agg(F.sum("entries").alias("entries")).select("entries", F.lit(VOCABULARY_BUDGET).cast("long").alias("budget"), (F.col("entries") <= VOCABULARY_BUDGET).alias("fits"))
