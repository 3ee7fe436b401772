"""Training runs kept as tables: train, look up, encode, decode, download."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import sinks
from . import bpe, fertility

RUN = "run_id string, vocab_size int, weights map<string,double>, spread double, score double, best_round int, rounds array<struct<round int, spread double, score double>>, fertility map<string,double>, created timestamp"
MERGES = "run_id string, rank int, a string, b string, n double"


class Runs:
    """Runs under ``folder``, in any store that Spark reads and writes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def train(self, docs: DataFrame, vocab_size: int = 10000, rounds: int = 10, weights: dict[str, float] | None = None) -> str:
        """Train and keep the best round; the id follows from the configuration, so the same run gets the same id."""
        log, best = fertility.training_rounds(docs, vocab_size, rounds, weights)
        config = json.dumps([vocab_size, rounds, weights, best["weights"], [m[:2] for m in best["merges"]]], sort_keys=True)
        run_id = sinks.run_id(config)
        row = (run_id, vocab_size, best["weights"], best["spread"], best["score"], best["round"], [(x["round"], x["spread"], x["score"]) for x in log], {k: v for k, v in best["fertility"].items() if v is not None}, datetime.now(timezone.utc))
        self.spark.createDataFrame([(run_id, i, a, b, float(n)) for i, (a, b, n) in enumerate(best["merges"])], MERGES).write.mode("overwrite").parquet(f"{self.folder}/merges/{run_id}")
        self.spark.createDataFrame([row], RUN).write.mode("overwrite").parquet(f"{self.folder}/runs/{run_id}")
        return run_id

    def get(self, run_id: str):
        """The run's row; an unknown id raises KeyError."""
        if not run_id.isalnum():
            raise KeyError(run_id)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/runs/{run_id}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            raise KeyError(run_id)
        return self.spark.read.schema(RUN).parquet(f"{self.folder}/runs/{run_id}").first()

    def merges(self, run_id: str) -> list[tuple[str, str, int]]:
        self.get(run_id)
        rows = self.spark.read.schema(MERGES).parquet(f"{self.folder}/merges/{run_id}").orderBy("rank").collect()
        return [(r["a"], r["b"], int(r["n"])) for r in rows]

    def round_log(self, run_id: str) -> DataFrame:
        """``round``, ``spread``, ``score`` and whether it is the best."""
        row = self.get(run_id)
        return self.spark.createDataFrame([(x["round"], x["spread"], x["score"], x["round"] == row["best_round"]) for x in row["rounds"]], "round int, spread double, score double, best boolean")

    def encode(self, run_id: str, docs: DataFrame) -> DataFrame:
        """One row a text, as :func:`bpe.encode_report`."""
        return bpe.encode_report(docs, self.merges(run_id))

    def decode(self, run_id: str, rows: DataFrame, key: str) -> DataFrame:
        return bpe.decode_ids(rows, bpe.vocabulary(self.spark, self.merges(run_id)), key)

    def tokenizer(self, run_id: str) -> DataFrame:
        return sinks.tokenizer_document(self.spark, self.merges(run_id))

    def vocabulary(self, run_id: str) -> DataFrame:
        return sinks.vocabulary_lines(bpe.vocabulary(self.spark, self.merges(run_id)))

    def report(self, run_id: str) -> DataFrame:
        """One JSON report of the run."""
        row = self.spark.read.schema(RUN).parquet(f"{self.folder}/runs/{run_id}")
        return row.select(F.to_json(F.struct("vocab_size", "weights", F.col("fertility").alias("per_language"), "spread", F.col("score").alias("self_score"), F.col("rounds").alias("round_log"))).alias("document"))


def acceptable(rates: DataFrame, gate: DataFrame, threshold: float = fertility.THRESHOLD, col: str = "fertility_u") -> DataFrame:
    """One row: whether the round trip passed and no language is over the threshold."""
    over = rates.agg(F.count_if(F.col(col) > threshold).alias("over"))
    return over.join(F.broadcast(gate)).select("passed", "over", (F.col("passed") & (F.col("over") == 0)).alias("acceptable"))


def single_text(spark: SparkSession, text: str, merges: list) -> dict:
    """Tokens, ids, decoded text and the round trip of one text."""
    row = bpe.encode_report(spark.createDataFrame([(text,)], "text string"), merges).first()
    return {"tokens": row["tokens_display"], "ids": row["ids"], "decoded": row["decoded"], "roundtrip_ok": row["roundtrip_ok"], "visible": spark.range(1).select(T.visible(F.lit(text)).alias("v")).first()["v"]}
