import json

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import bpe, fertility, pieces, runs


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "en", "the cat and the hat and the mat " * 3), (2, "hi", "यह एक परीक्षा है यह एक " * 3), (3, "en", None)], "doc_id long, lang string, text string")


def test_run_is_kept_and_used(spark, docs, tmp_path):
    kept = runs.Runs(spark, str(tmp_path))
    run_id = kept.train(docs, 280, 3)
    assert run_id == kept.train(docs, 280, 3) and len(run_id) == 12
    row = kept.get(run_id)
    assert row.created is not None and row.vocab_size == 280 and set(row.weights) == {"en", "hi"} and min(row.weights.values()) == 1.0
    assert [r.round for r in kept.round_log(run_id).orderBy("round").collect()] == [1, 2, 3] and kept.round_log(run_id).where("best").count() == 1
    coded = kept.encode(run_id, docs).where("text <> ''")
    assert coded.where(~F.col("roundtrip_ok")).count() == 0
    back = {r.doc_id: r.text for r in kept.decode(run_id, coded.select("doc_id", "ids"), "doc_id").collect()}
    assert back[1] == "the cat and the hat and the mat " * 2 + "the cat and the hat and the mat"
    assert len(json.loads(kept.tokenizer(run_id).first().document)["model"]["vocab"]) == kept.vocabulary(run_id).count()
    assert json.loads(kept.report(run_id).first().document)["vocab_size"] == 280
    for bad in ("nothere", "../x"):
        with pytest.raises(KeyError):
            kept.get(bad)


def test_pieces(docs):
    vocab, merges = pieces.train(docs, 2100, {"en": 2})
    assert "▁the" in vocab and merges[0][2] >= 2 and len(vocab) == len(set(vocab))
    assert pieces.encode(["the cat"], merges)[0][-1].startswith("▁") and "".join(pieces.encode(["the  cat"], merges)[0]) == "the▁▁cat"
    assert {r.ch for r in pieces.alphabet(docs).collect()} >= set("thecat ")


def test_acceptance(spark, docs):
    merges = bpe.merge_tables(bpe.pretoken_counts(docs), 4)
    rates = fertility.by_language(docs, merges)
    gate = fertility.gate(spark.createDataFrame([("a b", "a b")], "text string, decoded string"))
    assert runs.acceptable(rates, gate, 100.0).first().acceptable and not runs.acceptable(rates, gate, 0.1).first().acceptable
    assert runs.single_text(spark, " the hat ", merges)["roundtrip_ok"]
