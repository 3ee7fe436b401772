import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions import udfs
from corpuscle.operators import bpe, cleaning, fertility, grid, mixture, pieces
from corpuscle.plans import queries
from corpuscle.sources import corpora, sinks
from corpuscle.streaming import counts

PRETOKENS = {
    "a\nb": ["a", " b"],
    "a  b": ["a", "  ", "b"],
    "a ": ["a", " "],
    "क्‍ष": ["क्‍ष"],
    "GDP3": ["GDP", "3"],
    "½Ⅻ²": ["½Ⅻ²"],
    "a b　c": ["a", " b", " c"],
    "": [],
    "   ": ["   "],
    "x,y": ["x", ",", "y"],
    " ఼ౝ": [" ఼ౝ"],
}


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"text {kind}").select(f(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize("text", sorted(PRETOKENS))
def test_pretokens(spark, text):
    assert one(spark, text, T.pretokens) == PRETOKENS[text]
    assert "".join(one(spark, text, lambda c: T.pretokens(c, "keep"))) == text


def test_counts_of_words_and_units(spark):
    assert [one(spark, t, T.unit_count) for t in ("GDP3", "क्‍ष", "a, b", "", None)] == [1, 3, 3, 0, 0]
    assert one(spark, "क्‍ष", T.unit_count_joined) == 1
    assert [one(spark, t, T.word_count) for t in ("a b", "  ", None, "x\ny z")] == [2, 0, 0, 3]
    assert one(spark, "  a b \n", T.strip) == "a b" and one(spark, " a b ", T.visible) == "ab"
    assert one(spark, "a\r\nb\x0bc d", T.lines) == ["a", "b", "c", "d"]


def test_bytes_and_display(spark):
    assert one(spark, "é", lambda c: T.symbols(c)) == "<C3><A9>" and one(spark, "", lambda c: T.symbol_list(T.symbols(c))) == []
    assert one(spark, "20C3", T.hex_text) == " �"
    assert len({ch for _, ch in T.byte_alphabet()}) == 256 and one(spark, "20C3", T.byte_display) == "ĠÃ"
    assert udfs.escape_display("a\\b\n‍ ") == "a\\\\b\\x0a\\u200d\\u2028"
    assert one(spark, "a b/ü*~", T.quote) == "a%20b%2F%C3%BC%2A~" and one(spark, "<a&b>", T.html_escape) == "&lt;a&amp;b&gt;"
    assert one(spark, " a b", T.metaspace) == ["▁a", "▁b"]


def test_checksums_and_code(spark):
    assert udfs.verhoeff("2363") and not udfs.verhoeff("2364") and udfs.verhoeff("123451") and not udfs.verhoeff("123450")
    assert [one(spark, t, udfs.parses) for t in ("x = 1", "x = = 1", None)] == [True, False, None]
    assert [one(spark, t, lambda c: udfs.parses(c, "c")) for t in ("f(a[1]){}", "f(]")] == [True, False]


def test_normal_forms_keep_joiners(spark):
    assert one(spark, "é", udfs.nfc) == "é" and one(spark, "ﬁ", udfs.nfc) == "ﬁ" and one(spark, "ﬁ", udfs.nfkc) == "fi"
    df = spark.createDataFrame([("क्‍ष‌", True), ("ﬁ", True), ("ﬁ", False)], "text string, code boolean")
    assert [r.text for r in cleaning.normalised(df, "NFKC", F.col("code")).collect()] == ["क्‍ष‌", "ﬁ", "fi"]
    assert one(spark, "क्‍ष‌", cleaning.joiners) == 2


PAGE = "<html><head><title>t</title><style>x</style></head><body><h1>Big_One</h1><p>A <b>bold</b> and <i>it</i> &amp; <a href='/u'>link</a>.<br>next</p><script>no</script><ul><li>one<li>two</ul><ol><li>x</li></ol><table><tr><th>h</th><th>k</th></tr><tr><td>1</td></tr></table><img alt='a' src='b.png'><p>end<p>"


def test_markdown():
    got = udfs.to_markdown(PAGE)
    for piece in ("# Big\\_One\n", "A **bold** and *it* & [link](/u).\nnext", "* one\n* two", "1. x", "| h | k |\n| --- | --- |\n| 1 |  |", "![a](b.png)"):
        assert piece in got, piece
    assert got.endswith("end\n") and "\n\n\n\n" not in got and "no" not in got.split() and "\nt\n" not in got
    assert udfs.to_markdown("") == "\n"


def naive_merges(words, k):
    words, out = [(list(s), f) for s, f in words], []
    for _ in range(k):
        n = {}
        for s, f in words:
            for p in zip(s, s[1:]):
                n[p] = n.get(p, 0) + f
        if not n or max(n.values()) < 2:
            break
        a, b = min(n, key=lambda p: (-n[p], p))
        out.append((a, b, n[a, b]))
        for i, (s, f) in enumerate(words):
            new, j = [], 0
            while j < len(s):
                two = j + 1 < len(s) and (s[j], s[j + 1]) == (a, b)
                new.append(a + b if two else s[j])
                j += 1 + two
            words[i] = (new, f)
    return out


def naive_encode(s, rank):
    s = list(s)
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(s, s[1:])) if p in rank), default=None)
        if best is None:
            return s
        i = best[1]
        s[i : i + 2] = [s[i] + s[i + 1]]


def test_training_and_encoding_equal_plain_versions(spark):
    r = random.Random(1)
    words = [([r.choice("abc") for _ in range(r.randint(1, 8))], r.randint(1, 5)) for _ in range(60)]
    merges = bpe.train_local(words, 25)
    assert merges == naive_merges(words, 25)
    rank = {(a, b): i for i, (a, b, _) in enumerate(merges)}
    for _ in range(300):
        s = [r.choice("abc") for _ in range(r.randint(0, 14))]
        assert bpe.encode_word(s, rank) == naive_encode(s, rank)
    docs = spark.createDataFrame([("en", "the cat the hat aaa"), ("fr", "la la the"), (None, None)], "lang string, text string")
    counts_ = bpe.pretoken_counts(docs)
    few = bpe.merge_tables(counts_, 6)
    assert few == bpe.train(counts_, 262) and bpe.merge_tables(counts_, 0) == []
    assert bpe.train(counts_, 100) == []
    weighted = {x.pretoken: x.freq for x in bpe.pretoken_counts(docs, {"en": 3}).collect()}
    assert weighted[" the"] == 4 and weighted["la"] == 1
    pairs = {(x.a, x.b): x.n for x in bpe.pair_counts(bpe.with_symbols(spark.createDataFrame([("aaa", 2)], "pretoken string, freq long"))).collect()}
    assert pairs == {("61", "61"): 4}
    assert one(spark, "<61><61><61>", lambda c: bpe.apply_merge(c, "61", "61")) == "<6161><61>"


def test_encode_decode_round_trip(spark):
    docs = spark.createDataFrame([(1, "en", "the theme of the day 😀"), (2, "hi", "भारत a\nb"), (3, "en", ""), (4, "en", None)], "doc_id long, lang string, text string")
    merges = bpe.merge_tables(bpe.pretoken_counts(docs), 10)
    rows = {r.doc_id: r for r in bpe.encode_report(docs, merges).collect()}
    assert rows[1].decoded == "the theme of the day 😀" and rows[2].decoded == "भारत a b" and all(r.roundtrip_ok for r in rows.values())
    assert rows[3].token_count == 0 and rows[3].fertility is None and rows[4].words == 0
    vocab = bpe.vocabulary(spark, merges)
    back = {r.doc_id: r.text for r in bpe.decode_ids(bpe.encode_report(docs, merges).select("doc_id", "ids"), vocab, "doc_id").collect()}
    assert back[1] == rows[1].decoded
    many = {r.doc_id: r.tokens for r in bpe.encode(docs, merges, few=0).collect()}
    assert many[1] == rows[1].tokens
    bad = spark.createDataFrame([(1, [-1])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="no such id"):
        bpe.decode_ids(bad, vocab, "doc_id").collect()
    assert bpe.missing_operands(bpe.model(spark, [("61", "9999", 1)]), vocab).count() == 2
    fertile = fertility.by_language(docs, merges)
    assert sorted(map(tuple, fertile.collect())) == sorted(map(tuple, fertility.by_language(docs, merges, few=0).collect()))


def test_scores_and_weights(spark):
    rates = spark.createDataFrame([("en", 0.8217635112186263), ("hi", 0.8441869998937156), ("te", 0.8624731466475709), ("ta", 0.8781402193335903)], "lang string, fertility_u double")
    got = fertility.score(rates).first()
    assert got.spread == pytest.approx(0.05637670811496398) and got.raw_score == pytest.approx(17737.82176073121) and got.penalty_factor == 1.0 and got.languages_over_threshold == ""
    same = fertility.score(spark.createDataFrame([("en", 1.3), ("hi", 1.3)], "lang string, fertility_u double")).first()
    assert same.raw_score is None and same.languages_over_threshold == "en,hi" and same.penalty_factor > 1
    w = {r.lang: r.weight for r in fertility.rebalanced(spark.createDataFrame([("en", 1.0), ("hi", 3.0), ("xx", None)], "lang string, fertility_w double"), {"en": 1.0, "hi": 1.0}).collect()}
    assert w["en"] == 1.0 and w["hi"] == pytest.approx(1.5) and w["xx"] == 1.0
    docs = spark.createDataFrame([("en", "the cat sat on the mat " * 4), ("xx", "zq qz zz qq zqzq " * 3)], "lang string, text string")
    log, best = fertility.training_rounds(docs, 266, 3)
    assert [x["round"] for x in log] == [1, 2, 3] and best["score"] == max(x["score"] for x in log if x["score"]) and min(best["weights"].values()) == 1.0
    assert len(fertility.grid_search(docs, 260, {"en": [1.0, 2.0], "xx": [1.0]})) == 2
    assert [r.meets for r in fertility.meets_targets(spark.createDataFrame([("en", 1.2), ("zz", 1.8)], "domain string, rate double")).orderBy("domain").collect()] == [True, False]
    gate = fertility.gate(spark.createDataFrame([("a b", "ab"), ("x", "y")], "text string, decoded string"))
    assert tuple(gate.first()) == (2, 1, False)
    assert fertility.gate_failures(spark.createDataFrame([("x", "y")], "text string, decoded string")).count() == 1


def test_sources(spark, tmp_path):
    for lang, text in (("en", "one\ntwo\n"), ("hi", "एक\n")):
        (tmp_path / f"{lang}.faithful.txt").write_text(text, encoding="utf-8")
        (tmp_path / f"{lang}.meta.json").write_text(json.dumps({"language": lang, "chars": len(text), "lines": text.count("\n")}))
    assert {r.lang: r.text for r in corpora.corpus(spark, str(tmp_path)).collect()} == {"en": "one\ntwo\n", "hi": "एक\n"}
    assert corpora.corpus_lines(spark, str(tmp_path)).where("lang = 'en' and line_no = 2").first().line == "two"
    assert {r.language: r.lines for r in corpora.corpus_metadata(spark, str(tmp_path)).collect()} == {"en": 2, "hi": 1}
    assert one(spark, "en=2 hi=3", corpora.weight_arguments) == {"en": 2, "hi": 3}
    bodies = spark.createDataFrame([(None,), ('{"rounds": 99, "vocab_size": 300}',)], "body string")
    assert [(r.vocab_size, r.rounds) for r in corpora.training_request(bodies).collect()] == [(10000, 10), (300, 16)]
    responses = [json.dumps({"query": {"pages": p}}) for p in ({"7": {"extract": "é" * 300}}, {"-1": {"missing": ""}}, {"8": {"extract": "short"}}, {})]
    got = corpora.extracts(spark.createDataFrame([(r,) for r in responses], "response string")).collect()
    assert [r.error for r in got] == [None, "missing", "too short", "no pages"] and len(got[0].text) == 300
    for doc in ({"model": {"vocab": {"a": 1, "b": 0}, "merges": ["a b", "[ x"]}}, {"model": {"vocab": {"a": 1, "b": 0}, "merges": [["a", "b"], ["[", "x"]]}}, {"vocab": {"a": 1, "b": 0}, "merges": [["a", "b"], ["[", "x"]]}):
        df = spark.createDataFrame([(json.dumps(doc),)], "document string")
        assert [(r.a, r.b) for r in corpora.tokenizer_merges(df).orderBy("rank").collect()] == [("a", "b"), ("[", "x")]
        assert [r.token for r in corpora.tokenizer_vocab(df).orderBy("id").collect()] == ["b", "a"]
    hit, miss = corpora.read_through(spark.createDataFrame([("en", "A"), ("en", "B")], "lang string, title string"), spark.createDataFrame([("en", "A", "t")], "lang string, title string, text string"))
    assert hit.count() == 1 and miss.first().title == "B"
    pasted = corpora.pasted(spark.createDataFrame([("en", "x" * 300), ("hi", "short")], "lang string, text string"), spark.createDataFrame([("en", "w"), ("hi", "v")], "lang string, text string"))
    assert {r.lang: len(r.text) for r in pasted.collect()} == {"en": 300, "hi": 1}
    metrics = {"vocab_size": 10, "spread": 0.5, "raw_score": 2000.0, "per_language": {"en": {"label": "English", "tokens": 5, "faithful_units": 4, "fertility": 1.25}}}
    (tmp_path / "metrics.json").write_text(json.dumps(metrics))
    assert corpora.metrics(spark, str(tmp_path / "metrics.json")).first().fertility == 1.25
    assert corpora.languages(spark).count() == 4


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("en", "the cat\nthe hat"), ("hi", "भारत")], "lang string, text string")
    sinks.write_corpus(docs, str(tmp_path / "corpus"))
    assert spark.read.text(str(tmp_path / "corpus")).count() == 3
    assert sorted((r.lang, r.text) for r in corpora.written_corpus(spark, str(tmp_path / "corpus")).collect()) == [("en", "the cat"), ("en", "the hat"), ("hi", "भारत")]
    sinks.write_metadata(docs, str(tmp_path / "meta"), "paste")
    assert {r.code: (r.language, r.title, r.source, r.lines) for r in corpora.written_metadata(spark, str(tmp_path / "meta")).collect()} == {"en": ("English", "India", "paste", 1), "hi": ("Hindi", "भारत", "paste", 0)}
    for x in ("b", "a"):
        (tmp_path / f"{x}.faithful.txt").write_text(x)
    assert [r.path[-14:] for r in corpora.files(spark, str(tmp_path)).collect()] == ["a.faithful.txt", "b.faithful.txt"]
    held = spark.createDataFrame([("en", "A", "t")], "lang string, title string, text string")
    fetched = spark.createDataFrame([("en", "A", "u"), ("hi", "B", "v"), ("hi", "B", "v"), ("te", "C", None)], held.schema)
    assert sorted(corpora.refilled(held, fetched).collect()) == [("en", "A", "t"), ("hi", "B", "v")]
    assert spark.read.json(str(tmp_path / "meta")).where("code = 'en'").first()["chars"] == 15
    merges = bpe.merge_tables(bpe.pretoken_counts(docs), 5)
    doc = sinks.tokenizer_document(spark, merges)
    parsed = json.loads(doc.first().document)
    assert len(parsed["model"]["vocab"]) == 256 + len(merges) and len(parsed["model"]["merges"]) == len(merges)
    assert [r.id for r in corpora.tokenizer_vocab(doc).orderBy("id").collect()] == list(range(256 + len(merges)))
    assert corpora.tokenizer_merges(doc).count() == len(merges)
    lines = {r.id: r.line for r in sinks.vocabulary_lines(bpe.vocabulary(spark, merges)).collect()}
    assert lines[10] == "10\t\\x0a" and lines[92] == "92\t\\\\" and lines[97] == "97\ta"
    rates = fertility.by_language(docs, merges)
    metrics = json.loads(sinks.metrics_document(rates, fertility.score(rates), 261, True).first().document)
    assert set(metrics["per_language"]) == {"en", "hi"} and metrics["faithful_roundtrip_gate"] == "PASS"
    (tmp_path / "metrics.json").write_text(sinks.metrics_document(fertility.with_labels(rates, corpora.languages(spark)), fertility.score(rates), 261, False, [("a", "b")]).first().document)
    read = {r.lang: r for r in corpora.metrics(spark, str(tmp_path / "metrics.json")).collect()}
    assert read["en"].label == "English" and read["en"].vocab_size == 261 and read["hi"].fertility == rates.where("lang = 'hi'").first().fertility_u
    report = json.loads(sinks.report_document(rates, fertility.score(rates), {"en": 1}, [{"round": 1, "spread": 0.1, "score": 10000.0}], 261).first().document)
    assert report["round_log"][0]["round"] == 1 and report["weights"] == {"en": 1.0}
    assert sinks.summary_lines(rates).count() == 2 and sinks.run_id("a") == sinks.run_id("a") != sinks.run_id("b")
    table = bpe.model(spark, merges)
    sinks.save_model(table, str(tmp_path / "model"))
    assert bpe.merges_of(spark.read.parquet(str(tmp_path / "model"))) == merges


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def test_cleaning(spark):
    long = " ".join(f"w{i}" for i in range(40))
    df = docs_of(spark, ["the cat and the dog", "der Hund und die Katze", "भारत एक देश", None, "the cat and the dog", long, long + " x", "a\nb\na", "Apache License, Version 2.0", 'token = "aaaabbbbccccdddd1111"'])
    pred = {r.doc_id: (r.lang_pred, r.mix_share) for r in cleaning.language_scores(df).collect()}
    assert [pred[i][0] for i in range(4)] == ["en", "de", "hi", "und"]
    dup = {r.doc_id: (r.copies, r.kept) for r in cleaning.exact_duplicates(df).collect()}
    assert dup[0] == (2, True) and dup[4] == (2, False)
    para = {r.doc_id: r.text for r in cleaning.without_repeated_paragraphs(df).collect()}
    assert para[7] == "a\nb" and 4 not in para and 3 not in para
    assert [(r.a, r.b) for r in cleaning.minhash_links(df).collect()] == [(5, 6)]
    bench = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(5, 18))), (2, "short")], "item_id long, text string")
    assert sorted((r.doc_id, r["items"]) for r in cleaning.contaminated(df, bench).collect()) == [(5, 1), (6, 1)]
    assert [r.license for r in df.select(cleaning.license_of("text").alias("license")).collect()][8] == "apache-2.0"
    scrub = {r.doc_id: r for r in cleaning.scrubbed(df).collect()}
    assert scrub[9].text == '<SECRET>"' and scrub[9].redactions == 1 and scrub[3].text == ""
    people = docs_of(spark, ["a@b.org 10.0.0.1 4111111111111111 4111111111111112 +1 (743) 555-3824 ABCDE1234F 2345 6789 0124", None])
    got = cleaning.personal_data(people).where("doc_id = 0").first()
    assert (got.email, got.ipv4, got["card"], got.phone, got.pan, got.aadhaar) == (1, 1, 1, 1, 1, 1)
    digits = next(f"23456789012{d}" for d in range(10) if udfs.verhoeff(f"23456789012{d}"))
    assert [r.number for r in cleaning.aadhaar_numbers(docs_of(spark, [f"{digits[:4]} {digits[4:8]} {digits[8:]}", "2345 6789 0120 "])).collect()][:1] == [digits]
    tox = cleaning.toxicity_thresholds(docs_of(spark, ["you idiot", "fine words"]), ["idiot"], {"en": 100.0})
    assert [r.flagged for r in tox.orderBy("doc_id").collect()] == [True, False]
    assert cleaning.audit_sample(df, "lang", 2).count() == 2 and cleaning.quality_filter(df).count() == 10
    stages = [r.documents for r in cleaning.funnel(df, bench).orderBy("step").collect()]
    assert stages[0] == 10 and stages == sorted(stages, reverse=True) and len(stages) == 10
    code = "def f(a, b): return a + b + c + d if a else h(%s) # %s"
    near = docs_of(spark, [code % (1, "one"), code % (22, "two words"), "x\n" + long + "\nfine day", long + " x", None])
    assert [(r.a, r.b) for r in cleaning.code_clones(near).where("jaccard = 1 or a < 2").collect()] == []
    assert cleaning.code_clones(docs_of(spark, [code % (1, "one"), "\n" + (code % (22, "two")) + "\nreturn"])).count() == 1
    assert [tuple(r)[:4] for r in cleaning.paragraph_links(near).collect()] == [(2, 1, 3, 0)]
    assert cleaning.without_generated(docs_of(spark, ["// do not edit", "fine", None])).count() == 2
    assert [r.text for r in cleaning.masked(docs_of(spark, ["a@b.org or 10.0.0.1", None])).orderBy("doc_id").collect()] == ["<PII> or <PII>", ""]
    kept = dict((k, sorted(r.doc_id for r in x.collect())) for k, x in cleaning.stages(docs_of(spark, ["the cat and the dog", "the cat and the dog", "the idiot on this", "the " + long, "the " + long + " x"]), bench, ["idiot"], {}))
    assert kept["deduplicated"] == [0, 2, 3, 4] and kept["near_deduplicated"] == [0, 2, 3] and kept["decontaminated"] == [0]
    assert [x for (x,) in df.select(cleaning.is_generated(F.lit("// DO NOT EDIT"))).limit(1).collect()] == [True]


def test_mixture(spark):
    rows = spark.createDataFrame([(i, "a" if i < 80 else "b", 1) for i in range(100)], "doc_id long, s string, n long")
    plan = mixture.shares(rows, "s", "n", spark.createDataFrame([("a", 0.5), ("b", 0.5)], "slice string, target double"))
    rate = {r.slice: r.rate for r in plan.collect()}
    assert rate == {"a": pytest.approx(0.25), "b": 1.0}
    took = mixture.sample(rows, "s", plan)
    assert took.where("s = 'b'").count() == 20 and took.where("s = 'a'").count() < 40
    assert mixture.epochs(spark, 1.6e12, 0.8e12, 2).first().within_cap
    turns = spark.createDataFrame([(1, 1, "assistant", "error"), (1, 2, "user", "?"), (1, 3, "assistant", "done"), (2, 1, "assistant", "error")], "conv_id long, turn long, role string, text string")
    assert sorted((r.conv_id, r.recovered) for r in mixture.recoveries(turns, "error").collect()) == [(1, True), (2, False)]
    rate = mixture.recovery_rate(turns, "error").first()
    assert (rate.failures, rate.rate, rate.passed) == (2, 0.5, False) and mixture.recovery_rate(turns, "nothing").first().passed
    assert mixture.quota(rows, ["s"], 3, "doc_id").count() == 6
    assert mixture.capped(rows.withColumn("f", F.col("doc_id") < 8), "f").first().within_cap
    bars = mixture.bars(spark.createDataFrame([("m", 0.9)], "metric string, value double"), spark.createDataFrame([("m", 0.8), ("k", 0.1)], "metric string, bar double"))
    assert not mixture.all_passed(bars).first().passed
    calls = spark.createDataFrame([('{"k": 1}',), ("{",), (None,)], "c string")
    assert mixture.schema_accuracy(calls, "c", "k int", "k").first().valid == 1
    a, b = (spark.createDataFrame([(1, x)], "k1 long, text string") for x in ("hello", "bonjour"))
    assert mixture.aligned(a, b, "k1").first().text_b == "bonjour"
    assert mixture.vocabulary_budget(spark).first().fits and sum(x for _, x in mixture.PRETRAINING) == 100 == sum(x for _, x in mixture.FINE_TUNING)
    assert fertility.choose_vocabulary(spark.createDataFrame([(65536, False), (131072, True), (262144, True)], "vocab long, meets boolean")).first().vocab == 131072
    assert [r.billions for r in fertility.embedding_cost(spark).orderBy("vocab").collect()] == [0.805, 1.611, 3.221]
    assert mixture.pivot(rows.withColumn("v", F.lit(1.0)), "doc_id", "s", ["a", "b"], "v").count() == 100


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame(pd.DataFrame({"lang": ["en", "en"], "text": ["a b", "c"]})).write.parquet(src)
    query = counts.language_counts(spark.readStream.schema("lang string, text string").parquet(src)).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    assert tuple(spark.table("counted").first()) == ("en", 2, 3, 3)


def test_minhash_compares_all_members_of_a_band(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(words[7 * i : 7 * i + 90]) for i in range(1, 31)}
    sets = {i: set(one(spark, t, cleaning.shingle_hashes, "string")) for i, t in texts.items()}
    bands = {}
    for i, h in sets.items():
        m = [min((x * a + b) % cleaning.PRIME for x in h) for a, b in cleaning.hash_family()]
        bands[i] = [tuple(m[k : k + cleaning.ROWS]) for k in range(0, cleaning.HASHES, cleaning.ROWS)]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(a, b): like(a, b) for a in sets for b in sets if a < b and like(a, b) >= cleaning.SIMILARITY and any(x == y for x, y in zip(bands[a], bands[b], strict=True))}
    df = spark.createDataFrame([*texts.items(), (90, texts[1])], "doc_id long, text string")
    for block in (256, 2):
        monkeypatch.setattr(cleaning, "BLOCK", block)
        got = cleaning.minhash_links(df).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.jaccard for r in got} == want


def test_training_keeps_all_words_beyond_the_drivers_bound(spark, monkeypatch):
    r = random.Random(5)
    names = ["".join(r.choice("abcaé") for _ in range(r.randint(1, 7))) for _ in range(150)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(names) for _ in range(60)), r.choice(["en", "fr", None])) for i in range(12)], "doc_id long, text string, lang string")
    words = bpe.pretoken_counts(docs)
    want = bpe.train(words, 256 + 40)
    for top in (512, 3):
        monkeypatch.setattr(bpe, "TOP", top)
        assert bpe.train(words, 256 + 40, max_words=5) == want
    assert pieces.train(docs, 2040, max_words=5) == pieces.train(docs, 2040)
    few, whole = fertility.training_rounds(docs, 256 + 10, 2, max_words=5), fertility.training_rounds(docs, 256 + 10, 2)
    assert [x["round"] for x in few[0]] == [1, 2] and few[1]["fertility"] == whole[1]["fertility"]
    assert [m[:2] for m in few[1]["merges"]] == [m[:2] for m in whole[1]["merges"]]


def test_grid_search_beyond_the_drivers_bound_counts_once(spark, monkeypatch):
    """many bytes of pretokens stay distributed, whatever their number, and a grid counts them once."""
    r = random.Random(6)
    names = ["".join(r.choice("abcaé") for _ in range(r.randint(1, 7))) for _ in range(150)]
    docs = spark.createDataFrame([(" ".join(r.choice(names) for _ in range(60)), r.choice(["en", "fr", None])) for i in range(12)], "text string, lang string")
    choices, calls, count = {"en": [1.0, 2.0], "fr": [1.0]}, [], bpe.pretoken_counts
    want = fertility.grid_search(docs, 256 + 16, choices)
    monkeypatch.setattr(fertility, "MAX_BYTES", 10)
    monkeypatch.setattr(bpe, "train_local", None)
    monkeypatch.setattr(bpe, "pretoken_counts", lambda *a, **k: calls.append(1) or count(*a, **k))
    assert fertility.grid_search(docs, 256 + 16, choices) == want and len(calls) == 1


def test_weight_grid_trains_every_language_and_many_merges(spark, sf_small, monkeypatch):
    """the query tries each weight of each language and trains as many merges as the re-balancing rounds."""
    seen, search = [], fertility.grid_search
    monkeypatch.setattr(fertility, "grid_search", lambda docs, size, choices: seen.append((size, choices)) or search(docs.limit(20), 256 + 2, {k: v[:1] for k, v in choices.items()}))
    assert len(queries.weight_grid(spark, sf_small).collect()) == 1
    langs = {r["lang"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("lang").distinct().collect() if r["lang"]}
    ((size, choices),) = seen
    assert set(choices) >= langs and size >= 256 + 64 and all({1, 2, 3, 5} <= set(x) for x in choices.values())


def test_grid_search_equals_training_one_by_one(spark, monkeypatch):
    """cut fragments, shared states and lower bounds change no spread; nor does the way for large tables."""
    r = random.Random(11)
    names = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(300)]
    docs = spark.createDataFrame([("".join(r.choice(names) + r.choice([" ", "  ", ", ", "\n", "\u3000", "3"]) for _ in range(80)), r.choice(["de", "en", "fr", None])) for _ in range(30)] + [(None, "en"), ("", "xx")], "text string, lang string")
    choices = {"de": [1.0, 3.0], "en": [1.0, 2.5], "zz": [1.0, 9.0]}
    plain = bpe.pretoken_counts(docs, by=["lang"])
    assert sorted(map(str, fertility.counted(docs)[0].select("lang", "pretoken", "freq").collect())) == sorted(map(str, plain.select("lang", "pretoken", "freq").collect()))
    for merges in (5, 40):
        got = fertility.grid_search(docs, 256 + merges, choices)
        assert len(got) == 8
        for x in got:
            log, best = fertility.training_rounds(docs, 256 + merges, 1, x["weights"])
            assert (x["weights"], x["spread"], x["score"]) == (best["weights"], log[0]["spread"], log[0]["score"])
    shares = [grid.tokens(plain, ["de", "en"], 40, [(1.0, 3.0), (2.5, 1.0)], share) for share in (0.3, 0.01, 0.0)]
    assert shares[0] == shares[1] == shares[2]
    few = fertility.grid_search(docs, 256 + 5, {"de": [1.0, 3.0]})
    monkeypatch.setattr(grid, "MAX_FRAGMENTS", -1)
    assert fertility.grid_search(docs, 256 + 5, {"de": [1.0, 3.0]}) == few


def test_decoding_keeps_every_row(spark):
    vocab = bpe.vocabulary(spark, [("61", "62", 3)])
    rows = spark.createDataFrame([(1, [256, 32]), (2, []), (3, None), (1, [97]), (None, [195, 169])], "doc_id long, ids array<int>")
    got = [(r.doc_id, r.text) for r in bpe.decode_ids(rows, vocab, "doc_id").collect()]
    assert sorted(got, key=str) == sorted([(1, "ab "), (2, ""), (3, None), (1, "a"), (None, "é")], key=str)
    for bad in ([257], [-1], [None]):
        with pytest.raises(Exception, match="no such id"):
            bpe.decode_ids(spark.createDataFrame([(1, bad)], "doc_id long, ids array<int>"), vocab, "doc_id").collect()
    tokens = spark.createDataFrame([(["61", "6162"],), (["zz"],)], "t array<string>")
    names = bpe.vocabulary_list([("61", "62", 3)])
    assert [r.x for r in tokens.select(bpe.token_ids(F.col("t"), names).alias("x")).collect()] == [[97, 256], [None]]
    with pytest.raises(Exception, match="no such token"):
        tokens.select(bpe.token_ids(F.col("t"), names, strict=True).alias("x")).collect()


def test_quality_quantile_is_exact(spark):
    texts = ["a" * k + "1" * (200 - k) for k in range(1, 120)]
    got = cleaning.quality_filter(docs_of(spark, texts), 0.3).collect()
    shares = sorted(k / 200 for k in range(1, 120))
    assert {r.least for r in got} == {shares[-(-119 * 3 // 10) - 1]} and max(abs(r.letters - (r.doc_id + 1) / 200) for r in got) < 1e-15


def test_lines_and_labels(spark):
    docs = spark.createDataFrame([("en", "a b\n\n  \nc"), ("xx", "d")], "lang string, text string")
    got = {r.lang: (r.tokens, r.words) for r in fertility.by_line(docs, []).collect()}
    assert got == {"en": (4, 3), "xx": (1, 1)}
    named = {r.lang: (r.label, r.code) for r in fertility.with_labels(fertility.by_line(docs, []), corpora.languages(spark)).collect()}
    assert named == {"en": ("English", "en"), "xx": ("xx", "xx")}


def test_rates_by_domain(spark):
    rows = spark.createDataFrame([("en", "a bc"), ("code", "a bc"), ("json", '{"k": [1, "x"]}'), ("json", None), (None, "a b")], "domain string, text string")
    got = {r.domain: r for r in fertility.by_domain(rows, []).collect()}
    assert (got["en"].rate, got["code"].rate, got[None].rate) == (2.0, 1.0, 1.5)
    assert got["json"].json_units == 9 and got["json"].rate == 15 / 9
