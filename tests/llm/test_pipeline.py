import re
from fractions import Fraction
from heapq import heappop, heappush

import corpus_pipeline
from corpuscle.llm import pfair_mix
from corpuscle.llm import queries as llm_queries

from .conftest import SCHEMA, odd_texts, prose, rows


def simulate(counts, weights):
    """Earliest deadline first, slot by slot, phase by phase."""
    left, done, out = dict(counts), dict.fromkeys(counts, 0), []
    while any(left.values()):
        parts = pfair_mix.whole_parts({s: weights[s] for s in left if left[s]})
        total, t, sent = sum(parts.values()), 0, dict.fromkeys(parts, 0)
        while True:
            ready = []
            for s, p in parts.items():
                if sent[s] * total // p <= t:
                    heappush(ready, (-(-(sent[s] + 1) * total // p), s))
            s = heappop(ready)[1]
            out.append((s, done[s]))
            done[s] += 1
            sent[s] += 1
            left[s] -= 1
            t += 1
            assert all(abs(Fraction(p, total) * t - sent[x]) < 1 for x, p in parts.items())
            if not left[s]:
                break
    return out


def test_phases_equal_a_simulation():
    for counts, weights in (({"a": 40, "b": 25, "c": 3}, {"a": 5, "b": 3, "c": 2}), ({"a": 7}, {"a": 1}), ({"a": 5, "b": 2500}, {"a": 0.001, "b": 0.999}), ({x: 4 for x in "abcdef"}, dict.fromkeys("abcdef", 1))):
        plan, got = pfair_mix.phases(counts, weights), {}
        for p in plan:
            for s, parts in p["parts"].items():
                for i in range(p["used"][s]):
                    got[p["slot"] + i // parts * p["total"] + p["places"][s][i % parts]] = (s, p["first"][s] + i)
        assert [got[i] for i in range(len(got))] == simulate(counts, weights)


def test_mixture_has_every_document_once(spark, nothing):
    texts = [(i, "x") for i in range(300)]
    df = spark.createDataFrame(rows(texts, sources=["big"] * 7 + ["mid", "mid", None]), SCHEMA)
    got = pfair_mix.mix(df, {"big": 0.5, "mid": 0.4}, block=4).collect()
    assert sorted(r.doc_id for r in got) == list(range(300))
    blocks = {(r.source, r.block): r for r in got}
    slots = sorted(r.slot for r in blocks.values())
    assert slots == list(range(len(blocks))) and all(r.release <= r.slot < r.deadline for r in blocks.values())
    assert pfair_mix.mix(nothing).count() == 0
    again = pfair_mix.mix(df.repartition(5), {"big": 0.5, "mid": 0.4}, block=4).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got)) if all(r.source for r in got) else {tuple(r) for r in again} == {tuple(r) for r in got}
    first = pfair_mix.mix(df, {"big": 0.5, "mid": 0.4}, block=4, until="first").collect()
    assert {r.phase for r in first} == {0} and len(first) < 300
    assert pfair_mix.mixed_documents(df).columns == df.columns and pfair_mix.mixed_documents(df).count() == 300


def test_ordinals_number_each_source(spark):
    df = spark.createDataFrame([(i, "s" if i % 3 else None) for i in range(3000)], "doc_id long, source string")
    by = {}
    for r in pfair_mix.ordinals(df, 3000, 1).collect():
        by.setdefault(r.source, []).append(r.ordinal)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_stages_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in odd_texts()] + [(None, "no id", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(2 * i + 1, 1, int(i % 5 == 0)) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert docs.count() > 10


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_run_keeps_clean_documents(spark, sf_small):
    got = corpus_pipeline.run(spark, sf_small)
    n = spark.read.parquet(f"{sf_small}/documents.parquet").count()
    assert 0.6 * n < got.count() < n and {"doc_id", "n_tokens", "ids_sha256"} <= set(got.columns)


def test_every_query_runs(spark, sf_small):
    for name in ("op1_pfair_mix", "op2_nearest", "op9_embedding_dedup"):
        assert llm_queries()[name](spark, sf_small).count() > 0
    assert prose(1, 3)


def test_targets_hold_unrounded():
    many = {f"s{i:04d}": 1.0 for i in range(1200)} | {"big": 600.0}
    long = {"a": 2**0.5, "b": 3**0.5, "c": 0.0007}
    for weights, counts in ((many, {s: 700 if s == "big" else 3 for s in many}), (long, {"a": 30000, "b": 36000, "c": 100})):
        whole = sum(map(Fraction, weights.values()))
        plan = pfair_mix.phases(counts, weights, "first")[0]
        assert plan["length"] > 1800
        for s, w in weights.items():
            w = Fraction(w) / whole
            # A source is furthest ahead just after a block and furthest behind just before one.
            assert abs(w * plan["length"] - plan["used"][s]) < 1
            assert all(abs(w * t - i) < 1 and abs(w * (t + 1) - i - 1) < 1 for i, t in enumerate(plan["places"][s]))


def test_more_than_a_thousand_sources(spark):
    df = spark.createDataFrame([(i, "big" if i % 3 == 0 else f"s{i % 1100}") for i in range(3600)], "doc_id long, source string")
    got = pfair_mix.mix(df, {"big": 1200.0} | {f"s{i}": 1.0 for i in range(1100)}, block=1, until="first").collect()
    big = sum(r.source == "big" for r in got)
    assert got and abs(big - len(got) * 1200 / 2300) < 1 and len({(r.source, r.block) for r in got}) == len(got)


def test_run_returns_the_mixture(spark, sf_small):
    key = lambda s: (s is not None, s or "")
    got = corpus_pipeline.run(spark, sf_small).select("doc_id", "mix_slot", "mix_position")
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").selectExpr("doc_id", "source", "xxhash64(29, doc_id) h")
    by = {}
    for r in got.join(docs, "doc_id").collect():
        by.setdefault(key(r.source), []).append(((r.h % (1 << 64)) >> 33, r.h, r.doc_id, (r.mix_slot, r.mix_position)))
    counts = {s: -(-len(x) // pfair_mix.BLOCK) for s, x in by.items()}
    slots = {block: t for t, block in enumerate(simulate(counts, {s: len(x) ** pfair_mix.ALPHA for s, x in by.items()}))}
    for s, x in by.items():
        for i, (*_, at) in enumerate(sorted(x)):
            assert at == (slots[s, i // pfair_mix.BLOCK], i % pfair_mix.BLOCK)
    assert sum(map(len, by.values())) == got.count() > 0


def test_run_equals_brute_force(spark, sf_small):
    """Every stage but the fitted one again by plain means: all pairs, plain patterns, the tokenizers library."""
    import hashlib

    from tokenizers import Tokenizer

    from corpuscle.llm import bpe_backtrack, weak_toxicity

    from .test_documents import linked, spans

    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id for r in weak_toxicity.score_documents(docs, labels).collect() if r.predicted}
    texts = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    component = linked(texts)
    library = Tokenizer.from_file(bpe_backtrack.vocabulary_path())
    more = [r for r in corpus_pipeline.secret_ledger.MORE]
    want = {}
    for d, t in texts:
        if component[d][1] != d:
            continue
        t = t or ""
        places = [(a, b) for a, _, _, b in spans(t)]
        for rule in more:
            places += [m.span() for m in re.finditer(rule.pattern, t) if len(m.group(rule.group)) >= rule.least]
        out, at = "", 0
        for a, b in sorted(places):
            if a < at:
                at = max(at, b)
                continue
            out, at = out + t[at:a] + "[SECRET]", b
        ids = library.encode(out + t[at:], add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_small).collect()}
    assert got == want and 0 < len(got) < docs.count()
