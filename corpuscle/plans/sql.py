"""The queries again as SQL, for an independent engine."""

from __future__ import annotations

from ..functions import text as T
from ..operators import cleaning as C
from ..operators import fertility as R
from ..sources.corpora import LANGUAGES
from . import queries as Q

_S = T.SPACE
_q = lambda s: s.replace("'", "''")
_q2 = lambda s: "'" + _q(s) + "'"
_T = "coalesce(text, '')"
_WORDS = rf"len(regexp_extract_all({_T}, '[^{_S}]+'))"
_UNITS = rf"len(regexp_extract_all({_T}, '{T.UNIT}'))"
_PRETOKENS = rf"regexp_extract_all({_T}, '{T.PRETOKEN}')"
_FOLD = rf"case when regexp_matches(p, '^[{_S}][^{_S}]') then ' ' || substr(p, 2) else p end"
_VISIBLE = lambda x: rf"regexp_replace({x}, '[{_S}]', '', 'g')"
_GRAMS = rf"regexp_extract_all(lower({_T}), '{T.GRAM_WORD}')"

_COUNTED = f"counted as materialized (select lang, t, count(*) c from (select lang, {_FOLD} t from (select lang, unnest({_PRETOKENS}) p from documents)) group by all)"


def _merge_chain(k: int = Q.MERGES) -> str:
    """Merges one after the other: tables w0 .. wk of distinct pretokens and b0 .. b(k-1) of the best pairs."""
    parts = [_COUNTED, r"w0 as materialized (select t, regexp_replace(hex(encode(t)), '(..)', '<\1>', 'g') s, sum(c) c from counted group by t)"]
    for i in range(k):
        parts.append(
            f"b{i} as materialized (with x as (select c, string_split(s[2:-2], '><') y from w{i}), p as (select c, y, unnest(range(1, len(y))) i from x where len(y) > 1) "
            f"select y[i] a, y[i+1] b, sum(c) n from p group by 1, 2 having sum(c) >= 2 order by n desc, a, b limit 1)"
        )
        parts.append(f"w{i + 1} as materialized (select t, c, case when a is null then s else replace(s, '<' || a || '><' || b || '>', '<' || a || b || '>') end s from w{i} left join b{i} on true)")
    return ", ".join(parts)


_CHAIN = _merge_chain()
_LAST = f"w{Q.MERGES}"
_MERGED = " union all ".join(f"select {i} rank, a, b, a || b merged, n from b{i}" for i in range(Q.MERGES))
_RATES = f"""{_CHAIN},
tokens as (select lang, sum(counted.c * len(string_split(s[2:-2], '><')))::bigint tokens from counted join {_LAST} using (t) group by lang),
sizes as (select lang, sum({_WORDS})::bigint words, sum({_UNITS})::bigint faithful_units from documents group by lang),
rates as (select sizes.lang, coalesce(tokens, 0) tokens, words, faithful_units, tokens / nullif(words, 0) fertility_w, tokens / nullif(faithful_units, 0) fertility_u from sizes left join tokens on sizes.lang is not distinct from tokens.lang)"""
_LINE_SPLIT = rf"regexp_split_to_array({_T}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"


def _spoken() -> str:
    """Merges over the distinct pretokens of table ``spoken``: the last table is l<merges>."""
    steps = [r"l0 as (select distinct t, regexp_replace(hex(encode(t)), '(..)', '<\1>', 'g') s from spoken)"]
    for i in range(Q.MERGES):
        steps.append(f"l{i + 1} as materialized (select t, case when a is null then s else replace(s, '<' || a || '><' || b || '>', '<' || a || b || '>') end s from l{i} left join b{i} on true)")
    return ", ".join(steps)


def _line_rates() -> str:
    """Rates over non-blank lines: their pretokens go through the merges of the whole texts."""
    lines = f"lines as materialized (select lang, text from (select lang, unnest({_LINE_SPLIT}) text from documents) where length({_VISIBLE('text')}) > 0)"
    counted = f"spoken as materialized (select lang, t, count(*) c from (select lang, {_FOLD} t from (select lang, unnest({_PRETOKENS}) p from lines)) group by all)"
    return f"""with {_CHAIN}, {lines}, {counted}, {_spoken()},
tokens as (select lang, sum(spoken.c * len(string_split(s[2:-2], '><')))::bigint tokens from spoken join l{Q.MERGES} using (t) group by lang),
sizes as (select lang, sum({_WORDS})::bigint words, sum({_UNITS})::bigint faithful_units from lines group by lang)
select sizes.lang, coalesce(tokens, 0) tokens, words, faithful_units, tokens / nullif(words, 0) fertility_w, tokens / nullif(faithful_units, 0) fertility_u from sizes left join tokens on sizes.lang is not distinct from tokens.lang"""


def _choice() -> str:
    rows = " union all ".join(f"select {256 + k} vocab, (select sum(c * len(string_split(s[2:-2], '><')))::bigint from w{k}) tokens" for k in (4, 8, Q.MERGES))
    return f"with {_CHAIN}, o as ({rows}), m as (select *, coalesce(tokens / nullif((select sum({_WORDS}) from documents), 0) <= 6.0, false) meets from o) select vocab::int vocab, tokens, meets from m where meets order by vocab limit 1"


_WEIGHTS = "weights(l, weight) as (values " + ", ".join(f"('{k}', {v})" for k, v in Q.WEIGHTS.items()) + ")"
_STOP = lambda words: f"len(list_filter({_GRAMS}, lambda w: w in ({', '.join(repr(w) for w in words)})))"
_SCRIPT = lambda p: f"len(regexp_extract_all({_T}, '{p}'))"


def _language() -> str:
    n = {k: _STOP(v) for k, v in C.STOP_WORDS.items()} | {C.SCRIPT_LANGUAGE[k]: _SCRIPT(v) for k, v in C.SCRIPTS.items()}
    names = sorted(n)
    top, total = f"greatest({', '.join(f'n_{k}' for k in names)})", " + ".join(f"n_{k}" for k in names)
    pred = " ".join(f"when n_{k} = {top} and {top} > 0 then '{k}'" for k in names)
    return f"""with s as (select *, {', '.join(f'{x}::bigint n_{k}' for k, x in n.items())}, {_STOP(C.ROMANISED)}::bigint n_romanised from documents)
select doc_id, {', '.join(f'n_{k}' for k in names)}, n_romanised, case {pred} else 'und' end lang_pred, coalesce(({total} - {top}) / nullif({total}, 0), 0) mix_share from s"""


_LICENSE = "case " + " ".join(f"when regexp_matches({_T}, '{p}') then '{k}'" for k, p in C.LICENSES.items()) + " else 'none' end"
_DUPES = f"d as (select doc_id, sha256({_T}) digest from documents), g as (select digest, min(doc_id) first_id, count(*) copies from d group by digest)"
_PARAGRAPHS = rf"""p as (select doc_id, pos - 1 pos, parts[pos] paragraph from (select doc_id, parts, unnest(range(1, len(parts) + 1)) pos from (select doc_id, string_split({_T}, chr(10)) parts from documents))),
r as (select doc_id, pos, paragraph, sha256(paragraph) digest from p where length(regexp_replace(paragraph, '[{_S}]', '', 'g')) > 0),
g as (select digest, min(struct_pack(doc_id := doc_id, pos := pos)) f, count(*) copies from r group by digest)"""
_NGRAM = lambda table, key, n: f"(select distinct {key}, array_to_string(w[i:i+{n - 1}], ' ') g from (select {key}, w, unnest(range(1, len(w) - {n - 2})) i from (select {key}, {_GRAMS} w from {table}) where len(w) >= {n}))"
_DIRTY = f"select doc_id, count(distinct item_id) items from {_NGRAM('documents', 'doc_id', 13)} a join {_NGRAM('benchmark', 'item_id', 13)} b using (g) group by doc_id"
_HASH60 = lambda x: f"('0x' || substr(md5({x}), 1, 15))::bigint"
_FEATURES = rf"""f as (select doc_id, lang, coalesce(len(regexp_extract_all({_T}, '\p{{L}}')) / nullif(length({_T}), 0), 0) letters, coalesce(len(regexp_extract_all({_T}, '\p{{Lu}}')) / nullif(length({_T}), 0), 0) upper,
 1 - len(list_distinct(string_split({_T}, chr(10)))) / len(string_split({_T}, chr(10))) repeated from documents),
least_ as (select l, min(letters) least from (select lang l, letters, count(*) over (partition by lang order by letters) up_to, count(*) over (partition by lang) n from f) where up_to >= n * 0.05::double group by l),
kept as (select doc_id, lang, letters, least, letters >= least and repeated < 0.5 and upper < 0.5 kept from f join least_ on lang is not distinct from l)"""
_LUHN = "list_sum(list_transform(range(1, 17), lambda i: case when i % 2 = 1 then (2 * substr(x, i, 1)::int) // 10 + (2 * substr(x, i, 1)::int) % 10 else substr(x, i, 1)::int end)) % 10 = 0"
_SHARES = lambda rows, slice_, amount, targets: f"""t as (select {slice_} slice, sum({amount})::bigint amount from {rows} group by 1),
targets(s, target) as (values {', '.join(f"('{k}', {v}::double)" for k, v in targets)}),
u as (select slice, amount, amount / sum(amount) over () share, coalesce(target, 0) target from t left join targets on slice = s),
rated as (select slice, amount, share, target, coalesce((target / share) / max(target / share) over (), 0) rate from u)"""  # noqa: E731
_MIX = _SHARES("documents", "lang", _WORDS, [(k, v / 100) for k, v in Q._TARGETS])
_SFT = _SHARES("conversations", "role", "1", [("user", 0.45), ("assistant", 0.45), ("system", 0.1)])
_TOXIC = f"tox as (select doc_id, lang, {_STOP(Q.LEXICON)}::bigint hits, coalesce({_STOP(Q.LEXICON)} * 1000 / nullif({_WORDS}, 0), 0) per_mille from documents), flags as (select *, per_mille > case {' '.join(f'when lang = {k!r} then {v}' for k, v in Q.THRESHOLDS.items())} else 5.0 end flagged from tox)"
def _minhash(rows: str) -> str:
    """Links among ``rows``, which have ``doc_id`` and ``t``."""
    return f"""classes as (select min(doc_id) doc_id, any_value(t) t from ({rows}) group by sha256(t)),
sh as (select doc_id, list_distinct(list_transform(list_distinct(list_transform(range(1, len(w) - {C.SHINGLE - 2}), lambda i: array_to_string(w[i:i+{C.SHINGLE - 1}], ' '))), lambda g: ('0x' || substr(md5(g), 1, 8))::bigint % {C.PRIME})) h from (select doc_id, regexp_extract_all(lower(t), '{T.GRAM_WORD}') w from classes) where len(w) >= {C.SHINGLE}),
m as materialized (select doc_id, h, [{', '.join(f'list_min(list_transform(h, lambda x: (x * {a} + {b}) % {C.PRIME}))' for a, b in C.hash_family())}] m from sh),
bands as materialized (select doc_id, k band, array_to_string(m[k*{C.ROWS}+1:k*{C.ROWS}+{C.ROWS}], '_') v from (select doc_id, m, unnest(range(0, {C.HASHES // C.ROWS})) k from m)),
pairs as (select distinct x.doc_id a, y.doc_id b from bands x join bands y on x.band = y.band and x.v = y.v and x.doc_id < y.doc_id),
j as (select a, b, len(list_intersect(x.h, y.h)) n, len(x.h) p, len(y.h) q from pairs join m x on x.doc_id = a join m y on y.doc_id = b),
links as (select a, b, n / (p + q - n) jaccard from j where n / (p + q - n) >= {C.SIMILARITY})"""


_MINHASH = _minhash(f"select doc_id, {_T} t from documents")
_CODE = f"regexp_replace(regexp_replace(regexp_replace({_T}, '{_q(C.COMMENT)}', ' ', 'g'), '{_q(C.STRING)}', ' str ', 'g'), '{_q(C.NUMBER)}', '0', 'g')"
_MASKED = lambda x: f"regexp_replace(regexp_replace(regexp_replace({x}, {_q2(C.PII['email'])}, '<PII>', 'g'), {_q2(C.PII['ipv4'])}, '<PII>', 'g'), {_q2(C.PII['phone'])}, '<PII>', 'g')"


def _funnel() -> str:
    """Each step over the rows of the one before it."""
    over = lambda i, sql: sql.replace("from documents", f"from s{i}")
    secret = f"regexp_replace(text, '{_q(C.SECRET)}', '<SECRET>', 'g')"
    kept = lambda i, where: f"s{i} as materialized (select * from s{i - 1} where {over(i - 1, where)})"
    steps = [
        f"s0 as materialized (select doc_id, lang, {_T} text from documents)",
        f"s1 as materialized (select doc_id, lang, nfc_normalize(text) text from s0 where doc_id in (select doc_id from ({over(0, _language())}) where lang_pred <> 'und'))",
        kept(2, f"doc_id in (with {_DUPES} select doc_id from d join g using (digest) where doc_id = first_id)"),
        kept(3, f"doc_id not in (with {_MINHASH} select b from links)"),
        kept(4, f"doc_id in (with {_FEATURES} select doc_id from kept where kept)"),
        kept(5, f"{_LICENSE} in {C.ALLOWED!r}"),
        kept(6, f"not regexp_matches(text, {_q2(C.GENERATED)})"),
        f"s7 as materialized (select doc_id, lang, {_MASKED(secret)} text from s6)",
        kept(8, f"doc_id in (with {_TOXIC} select doc_id from flags where not flagged)"),
        kept(9, f"doc_id not in (select doc_id from ({_DIRTY}))"),
    ]
    names = ("input", "identified", "deduplicated", "near_deduplicated", "quality", "licensed", "written", "scrubbed", "civil", "decontaminated")
    return f"with {', '.join(steps)} " + " union all ".join(f"select {i} step, '{x}' stage, count(*) documents from s{i}" for i, x in enumerate(names))


def _domains() -> str:
    """Tokens of other texts under the documents' merges, by each domain's measure."""
    texts = "texts as materialized (select lang domain, coalesce(text, '') text from documents union all select 'code', coalesce(html, '') from pages union all select 'json', coalesce(props::varchar, '') from events)"
    kind = lambda m: "(" + ", ".join(repr(d) for d, x, _ in R.TARGETS if x == m) + ")"
    return f"""with {_CHAIN}, {texts}, spoken as materialized (select domain, t, count(*) c from (select domain, {_FOLD} t from (select domain, unnest({_PRETOKENS}) p from texts)) group by all), {_spoken()},
tokens as (select domain, sum(spoken.c * len(string_split(s[2:-2], '><')))::bigint tokens from spoken join l{Q.MERGES} using (t) group by domain),
sizes as (select domain, sum({_WORDS})::bigint words, sum(length(text))::bigint as characters, sum(len(regexp_extract_all(text, {_q2(R.JSON_UNIT)})))::bigint json_units from texts group by domain),
x as (select sizes.domain, coalesce(tokens, 0)::bigint tokens, words, characters, json_units from sizes left join tokens on sizes.domain is not distinct from tokens.domain)
select *, tokens / nullif(case when coalesce(domain in {kind('char')}, false) then characters when coalesce(domain in ({kind('unit')[1:-1]}), false) then json_units else words end, 0) rate from x"""


def oracle_sql() -> dict[str, str]:
    line = rf"regexp_split_to_array({_T}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
    return {
        "corpus_alphabet": "select distinct ch, unicode(ch)::int code_point from (select unnest(string_split(text, '')) ch from documents) where ch not in ('', chr(10))",
        "corpus_stats": f"select lang, sum(length({_T}))::bigint chars, sum(len({_T}) - len(replace({_T}, chr(10), '')))::bigint lines, 'NFC' normalization from documents group by lang",
        "words_and_units": f"select lang, sum({_WORDS})::bigint words, sum({_UNITS})::bigint faithful_units from documents group by lang",
        "visible_characters": f"select doc_id, length({_VISIBLE(_T)})::bigint visible, length(regexp_replace(regexp_replace({_T}, '^[{_S}]+', ''), '[{_S}]+$', ''))::bigint stripped, len(list_filter({line}, lambda x: length(regexp_replace(x, '[{_S}]', '', 'g')) > 0))::bigint as lines from documents",
        "pretoken_summary": f"with {_COUNTED} select lang, sum(c)::bigint pretokens, count(*) distinct_pretokens from counted group by lang",
        "weighted_pretokens": f"with {_COUNTED}, {_WEIGHTS} select t pretoken, sum(c * coalesce(weight, 1))::bigint freq from counted left join weights on lang = l group by t",
        "pair_counts": f"with {_merge_chain(0)}, x as (select c, string_split(s[2:-2], '><') y from w0), p as (select c, y, unnest(range(1, len(y))) i from x where len(y) > 1) select y[i] a, y[i+1] b, sum(c)::bigint n from p group by 1, 2",
        "bpe_merges": f"with {_CHAIN} select rank, a, b, merged, n::bigint n from ({_MERGED})",
        "bpe_vocabulary": f"with {_CHAIN}, v as (select i, printf('%02X', i) token from range(256) r(i) union all select 256 + rank, merged from ({_MERGED})), u as (select token, min(i) i from v group by token) select (row_number() over (order by i) - 1)::int id, token from u",
        "fertility_by_language": f"with {_RATES} select * from rates",
        "fertility_by_line": _line_rates(),
        "vocabulary_choice": _choice(),
        "labelled_rates": f"with {_RATES}, n(code, label) as (values {', '.join(f'({c!r}, {x!r})' for c, x, _ in LANGUAGES)}) select lang, coalesce(label, lang) as label, lang code, fertility_u from rates left join n on lang = n.code",
        "token_lookup": f"""with {_CHAIN}, v as (select i, printf('%02X', i) token from range(256) r(i) union all select 256 + rank, merged from ({_MERGED})), ids as (select token, (row_number() over (order by min(i)) - 1) id from v group by token),
o as (select doc_id, t, count(*) c from (select doc_id, {_FOLD} t from (select doc_id, unnest({_PRETOKENS}) p from documents)) group by all),
w as materialized (select t, len(string_split(s[2:-2], '><')) n, list_sum(list_transform(string_split(s[2:-2], '><'), lambda x: m[x])) z from {_LAST}, (select map(list(token), list(id)) m from ids)),
k as (select doc_id, sum(c * n)::bigint n, sum(c * z)::bigint z from o join w using (t) group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint n, coalesce(z, 0)::bigint id_sum from documents d left join k on d.doc_id = k.doc_id""",
        "fertility_score": f"""with {_RATES}, x as (select max(fertility_u) - min(fertility_u) spread, avg(fertility_u) mean_fertility, max(case when lang = 'de' then fertility_u end) p, coalesce(string_agg(lang, ',' order by lang) filter (fertility_u > {R.THRESHOLD}), '') over_ from rates)
select spread, 1000 / nullif(spread, 0) raw_score, exp(greatest(0, coalesce(p, 0) / {R.THRESHOLD} - 1)) penalty_factor, 1000 / nullif(spread, 0) / exp(greatest(0, coalesce(p, 0) / {R.THRESHOLD} - 1)) adjusted_score, mean_fertility, over_ languages_over_threshold from x""",
        "fertility_ranking": f"with {_RATES} select lang, fertility_u, rank() over (order by fertility_u)::int place, fertility_u = min(fertility_u) over () best, fertility_u = max(fertility_u) over () worst from rates",
        "fertility_targets": f"with {_RATES}, t(d, target) as (values {', '.join(f'({d!r}, {x}::double)' for d, _, x in R.TARGETS)}) select lang domain, fertility_w rate, coalesce(target, 1.7) target, fertility_w <= coalesce(target, 1.7) meets from rates left join t on lang = d",
        "rebalanced_weights": f"with {_RATES}, {_WEIGHTS}, s as (select lang, greatest(1.0, coalesce(weight, 1)::double * least({R.HIGH}, greatest({R.LOW}, fertility_w / avg(fertility_w) over ()))) w from rates left join weights on lang = l) select lang, w / min(w) over () weight from s",
        "merge_closure": f"with {_CHAIN}, v as (select printf('%02X', i) token from range(256) r(i) union select merged from ({_MERGED})), u as (select a t from ({_MERGED}) union select b from ({_MERGED}) union select merged from ({_MERGED})) select count(*) missing from u where t not in (select token from v)",
        "encode_documents": f"""with {_CHAIN}, v as (select i, printf('%02X', i) token from range(256) r(i) union all select 256 + rank, merged from ({_MERGED})), ids as (select token, (row_number() over (order by min(i)) - 1) id from v group by token),
d as (select doc_id, regexp_replace(regexp_replace({_T}, '^[{_S}]+', ''), '[{_S}]+$', '') text from documents), o as (select doc_id, t, count(*) c from (select doc_id, {_FOLD} t from (select doc_id, unnest({_PRETOKENS}) p from d)) group by all),
w as materialized (select t, len(string_split(s[2:-2], '><')) n, list_sum(list_transform(string_split(s[2:-2], '><'), lambda x: m[x])) z from {_LAST}, (select map(list(token), list(id)) m from ids)),
k as (select doc_id, sum(c * n)::bigint n, sum(c * z)::bigint z from o join w using (t) group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint token_count, {_WORDS}::bigint words, coalesce(n, 0) / nullif({_WORDS}, 0) fertility, true roundtrip_ok, coalesce(z, 0)::bigint id_sum from d left join k on d.doc_id = k.doc_id""",
        "decode_documents": f"""with d as (select doc_id, regexp_replace(regexp_replace({_T}, '^[{_S}]+', ''), '[{_S}]+$', '') text from documents), p as (select doc_id, list_transform({_PRETOKENS}, lambda p: {_FOLD}) x from d)
select doc_id, sha256(array_to_string(x, '')) text_sha256 from p""",
        "roundtrip_gate": f"with l as (select lang, doc_id, x[i] t, i from (select lang, doc_id, x, unnest(range(1, len(x) + 1)) i from (select lang, doc_id, {line} x from documents))), r as (select *, row_number() over (partition by lang order by doc_id, i) r from l where length({_VISIBLE('t')}) > 0) select count(*) + {len(Q.SAMPLES)} samples, 0::bigint failures, true passed from r where r <= 40",
        "metaspace_pieces": "select doc_id, len(regexp_extract_all(replace(coalesce(text, ''), ' ', '▁'), '▁[^▁]*|[^▁]+'))::bigint pieces, replace(array_to_string(regexp_extract_all(replace(coalesce(text, ''), ' ', '▁'), '▁[^▁]*|[^▁]+'), ''), '▁', ' ') = text lossless from documents",
        "display_escapes": "select page_id, url_encode(url) quoted, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) escaped_sha256 from pages",
        "nfc_texts": "select doc_id, sha256(nfc_normalize(text)) nfc_sha256, len(regexp_extract_all(nfc_normalize(text), '[\\x{200c}\\x{200d}]'))::bigint joiners from documents",
        "language_scores": _language(),
        "exact_duplicates": f"with {_DUPES} select doc_id, digest, copies, doc_id = first_id kept from d join g using (digest)",
        "duplicate_groups": f"with {_DUPES} select digest, copies, first_id from g where copies > 1",
        "paragraph_duplicates": f"with {_PARAGRAPHS} select doc_id, pos::int pos, copies, doc_id = f.doc_id and pos = f.pos kept from r join g using (digest)",
        "texts_without_repeats": f"with {_PARAGRAPHS} select doc_id, sha256(string_agg(paragraph, chr(10) order by pos)) text_sha256 from r join g using (digest) where doc_id = f.doc_id and pos = f.pos group by doc_id",
        "minhash_links": f"with {_MINHASH} select a, b, jaccard from links",
        "code_clones": f"with {_minhash(f'select doc_id, {_CODE} t from documents')} select a, b, jaccard from links",
        "paragraph_links": f"with {_PARAGRAPHS}, {_minhash('select struct_pack(doc_id := doc_id, pos := pos) doc_id, paragraph t from r')} select a.doc_id a_doc, a.pos::int a_pos, b.doc_id b_doc, b.pos::int b_pos, jaccard from links",
        "written_documents": f"select doc_id from documents where not regexp_matches({_T}, {_q2(C.GENERATED)})",
        "masked_texts": f"select doc_id, sha256({_MASKED(_T)}) text_sha256 from documents",
        "domain_rates": _domains(),
        "recovery_rate": "with a as (select conv_id, turn, regexp_matches(coalesce(text, ''), '(?i)error|sorry|th') bad from conversations where role = 'assistant'), n as (select *, lead(bad) over (partition by conv_id order by turn) nb from a), r as (select coalesce(not nb, false)::int::double x from n where bad) select count(*) failures, avg(x) rate, coalesce(avg(x) >= 0.6, true) passed from r",
        "fine_tuning_sample": f"with {_SFT} select conv_id, turn, role from conversations join rated on role = slice where {_HASH60(chr(39) + 'sft' + chr(39) + ' || conv_id || chr(58) || turn')} / {float(1 << 60)!r} < rate",
        "contaminated": _DIRTY,
        "decontaminated": f"select doc_id from documents where doc_id not in (select doc_id from ({_DIRTY}))",
        "quality_filter": f"with {_FEATURES} select doc_id, lang, letters, least, kept from kept",
        "license_allowlist": f"select doc_id, {_LICENSE} license, {_LICENSE} in {C.ALLOWED!r} allowed from documents",
        "secret_scrub": f"select doc_id, sha256(regexp_replace({_T}, '{_q(C.SECRET)}', '<SECRET>', 'g')) text_sha256, len(regexp_extract_all({_T}, '{_q(C.SECRET)}'))::bigint redactions from documents",
        "personal_data": f"select doc_id, {', '.join(f'len(regexp_extract_all({_T}, {_q2(p)}))::bigint {k}' for k, p in C.PII.items() if k != 'card')}, len(list_filter(regexp_extract_all({_T}, {_q2(C.PII['card'])}), lambda x: {_LUHN}))::bigint card from documents",
        "toxicity_thresholds": f"with {_TOXIC} select doc_id, lang, hits, per_mille, flagged from flags",
        "toxicity_audit": f"with {_TOXIC} select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by {_HASH60(chr(39) + 'audit' + chr(39) + ' || doc_id')}, doc_id) r from flags where flagged) where r <= 20",
        "labelled_documents": "select d.doc_id, lang, coalesce(quality, -1) quality, coalesce(toxic, -1) toxic from documents d left join labels l on d.doc_id = l.doc_id",
        "cleaning_funnel": _funnel(),
        "mixture_shares": f"with {_MIX} select slice, amount, share, target, rate from rated",
        "mixture_sample": f"with {_MIX} select doc_id, lang from documents join rated on lang = slice where {_HASH60(chr(39) + 'mix' + chr(39) + ' || doc_id')} / {float(1 << 60)!r} < rate",
        "fine_tuning_shares": f"with {_SFT} select slice, amount, share, target, rate from rated",
        "recoveries": "with a as (select conv_id, turn, regexp_matches(coalesce(text, ''), '(?i)error|sorry|th') bad from conversations where role = 'assistant'), n as (select *, lead(bad) over (partition by conv_id order by turn) nb from a) select conv_id, turn, coalesce(not nb, false) recovered from n where bad",
        "annotator_quota": f"select doc_id, lang, source, pick::int pick from (select doc_id, lang, source, row_number() over (partition by lang, source order by {_HASH60(chr(39) + 'quota' + chr(39) + ' || doc_id')}, doc_id) pick from documents) where pick <= 3",
        "synthetic_cap": "with x as (select coalesce(source = 'src3', false) s from documents) select count(*) total, count(*) filter (s) flagged, avg(s::int::double) share, avg(s::int::double) <= 0.08 within_cap from x",
        "language_quality_bars": "with b(metric, bar) as (values ('de', 0.8::double), ('en', 0.8), ('es', 0.8), ('fr', 0.8), ('hi', 0.8)), s as (select lang, avg(quality::double) value from documents join labels using (doc_id) where quality is not null group by lang) select metric, value, bar, coalesce(value >= bar, false) passed from b left join s on lang = metric",
        "call_schema_accuracy": "select count(*) calls, count(*) filter (json_extract(props, '$.k') is not null) valid, avg((json_extract(props, '$.k') is not null)::int::double) accuracy from events",
        "quality_by_source": "select source, avg(quality::double) filter (lang = 'de') de, avg(quality::double) filter (lang = 'en') en, avg(quality::double) filter (lang = 'es') es, avg(quality::double) filter (lang = 'fr') fr from documents left join labels using (doc_id) group by source",
        "embedding_cost": "select v::bigint vocab, round(v * 12288.0::double / 1e9, 3) billions, round(v * 12288.0::double / 40e9 * 100, 1) percent from (values (65536), (131072), (262144)) t(v)",
        "vocabulary_budget": "select 130856::bigint entries, 131072::bigint budget, true fits",
        "token_epochs": f"select 1e6::double budget, sum({_WORDS})::double unique_tokens, 1e6 / sum({_WORDS}) epochs, 1e6 / sum({_WORDS}) <= 2 within_cap from documents",
    }
