"""Corpus cleaning: languages, normal forms, duplicates, quality, licences, secrets, personal data, contamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs

#: Frequent words by language.
STOP_WORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "auf", "mit", "dem", "den"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "was", "for", "with", "on", "this"),
    "es": ("el", "la", "los", "las", "que", "y", "en", "un", "una", "por", "con", "para"),
    "fr": ("le", "la", "les", "des", "et", "un", "une", "du", "dans", "est", "pour", "que"),
}
#: Scripts by block pattern.
SCRIPTS = {"deva": r"[\x{900}-\x{97f}]", "taml": r"[\x{b80}-\x{bff}]", "telu": r"[\x{c00}-\x{c7f}]", "beng": r"[\x{980}-\x{9ff}]"}
#: Languages of scripts, and romanised words that mark code-mixed Hindi.
SCRIPT_LANGUAGE = {"deva": "hi", "taml": "ta", "telu": "te", "beng": "bn"}
ROMANISED = ("hai", "nahi", "kya", "aur", "mein", "kar", "raha", "bahut", "accha")

#: Licence patterns and the allow-list.
LICENSES = {
    "apache-2.0": r"(?i)apache license,? version 2",
    "mit": r"(?i)\bmit license",
    "gpl-3.0": r"(?i)gnu general public license,? version 3",
    "cc-by-nc": r"(?i)cc by-nc",
}
ALLOWED = ("apache-2.0", "mit", "none")

#: Secrets that are scrubbed, and personal data.
SECRET = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\s*[:=]\s*["']?[A-Za-z0-9+/_.=-]{12,}|AKIA[A-Z0-9]{16}|[0-9a-f]{32,}"""
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b",
    "card": r"\b[0-9]{16}\b",
    "phone": r"\+[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|\b[6-9][0-9]{9}\b",
    "aadhaar": r"\b[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "pan": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
}
#: Marks of generated or vendored code.
GENERATED = r"(?i)auto-?generated|do not edit|generated by|node_modules/|vendor/|third_party/|\.min\.js"


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def language_scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per language the number of its frequent words, per script its letters; ``lang_pred`` and ``mix_share``, the part of the evidence for other languages.

    Nothing is dropped: romanised and code-mixed texts keep their share beside the label.
    """
    c = F.lower(F.coalesce(F.col(text), F.lit("")))
    known = lambda v: F.size(F.filter("words_", lambda w: w.isin(*v))).cast("long")
    n = {k: known(v) for k, v in STOP_WORDS.items()}
    scripts = {SCRIPT_LANGUAGE[k]: _count(F.coalesce(F.col(text), F.lit("")), v) for k, v in SCRIPTS.items()}
    docs = docs.withColumn("words_", F.regexp_extract_all(c, F.lit(T.GRAM_WORD), 0))
    out = docs.select("*", *(x.alias(f"n_{k}") for k, x in n.items()), *(x.alias(f"n_{k}") for k, x in scripts.items()), known(ROMANISED).alias("n_romanised")).drop("words_")
    names = sorted([*n, *scripts])
    top, total = F.greatest(*(F.col(f"n_{k}") for k in names)), sum(F.col(f"n_{k}") for k in names)
    pred = F.coalesce(*(F.when((F.col(f"n_{k}") == top) & (top > 0), F.lit(k)) for k in names), F.lit("und"))
    return out.withColumn("lang_pred", pred).withColumn("mix_share", F.coalesce(F.try_divide(total - top, total), F.lit(0.0)))


def normalised(docs: DataFrame, form: str = "NFC", keep: Column | None = None) -> DataFrame:
    """Texts in a normal form; rows where ``keep`` holds (code, mathematics) get NFC whatever the form."""
    c = udfs.normaliser(form)(F.col("text"))
    return docs.withColumn("text", c if keep is None else F.when(keep, udfs.nfc(F.col("text"))).otherwise(c))


def joiners(c: Column | str) -> Column:
    """Zero-width joiners and non-joiners, which normalisation must not change."""
    return _count(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"[\x{200c}\x{200d}]")


#: Groups that a join meets by broadcast: after the largest ones, no group has more than this part's inverse of all rows.
HOT_GROUPS = 1000


def once(df: DataFrame) -> DataFrame:
    """``df`` computed once for several uses: in the shared checkpoint folder if there is one, else cached."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Rows joined with their group.

    The largest groups, a fixed number of rows, are broadcast; the others are
    joined by a shuffle in which no key is hot any more.
    """
    hot = F.broadcast(groups.orderBy(F.desc(size), key).limit(HOT_GROUPS))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(groups, key))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``digest``, ``copies``, ``kept``: the smallest doc_id of each text stays.

    Only digests are shuffled, and groups are met by aggregation, so a hot text
    costs a row a task.
    """
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return with_groups(rows, groups, "digest", "copies").select("doc_id", "digest", "copies", (F.col("doc_id") == F.col("first_id")).alias("kept"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``pos``, ``paragraph`` of the non-blank lines."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "paragraph")).where(~T.is_blank("paragraph"))


def paragraph_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``pos``, ``paragraph``, ``copies``, ``kept``: the first copy over all documents stays."""
    rows = paragraphs(docs).withColumn("digest", F.sha2(F.col("paragraph").cast("binary"), 256))
    groups = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("copies"))
    kept = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))
    return with_groups(rows, groups, "digest", "copies").select("doc_id", "pos", "paragraph", "copies", kept.alias("kept"))


def without_repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of what paragraph deduplication leaves, in order."""
    kept = paragraph_duplicates(docs).where("kept").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "paragraph"))).alias("x"))
    return kept.select("doc_id", F.array_join(F.transform("x", lambda x: x["paragraph"]), "\n").alias("text"))


#: MinHash: shingle words, hashes, rows of a band, similarity; the prime of the hash family.
SHINGLE, HASHES, ROWS, SIMILARITY, PRIME = 5, 32, 2, 0.75, 2147483647
#: Members of a block of a band.
BLOCK = 256


def hash_family(n: int = HASHES) -> list[tuple[int, int]]:
    return [((7919 * (i + 1) * (i + 3)) % PRIME | 1, (104729 * (i + 2)) % PRIME) for i in range(n)]


def shingle_hashes(text: Column) -> Column:
    """Distinct 31-bit hashes of the word shingles."""
    grams = F.array_distinct(T.ngrams(T.gram_words(text), SHINGLE))
    return F.array_distinct(F.transform(grams, lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 8), 16, 10).cast("long") % PRIME))


#: Comments, string literals and numbers of code (those in names too), for copies that differ in these only.
COMMENT, STRING, NUMBER = r"(?s:/\*.*?\*/)|//[^\n]*|#[^\n]*", r""""[^"\n]*"|'[^'\n]*'""", r"[0-9][0-9A-Za-z_.]*"


def code_tokens(c: Column | str) -> Column:
    """Code without comments, with one mark for every string and one for every number."""
    t = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, COMMENT, " "), STRING, " str "), NUMBER, "0")


def code_clones(docs: DataFrame) -> DataFrame:
    """Near clones of code: ``a``, ``b``, ``jaccard`` of :func:`minhash_links` over normalised tokens."""
    return minhash_links(docs.withColumn("text", code_tokens("text")))


def paragraph_links(docs: DataFrame) -> DataFrame:
    """Near duplicates among paragraphs: ``a_doc``, ``a_pos``, ``b_doc``, ``b_pos``, ``jaccard``, the earlier place first."""
    links = minhash_links(paragraphs(docs).select(F.struct("doc_id", "pos").alias("doc_id"), F.col("paragraph").alias("text")))
    return links.select(F.col("a.doc_id").alias("a_doc"), F.col("a.pos").alias("a_pos"), F.col("b.doc_id").alias("b_doc"), F.col("b.pos").alias("b_pos"), "jaccard")


def minhash_links(docs: DataFrame) -> DataFrame:
    """``a``, ``b``, ``jaccard`` of verified near duplicates: all pairs ``a < b`` that share a band, among the first documents of equal texts.

    ``doc_id`` may be any type that orders.

    Equal texts collapse first.  A band's members are dealt to blocks and every two
    blocks meet in a group of their own, so no group has more than a few hundred
    rows; pairs whose sizes allow the similarity are verified once.  The links of a
    group of near copies are as many as its pairs.
    """
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"), "text").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    rows = rows.select("doc_id", shingle_hashes(F.col("text")).alias("h"))
    rows = once(rows.where(F.size("h") > 0))
    # One minimum a hash over exploded shingles: compiled code, and the shuffle carries minima only.
    mins = [F.min((F.col("x") * F.lit(a) + F.lit(b)) % F.lit(PRIME)).alias(f"m{i}") for i, (a, b) in enumerate(hash_family())]
    signed = rows.select("doc_id", F.explode("h").alias("x")).groupBy("doc_id").agg(*mins)
    values = F.array(*(F.concat_ws("_", *(f"m{i}" for i in range(k, k + ROWS))) for k in range(0, HASHES, ROWS)))
    sizes = rows.select("doc_id", F.size("h").alias("size"))
    bands = signed.join(sizes, "doc_id").select("doc_id", "size", F.posexplode(values).alias("band", "value")).select("doc_id", "size", F.concat_ws(":", "band", "value").alias("bucket"))
    bands = once(bands)
    groups = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK)
    members = with_groups(bands, groups, "bucket", "n").withColumn("mine", F.pmod(F.xxhash64("doc_id"), blocks))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = once(members.select("doc_id", "size", "bucket", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi")))
    x = met.select("bucket", "lo", "hi", F.col("mine").alias("i"), F.col("doc_id").alias("a"), F.col("size").alias("p"))
    y = met.select("bucket", "lo", "hi", F.col("mine").alias("j"), F.col("doc_id").alias("b"), F.col("size").alias("q"))
    # Sizes bound the similarity from above, so a pair that they rule out is no link.
    near = F.least("p", "q") >= F.lit(SIMILARITY) * F.greatest("p", "q")
    pairs = x.join(y, ["bucket", "lo", "hi"]).where((F.col("a") < F.col("b")) & ((F.col("lo") == F.col("hi")) | (F.col("i") != F.col("j"))) & near)
    pairs = pairs.select("a", "b").distinct()
    sets = rows.select("doc_id", "h")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("h").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    return both.select("a", "b", (common / (F.size("ha") + F.size("hb") - common)).alias("jaccard")).where(F.col("jaccard") >= SIMILARITY)


#: Hashes of benchmark grams up to which they are broadcast (8 bytes each).
SMALL_GRAMS = 1_000_000


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """``doc_id`` and ``items`` (benchmark items that share an n-gram of words) of contaminated documents.

    Documents' grams are met by their hashes first, against the benchmark's hashes
    (broadcast while they are few, else by a join that carries hashes); only grams
    that pass are compared as strings.
    """
    grams = lambda df, key: df.select(key, F.explode(F.array_distinct(T.ngrams(T.gram_words("text"), n))).alias("g"))
    items = once(grams(benchmark, "item_id").withColumn("gh", F.xxhash64("g")))
    hashes = items.select(F.col("gh").alias("h")).distinct()
    hashes = F.broadcast(hashes) if items.count() <= SMALL_GRAMS else hashes
    near = grams(docs, "doc_id").withColumn("h", F.xxhash64("g")).join(hashes, "h", "left_semi")
    return near.select("doc_id", "g").join(items.select("g", "item_id"), "g").groupBy("doc_id").agg(F.countDistinct("item_id").alias("items"))


def quality_features(docs: DataFrame) -> DataFrame:
    """Word count, mean word length, share of letters, of upper case and of repeated lines."""
    t = F.coalesce(F.col("text"), F.lit(""))
    n, rows = F.length(t), F.split(t, "\n", -1)
    return docs.select(
        "doc_id",
        "lang",
        T.word_count(t).alias("words"),
        F.coalesce(F.try_divide(F.length(T.visible(t)), T.word_count(t)), F.lit(0.0)).alias("word_length"),
        F.coalesce(F.try_divide(_count(t, r"\p{L}"), n), F.lit(0.0)).alias("letters"),
        F.coalesce(F.try_divide(_count(t, r"\p{Lu}"), n), F.lit(0.0)).alias("upper"),
        (1 - F.size(F.array_distinct(rows)) / F.size(rows)).alias("repeated_lines"),
    )


def quality_filter(docs: DataFrame, low: float = 0.05) -> DataFrame:
    """``doc_id``, ``lang``, ``letters``, ``least``, ``kept``: each language's own threshold, its exact ``low`` quantile of the share of letters.

    Counts of 10,001 bins find the bin that holds the quantile; only that bin's shares
    are ordered, so no language's documents meet in one task.
    """
    f = quality_features(docs).withColumn("bin", F.floor(F.col("letters") * 10000))
    w = Window.partitionBy("l").orderBy("bin")
    counts = f.groupBy(F.col("lang").alias("l"), "bin").agg(F.count("*").alias("n"))
    counts = counts.select("l", "bin", "n", F.sum("n").over(w).alias("up_to"), F.sum("n").over(Window.partitionBy("l")).alias("all"))
    held = counts.where(F.col("up_to") >= F.col("all") * low).groupBy("l").agg(F.min(F.struct("bin", (F.col("up_to") - F.col("n")).alias("before"), "all")).alias("x"))
    held = held.select("l", F.col("x.bin").alias("b"), "x.before", "x.all")
    near = f.join(F.broadcast(held), F.col("lang").eqNullSafe(F.col("l")) & (F.col("bin") == F.col("b"))).groupBy("l", "before", "all", "letters").agg(F.count("*").alias("n"))
    near = near.withColumn("up_to", F.col("before") + F.sum("n").over(Window.partitionBy("l").orderBy("letters")))
    least = near.where(F.col("up_to") >= F.col("all") * low).groupBy("l").agg(F.min("letters").alias("least"))
    joined = f.join(F.broadcast(least), F.col("lang").eqNullSafe(F.col("l")))
    return joined.select("doc_id", "lang", "letters", "least", ((F.col("letters") >= F.col("least")) & (F.col("repeated_lines") < 0.5) & (F.col("upper") < 0.5)).alias("kept"))


def license_of(c: Column | str) -> Column:
    t = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.coalesce(*(F.when(t.rlike(p), F.lit(k)) for k, p in LICENSES.items()), F.lit("none"))


def scrubbed(docs: DataFrame, mark: str = "<SECRET>", keep: list[str] = ()) -> DataFrame:
    """``doc_id``, ``text`` without secrets, ``redactions``, and the columns ``keep``."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", *keep, F.regexp_replace(t, SECRET, mark).alias("text"), _count(t, SECRET).alias("redactions"))


def is_generated(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).rlike(GENERATED)


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of each kind; cards count if the Luhn checksum holds, Aadhaar numbers are candidates (see :func:`aadhaar_numbers`)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    kinds = [_count(t, p).alias(k) for k, p in PII.items() if k != "card"]
    cards = F.filter(F.regexp_extract_all(t, F.lit(PII["card"]), 0), lambda x: F.call_function("luhn_check", x))
    return docs.select("doc_id", *kinds, F.size(cards).cast("long").alias("card"))


def aadhaar_numbers(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``number`` of the candidates whose Verhoeff checksum holds."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PII["aadhaar"]), 0)).alias("number"))
    return found.withColumn("number", F.regexp_replace("number", "[ -]", "")).where(udfs.verhoeff_ok(F.col("number")))


def toxicity_thresholds(docs: DataFrame, lexicon: list[str], thresholds: dict[str, float], default: float = 5.0) -> DataFrame:
    """``doc_id``, ``lang``, ``hits``, ``per_mille``, ``flagged``: lexicon words per thousand against the language's own threshold."""
    t = F.lower(F.coalesce(F.col("text"), F.lit("")))
    hits, words = F.size(F.filter(F.regexp_extract_all(t, F.lit(T.GRAM_WORD), 0), lambda w: w.isin(list(lexicon)))).cast("long"), T.word_count(t)
    limit = F.coalesce(*(F.when(F.col("lang") == k, F.lit(v)) for k, v in thresholds.items()), F.lit(default))
    rate = F.coalesce(F.try_divide(hits * 1000, words), F.lit(0.0))
    return docs.select("doc_id", "lang", hits.alias("hits"), rate.alias("per_mille"), (rate > limit).alias("flagged"))


def audit_sample(rows: DataFrame, strata: str, n: int, seed: str = "audit") -> DataFrame:
    """``n`` rows of each stratum by a fixed hash, for people to look at."""
    h = T.hash60(F.concat(F.lit(seed), F.col("doc_id").cast("string")))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(strata).orderBy(h, "doc_id"))).where(F.col("r") <= n).drop("r")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with their quality and toxicity labels where there are any."""
    return docs.join(labels.select(F.col("doc_id").alias("l_id"), "quality", "toxic"), F.col("doc_id") == F.col("l_id"), "left").drop("l_id")


def without_generated(docs: DataFrame) -> DataFrame:
    """Documents without marks of generated or vendored code."""
    return docs.where(~is_generated("text"))


def masked(docs: DataFrame, mark: str = "<PII>") -> DataFrame:
    """Texts with mail addresses, network addresses and telephone numbers marked out."""
    t = F.coalesce(F.col("text"), F.lit(""))
    for kind in ("email", "ipv4", "phone"):
        t = F.regexp_replace(t, PII[kind], mark)
    return docs.withColumn("text", t)


def stages(docs: DataFrame, benchmark: DataFrame, lexicon: list[str], thresholds: dict[str, float]):
    """Name and documents of each cleaning step, in order, each over what the one before it kept.

    Near duplicates go if a document with a smaller id is linked with them.  Every
    step's rows are kept once, since several steps read their input more than once.
    """
    now = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    yield "input", now
    now = once(normalised(language_scores(now).where("lang_pred <> 'und'").select("doc_id", "lang", "text")))
    yield "identified", now
    now = once(now.join(exact_duplicates(now).where("kept").select("doc_id"), "doc_id", "left_semi"))
    yield "deduplicated", now
    now = once(now.join(minhash_links(now).select(F.col("b").alias("doc_id")), "doc_id", "left_anti"))
    yield "near_deduplicated", now
    now = once(now.join(quality_filter(now).where("kept").select("doc_id"), "doc_id", "left_semi"))
    yield "quality", now
    now = now.where(license_of("text").isin(*ALLOWED))
    yield "licensed", now
    now = without_generated(now)
    yield "written", now
    now = masked(scrubbed(now, keep=["lang"]))
    yield "scrubbed", now
    now = once(now.join(toxicity_thresholds(now, lexicon, thresholds).where("not flagged").select("doc_id"), "doc_id", "left_semi"))
    yield "civil", now
    yield "decontaminated", now.join(contaminated(now, benchmark).select("doc_id"), "doc_id", "left_anti")


def funnel(docs: DataFrame, benchmark: DataFrame, lexicon: list[str] = (), thresholds: dict[str, float] | None = None) -> DataFrame:
    """Documents left after each cleaning step, in order: ``step``, ``stage``, ``documents``."""
    out = None
    for i, (k, df) in enumerate(stages(docs, benchmark, list(lexicon), thresholds or {})):
        p = df.agg(F.count("*").alias("documents")).select(F.lit(i).alias("step"), F.lit(k).alias("stage"), "documents")
        out = p if out is None else out.unionByName(p)
    return out
