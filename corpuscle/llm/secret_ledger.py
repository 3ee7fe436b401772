"""Secret scans over an incremental blob ledger (operator 4), DataFrame operations only.

Every version of every path is content-addressed by the SHA-256 of its text.  A
ledger keeps, for every blob, the pairs (rule, rule version) that were scanned and
what they found; a run scans the other pairs only, each distinct blob once, and the
findings are joined back to all paths that hold the blob.  A new rule version, or a
new blob, therefore costs exactly its own scan.  A run's pairs and findings are one
append, so a run that is cut short is repeated, never skipped.

Positions come from the text between the matches: ``split`` gives the pieces
around them, and running sums of lengths give starts and ends, in code points and in
bytes.

Skew: copies collapse before the exchange by blob (map-side), so a hot blob is one
row there.  Where findings go back to paths, or to whole texts, the blobs with more
than a ``HOT_BLOBS``-th part of all rows (so fewer than that many of them) are dealt
out by a salt, and their one row of findings is repeated for each salt.

Results for odd input: a null text counts as empty; a null path is kept; a text
without findings yields zero counts and the hash of the empty string; repeated
rows each get their result; matches at equal starts are ordered by rule; very long
texts are taken whole, in time linear in their length; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, packed, shared_folder, table, unpacked


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has ``least`` characters or more.

    ``hint`` is a cheap test that is true wherever the pattern matches: a plain
    substring, or a pattern if it starts with ``~``.
    """

    kind: str
    pattern: str
    group: int
    least: int
    hint: str
    version: int = 1


#: The three base rules, in the order in which ties are listed.
BASE = (
    Rule("assign", r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, r"~(?i)password|passwd|secret|token|api_?key"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    Rule("hex", r"[0-9a-f]+", 0, 16, r"~[0-9a-f]{16}"),
)
#: Rules beyond the base ones.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20, "PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, "~gh[pousr]_"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, "eyJ"),
)
RULES = BASE + MORE

#: A blob is hot when it holds more than this part of all rows; rows of a salt of a hot blob, at least.
HOT_BLOBS, SALT = 1000, 64

_SPAN = "array<struct<n:int,gap:int,len:int,value:int,bgap:int,blen:int>>"
_FOUND = "array<struct<kind:string,version:int,start:bigint,stop:bigint,bstart:bigint,bstop:bigint>>"
_SCANS = f"blob string, done array<struct<kind:string,version:int>>, found {_FOUND}"


def _hit(text: Column, rule: Rule) -> Column:
    return text.rlike(rule.hint[1:]) if rule.hint.startswith("~") else F.contains(text, F.lit(rule.hint))


def _matches(text: Column, rule: Rule, number: int, wanted: Column) -> Column:
    """All matches of a rule, left to right: the lengths of the gap before each, of it and of its value, in code points and in bytes."""
    found = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(rule.pattern), 0).alias("m"))
    found = F.filter(found, lambda x: x["m"].isNotNull())
    value = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m)
    rows = F.transform(found, lambda x: F.struct(F.lit(number).alias("n"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("len"), value(x["m"]).alias("value"), F.octet_length(x["gap"]).alias("bgap"), F.octet_length(x["m"]).alias("blen")))
    return F.coalesce(F.when(wanted & _hit(text, rule), rows), F.array()).cast(_SPAN)


def _names(rules) -> Column:
    return F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))


def address(versions: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path`` and ``blob``: the SHA-256 of each version's text."""
    return versions.select(F.col(path).alias("path"), F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256).alias("blob"))


def unseen(versions: DataFrame, rules, scans: DataFrame | None = None, content: str = "content") -> DataFrame:
    """``blob``, ``content`` and ``todo`` (kinds and versions) of every blob with a pair that the scans lack."""
    text = F.coalesce(F.col(content), F.lit(""))
    blobs = versions.select(F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("content"))
    blobs = blobs.dropDuplicates(["blob"]).withColumn("every", _names(rules))
    if scans is None:
        return blobs.withColumnRenamed("every", "todo")
    done = scans.select(F.col("blob").alias("b"), F.explode("done").alias("x")).groupBy("b").agg(F.collect_set("x").alias("done"))
    # Both sides are exchanged by blob already, so no content travels again.
    new = blobs.join(done, F.col("blob") == F.col("b"), "left")
    return new.select("blob", "content", F.when(F.col("done").isNull(), F.col("every")).otherwise(F.array_except("every", "done")).alias("todo")).where(F.size("todo") > 0)


def scan(blobs: DataFrame, rules) -> DataFrame:
    """``blob``, ``done`` (the pairs scanned now) and ``found`` of the blobs' pairs to do."""
    text = F.col("content")
    wanted = lambda r: F.exists("todo", lambda x: (x["kind"] == r.kind) & (x["version"] == r.version))
    found = F.concat(*(_matches(text, r, i, wanted(r)) for i, r in enumerate(rules)))
    rows = blobs.select("blob", "todo", F.posexplode_outer(found).alias("at", "x")).select("blob", "todo", "at", "x.*")
    so_far = Window.partitionBy("blob", "n").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda gap, size: F.sum(F.col(gap).cast("long") + F.col(size)).over(so_far)
    rows = rows.select("blob", "todo", "n", "value", "len", "blen", run("gap", "len").alias("stop"), run("bgap", "blen").alias("bstop"))
    pick = lambda f: F.element_at(F.array(*(F.lit(f(r)) for r in rules)), F.col("n") + 1)
    span = F.struct(pick(lambda r: r.kind).alias("kind"), pick(lambda r: r.version).alias("version"), (F.col("stop") - F.col("len")).alias("start"), "stop", (F.col("bstop") - F.col("blen")).alias("bstart"), "bstop")
    kept = F.collect_list(F.when(F.col("value") >= pick(lambda r: r.least), span))
    return rows.groupBy("blob").agg(F.first("todo").alias("done"), kept.alias("found")).select("blob", "done", F.col("found").cast(_FOUND).alias("found"))


class Ledger:
    """A ledger kept as one Parquet table under ``folder``: a row a scan of a blob, with the pairs scanned and their findings."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def scans(self) -> DataFrame:
        try:
            return self.spark.read.schema(_SCANS).parquet(f"{self.folder}/scans")
        except AnalysisException:  # nothing was scanned yet
            return self.spark.createDataFrame([], _SCANS)

    def pairs(self) -> DataFrame:
        """``blob``, ``kind`` and ``version`` of every pair scanned."""
        return self.scans().select("blob", F.explode("done").alias("x")).select("blob", "x.*")

    def findings(self) -> DataFrame:
        """``blob``, ``kind``, ``version``, ``start``, ``stop``, ``bstart`` and ``bstop`` of every finding, once."""
        return self.scans().select("blob", F.explode("found").alias("x")).select("blob", "x.*").distinct()

    def update(self, versions: DataFrame, rules=None, content: str = "content") -> None:
        """Scan what is new, and append it."""
        rules = RULES if rules is None else rules
        scan(unseen(versions, rules, self.scans(), content), rules).write.mode("append").parquet(f"{self.folder}/scans")

    def by_blob(self, rules=None) -> DataFrame:
        """One row a blob with findings under ``rules``; see :func:`by_blob`."""
        return by_blob(self.findings(), RULES if rules is None else rules)

    def of(self, versions: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
        """Findings of all paths."""
        paths = cut(address(versions, path, content))
        found = self.findings().groupBy("blob").agg(F.collect_list(F.struct("kind", "version", "start", "stop")).alias("x"))
        return with_findings(paths, found, "inner").select("path", "blob", F.explode("x").alias("x")).select("path", "blob", "x.*")


def with_findings(rows: DataFrame, found: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` (with ``blob``) joined with ``found`` (a row a blob), hot blobs dealt out by a salt."""
    total = rows.count()
    sizes = rows.groupBy(F.col("blob").alias("hot_blob")).agg(F.count("*").alias("n")).where(F.col("n") > max(SALT, total // HOT_BLOBS))
    # Fewer than HOT_BLOBS rows, since each stands for more than that part of all.
    hot = F.broadcast(cut(sizes.select("hot_blob", F.ceil(F.col("n") / max(SALT, total // HOT_BLOBS)).cast("int").alias("salts"))))
    salted = rows.join(hot, F.col("blob") == F.col("hot_blob"), "left")
    salted = salted.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("salts")).cast("int"), F.lit(0))).drop("hot_blob", "salts")
    found = found.withColumnRenamed("blob", "found_blob").join(hot, F.col("found_blob") == F.col("hot_blob"), "left")
    found = found.withColumn("found_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("hot_blob", "salts")
    return salted.join(found, (F.col("blob") == F.col("found_blob")) & (F.col("salt") == F.col("found_salt")), how).drop("found_blob", "found_salt", "salt")


def _joined(rows: Column) -> Column:
    """``kind:start:end`` of sorted rows, joined by commas."""
    return F.concat_ws(",", F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))))


def by_blob(findings: DataFrame, rules) -> DataFrame:
    """One row a blob with findings of ``rules``: counts of the base kinds, the hash of the base spans, all spans, and the byte places to mark (overlapping ones as one)."""
    base = [r.kind for r in BASE]
    order = F.coalesce(*(F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.lit(i)) for i, r in enumerate(rules)))
    rows = findings.withColumn("rule", order).where("rule is not null")
    w = Window.partitionBy("blob").orderBy("bstart", "rule")
    before = F.max("bstop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", (F.coalesce(before, F.lit(-1)) <= F.col("bstart")).cast("long"))
    rows = rows.withColumn("place", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    places = rows.groupBy("blob", "place").agg(F.min("bstart").alias("bstart"), F.max("bstop").alias("bstop"), F.collect_list(F.struct("start", "rule", "kind", "stop")).alias("part"))
    got = places.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("part"))).alias("rows"), F.array_sort(F.collect_list(F.struct("bstart", "bstop"))).alias("places"))
    n = lambda k: F.size(F.filter("rows", lambda x: x["kind"] == k)).cast("long")
    return got.select("blob", *(n(k).alias(f"n_{k}") for k in base), F.sha2(_joined(F.filter("rows", lambda x: x["kind"].isin(*base))).cast("binary"), 256).alias("base_sha256"), _joined(F.col("rows")).alias("spans"), "places")


def _throwaway(spark: SparkSession) -> Ledger:
    return Ledger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")


def scan_documents(docs: DataFrame, rules=None, ledger: Ledger | None = None) -> DataFrame:
    """Findings of every document; with a ledger, only pairs that it lacks are scanned, and it keeps them."""
    rules = RULES if rules is None else rules
    ledger = ledger or _throwaway(docs.sparkSession)
    versions = docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    ledger.update(versions, rules)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    out = with_findings(cut(address(versions)), ledger.by_blob(rules))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(F.col("path").alias("doc_id"), zero("n_assign"), zero("n_access"), zero("n_hex"), F.coalesce("base_sha256", nothing).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), "blob")


def redact(text: Column, places: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every place (struct of first and end byte, ascending, apart) replaced by a mark."""
    data = text.cast("binary")
    n = F.size(places)

    def piece(i: Column) -> Column:
        lo = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(places, i - 1)["bstop"])
        hi = F.when(i == n, F.octet_length(data).cast("long")).otherwise(F.get(places, i)["bstart"])
        return F.substring(data, (lo + 1).cast("int"), (hi - lo).cast("int")).cast("string")

    return F.array_join(F.transform(F.sequence(F.lit(0), n), piece), mark)


def redact_documents(docs: DataFrame, rules=None, ledger: Ledger | None = None) -> DataFrame:
    """The documents with their secrets marked out, with their columns; ``n_chars`` follows the text."""
    rules = RULES if rules is None else rules
    ledger = ledger or _throwaway(docs.sparkSession)
    versions = docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    ledger.update(versions, rules)
    here = packed(docs).withColumn("blob", F.sha2(F.coalesce("row.text", F.lit("")).cast("binary"), 256))
    found = ledger.by_blob(rules).select("blob", "places")
    out = with_findings(here, found).withColumn("redacted", F.when(F.col("places").isNull(), F.col("row.text")).otherwise(redact(F.col("row.text"), F.col("places"))))
    return unpacked(out, docs.columns, text=F.col("redacted"), n_chars=F.length("redacted").cast("long"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come to the ledger in two increments; the second scans what the first has not seen."""
    docs = table(spark, sf_dir, "documents")
    ledger = _throwaway(spark)
    ledger.update(docs.where(F.xxhash64("doc_id") < 0).select(F.col("doc_id").alias("path"), F.col("text").alias("content")))
    return scan_documents(docs, ledger=ledger).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def _oracle() -> str:
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("((?i)password|passwd|secret|token|api_?key)(?-i)", "((?i:password|passwd|secret|token|api_?key))").replace("'", "''")
        hint = f"regexp_matches(t, '{r.hint[1:]}')" if r.hint.startswith("~") else f"contains(t, '{r.hint}')"
        parts.append(f"select doc_id, {i} r, '{r.kind}' kind, {r.least} least, regexp_extract_all(t, '{p}', 0) m, regexp_extract_all(t, '{p}', {r.group}) v, regexp_split_to_array(t, '{p}') g from d where {hint}")
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
hits as ({' union all '.join(parts)}),
x as (select doc_id, r, kind, least, m, v, g, unnest(range(1, len(m) + 1)) i from hits),
y as (select doc_id, r, kind, length(v[i]) >= least ok, length(m[i]) n, sum(length(g[i]) + length(m[i])) over (partition by doc_id, r order by i) stop from x),
z as (select doc_id, r, kind, (stop - n)::bigint a, stop::bigint b from y where ok),
s as (select doc_id, count(*) filter (r = 0) n_assign, count(*) filter (r = 1) n_access, count(*) filter (r = 2) n_hex,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by a, r) filter (r < 3), '') base, string_agg(kind || ':' || a || ':' || b, ',' order by a, r) spans from z group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join s on d.doc_id = s.doc_id"""


ORACLE_SQL = _oracle()
