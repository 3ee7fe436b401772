"""Toxicity by weak supervision (operator 5).

1. *Voters.*  From the labelled sample, words and word beginnings that stand far
   more often in toxic texts become lexicon voters; fixed patterns (shouting,
   runs of marks, masked words) are further voters, and "no voter spoke" votes
   for clean.  A voter fires or abstains.
2. *Generative label model.*  Expectation-maximisation estimates how often each
   voter fires in toxic and in clean texts, and the class balance, over texts with and
   without a given label.  The given labels are one more voter, whose rates are
   estimated too.  Voters that fire together more than their rates explain
   (beginnings of one another, say) are correlated; each counts with the inverse of
   its correlations' sum, so that a crowd of copies has one voice.
3. *Linear classifier.*  A logistic regression on the voters' firings, their
   density and text statistics is trained on the label model's posteriors of all
   these texts, mostly unlabelled ones where labels are few; it scores every whole text.

The sample: ``SAMPLE`` labelled and ``UNLABELLED`` other texts at most, the first by a hash
of the id, one text an id, none of the held-out fold.  It is read once and kept;
everything that comes to the driver is bounded by it.  There a firing is a byte, and
``ROWS`` texts at a time become floats.  Scoring is one pass without a shuffle.

Labels, lang, source and doc_id are no inputs of a score.

Results for odd input: a null text counts as empty, and empty texts get a score
too; labels that are null or neither 0 nor 1 are not learned from; without labels
of both kinds the score is the share of toxic labels (0 without any); repeated
rows get equal scores, and of rows that repeat an id one is learned from; very long
texts are taken whole; rows without a doc_id are scored and not learned from; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import crc_mod, cut, table
from ._text import ALNUM, LOWER, Chunk, chunks, mix, prefix_hash, span_hash, words

#: Labelled and unlabelled texts that the model is fitted on, at most.
SAMPLE, UNLABELLED = 20_000, 10_000
#: Lexicon voters, at most.
VOTERS = 384
#: Lengths in bytes of the word beginnings that may become voters.
STARTS = (4, 5, 6)
#: Share of toxic texts, among those where it fires, that a lexicon voter has at least.
PRECISION = 0.75
#: Log-likelihood ratio, against the share of toxic texts, that a lexicon voter has at least: rarer words are chance.
EVIDENCE = 11.0
#: Trust in a given label to start from, and how many texts that belief is worth.
TRUST, BELIEF = 0.97, 20
#: What a text without a label counts for, beside one with a label.
OTHERS = 0.25
#: What it counts that some voter spoke, beside what that voter says: the choice of voters makes them look purer than they are.
SILENCE = 0.5
#: Texts whose firings are floats at once while the model is fitted.
ROWS = 1024

_U = np.uint64
PATTERNS = ("shouting", "marks", "masked", "short")


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and word beginnings with their documents (repeats included), and text statistics a document."""
    data = LOWER[chunk.data]
    n = len(chunk)
    s, e, doc = words(data, chunk.offsets, ALNUM)
    p = prefix_hash(data)
    out, owner = [span_hash(p, s, e)], [doc]
    for k in STARTS:
        ok = e - s >= k
        out.append(mix(span_hash(p, s[ok], s[ok] + k) + _U(k)))
        owner.append(doc[ok])
    size = np.maximum(1, np.diff(chunk.offsets)).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[chunk.offsets[1:]] - total[chunk.offsets[:-1]]) / size

    raw = chunk.data
    star = raw == 0x2A
    masked = np.zeros(len(raw), bool)
    if len(raw) > 2:
        masked[1:-1] = star[1:-1] & ALNUM[data[:-2]] & (star[2:] | ALNUM[data[2:]])
    stats = np.stack((share((raw >= 65) & (raw <= 90)) > 0.3, share((raw == 0x21) | (raw == 0x3F)) > 0.04, share(masked) > 0, np.bincount(doc, minlength=n) < 8), axis=1).astype(float)
    return np.concatenate(out), np.concatenate(owner), stats


def training_sample(docs: DataFrame, labels: DataFrame, n: int = SAMPLE, more: int = UNLABELLED) -> DataFrame:
    """``doc_id``, ``text`` and ``toxic`` (-1 without a label) of the texts to learn from, outside the held-out fold, kept."""
    open_fold = F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0)
    first = lambda df, k: df.orderBy(F.xxhash64(F.lit(23), F.col("doc_id")), "doc_id").limit(k)
    given = labels.where(F.col("toxic").isin(0, 1) & open_fold).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # The first ids of the table, as many as suffice beside all labelled ones that may be among them.
    others = first(docs.where(open_fold).select("doc_id").distinct(), n + more)
    others = first(others.join(given, "doc_id", "left_anti"), more).withColumn("toxic", F.lit(-1))
    chosen = cut(first(given, n).unionByName(others)).withColumnRenamed("doc_id", "id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    return cut(rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"), F.first("toxic").alias("toxic")).select("doc_id", "x.text", "toxic"))


def _with_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, np.ndarray]]:
    for batch in batches:
        toxic, at = batch.column(2).to_numpy(), 0
        for c in chunks([batch]):
            yield c, toxic[at : at + len(c)]
            at += len(c)


def _lexicon(sample: DataFrame) -> tuple[np.ndarray, int, int]:
    """Hashes of the lexicon voters, and the numbers of toxic and clean texts."""

    def count(batches):
        for c, toxic in _with_toxic(batches):
            h, doc, _ = features(c)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            keep = np.ones(len(h), bool)
            keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, y = h[keep], toxic[doc[keep]]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
            pos = np.add.reduceat(y, first) if len(first) else np.zeros(0)
            n = np.diff(np.concatenate((first, [len(h)])))
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(pos.astype(np.int64)), pa.array((n - pos).astype(np.int64))], ["h", "pos", "neg"])

    pos, neg = sample.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not pos or not neg:
        return np.zeros(0, np.uint64), pos, neg
    counted = sample.where("toxic >= 0").mapInArrow(count, "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rate = F.col("pos") / F.lit(float(pos)) - F.col("neg") / F.lit(float(neg))
    base, part = pos / (pos + neg), F.col("pos") / (F.col("pos") + F.col("neg"))
    evidence = F.col("pos") * F.log(part / base) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - part) / (1 - base))).otherwise(0.0)
    chosen = counted.where((part >= PRECISION) & (evidence >= EVIDENCE)).orderBy(rate.desc(), "h").limit(VOTERS)
    return np.sort(np.array([r["h"] for r in chosen.collect()], np.int64).view(np.uint64)), pos, neg


def _fired(chunk: Chunk, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0/1 firings of all voters for each text, and the classifier's further inputs."""
    h, doc, stats = features(chunk)
    votes = np.zeros((len(chunk), len(lexicon)), bool)
    hits = np.zeros(len(chunk))
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
        ok = np.flatnonzero(lexicon[at] == h)
        votes[doc[ok], at[ok]] = True
        hits = np.bincount(doc[ok], minlength=len(chunk)).astype(float)
    silent = ~votes.any(1)
    fired = np.hstack((votes, stats > 0, silent[:, None]))
    more = np.stack((np.log1p(hits), np.log1p(votes.sum(1))), axis=1)
    return fired, more


def _blocks(n: int) -> list[slice]:
    return [slice(at, min(n, at + ROWS)) for at in range(0, n, ROWS)]


def _each(n: int, of: Callable[[slice], np.ndarray]) -> np.ndarray:
    """One number a row, computed by blocks."""
    out = np.empty(n)
    for b in _blocks(n):
        out[b] = of(b)
    return out


def _correlation(fired: np.ndarray, weight: np.ndarray, expected: Callable[[slice], np.ndarray]) -> np.ndarray:
    """Of the voters, by what their firings differ from what is expected of them; rows count for their weight."""
    c = np.zeros((fired.shape[1],) * 2)
    for b in _blocks(len(fired)):
        r = fired[b] - expected(b)
        c += r.T @ (weight[b][:, None] * r)
    d = np.sqrt(np.maximum(np.diag(c), 1e-9))
    return c / d[:, None] / d[None, :]


def _total(fired: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How much weight each voter's firings have."""
    return sum((weight[b] @ fired[b].astype(float) for b in _blocks(len(fired))), np.zeros(fired.shape[1]))


class LabelModel:
    """Class-conditional firing rates of correlated voters, by expectation-maximisation."""

    def fit(self, fired: np.ndarray, given: np.ndarray, silent: int | None = None, rounds: int = 25) -> np.ndarray:
        """Posterior probability of toxic for each row; ``given`` is 0, 1 or -1 where unknown.

        Voter ``silent`` speaks when no other does; when others speak, it counts for
        ``SILENCE`` of what it would.
        """
        n = len(fired)
        self.silence = np.ones(fired.shape[1])
        if silent is not None:
            self.silence[silent] = SILENCE
        # Rows without a label start from how many voices speak, a crowd of copies as one.
        mean = _total(fired, np.ones(n)) / max(1, n)
        alike = _correlation(fired, np.ones(n), lambda b: mean)
        voice = 1 / np.maximum(1, np.where(alike > 0.5, alike, 0).sum(1))
        voices = _each(n, lambda b: fired[b] @ voice)
        y = np.where(given < 0, 0.2 * voices / (voices + 1), np.where(given == 1, TRUST, 1 - TRUST))
        known, said = given >= 0, (given == 1).astype(float)
        # The labelled texts give the first rates; then the others count for a part each.
        part = np.where(known, 1.0, OTHERS) if known.any() else np.ones(n)
        for k in range(rounds):
            u = known.astype(float) if known.any() and k < 2 else part
            w1, w0 = (u * y).sum() + 2, (u * (1 - y)).sum() + 2
            self.balance = w1 / (w1 + w0)
            self.toxic, self.clean = (_total(fired, u * y) + 0.05) / w1, (_total(fired, u * (1 - y)) + 0.05) / w0
            # How often a label says toxic in toxic and in clean texts.
            self.said = tuple((BELIEF * t + (said * p)[known].sum()) / (BELIEF + p[known].sum()) for t, p in ((TRUST, y), (1 - TRUST, 1 - y)))
            # Correlation within the classes: what is left of joint firings beyond both rates.
            self.correlation = _correlation(fired, u, lambda b, y=y: np.outer(y[b], self.toxic) + np.outer(1 - y[b], self.clean))
            self.weight = 1 / np.maximum(1, np.where(self.correlation > 0.1, self.correlation, 0).sum(1))
            new = self.posterior(fired, given)
            done = k > 2 and np.abs(new - y).max() < 1e-4
            y = new
            if done:
                break
        return y

    def posterior(self, fired: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Probability of toxic under the rates, each voter to the power of its weight, the given label as it is."""
        spoke = self.weight * (np.log(self.toxic) - np.log(self.clean))
        kept = self.silence * self.weight * (np.log1p(-np.minimum(self.toxic, 0.999)) - np.log1p(-np.minimum(self.clean, 0.999)))
        logit = np.log(self.balance / (1 - self.balance)) + _each(len(fired), lambda b: fired[b] @ spoke + (1.0 - fired[b]) @ kept)
        t, c = np.clip(self.said, 1e-3, 1 - 1e-3)
        logit += np.where(given < 0, 0.0, np.where(given == 1, np.log(t / c), np.log((1 - t) / (1 - c))))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _inputs(fired: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The classifier's inputs, the first one constant."""
    return np.hstack((np.ones((len(fired), 1)), fired, more))


def _regress(fired: np.ndarray, more: np.ndarray, y: np.ndarray, rounds: int = 25, l2: float = 0.3) -> np.ndarray:
    """Weights of a logistic regression on soft labels."""
    w = np.zeros(1 + fired.shape[1] + more.shape[1])
    ridge = np.full(len(w), l2)
    ridge[0] = 1e-6
    for _ in range(rounds):
        bend, slope = np.diag(ridge + 1e-9), -ridge * w
        for b in _blocks(len(y)):
            x = _inputs(fired[b], more[b])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            bend += (x * (p * (1 - p))[:, None]).T @ x
            slope += x.T @ (y[b] - p)
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """A fitted scorer: lexicon, label model and weights."""

    def __init__(self, sample: DataFrame):
        self.lexicon, pos, neg = _lexicon(sample)
        self.weights, self.base = None, pos / (pos + neg) if pos + neg else 0.0
        if not pos or not neg:
            return
        lexicon = self.lexicon

        def votes(batches):
            for c, toxic in _with_toxic(batches):
                fired, more = _fired(c, lexicon)
                yield pa.RecordBatch.from_arrays([c.ids, pa.array(toxic.astype(np.int32)), pa.array([row.tobytes() for row in np.packbits(fired, axis=1)], pa.binary()), pa.array(list(more), pa.list_(pa.float64()))], ["doc_id", "toxic", "fired", "more"])

        got = sample.mapInArrow(votes, "doc_id long, toxic int, fired binary, more array<double>").orderBy("doc_id").toArrow()
        n = len(lexicon) + len(PATTERNS) + 1
        fired = np.unpackbits(np.frombuffer(b"".join(got["fired"].to_pylist()), np.uint8).reshape(len(got), -1), axis=1)[:, :n]
        given = got["toxic"].to_numpy()
        self.labels = LabelModel()
        y = self.labels.fit(fired, given, n - 1)
        self.weights = _regress(fired, np.array(got["more"].to_pylist(), float), y)

    def score(self, chunk: Chunk) -> np.ndarray:
        if self.weights is None:
            return np.full(len(chunk), float(self.base))
        fired, more = _fired(chunk, self.lexicon)
        return 1 / (1 + np.exp(-np.clip(_inputs(fired, more) @ self.weights, -30, 30)))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    model = Model(training_sample(docs, labels))
    model.labels = None

    def run(batches):
        for c in chunks(batches):
            score = model.score(c)
            yield pa.RecordBatch.from_arrays([c.ids, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns; one pass without a shuffle."""
    model = Model(training_sample(docs, labels))
    model.labels = None
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([pa.array(range(len(batch)), pa.int64()), batch.column(at)], ["doc_id", "text"])
            keep = [model.score(c) < 0.5 for c in chunks([plain])]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
