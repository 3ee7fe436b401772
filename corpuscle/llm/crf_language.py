"""Language identification of words in code-switched text by a linear-chain CRF (operator 7).

Each word of a line gets a label.  Its emission features are its beginnings and
endings, its character n-grams and the word itself (the lexicon), hashed into a
table of weights; transitions between neighbouring labels are learned too.
Forward-backward gives each word's label probabilities; a document's language is
the one with the largest sum of them, its score that sum's share.

Training maximises the conditional likelihood on sequences put together from
segments of different languages, so that transitions see switches.  The sample:
``SAMPLE`` documents by a hash of the id, the same number for each language (``LEAST`` at
least), and ``SEGMENTS`` segments of ``LENGTH`` words of each, from its beginning,
middle and end.  Prediction reads every whole text, in one pass without
a shuffle; all sequences of a chunk advance together.

Only texts and non-null labels of the learning fold are learned from; lang, source
and doc_id are no inputs of a prediction.

Results for odd input: a null text, or one without a letter, is ``und`` with score
0; without any labelled document every text is ``und``; ties go to the smaller
label; repeated rows get equal results; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import crc_mod, cut, table
from ._text import LOWER, Chunk, chunks, csr_gather, mix, prefix_hash, span_hash, words

#: Documents of the training sample, at most; segments of each and their words.
SAMPLE, SEGMENTS, LENGTH = 6000, 3, 24
#: Documents of the sample that each language has at least, if there are so many.
LEAST = 100
#: Rows of the table of weights (a power of 2).
ROWS = 1 << 16
EPOCHS = 5

_U = np.uint64
#: Bytes of words: letters, and all that is not ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(97, 123), *range(128, 256)]] = True


def word_features(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table of weights, and the word of each."""
    p = prefix_hash(data)
    n = np.arange(len(s))
    rows, owner = [span_hash(p, s, e)], [n]

    def add(a, b, of, salt):
        rows.append(mix(span_hash(p, a, b) + _U(salt)))
        owner.append(of)

    for k in (1, 2, 3):
        ok = e - s > k
        add(s[ok], s[ok] + k, n[ok], 10 + k)
        add(e[ok] - k, e[ok], n[ok], 20 + k)
    for k in (2, 3, 4):
        lens = np.maximum(0, e - s - k + 1)
        a = csr_gather(s, lens)
        add(a, a + k, np.repeat(n, lens), 30 + k)
    return (np.concatenate(rows) & _U(ROWS - 1)).astype(np.int64), np.concatenate(owner)


def emissions(data: np.ndarray, s: np.ndarray, e: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word's features; equal words are summed once."""
    if not len(s):
        return np.zeros((0, weights.shape[1]))
    _, first, inv = np.unique(span_hash(prefix_hash(data), s, e), return_index=True, return_inverse=True)
    rows, owner = word_features(data, s[first], e[first])
    out = np.stack([np.bincount(owner, weights[rows, j], minlength=len(first)) for j in range(weights.shape[1])], axis=1)
    return out[inv]


def forward_backward(e: np.ndarray, lens: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of the words of sequences laid end to end, and the expected transitions.

    All sequences advance together, the longest first, so that a step works on
    those that have not ended.
    """
    n_labels = e.shape[1]
    out = np.zeros_like(e)
    moves = np.zeros((n_labels, n_labels))
    if not len(lens):
        return out, moves
    order = np.argsort(-lens, kind="stable")
    lens = lens[order]
    first = (np.concatenate(([0], np.cumsum(lens[np.argsort(order, kind="stable")])))[:-1])[order]
    x = np.exp(e - e.max(1, keepdims=True))
    a, longest = np.exp(trans), int(lens[0])
    live = np.searchsorted(-lens, -np.arange(1, longest + 1), side="right")
    alpha = np.exp(start - start.max()) * x[first]
    alpha /= alpha.sum(1, keepdims=True)
    out[first] = alpha
    for t in range(1, longest):
        k = live[t]
        alpha = (alpha[:k] @ a) * x[first[:k] + t]
        alpha /= alpha.sum(1, keepdims=True)
        out[first[:k] + t] = alpha
    beta = np.ones((len(lens), n_labels))
    for t in range(longest - 2, -1, -1):
        k = live[t + 1]
        at = first[:k] + t
        ahead = x[at + 1] * beta[:k]
        joint = out[at][:, :, None] * a[None] * ahead[:, None, :]
        total = joint.sum((1, 2))
        moves += np.tensordot(1 / total, joint, axes=(0, 0))
        b = ahead @ a.T
        beta[:k] = b / b.sum(1, keepdims=True)
        post = out[at] * beta[:k]
        out[at] = post / post.sum(1, keepdims=True)
    return out, moves


class Crf:
    """Labels, weights and transitions."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        k = len(labels)
        self.weights = np.zeros((ROWS, k))
        self.trans, self.start = np.zeros((k, k)), np.zeros(k)

    def fit(self, segments: list[tuple[str, bytes]], seed: int = 3) -> Crf:
        """Learn from (label, segment) pairs, put together into switching sequences."""
        rng = np.random.default_rng(seed)
        k, number = len(self.labels), {x: i for i, x in enumerate(self.labels)}
        data = np.frombuffer(b"\n".join(x for _, x in segments) + b"\n", np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(x) + 1 for _, x in segments])))
        s, e, seg = words(LOWER[data], offsets, LETTERS)
        label = np.array([number[x] for x, _ in segments])[seg]
        rows, owner = word_features(LOWER[data], s, e)
        order = np.argsort(owner, kind="stable")
        rows, per = rows[order], np.bincount(owner, minlength=len(s))
        at = np.concatenate(([0], np.cumsum(per)))
        first = np.searchsorted(seg, np.arange(len(segments) + 1))
        g2 = np.full((ROWS, k), 1e-6), np.full((k, k), 1e-6)
        for _ in range(EPOCHS):
            deal = rng.permutation(len(segments))
            size = 1 + rng.integers(0, 3, len(deal))
            groups = np.split(deal, np.cumsum(size)[np.cumsum(size) < len(deal)])
            for lo in range(0, len(groups), 128):
                batch = groups[lo : lo + 128]
                w = [np.concatenate([np.arange(first[i], first[i + 1]) for i in g]) for g in batch]
                lens = np.array([len(x) for x in w])
                w, lens = np.concatenate([x for x in w if len(x)]) if lens.any() else np.zeros(0, int), lens[lens > 0]
                if not len(w):
                    continue
                n_rows = at[w + 1] - at[w]
                r, of = rows[csr_gather(at[w], n_rows)], np.repeat(np.arange(len(w)), n_rows)
                em = np.stack([np.bincount(of, self.weights[r, j], minlength=len(w)) for j in range(k)], axis=1)
                post, moves = forward_backward(em, lens, self.trans, self.start)
                y = label[w]
                d = -post
                d[np.arange(len(w)), y] += 1
                inner = np.ones(len(w), bool)
                inner[np.cumsum(lens) - 1] = False
                i = np.flatnonzero(inner)
                seen = np.zeros((k, k))
                np.add.at(seen, (y[i], y[i + 1]), 1)
                used, inv = np.unique(r, return_inverse=True)
                g = np.stack([np.bincount(inv, d[of, j]) for j in range(k)], axis=1) - 1e-3 * self.weights[used]
                g2[0][used] += g * g
                self.weights[used] += 0.15 * g / np.sqrt(g2[0][used])
                gt = seen - moves - 1e-2 * self.trans
                g2[1][...] += gt * gt
                self.trans += 0.1 * gt / np.sqrt(g2[1])
        return self

    def tag(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words' documents, label probabilities and starts; a sequence is a line."""
        data = LOWER[chunk.data]
        s, e, doc = words(data, chunk.offsets, LETTERS)
        lines = np.concatenate(([0], np.cumsum(data == 10)))[s] if len(s) else np.zeros(0, np.int64)
        cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), (lines[1:] != lines[:-1]) | (doc[1:] != doc[:-1]))))
        lens = np.diff(np.concatenate((cut, [len(s)])))
        post, _ = forward_backward(emissions(data, s, e, self.weights), lens, self.trans, self.start)
        return doc, post, s


def training_segments(docs: DataFrame) -> list[tuple[str, bytes]]:
    """Segments of sample documents of the learning fold, with their languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, at = batch.column(2).to_pylist(), 0
            for c in chunks([batch]):
                s, e, doc = words(LOWER[c.data], c.offsets, LETTERS)
                first = np.searchsorted(doc, np.arange(len(c) + 1))
                names, parts = [], []
                for i in range(len(c)):
                    n = int(first[i + 1] - first[i])
                    for j in range(min(SEGMENTS, -(-n // LENGTH))):
                        lo = int(first[i]) + (0 if n <= LENGTH else (n - LENGTH) * j // max(1, SEGMENTS - 1))
                        hi = min(lo + LENGTH, int(first[i + 1]))
                        names.append(lang[at + i])
                        parts.append(b" ".join(c.data[s[k] : e[k]].tobytes() for k in range(lo, hi)))
                at += len(c)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.binary())], ["lang", "part"])

    learn = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 4) != 2))
    # Every language that can be learned gets its part of the sample, however rare it is.
    sizes = learn.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n"))
    sizes = cut(sizes)
    each = max(LEAST, SAMPLE // max(1, sizes.count()))
    place = F.pmod(F.xxhash64(F.lit(31), F.col("doc_id")), F.lit(1 << 40))
    # A share by the hash first, so that no language's rows ever meet in one task.
    near = learn.select("doc_id", "lang", place.alias("h")).join(sizes, F.col("lang") == F.col("l")).where(F.col("h") < F.lit(float(1 << 40)) * (2 * each + 20) / F.col("n"))
    few = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= each)
    few = F.broadcast(few.select(F.col("doc_id").alias("id"), F.col("lang").alias("id_lang")).distinct())
    rows = learn.join(few, (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("id_lang"))).select("doc_id", "text", "lang")
    # Of rows that repeat an id and a language one is learned from.
    rows = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "text", "lang").mapInArrow(run, "lang string, part binary")
    return sorted((r["lang"], bytes(r["part"])) for r in rows.collect())


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``n_switches`` (changes of label along the lines) of every document."""
    docs = docs.select("doc_id", "text", "lang")
    segments = training_segments(docs)
    crf = Crf(sorted({x for x, _ in segments})).fit(segments) if segments else None
    if crf is not None:
        crf.weights = crf.weights.astype(np.float32)
    names = np.array([*crf.labels, "und"] if crf else ["und"], object)

    def run(batches):
        for c in chunks(batches):
            n = len(c)
            best, score, switches = np.full(n, len(names) - 1), np.zeros(n), np.zeros(n, np.int64)
            if crf is not None:
                doc, post, s = crf.tag(c)
                total = np.stack([np.bincount(doc, post[:, j], minlength=n) for j in range(post.shape[1])], axis=1)
                label = post.argmax(1)
                change = (label[1:] != label[:-1]) & (doc[1:] == doc[:-1])
                switches = np.bincount(doc[1:][change], minlength=n)
                count = np.bincount(doc, minlength=n)
                ascii_letter = np.bincount(doc, (c.data[s] < 128) if len(s) else None, minlength=n) > 0
                for i in np.flatnonzero(count > 0).tolist():
                    if ascii_letter[i] or any(ch.isalpha() for ch in c.text(i).decode("utf-8", "replace")):
                        best[i] = int(total[i].argmax())
                        score[i] = min(1.0, total[i, best[i]] / count[i])
            yield pa.RecordBatch.from_arrays([c.ids, pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(switches)], ["doc_id", "lang_pred", "score", "n_switches"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_switches long").select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_switches")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
