"""BPE encoding by backtracking, and decoding by an offset table (operator 8).

Encoding.  A greedy longest-match walk over each pretoken proposes tokens from
an Aho-Corasick trie of the vocabulary.  A proposed token stands only if it is
*compatible* with the token before it: the merge order must never have joined
bytes across their border.  Compatibility of a pair is decided once from the
merge ranks and kept in a table.  When no shorter match is compatible, the walk
takes back its last token and marks the position as a dead end, so each
position is visited a bounded number of times and a pretoken costs linear time.
The result equals applying the merges in rank order.

Decoding.  All token bytes lie end to end in one buffer; an offset table gives
each token's slice and a gather rebuilds the bytes.

Results for odd input: a null text is encoded as empty (no tokens, the hash of
nothing); the text of an added token becomes that token; ids never depend on
other rows, so ties and repeated rows give equal results; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._spark import table
from ._text import _buffers, csr_gather, rest

#: The pattern that cuts a text into pretokens before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct pretokens of a generation of a worker's memory; two generations are held (speed only).
MEMORY = 150_000

NAME = "byte_bpe_50k.json"


def vocabulary_path(name: str = NAME) -> str:
    """Where the vocabulary lies: folder ``CORPUSCLE_TOKENIZERS`` if set, else the installed package of public files."""
    if folder := os.environ.get("CORPUSCLE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """Printable character of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class _Memory(dict):
    """Numbers of pretokens; one that is new is numbered by ``make``."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, piece: str) -> int:
        return self.make(piece)


class Bpe:
    """An exact byte-level BPE encoder and decoder for one vocabulary file."""

    def __init__(self, source: str):
        doc = json.loads(source)
        alphabet, model = byte_alphabet(), doc["model"]
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.id_of = {raw(t): i for t, i in model["vocab"].items()}
        self.rank: dict[bytes, int] = {}
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        self.pairs: dict[tuple[bytes, bytes], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            self.pairs[a, b] = r
            if a + b not in self.rank:
                self.rank[a + b], self.parts[a + b] = r, (a, b)
        self.whole: dict[bytes, bool] = {}
        self.token = {i: t for t, i in self.id_of.items()}
        self.fits: dict[int, bool] = {}
        # Only tokens that the merges of their own bytes lead to can ever stand.
        stand = {t for t in self.id_of if self._whole(t)}
        self.automaton = ahocorasick.Automaton()
        top = max(self.id_of.values()) + 1
        self.length, self.shorter = [0] * top, [-1] * top
        for t in stand:
            i = self.id_of[t]
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
            self.length[i] = len(t)
            k = len(t) - 1
            while k and t[:k] not in stand:
                k -= 1
            if k:
                self.shorter[i] = self.id_of[t[:k]]
        self.automaton.make_automaton()
        self.added = {t["content"]: t["id"] for t in doc.get("added_tokens", ())}
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        top = max([*self.id_of.values(), *self.added.values()]) + 1
        tokens = [b""] * top
        for t, i in self.id_of.items():
            tokens[i] = t
        for t, i in self.added.items():
            tokens[i] = t.encode()
        #: The offset table: token i is blob[offset[i]:offset[i + 1]].
        self.offset = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        decimal = [b"%d," % i for i in range(top)]
        self.dec_offset = np.concatenate(([0], np.cumsum([len(t) for t in decimal])))
        self.dec_blob = np.frombuffer(b"".join(decimal), np.uint8)
        self.pretokens = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        """Drop what was learned from texts; the vocabulary stays."""
        self.fits.clear()
        self._forget()
        self._forget()

    def _forget(self) -> None:
        """Start the memory of pretokens anew: piece number k has the ids ``_flat[_start[k]:_start[k + 1]]``.

        What the last memory knew stays at hand for one more generation, so frequent
        pretokens are never encoded again.
        """
        self.before = (self.known, self._flat, self._start) if hasattr(self, "known") else ({}, None, None)
        self.known = _Memory(self._number)
        self._flat, self._start = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)

    def _holds(self, x: bytes, y: bytes, join: int = -1) -> bool:
        """Whether no merge but number ``join`` ever crosses the border between tokens ``x`` and ``y`` standing side by side.

        Both tokens are taken apart from their last merge backwards, the later
        merge first; the parts that touch the border at that time must not have
        a merge that would have come before.
        """
        limit = 1 << 60
        while True:
            r = self.pairs.get((x, y))
            if r is not None and r < limit and r != join:
                return False
            rx, ry = self.rank.get(x, -1) if len(x) > 1 else -1, self.rank.get(y, -1) if len(y) > 1 else -1
            if rx < 0 and ry < 0:
                return True
            # Equal merges are done from the left, so the left part's came first.
            if rx > ry:
                limit, x = rx, self.parts[x][1]
            else:
                limit, y = ry + 0.5, self.parts[y][0]

    def _whole(self, t: bytes) -> bool:
        """Whether the merges of the bytes of ``t`` lead to the single token ``t``."""
        if len(t) == 1:
            return True
        if t not in self.rank:
            return False
        if t not in self.whole:
            a, b = self.parts[t]
            self.whole[t] = self._whole(a) and self._whole(b) and self._holds(a, b, self.rank[t])
        return self.whole[t]

    def _fits(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a``; the table of pairs keeps the answer."""
        if len(self.fits) > 2 * MEMORY:
            self.fits.clear()
        got = self.fits[a << 20 | b] = self._holds(self.token[a], self.token[b])
        return got

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one pretoken."""
        n = len(piece)
        longest = [-1] * n
        for end, (t, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size] = t  # ends rise, so the last is the longest
        length, shorter, fits = self.length, self.shorter, self.fits
        dead, out, at, last, t = None, [], 0, -1, longest[0] if n else -1
        while at < n:
            while t >= 0:
                if dead is None or at + length[t] not in dead:
                    if last < 0:
                        break
                    ok = fits.get(last << 20 | t)
                    if self._fits(last, t) if ok is None else ok:
                        break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                at += length[t]
                last = t
                if at < n:
                    t = longest[at]
            elif out:
                dead = dead or set()
                dead.add(at)
                t = out.pop()
                at -= length[t]
                last, t = out[-1] if out else -1, shorter[t]
            else:
                raise ValueError("the vocabulary lacks some bytes")
        return out

    def _number(self, piece: str) -> int:
        k, (old, flat, start) = len(self.known), self.before
        j = dict.get(old, piece)
        ids = self.encode_piece(piece.encode("utf-8", "surrogatepass")) if j is None else flat[start[j] : start[j + 1]]
        lo = int(self._start[k])
        hi = lo + len(ids)
        if hi > len(self._flat):
            self._flat = np.concatenate((self._flat, np.zeros(max(hi, len(self._flat)), np.int32)))
        if k + 2 > len(self._start):
            self._start = np.concatenate((self._start, np.zeros(len(self._start), np.int64)))
        self._flat[lo:hi] = ids
        self._start[k + 1] = hi
        self.known[piece] = k
        return k

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text, added tokens included."""
        if self.split_added is not None and any(t in text for t in self.added):
            out = []
            for k, part in enumerate(self.split_added.split(text)):
                if k % 2:
                    out.append(np.array([self.added[part]], np.int64))
                elif part:
                    out.append(self._ids(part))
            return np.concatenate(out) if out else np.zeros(0, np.int64)
        return self._ids(text)

    def _ids(self, text: str) -> np.ndarray:
        pieces, out = self.pretokens(text), []
        # A very long text goes by parts, so that it can't outgrow the memory of pretokens.
        for at in range(0, len(pieces), MEMORY):
            if len(self.known) > MEMORY:
                self._forget()
            codes = np.array(list(map(self.known.__getitem__, pieces[at : at + MEMORY])), np.int64)
            lo = self._start[codes]
            out.append(self._flat[csr_gather(lo, self._start[codes + 1] - lo)])
        return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.int32), *out])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        lo = self.offset[ids]
        return self.blob[csr_gather(lo, self.offset[ids + 1] - lo)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids; bytes that are not UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        lo = self.dec_offset[ids]
        return self.dec_blob[csr_gather(lo, self.dec_offset[ids + 1] - lo)].tobytes()[:-1]


_LOADED: dict[str, Bpe] = {}


def load(path: str, shipped=None) -> Bpe:
    """The vocabulary at ``path``, built once a process; from the shipped file where there is one."""
    if path not in _LOADED:
        if shipped is not None:
            _LOADED[path] = Bpe(shipped.value)
        else:
            with open(path, encoding="utf-8") as f:
                _LOADED[path] = Bpe(f.read())
    return _LOADED[path]


def _shipped(spark: SparkSession, path: str):
    """The vocabulary file (1.5 MB, whatever the table), so that only the driver needs the path."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str | None = None, ids: bool = True, digests: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, with ``ids`` the token ids and with ``digests`` the hashes of ids and decoded text.

    One pass without any shuffle; the vocabulary (1.5 MB) is read from ``path`` on the
    driver and sent once to each executor.
    """
    path = path or vocabulary_path()
    file = _shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, file)
        for whole in batches:
            data, offsets, _ = _buffers(whole.column(1))
            data = memoryview(data)
            for at in range(0, len(whole), 256):
                part = whole.slice(at, 256)
                cols = [part.column(0)]
                n, token_ids, id_hash, text_hash = [], [], [], []
                for i in range(at, at + len(part)):
                    got = bpe.encode(bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
                    n.append(len(got))
                    if ids:
                        token_ids.append(got.astype(np.int32))
                    if digests:
                        id_hash.append(hashlib.sha256(bpe.decimals(got)).hexdigest())
                        text_hash.append(hashlib.sha256(bpe.decode(got).encode("utf-8")).hexdigest())
                cols.append(pa.array(n, pa.int64()))
                cols += [pa.array(token_ids, pa.list_(pa.int32()))] * ids
                cols += [pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())] * digests
                yield pa.RecordBatch.from_arrays(cols, names)
        # The worker may serve other stages next: the memory of this task goes.
        bpe.forget()
        rest()

    names = ["doc_id", "n_tokens", *["ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests]
    kinds = ["long", "long", *["array<int>"] * ids, *["string", "string"] * digests]
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(map(" ".join, zip(names, kinds, strict=True))))


def decode_documents(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` from ``doc_id`` and ``ids``; null ids give a null text, unknown ids raise."""
    path = path or vocabulary_path()
    file = _shipped(tokens.sparkSession, path)

    def run(batches):
        bpe = load(path, file)
        for batch in batches:
            texts = []
            for x in batch.column(1).to_pylist():
                if x is not None and any(i is None or not 0 <= i < len(bpe.offset) - 1 for i in x):
                    raise ValueError("an id is not in the vocabulary")
                texts.append(None if x is None else bpe.decode(np.array(x, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), ids=False, digests=True)
