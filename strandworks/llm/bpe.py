"""Byte-level BPE: encoding, decoding and token counts.

``Vocabulary`` holds the tables of a public tokenizer file. ``merge_all``
encodes many pre-tokens at once with a pair occurrence index: each pair that
has a merge rank is mapped to all its positions; the active ranks are applied
in ascending order, each to all its positions, and the lists of the new
neighbour pairs are updated. A merge only makes pairs of higher rank (the
token did not exist before), so one ascending pass is the library's result.

Tables ship as one broadcast of a few MB, whose size the vocabulary fixes.
Work is per partition without any shuffle; a text is processed whole, in
chunks of documents so that memory stays bounded.

Defined results: a null text is an empty text with 0 tokens; repeated rows give
repeated results; special strings in a text become their special id, as the
library's default does; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, in_small_batches

#: Fixed values of the byte-level pre-tokenizer: Unicode white space, and the pattern with it spelled out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The same on texts of ASCII alone, for the faster of the two expression libraries.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Characters of text tokenized at once, and pre-tokens that a worker remembers.
CHUNK_CHARS = 2_000_000
REMEMBERED = 250_000

split_any = regex.compile(PATTERN).findall
split_ascii = re.compile(ASCII_PATTERN).findall


def pre_tokens(text: str) -> list[str]:
    return split_ascii(text) if text.isascii() else split_any(text)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        self.name = hashlib.sha256(path.encode()).hexdigest()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.pieces[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_ids[b] = ids[c]
        self.width = len(self.pieces)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        codes = np.array([ids[a] * self.width + ids[b] for a, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        self.left, self.right, self.made = codes // self.width, codes % self.width, made
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks = codes[order], order.astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs; -1 where there is none."""
        code = left * self.width + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], -1)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row and the bounds between words, by the pair occurrence index."""
        if not words:
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        symbol = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n, ends = len(symbol), np.cumsum(lengths)
        after = np.arange(1, n + 1)
        after[ends[lengths > 0] - 1] = -1
        before = np.full(n + 1, -1)  # the last cell takes what is written to -1
        before[after[after >= 0]] = np.flatnonzero(after >= 0)
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(first: np.ndarray, second: np.ndarray) -> None:
            rank = self.rank_of(symbol[first], symbol[second])
            first, rank = first[rank >= 0], rank[rank >= 0]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            first, rank = first[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for part, r in zip(np.split(first, cuts), rank[np.concatenate(([0], cuts))].tolist()):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(part)

        inner = np.flatnonzero(after >= 0)
        enter(inner, after[inner])
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            left, right = self.left[r], self.right[r]
            at = at[alive[at] & (symbol[at] == left)]
            at = at[after[at] >= 0]
            at = at[symbol[after[at]] == right]
            if left == right and len(at) > 1:
                at = np.unique(at)
                # in a run of overlapping pairs every second one merges, from the left
                start = np.concatenate(([True], after[at[:-1]] != at[1:]))
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                at = at[run % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self.made[r]
            alive[gone] = False
            far = after[gone]
            after[at] = far
            before[far] = np.where(far >= 0, at, before[far])
            prior = before[at]
            has = prior >= 0
            enter(prior[has], at[has])
            has = far >= 0
            enter(at[has], far[has])
        kept = np.concatenate(([0], np.cumsum(alive)))
        bounds = kept[np.concatenate(([0], ends))]
        return symbol[alive].astype("<u4"), bounds

    def whole_tokens(self) -> set[str]:
        """Vocabulary strings that are one pre-token and that the merges bring to one token: proven, not assumed."""
        texts = []
        for piece in self.pieces:
            try:
                text = piece.decode()
            except UnicodeDecodeError:
                continue
            if text and text not in self.special and pre_tokens(text) == [text]:
                texts.append(text)
        _, bounds = self.merge_all([t.encode() for t in texts])
        return {t for t, n in zip(texts, np.diff(bounds).tolist()) if n == 1}

    def parts(self, text: str) -> list[str]:
        """``text`` cut at special strings; these stand at odd places."""
        return re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special and any(s in text for s in self.special) else [text]


_remembered: dict[str, dict] = {}


def memory(name: str) -> dict:
    """What this worker remembers under ``name``; emptied when full, so its size is bounded."""
    kept = _remembered.setdefault(name, {})
    if len(kept) > REMEMBERED:
        kept.clear()
    return kept


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def learn(vocab: Vocabulary, known: dict, lists: list[list[str]], values) -> None:
    fresh = list(set(chain.from_iterable(lists)).difference(known))
    known.update(zip(fresh, values(*vocab.merge_all([w.encode() for w in fresh]))))


def packed_ids(ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    data, cuts = ids.tobytes(), (bounds * 4).tolist()
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def numbers(ids: np.ndarray, bounds: np.ndarray) -> list[int]:
    return np.diff(bounds).tolist()


def cut(vocab: Vocabulary, texts: list[str]) -> list[list[str]]:
    """Pre-tokens of each text, special strings left out."""
    return [pre_tokens(t) if len(p := vocab.parts(t)) == 1 else [x for piece in p[::2] for x in pre_tokens(piece)] for t in texts]


def encode_texts(vocab: Vocabulary, texts: list[str]) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    known, out = memory("ids" + vocab.name), []
    mark = {s: np.array([i], "<u4").tobytes() for s, i in vocab.special.items()}
    get = known.__getitem__
    for a, b in chunks(texts):
        lists = cut(vocab, texts[a:b])
        learn(vocab, known, lists, packed_ids)
        for text, words in zip(texts[a:b], lists):
            pieces = vocab.parts(text)
            if len(pieces) == 1:
                out.append(b"".join(map(get, words)))
            else:
                out.append(b"".join(mark[p] if k % 2 else b"".join(map(get, pre_tokens(p))) for k, p in enumerate(pieces)))
        if len(known) > REMEMBERED:
            known.clear()
    return out


def decode_ids(vocab: Vocabulary, packed: bytes) -> str:
    ids = np.frombuffer(packed, "<u4").tolist()
    return b"".join(map(vocab.pieces.__getitem__, ids)).decode("utf-8", "replace")


def count_texts(vocab: Vocabulary, whole: set[str], texts: list[str]) -> list[int]:
    """Token numbers: a pre-token in ``whole`` counts 1 at once, only the rest are merged."""
    known, out = memory("counts" + vocab.name), []
    if not known:
        known.update(dict.fromkeys(whole, 1))
    for a, b in chunks(texts):
        lists = cut(vocab, texts[a:b])
        learn(vocab, known, lists, numbers)
        get = known.__getitem__
        out += [sum(map(get, words)) + len(vocab.parts(t)) // 2 for t, words in zip(texts[a:b], lists)]
        if len(known) > REMEMBERED:
            known.clear()
            known.update(dict.fromkeys(whole, 1))
    return out


def _texts(batch: pd.DataFrame) -> list[str]:
    return [t if isinstance(t, str) else "" for t in batch["text"]]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            packed = encode_texts(shared.value, texts)
            n = np.array([len(x) // 4 for x in packed], np.int64)
            flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat))
            digest = [hashlib.sha256(decode_ids(shared.value, x).encode()).hexdigest() for x in packed]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n), ids, pa.array(digest, pa.string())], ["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of ``tokens`` (doc_id, ids)."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(shared.value, np.array(x or [], "<u4").tobytes()) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return in_small_batches(tokens).select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = encode_texts(shared.value, _texts(batch))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_tokens": [len(x) // 4 for x in packed],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in packed],
                    "decoded_sha256": [hashlib.sha256(decode_ids(shared.value, x).encode("utf-8")).hexdigest() for x in packed],
                }
            )

    return in_small_batches(docs).select(as_text("doc_id"), "text").mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumn("doc_id", F.col("doc_id").cast("long"))


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``."""
    vocab = Vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, vocab.whole_tokens()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, whole = shared.value
        for batch in batches:
            texts = _texts(batch)
            n = count_texts(vocab, whole, texts)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]})

    return in_small_batches(docs).select(as_text("doc_id"), "text").mapInPandas(run, "doc_id string, n_bytes long, n_tokens long, over_limit boolean").withColumn("doc_id", F.col("doc_id").cast("long"))
