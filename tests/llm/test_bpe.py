import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandworks.llm import bpe
from strandworks.llm import queries as Q

from .helpers import TEXTS, edge_docs, empty_docs

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
PIECES = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'ll", "é", "Ω", "中", "😀", "1", "²", "Ⅷ", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000", "_", "!!", "<|endoftext|>", "<|", "aaaaaa", "\0", "१", "\u093c", "\ufeff", "\u200b"]


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def samples():
    rng = random.Random(3)
    mixed = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    any_code = ["".join(chr(rng.choice([rng.randrange(1, 0xD7FF), rng.randrange(0xE000, 0x10FFFF), rng.randrange(1, 300)])) for _ in range(20)) for _ in range(800)]
    return mixed + any_code + [t or "" for t in TEXTS]


def test_ids_counts_and_text_are_the_library_s(vocab, library):
    texts = samples()
    whole = vocab.whole_tokens()
    want = library.encode_batch(texts, add_special_tokens=False)
    packed, counts = bpe.encode_texts(vocab, texts), bpe.count_texts(vocab, whole, texts)
    for text, w, p, c in zip(texts, want, packed, counts):
        assert np.frombuffer(p, "<u4").tolist() == w.ids
        assert c == len(w.ids)
        assert bpe.decode_ids(vocab, p) == library.decode(w.ids, skip_special_tokens=False) == text


def test_whole_tokens_are_proven(vocab, library):
    whole = vocab.whole_tokens()
    some = random.Random(1).sample(sorted(whole), 500)
    assert all(len(e.ids) == 1 for e in library.encode_batch(some, add_special_tokens=False))


def test_bounded_memory_gives_the_same(vocab, monkeypatch):
    texts = samples()[:600]
    want = bpe.encode_texts(vocab, texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    bpe._remembered.clear()
    assert bpe.encode_texts(vocab, texts) == want
    bpe._remembered.clear()


@pytest.mark.parametrize("name", ["op4_bpe", "op7_token_counts"])
def test_queries_on_the_whole_table(spark, library, name):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.QUERIES[name](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        if name == "op4_bpe":
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
        else:
            assert r.n_bytes == len(docs[r.doc_id].encode()) and r.over_limit == (len(ids) > 512)


def test_edges(spark):
    docs = edge_docs(spark)
    assert bpe.digests(docs, PATH).count() == bpe.token_counts(docs, PATH).count() == docs.count()
    zero = {r.doc_id: r for r in bpe.token_counts(docs, PATH).collect()}
    assert zero[0].n_tokens == zero[1].n_tokens == 0
    assert bpe.digests(empty_docs(spark), PATH).count() == bpe.token_counts(empty_docs(spark), PATH).count() == 0


def test_round_trip_through_arrays(spark):
    docs = edge_docs(spark).filter("doc_id is not null and doc_id <> 4")
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(docs, PATH), PATH).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.collect()}
