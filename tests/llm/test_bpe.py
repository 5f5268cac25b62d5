"""Encoding with chunk reuse against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lagweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "a", "é", "!!", "<|endoftext|>", "12", "'s", "\xa0", "　", "漢字", "́", "word ", "the and ", "x" * 50, "😀"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 5, 50, 600]))) for _ in range(n)]
    return [*texts, "x" * 5000, " " * 5000, "ab" * 3000, "é" * 3000, "word " * 4000]


def as_list(ids):
    return np.frombuffer(ids, "<u4").tolist()


def test_whole_texts_and_texts_out_of_shared_chunks_equal_the_library(library):
    texts = [t.encode() for t in odd_texts(200, 3)]
    expected = [library.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    assert [as_list(i) for i in bpe.encode_all(texts, [{}] * len(texts), PATH)] == expected
    given = []
    for t in texts:
        own = bpe.chunks(t)
        given.append({k: i for k, i in enumerate(bpe.encode_all(own, [{}] * len(own), PATH)) if k % 2})
    assert [as_list(i) for i in bpe.encode_all(texts, given, PATH)] == expected


def test_shared_ids_that_disagree_are_not_used(library):
    text = " ".join(f"word{k}" for k in range(2000)).encode()
    wrong = {k: np.arange(9, dtype="<u4").tobytes() for k in range(len(bpe.chunks(text)))}
    (got,) = bpe.encode_all([text], [wrong], PATH)
    assert as_list(got) == library.encode(text.decode(), add_special_tokens=False).ids


def test_chunks_depend_on_content_only():
    rng = random.Random(1)
    shared = " ".join(f"w{rng.randrange(500)}" for _ in range(6000)).encode()
    a, b = bpe.chunks(b"one two " * 40 + shared), bpe.chunks(b"another beginning " * 31 + shared)
    assert b"".join(a) == b"one two " * 40 + shared
    assert len(set(a) & set(b)) > len(a) * 0.6
    assert bpe.chunks(b"") == []


def test_decoding_equals_the_library(library):
    for ids in ([], [50256, 1, 2], [255, 254, 100], list(range(0, 50257, 37))):
        assert bpe.decode(np.array(ids, "<u4").tobytes(), PATH) == library.decode(ids, skip_special_tokens=False)


class Counting:
    """The library, with a count of the texts that it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_words_go_to_the_library_many_at_a_time(library):
    encoder = bpe.Encoder(PATH)
    encoder.tokenizer = Counting(encoder.tokenizer)
    words = {f"{blank}w{k}{end}" for k in range(800) for blank, end in ((" ", ""), ("\n\n", "é!"), ("\u3000 ", "<|endoftext|>"), (" \t", "\x1c,"))}
    pieces = words | {" ", "\n \n", "first", "x" * 300, " " + "漢" * 300}
    table = encoder.learn(pieces)
    assert {p: as_list(table[p]) for p in pieces} == {p: library.encode(p, add_special_tokens=False).ids for p in pieces}
    assert encoder.tokenizer.texts < 20
    again = encoder.learn({" w1", " " + "漢" * 300})
    assert again is table and as_list(again[" " + "漢" * 300]) == library.encode(" " + "漢" * 300, add_special_tokens=False).ids
    assert encoder.tokenizer.texts < 20
    encoder.learn({" w1"})
    assert not [p for p in encoder.known if len(p) > bpe.WORD]


def test_a_vocabulary_of_other_tokens_is_asked_word_by_word():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, words = bpe.Encoder(path), [" one", " twoé", "\n three", "four", " "]
    assert {p: as_list(i) for p, i in encoder.encode(words).items()} == {p: encoder.tokenizer.encode(p, add_special_tokens=False).ids for p in words}


def test_documents(spark, library):
    rng = random.Random(8)
    passage = " ".join(f"w{rng.randrange(300)}" for _ in range(3000))
    texts = [*odd_texts(30, 5), *[f"{k} starts {passage} {k} ends" for k in range(6)], passage, passage, None, ""]
    rows = [(i if i % 9 else None, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, _key int").repartition(3)
    got = bpe.encode_documents(docs, PATH, with_ids=True).collect()
    expected = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), packed))
    assert sorted([(*r[:4], bytes(r[4])) for r in map(tuple, got)], key=str) == sorted(expected, key=str)
    shared = bpe.encode_texts(docs, PATH)
    assert shared.count() == len({t or "" for t in texts})
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_the_texts_move_once(spark, tmp_path):
    rng = random.Random(2)
    passage = " ".join(f"w{rng.randrange(300)}" for _ in range(2000))
    docs = spark.createDataFrame([(k, f"text {k} {passage}") for k in range(20)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    out = bpe.encode_documents(docs, PATH)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    moved = [line for line in final.split("\n") if "first(_text" in line and "partial" in line]
    assert "ReusedExchange" in final and len(moved) == 1
