"""Range coding and token files against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lagweave.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "\n", "\t", "\r\n", "\x1c", "a", "É", "!!", "<|endoftext|>", "<|ENDOFTEXT|>", "12", "'LL", "\xa0", "漢字", "́", "Word, ", "the. ", "x" * 50, "😀", "ΑΣ", "İ", ".", ","]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 5, 50, 400]))) for _ in range(n)]


def test_words_equal_the_library():
    library, texts = Tokenizer.from_file(PATH), odd_texts(500, 2)
    got = token_files.WordEncoder(PATH).encode([t.encode() for t in texts], 1)
    assert [np.frombuffer(i, np.uint16).tolist() for i in got] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_words_equal_the_library_over_generations(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED", 40)
    rng, library, encoder = random.Random(5), Tokenizer.from_file(PATH), token_files.WordEncoder(PATH)
    letters = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ×÷"
    for _ in range(60):
        words = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 60]))) + rng.choice(["", "", ",", ".", "!", ".,", "***", "&&&.", "'s", "<|", "_-`", "!a.", "é.", "Ä$"]) for _ in range(20)]
        text = " ".join([*words, "the", "of,"])
        assert np.frombuffer(encoder.encode([text.encode()], 1)[0], np.uint16).tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]
    assert len(encoder.known) <= 40 + 2 * 23 and encoder.older


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 70_001])
@pytest.mark.parametrize("kind", ["one", "skewed", "even"])
def test_blocks_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"one": np.full(n, 65_535), "skewed": rng.geometric(0.3, n) % 50_000, "even": rng.integers(0, 1 << 16, n)}[kind].astype(np.uint16)
    seen = np.unique(ids, return_counts=True)
    table = token_files.scaled(dict(zip(*[x.tolist() for x in seen])))
    assert sum(table.values()) == 1 << token_files.BITS and min(table.values()) >= 1
    code = token_files.Code(table)
    states, words = code.encode(ids)
    assert (code.decode(states, words, n) == ids).all()
    if kind == "skewed" and n > 10_000:
        assert len(words) * 8 / n < 3.6  # entropy is about 2.9 bits


def expected_rows(rows):
    library, out, start = Tokenizer.from_file(PATH), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("block", [7, 1000, token_files.BLOCK])
def test_files_read_back(spark, block):
    rows = [(k * 3 - 50, t) for k, t in enumerate(odd_texts(150, block))]
    rows += [(1000, None), (1001, "long words " * 3000), (5000, ""), (None, "no id")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, ids string").repartition(4)
    got = token_files.write_and_read(docs, PATH, 1, block=block).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected_rows(rows)


def test_repeated_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (0, "c")], "doc_id long, text string")
    got = sorted(map(tuple, token_files.write_and_read(docs, PATH, 1).collect()))
    assert [r[1:3] for r in got] == [(0, 2), (2, 3), (5, 3)]
    assert token_files.write_and_read(docs.limit(0), PATH, 1).count() == 0


def test_ranges_follow_the_ids_and_split_equal_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE", 500)
    docs = spark.createDataFrame([(7, "the same words")] * 900 + [(8, "others"), (None, "none")], "doc_id long, text string").repartition(3)
    path = str(tmp_path / "files")
    token_files.write_files(docs, path, PATH, 1, block=64)
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = [r["n"] for r in blocks.groupBy("part").sum("n").withColumnRenamed("sum(n)", "n").collect()]
    assert len(sizes) >= 6 and max(sizes) < 1500 and spark.read.parquet(f"{path}/parts").count() == len(sizes)
    read = sorted(map(tuple, token_files.read_documents(spark, path).select("start", "doc_id", "n_tokens").collect()))
    assert [r[1] for r in read] == [None] + [7] * 900 + [8]
    assert [r[0] for r in read] == [sum(x[2] for x in read[:k]) for k in range(len(read))]


def test_number_of_ranges():
    assert token_files._ranges(0, 8) == 1 and token_files._ranges(token_files.BLOCK + 1, 8) == 2
    assert token_files._ranges(token_files.RANGE * 8, 8) == 8 and token_files._ranges(token_files.RANGE * 1000, 8) == 1000


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(50)], "doc_id long, text string")
    path = str(tmp_path / "files")
    token_files.write_files(docs, path, PATH, 1)
    block = spark.read.parquet(f"{path}/blocks").first()
    code = token_files.read_code(spark, path)
    states = bytearray(block["states"])
    states[2] ^= 255
    with pytest.raises(ValueError):
        token_files._decoded(code, bytes(states), block["words"], block["n"], block["crc"])
