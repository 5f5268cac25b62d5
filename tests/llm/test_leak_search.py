"""The search for benchmark passages against brute force: every item, anywhere, at the accepted share of edits."""

import random

import numpy as np
import pytest

from lagweave.llm import decontaminate

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").collect()]
    docs = [r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    return items, [d for d in docs if len(d) > 300]


def brute_force(items, texts):
    """(text, item, edits) by the exact test of every pair."""
    folded = [decontaminate.canonical(t.encode()).decode() for t in texts]
    wanted = [(i, decontaminate.canonical(t.encode()).strip(b" ").decode()) for i, t in items]
    found = set()
    for k, text in enumerate(folded):
        for i, item in wanted:
            most = int(decontaminate.EDITED * len(item))
            edits = decontaminate.passage_distance(item, text, most)
            if edits <= most:
                found.add((k, i, edits))
    return found


def searched(items, texts):
    block = decontaminate.Items([(i, t.encode()) for i, t in items])
    return {(k, block.ids[i], e) for k, i, e, _ in decontaminate._matches(block, [t.encode() for t in texts])}


def changed(rng, text, count, places=None):
    """`count` random edits at different places."""
    out = list(text)
    for at in rng.sample(places or range(len(text)), count):
        letter = rng.choice("abcdefghijklmnop ")
        out[at] = rng.choice(["", letter, text[at] + letter])
    return "".join(out)


def planted(items, docs, rng, share):
    texts = []
    for k, (_, text) in enumerate(items):
        base = docs[k % len(docs)][:300]
        texts.append(f"{base} {changed(rng, text, int(share * len(text)))} {base[::-1]}")
    return texts


@pytest.mark.parametrize("share", [0.0, 0.02, 0.05, 0.1])
def test_recall_and_precision_against_brute_force_up_to_the_accepted_share(corpus, share):
    items, docs = corpus
    rng = random.Random(share)
    expected, found = set(), set()
    for turn in range(5):
        texts = planted(items, docs, rng, share)
        expected |= {(turn, *x) for x in brute_force(items, texts)}
        found |= {(turn, *x) for x in searched(items, texts)}
    assert len(expected) >= 5 * len(items)
    assert found <= expected  # the exact test decides
    assert len(found) >= (0.95 if share == decontaminate.EDITED else 0.99) * len(expected)


def test_edits_beyond_the_accepted_share_are_no_match(corpus):
    items, docs = corpus
    texts = planted(items, docs, random.Random(3), 0.4)
    assert searched(items, texts) == brute_force(items, texts) == set()


def test_even_edits_that_leave_no_long_run(corpus):
    items, _ = corpus
    every = round(1 / decontaminate.EDITED)
    texts = []
    for _, text in items:  # every tenth character another one
        own = "".join("#" if k % every == every - 1 else c for k, c in enumerate(text))
        texts.append(f"before it {own} and after it")
    expected = brute_force(items, texts)
    found = searched(items, texts)
    assert len(expected) >= len(items) and found <= expected and len(found) >= 0.95 * len(expected)


def test_windows_lose_no_passage_within_the_share(corpus):
    items, docs = corpus
    rng = random.Random(8)
    block = decontaminate.Items([(i, t.encode()) for i, t in items])
    for text, (item, _) in zip(planted(items, docs, rng, decontaminate.EDITED), items):
        folded = decontaminate.canonical(text.encode()).decode()
        edge = "\n" * block.margin
        windows = block.windows(block.classes(edge + folded + edge))
        assert item in {block.ids[i] for _, _, i in windows.tolist()}


def test_a_walk_goes_on_by_random_bits_and_gives_out_characters():
    data = np.array([5, 6, 7, 8, 0, 0, 0, 0, 0, 0], np.uint8)
    factor, term = np.zeros((decontaminate.PERIOD, 2), np.uint64), np.zeros((decontaminate.PERIOD, 2), np.uint64)
    term[::2, 0] = term[:, 1] = np.uint64(1 << 63)  # table 0 goes on at even steps, table 1 at every one
    steps = np.array([[0, 1, 2, 3, 4, 5]] * 2)
    got = decontaminate.walk(data, np.zeros(2, np.int64), steps, (factor, term, np.array([0, 1])))
    assert got.tolist() == [[5, 6, 6, 7, 7, 8], [5, 6, 7, 8, 0, 0]]


def test_blocks_of_items_give_what_one_block_gives(spark, corpus, monkeypatch):
    items, docs = corpus
    rng = random.Random(4)
    rows = [(k, f"{docs[k][:200]} {changed(rng, t, len(t) // 12)} {docs[k][-200:]}") for k, (_, t) in enumerate(items[:7])] + [(50, "nothing of it")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items[:7], "item_id long, text string")
    expected = {(rows[k][0], i, e) for k, i, e in brute_force(items[:7], [t for _, t in rows])}
    assert {(k, i) for k, i, _ in expected} >= {(k, items[k][0]) for k in range(7)}
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", ("item_id", "text", 3))
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.leaks(documents, benchmark).collect()} == expected
    assert [r["doc_id"] for r in decontaminate.keep_clean(documents, benchmark).collect()] == [50]


@pytest.mark.parametrize("share", [0.05, 0.08, 0.1])
def test_edits_in_the_first_half_only(corpus, share):
    items, _ = corpus
    rng = random.Random(share)
    texts = [f"before it {changed(rng, t, int(share * len(t)), range(len(t) // 2))} and after it" for _, t in items]
    expected = brute_force(items, texts)
    assert {(k, i) for k, i, _ in expected} >= {(k, items[k][0]) for k in range(len(items))}
    found = searched(items, texts)
    assert found <= expected and len(found) >= 0.9 * len(expected)


def test_no_head_is_needed(corpus):
    items, _ = corpus
    texts = []
    for _, text in items:  # all words that begin in the first half have another first letter, as far as edits are allowed
        left, out = int(decontaminate.EDITED * len(text)), list(text)
        for k in range(len(text) // 2):
            if left and (k == 0 or text[k - 1] in " \n"):
                out[k], left = "#", left - 1
        texts.append(f"before it {''.join(out)} and after it")
    expected = brute_force(items, texts)
    assert {(k, i) for k, i, _ in expected} >= {(k, items[k][0]) for k in range(len(items))}
    found = searched(items, texts)
    assert found <= expected and len(found) >= 0.9 * len(expected)


def test_scripts_without_spaces(spark):
    rng = random.Random(12)
    alphabets = ["的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほ日本語学人", "กขคงจฉชซญดตถทธนบปผพฟภมยรลวศสหอะาิีุเแโ"]
    draw = lambda k, n: "".join(rng.choice(alphabets[k % 3]) for _ in range(n))
    items = [(k, draw(k, rng.randrange(30, 200))) for k in range(30)]
    texts = [draw(k, 400) + t + draw(k, 400) for k, (_, t) in enumerate(items)]
    texts += [draw(k, 400) + changed(rng, t, int(decontaminate.EDITED * len(t))) + draw(k, 400) for k, (_, t) in enumerate(items)]
    found = searched(items, texts)
    expected = brute_force(items, texts)
    assert {(k, i) for k, i, _ in expected} >= {(k, k % 30) for k in range(60)}
    assert found <= expected and len(found) >= 0.95 * len(expected)
    assert {(k, i) for k, i, _ in found} >= {(k, k) for k in range(30)}


def test_unicode_white_space_is_blank(corpus):
    items, _ = corpus
    blanks = "\u00a0\u3000\u2003\u2028\u0085\u202f"
    texts = ["before" + " ".join(["", *t.split(), ""]).replace(" ", blanks[k % len(blanks)]) + "after" for k, (_, t) in enumerate(items)]
    plain = [(i, " ".join(t.split())) for i, t in items]
    assert {(k, i) for k, i, e in searched(plain, texts) if e == 0} >= {(k, items[k][0]) for k in range(len(items))}
    assert searched([(7, "\u00a0\u3000")], ["a \u3000 b"]) == set()


def test_short_items_match_exactly_between_word_borders(spark):
    items = [(1, "What is 2+2?"), (2, "Paris"), (3, "a"), (4, "\u4e2d\u6587\u95ee"), (5, "x" * 23), (6, "  "), (7, "C++"), (8, "caf\u00e9 au lait")]
    texts = ["so WHAT  is 2+2? yes", "so what\nis 2+2?", "in Paris.", "comparison", "parisian", "b\u4e2d\u6587\u95ee\u9898", "x" * 24, f"({'x' * 23})", "in c++, yes", "a", "", "Caf\u00e9\u00a0au lait!", "an abc", "parts"]
    assert searched(items, texts) == {(1, 1, 0), (2, 2, 0), (5, 4, 0), (7, 5, 0), (8, 7, 0), (9, 3, 0), (11, 8, 0)}
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = decontaminate.keep_clean(documents, spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {0, 3, 4, 6, 10, 12, 13}
