"""Benchmark passages in documents, also edited ones: CGK walks, bit-sampling LSH, exact edit distance.

Texts are compared in lower case with white space (ASCII and Unicode) as spaces, character by character. An item of m characters matches
a document if the smallest edit distance between the whole item and any passage of it is at most k = int(EDITED * m).

1. Windows of an item's size start where document and item have characters in common: passages within k edits share `m - q + 1 - k q` of the
   item's runs of q characters at least (q-gram lemma), at places that differ from the item's by one number give or take k. Where
   a document has as many, a window is placed by the first of them. This loses none, needs no head or border, and works in every script.
2. A CGK walk embeds window and item alike: at each step it gives out the character it stands on, and a random bit of step and
   character says whether it goes on. Few edits of the text change few characters of the embedding, as the walks fall into step again after an edit.
3. A table has a fresh walk and `SAMPLED` steps of it; a window is a candidate if it agrees with the item in all sampled characters of one
   table. The number of tables follows from `EDITED` and the target recall `RECALL`: as many as it takes for that share of copies of the
   items, changed by random edits up to the accepted share.
4. Candidates pass the exact test, by bit-parallel dynamic programming over the place of the window.

The walk reads whole documents, in batches, in one pass and without a shuffle. The items are a stated query set: they go
to the tasks in blocks of `BLOCK` items, one pass each.

Defined cases: NULL and empty texts hold nothing; NULL and empty items are skipped; very short items (under `SHORTEST` bytes) count only where
they stand unedited between word borders; a letter of a script without spaces has a border at either side. Repeated items match each under its own id. Repeated rows each give their matches. Empty tables
give no matches and drop no rows. Further columns are kept by `keep_clean`.
"""

import re
from collections import Counter
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.shared import stored
from .common import groups_of, map_batches, ship, text_of, utf8

SHORTEST = 24
EDITED = 0.1  # accepted share of edits
RECALL = 0.97  # of passages with as many random edits
SAMPLED = 6  # steps of a table
TABLES = 512  # at most
ROUNDS = 4  # of tables tried one after the other
REACH = 1.8  # steps of a walk for a character of the item
RUNS = (8, 6, 4)  # q
COMMON = 4  # runs that a window has to share, if the lemma asks for as many; else q is smaller
PERIOD = 512  # steps with bits of their own
COPIES = 256  # changed items that say how many tables it takes
SEED = 20240229
CLASSES = 255  # of characters; rarer ones share a class, which makes candidates, never losses
BLOCK = 1000
GROUP = 1 << 20  # bytes of text searched at a time
PLACES = 1 << 17  # places looked up at a time
WALKS = 1 << 17  # at a time
MIXER = np.uint64(0x9E3779B97F4A7C15)


def _folding() -> bytes:
    folding = bytearray(range(256))
    folding[65:91] = range(97, 123)
    folding[9:14] = b" " * 5
    return bytes(folding)


FOLDING = _folding()


#: Unicode White_Space beyond ASCII, in UTF-8. The first bytes stand only at the start of a character.
BLANKS = re.compile("|".join("\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000").encode())


#: Letters and digits of scripts with spaces: the others are Thai, Lao, Burmese, Khmer, Kana and Han.
LETTER = "[^\\W\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"


def canonical(text: bytes) -> bytes:
    folded = text.translate(FOLDING)
    return folded if folded.isascii() else BLANKS.sub(b" ", folded)


def between_borders(item: str) -> re.Pattern:
    """What finds the item where no letter goes on beside it."""
    before, after = (f"(?<!{LETTER})", f"(?!{LETTER})")
    return re.compile((before if re.match(LETTER, item[0]) else "") + re.escape(item) + (after if re.match(LETTER, item[-1]) else ""))


def grams(data: np.ndarray, length: int, bits: int) -> np.ndarray:
    """A hash of so many bits of the `length` classes at each place."""
    wide = data.astype(np.uint64)
    code = wide[: len(data) - length + 1].copy()
    for j in range(1, length):
        code = (code << np.uint64(8)) | wide[j : len(data) - length + 1 + j]
    return ((code + np.uint64(1)) * MIXER >> np.uint64(64 - bits)).astype(np.int64)


def walk(data: np.ndarray, at: np.ndarray, steps: np.ndarray, bits: tuple[np.ndarray, np.ndarray], wanted: np.ndarray | None = None) -> np.ndarray:
    """What CGK walks from `at` stand on at their sampled `steps` (ascending in each row); with `wanted`, whether they stand on just
    that, where a walk ends at the first difference. `bits` has the two factors of each (step, walk's table) that make its random bits."""
    factor, term, table = bits
    count = steps.shape[1]
    out = np.zeros(steps.shape, np.uint8)
    live, place, taken = np.arange(len(at)), at.copy(), np.zeros(len(at), np.int64)
    due, step = steps[:, 0].copy(), 0
    own_table = table.copy()
    while len(live):
        here = data[place]
        hit = np.flatnonzero(due == step)
        if len(hit):
            who, number = live[hit], taken[live[hit]]
            out[who, number] = here[hit]
            taken[who] = number + 1
            more = number + 1 < count
            if wanted is not None:
                more &= here[hit] == wanted[who, number]
            due[hit] = np.where(more, steps[who, np.minimum(number + 1, count - 1)], -1)
            going = due >= 0
            if np.count_nonzero(going) * 4 < 3 * len(going):
                live, place, due, own_table, here = live[going], place[going], due[going], own_table[going], here[going]
        turn = step % PERIOD
        place += ((here * factor[turn][own_table] + term[turn][own_table]) >> np.uint64(63)).astype(np.int64)
        step += 1
    return out if wanted is None else (taken == count) & (out == wanted).all(axis=1)


class Items:
    """A block of items: their runs of characters by hash, and what their walks give out at the sampled steps."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.ids, self.texts, self.decoded = [], [], []
        for item, text in rows:
            folded = canonical(text).strip(b" ")
            if not folded:
                continue
            self.ids.append(item)
            self.texts.append(folded)
            self.decoded.append(folded.decode("utf-8", "replace"))
        self.short = [between_borders(d) if len(t) < SHORTEST else None for d, t in zip(self.decoded, self.texts)]
        self.size = np.array([len(d) for d in self.decoded], np.int64)
        self.most = np.array([0 if s else int(EDITED * len(d)) for d, s in zip(self.decoded, self.short)], np.int64)
        often = [c for c, _ in sorted(Counter("".join(self.decoded)).items(), key=lambda x: (-x[1], x[0]))]
        self.class_of = np.zeros(max(map(ord, often), default=0) + 2, np.uint8)
        for rank, c in enumerate(often):
            self.class_of[ord(c)] = 1 + rank % CLASSES
        coded = [self.classes(d) for d in self.decoded]
        self.margin = int(self.size.max(initial=0) * 2) + 64
        self._runs(coded)
        random = np.random.default_rng(SEED)
        self.factor, self.term = (random.integers(0, 1 << 64, (PERIOD, TABLES), np.uint64) for _ in range(2))
        self.share = np.sort(random.random((TABLES, SAMPLED)), axis=1)
        self.tables = TABLES
        self._keys(coded)
        self._enough_tables(random)

    def classes(self, text: str) -> np.ndarray:
        """The class of every character; 0 where no item has it."""
        out = [np.empty(0, np.uint8)]
        for k in range(0, len(text), GROUP):
            points = np.frombuffer(text[k : k + GROUP].encode("utf-32-le", "replace"), np.uint32)
            out.append(self.class_of[np.minimum(points, len(self.class_of) - 1)])
        return np.concatenate(out)

    def _runs(self, coded: list[np.ndarray]) -> None:
        """The runs of the items by length and hash, and how many of them a window has to share."""
        lengths, own, place = [], [], []
        self.need = np.ones(len(coded), np.int64)
        for number, codes in enumerate(coded):
            if self.short[number]:
                continue
            least = {q: len(codes) - q + 1 - int(self.most[number]) * q for q in RUNS}
            q = next((q for q in RUNS if least[q] >= COMMON), RUNS[-1])
            self.need[number] = max(least[q], 1)
            count = len(codes) - q + 1
            lengths += [q] * count
            own += [number] * count
            place += range(count)
        lengths, own, place = (np.array(x, np.int64) for x in (lengths, own, place))
        self.bits = max(12, len(own).bit_length() + 3)
        self.lookup = {}
        for q in np.unique(lengths).tolist():
            here = np.flatnonzero(lengths == q)
            hashed = np.concatenate([grams(coded[i], q, self.bits) for i in np.unique(own[here])])
            order = np.argsort(hashed, kind="stable")
            begins = np.searchsorted(hashed[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
            self.lookup[q] = begins, own[here][order], place[here][order]

    def _walks(self, item: np.ndarray, tables: np.ndarray):
        """Sampled steps and bits of the walks of every item in every one of the tables."""
        length = np.maximum((REACH * self.size[item]).astype(np.int64), SAMPLED)
        each = np.tile(tables, len(item))
        steps = (self.share[each] * np.repeat(length - SAMPLED + 1, len(tables))[:, None]).astype(np.int64) + np.arange(SAMPLED)
        return steps, (self.factor, self.term, each)

    def _keys(self, coded: list[np.ndarray]) -> None:
        edge = np.zeros(self.margin, np.uint8)
        self.keys = np.zeros((len(coded), self.tables, SAMPLED), np.uint8)
        for own in self._parts(np.arange(len(coded))):
            data = np.concatenate([x for i in own for x in (coded[i], edge)])
            first = np.cumsum([0, *[len(coded[i]) + len(edge) for i in own]])[:-1]
            steps, bits = self._walks(own, np.arange(self.tables))
            self.keys[own] = walk(data, np.repeat(first, self.tables), steps, bits).reshape(len(own), self.tables, SAMPLED)

    def _parts(self, numbers: np.ndarray, tables: int | None = None):
        size = max(1, WALKS // (tables or self.tables))
        return [numbers[k : k + size] for k in range(0, len(numbers), size)]

    def agreements(self, data: np.ndarray, begin: np.ndarray, item: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """(window, table): whether a window agrees with its item in all sampled steps of a table."""
        out = [np.empty((0, len(tables)), bool)]
        for own in self._parts(np.arange(len(begin)), len(tables)):
            steps, bits = self._walks(item[own], tables)
            wanted = self.keys[item[own]][:, tables].reshape(-1, SAMPLED)
            out.append(walk(data, np.repeat(begin[own], len(tables)), steps, bits, wanted).reshape(len(own), len(tables)))
        return np.concatenate(out)

    def _enough_tables(self, random) -> None:
        """Keeps as many tables as find the target share of changed copies of the items."""
        long = np.flatnonzero([not s for s in self.short])
        if not len(long):
            return
        chosen = np.resize(long, COPIES) if len(long) < COPIES else long[:: len(long) // COPIES]
        copies = [changed(random, self.decoded[i], int(self.most[i])) for i in chosen]
        edge = "\n" * self.margin
        data = self.classes(edge + "".join(c + edge for c in copies))
        begin = np.cumsum([len(edge), *[len(c) + len(edge) for c in copies]])[:-1]
        found = np.logical_or.accumulate(self.agreements(data, begin, chosen, np.arange(self.tables)), axis=1).mean(axis=0)
        self.tables = min(int(np.searchsorted(found, RECALL)) + 1, TABLES)
        self.keys = self.keys[:, : self.tables]
        self.factor, self.term = self.factor[:, : self.tables], self.term[:, : self.tables]

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Distinct (place of a common run, begin, item) rows of windows that share enough runs with an item."""
        reach, out = self.margin, [np.empty((0, 3), np.int64)]
        for q, (begins, own, place) in self.lookup.items():
            kept = np.empty((0, 3), np.int64)
            for low in range(0, len(data) - q + 1, PLACES):
                hashed = grams(data[low : low + PLACES + q - 1], q, self.bits)
                first = begins[hashed]
                number = begins[hashed + 1] - first
                here = np.flatnonzero(number)
                number = number[here]
                run = np.arange(number.sum()) + np.repeat(first[here] - np.cumsum(number) + number, number)
                new = np.column_stack([np.repeat(here + low, number), place[run], own[run]])
                hits = np.concatenate([kept, new])
                out.append(self._dense(hits))
                kept = hits[hits[:, 0] >= low + PLACES - reach]
        return np.unique(np.concatenate(out), axis=0)

    def _dense(self, hits: np.ndarray) -> np.ndarray:
        if not len(hits):
            return hits
        at, place, item = hits.T
        begin = at - place + self.margin
        key = item << 40 | begin // (self.most[item] + 1)  # all runs of a passage lie in two neighbouring spans
        order = np.lexsort((place, key))
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(first, len(key)))
        key, leading = key[first], order[first]
        beside = np.append(key[1:] == key[:-1] + 1, False)
        follower = np.append(leading[1:], 0)
        enough = count + np.where(beside, np.append(count[1:], 0), 0) >= self.need[item[leading]]
        leading = np.where(beside & (place[follower] < place[leading]), follower, leading)[enough]
        return np.column_stack([at[leading], begin[leading] - self.margin, item[leading]])

    def candidates(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (text, begin, item) rows of windows that agree with an item in some table. `data` holds the classes of texts that begin
        at `first`, with a margin at both ends."""
        at, begin, item = self.windows(data).T
        text = np.searchsorted(first, at, "right") - 1
        text, begin, item = np.unique(np.column_stack([text, begin, item]), axis=0).T
        found = np.zeros(len(begin), bool)
        for tables in np.array_split(np.arange(self.tables), ROUNDS):
            left = np.flatnonzero(~found & (begin >= 0))
            if len(tables) and len(left):
                found[left] = self.agreements(data, begin[left], item[left], tables).any(axis=1)
        return np.column_stack([text, begin, item])[found]


def changed(random: np.random.Generator, text: str, edits: int) -> str:
    """The text with so many random insertions, deletions and replacements at different places."""
    out = list(text)
    for at in random.choice(len(out), edits, replace=False):
        letter = text[random.integers(len(text))]
        out[at] = ("", letter, out[at] + letter)[random.integers(3)]
    return "".join(out)


def passage_distance(item: str, text: str, most: int) -> int:
    """The smallest edit distance between the item and any part of the text, most + 1 if it is larger than that."""
    if item in text:
        return 0
    n = len(item)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, n
    for c in text:  # Myers' columns; a part may begin anywhere, so the first row stays zero
        match = where.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right, left = down | ~(diagonal | up) & full, up & diagonal
        score += bool(right & top) - bool(left & top)
        right, left = right << 1 & full, left << 1 & full
        up, down = left | ~(diagonal | right) & full, right & diagonal
        best = min(best, score)
    return best if best <= most else most + 1


def _matches(items: Items, texts: list[bytes]) -> list[tuple[int, int, int, float]]:
    """(text, item, edits, similarity) of the items that the texts hold, found in groups of texts of bounded size."""
    return [(own.start + t, *rest) for own in groups_of(texts, GROUP) for t, *rest in _group_matches(items, texts[own])]


def _group_matches(items, texts):
    if not items.ids:
        return []
    joined = [canonical(t).decode("utf-8", "replace") for t in texts]
    first = np.cumsum([items.margin, *[len(t) + 1 for t in joined]])
    edge = np.zeros(items.margin, np.uint8)
    data = np.concatenate([edge, items.classes("\n".join(joined)), edge])  # no item has a line break
    windows: dict[tuple[int, int], list[list[int]]] = {}
    for text, place, item in items.candidates(data, first).tolist():
        begin, slack = place - int(first[text]), 2 * int(items.most[item])
        low, high = max(0, begin - slack), max(0, begin + len(items.decoded[item]) + slack)
        own = windows.setdefault((text, item), [[low, high]])
        if low <= own[-1][1]:  # places come in order
            own[-1][1] = max(own[-1][1], high)
        else:
            own.append([low, high])
    found = _short_matches(items, joined)
    for (text, item), own in windows.items():
        wanted, most = items.decoded[item], int(items.most[item])
        edits = min(passage_distance(wanted, joined[text][low:high], most) for low, high in own)
        if edits <= most:
            found.append((text, item, edits, 1 - edits / len(wanted)))
    return sorted(found)


def _short_matches(items, texts):
    """Short items, unedited and between borders: one automaton finds them all."""
    import ahocorasick

    short = {}
    for number, border in enumerate(items.short):
        if border:
            short.setdefault(items.decoded[number], []).append(number)
    if not short:
        return []
    finder = ahocorasick.Automaton()
    for word in short:
        finder.add_word(word, word)
    finder.make_automaton()
    found = []
    for k, text in enumerate(texts):
        for word in {w for _, w in finder.iter(text)}:
            if items.short[short[word][0]].search(text):
                found += [(k, number, 0, 1.0) for number in short[word]]
    return found


def item_blocks(items: DataFrame, id_column: str = "item_id", text_column: str = "text", block: int = BLOCK):
    """The items in blocks of at most `block`, read one block at a time."""
    rows = items.select(F.col(id_column), F.col(text_column)).where(F.col(text_column).isNotNull()).toLocalIterator()
    taken = []
    for item, text in rows:
        taken.append((item, text.encode()))
        if len(taken) == block:
            yield Items(taken)
            taken = []
    if taken:
        yield Items(taken)


def _found(batch: pa.RecordBatch, items: Items) -> pa.RecordBatch | None:
    hits = _matches(items, utf8(batch, "_text"))
    if not hits:
        return None
    rows, which, edits, similar = zip(*hits)
    ids = batch.column(0).take(pa.array(rows))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([items.ids[i] for i in which], pa.int64()), pa.array(edits, pa.int32()), pa.array(similar, pa.float64())],
        ["_id", "item_id", "edits", "similarity"],
    )


def leaks(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, item_id, edits, similarity): every item that a document holds, with the fewest edits."""
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), text_of(text_column).alias("_text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, item_id bigint, edits int, similarity double"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(items):
        out = out.unionByName(map_batches(rows, partial(_found, items=block), schema))
    return out.withColumnRenamed("_id", id_column)


def _clean(block: Items) -> Callable[[pa.Array], pa.Array]:
    def clean(texts: pa.Array) -> pa.Array:
        found = {hit[0] for hit in _matches(block, [(t or "").encode() for t in texts.to_pylist()])}
        return pa.array([k not in found for k in range(len(texts))])

    return clean


def keep_clean(docs: DataFrame, items: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item."""
    ship(docs.sparkSession)
    for number, block in enumerate(item_blocks(items)):
        docs = stored(docs, "clean") if number else docs  # one pass of Python workers at a time
        docs = docs.where(F.arrow_udf(_clean(block), "boolean")(text_of(text_column)))
    return docs
