"""BPE encoding and decoding with reuse of content-defined chunks.

1. A rolling hash over the bytes cuts every text where the hash of the last 32 bytes meets a mask, so equal passages are cut
   alike wherever they stand. Only digests of the chunks are shuffled, to find those that occur more than once.
2. Of each of these the first occurrence is encoded, once over all documents; the ids go to every other occurrence.
   Chunks that occur once are encoded where they are.
3. A chunk's own encoding may differ at its ends from that inside the text. So every join is encoded again, from the last
   cut before the chunk's end that is certain to the first one after its start; if a chunk has none, the window
   widens into the next one. Shared ids must agree with a fresh encoding at both ends of what is kept, else the chunk is
   encoded in place.

A cut is certain before white space that follows another character: byte-level pre-tokenizers with the pattern of
`public_tokenizers.PATTERN` never join characters across it, and never look back. Words between such cuts are encoded by the tokenizers
library, many new ones as one text whose ids are dealt out by their bytes, and kept in a bounded cache per worker, so the result is
that of encoding whole texts.

Equal texts are encoded once. The text moves in one shuffle, by the digest of the text, with copies combined before it; both
uses read the same exchange. Defined cases: NULL texts are empty and have no ids. Repeated rows give a row each. Rows with a NULL id
are encoded like others. An empty table gives no rows. Strings of special tokens in a text are special tokens, as in the library.
Further columns are ignored.
"""

import os
import re
from array import array
from functools import cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import stored
from .common import groups_of, map_batches, text_of, utf8

#: The characters with the Unicode property White_Space, as a character class.
BLANKS = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")
SIGNS = frozenset(re.findall(f"[{BLANKS}]", "".join(map(chr, range(0x3001)))))
MASK = np.uint32((1 << 10) - 1)
LEAST = 128
CACHED = 150_000  # pieces of a generation
GROUP = 1 << 20  # bytes of text held as pieces at a time
WORD = 64
JOINED = 1000  # words given to the library as one text
#: A random number per byte for the rolling hash.
GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, np.uint32)


def cuts(data: bytes) -> list[int]:
    """Where chunks begin and end: content-defined, at the start of a character, `LEAST` bytes apart or more."""
    if len(data) <= LEAST:
        return [0, len(data)] if data else [0]
    signs = np.frombuffer(data, np.uint8)
    rolled = GEAR[signs]
    for width in (1, 2, 4, 8, 16):  # the hash of 2, 4, .. 32 bytes from those of half as many
        rolled[width:] += rolled[:-width] << np.uint32(width)
    out = [0]
    for at in (np.flatnonzero(rolled & (MASK << np.uint32(16)) == 0) + 1).tolist():
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        if at - out[-1] >= LEAST and len(data) - at >= LEAST:
            out.append(at)
    return [*out, len(data)]


def chunks(data: bytes) -> list[bytes]:
    at = cuts(data)
    return [data[a:b] for a, b in zip(at, at[1:])]


class Encoder:
    """Ids of pieces of text, as the bytes of little-endian 32-bit numbers, with a bounded cache of two generations.

    What is used stays in the younger one; when that is full it becomes the older one, and what was not used since then is gone.
    """

    def __init__(self, path: str):
        self.path = path
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.passing: set[str] = set()  # long pieces, which stay for one call only

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """A table that has all of the pieces, to be used before the next call."""
        for piece in self.passing:
            self.known.pop(piece, None)
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        # `difference` looks the pieces up in the table; a minus of its keys would go over the whole table.
        missing = pieces.difference(self.known)
        # A comma or full stop after a letter is a token of its own, so the piece before it is looked up by itself.
        ended = {p for p in missing if p[-1:] in (",", ".") and "a" <= p[-2:-1] <= "z" and "<|" not in p}
        wanted = (missing - ended) | {p[:-1] for p in ended} | {p[-1] for p in ended}
        kept = {p: self.older[p] for p in wanted & self.older.keys()}
        new = kept | self.encode(list(wanted.difference(kept).difference(self.known)))
        self.known.update(new)
        self.known.update([(p, self.known[p[:-1]] + self.known[p[-1]]) for p in ended])
        self.passing = {p for p in chain(new, ended) if len(p) > WORD}
        return self.known

    def encode(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces. Words with a certain cut on both sides go to the library many at a time, as one text."""
        words, others = [], []
        for p in pieces:
            (words if p[0] in SIGNS and p[-1] not in SIGNS else others).append(p)
        joined = self.tokenizer.encode_batch_fast(["".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in joined), np.uint32)
        ends, wanted = np.cumsum(_sizes(self.path)[ids]), np.cumsum([len(p.encode()) for p in words], dtype=np.int64)
        at = np.searchsorted(ends, wanted) + 1
        if words and (at[-1] != len(ids) or (ends[at - 1] != wanted).any()):  # a vocabulary whose tokens are not the bytes of the text
            words, others, at = [], pieces, at[:0]
        packed, stops = ids.astype("<u4").tobytes(), (4 * at).tolist()
        out = {p: packed[a:b] for p, a, b in zip(words, [0, *stops], stops)}
        found = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
        out.update([(p, array("I", e.ids).tobytes()) for p, e in zip(others, found)])
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@cache
def _bytes_of_ids(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level vocabulary stands for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in printable}
    signs |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printable)))}
    tokenizer = encoder(path).tokenizer
    tokens = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    return [bytes(signs[c] for c in t) if all(c in signs for c in t) else t.encode() for t in tokens]


@cache
def _sizes(path: str) -> np.ndarray:
    return np.array([len(b) for b in _bytes_of_ids(path)], np.int64)


def _pieces(text: bytes) -> list[str]:
    return PIECE.findall(text.decode("utf-8", "replace"))


def _plan(text: bytes, given: dict[int, bytes]) -> list[tuple[list[str], bytes | None, list[str]]]:
    """A text as steps (pieces to encode, shared ids or None, all pieces of the shared chunk)."""
    if not given:
        return [(_pieces(text), None, [])]
    steps, window = [], b""
    for number, chunk in enumerate(chunks(text)):
        own = _pieces(chunk)
        if len(own) < 2:  # no certain cut: the window goes on
            window += chunk
            continue
        steps.append((_pieces(window + own[0].encode()), None, []))
        if number in given:
            steps.append(([own[0], own[-1]], given[number], own))
        else:
            steps.append((own[1:-1], None, []))
        window = own[-1].encode()
    return [*steps, (_pieces(window), None, [])]


def _assemble(steps, table) -> bytes:
    out = []
    for pieces, shared, own in steps:
        if shared is None:
            out += map(table.__getitem__, pieces)
            continue
        head, tail = table[pieces[0]], table[pieces[1]]
        out.append(shared[len(head) : len(shared) - len(tail)])
    return b"".join(out)


def _agrees(step, table) -> bool:
    pieces, shared, _ = step
    head, tail = table[pieces[0]], table[pieces[1]]
    return len(shared) >= len(head) + len(tail) and shared.startswith(head) and shared.endswith(tail)


def _pieces_of(plans) -> set[str]:
    return set().union(*(pieces for steps in plans for pieces, _, _ in steps))


def encode_all(texts: list[bytes], given: list[dict[int, bytes]], path: str) -> list[bytes]:
    """The ids of whole texts; `given` has the ids of some of the chunks of each. Texts go in groups of bounded size."""
    return [ids for own in groups_of(texts, GROUP) for ids in _encode_group(texts[own], given[own], path)]


def _encode_group(texts, given, path):
    plans = [_plan(t, g) for t, g in zip(texts, given)]
    table = encoder(path).learn(_pieces_of(plans))
    wrong = set()
    for steps in plans:
        for k, step in enumerate(steps):
            if step[1] is not None and not _agrees(step, table):
                steps[k] = (step[2][1:-1], None, [])
                wrong.update(step[2])
    if wrong:
        table = encoder(path).learn(wrong | _pieces_of(plans))
    return [_assemble(steps, table) for steps in plans]


def _chunk_digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    import xxhash

    found = [[xxhash.xxh3_128_digest(c) for c in chunks(t)] for t in utf8(batch, "_text")]
    counts = [len(f) for f in found]
    rows = np.repeat(np.arange(len(counts)), counts)
    places = np.concatenate([np.arange(n) for n in counts]) if counts else np.empty(0)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(rows)), pa.array(places.astype(np.int32)), pa.array(list(chain(*found)), pa.binary())], ["_key", "_seq", "_chunk"]
    )


def _encode_chunks(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    wanted, digests = [], []
    for text, marks in zip(utf8(batch, "_text"), batch.column(1).to_pylist()):
        own = chunks(text)
        wanted += [own[m["_seq"]] for m in marks]
        digests += [m["_chunk"] for m in marks]
    ids = encode_all(wanted, [{}] * len(wanted), path)
    return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ids, pa.binary())], ["_chunk", "_ids"])


@cache
def _bytes_table(path: str) -> pa.Array:
    return pa.array(_bytes_of_ids(path), pa.large_binary())


def decode_all(texts: list[bytes], path: str) -> list[str]:
    """The texts of ids as made here; bytes that are no UTF-8 become replacement characters."""
    ids = pa.Array.from_buffers(pa.uint32(), sum(map(len, texts)) // 4, [None, pa.py_buffer(b"".join(texts))])
    taken = _bytes_table(path).take(ids)
    ends = np.frombuffer(taken.buffers()[1], np.int64)[np.cumsum([0, *[len(t) // 4 for t in texts]])] if len(ids) else np.zeros(len(texts) + 1, np.int64)
    joined = memoryview(taken.buffers()[2] or b"")
    return [str(joined[a:b], "utf-8", "replace") for a, b in zip(ends.tolist(), ends[1:].tolist())]


def decode(ids: bytes, path: str) -> str:
    return decode_all([ids], path)[0]


def _encode_texts(batch: pa.RecordBatch, path: str):
    texts = utf8(batch, "_text")
    for own in groups_of(texts, GROUP):
        part = batch.slice(own.start, own.stop - own.start)
        given = [{m["_seq"]: m["_ids"] for m in marks or []} for marks in part.column(2).to_pylist()]
        ids = _encode_group(texts[own], given, path)
        counts, decoded = np.array([len(i) // 4 for i in ids], np.int64), decode_all(ids, path)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(counts), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["_key", "n_tokens", "ids", "decoded"]
        )


def text_key(text_column: str = "text") -> Column:
    # The coalesce only says that it is never NULL; without it the two uses of the texts get different filters and no shared exchange.
    # Half of the digest is enough to tell texts apart, and this key is most of what moves with each chunk.
    return F.coalesce(F.unhex(F.substring(F.sha2(text_of(text_column), 256), 1, 32)), F.lit(b""))


def encode_texts(docs: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """One row per distinct text: (_key, n_tokens, ids, decoded), the ids as bytes of little-endian unsigned 32-bit integers."""
    rows = docs.select(text_key(text_column).alias("_key"), text_of(text_column).alias("_text"))
    found = map_batches(rows, _chunk_digests, "_key binary, _seq int, _chunk binary").distinct()
    firsts = found.groupBy("_chunk").agg(F.count("*").alias("_n"), F.min(F.struct("_key", "_seq")).alias("_first")).where("_n > 1")
    # Of chunks that occur more than once: their places. Small, and read twice.
    shared = stored(found.join(firsts, "_chunk").select("_chunk", "_key", "_seq", F.struct("_key", "_seq").eqNullSafe(F.col("_first")).alias("_is_first")), "chunks")
    texts = rows.groupBy("_key").agg(F.first("_text").alias("_text"))
    marks = shared.where("_is_first").groupBy("_key").agg(F.collect_list(F.struct("_seq", "_chunk")).alias("_marks"))
    encoded = map_batches(texts.join(marks, "_key").select("_text", "_marks"), partial(_encode_chunks, path=path), "_chunk binary, _ids binary")
    given = shared.select("_chunk", "_key", "_seq").join(encoded, "_chunk")
    given = given.groupBy("_key").agg(F.collect_list(F.struct("_seq", "_ids")).alias("_given"))
    return map_batches(
        texts.join(given, "_key", "left").select("_key", "_text", "_given"), partial(_encode_texts, path=path), "_key binary, n_tokens bigint, ids binary, decoded string"
    )


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of `docs`: (id, n_tokens, ids_sha256, decoded_sha256) and, if asked for, the ids."""
    texts = encode_texts(docs, path, text_column)
    digests = texts.select(
        "_key",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["ids"] if with_ids else []),
    )
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), text_key(text_column).alias("_key"))
    return rows.join(digests, "_key").drop("_key").withColumnRenamed("_id", id_column)
