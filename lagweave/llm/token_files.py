"""Token ids in files: static range asymmetric numeral systems in independent interleaved blocks.

Format. A folder with three Parquet tables:

* `table`: one row (id, frequency) per symbol that occurs; the frequencies are shared by all blocks and add up to 2^BITS.
* `blocks`: one row per block of up to `block` ids: part, number of the block in its part, first position in the part, number of
  ids, whether it is one of several of a document (`spans`; else its documents are whole), the checkpoint (final states of the lanes),
  the words the lanes put out, a CRC-32 of the ids, and `docs`, the documents with ids in the block in ascending order: doc_id, start in
  the part, number of ids. A block has at most `block` of them.
* `parts`: one row (part, offset) per part, the ids of all parts before it.

A block is coded by itself, so any block can be decoded in parallel and after a seek: the column `docs` tells which blocks hold a
document. Inside a block the ids lie in LANES columns that are coded in lockstep, each with its own 32-bit state, row by row from the
last; words that leave the states go to one stream, in an order the decoder repeats. The states at the end of the encoder are the checkpoint the decoder starts from.

Symbols are 16-bit values: ids of larger vocabularies would take two symbols (`SYMBOLS` bounds them, larger ids are an
error). Every id of the vocabulary that occurs has a frequency of one at least.

Order and positions. Texts are tokenized once and stored. The rows move once, into ranges of (id, hash of the text, place in the
stored table), whose number follows from the count of ids, about `RANGE` of them each, so no range grows with the data and rows with
equal ids are split like others. The blocks are cut where the ranges are sorted, with positions that count from the start of the
range; a running sum over one row per range gives the rest. Blocks end before a document that would not fit, and at the end of a range.

Defined cases: NULL texts are empty; every document ends with the end id, so none is without ids. Ids are numbers. Documents with equal
or NULL ids lie next to each other, NULL first, in the order of a hash of their texts. Repeated rows are written each. An
empty table gives files without rows. A damaged block fails its checksum and raises. Further columns are ignored.
"""

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.shared import fresh_path, stored
from .common import groups_of, map_batches, ship, text_of, utf8

BITS = 20
SYMBOLS = 1 << 16
LANES = 1024
BLOCK = 1 << 18
RANGE = 1 << 24  # ids of a range, two bytes each
STORED = 32  # blocks of a row group, which readers and writers hold at once
LOW = np.uint64(1 << 31)  # lower bound of a state; words of 32 bits
CACHED = 250_000  # words of a generation
TOGETHER = 64  # words of one call
GROUP = 1 << 22  # bytes of text held as words at a time
WORD = 48
#: Small letters of Latin-1 (in UTF-8 0xC3 and 0x9F to 0xB6 or 0xB8 to 0xBF): pieces by themselves, which no normalization changes.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: By byte: 1 for a letter of ASCII, 2 for the second byte of a letter of Latin-1, 3 for a sign of ASCII but the apostrophe.
KINDS = np.zeros(256, np.uint8)
KINDS[33:127], KINDS[ord("'")] = 3, 0
KINDS[48:58], KINDS[65:91], KINDS[97:123] = 0, 1, 1
KINDS[0x80:0xC0], KINDS[[0x97, 0xB7]] = 2, 0


# Tokenizing


def parted(text: bytes) -> bytes:
    """A space between each letter of ASCII or Latin-1 and a sign after it, which begins a piece of its own; apostrophes may begin a short form."""
    signs = np.frombuffer(text, np.uint8)
    kinds = KINDS[signs]
    letter = kinds == 1
    letter[1:] |= (kinds[1:] == 2) & (signs[:-1] == 0xC3)
    ends = np.flatnonzero(letter[:-1] & (kinds[1:] == 3))
    return np.insert(signs, ends + 1, ord(" ")).tobytes() if len(ends) else text


def _pieces(values: pa.LargeBinaryArray, bounds: np.ndarray | None = None) -> list[bytes]:
    """The values, or what stands between the values at `bounds`."""
    offsets, data = np.frombuffer(values.buffers()[1], np.int64)[: len(values) + 1], values.buffers()[2]
    at = (offsets if bounds is None else offsets[bounds]).tolist()
    whole = data.to_pybytes() if data is not None else b""
    return [whole[a:b] for a, b in zip(at, at[1:])]


class WordEncoder:
    """Ids of words, as bytes of 16-bit numbers, for tokenizers that drop white space; with a bounded cache of two generations.

    What is used stays in the younger one; when that is full it becomes the older one, and what was not used since then is gone.

    Words of small Latin letters alone are a piece each and stay as they are under normalization, so where the vocabulary marks ends of
    words they go to the merges directly, many in one call, and the marks part the ids again. Other words take the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        def load():
            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            return tokenizer

        self.tokenizer, self.merges = load(), load()
        self.merges.normalizer = None
        blanks, signs = pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([blanks, signs])
        mark = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(min(SYMBOLS, self.tokenizer.get_vocab_size()))]
        self.last = np.array([bool(mark) and t.endswith(mark) for t in tokens])
        self.known: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}

    def _by_merges(self, words: list[bytes]) -> Iterator[bytes]:
        """The ids of words of `LETTERS`."""
        joined = [b" ".join(words[k : k + TOGETHER]).decode() for k in range(0, len(words), TOGETHER)]
        flat = array("H")
        for e in self.merges.encode_batch_fast(joined, add_special_tokens=False):
            flat.extend(e.ids)
        data = flat.tobytes()
        ends = ((np.flatnonzero(self.last[np.frombuffer(data, np.uint16)]) + 1) * 2).tolist()
        if len(ends) != len(words):
            raise ValueError("a word without the mark of its end")
        return (data[a:b] for a, b in zip([0, *ends], ends))

    def _learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words that the younger generation has not, which then has those of up to `WORD` bytes."""
        out = {w: self.older[w] for w in missing if w in self.older}
        asked = [w for w in missing if w not in out]
        letters = list(filter(LETTERS, asked)) if self.last.any() else []
        others = list(set(asked).difference(letters))
        try:
            out.update(zip(letters, self._by_merges(letters)))
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in others], add_special_tokens=False)
            out.update(zip(others, [array("H", e.ids).tobytes() for e in found]))
        except OverflowError:
            raise ValueError("ids beyond 16 bits") from None
        self.known.update([(w, i) for w, i in out.items() if len(w) <= WORD])
        return out

    def encode(self, texts: list[bytes], end: int) -> list[bytes]:
        """Ids of whole UTF-8 texts. The words are what stands between spaces and line feeds, which such a tokenizer drops.

        It lowers letters, too; A to Z are lowered and signs parted from letters before the lookup, unless the text may hold a special
        token. The different words of all `texts` are looked up once, and their ids are taken by the places of the words.
        """
        if len(self.known) > CACHED:
            self.known, self.older = {b"": b""}, self.known
        plain = [(t if b"<|" in t else parted(t.lower())).replace(b"\n", b" ") for t in texts]
        split = pc.split_pattern(pa.array(plain, pa.large_binary()), " ")
        places = split.flatten().dictionary_encode()
        words = _pieces(places.dictionary)
        found = list(map(self.known.get, words))
        missing = [w for w, ids in zip(words, found) if ids is None]
        if missing:
            learnt = self._learn(missing)
            found = [learnt[w] if ids is None else ids for w, ids in zip(words, found)]
        ids = pa.array(found, pa.large_binary()).take(places.indices)
        last = array("H", [end]).tobytes()
        return [t + last for t in _pieces(ids, split.offsets.to_numpy())]


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _tokenize(batch: pa.RecordBatch, path: str, end: int) -> pa.RecordBatch:
    texts = utf8(batch, "_text")
    ids = [i for own in groups_of(texts, GROUP) for i in _encoder(path).encode(texts[own], end)]
    counts = np.array([len(i) // 2 for i in ids], np.int64)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), pa.array(ids, pa.binary())], ["_id", "_tie", "_n", "_ids"])


def tokenized(docs: DataFrame, path: str, end: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(_id, _tie, _n, _ids): 16-bit ids of every text with the end id."""
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), F.xxhash64(text_of(text_column)).alias("_tie"), text_of(text_column).alias("_text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, _tie bigint, _n bigint, _ids binary"
    return map_batches(rows, partial(_tokenize, path=path, end=end), schema)


# Frequencies


def _count(batches):
    counts = np.zeros(SYMBOLS, np.int64)
    for batch in batches:
        for ids in batch.column(0).to_pylist():
            counts += np.bincount(np.frombuffer(ids, np.uint16), minlength=SYMBOLS) if len(ids) > SYMBOLS else 0
        small = b"".join(ids for ids in batch.column(0).to_pylist() if len(ids) <= SYMBOLS)
        counts += np.bincount(np.frombuffer(small, np.uint16), minlength=SYMBOLS)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["id", "n"])


def scaled(counts: dict[int, int], bits: int = BITS) -> dict[int, int]:
    """Frequencies of one at least that add up to 2^bits, nearly in proportion."""
    total = sum(counts.values())
    if not total:
        return {}
    size = 1 << bits
    out = {i: max(1, n * size // total) for i, n in counts.items()}
    rest = size - sum(out.values())
    for i in sorted(out, key=lambda i: (-counts[i], i)):  # the frequent ones take what is left or missing
        change = rest if rest > 0 else max(rest, 1 - out[i] + out[i] // 2)
        out[i] += change
        rest -= change
        if not rest:
            break
    return out


class Code:
    """The shared table, ready for coding."""

    def __init__(self, frequencies: dict[int, int]):
        ids = np.array(sorted(frequencies), np.int64)
        self.frequency, self.start = np.zeros(SYMBOLS, np.uint64), np.zeros(SYMBOLS, np.uint64)
        own = np.array([frequencies[i] for i in ids.tolist()], np.uint64)
        self.frequency[ids] = own
        self.start[ids] = np.cumsum(own) - own
        self.symbol = np.repeat(ids, own.astype(np.int64)).astype(np.uint16)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(states, words) of a block."""
        rows = -(-len(ids) // LANES)
        states, out = np.full(LANES, LOW, np.uint64), []
        for r in range(rows - 1, -1, -1):
            row = ids[r * LANES : (r + 1) * LANES]
            x, f = states[: len(row)], self.frequency[row]
            full = x >= f << np.uint64(63 - BITS)
            if full.any():
                out.append(x[full].astype(np.uint32)[::-1])
                x = np.where(full, x >> np.uint64(32), x)
            quotient = x // f
            states[: len(row)] = (quotient << np.uint64(BITS)) + (x - quotient * f) + self.start[row]
        words = np.concatenate(out)[::-1] if out else np.empty(0, np.uint32)
        return states.astype("<u8").tobytes(), words.astype("<u4").tobytes()

    def decode(self, states: bytes, words: bytes, n: int) -> np.ndarray:
        x, stream, at = np.frombuffer(states, "<u8").copy(), np.frombuffer(words, "<u4"), 0
        out = np.empty(n, np.uint16)
        for r in range(-(-n // LANES)):
            width = min(LANES, n - r * LANES)
            now = x[:width]
            slot = now & np.uint64((1 << BITS) - 1)
            row = self.symbol[slot.astype(np.int64)]
            out[r * LANES : r * LANES + width] = row
            now = self.frequency[row] * (now >> np.uint64(BITS)) + slot - self.start[row]
            low = now < LOW
            k = int(low.sum())
            if k:
                now[low] = now[low] << np.uint64(32) | stream[at : at + k]
                at += k
            x[:width] = now
        return out


# Writing and reading


DOC = "struct<doc_id: bigint, start: bigint, n_tokens: bigint>"
BLOCKS = f"part int, number int, first bigint, n int, spans boolean, states binary, words binary, crc bigint, docs array<{DOC}>"


def _blocks(batches, code: Code, block: int):
    """Blocks of a part, whose rows arrive in order. A document of over `block` ids has blocks of its own."""
    number, first, waiting, held, size = 0, 0, [], [], 0
    entry = pa.struct([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens")])
    schema = pa.schema(
        [("part", pa.int32()), ("number", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("spans", pa.bool_())]
        + [("states", pa.binary()), ("words", pa.binary()), ("crc", pa.int64()), ("docs", pa.list_(entry))]
    )

    def cut(ids: bytes, docs: list[dict], spans: bool):
        nonlocal number, first
        data = np.frombuffer(ids, np.uint16)
        row = [part, number, first, len(data), spans, *code.encode(data), zlib.crc32(data.astype("<u2").tobytes()), docs]
        number, first = number + 1, first + len(data)
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema)

    for batch in batches:
        for part, i, n, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if held and size + n > block:
                yield cut(b"".join(waiting), held, False)
                waiting, held, size = [], [], 0
            doc = {"doc_id": i, "start": first + size, "n_tokens": n}
            if n > block:
                for k in range(0, 2 * n, 2 * block):
                    yield cut(ids[k : k + 2 * block], [doc], True)
            else:
                waiting.append(ids)
                held.append(doc)
                size += n
    if held:
        yield cut(b"".join(waiting), held, False)


def _ranges(total: int, parallel: int) -> int:
    """How many ranges `total` ids are dealt to: of `RANGE` ids, or smaller ones where not every core had one."""
    return max(-(-total // RANGE), min(parallel, -(-total // BLOCK)), 1)


def write_files(docs: DataFrame, path: str, vocabulary: str, end: int, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK) -> None:
    """Tokenize `docs` and write the files below `path`."""
    spark = docs.sparkSession
    tokens = stored(tokenized(docs, vocabulary, end, id_column, text_column), "tokens")
    counted = tokens.select("_ids").mapInArrow(_count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    counts = {r["id"]: r["n"] for r in counted.collect()}  # at most 2^16 rows
    code = scaled(counts)
    spark.createDataFrame(sorted(code.items()), "id int, frequency int").coalesce(1).write.parquet(f"{path}/table")

    order = ["_id", "_tie", "_at"]
    rows = tokens.withColumn("_at", F.monotonically_increasing_id())  # parts equal rows, too
    ranged = rows.repartitionByRange(_ranges(sum(counts.values()), spark.sparkContext.defaultParallelism), *order).sortWithinPartitions(*order)
    placed = ranged.select(F.spark_partition_id().alias("part"), F.col("_id").cast("bigint"), "_n", "_ids")
    placed.mapInArrow(partial(_blocks, code=Code(code), block=block), BLOCKS).write.option("parquet.block.row.count.limit", STORED).parquet(f"{path}/blocks")

    totals = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).write.parquet(f"{path}/parts")


def read_code(spark: SparkSession, path: str) -> Code:
    return Code({r["id"]: r["frequency"] for r in spark.read.parquet(f"{path}/table").collect()})  # at most 2^16 rows


def _decoded(code: Code, states: bytes, words: bytes, n: int, crc: int) -> np.ndarray:
    ids = code.decode(states, words, n)
    if zlib.crc32(ids.astype("<u2").tobytes()) != crc:
        raise ValueError("a damaged block")
    return ids


def _slices(batches, code: Code):
    """Of every block the pieces of its documents: (doc_id, start, n_tokens, at, ids)."""
    for batch in batches:
        rows = batch.to_pydict()
        for offset, first, n, states, words, crc, docs in zip(*(rows[c] for c in ("offset", "first", "n", "states", "words", "crc", "docs"))):
            ids = _decoded(code, states, words, n, crc).astype("<u4")
            low = [max(d["start"], first) for d in docs]
            parts = [ids[a - first : min(d["start"] + d["n_tokens"], first + n) - first].tobytes() for a, d in zip(low, docs)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d["doc_id"] for d in docs], pa.int64()), pa.array([offset + d["start"] for d in docs], pa.int64())]
                + [pa.array([d["n_tokens"] for d in docs], pa.int64()), pa.array([offset + a for a in low], pa.int64()), pa.array(parts, pa.binary())],
                ["doc_id", "start", "n_tokens", "at", "ids"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the ids of every document, as bytes of little-endian unsigned 32-bit integers.

    Every block is decoded once, with its documents beside it. Only documents of several blocks are put together in a shuffle.
    The offsets that are broadcast are 12 bytes per `RANGE` ids.
    """
    ship(spark)
    parts = spark.read.schema("part int, offset bigint").parquet(f"{path}/parts")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").join(F.broadcast(parts), "part")
    pieces_of = partial(_slices, code=read_code(spark, path))

    def decoded(chosen: Column) -> DataFrame:
        rows = blocks.where(chosen).select("offset", "first", "n", "states", "words", "crc", "docs")
        return rows.mapInArrow(pieces_of, "doc_id bigint, start bigint, n_tokens bigint, at bigint, ids binary")

    pieces = decoded(F.col("spans")).groupBy("doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("pieces"))
    joined = F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")
    return decoded(~F.col("spans")).select("doc_id", "start", "n_tokens", "ids").union(pieces.select("doc_id", "start", "n_tokens", joined))


def write_and_read(docs: DataFrame, vocabulary: str, end: int, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of `docs`, out of the files: (doc_id, start, n_tokens, ids_crc32)."""
    path = fresh_path(docs.sparkSession, "token-files")
    write_files(docs, path, vocabulary, end, id_column, text_column, block)
    read = read_documents(docs.sparkSession, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
