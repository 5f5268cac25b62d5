"""Fill-in-middle transformation by displacement scatter.

A text is cut after two numbers of lines into prefix, middle and suffix, which an output holds in another order behind markers. The cuts of a
whole group of texts are found by scans over its bytes. Every byte of the group moves by an offset that changes only at cuts, so a
difference array with the changes, summed up, gives each byte's offset, and one scatter builds all outputs. Going back, the markers in the outputs give the
parts, the same sums give the place each byte of the text comes from, and one gather restores them. Sums run over windows
of `WINDOW` bytes that hand on their last offset, so index arrays stay small beside a text of any length.

The two hashes that place the cuts and the two that choose the form come from the SHA-256 of seed and id: they do not depend on
partitions, and a lost task gives the same rows again.

Defined cases: a NULL text is empty; empty texts and texts that hold a marker stay plain. A NULL id is hashed as an empty string. Rows that
repeat an id are cut by the same hashes. An empty table gives no rows. Lines end with a line feed only. Further columns are ignored.
"""

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import groups_of, map_batches, ship, text_of, utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3  # bytes of a marker
GROUP = 1 << 20  # bytes of texts at a time
WINDOW = 1 << 20  # bytes summed at a time
SEED = 7
RATE = 100  # of 100 texts, how many are transformed
SUFFIX_FIRST = 50  # of 100 transformed texts, how many begin with the suffix


def offsets(at: np.ndarray, shift: np.ndarray, size: int):
    """(begin, places moved) of each window of `size` bytes: a byte moves by the `shift` of the last entry of `at`, in order, up to it."""
    change = np.diff(shift, prepend=0)
    carried = 0
    for begin in range(0, size, WINDOW):
        end = min(begin + WINDOW, size)
        own = slice(*np.searchsorted(at, [begin, end]))
        difference = np.zeros(end - begin, np.int64)
        difference[0] = carried
        np.add.at(difference, at[own] - begin, change[own])  # parts may be empty: their changes add up
        moved = np.cumsum(difference, out=difference)
        carried = int(moved[-1])
        moved += np.arange(begin, end)
        yield begin, end, moved


def scatter(data: np.ndarray, at: np.ndarray, shift: np.ndarray, out: np.ndarray) -> None:
    for begin, end, to in offsets(at, shift, len(data)):
        out[to] = data[begin:end]


def gather(data: np.ndarray, at: np.ndarray, shift: np.ndarray, out: np.ndarray) -> None:
    for begin, end, origin in offsets(at, shift, len(out)):
        out[begin:end] = data[origin]


def marks(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and texts of all markers; `first` has the bounds of the texts."""
    place = np.flatnonzero(data[:-2] == PREFIX[0]) if len(data) > 2 else np.empty(0, np.int64)
    letter = data[place + 1]
    place = place[(data[place + 2] == PREFIX[2]) & ((letter == PREFIX[1]) | (letter == SUFFIX[1]) | (letter == MIDDLE[1]))]
    text = np.searchsorted(first, place, "right") - 1
    inside = place + MARK <= first[text + 1]
    return place[inside], text[inside]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def line_cuts(data: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text, and where prefix and middle end; `hashes` has two columns."""
    ends = np.flatnonzero(data == 10) + 1
    before = np.searchsorted(ends, first, "right")
    full = np.diff(before)
    open_end = (np.diff(first) > 0) & (data[first[1:] - 1] != 10) if len(data) else np.zeros(len(full), bool)
    lines = full + open_end
    units = np.sort(hashes % (lines + 1)[:, None], axis=1)
    padded = np.append(ends, 0)
    cuts = np.where(units > full[:, None], first[1:, None], padded[np.minimum(before[:-1, None] + units - 1, len(ends))])
    return lines, *np.where(units == 0, first[:-1, None], cuts).T


def characters(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points of the parts [begin, end), which follow one another."""
    starts = np.append((data & 0xC0) != 0x80, False)
    bounds = np.column_stack([begin, end]).ravel()
    return np.where(begin < end, np.add.reduceat(starts, bounds, dtype=np.int64)[::2], 0) if len(begin) else np.empty(0, np.int64)


def text_array(data: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(data)])


def transform(texts: list[bytes], hashes: np.ndarray, rate: int, suffix_first: int):
    """(lines, form, prefix characters, middle characters, outputs) of texts; `hashes` has four columns."""
    data, first = joined(texts)
    lines, one, two = line_cuts(data, first, hashes[:, :2])
    plain = (np.diff(first) == 0) | (hashes[:, 2] % 100 >= rate)
    plain[marks(data, first)[1]] = True
    spm = ~plain & (hashes[:, 3] % 100 < suffix_first)
    begin, end = first[:-1], first[1:]
    prefix, middle, suffix = one - begin, two - one, end - two
    size = np.diff(first) + np.where(plain, 0, 3 * MARK)
    goal = np.cumsum(np.append(0, size))
    # Where each part goes within its output, and from there how far its bytes move.
    to_prefix = np.where(plain, 0, np.where(spm, 2 * MARK + suffix, MARK))
    to_suffix = np.where(plain, prefix + middle, np.where(spm, MARK, 2 * MARK + prefix))
    to_middle = np.where(plain, prefix, 3 * MARK + prefix + suffix)
    start = goal[:-1]
    at = np.column_stack([begin, one, two]).ravel()
    shift = np.column_stack([start + to_prefix - begin, start + to_middle - one, start + to_suffix - two]).ravel()
    out = np.empty(goal[-1], np.uint8)
    scatter(data, at, shift, out)
    for mark, where in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        places = (start + where - MARK)[~plain]
        out[places[:, None] + np.arange(MARK)] = np.frombuffer(mark, np.uint8)
    counts = [pa.array(characters(data, a, b), pa.int64(), mask=plain) for a, b in ((begin, one), (one, two))]
    return lines, np.where(plain, "plain", np.where(spm, "spm", "psm")), *counts, text_array(out, goal)


def rebuild(outputs: list[bytes], forms: list[str]) -> pa.Array:
    """The texts that outputs of these forms were made from."""
    data, first = joined(outputs)
    plain = np.array([f == "plain" for f in forms], bool)
    place, text = marks(data, first)
    place = place[~plain[text]].reshape(-1, 3)
    begin, end = first[:-1], first[1:]
    # Parts in the order of the output: second marker, third marker, end of the output.
    ends = np.column_stack([place[:, 1:], end[~plain]])
    spm = np.array([f == "spm" for f in forms], bool)[~plain]
    number = np.where(spm[:, None], [1, 2, 0], [0, 2, 1])  # which parts are prefix, middle and suffix
    starts = np.take_along_axis(place + MARK, number, 1)
    sizes = np.take_along_axis(ends - place - MARK, number, 1)
    parts, lengths = np.column_stack([begin, end, end]), np.zeros((len(plain), 3), np.int64)
    lengths[:, 0] = end - begin
    parts[~plain], lengths[~plain] = starts, sizes
    goal = np.cumsum(np.append(0, lengths.sum(axis=1)))
    at = np.cumsum(np.append(0, lengths.ravel()))[:-1]
    out = np.empty(goal[-1], np.uint8)
    gather(data, at, parts.ravel() - at, out)
    return text_array(out, goal)


def _transformed(batch: pa.RecordBatch, rate: int, suffix_first: int):
    texts = utf8(batch, "_text")
    hashes = np.column_stack([batch.column(f"_h{j}").to_numpy() for j in range(4)])
    for own in groups_of(texts, GROUP):
        n, form, prefix, middle, output = transform(texts[own], hashes[own], rate, suffix_first)
        ids = batch.column(0).slice(own.start, own.stop - own.start)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), prefix, middle, output.cast(pa.string())],
            ["_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def fill_middle(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): every text transformed; n is its number of lines."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * j + 1, 8), 16, 10).cast("bigint").alias(f"_h{j}") for j in range(4)]
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), text_of(text_column).alias("_text"), *hashes)
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return map_batches(rows, partial(_transformed, rate=rate, suffix_first=suffix_first), schema).withColumnRenamed("_id", id_column)


def _restored(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    texts, forms = [(x or "").encode() for x in outputs.to_pylist()], forms.to_pylist()
    return pa.concat_arrays([rebuild(texts[own], forms[own]).cast(pa.string()) for own in groups_of(texts, GROUP)])


def restored(rows: DataFrame, output: str = "output", form: str = "form") -> Column:
    """The text that an output of the given form was made from, from these two alone."""
    ship(rows.sparkSession)
    return F.arrow_udf(_restored, "string")(F.col(output), F.col(form))


def transform_and_restore(docs: DataFrame) -> DataFrame:
    """Digests of every output and of the text restored from it."""
    rows = fill_middle(docs)
    return rows.withColumn("text", restored(rows)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"),
    )


ORACLE_SQL = rf"""
WITH rows AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), units AS (
    SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u,
           [('0x' || h[8 * j + 1 : 8 * j + 8])::BIGINT FOR j IN [0, 1, 2, 3]] AS g FROM rows
), cuts AS (
    SELECT *, least(g[1] % (len(u) + 1), g[2] % (len(u) + 1)) AS one, greatest(g[1] % (len(u) + 1), g[2] % (len(u) + 1)) AS two,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= {RATE} THEN 'plain'
                WHEN g[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
    FROM units
), parts AS (
    SELECT doc_id, t, form, len(u) AS n, array_to_string(u[1:one], '') AS p, array_to_string(u[one + 1:two], '') AS m,
           array_to_string(u[two + 1:len(u)], '') AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
           AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
