"""Substring dedup: relative Lempel-Ziv parsing of documents against indexed reference blocks.

A factor is a run of words that a document shares with an earlier document (one with a
smaller id), at least ``window`` words long. The parse goes from left to right: a factor goes on
while the next window continues it in the same reference, the first document that has the
window, and ends where that document does not have the next one. The windows across a
factor's end are looked up on their own, so no shared window is lost at a boundary. A factor is
therefore the longest in its reference, but another reference may have had a longer one.

The reference is the whole corpus, indexed in blocks by hash; every block is bounded, and
documents come in chunks of about ``CHUNK_BYTES`` of text:

1. Each chunk asks the blocks about its anchors. A window's anchor is the least hash of its
   ``seed``-word runs, so equal windows have equal anchors, and neighbours mostly share one:
   about a fifth as many anchors as windows. A block answers which of them other chunks have.
2. Windows with such an anchor go to the blocks with a 96-bit hash. Within a chunk only the
   window of the smallest id is sent, so a passage that a third of all documents share sends
   one entry a chunk. The block returns the first document, and the place in it, for each
   window that a smaller id has.
3. Each chunk parses its documents into factors along these places.

Texts are shuffled once, by chunk; the three passes read the same exchange. Entries travel
as packed arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from daywatch.llm.blobs import joined, pack
from daywatch.llm.text import free_name
from daywatch.session import shuffle_width

WINDOW = 13
SEED = 6
CHUNK_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).max

FACTOR = StructType(
    [
        StructField("start", IntegerType()),
        StructField("length", IntegerType()),
        StructField("ref_id", LongType()),
        StructField("ref_start", IntegerType()),
    ]
)
RESULT = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_removed", LongType()),
        StructField("kept_text", StringType()),
        StructField("factors", ArrayType(FACTOR)),
    ]
)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_ASKED = ["u8", "u4", "i8", "u4", "u4"]
_FOUND = ["u4", "u4", "i8", "u4"]


class Chunk:
    """The documents of a chunk in an order that depends on their ids and texts only."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, window: int):
        ids = table.column(id_col).cast(pa.int64())
        keys = np.array(ids.fill_null(NO_ID).to_numpy(), np.int64)
        texts = table.column(text_col).cast(pa.binary()).to_pylist()
        self.order = sorted(range(len(texts)), key=lambda i: (keys[i], texts[i] or b""))
        self.ids = keys[self.order]
        self.texts = [texts[i] or b"" for i in self.order]
        self.window = window

    def hash_words(self) -> None:
        digest = xxhash.xxh64_intdigest
        parts = [np.fromiter(map(digest, t.split()), np.uint64) for t in self.texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        self.hashes = np.concatenate([*parts, np.zeros(0, np.uint64)])
        first = np.cumsum(sizes) - sizes
        # Starts of windows that end within their document, with the row and place they have.
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(self.hashes)) - first[row]
        inside = place + self.window <= sizes[row]
        self.at = np.nonzero(inside)[0]
        self.row = row[inside].astype(np.uint32)
        self.place = place[inside].astype(np.uint32)

    def runs(self, size: int, base: np.uint64) -> np.ndarray:
        """A hash of every ``size`` words in a row."""
        n = len(self.hashes) - size + 1
        out = np.zeros(max(n, 0), np.uint64)
        for j in range(size if n > 0 else 0):
            out *= base
            out += self.hashes[j : j + n]
        out ^= out >> np.uint64(33)
        out *= _MIX
        out ^= out >> np.uint64(29)
        return out

    def anchors(self, seed: int) -> np.ndarray:
        """For each window the least hash of its seeds."""
        if not len(self.at):
            return np.zeros(0, np.uint64)
        seeds = self.runs(seed, _BASES[0])
        n = len(self.hashes) - self.window + 1
        least = seeds[:n].copy()
        for j in range(1, self.window - seed + 1):
            np.minimum(least, seeds[j : j + n], out=least)
        return least[self.at]

    def anchor_owners(self, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors of all windows; the distinct ones, and which of them several rows have."""
        anchor = self.anchors(seed)
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (self.row[1:] != self.row[:-1])
        a, r = anchor[new], self.row[new]
        order = np.lexsort((r, a))
        a, r = a[order], r[order]
        first = np.ones(len(a), bool)
        first[1:] = a[1:] != a[:-1]
        begin = np.nonzero(first)[0]
        end = np.append(begin[1:], len(a)) - 1
        return anchor, a[begin], r[begin] != r[end] if len(a) else np.zeros(0, bool)


def _by_block(blocks: int, hashes: np.ndarray, arrays: list[np.ndarray]):
    """The arrays dealt to blocks by hash, in order within each."""
    if not len(hashes):
        return
    block = (hashes % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block = block[order]
    cuts = np.nonzero(np.diff(block))[0] + 1
    for part in np.split(order, cuts):
        yield int(hashes[part[0]] % np.uint64(blocks)), [a[part] for a in arrays]


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_MESSAGE = pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("data", pa.binary())])
MESSAGE, ANSWER = "block long, chunk long, kind int, data binary", "chunk long, data binary"


def answer_anchors(table: pa.Table) -> pa.Table:
    """Block: for each chunk, those of its anchors that another chunk, or several of its rows, have."""
    chunks = table.column("chunk").to_pylist()
    parts = [joined([d], ["u8", "u1"]) for d in table.column("data").to_pylist()]
    every = np.concatenate([p[0] for p in parts])
    count = np.concatenate([p[1] for p in parts]).astype(np.int64) + 1
    order = np.argsort(every)
    ranked = every[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    totals = np.add.reduceat(count[order], np.nonzero(first)[0]) if len(ranked) else count
    live = np.zeros(len(every), bool)
    live[order] = (totals > 1)[np.cumsum(first) - 1] if len(ranked) else False
    rows, at = [], 0
    for chunk, p in zip(chunks, parts):
        hit = p[0][live[at : at + len(p[0])]]
        at += len(p[0])
        if len(hit):
            rows.append((chunk, pack(hit)))
    return _rows(_ANSWER, rows)


def answer_windows(table: pa.Table) -> pa.Table:
    """Block: the first document of each window, for windows of larger ids; others pass through."""
    rows, chunks, parts = [], [], []
    for chunk, kind, data in zip(*[table.column(c).to_pylist() for c in ("chunk", "kind", "data")]):
        if kind:
            rows.append((chunk, data))
        else:
            chunks.append(chunk)
            parts.append(joined([data], _ASKED))
    if parts:
        sizes = [len(p[0]) for p in parts]
        high, low, ids, row, place = [np.concatenate(x) for x in zip(*parts)]
        order = np.lexsort((place, ids, low, high))
        first = _firsts(high[order], low[order])
        lead = order[np.nonzero(first)[0]][np.cumsum(first) - 1]
        ref = np.empty(len(order), np.int64)
        ref[order] = lead
        copied = ids > ids[ref]
        at = 0
        for chunk, size in zip(chunks, sizes):
            hit = at + np.nonzero(copied[at : at + size])[0]
            at += size
            if len(hit):
                rows.append((chunk, pack(row[hit], place[hit], ids[ref[hit]], place[ref[hit]])))
    return _rows(_ANSWER, rows)


def _firsts(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    first = np.ones(len(high), bool)
    first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    return first


def parsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` and a struct ``parsed``: ``n_words, n_removed, kept_text, factors``.

    Words are runs of other characters than ASCII white space, unchanged. A window is
    ``window`` words in a row; words of windows that a row with a smaller id has anywhere are
    removed, judged on the input. ``factors`` has the runs with the reference they follow (start
    and length in words; runs may overlap). ``kept_text`` has the other words, joined by spaces.

    A null text has no words; texts of any length are parsed whole. A null id counts as larger than any other and is no one's
    reference; rows with equal ids are no references of each other. Documents shorter than a
    window keep all words. Empty tables give empty results. If ``parsed`` is taken, the
    struct's name gets an underscore before it.
    """
    seed = min(SEED, window)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    width = shuffle_width(docs.sparkSession)
    chunks = max(width, -(-total // CHUNK_BYTES))
    blocks = chunks
    chunk_col, out_col = free_name(docs, "chunk"), free_name(docs, "parsed")
    placed = docs.withColumn(chunk_col, F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)).cast("long"))
    placed = placed.repartition(chunks, chunk_col)

    def ask_anchors(table: pa.Table) -> pa.Table:
        me = table.column(chunk_col)[0].as_py()
        chunk = Chunk(table, id_col, text_col, window)
        chunk.hash_words()
        _, distinct, several = chunk.anchor_owners(seed)
        parts = _by_block(blocks, distinct, [distinct, several.astype(np.uint8)])
        return _rows(_MESSAGE, [(b, me, 0, pack(*p)) for b, p in parts])

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(_MESSAGE, [])
        me = table.column(chunk_col)[0].as_py()
        chunk = Chunk(table, id_col, text_col, window)
        chunk.hash_words()
        anchor, distinct, several = chunk.anchor_owners(seed)
        (elsewhere,) = joined(answers.column("data").to_pylist(), ["u8"])
        live = np.isin(anchor, np.concatenate([elsewhere, distinct[several]]))
        at, row, place = chunk.at[live], chunk.row[live], chunk.place[live]
        high = chunk.runs(window, _BASES[0])[at]
        low = (chunk.runs(window, _BASES[1])[at] >> np.uint64(32)).astype(np.uint32)
        ids = chunk.ids[row]
        order = np.lexsort((place, row, low, high))
        first = _firsts(high[order], low[order])
        ref = np.empty(len(order), np.int64)
        ref[order] = order[np.nonzero(first)[0]][np.cumsum(first) - 1] if len(order) else order
        known = ids > ids[ref]
        rows = [(me, me, 1, pack(row[known], place[known], ids[ref[known]], place[ref[known]]))] if known.any() else []
        asked = [x[~known] for x in (high, low, ids, row, place)]
        return _rows(_MESSAGE, rows + [(b, me, 0, pack(*p)) for b, p in _by_block(blocks, asked[0], asked)])

    columns = docs.columns
    schema = StructType([*docs.schema.fields, StructField(out_col, RESULT)])

    def parse(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = table.drop_columns([chunk_col])
        chunk = Chunk(table, id_col, text_col, window)
        row, place, ref_id, ref_place = joined(answers.column("data").to_pylist(), _FOUND)
        order = np.lexsort((place, row))
        row, place, ref_id, ref_place = row[order], place[order], ref_id[order], ref_place[order]
        new = np.ones(len(row), bool)
        new[1:] = (
            (row[1:] != row[:-1])
            | (place[1:] != place[:-1] + 1)
            | (ref_id[1:] != ref_id[:-1])
            | (ref_place[1:] != ref_place[:-1] + 1)
        )
        begin = np.nonzero(new)[0]
        length = np.append(begin[1:], len(row))[: len(begin)] - begin + window - 1
        start = place[begin].astype(np.int64)
        # Words kept and removed, document by document.
        upto = np.searchsorted(row[begin], np.arange(len(chunk.texts) + 1))
        n_words, n_removed, kept = [], [], []
        for i, text in enumerate(chunk.texts):
            words = text.split()
            n_words.append(len(words))
            mine = slice(upto[i], upto[i + 1])
            if upto[i] < upto[i + 1]:
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, start[mine], 1)
                np.add.at(edges, start[mine] + length[mine], -1)
                covered = np.cumsum(edges[:-1]) > 0
                n_removed.append(int(covered.sum()))
                words = [words[j] for j in np.nonzero(~covered)[0].tolist()]
            else:
                n_removed.append(0)
            kept.append(b" ".join(words))
        factors = pa.StructArray.from_arrays(
            [
                pa.array(start.astype(np.int32)),
                pa.array(length.astype(np.int32)),
                pa.array(ref_id[begin]),
                pa.array(ref_place[begin].astype(np.int32)),
            ],
            names=["start", "length", "ref_id", "ref_start"],
        )
        out = pa.StructArray.from_arrays(
            [
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
                pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), factors),
            ],
            names=["n_words", "n_removed", "kept_text", "factors"],
        )
        return table.take(pa.array(chunk.order, pa.int64())).select(columns).append_column(out_col, out)

    questions = placed.groupBy(chunk_col).applyInArrow(ask_anchors, MESSAGE)
    shared = questions.groupBy("block").applyInArrow(answer_anchors, ANSWER)
    windows = placed.groupBy(chunk_col).cogroup(shared.groupBy("chunk")).applyInArrow(ask_windows, MESSAGE)
    found = windows.groupBy("block").applyInArrow(answer_windows, ANSWER)
    return placed.groupBy(chunk_col).cogroup(found.groupBy("chunk")).applyInArrow(parse, schema)


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", window: int = WINDOW
) -> DataFrame:
    """``docs`` with the repeated words removed; texts without any stay as they are.

    Where the table has ``chars_col``, it gets the length of changed texts.
    """
    out = free_name(docs, "parsed")
    rows = parsed(docs, id_col, text_col, window)
    changed, kept = F.col(out)["n_removed"] > 0, F.col(out)["kept_text"]
    new = {text_col: F.when(changed, kept).otherwise(F.col(text_col))}
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        new[chars_col] = F.when(changed, F.length(kept).cast(kind)).otherwise(F.col(chars_col))
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
