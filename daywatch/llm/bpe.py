"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

The split pattern (contractions; letters, digits or other signs with one space before them;
white space, less its last character before a word) is run without a regular expression.
Arrays of code points become arrays of classes, in which what the pattern looks ahead for is
already settled: a contraction's apostrophe, and the last white space before a word. What is
left is a small automaton. Each class is a function on its states; functions compose
associatively, and their closure is small enough for one table, so states at all positions
come from a blocked prefix scan of table lookups. Slices between the boundaries are merged
once each and cached; the end offset of each token's bytes is kept for decoding.
"""

from __future__ import annotations

import base64
import heapq
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from daywatch.llm.text import free_name, pieces, texts_of, with_columns

# Classes of characters.
LETTER, DIGIT, OTHER, ONE_MORE, TWO_MORE, BLANK, LAST_SPACE, LAST_BLANK, END = range(9)
# States after a character: a break, within a run, after the space before a word, within a contraction.
BREAK, LETTERS, DIGITS, OTHERS, BLANKS, SPACE, NEED_1, NEED_2 = range(8)
# Unicode's White_Space property, and the contractions' letters.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE_LETTER, TWO_LETTERS = "stmd", ["re", "ve", "ll"]

SENTINEL = sys.maxunicode + 1
BLOCK = 64
#: Slices whose ids a worker keeps at most.
CACHED = 400_000
#: Slices longer than this are merged with a heap.
LONG = 80
#: Text bytes split at once: arrays over code points hold some forty times as much.
SPLIT_BYTES = 1 << 20


def class_table() -> np.ndarray:
    """The class of every code point, before looking ahead; the sentinel ends a text."""
    table = np.full(SENTINEL + 1, OTHER, np.uint8)
    for code in range(SENTINEL):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            table[code] = LETTER if kind == "L" else DIGIT
    table[WHITE] = BLANK
    table[SENTINEL] = END
    return table


def step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a character of a class, and whether a token begins before it."""
    if kind == LETTER:
        if state in (NEED_1, NEED_2):
            return (BREAK if state == NEED_1 else NEED_1), False
        return LETTERS, state not in (LETTERS, SPACE)
    if kind == DIGIT:
        return DIGITS, state not in (DIGITS, SPACE)
    if kind in (OTHER, ONE_MORE, TWO_MORE):
        if kind == OTHER or state in (OTHERS, SPACE):
            return OTHERS, state not in (OTHERS, SPACE)
        return (NEED_1 if kind == ONE_MORE else NEED_2), True
    if kind == BLANK:
        return BLANKS, state != BLANKS
    return {LAST_SPACE: SPACE, LAST_BLANK: BREAK, END: BREAK}[kind], True


class Splitter:
    """Token boundaries of many texts at once."""

    def __init__(self) -> None:
        self.classes = class_table()
        functions = [tuple(step(s, k)[0] for s in range(8)) for k in range(9)]
        self.begins = np.array([[step(s, k)[1] for k in range(9)] for s in range(8)])
        known = {f: i for i, f in enumerate(dict.fromkeys(functions))}
        generators = list(known)
        todo = list(known)
        while todo:
            f = todo.pop()
            for g in generators:
                h = tuple(g[s] for s in f)
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
        every = list(known)
        n = len(every)
        self.of_class = np.array([known[f] for f in functions], np.uint16)
        self.acts = np.array(every, np.uint8)
        # then[a, b]: b after a
        self.then = np.array([[known[tuple(g[s] for s in f)] for g in every] for f in every], np.uint16)
        self.size = n

    def scan(self, functions: np.ndarray) -> np.ndarray:
        """The composition of all functions up to each place, that one included."""
        n = len(functions)
        if n <= BLOCK:
            out = functions.copy()
            for i in range(1, n):
                out[i] = self.then[out[i - 1], out[i]]
            return out
        rows = -(-n // BLOCK)
        grid = np.zeros(rows * BLOCK, np.uint16)
        grid[:n] = functions
        grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
        flat = self.then.reshape(-1)
        for j in range(1, BLOCK):
            grid[j] = flat[grid[j - 1].astype(np.int32) * self.size + grid[j]]
        before = self.scan(grid[-1])[:-1]
        grid[:, 1:] = flat[before.astype(np.int32) * self.size + grid[:, 1:]]
        return np.ascontiguousarray(grid.T).reshape(-1)[:n]

    def classify(self, codes: np.ndarray) -> np.ndarray:
        """Classes with everything that the pattern looks ahead for; the last code is the sentinel."""
        kind = self.classes[codes]
        after = np.append(kind[1:], np.uint8(END))
        last = (kind == BLANK) & (after != BLANK) & (after != END)
        out = kind.copy()
        out[last] = np.where(codes[last] == 32, LAST_SPACE, LAST_BLANK)
        at = np.nonzero(codes == ord("'"))[0]
        if len(at):
            one = codes[np.minimum(at + 1, len(codes) - 1)]
            two = codes[np.minimum(at + 2, len(codes) - 1)]
            out[at[np.isin(one, [ord(c) for c in ONE_LETTER])]] = ONE_MORE
            for a, b in TWO_LETTERS:
                out[at[(one == ord(a)) & (two == ord(b))]] = TWO_MORE
        return out

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Whether a token begins at each code; sentinels begin none."""
        kind = self.classify(codes)
        states = self.acts[self.scan(self.of_class[kind]), BREAK]
        before = np.append(np.uint8(BREAK), states[:-1])
        return self.begins[before, kind] & (kind != END)

    def split(self, texts: list[bytes]) -> tuple[bytes, list[int], list[int]]:
        """All bytes, the byte offsets of all tokens and the end, and each text's number of tokens."""
        mark = np.array([SENTINEL], np.uint32)
        arrays = [np.frombuffer(t.decode().encode("utf-32-le"), "<u4") for t in texts]
        codes = np.concatenate([x for a in arrays for x in (a, mark)]) if texts else np.zeros(0, np.uint32)
        if not len(codes):
            return b"", [0], []
        start = self.starts(codes)
        width = (codes >= 0x80).astype(np.uint8) + (codes >= 0x800) + (codes >= 0x10000) + np.uint8(1)
        width[codes == SENTINEL] = 0
        ends = np.cumsum(width, dtype=np.int64)
        offsets = (ends - width)[start].tolist()
        bounds = np.cumsum([0] + [len(a) + 1 for a in arrays])[:-1]
        return b"".join(texts), [*offsets, int(ends[-1])], np.add.reduceat(start, bounds, dtype=np.int64).tolist()


class Merger:
    """Merges slices by ranks: the adjacent pair of least rank first, the leftmost of equals."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.none = self.size = max(ranks.values()) + 1
        # A pair's key is first * size + second, its value the id of both together.
        self.pairs = {
            ranks[t[:i]] * self.size + ranks[t[i:]]: r
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }

    def __call__(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(piece) > LONG:
            return _merge_long(piece, self.ranks)
        pair, size, none = self.pairs.get, self.size, self.none
        ids = [self.single[b] for b in piece]
        costs = [pair(a * size + b, none) for a, b in zip(ids, ids[1:])]
        while costs:
            least = min(costs)
            if least == none:
                break
            i = costs.index(least)
            ids[i] = least
            del ids[i + 1], costs[i]
            if i < len(costs):
                costs[i] = pair(least * size + ids[i + 1], none)
            if i:
                costs[i - 1] = pair(ids[i - 1] * size + least, none)
        return ids


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As Merger does, with a heap and links to neighbours, in n log n steps."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here; 0 for none
    previous = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < n and (rank := ranks.get(piece[a : end[b]])) is not None:
            heapq.heappush(heap, (rank, a, end[b]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, a, stop = heapq.heappop(heap)
        b = end[a]
        if not b or b >= n or end[b] != stop:
            continue
        end[a], end[b] = stop, 0
        if stop < n:
            previous[stop] = a
        offer(a)
        if previous[a] >= 0:
            offer(previous[a])
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class Codec:
    """Encoder and decoder over one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.known: dict[bytes, bytes] = {}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            tokens[i] = token
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    @cached_property
    def splitter(self) -> Splitter:
        return Splitter()

    @cached_property
    def merge(self) -> Merger:
        return Merger(self.ranks)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; null counts as empty."""
        raw, offsets, counts = self.splitter.split([t or b"" for t in texts])
        slices = [raw[a:b] for a, b in zip(offsets, offsets[1:])]
        new = {s for s in slices if s not in self.known}
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
            new = set(slices)
        for s in new:
            self.known[s] = struct.pack(f"<{len(ids := self.merge(s))}I", *ids)
        found = list(map(self.known.__getitem__, slices))
        out, at = [], 0
        for n in counts:
            out.append(b"".join(found[at : at + n]))
            at += n
        return out

    def ends(self, ids: bytes) -> np.ndarray:
        """The end offset of each id's bytes in the text."""
        return np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])

    def decode(self, ids: bytes, ends: np.ndarray) -> bytes:
        codes = np.frombuffer(ids, "<u4")
        if not len(codes):
            return b""
        sizes = np.diff(ends, prepend=0)
        place = np.arange(int(ends[-1])) + np.repeat(self.begins[codes] - (ends - sizes), sizes)
        return self.bytes[place].tobytes()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a rank file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, ranks: str, text_col: str = "text", ids: str = "ids", ends: str = "ends") -> DataFrame:
    """Add the columns ``ids`` and ``ends``: token ids and the end offsets of their bytes.

    Both are binary, little-endian 32-bit integers. ``ranks`` is a rank file present on every
    machine. Null and empty texts have no tokens. Names that ``docs`` uses get an underscore
    before them. Ids of rows don't matter, null or repeated: each row is encoded by itself and an
    empty table gives no rows. Texts of any length are split whole.
    """

    def columns(texts: list[bytes | None]) -> list[pa.Array]:
        own = codec(ranks)
        rows = own.encode(texts)
        return [pa.array(rows, pa.binary()), pa.array([own.ends(r).astype("<u4").tobytes() for r in rows], pa.binary())]

    fields = [StructField(free_name(docs, n), BinaryType()) for n in (ids, ends)]
    return with_columns(docs, text_col, fields, columns, SPLIT_BYTES)


def decode(tokens: DataFrame, ranks: str, ids: str = "ids", ends: str = "ends", out: str = "decoded") -> DataFrame:
    """Add the bytes (``out``, binary) that the ids of each row stand for; null for null ids."""
    at, offsets_at = tokens.columns.index(ids), tokens.columns.index(ends)
    schema = StructType([*tokens.schema.fields, StructField(free_name(tokens, out), BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for whole in batches:
            for b in pieces(whole, at):
                rows = [
                    None if i is None else own.decode(i, np.frombuffer(e, "<u4").astype(np.int64))
                    for i, e in zip(texts_of(b, at), texts_of(b, offsets_at))
                ]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.binary())], names=schema.names)

    return tokens.mapInArrow(run, schema)
