"""Packing: cutting-stock column generation over the histogram of piece lengths.

A document's tokens are cut into pieces of ``capacity`` tokens and a rest. Pieces shorter than a
sixteenth of that are strung together, shard by shard, into bundles of about an eighth, exact in
their length, so that rounding costs short pieces no more than long ones. Only the histogram of
lengths, in ``capacity / UNIT`` classes, reaches the driver. There a
linear program over patterns (how many pieces of each class make up one sequence) is solved
by column generation, a knapsack dynamic program pricing new patterns until the solution is
within ``GAP`` of its bound. Rounded down, the patterns take almost all pieces; the few left
by rounding, at most some per pattern, are placed first-fit. Pieces and bundles are ranked within
their class, in shards so that no class is one task, and rank r takes the r-th place that the
patterns have for its class.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from daywatch.llm import blobs
from daywatch.llm.text import pieces as runs_of
from daywatch.llm.text import small_batches, stored
from daywatch.session import shuffle_width

CAPACITY = 4096
#: Tokens per length class: lengths are rounded up to it for the plan only.
UNIT = 16
#: Pieces shorter than this part of the capacity are bundled, to about the other part.
SHORT, BUNDLE = 16, 8
GAP = 0.002
#: Words whose ids a worker keeps at most, about 40 bytes each.
CACHED_WORDS = 600_000
#: What may follow the letters of a word.
MARKS = ("", ".", ",")
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, ids binary"


class Known:
    """Token ids of strings met before, most used ones kept, as Arrow and numpy arrays."""

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys = pa.array([], pa.string())
        self.ids, self.lengths, self.uses = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def at(self, strings: pa.Array) -> np.ndarray:
        """Places of distinct strings in ``ids_at``; new ones are encoded."""
        found = pc.fill_null(pc.index_in(strings, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = found < 0
        if new.any():
            missing = strings.filter(pa.array(new))
            ids, lengths = self.encode(missing)
            found[new] = len(self.lengths) + np.arange(len(missing))
            self.keys = pa.concat_arrays([self.keys, missing])
            self.ids, self.lengths = np.append(self.ids, ids), np.append(self.lengths, lengths)
            self.uses = np.append(self.uses, np.zeros(len(missing), np.int64))
        self.uses[found] += 1
        return found

    def trim(self, most: int) -> None:
        """Keep the strings used most, half of ``most``, once there are more."""
        if len(self.lengths) > most:
            kept = np.sort(np.argsort(-self.uses, kind="stable")[: most // 2])
            self.ids = _gathered(self.ids, self.lengths, kept)
            self.keys, self.lengths = self.keys.take(pa.array(kept)), self.lengths[kept]
            self.uses = self.uses[kept] // 2


def _gathered(values: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The runs of values with these numbers, end to end."""
    starts, size = (np.cumsum(lengths) - lengths)[chosen], lengths[chosen]
    before = np.cumsum(size) - size
    return values[np.repeat(starts - before, size) + np.arange(size.sum())]


class WordEncoder:
    """Token ids of texts whose tokenizer splits at white space anyway.

    A batch's distinct words are found in Arrow and looked up once each. Words of letters, with a
    full stop or comma after them or not, are brought to the tokenizer's normal form first and
    looked up by their letters alone; the mark is a token of its own then. Letters not met before
    are encoded many in one text and told apart by the tokens that end a word.
    """

    END = "</w>"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.END)]] = True
        self.marks = [self._each([m])[0] for m in MARKS]
        self.letters, self.others = Known(self._encode_letters), Known(lambda words: self._each(words.to_pylist()))

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _encode_letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        line = " ".join(words.to_pylist())
        ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.nonzero(self.ends[ids])[0] + 1
        if len(stops) != len(words):  # letters that this vocabulary splits further
            return self._each(words.to_pylist())
        return ids, np.diff(stops, prepend=0)

    def _normal(self, words: pa.Array) -> pa.Array:
        """Words of letters and combining marks in the tokenizer's normal form."""
        normalizer = self.tokenizer.normalizer
        if normalizer is None or not len(words):
            return words
        listed = words.to_pylist()
        found = normalizer.normalize_str(" ".join(listed)).split(" ")
        if len(found) != len(listed):
            found = [normalizer.normalize_str(w) for w in listed]
        return pa.array(found, pa.string())

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, end to end, and how many each has."""
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        mark, stem = np.zeros(len(words), np.int64), words
        for i, m in enumerate(MARKS):
            if m:
                has = pc.ends_with(words, m).to_numpy(zero_copy_only=False) & (size > 1)
                mark[has] = i
        if mark.any():
            cut = pc.utf8_slice_codeunits(words, 0, -1)
            stem = pc.if_else(pa.array(mark > 0), cut, words)
        ascii_only = pc.string_is_ascii(stem)
        plain = pc.and_(ascii_only, pc.ascii_is_alpha(stem)).to_numpy(zero_copy_only=False)
        core = pc.ascii_lower(stem)
        # Small Latin letters with their accents are in normal form already.
        odd = ~ascii_only.to_numpy(zero_copy_only=False)
        latin = odd.copy()
        latin[odd] = pc.match_substring_regex(core.filter(pa.array(odd)), "^[a-zß-öø-ÿ]+$").to_numpy(zero_copy_only=False)
        plain, odd = plain | latin, odd & ~latin
        odd[odd] = pc.match_substring_regex(stem.filter(pa.array(odd)), "^[\\pL\\pM]+$").to_numpy(zero_copy_only=False)
        if odd.any():
            normal = self._normal(stem.filter(pa.array(odd)))
            whole = pc.match_substring_regex(normal, "^\\pL+$").to_numpy(zero_copy_only=False)
            core = pc.replace_with_mask(core, pa.array(odd), normal)
            odd[odd] = whole
        lettered = plain | odd
        coded = core.filter(pa.array(lettered)).dictionary_encode()
        at = self.letters.at(coded.dictionary)[coded.indices.to_numpy()]
        other = self.others.at(words.filter(pa.array(~lettered)))

        # One table of runs: marks, letters, other words.
        values = np.concatenate([*self.marks, self.letters.ids, self.others.ids])
        lengths = np.concatenate([[len(m) for m in self.marks], self.letters.lengths, self.others.lengths])
        lengths = lengths.astype(np.int64)
        first = np.empty(len(words), np.int64)
        first[lettered] = len(MARKS) + at
        first[~lettered] = len(MARKS) + len(self.letters.lengths) + other
        runs = np.stack([first, np.where(lettered, mark, 0)], 1).ravel()  # the empty mark has no ids
        return _gathered(values, lengths, runs), lengths[runs].reshape(-1, 2).sum(1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and how many each has; null is empty."""
        self.letters.trim(CACHED_WORDS)
        self.others.trim(CACHED_WORDS // 4)
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        offsets = split.offsets.to_numpy()
        flat = split.values.slice(offsets[0], offsets[-1] - offsets[0])
        coded = flat.cast(pa.string()).dictionary_encode()
        ids, lengths = self.words(coded.dictionary)  # an empty one at the edge of a text has no ids
        codes = coded.indices.to_numpy()
        upto = np.concatenate([[0], np.cumsum(lengths[codes])])
        return _gathered(ids, lengths, codes), np.diff(upto[offsets - offsets[0]])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_pieces(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str, text_col: str, keep_ids: bool
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, ids`` of each piece; ids only with ``keep_ids``."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = np.array([end_id], "<u4")
    schema = StructType([narrow.schema["doc_id"], *StructType.fromDDL(PIECE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for whole in batches:
            for batch in runs_of(whole, 1):
                flat, sizes = encode(batch.column(1))
                rows, starts, lengths, sums, totals, ids = [], [], [], [], [], []
                at = 0
                for i, size in enumerate(sizes.tolist()):
                    own, at = flat[at : at + size], at + size
                    for start in range(0, size + 1, capacity):
                        part = own[start : start + capacity]
                        if start + capacity > size:
                            part = np.append(part, end)
                        rows.append(i)
                        starts.append(start)
                        lengths.append(len(part))
                        sums.append(zlib.crc32(part.astype("<u4", copy=False)))
                        totals.append(size + 1)
                        ids.append(blobs.pack(part.astype("<u4", copy=False)) if keep_ids else None)
                columns = [pa.array(c, pa.int64()) for c in (starts, lengths, sums, totals)]
                taken = batch.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken, *columns, pa.array(ids, pa.binary())], names=schema.names)

    return small_batches(narrow).mapInArrow(run, schema)


def solve(counts: np.ndarray, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each: pieces per class) and how often the linear program uses them.

    counts[c] pieces have c units; the capacity is len(counts) - 1 units.
    """
    size = len(counts) - 1
    classes = np.nonzero(counts)[0]
    need = counts[classes].astype(float)
    m = len(classes)
    if not m:
        return np.zeros((size + 1, 0), np.int64), np.zeros(0)
    patterns = np.zeros((m, m))
    patterns[np.arange(m), np.arange(m)] = size // classes
    inverse = np.diag(1.0 / (size // classes))
    uses = inverse @ need
    while True:
        prices = inverse.sum(0)
        pattern, value = knapsack(classes, np.maximum(prices, 0), size)
        if value <= 1 + 1e-9 or (prices @ need) / value >= (1 - gap) * uses.sum():
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, uses / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        uses = np.maximum(uses - ratio[out] * step, 0)
        uses[out] = ratio[out]
        patterns[:, out] = pattern
    full = np.zeros((size + 1, m), np.int64)
    full[classes] = np.rint(patterns).astype(np.int64)
    return full, uses


def knapsack(weights: np.ndarray, prices: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """The dearest multiset of weights that fits, as counts per weight, and its price."""
    best = np.zeros(size + 1)
    last = np.full(size + 1, -1)
    for w in range(1, size + 1):
        n = np.searchsorted(weights, w, "right")
        best[w], last[w] = best[w - 1], -1
        if n:
            worth = best[w - weights[:n]] + prices[:n]
            i = int(np.argmax(worth))
            if worth[i] > best[w] + 1e-12:
                best[w], last[w] = worth[i], i
    counts, w = np.zeros(len(weights)), size
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            counts[last[w]] += 1
            w -= weights[last[w]]
    return counts, float(best[size])


class Plan:
    """For each class, where the piece of each rank goes: ranges of ranks and their patterns."""

    def __init__(self, counts: np.ndarray):
        size = len(counts) - 1
        patterns, uses = solve(counts)
        whole = np.floor(uses + 1e-6).astype(np.int64)
        left = counts - patterns @ whole
        self.ranges: dict[int, list[tuple[int, int, int, int]]] = {}
        self.filled = np.zeros_like(counts)
        self.sequences = 0
        for p in np.nonzero(whole)[0]:
            self._add(patterns[:, p], int(whole[p]))
        bins: list[np.ndarray] = []
        room = np.zeros(0, np.int64)
        for c in range(size, 0, -1):
            for _ in range(max(0, int(left[c]))):
                fits = np.nonzero(room >= c)[0]
                if not len(fits):
                    bins.append(np.zeros(size + 1, np.int64))
                    room = np.append(room, size)
                    fits = [len(bins) - 1]
                bins[fits[0]][c] += 1
                room[fits[0]] -= c
        for pattern in bins:
            self._add(pattern, 1)
        self.places = {
            c: tuple(np.array(x, np.int64) for x in zip(*found)) for c, found in self.ranges.items()
        }

    def _add(self, pattern: np.ndarray, times: int) -> None:
        """``times`` sequences of a pattern."""
        slot = 0
        for c in np.nonzero(pattern)[0].tolist():
            each = int(pattern[c])
            self.ranges.setdefault(c, []).append((int(self.filled[c]), each, self.sequences, slot))
            self.filled[c] += each * times
            slot += each
        self.sequences += times

    def place(self, unit: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and slot of the piece with this rank in its class."""
        sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for c in np.unique(unit).tolist():
            begin, each, base, first = self.places[c]
            mine = unit == c
            i = np.searchsorted(begin, rank[mine], "right") - 1
            at = rank[mine] - begin[i]
            sequence[mine] = base[i] + at // each[i]
            slot[mine] = first[i] + at % each[i]
        return sequence, slot


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    The ids of a document are those of its text under the vocabulary file (of a tokenizer that
    drops white space), then ``end_id``. Each id lies in one piece; a sequence's pieces have no
    gap between them. With ``keep_ids`` a column ``ids`` holds the piece's packed ids. Null and
    empty texts are the end id alone. Null ids and repeated rows are packed like others, a row as
    many pieces as it has. Texts of any length are cut into pieces. An empty table has no pieces.
    Columns other than the two don't matter, whatever their names.
    """
    spark = docs.sparkSession
    every = stored(token_pieces(docs, vocabulary, end_id, capacity, id_col, text_col, keep_ids), "pieces")
    shards = 4 * shuffle_width(spark)
    order = ["doc_id", "start", "ids_crc32"]
    every = every.withColumn("shard", F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int"))
    unit = F.ceil(F.col("length") / F.lit(UNIT)).cast("int").alias("unit")

    long = every.where(F.col("length") >= capacity // SHORT).select("*", unit)
    short = every.where(F.col("length") < capacity // SHORT)
    earlier = Window.partitionBy("shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("run", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
    short = short.withColumn("bundle", F.expr(f"run div {max(1, capacity // BUNDLE)}"))
    bundles = short.groupBy("shard", "bundle").agg(F.sum("length").alias("length"))
    bundles = stored(bundles, "bundles").select("*", unit)

    counts = np.zeros((2, -(-capacity // UNIT) + 1), np.int64)
    for i, table in enumerate((long, bundles)):
        for found, n in table.groupBy("unit").count().collect():  # one row a class
            counts[i, found] = n
    plan = Plan(counts.sum(0))
    singles = _placed(long, order, plan, np.zeros_like(counts[0]))
    packed = _placed(bundles, ["bundle"], plan, counts[0]).select("shard", "bundle", "sequence_id", "slot")
    members = short.join(packed, ["shard", "bundle"])

    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    kept = [c for c in out if c != "offset"]
    placed = singles.select(*kept, "slot", F.lit(0).cast("long").alias("run")).union(members.select(*kept, "slot", "run"))
    before = Window.partitionBy("sequence_id").orderBy("slot", "run").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(*out)


def _placed(items: DataFrame, order: list[str], plan: Plan, first: np.ndarray) -> DataFrame:
    """Add ``sequence_id, slot`` to items with ``unit, shard``, ranked in their class from ``first`` on."""
    before = Window.partitionBy("unit").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        items.groupBy("unit", "shard")
        .agg(F.count("*").alias("n"))
        .select("unit", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    own = Window.partitionBy("unit", "shard").orderBy(*order)
    ranked = (
        items.withColumn("rank", F.row_number().over(own).cast("long") - 1)
        .join(offsets, ["unit", "shard"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .drop("before")
    )
    schema = StructType([*ranked.schema.fields, *StructType.fromDDL("sequence_id long, slot long").fields])
    unit_at, rank_at = ranked.columns.index("unit"), ranked.columns.index("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = b.column(unit_at).to_numpy()
            sequence, slot = plan.place(unit, b.column(rank_at).to_numpy() + first[unit])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence), pa.array(slot)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: ``sequence_id, n_tokens, input_ids, doc_ids, starts, offsets``.

    ``pieces`` is a result of ``pack`` with ids. A sequence has at most ``capacity`` pieces.
    """
    part = F.struct("offset", "doc_id", "start", "ids")
    rows = (
        pieces.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("parts"))
        .select(
            "sequence_id",
            "n_tokens",
            F.col("parts.ids").alias("ids"),
            F.col("parts.doc_id").alias("doc_ids"),
            F.col("parts.start").alias("starts"),
            F.col("parts.offset").alias("offsets"),
        )
    )
    names = ["sequence_id", "n_tokens", "input_ids", "doc_ids", "starts", "offsets"]
    fields = {f.name: f for f in rows.schema.fields} | {"input_ids": StructField("input_ids", ArrayType(IntegerType()))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                lists = [np.concatenate([blobs.unpack(x)[0] for x in parts]) for parts in b.column(2).to_pylist()]
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                flat = np.concatenate(lists).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                columns = [b.column(0), b.column(1), ids, b.column(3), b.column(4), b.column(5)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, StructType([fields[n] for n in names]))
