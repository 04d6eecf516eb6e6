"""LM scoring: masked pseudo-likelihood under a bidirectional window network.

Tokens are the corpus's frequent words, more of them the larger the corpus, and hash buckets
for the rest. The network sees two tokens on either side of a masked one: position embeddings
are summed, squashed, and predict first the token's class, then the token within it. A word in a
bucket is spelt out as well: its letters cost what a letter-pair model of all such words makes
them, so that every string has its probability, met before or not.

The network is trained in numpy, in parallel over all documents. Texts become token ids once;
every trainer runs gradient steps over masked places of its share, the parameters are averaged
by the number of places, and the next round starts from there. Each place is masked in one of
the rounds. A document's score is the sum of the log-probabilities of all its words, each given
its neighbours.

Vocabulary and parameters are tables in shared storage that workers read once; the driver
holds neither. There is a trainer for every few tokens a parameter, so what trainers hand on
stays in proportion to the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from daywatch.llm import blobs
from daywatch.llm.text import free_name, pieces, small_batches, stored
from daywatch.llm.warc import file_system
from daywatch.session import scratch_path

#: Classes, and tokens of a class, of the smallest network; larger vocabularies have more of both.
CLASSES = 32
#: Words in the vocabulary, times the cube root of the corpus's words.
ROOT_SHARE = 20
#: Tokens that stand for hashed words outside the vocabulary.
BUCKETS = 64
WIDTH = 24
REACH = 2
ROUNDS = 2
RATE = 0.1
#: Places of a gradient step, fewer at first.
FIRST_STEP, STEP = 256, 4096
SCORED = 16384
#: Tokens a trainer has for each parameter.
TOKENS_A_VALUE = 3
#: Rows that the parameters are cut into for averaging.
SLICES = 16
#: Stands for no letter: before a word and after it.
NO_LETTER = 256
LETTERS = NO_LETTER + 1


# -- network ---------------------------------------------------------------------------------------


def shapes(side: int) -> dict[str, tuple[int, ...]]:
    """Of the parameters of a network with ``side`` classes of ``side`` tokens."""
    return {
        "around": (2 * REACH, side * side + 1, WIDTH),
        "bias": (WIDTH,),
        "classes": (side, WIDTH),
        "class_bias": (side,),
        "words": (side, side, WIDTH),
        "word_bias": (side, side),
    }


def n_values(side: int) -> int:
    return sum(int(np.prod(s)) for s in shapes(side).values())


def side_for(n_words: int) -> int:
    """Classes that hold so many words and the buckets."""
    return max(CLASSES, math.isqrt(n_words + BUCKETS - 1) + 1)


class Network:
    def __init__(self, values: np.ndarray | None = None, seed: int = 7, side: int = CLASSES):
        if values is None:
            values = np.random.default_rng(seed).normal(0, 0.1, n_values(side))
        self.values = np.array(values, np.float32)
        self.side = next(k for k in count(1) if n_values(k) >= len(values))
        self.parts, at = {}, 0
        for name, shape in shapes(self.side).items():
            n = int(np.prod(shape))
            self.parts[name] = self.values[at : at + n].reshape(shape)
            at += n
        self.squares: dict[str, np.ndarray] = {}

    def hidden(self, context: np.ndarray) -> np.ndarray:
        around = self.parts["around"]
        total = self.parts["bias"] + around[0][context[0]]
        for i in range(1, 2 * REACH):
            total += around[i][context[i]]
        return np.tanh(total)

    def log_probs(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Of each token given its context (a row per neighbour)."""
        h = self.hidden(context)
        kind, place = token // self.side, token % self.side
        out = _chosen(h @ self.parts["classes"].T + self.parts["class_bias"], kind)
        for c, mine in _groups(kind):
            out[mine] += _chosen(h[mine] @ self.parts["words"][c].T + self.parts["word_bias"][c], place[mine])
        return out

    def gradients(self, context: np.ndarray, token: np.ndarray) -> list[tuple[str, object, np.ndarray]]:
        """Of the mean loss of these places: part, where in it, and the gradient there."""
        p, n = self.parts, len(token)
        h = self.hidden(context)
        kind, place = token // self.side, token % self.side
        error = _probabilities(h @ p["classes"].T + p["class_bias"])
        error[np.arange(n), kind] -= 1
        error /= n
        back = error @ p["classes"]
        grads = [("classes", ..., error.T @ h), ("class_bias", ..., error.sum(0))]
        for c, mine in _groups(kind):
            near = h[mine]
            inner = _probabilities(near @ p["words"][c].T + p["word_bias"][c])
            inner[np.arange(len(mine)), place[mine]] -= 1
            inner /= n
            grads += [("words", c, inner.T @ near), ("word_bias", c, inner.sum(0))]
            back[mine] += inner @ p["words"][c]
        back *= 1 - h * h
        grads.append(("bias", ..., back.sum(0)))
        for i in range(2 * REACH):
            order = np.argsort(context[i], kind="stable")
            ranked = context[i][order]
            begin = np.nonzero(np.append(True, ranked[1:] != ranked[:-1]))[0]
            grads.append(("around", (i, ranked[begin]), np.add.reduceat(back[order], begin, axis=0)))
        return grads

    def learn(self, context: np.ndarray, token: np.ndarray, rate: float) -> None:
        """One step of adaptive gradient descent; what has no gradient isn't touched."""
        for name, at, g in self.gradients(context, token):
            if name not in self.squares:
                self.squares[name] = np.full(self.parts[name].shape, 1e-6, np.float32)
            square = self.squares[name][at] + g * g
            self.squares[name][at] = square
            self.parts[name][at] -= rate * g / np.sqrt(square)


def _chosen(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of one entry a row."""
    logits -= logits.max(1, keepdims=True)
    own = logits[np.arange(len(at)), at]
    return own - np.log(np.exp(logits, out=logits).sum(1))


def _probabilities(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def _groups(kind: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(kind, kind="stable")
    cuts = np.nonzero(np.diff(kind[order]))[0] + 1
    for mine in np.split(order, cuts):
        if len(mine):
            yield int(kind[mine[0]]), mine


# -- words -----------------------------------------------------------------------------------------


def lower_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts end to end, A-Z lower-cased, and where each text's begin (and the last end)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    offsets = split.offsets.to_numpy()
    flat = split.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.string())
    full = pc.greater(pc.binary_length(flat), 0)  # the edges of a text may give empty ones
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), upto[offsets - offsets[0]]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n`` over all texts; counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 0):
                found = pc.value_counts(lower_words(batch.column(0))[0])
                yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])

    texts = small_batches(docs.select(F.col(text_col).cast("string")))
    parts = texts.mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's bytes behind one another: byte, byte before it (or none), and where words begin."""
    words = pa.concat_arrays([words.cast(pa.large_binary())])
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].astype(np.int64) if data else np.zeros(0, np.int64)
    begin = offsets[:-1] - offsets[0]
    before = np.empty_like(raw)
    before[1:] = raw[:-1]
    before[begin] = NO_LETTER
    return raw, before, begin


def buckets(words: pa.Array) -> np.ndarray:
    """The hash bucket of each (not empty) word."""
    raw, _, begin = _letters(words)
    if not len(words):
        return raw
    place = np.arange(len(raw)) - np.repeat(begin, np.diff(np.append(begin, len(raw))))
    power = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    mixed = np.add.reduceat((raw + 1).astype(np.uint64) * power[place], begin)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(58)).astype(np.int64) % BUCKETS


def pair_counts(words: pa.Array, times: np.ndarray) -> np.ndarray:
    """How often a letter follows another in words that occur so often, by pair number."""
    raw, before, begin = _letters(words)
    size = np.diff(np.append(begin, len(raw)))
    each = np.repeat(times, size)
    out = np.zeros(LETTERS * LETTERS, np.int64)
    np.add.at(out, before * LETTERS + raw, each)
    np.add.at(out, raw[begin + size - 1] * LETTERS + NO_LETTER, times)
    return out


def spelling(words: pa.Array, table: np.ndarray) -> np.ndarray:
    """Log-probability of the letters of each word and of its end, and of nothing but its bucket's words."""
    if not len(words):
        return np.zeros(0)
    raw, before, begin = _letters(words)
    last = raw[np.append(begin[1:], len(raw)) - 1]
    return np.add.reduceat(table[before, raw], begin) + table[last, NO_LETTER] + math.log(BUCKETS)


class Words:
    """Token ids, and what spelling costs, of words; others than the vocabulary's go to a bucket."""

    def __init__(self, known: pa.Array, table: np.ndarray):
        self.known, self.table = known, table
        self.side = side_for(len(known))
        self.first_bucket = self.side**2 - BUCKETS

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens end to end, what their spelling adds, and where each text's begin."""
        flat, starts = lower_words(texts)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary
        ids = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        rare = ids < 0
        others = distinct.filter(pa.array(rare))
        ids[rare] = self.first_bucket + buckets(others)
        extra = np.zeros(len(ids))
        extra[rare] = spelling(others, self.table)
        codes = coded.indices.to_numpy()
        return ids[codes], extra[codes], starts


def line_of(tokens: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """Texts one after the other, with ``end`` tokens between them as far as a window reaches."""
    n = len(starts) - 1
    line = np.full(len(tokens) + REACH * (n + 1), end, np.int32)
    text = np.repeat(np.arange(1, n + 1), np.diff(starts))
    line[np.arange(len(tokens)) + REACH * text] = tokens
    return line


def contexts(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tokens around places of a line, a row per neighbour."""
    return np.stack([line[at + d] for d in (*range(-REACH, 0), *range(1, REACH + 1))])


# -- training --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Paths of tables in shared storage: words by rank, letter pairs, parameters."""

    words: str
    pairs: str
    values: str


_HELD: dict[str, object] = {}


def _table(path: str) -> pa.Table:
    system, root = file_system(path)
    return pads.dataset(root, filesystem=system, format="parquet").to_table()


def _held(path: str, make) -> object:
    """What a worker has read from a path; a few paths at a time."""
    if path not in _HELD:
        while len(_HELD) >= 4:
            _HELD.pop(next(iter(_HELD)))
        _HELD[path] = make(path)
    return _HELD[path]


def read_words(model: Model) -> Words:
    def make(path: str) -> Words:
        table = _table(path).sort_by("rank")
        pairs = _table(model.pairs)
        counts = np.ones(LETTERS * LETTERS)  # every pair once, so that nothing is impossible
        counts[pairs.column("pair").to_numpy()] += pairs.column("n").to_numpy()
        counts = counts.reshape(LETTERS, LETTERS)
        known = table.column("word").cast(pa.string()).combine_chunks()
        return Words(known, np.log(counts / counts.sum(1, keepdims=True)))

    return _held(model.words, make)


def read_values(path: str) -> np.ndarray:
    def make(path: str) -> np.ndarray:
        rows = _table(path).sort_by("slice").column("data").to_pylist()
        return np.concatenate([np.frombuffer(r, np.float32) for r in rows])

    return _held(path, make)


def _written(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def vocabulary(counts: DataFrame) -> DataFrame:
    """``word, rank`` of the words met most often, from 0, equally frequent ones by their bytes."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = max(CLASSES, int(ROOT_SHARE * total ** (1 / 3)))
    top = counts.where("n > 1").orderBy(F.desc("n"), "word").limit(size)

    # The rows of the one ordered partition that a limit leaves, numbered.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(range(at, at + b.num_rows), pa.int64())], ["word", "rank"])
            at += b.num_rows

    return top.select("word").mapInArrow(run, "word string, rank long")


def letter_pairs(counts: DataFrame, known: DataFrame) -> DataFrame:
    """``pair, n`` over all words outside the vocabulary, each as often as it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS * LETTERS, np.int64)
        for b in batches:
            for part in pieces(b, 0):
                total += pair_counts(part.column(0), part.column(1).to_numpy())
        pairs = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(total[pairs])], ["pair", "n"])

    rare = counts.join(known.select("word"), "word", "left_anti").select("word", "n")
    return rare.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def token_lines(docs: DataFrame, text_col: str, model: Model) -> DataFrame:
    """``data, n``: packed lines of token ids, a row per few megabytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = read_words(model)
        for whole in batches:
            for batch in pieces(whole, 0):
                tokens, _, starts = words(batch.column(0))
                if len(tokens):
                    packed = blobs.pack(line_of(tokens, starts, words.side**2))
                    columns = [pa.array([packed], pa.binary()), pa.array([len(tokens)], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["data", "n"])

    return small_batches(docs.select(F.col(text_col).cast("string"))).mapInArrow(run, "data binary, n long")


AVERAGED = "slice int, part long, weight double, data binary"


def train_round(lines: DataFrame, trainers: int, side: int, start: str | None, index: int, rounds: int, rate: float) -> str:
    """Path of the parameters after every trainer has learned from its lines, averaged by places."""
    end = side**2

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        net = Network(side=side) if start is None else Network(read_values(start))
        seen = 0
        for b in batches:
            for value in b.column(0).to_pylist():
                (line,) = blobs.unpack(value)
                at = np.nonzero(line != end)[0]
                # Each place is masked in one round; which one, its number in the line decides.
                mixed = (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                at = at[((mixed >> np.uint64(40)) + np.uint64(index)) % np.uint64(rounds) == 0]
                while len(at):
                    step = min(max(FIRST_STEP, seen // 8), STEP)
                    now, at = at[:step], at[step:]
                    net.learn(contexts(line, now), line[now], rate)
                    seen += len(now)
        parts = np.array_split(net.values, SLICES)
        columns = [
            pa.array(range(SLICES), pa.int32()),
            pa.array([TaskContext.get().partitionId()] * SLICES, pa.int64()),
            pa.array([float(seen)] * SLICES, pa.float64()),
            pa.array([p.tobytes() for p in parts], pa.binary()),
        ]
        if seen:
            yield pa.RecordBatch.from_arrays(columns, ["slice", "part", "weight", "data"])

    # Rows are dealt by their bytes: the same trainers have the same lines in every attempt.
    rows = lines.repartition(trainers, F.xxhash64("data")).select("data").mapInArrow(learn, AVERAGED)
    shards = max(1, math.isqrt(trainers))
    for salt in (F.col("part") % shards, F.lit(0)):
        rows = rows.withColumn("part", salt.cast("long")).groupBy("slice", "part").applyInArrow(_average, AVERAGED)
    return _written(rows.select("slice", "data"), "parameters")


def _average(table: pa.Table) -> pa.Table:
    order = np.lexsort([table.column("part").to_numpy(), table.column("weight").to_numpy()])
    total, weight = None, 0.0
    for i in order.tolist():  # a row at a time: no more than two arrays are held
        w = table.column("weight")[i].as_py()
        own = np.frombuffer(table.column("data")[i].as_buffer(), np.float32) * np.float64(w)
        total, weight = own if total is None else total + own, weight + w
    first = table.slice(0, 1)
    mean = (total / weight).astype(np.float32).tobytes()
    return pa.Table.from_arrays(
        [first.column("slice"), first.column("part"), pa.array([weight]), pa.array([mean], pa.binary())],
        names=["slice", "part", "weight", "data"],
    )


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> Model:
    """A model of all of ``docs``; null and empty texts add nothing, repeated rows count again.

    An empty table gives an untrained network without words, under which scores are still defined.
    """
    spark = docs.sparkSession
    counts = stored(word_counts(docs, text_col), "words")
    words = _written(vocabulary(counts), "vocabulary")
    known = spark.read.schema("word string, rank long").parquet(words)
    pairs = _written(letter_pairs(counts, known), "letter_pairs")
    side = side_for(known.count())
    if counts.isEmpty():
        rows = [(i, bytearray(p.tobytes())) for i, p in enumerate(np.array_split(Network(side=side).values, SLICES))]
        return Model(words, pairs, _written(spark.createDataFrame(rows, "slice int, data binary"), "parameters"))
    lines = stored(token_lines(docs, text_col, Model(words, pairs, "")), "token_lines")
    total = lines.agg(F.sum("n")).first()[0]
    trainers = max(1, total // (TOKENS_A_VALUE * n_values(side)))
    values = None
    for i in range(rounds):
        values = train_round(lines, trainers, side, values, i, rounds, RATE / (i + 1))
    return Model(words, pairs, values)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``n_tokens, log_prob, mean_log_prob`` to all columns of ``docs``, in one pass.

    A word outside the vocabulary has the probability of its bucket and of its letters. Null and
    empty texts have no tokens, a sum of zero and a null mean. Ties don't matter: equal texts have equal
    scores, repeated rows a row each. Texts of any length are scored whole. An empty table gives no rows. A name that
    ``docs`` uses gets an underscore before it. ``keep_text`` false leaves the texts out.
    """
    kinds = {"n_tokens": LongType(), "log_prob": DoubleType(), "mean_log_prob": DoubleType()}
    fields = [StructField(free_name(docs, n), k) for n, k in kinds.items()]
    at = docs.columns.index(text_col)
    kept = [i for i in range(len(docs.columns)) if keep_text or i != at]
    schema = StructType([*[docs.schema.fields[i] for i in kept], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = read_words(model), Network(read_values(model.values))
        for whole in batches:
            for batch in pieces(whole, at):
                tokens, extra, starts = words(batch.column(at))
                line = line_of(tokens, starts, net.side**2)
                place = np.nonzero(line != net.side**2)[0]
                upto = np.zeros(len(tokens) + 1)
                for i in range(0, len(tokens), SCORED):
                    own = slice(i, i + SCORED)
                    upto[1:][own] = net.log_probs(contexts(line, place[own]), tokens[own])
                upto[1:] += extra
                # Sums of each text alone, so that they don't depend on the texts before it.
                sums = np.array([upto[1:][a:b].sum() for a, b in zip(starts[:-1], starts[1:])])
                sizes = np.diff(starts)
                means = pa.array(np.divide(sums, sizes, out=np.zeros(len(sums)), where=sizes > 0), mask=sizes == 0)
                out = [pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), means]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *out], names=schema.names)

    return small_batches(docs).mapInArrow(run, schema)
