"""Line dedup: Bloom filters of once-seen and twice-seen line keys find the suspected repeats.

A key is a line without the white space around it, A-Z lower-cased. Tasks reduce the long keys
of their documents to 128-bit digests. A digest that several documents of a run hold is a
suspect at once; one entry of each digest goes to its slice of the digest space. There two Bloom
filters are built: what is found in the first already is entered in the second. Slices are
salted, and the filters of a slice merge: bits set in two first filters count as twice seen.
Digests that the merged second filter holds are suspects too.

Only suspects, as digest and document, shuffle as rows: distinct documents are counted exactly
and the document that keeps the key is chosen. Texts move once, to meet what they lose.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from daywatch.llm import blobs
from daywatch.llm.text import free_name, pieces, small_batches, stored, texts_of
from daywatch.session import shuffle_width

MIN_CHARS = 40
MIN_DOCS = 5
#: Filter bits per expected key of a slice; each key sets two.
BITS_A_KEY = 8
#: Keys a task holds before it hands them on.
RUN_KEYS = 1 << 18
#: Parts that a slice is dealt to before its filters merge.
SALTS = 4
#: Bytes of UTF-8 that do not begin a code point.
_INNER = bytes(range(0x80, 0xC0))

FILTER = "slice int, part int, once binary, twice binary"
RESULT = StructType(
    [StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept_text", StringType())]
)


def digest_of(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit digest of the line's key, none if the key is too short."""
    key = line.strip().lower()
    if len(key) < min_chars or not key.isascii() and len(key.translate(None, _INNER)) < min_chars:
        return None
    return blake2b(key, digest_size=16).digest()


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _places(low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key; ``bits`` is a power of two."""
    mask = np.uint64(bits - 1)
    return (low & mask).astype(np.int64), ((low >> np.uint64(32)) & mask).astype(np.int64)


def _packed(bits: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes())


def _unpacked(value: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(value), np.uint8)).view(bool)


def _entries(docs: DataFrame, min_chars: int, slices: int) -> DataFrame:
    """``part, n, keys, owners``: packed digests with a document for each.

    ``docs`` has ``owner`` and ``text``. Part -1 has the suspects of a run, every document of
    them; the other parts have one entry of each digest of a run, marked if it is such a suspect.
    """
    owner = docs.schema["owner"]
    schema = StructType(
        [
            StructField("part", IntegerType()),
            StructField("n", LongType()),
            StructField("keys", BinaryType()),
            StructField("owners", ArrayType(owner.dataType)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        digests: list[bytes] = []
        rows: list[int] = []
        owners: list[pa.Array] = []
        n_docs, salt = 0, TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n_docs, salt
            if digests:
                high, low = _halves(digests)
                row, own = np.array(rows, np.int64), pa.concat_arrays(owners)
                order = np.lexsort((low, high))
                high, low, row = high[order], low[order], row[order]
                first = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))
                size = np.diff(np.append(np.nonzero(first)[0], len(high)))
                several = np.repeat(size > 1, size)
                if several.any():
                    yield batch_of(-1, high[several], low[several], row[several], own, None)
                high, low, row, several = high[first], low[first], row[first], several[first]
                where = (high % np.uint64(slices)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                cuts = np.nonzero(np.diff(where[order]))[0] + 1
                for mine in np.split(order, cuts):
                    part = int(where[mine[0]]) * SALTS + salt % SALTS
                    yield batch_of(part, high[mine], low[mine], row[mine], own, several[mine])
            digests.clear(), rows.clear(), owners.clear()
            n_docs, salt = 0, salt + 1

        def batch_of(part, high, low, row, own, several) -> pa.RecordBatch:
            marks = np.ones(len(high), np.uint8) if several is None else several.astype(np.uint8)
            held = pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), own.take(pa.array(row)))
            columns = [pa.array([part], pa.int32()), pa.array([len(row)], pa.int64())]
            columns += [pa.array([blobs.pack(high, low, marks)], pa.binary()), held]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for whole in batches:
            for batch in pieces(whole, 1):
                owners.append(batch.column(0))
                for text in texts_of(batch, 1):
                    found = {digest_of(line, min_chars) for line in (text or b"").split(b"\n")}
                    found.discard(None)
                    digests.extend(found)
                    rows.extend([n_docs] * len(found))
                    n_docs += 1
                if len(digests) >= RUN_KEYS:
                    yield from flush()
        yield from flush()

    return small_batches(docs.select("owner", "text")).mapInArrow(run, schema)


def _filters(entries: DataFrame, bits: int) -> DataFrame:
    """``part, twice``: for every part of a slice the merged filter of what was seen twice."""

    def build(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for value in table.column("keys").to_pylist():
            _, low, marks = blobs.unpack(value)
            a, b = _places(low, bits)
            again = marks.astype(bool) | (once[a] & once[b])
            twice[a[again]] = twice[b[again]] = True
            once[a] = once[b] = True
        part = table.column("part")[0].as_py()
        columns = [[part // SALTS], [part], [_packed(once)], [_packed(twice)]]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["slice", "part", "once", "twice"])

    def merge(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for o, t in zip(table.column("once").to_pylist(), table.column("twice").to_pylist()):
            own = _unpacked(o)
            twice |= _unpacked(t) | (once & own)
            once |= own
        parts = table.column("part").to_pylist()
        return pa.Table.from_arrays(
            [pa.array(parts, pa.int32()), pa.array([_packed(twice)] * len(parts), pa.binary())], names=["part", "twice"]
        )

    built = entries.groupBy("part").applyInArrow(build, FILTER)
    return built.groupBy("slice").applyInArrow(merge, "part int, twice binary")


def suspects(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``digest, id, version`` of all keys that two documents hold, and of few others.

    ``docs`` has ``owner``, a struct of ``id`` and ``version``, and ``text``.
    """
    slices = shuffle_width(docs.sparkSession)
    entries = stored(_entries(docs, min_chars, slices), "line_keys")
    dealt, local = entries.where("part >= 0"), entries.where("part < 0")
    total = dealt.agg(F.sum("n")).first()[0] or 0
    bits = 1 << max(12, (BITS_A_KEY * total // slices).bit_length())
    owner = docs.schema["owner"].dataType
    schema = StructType([StructField("digest", BinaryType()), *[StructField(f.name, f.dataType) for f in owner]])

    def taken(value: bytes, owners: pa.ListScalar, twice: np.ndarray | None) -> pa.RecordBatch:
        high, low, marks = blobs.unpack(value)
        keep = np.ones(len(high), bool)
        if twice is not None:
            a, b = _places(low, bits)
            keep = twice[a] & twice[b] & (marks == 0)
        raw = np.stack([high[keep], low[keep]], 1).astype("<u8").tobytes()
        digests = pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())
        own = owners.values.take(pa.array(np.nonzero(keep)[0]))
        return pa.RecordBatch.from_arrays([digests, *[own.field(i) for i in range(len(owner))]], names=schema.names)

    def test(table: pa.Table, filters: pa.Table) -> pa.Table:
        twice = _unpacked(filters.column("twice")[0].as_py())
        return pa.Table.from_batches(
            [taken(v.as_py(), o, twice) for v, o in zip(table.column("keys"), table.column("owners"))]
        )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, owners in zip(batch.column(0), batch.column(1)):
                yield taken(value.as_py(), owners, None)

    tested = dealt.groupBy("part").cogroup(_filters(dealt, bits).groupBy("part")).applyInArrow(test, schema)
    return tested.union(local.select("keys", "owners").mapInArrow(spread, schema))


def dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """All columns of ``docs`` and a struct ``lines``: ``n_lines, n_dropped, kept_text``.

    Texts are split at line feeds; a null or empty text is one empty line. A line's key is the
    line without ASCII white space at both ends, A-Z lower-cased. Keys of ``min_chars`` code
    points or more that ``min_docs`` documents hold lose all their lines, except in the document
    with the largest id among them, which keeps every one. Lines that stay are joined by line feeds, unchanged.

    Documents are told apart by their ids: rows that repeat an id count as one document and keep
    or lose a key together. Null ids are one document too, which ranks below all others. Empty tables give empty
    results. If ``lines`` is taken, the struct's name gets an underscore before it.
    """
    if min_docs < 2:
        raise ValueError("only repeated lines are looked for")
    out, gone = free_name(docs, "lines"), free_name(docs, "gone")
    text = F.col(text_col).cast("string")
    version = F.xxhash64(text)
    owner = F.struct(F.col(id_col).alias("id"), version.alias("version"))
    found = stored(suspects(docs.select(owner.alias("owner"), text.alias("text")), min_chars), "line_suspects")
    held = found.select("digest", "id").distinct().groupBy("digest")
    repeated = held.agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    # Stored, so that it is broadcast if it is small, and a digest that very many documents hold is split if it isn't.
    repeated = stored(repeated.select("digest", "keeper"), "line_keepers")
    losses = (
        found.join(repeated, "digest")
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        # What one text loses: no more than its lines.
        .groupBy("id", "version")
        .agg(F.collect_set("digest").alias("gone"))
    )
    # Plain names on the left: nothing clashes with the columns of the losses.
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], version.alias("own"))
    same = F.col(names[id_col]).eqNullSafe(F.col("id")) & (F.col("own") == F.col("version"))
    rows = rows.join(losses, same, "left").select(*[F.col(n).alias(c) for c, n in names.items()], F.col("gone").alias(gone))
    text_at, gone_at = docs.columns.index(text_col), len(docs.columns)
    if docs.schema[text_col].dataType != StringType():
        rows = rows.withColumn(text_col, text)
    fields = [f for f in rows.schema.fields if f.name != gone]
    schema = StructType([*fields, StructField(out, RESULT)])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text_at):
                n_lines, n_dropped, kept = [], [], []
                for value, lost in zip(texts_of(batch, text_at), batch.column(gone_at).to_pylist()):
                    value = value or b""
                    size = value.count(b"\n") + 1
                    if lost:
                        lost = set(lost)
                        lines = [x for x in value.split(b"\n") if digest_of(x, min_chars) not in lost]
                        n_dropped.append(size - len(lines))
                        value = b"\n".join(lines)
                    else:
                        n_dropped.append(0)
                    n_lines.append(size)
                    kept.append(value)
                columns = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
                columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                struct = pa.StructArray.from_arrays(columns, names=RESULT.names)
                own = [c for i, c in enumerate(batch.columns) if i != gone_at]
                yield pa.RecordBatch.from_arrays([*own, struct], names=schema.names)

    return small_batches(rows).mapInArrow(drop, schema)
