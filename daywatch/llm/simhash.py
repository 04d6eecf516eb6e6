"""SimHash near-dedup: an inverted index of positional fingerprint bytes.

Two 64-bit fingerprints that differ in at most d bits agree in at least 8 - d of their
eight bytes. With d = 2 that leaves two of the four byte pairs whole, so every such pair of
fingerprints meets in one of six posting lists: its key holds the values of two byte pairs
at their positions. Within a list the shared positional bytes of each pair are tallied,
pairs that reach the guaranteed count are kept and verified bit by bit.

Only distinct fingerprints are indexed, so copies cost nothing. A list longer than
``LIST_PAIRS`` isn't paired off: its fingerprints are linked through their one-bit
neighbours instead, which finds exactly the same components in steps that grow in
proportion to the list.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from daywatch.llm.components import components
from daywatch.llm.exact import one_of_each
from daywatch.llm.text import free_name, stored, with_columns

SEED = 42
#: Longest posting list of which every pair is tallied.
LIST_PAIRS = 32
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16
MAX_BITS = 2


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of one text, as an unsigned integer; zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64)
    for at in range(0, len(values), COUNTED):
        part = values[at : at + COUNTED].astype("<u8").view(np.uint8)
        counts += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = (2 * counts > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str, name: str, shingle: int = 3) -> DataFrame:
    def column(texts: list[bytes | None]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))]

    return with_columns(docs, text_col, [StructField(name, LongType())], column)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) whose components are exact."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the six byte-pair lists guarantee distances of up to two bits")
    masks = [sum(0xFFFF << (16 * g) for g in pair) for pair in combinations(range(4), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = [F.struct(F.lit(i).alias("place"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]
    postings = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.place", "k.key")
    lists = postings.groupBy("place", "key").agg(F.count("*").alias("n")).where("n > 1")
    held = stored(postings.join(lists, ["place", "key"]), "postings")

    short = held.where(F.col("n") <= LIST_PAIRS)
    one = short.select("place", "key", F.col("fp").alias("a"))
    other = short.select("place", "key", F.col("fp").alias("b"))
    pairs = one.join(other, ["place", "key"]).where("a < b").select("a", "b").distinct()
    differ = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum(F.when(differ.bitwiseAND(F.lit(_byte(i))) == 0, 1).otherwise(0) for i in range(8))
    near = pairs.where((shared >= 8 - max_bits) & (F.bit_count(differ) <= max_bits))

    # Fingerprints that share a one-bit neighbour are two bits apart at most, and the other way
    # round; a neighbour has 65 of them at most.
    busy = held.where(F.col("n") > LIST_PAIRS).select("fp").distinct()
    reach = max_bits // 2 if max_bits != 1 else 1
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_bit(i))) for i in range(64)] * (reach > 0)
    met = busy.select("fp", F.explode(F.array(*flips)).alias("via")).groupBy("via").agg(F.collect_set("fp").alias("fps"))
    pairs = met.where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    if max_bits == 1:  # a neighbour that is a fingerprint itself is one bit from the others
        pairs = met.select(F.col("via").alias("a"), F.explode("fps").alias("b")).join(
            busy.select(F.col("fp").alias("a")), "a", "left_semi"
        )
    return near.union(pairs.where("a <> b").distinct())


def near_groups(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp, component_id, root`` from ``fp, doc_id`` rows: the smallest id and fingerprint of the component."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprints")
    roots = components(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least_id"
    )
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return stored(rooted.join(ids, "root").select("fp", "component_id", "root"), "groups")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    A-Z are lower-cased, words are runs of non-space characters, shingles count with their
    repeats; a text of fewer words is one shingle. Null and empty texts have fingerprint zero
    and are linked like any other. ``component_id`` is the smallest id reachable over links of
    at most ``max_bits`` differing bits, null if all reachable ids are null.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = stored(with_fingerprints(narrow, "text", "fp", shingle).drop("text"), "prints")
    return prints.join(near_groups(prints, max_bits), "fp").select(
        "doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS
) -> DataFrame:
    """One document of each component stays, that with the smallest id, with all its columns.

    Where rows repeat that id (or none of a component has an id), the least of them by its columns,
    from the first on, stays. Null and empty texts are linked to each other like any others.
    """
    fp, group, root = (free_name(docs, n) for n in ("fp", "component_id", "root"))
    printed = with_fingerprints(docs, text_col, fp, shingle)
    prints = stored(printed.select(F.col(fp).alias("fp"), F.col(id_col).alias("doc_id")), "prints")
    found = near_groups(prints, max_bits)
    groups = found.select(F.col("fp").alias(fp), F.col("component_id").alias(group), F.col("root").alias(root))
    kept = printed.join(groups, fp).where(F.col(id_col).eqNullSafe(F.col(group)))
    members = prints.join(found, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    again = members.groupBy("root").count().where("count > 1").select(F.col("root").alias("_again"))
    if not again.isEmpty():
        repeated = kept[root] == again["_again"]
        kept = kept.join(again, repeated, "left_anti").union(
            one_of_each(kept.join(again, repeated, "left_semi"), [root])
        )
    return kept.select(*docs.columns)


def _bit(i: int) -> int:
    return 1 << i if i < 63 else -(1 << 63)


def _byte(i: int) -> int:
    mask = 0xFF << (8 * i)
    return mask - (1 << 64) if mask >> 63 else mask
