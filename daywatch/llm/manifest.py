"""Merkle dataset manifest: ranks come from bitmaps, levels are reduced through keyed slots.

The ids of a group form a sparse bitmap of 64-bit words; tasks build partial words, which merge
by OR. Over the words lies a directory of counts, 65,536 children a node, so that no sum runs
over more than one node's children. A leaf's place is what the directory counts before its
word and the bits below its own in the word; no leaves are sorted. Only words in which an id
repeats are ranked row by row.

Every 4096 consecutive nodes are one block, whose task fills a slot per node and reduces three
levels. The subroots are ranked and reduced the same way. Paths then come down block by block:
what stands before and after a node in its run of sixteen, level by level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daywatch.llm.text import free_name, stored
from daywatch.operators.ranking import prefix_scan

ARITY = 16
#: Levels that one block reduces, and so nodes of a block.
LEVELS = 3
BLOCK = ARITY**LEVELS
#: Levels that sixteen-fold nodes over all 64-bit counts can have.
MOST_LEVELS = 16
#: The word of rows without id, before all others.
NO_WORD = -(1 << 57) - 1
PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the byte count of the value as text, a colon and that text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row with these values."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and each level above them."""
    found = [nodes]
    for _ in range(levels):
        below = found[-1]
        found.append([_digest("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return found


# -- coordinates -----------------------------------------------------------------------------------


def coordinates(leaves: DataFrame) -> DataFrame:
    """Add ``idx`` and ``n``: a leaf's place in its group ``g`` by ``id``, from 0, and the leaves there.

    ``leaves`` has ``g`` (not null), ``id`` (long), ``leaf`` and other columns, and is stored. Null
    ids come first. Rows of one id come by ``leaf``; equal rows take consecutive places.
    """
    word = F.coalesce(F.shiftright("id", 6), F.lit(NO_WORD))
    bit = F.coalesce(F.col("id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int")
    keyed = leaves.withColumn("word", word)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))
    words = keyed.groupBy("g", "word").agg(F.bit_or(one).alias("bits"), F.count("*").alias("rows"))
    words = stored(words, "bitmap_words").withColumn("crowded", F.col("rows") > F.bit_count("bits"))
    directory = _before(words)

    placed = keyed.join(directory, ["g", "word"])
    plain = placed.where(~F.col("crowded")).withColumn("idx", F.col("before") + F.bit_count(F.col("bits").bitwiseAND(below)))
    columns = [*leaves.columns, "idx", "n"]
    if words.where("crowded").isEmpty():
        return plain.select(*columns)
    return plain.select(*columns).union(_repeated(placed.where("crowded"), leaves.columns).select(*columns))


def _before(words: DataFrame) -> DataFrame:
    """``g, word, bits, crowded, before, n`` of each word: rows in earlier words of the group, and in all."""
    levels, keys = [words.select("g", "word", "rows")], ["word"]
    for i in range(3):
        key = f"node{i}"
        levels.append(
            levels[-1].groupBy("g", F.shiftright(keys[-1], 16).alias(key)).agg(F.sum("rows").alias("rows"))
        )
        keys.append(key)
    tops = levels[-1].groupBy("g").agg(F.sum("rows").alias("n"))
    found, above = None, []
    for i in reversed(range(4)):  # from the few nodes at the top down to the words
        above = ["g"] if i == 3 else ["g", keys[i + 1]]
        rows = levels[i] if i == 3 else levels[i].withColumn(keys[i + 1], F.shiftright(keys[i], 16))
        earlier = Window.partitionBy(*above).orderBy(keys[i]).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("own", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        if found is None:
            found = rows.join(tops, "g").withColumnRenamed("own", "before")
        else:
            found = rows.join(found.drop("rows"), above).withColumn("before", F.col("before") + F.col("own")).drop("own")
        found = found.select("g", keys[i], "rows", "before", "n")
    return found.drop("rows").join(words.select("g", "word", "bits", "crowded"), ["g", "word"])


def _repeated(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Places in words where an id repeats: equal rows are counted first, then each copy gets its place."""
    counted = rows.groupBy(*columns, "word", "before", "n").agg(F.count("*").alias("copies"))
    counted = stored(counted, "repeated_ids").withColumn("head", F.substring("leaf", 1, 4))
    out = counted
    rest = [c for c in columns if c not in ("g", "id", "leaf")]
    for group, by, order in (
        # At most 64 ids to a word and 65,536 heads to an id; the rest lies evenly under the heads.
        (["g", "word"], ["g", "word", "id"], ["id"]),
        (["g", "word", "id"], ["g", "word", "id", "head"], ["head"]),
        (["g", "word", "id", "head"], None, ["leaf", *rest]),
    ):
        earlier = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        if by is None:
            out = out.withColumn("at", F.coalesce(F.sum("copies").over(earlier), F.lit(0)))
        else:
            sums = counted.groupBy(*by).agg(F.sum("copies").alias("sum"))
            sums = sums.withColumn("at", F.coalesce(F.sum("sum").over(earlier), F.lit(0))).drop("sum")
            a, b = out.alias("a"), sums.alias("b")
            same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]
            out = a.join(b, same).select("a.*", F.col("b.at").alias("at"))
        out = out.withColumn("before", F.col("before") + F.col("at")).drop("at")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    return out.select("*", copies.alias("copy")).withColumn("idx", F.col("before") + F.col("copy"))


# -- trees -----------------------------------------------------------------------------------------


def _levels(n: Column) -> Column:
    """Levels over n nodes, zero over one."""
    return sum((n > F.lit(ARITY**k)).cast("int") for k in range(MOST_LEVELS))


def _up(nodes: DataFrame) -> DataFrame:
    """The nodes that blocks reduce to: ``g, idx, node, left``."""
    schema = "g string, idx long, node string, left int"

    def reduce(table: pa.Table) -> pa.Table:
        idx = table.column("idx").to_pylist()
        slots: list[str] = [""] * len(idx)
        for i, node in zip(idx, table.column("node").to_pylist()):
            slots[i % BLOCK] = node
        left = table.column("left")[0].as_py()
        levels = min(LEVELS, left)
        top = _reduced(slots, levels)[-1]
        columns = [[table.column("g")[0].as_py()], [idx[0] // BLOCK], top, [left - levels]]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["g", "idx", "node", "left"])

    blocks = nodes.select("g", "idx", "node", "left", F.expr(f"idx div {BLOCK}").alias("block"))
    return blocks.groupBy("g", "block").applyInArrow(reduce, schema)


def reduced(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of nodes, block level by block level, and the last node of each group: ``g, node``.

    ``nodes`` (stored) has ``g, idx, node, n``. The tables have ``g, idx, node, left``: the levels
    that are left above a node. Nodes of small groups end in early tables, with none left.
    """
    most = nodes.agg(F.max(_levels(F.col("n")))).first()[0] or 0
    tables = [nodes.withColumn("left", _levels(F.col("n")))]
    for _ in range(-(-most // LEVELS)):
        tables.append(stored(_up(tables[-1].where("left > 0")), "nodes"))
    ends = [t.where("left = 0").select("g", "node") for t in tables]
    roots = ends[0]
    for more in ends[1:]:
        roots = roots.union(more)
    return tables, roots


def _paths(rows: DataFrame, above: DataFrame, finish: bool) -> DataFrame:
    """Paths of rows with levels left, from the paths of the nodes their blocks reduce to.

    With ``finish`` the path is walked and only its digests leave the task.
    """
    out = "g string, idx long, id long, leaf string, proof_sha256 string, folded_root string"
    schema = out if finish else f"g string, idx long, path {PATH}"
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def down(table: pa.Table, upper: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _finished([]) if finish else pa.Table.from_arrays(
                [pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], kind)], names=["g", "idx", "path"]
            )
        rest = upper.column("path")[0].as_py()
        idx, nodes = table.column("idx").to_pylist(), table.column("node").to_pylist()
        slots: list[str] = [""] * len(idx)
        for i, node in zip(idx, nodes):
            slots[i % BLOCK] = node
        levels = _reduced(slots, min(LEVELS, table.column("left")[0].as_py()))[:-1]
        sides: list[list[dict[str, str]]] = []
        for nodes_here in levels:
            here = []
            for at in range(len(nodes_here)):
                begin = at - at % ARITY
                before, after = "".join(nodes_here[begin:at]), "".join(nodes_here[at + 1 : begin + ARITY])
                here.append({"before": before, "after": after})
            sides.append(here)
        paths = ([side[(i % BLOCK) // ARITY**k] for k, side in enumerate(sides)] + rest for i in idx)
        if finish:
            claims, ids = table.column("claim").to_pylist(), table.column("id").to_pylist()
            g = table.column("g").to_pylist()
            return _finished([(g[k], idx[k], ids[k], nodes[k], *_walk(p, claims[k] or nodes[k])) for k, p in enumerate(paths)])
        return pa.Table.from_arrays(
            [table.column("g").combine_chunks(), pa.array(idx, pa.int64()), pa.array(list(paths), kind)],
            names=["g", "idx", "path"],
        )

    blocks = rows.withColumn("block", F.expr(f"idx div {BLOCK}")).groupBy("g", "block")
    upper = above.select(F.col("g").alias("of_g"), F.col("idx").alias("of_block"), "path").groupBy("of_g", "of_block")
    return blocks.cogroup(upper).applyInArrow(down, schema)


def _walk(path: list[dict[str, str]], node: str) -> tuple[str, str]:
    """Digest of all siblings, and the node at the end of the path."""
    proof = _digest("".join(p["before"] + p["after"] for p in path))
    for p in path:
        node = _digest(p["before"] + node + p["after"])
    return proof, node


def _finished(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["g", "idx", "id", "leaf", "proof_sha256", "folded_root"]
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def above(tables: list[DataFrame], ends: DataFrame) -> DataFrame:
    """Paths ``g, idx, path`` of the nodes that the blocks of the first table reduce to.

    ``ends`` has ``g, path`` of each group's last node. A node with no level left is a block of
    its own, at the end already.
    """
    found = None
    for table in reversed(tables):
        lone = table.where("left = 0").join(ends, "g").select("g", F.lit(0).cast("long").alias("idx"), "path")
        upper = lone if found is None else found.union(lone)
        if table is not tables[0]:
            found = stored(_paths(table, upper, False), "paths")
    return upper


# -- manifests -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """Stored tables of a manifest.

    ``leaves`` has ``g, idx, node, n`` and ``id, claim``; ``subroots`` has ``g, idx, node, n`` of the groups.
    """

    tables: list[DataFrame]
    subroots: DataFrame
    upper: list[DataFrame]
    root: str | None


def group_key(group: Column) -> Column:
    """Groups as text that sorts as they do, bytewise with null first."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))


def build(
    docs: DataFrame, fields: Sequence[str], id_col: str = "doc_id", group_col: str = "source", claim: Column | None = None
) -> Manifest:
    """The manifest of ``docs``: a leaf per row over ``fields``, a tree per group, a tree over the groups.

    ``claim`` is the leaf that someone later shows for the row, null for the leaf itself.

    A null id comes first in its group, and a null group before all others; null fields have a
    digest of their own. Rows that repeat an id are leaves of their own, by digest; equal rows
    are as many leaves. An empty table has no root.
    """
    claimed = F.lit(None).cast("string") if claim is None else claim
    leaves = docs.select(
        group_key(F.col(group_col)).alias("g"),
        F.col(id_col).cast("long").alias("id"),
        leaf([F.col(c) for c in fields]).alias("leaf"),
        claimed.alias("claim"),
    )
    leaves = coordinates(stored(leaves, "leaves")).withColumnRenamed("leaf", "node")
    leaves = stored(leaves.select("g", "idx", "node", "n", "id", "claim"), "ranked_leaves")
    tables, ends = reduced(leaves)
    groups = prefix_scan(stored(ends, "subroots").withColumn("one", F.lit(1)), ["g"], ["one"])
    count = groups.count()
    subroots = groups.select("g", F.col("one_before").cast("long").alias("idx"), "node", F.lit(count).cast("long").alias("n"))
    subroots = stored(subroots, "ranked_subroots")
    upper, top = reduced(subroots.select(F.lit("").alias("g"), "idx", "node", "n"))
    root = top.first()
    return Manifest(tables, subroots, upper, root and root["node"])


def prove(manifest: Manifest) -> DataFrame:
    """One row per leaf: ``id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``proof_sha256`` is the digest of the siblings on the way to the root, in order.
    ``folded_root`` comes from the claimed leaf and those siblings; ``verified`` says that it is the root.
    """
    spark = manifest.subroots.sparkSession
    end = spark.range(1).select(F.lit("").alias("g"), F.expr(f"cast(array() as {PATH})").alias("path"))
    top = _paths(manifest.upper[0], above(manifest.upper, end), False).select("idx", "path")
    ends = stored(manifest.subroots.join(top, "idx").select("g", "node", "path"), "group_paths")
    walked = _paths(manifest.tables[0], above(manifest.tables, ends.select("g", "path")), True)
    root = F.lit(manifest.root).cast("string")
    return walked.join(ends.select("g", F.col("node").alias("subroot")), "g").select(
        "id",
        "leaf",
        "subroot",
        root.alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


def manifest(
    docs: DataFrame, fields: Sequence[str], id_col: str = "doc_id", group_col: str = "source", claim: Column | None = None
) -> DataFrame:
    """``prove`` over ``build``, with the rows' ids under their own name.

    Columns of ``docs`` beyond those named don't matter, whatever their names. Texts of any length are one field.
    """
    rows = prove(build(docs, fields, id_col, group_col, claim))
    name = id_col if id_col.lower() not in {c.lower() for c in rows.columns[1:]} else free_name(rows, id_col)
    return rows.withColumnRenamed("id", name)
