"""Exact dedup: 128-bit content hashes find the groups, a comparison of bytes confirms them.

Everything runs as DataFrame expressions. Only narrow rows (id, hashes, length) go
through the grouping, which counts in each task before it shuffles. Texts move once, to
meet their group; there the least and the greatest are compared byte by byte. Where they
differ, a hash is shared by different texts, and the group is split by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daywatch.llm.text import SPACES, free_name, stored


def without_spaces(text: Column) -> Column:
    """Null counts as empty; every ASCII white-space character goes."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = without_spaces,
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their normalised forms are. Of equal texts the row with the most
    code points in its original text stays, then the one with the smallest id. A null text
    counts as empty. A null id ranks after all others; ``keep_id`` is null only where every
    row of the group has a null id. Rows that repeat the surviving id within a group cannot
    be told from the survivor and are all marked kept (``drop_copies`` keeps one). Texts of any length are
    compared whole. Empty tables give empty results.
    """
    norm = normalise(F.col(text_col))
    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars"),
        norm.alias("norm"),
    ).withColumn("hash", content_hash(F.col("norm")))
    rows = texts.select("doc_id", "chars", "hash", F.sha2("norm", 256).alias("text_sha256"))

    groups = rows.groupBy("hash").agg(F.count("*").alias("n"), _best().alias("best"))

    # Bytes are compared inside groups only: texts move once, and what has a partner is kept.
    members = stored(texts.join(groups.where("n > 1"), "hash"), "members")
    # Copies fall together in the tasks before they shuffle; least and greatest text differ only in a collision.
    mixed = members.groupBy("hash").agg(F.min("norm").alias("least"), F.max("norm").alias("most")).where("least <> most")
    mixed = stored(members.join(mixed.select("hash"), "hash"), "mixed")
    survivors = mixed.where(_is_best()).groupBy("hash").agg(F.min("norm").alias("kept_norm"))
    strays = mixed.join(survivors, "hash").where("norm <> kept_norm").select("doc_id", "chars", "hash", "norm")
    joined = rows.join(groups, "hash")
    best, size = F.col("best"), F.col("n")
    if not mixed.isEmpty():
        own = strays.groupBy("hash", "norm").agg(F.count("*").alias("own_n"), _best().alias("own_best"))
        others = own.groupBy("hash").agg(F.sum("own_n").alias("others"))
        own = own.select("hash", F.sha2("norm", 256).alias("text_sha256"), "own_n", "own_best")
        joined = joined.join(others, "hash", "left").join(own, ["hash", "text_sha256"], "left")
        best = F.coalesce("own_best", "best")
        size = F.coalesce("own_n", F.col("n") - F.coalesce("others", F.lit(0)))
    keep_id = best["doc_id"]
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        size.cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each group of ``exact_groups``, with all its columns.

    Where rows repeat the id that stays (or none of a group has an id), the least of them by its
    columns, from the first on, stays. Null and empty texts are one group. Empty tables give empty results.
    """
    groups = stored(exact_groups(docs, id_col, text_col, **how).select("doc_id", "kept", "text_sha256"), "exact_groups")
    named = [F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")]
    dropped = groups.where(~F.col("kept")).select(*named)
    again = groups.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select(*named)
    sha = free_name(docs, "text_sha256")
    normalise = how.get("normalise", without_spaces)
    keyed = docs.withColumn(sha, F.sha2(normalise(F.col(text_col)), 256))

    def same(rows: DataFrame, other: DataFrame) -> Column:
        return rows[id_col].eqNullSafe(other["_id"]) & (rows[sha] == other["_sha"])

    kept = keyed.join(dropped, same(keyed, dropped), "left_anti")
    if not again.isEmpty():
        kept = kept.join(again, same(kept, again), "left_anti").union(
            one_of_each(kept.join(again, same(kept, again), "left_semi"), [id_col, sha])
        )
    return kept.drop(sha)


def one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The least row of each key by the order of its columns; rows fall together in the tasks first."""
    least = F.min(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("least")
    return rows.groupBy(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]).agg(least).select("least.*")


def _best() -> Column:
    return F.min(
        F.struct((-F.col("chars")).alias("rank"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"))
    )


def _is_best() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("best")["doc_id"]) & (-F.col("chars") == F.col("best")["rank"])
