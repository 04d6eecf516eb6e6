import hashlib
import re

from pyspark.sql import functions as F

from daywatch.llm import exact

SCHEMA = "doc_id long, text string, kept string, hash int"
ROWS = [
    (5, "one two", "x", 1), (3, "one\ttwo", "x", 1), (9, "one  two\n", "x", 1), (4, "one two", "x", 1), (4, "one two", "x", 1),
    (1, None, "x", 1), (2, "", "x", 1), (7, " \n", "x", 1), (None, "lonely", "x", 1), (None, "onetwo", "x", None),
    (10, "é" * 50_000, "x", 1), (11, "é" * 50_000 + " ", None, 1), (12, "other\u00a0text", "x", 1),
]


def expected():
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in ROWS]
    out = []
    for (i, *_), n in zip(ROWS, norm):
        group = [(-len(t or ""), j is None, j or 0, j) for (j, t, *_), m in zip(ROWS, norm) if m == n]
        keep = min(group)[3]
        out.append((i, keep, len(group), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups(spark):
    got = exact.exact_groups(spark.createDataFrame(ROWS, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == expected()


def test_a_hash_shared_by_different_texts_splits(spark):
    got = exact.exact_groups(
        spark.createDataFrame(ROWS, SCHEMA), content_hash=lambda n: F.md5(F.substring(n, 1, 1))
    )
    assert sorted(map(tuple, got.collect()), key=repr) == expected()
    got = exact.exact_groups(spark.createDataFrame(ROWS, SCHEMA), content_hash=lambda n: F.lit("same"))
    assert sorted(map(tuple, got.collect()), key=repr) == expected()


def test_drop_copies_keeps_one_row_of_each_group(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = exact.drop_copies(docs)
    assert got.columns == docs.columns
    # The surviving id 4 of the first group is given twice.
    wanted = sorted({(r[1], r[4]) for r in expected()}, key=repr)
    norm = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
    assert sorted(((r["doc_id"], norm(r["text"])) for r in got.collect()), key=repr) == wanted


def test_a_table_taken_in_twice_gives_what_it_gives_once(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    once, twice = exact.drop_copies(docs), exact.drop_copies(docs.union(docs).repartition(3))
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect()))
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a text").alias("text"))
    assert exact.drop_copies(same).count() == 1


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact.exact_groups(docs).count() == 0
    assert exact.drop_copies(docs).count() == 0


def test_a_group_of_many_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    rows = exact.exact_groups(docs).groupBy("keep_id", "group_size").count().collect()
    assert [tuple(r) for r in rows] == [(0, 3000, 3000)]
