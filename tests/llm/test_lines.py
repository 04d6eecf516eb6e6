import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from daywatch.llm import lines

SCHEMA = "doc_id long, text string, lines string, version int, GONE string"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))


def brute(rows, min_chars=40, min_docs=5):
    """Per row (doc_id, text): lines, dropped lines, kept text."""
    held = defaultdict(set)
    for i, text in rows:
        for k in map(key, (text or "").split("\n")):
            if len(k) >= min_chars:
                held[k].add(i)
    keeper = {k: max(i for i in ids if i is not None) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if keeper.get(key(x), i) == i]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def result(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(3)
    got = lines.dedup(docs, **how)
    assert got.columns == [*docs.columns, "_lines"]
    return sorted(((r["doc_id"], *r["_lines"]) for r in got.collect()), key=repr)


LONG, OTHER, ACCENTS = "A sentence that is a good deal longer than forty", "another one, quite long as well, of 45 letters", "é" * 39


def odd_rows():
    rows = [(i, f"{LONG}\nown line {i}\n  {LONG.upper()}\t") for i in range(4)]
    rows += [(None, f"{LONG}\n{OTHER}"), (None, LONG), (2**40, f"x\n{LONG}\ny\n{LONG}\n"), (-5, LONG), (-5, f"{LONG}\nmore")]
    # Found in four documents however often they repeat; a key of 39 code points, and one of 40.
    rows += [(i, OTHER) for i in (20, 21, 22, 22, 22)]
    rows += [(30 + i, f"{ACCENTS}\n{ACCENTS}É\n\n") for i in range(6)]
    rows += [(40, None), (41, ""), (42, "\n"), (43, "word " * 100_000), (44, "line\r"), (45, "\x0b\x0c"), (41, ""), (50, "a\nb\nc")]
    return rows


def test_against_brute_force(spark):
    assert result(spark, odd_rows()) == brute(odd_rows())


@pytest.mark.parametrize("seed", range(2))
def test_random_tables(spark, seed, monkeypatch):
    monkeypatch.setattr(lines, "RUN_KEYS", 50)  # many runs, so that repeats meet in the filters
    monkeypatch.setattr(lines, "BITS_A_KEY", 1 + seed)
    rng = random.Random(seed)
    pool = [f"line number {i} of the pool".ljust(rng.randrange(30, 60), "z") for i in range(300)]
    rows = [(rng.randrange(150), "\n".join(rng.choices(pool, k=rng.randrange(6)))) for _ in range(400)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows, min_chars=1, min_docs=2) == brute(rows, 1, 2)


def test_few_unique_lines_are_suspected(spark):
    docs = spark.range(4000).select(
        F.struct(F.col("id"), F.lit(0).cast("long").alias("version")).alias("owner"),
        F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit("\n"), F.sha2((F.col("id") % 50).cast("string"), 256)).alias("text"),
    )
    found = [bytes(r["digest"]) for r in lines.suspects(docs).select("digest").distinct().collect()]
    repeated = {lines.digest_of(hashlib.sha256(str(i).encode()).hexdigest().encode()) for i in range(50)}
    assert repeated <= set(found) and len(found) < 50 + 4000 * 0.15


def test_filters_merge_without_losing_a_key():
    rng = np.random.default_rng(0)
    a, b = lines._places(rng.integers(0, 1 << 63, 500).astype("<u8"), 1 << 12)
    assert a.max() < 1 << 12 and b.max() < 1 << 12 and (a != b).mean() > 0.99
    bits = rng.random(1 << 12) < 0.3
    assert (lines._unpacked(lines._packed(bits)) == bits).all()


def test_a_hot_line_and_empty_tables(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(LONG).alias("text"))
    got = lines.dedup(docs).groupBy("lines.n_dropped").count().collect()
    assert sorted(map(tuple, got)) == [(0, 1), (1, 4999)]
    assert lines.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        lines.dedup(docs, min_docs=1)
