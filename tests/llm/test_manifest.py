import random
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from daywatch.llm import manifest

SCHEMA = "doc_id long, source string, text string, g string, idx string, leaf int"
FIELDS = ["doc_id", "source", "text"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Levels from the nodes up to the single one."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 16]) for i in range(0, len(below), 16)])
    return levels


def siblings(levels, at):
    for nodes in levels[:-1]:
        begin = at - at % 16
        yield nodes[begin:at], nodes[at + 1 : begin + 16]
        at //= 16


def brute(rows, lowered):
    """rows (doc_id, source, text); ``lowered`` rows show their text in lower case."""
    groups = defaultdict(list)
    for i, source, text in rows:
        shown = text.lower() if text and lowered(i) else text
        groups[source].append((i is not None, i or 0, h(*map(field, (i, source, text))), h(*map(field, (i, source, shown)))))
    names = sorted(groups, key=lambda s: b"" if s is None else b"=" + s.encode())
    trees = {}
    for s in names:
        groups[s].sort()
        trees[s] = tree([leaf for _, _, leaf, _ in groups[s]])
    upper = tree([trees[s][-1][0] for s in names])
    root = upper[-1][0]
    out = []
    for g, s in enumerate(names):
        for at, (known, i, leaf, claim) in enumerate(groups[s]):
            path = [*siblings(trees[s], at), *siblings(upper, g)]
            node = claim
            for a, b in path:
                node = h(*a, node, *b)
            proof = h(*(x for a, b in path for x in [*a, *b]))
            out.append((i if known else None, leaf, trees[s][-1][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x", None, 1) for r in rows], SCHEMA).repartition(3)
    shown = [F.col("doc_id"), F.col("source"), F.translate("text", "ABC", "abc")]
    got = manifest.manifest(docs, FIELDS, claim=F.when(F.col("doc_id") % 5 == 0, manifest.leaf(shown)))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


def wanted(rows):
    return brute(rows, lambda i: i is not None and i % 5 == 0)


def test_groups_of_many_sizes(spark):
    rows = [(1000 * n + 3 * i, f"s{n}", f"ABC {i}") for n in (1, 2, 15, 16, 17, 255, 256, 257, 300) for i in range(n)]
    got = run(spark, rows)
    assert got == wanted(rows)
    assert not all(r[-1] for r in got) and sum(r[-1] for r in got) > len(got) / 2


def test_odd_ids_texts_and_groups(spark):
    rng = random.Random(0)
    ids = [0, 1, -1, 63, 64, -64, -65, 2**63 - 1, -(2**63), 2**62, 65536 * 64, 65536 * 64 - 1, -(2**22), 5 * 2**38, *(rng.randrange(-(2**63), 2**63) for _ in range(60))]
    sources = [None, "", "é", "z", "Z", "\U0001f600", "￮"]
    rows = [(i, rng.choice(sources), rng.choice(["A B", None, "", "éA"])) for i in ids] + [(7, None, "A" * 200_000), (8, "only", "B")]
    assert run(spark, rows) == wanted(rows)


def test_repeated_and_missing_ids(spark):
    rows = [(i % 7, "s", f"A{i % 11}") for i in range(300)] + [(None, "s", "B")] * 20 + [(None, "t", "B"), (5, "t", "B"), (5, "t", None)]
    rows += [(1, None, None)] * 40 + [(None, None, None)]
    assert run(spark, rows) == wanted(rows)


def test_many_groups(spark):
    rows = [(i, f"s{i % 600}", "A") for i in range(700)]
    assert run(spark, rows) == wanted(rows)


def test_one_row_and_none(spark):
    assert run(spark, [(5, "s", "a")]) == wanted([(5, "s", "a")])
    got = run(spark, [(10, "s", "A")])
    assert got == wanted([(10, "s", "A")]) and got[0][-1] is False
    assert run(spark, []) == []


def test_more_than_a_block(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("t").alias("text"))
    got = sorted(map(tuple, manifest.manifest(docs, FIELDS).collect()))
    assert got == sorted(brute([(i, "s", "t") for i in range(9000)], lambda i: False))
    assert all(r[-1] for r in got)


@pytest.mark.parametrize("n,levels", [(1, 0), (2, 1), (16, 1), (17, 2), (256, 2), (257, 3), (4096, 3), (4097, 4)])
def test_levels(spark, n, levels):
    assert spark.range(1).select(manifest._levels(F.lit(n))).first()[0] == levels
