import random

import pytest
from pyspark.sql import functions as F

from daywatch.llm import components, simhash
from tests.llm.brute import fingerprint, near_groups

SCHEMA = "doc_id long, text string, fp string, component_id int"


def documents():
    rng = random.Random(2)
    line = lambda n: [rng.choice(["Alpha", "beta", "GAMMA", "é", "ß", "d", "İx"]) + str(rng.randrange(30)) for _ in range(n)]
    rows, base = [], line(300)
    for i in range(80):
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(300)] = "changed"
        rows.append((i, rng.choice([" ", "\n"]).join(w)))
    rows += [(100 + i, " ".join(line(rng.randrange(1, 60)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, " \t"), (203, "one"), (204, "one two"), (205, "ONE TWO"), (None, "one"), (None, "only here")]
    rows += [(206, "a b c " * 60_000), (3, rows[3][1]), (3, rows[3][1])]
    return rows


def test_fingerprint():
    for _, text in documents():
        assert simhash.fingerprint(None if text is None else text.encode()) == fingerprint(text)


def test_against_brute_force(spark):
    rows = documents()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    wanted = [(i, f"{p:016x}", c) for (i, _), (p, c) in zip(rows, near_groups(rows))]
    assert sorted(map(tuple, simhash.near_copies(docs).collect()), key=repr) == sorted(wanted, key=repr)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(i or -1 for i, _, c in wanted if i == c)


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_crowded_lists_give_the_same_components(spark, bits):
    rng = random.Random(bits)
    prints = []
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            p = centre
            for _ in range(rng.randrange(0, 5)):
                p ^= 1 << rng.randrange(64)
            prints.append(p)
    rows = [(i, None) for i in range(len(prints))]
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    got = simhash.near_groups(spark.createDataFrame(signed, "fp long, doc_id long"), bits)
    found = {r["fp"] % (1 << 64): r["component_id"] for r in got.collect()}
    assert found == dict(near_groups(rows, prints, bits))


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_copies(docs).count() == 0 and simhash.drop_near_copies(docs).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (2001, 2000)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{1000 + i: 1000 for i in range(200)}, 2000: 2000, 2001: 2000}


def test_hex(spark):
    row = spark.createDataFrame([(-1,), (5,)], "fp long").select(simhash.fingerprint_hex(F.col("fp"))).collect()
    assert [r[0] for r in row] == ["f" * 16, "0" * 15 + "5"]


def test_rows_that_repeat_the_surviving_id_are_thinned(spark):
    far = "quite another text " * 30
    rows = [(3, "one text " * 40, 1), (3, "one text " * 40, 2), (5, "one text " * 40, 1), (None, far, 2), (None, far, 1), (3, far + "of the same id " * 20, 7), (None, "third " * 9, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root int")
    got = simhash.drop_near_copies(docs)
    prints = {t: simhash.fingerprint(t.encode()) for _, t, _ in rows}
    assert all(bin(a ^ b).count("1") > 2 for a in prints.values() for b in prints.values() if a != b)
    wanted = [(3, rows[0][1], 1), (None, far, 1), (3, rows[5][1], 7), (None, "third " * 9, 0)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)
    assert simhash.drop_near_copies(docs.union(docs)).count() == 4
