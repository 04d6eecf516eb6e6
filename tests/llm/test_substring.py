import random

from pyspark.sql import functions as F

from daywatch.llm import substring
from daywatch.llm.blobs import pack, unpack
from tests.llm.brute import without_repeats

SCHEMA = "doc_id long, text string, parsed string, chunk int"


def documents():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["É", "x\u00a0y", "\u3000"]
    line = lambda n: " ".join(rng.choices(vocab, k=n))
    shared = [line(n) for n in (12, 13, 14, 30, 60)]
    rows = []
    for i in range(120):
        parts = [line(rng.randrange(0, 40)) for _ in range(3)]
        for _ in range(rng.randrange(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "a " * 60), (203, "a " * 13), (204, "a " * 12), (205, None), (206, "")]
    rows += [(None, rows[4][1]), (None, rows[4][1]), (None, line(50)), (207, line(30)), (207, line(30)), (-5, shared[3])]
    rows += [(300, line(30_000)), (301, None)]
    rows[-1] = (301, rows[-2][1][:100_000])
    return rows


def test_against_brute_force(spark):
    rows = documents()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = substring.parsed(docs)
    assert got.columns == ["doc_id", "text", "parsed", "chunk", "_parsed"]
    p = F.col("_parsed")
    found = got.select("doc_id", p["n_words"], p["n_removed"], p["kept_text"]).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(without_repeats(rows), key=repr)


def test_factors_follow_their_reference(spark):
    rows = [r for r in documents() if r[0] is not None and r[0] != 207]
    texts = {i: (t or "").encode().split() for i, t in rows}
    docs = spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA)
    n = 0
    for row in substring.parsed(docs).select("doc_id", "_parsed").collect():
        for f in row["_parsed"]["factors"]:
            n += 1
            assert f["ref_id"] < row["doc_id"] and f["length"] >= substring.WINDOW
            own = texts[row["doc_id"]][f["start"] : f["start"] + f["length"]]
            assert own == texts[f["ref_id"]][f["ref_start"] : f["ref_start"] + f["length"]]
    assert n > 50


def test_drop_repeats(spark):
    docs = spark.createDataFrame([(1, "a\tb " * 10, 40), (2, "x " + "a\tb " * 10, 42), (3, "a\n b", 4), (4, None, None)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in substring.drop_repeats(docs).collect()}
    assert got == {1: ("a\tb " * 10, 40), 2: ("x", 1), 3: ("a\n b", 4), 4: (None, None)}


def test_empty(spark):
    assert substring.parsed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blobs():
    import numpy as np

    a, b = np.arange(5, dtype=np.uint64) << np.uint64(40), np.array([3, 1, 4, 1, 5], np.int32)
    x, y = unpack(pack(a, b))
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist()
    assert [len(z) for z in unpack(pack(a[:0], b[:0]))] == [0, 0]
