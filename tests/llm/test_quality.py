import random

from pyspark.sql import functions as F

from daywatch.llm import quality
from tests.llm.brute import counts

SCHEMA = "doc_id long, text string, lang string, source string, quality int, n_words string"


def documents():
    rng = random.Random(1)
    rows = []
    for i in range(400):
        n = rng.randrange(30, 200)
        words = [rng.choice("abcdefghij") * rng.randrange(1, 9) + str(rng.randrange(500)) for _ in range(n)]
        if i % 9 == 0:
            words = [w + "###" for w in words]
        if i % 11 == 0:
            words = words[:5] * 40
        text = " ".join(words)
        if i % 13 == 0:
            text = "\n".join([text[:80]] * 12 + [text])
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s0"] * 4 + ["s1", None])))
    rows += [(900, None, "en", "s0"), (901, "", "fr", None), (None, "x y z", None, "s9"), (902, "w " * 50_000, "en", "s0")]
    return rows + [rows[0], (0, rows[0][1], "en", "s0")]


def floor7(v):
    s = max(v.bit_length() - 7, 0)
    return v >> s << s


def verdicts(rows):
    rated = []
    for _, text, lang, source in rows:
        n, chars, symbols, dup, repeat = counts(text)
        lines = [x for x in (text or "").split("\n") if x.split()]
        rated.append(
            (lang, source, symbols * 10_000 // chars if chars else 0, dup * 10_000 // len(lines) if lines else 0,
             repeat * 10_000 // n if n else 0, chars * 100 // n if n else 0, n < 50 or 100 * repeat > 50 * n)
        )
    out, good = [], [r for r in rated if not r[6]]
    for r in rated:
        if r[6]:
            out.append((True, False))
            continue
        for group in ([x for x in good if x[:2] == r[:2]], [x for x in good if x[0] == r[0]], good):
            if len(group) >= quality.GROUP_ROWS:
                break
        ok = True
        for k, least in enumerate(quality.RATES.values(), 2):
            v = sorted(floor7(x[k]) for x in group)
            q1, q2, q3 = (v[-(-len(v) * q // 4) - 1] for q in (1, 2, 3))
            ok = ok and r[k] <= q2 + quality.SPREADS * max(q2 - q1, least)
            ok = ok and (k < 5 or r[k] >= q2 - quality.SPREADS * max(q3 - q2, least))
        out.append((r[6], ok))
    return out


def test_against_brute_force(spark):
    rows = documents()
    docs = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)
    got = quality.judge(docs)
    assert got.columns == [*docs.columns, "_quality"]
    q = F.col("_quality")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    found = got.select("doc_id", *[q[n] for n in names]).collect()
    wanted = [(r[0], *counts(r[1]), *v) for r, v in zip(rows, verdicts(rows))]
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
    assert 100 < sum(v[1] for v in verdicts(rows)) < 380
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(v[1] for v in verdicts(rows))


def test_sketches_merge(spark):
    rows = spark.range(1000).select(
        (F.col("id") % 3).cast("string").alias("lang"), *[(F.col("id") * (i + 1)).alias(r) for i, r in enumerate(quality.RATES)]
    )
    whole = quality.sketches(rows.withColumn("lang", F.lit("x")), ["lang"])
    merged = quality.merge_sketches(quality.sketches(rows, ["lang"]).withColumn("lang", F.lit("x")), ["lang"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))


def test_empty(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0
