import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from daywatch.llm import lm

SCHEMA = "doc_id long, text string, n_tokens string, _row int, _gain string"


def chain(rng, n):
    """Text in which each word follows from the one before."""
    word, out = rng.randrange(60), []
    for _ in range(n):
        out.append(f"W{word}")
        word = (word * 7 + rng.randrange(2)) % 60
    return " ".join(out)


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(0)
    rows = [(i, chain(rng, rng.randrange(50, 400)) + f" once{i}", "x", 1, "y") for i in range(2000)] + [(None,) * 5]
    return lm.train(spark.createDataFrame(rows, SCHEMA).repartition(3), rounds=2)


# A plain version: a loop over words, each probability written out.


def plain_log_prob(net, left, token, right):
    """ln p(token | two tokens on each side), from the parameters alone."""
    p = {k: v.astype(np.float64) for k, v in net.parts.items()}
    h = np.tanh(p["bias"] + sum(p["around"][i][t] for i, t in enumerate([*left, *right])))
    classes = [float(h @ p["classes"][c] + p["class_bias"][c]) for c in range(net.side)]
    c, w = divmod(token, net.side)
    inner = [float(h @ p["words"][c][k] + p["word_bias"][c][k]) for k in range(net.side)]
    return classes[c] - math.log(sum(map(math.exp, classes))) + inner[w] - math.log(sum(map(math.exp, inner)))


def plain_spelling(word, counts):
    """ln p(letters, end) under letter pairs counted once more than met, times the number of buckets."""
    letters = [256, *word.encode(), 256]
    total = math.log(lm.BUCKETS)
    for a, b in zip(letters, letters[1:]):
        total += math.log((counts[a, b] + 1) / (sum(n for (x, _), n in counts.items() if x == a) + 257))
    return total


def plain_score(text, words, net, pairs):
    known = {w: i for i, w in enumerate(words.known.to_pylist())}
    split = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    ids = [known.get(w, words.first_bucket + int(lm.buckets(pa.array([w]))[0])) for w in split]
    end = net.side**2
    line = [end, end, *ids, end, end]
    total = 0.0
    for i, (w, t) in enumerate(zip(split, ids)):
        total += plain_log_prob(net, line[i : i + 2], t, line[i + 3 : i + 5])
        if w not in known:
            total += plain_spelling(w, pairs)
    return len(ids), total


def test_scores_against_a_plain_version(spark, trained):
    words, net = lm.read_words(trained), lm.Network(lm.read_values(trained.values))
    pairs = Counter()
    rng = random.Random(0)
    for i in range(2000):
        chain(rng, rng.randrange(50, 400))
        for letters in [[256, *f"once{i}".encode(), 256]]:
            pairs.update(zip(letters, letters[1:]))
    rows = [(1, "W1 w7 unseen W49 é\u00a0x"), (2, ""), (3, None), (None, "W1"), (1, "W1 w7 unseen W49 é\u00a0x"), (5, " \n once1999\t"), (6, "\x00")]
    got = lm.score(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA), trained)
    assert got.columns == ["doc_id", "text", "n_tokens", "_row", "_gain", "_n_tokens", "log_prob", "mean_log_prob"]
    got = got.collect()
    assert len(got) == len(rows) and all(r["_row"] == 1 and r["_gain"] == "y" for r in got)
    for r in got:
        n, total = plain_score(r["text"], words, net, pairs)
        assert r["_n_tokens"] == n and r["log_prob"] == pytest.approx(total, rel=1e-5, abs=1e-6)
        assert r["mean_log_prob"] == (pytest.approx(r["log_prob"] / n) if n else None)


def test_gradients_are_finite_differences():
    rng = np.random.default_rng(0)
    net = lm.Network(rng.normal(0, 0.5, lm.n_values(3)))
    context, token = rng.integers(0, 10, (4, 40)), rng.integers(0, 9, 40)
    dense = {k: np.zeros(v.shape) for k, v in net.parts.items()}
    for name, at, g in net.gradients(context, token):
        dense[name][at] += g

    def loss():
        each = [plain_log_prob(net, context[:2, i], int(t), context[2:, i]) for i, t in enumerate(token)]
        return -sum(each) / len(each)

    for name, part in net.parts.items():
        flat = part.reshape(-1)
        for i in rng.choice(len(flat), min(12, len(flat)), replace=False):
            held, step = flat[i], np.float32(1e-2)
            flat[i] = held + step
            high, up = loss(), float(flat[i])
            flat[i] = held - step
            low, down = loss(), float(flat[i])
            flat[i] = held
            assert dense[name].reshape(-1)[i] == pytest.approx((high - low) / (up - down), abs=2e-4), name


def test_held_out_texts_beat_the_unigram_and_shuffled_texts_do_not(spark, trained):
    rng = random.Random(1)
    rows = []
    for i in range(40):
        words = chain(rng, 200).split()
        rows.append((i, " ".join(words), "x", 1, None))
        rng.shuffle(words)
        rows.append((100 + i, " ".join(words), "x", 1, None))
    got = lm.score(spark.createDataFrame(rows, SCHEMA), trained).toPandas()
    natural, shuffled = (got[m].mean_log_prob for m in (got.doc_id < 100, got.doc_id >= 100))
    assert natural.mean() > -np.log(60) + 1 and natural.mean() > shuffled.mean() + 1
    assert (natural.values > shuffled.values).mean() > 0.95


def test_probabilities_add_up(trained):
    net = lm.Network(lm.read_values(trained.values))
    size = net.side**2
    context = np.repeat(np.array([[3], [4], [5], [size]]), size, axis=1)
    assert np.exp(net.log_probs(context, np.arange(size))).sum() == pytest.approx(1, rel=1e-4)
    table = lm.read_words(trained).table
    assert np.allclose(np.exp(table).sum(1), 1)


def test_every_place_is_masked_once(spark, monkeypatch):
    """A network that counts what it learns instead."""
    rng = random.Random(5)
    texts = [chain(rng, rng.randrange(1, 30)) for _ in range(200)] + ["first"]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], SCHEMA)
    counts = lm.word_counts(docs)
    model = lm.Model(lm._written(lm.vocabulary(counts), "v"), lm._written(spark.range(0).selectExpr("id AS pair", "id AS n"), "p"), "")
    lines = [lm.blobs.unpack(r["data"])[0] for r in lm.token_lines(docs, "text", model).collect()]
    end = lm.read_words(model).side ** 2
    assert sum(int((x != end).sum()) for x in lines) == sum(len(t.split()) for t in texts)
    for line in lines:
        at = np.nonzero(line != end)[0]
        mixed = (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        shares = [((mixed >> np.uint64(40)) + np.uint64(i)) % np.uint64(3) == 0 for i in range(3)]
        assert (np.sum(shares, 0) == 1).all() and min(map(np.sum, shares)) > 0.2 * len(at)


def test_gibberish_costs_more_than_words_like_those_met(spark):
    rng = random.Random(3)
    syllables = ["ra", "men", "te", "lo", "vi", "dos"]
    invent = lambda: "".join(rng.choice(syllables) for _ in range(4))
    rows = [(i, " ".join(invent() for _ in range(60)), "x", 1, "y") for i in range(300)]
    model = lm.train(spark.createDataFrame(rows, SCHEMA))
    asked = [(1, " ".join(invent() + "ra" for _ in range(30))), (2, " ".join("".join(rng.choices("qxzkjwy", k=10)) for _ in range(30)))]
    got = {r["doc_id"]: r["mean_log_prob"] for r in lm.score(spark.createDataFrame([(*a, "x", 1, "y") for a in asked], SCHEMA), model).collect()}
    assert got[1] > got[2] + 10


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    model = lm.train(docs)
    assert lm.score(docs, model).count() == 0
    assert lm.score(spark.createDataFrame([(1, "a b", "x", 1, "y")], SCHEMA), model).first()["log_prob"] < 0


def test_the_vocabulary_grows_with_the_corpus(spark):
    def size(n):
        counts = spark.range(20_000).selectExpr("concat('w', id) AS word", f"{n} + id % 7 AS n")
        rows = lm.vocabulary(counts).orderBy("rank").collect()
        assert [r["rank"] for r in rows] == list(range(len(rows))) and rows[0]["word"] == "w1000"
        total = sum(n + i % 7 for i in range(20_000))
        assert len(rows) == int(20 * total ** (1 / 3))
        return len(rows)

    assert 5 * size(2) < size(2000) < 20_000


def test_buckets_and_lines():
    words = pa.array([f"w{i}" for i in range(5000)] + ["é" * 40])
    found = lm.buckets(words)
    assert found.min() >= 0 and found.max() < lm.BUCKETS and np.bincount(found, minlength=64).min() > 30
    assert lm.buckets(words.slice(70, 3)).tolist() == found[70:73].tolist()
    flat, starts = lm.lower_words(pa.array([" A b\n", None, "", "Ç\x0bd "]))
    assert flat.to_pylist() == ["a", "b", "Ç", "d"] and starts.tolist() == [0, 2, 2, 2, 4]
    assert lm.line_of(np.arange(4), starts, 9).tolist() == [9, 9, 0, 1, 9, 9, 9, 9, 9, 9, 2, 3, 9, 9]
