import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from daywatch.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string, unit int"
TEXTS = [
    "Hello, World! it's 2024\nÀ la carte", None, "", " \t\n", "é ́x ÀÉ İstanbul ΣΑΣ", "<|endoftext|> a<|startoftext|>b", "中文 テスト 😀😀",
    "word " * 9000, "don't I'LL 'tis x y z \x1c \x85", "a" * 30_000, "one two three", "one two three",
    "YENİ. क़. şarkıİ, ΣΑΣ. é́, ﬁ.",
]


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def packed(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "", 0), (10, TEXTS[10], "", 0)]
    return rows, packing.pack(spark.createDataFrame(rows, SCHEMA), PATH, 2, capacity=512, keep_ids=True).cache()


def test_every_token_lies_in_one_piece(packed):
    rows, got = packed
    pieces = got.drop("ids").toPandas()
    assert pieces.length.between(1, 512).all()
    for doc_id, text, *_ in rows:
        own = pieces[pieces.doc_id.isna() if doc_id is None else pieces.doc_id == doc_id]
        ids, copies = ids_of(text), sum(r[0] == doc_id for r in rows)
        assert (own.doc_tokens == len(ids)).all() and own.length.sum() == copies * len(ids)
        assert sorted(own.start) == sorted(s for s in range(0, len(ids), 512) for _ in range(copies))
        for p in own.itertuples():
            part = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert zlib.crc32(part) == p.ids_crc32


def test_sequences_have_no_gaps(packed):
    pieces = packed[1].drop("ids").toPandas().sort_values(["sequence_id", "offset"])
    for _, group in pieces.groupby("sequence_id"):
        assert group.offset.tolist() == [0, *np.cumsum(group.length)[:-1]]
        assert group.length.sum() <= 512


def test_sequence_rows(packed):
    got = packing.sequences(packed[1]).collect()
    assert sum(r["n_tokens"] for r in got) == sum(len(ids_of(t)) for _, t, *_ in packed[0])
    for r in got:
        assert len(r["input_ids"]) == r["n_tokens"]
        for doc, start, at, end in zip(r["doc_ids"], r["starts"], r["offsets"], [*r["offsets"][1:], r["n_tokens"]]):
            text = "no id" if doc is None else TEXTS[doc]
            assert r["input_ids"][at:end] == ids_of(text)[start : start + end - at]


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once_with_little_padding(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(4 - seed / 2, 1, 20_000).astype(int) + 1, 64)
    counts = np.bincount(lengths, minlength=65)
    plan = packing.Plan(counts)
    rank = np.concatenate([np.arange(n) for n in counts])
    unit = np.repeat(np.arange(65), counts)
    sequence, slot = plan.place(unit, rank)
    fill = np.bincount(sequence, unit, plan.sequences)
    assert fill.max() <= 64 and len(set(zip(sequence, slot))) == len(unit)
    assert plan.sequences <= 1.01 * lengths.sum() / 64 + 64


@pytest.mark.parametrize("words", [0, 1, 6, 30, 200, 700])
def test_short_texts_are_packed_with_little_padding(spark, words):
    docs = spark.range(12_000).select("id", F.concat(F.repeat(F.lit("word "), F.lit(words)), F.lit("no")).alias("text"))
    docs = docs.select(F.col("id").alias("doc_id"), F.when(F.lit(words > 0), F.col("text")).alias("text"))
    got = packing.pack(docs, PATH, 2)
    row = got.agg(F.sum("length"), F.countDistinct("sequence_id"), F.count("*")).first()
    assert row[2] == 12_000 and row[0] == 12_000 * (words + 2 if words else 1)
    best = -(-12_000 // (4096 // (words + 2))) if words else 3
    assert row[1] <= max(1.02 * row[0] / 4096, best) + 40


@pytest.mark.parametrize("first", range(0, 0x30000, 0x8000))
def test_every_letter_and_mark_before_a_stop_or_comma(first):
    """Alone, and within a text: what a letter becomes in normal form decides what it is one token with."""
    library, own = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    kinds = ("L", "M")
    found = [chr(c) for c in range(first, first + 0x8000) if unicodedata.category(chr(c))[0] in kinds]
    texts = [x for c in found for x in (f"{c}.", f"{c},", f"ab{c}.", f"x {c}y, {c}. z")] or [""]
    ids, sizes = own.encode(pa.array(texts))
    ends = np.cumsum(sizes)
    wanted = library.encode_batch_fast(texts, add_special_tokens=False)
    wrong = [t for t, w, a, b in zip(texts, wanted, ends - sizes, ends) if w.ids != ids[a:b].tolist()]
    assert not wrong


def test_kept_words_are_few_and_right(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 40)
    library, own = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    rng = np.random.default_rng(0)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice(list("abcé1."), 3)) for _ in range(20)) for _ in range(5)] + [None]
        ids, sizes = own.encode(pa.array(texts))
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert len(own.letters.keys) < 200
    assert own.encode(pa.array([], pa.string()))[0].tolist() == []


def test_linear_program_reaches_its_bound():
    counts = np.zeros(11, np.int64)
    counts[[7, 5, 3]] = [30, 40, 50]
    patterns, uses = packing.solve(counts)
    assert (patterns @ uses >= counts - 1e-6).all() and (np.arange(11) @ patterns <= 10).all()
    assert uses.sum() == pytest.approx(30 + 20 + 20 / 3, rel=0.01)


def test_knapsack_is_exact():
    counts, worth = packing.knapsack(np.array([3, 4, 5]), np.array([4.0, 5.0, 7.0]), 7)
    assert worth == 9 and counts.tolist() == [1, 1, 0]


def test_empty(spark):
    got = packing.pack(spark.createDataFrame([], SCHEMA), PATH, 2, keep_ids=True)
    assert got.count() == 0 and packing.sequences(got).count() == 0
