"""The pipeline against plain Python versions of its stages, stage by stage."""

import re

import corpus_pipeline
import __spark_entry__ as entry
from daywatch.llm import packing
from daywatch.llm.catalog import CHECKS, END_ID, QUERIES, word_vocabulary
from tests.llm.brute import near_groups, without_repeats

import pytest

from tests.compare import connect, difference
from tests.llm.test_quality import verdicts

SAMPLE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    result = QUERIES[name](spark, SAMPLE).toPandas()
    assert len(result)
    if name in CHECKS:
        problem = difference(result, connect(SAMPLE).execute(CHECKS[name]).df())
        assert problem is None, problem


def brute(rows):
    """Rows (doc_id, text, lang, source) after each stage but the last."""
    rows = [r for r, (_, ok) in zip(rows, verdicts(rows)) if ok]
    yield rows
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        best[key] = min(best.get(key, r), r, key=lambda x: (-len(x[1] or ""), x[0]))
    rows = sorted(best.values())
    yield rows
    rows = [r for r, (_, least) in zip(rows, near_groups([r[:2] for r in rows])) if r[0] == least]
    yield rows
    kept = without_repeats([r[:2] for r in rows])
    rows = [(r[0], text if gone else r[1], *r[2:]) for r, (_, _, gone, text) in zip(rows, kept)]
    yield rows


def test_stages(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    columns = docs.columns
    narrow = lambda df: sorted(tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect())
    sizes = [docs.count()]
    for (name, stage), wanted in zip(corpus_pipeline.STAGES, brute(narrow(docs))):
        docs = stage(spark, docs, SAMPLE).cache()
        assert docs.columns == columns, name
        assert narrow(docs) == sorted(wanted), name
        assert docs.where("n_chars <> length(text)").count() == 0
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3]
    tokens = packing.pack(docs, word_vocabulary(), END_ID).groupBy().sum("length").first()[0]
    got = corpus_pipeline.run(spark, SAMPLE).toPandas()
    assert got.n_tokens.sum() == tokens and (got.n_tokens <= 4096).all()
    assert sorted({d for row in got.doc_ids for d in row}) == sorted(r["doc_id"] for r in docs.collect())


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_empty_and_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp int, chunk string"
    odd = [(None, None, None, None, None, 1, "x"), (1, "", "en", "s", 0, 1, None), (1, "", "en", "s", 0, 1, None)]
    good = [(2, " ".join(f"word{i}" for i in range(90)), "en", None, 690, 1, "x")] * 2
    for rows in ([], odd, odd + good):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "").cache()
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "chunk"]
        assert docs.count() == (1 if len(rows) > 3 else 0)  # a row given twice stays once
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == (1 if len(rows) > 3 else 0)
