import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from daywatch.llm import bpe, catalog

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["a", "b", "s", "t", "re", "ve", "ll", "'", "'s", "'re", " ", "  ", "\n", "\t", "1", "22", "!", "é", "ß", "　", "😀", "中", "-", "\r\n", "\x1c", "\x85", "'d", "'m"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(4)
    out = ["".join(rng.choices(PARTS, k=rng.randrange(0, 30))) for _ in range(3000)]
    return out + ["x" * 3000, "ab" * 500, "!?" * 700, "\n" * 999, "'s" * 300, "<|endoftext|>", "", " ", "it's 'tis we'll 5's '''s"]


def test_ids_are_the_library_s(library):
    own = bpe.codec(PATH)
    every = texts()
    for text, ids in zip(every, own.encode([t.encode() for t in every])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(ids, own.ends(ids)) == text.encode()


def test_splits_are_the_pattern_s():
    own, pattern = bpe.codec(PATH).splitter, regex.compile(public_tokenizers.PATTERN)
    every = texts()
    raw, offsets, counts = own.split([t.encode() for t in every])
    slices, at = [raw[a:b].decode() for a, b in zip(offsets, offsets[1:])], 0
    for text, n in zip(every, counts):
        assert slices[at : at + n] == pattern.findall(text)
        at += n


def test_every_code_point(library):
    own = bpe.codec(PATH)
    every = [f"a{c}1 {c}{c}b" for c in map(chr, range(0x3400)) ] + [f"a{chr(i)}1 {chr(i)}b" for i in range(0xE000, 0x20000, 7)]
    for text, ids in zip(every, own.encode([t.encode() for t in every])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_scan_is_the_automaton_step_by_step():
    own, rng = bpe.Splitter(), np.random.default_rng(0)
    kinds = rng.integers(0, 9, 10_000)
    states = own.acts[own.scan(own.of_class[kinds]), bpe.BREAK]
    state = bpe.BREAK
    for kind, found in zip(kinds.tolist(), states.tolist()):
        state = bpe.step(state, kind)[0]
        assert state == found


def test_rows(spark, library):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate([*texts()[-9:], None, "long text " * 20_000])] + [(None, "a b", None, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, ends int, decoded int")
    coded = bpe.encode(docs, PATH)
    assert coded.columns == [*docs.columns, "_ids", "_ends"]
    back = bpe.decode(coded, PATH, "_ids", "_ends")
    for r in back.collect():
        text = r["text"] or ""
        assert np.frombuffer(r["_ids"], "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(r["_decoded"]) == text.encode()
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH, "_ids", "_ends").count() == 0


def test_query(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    wanted = {}
    for r in docs:
        ids = library.encode_ordinary(r["text"] or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        wanted[r["doc_id"]] = (len(ids), digest, hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = catalog.op10_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == wanted
