import textwrap
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from daywatch.llm import check_sql, licenses

SCHEMA = "doc_id long, text string, license_id int, canonical string"


def scan(spark, rows):
    docs = spark.createDataFrame([(*r, 0, "clash") for r in rows], SCHEMA)
    got = licenses.scan(docs, licenses.known_licences(spark)).collect()
    return sorted(((r["doc_id"], r["license_id"], r["notice_ids"], r["n_notices"]) for r in got), key=repr)


def test_whole_texts_in_any_writing(spark):
    changed = licenses.MIT.upper().replace("\n", "\r\n  ").replace(",", " ;").replace("SUBLICENSE", "sublicence")
    rows = [
        (1, licenses.MIT), (2, "The MIT"), (3, "Copyright (c) 2001 Someone\n© Another\n\n" + changed + "\n"),
        (4, licenses.MIT + " extra"), (5, licenses.ISC), (6, "MIT Licence\n\n" + licenses.MIT),
    ]
    assert [r[1] for r in scan(spark, rows)] == ["MIT", None, "MIT", None, "ISC", "MIT"]


def test_notices(spark):
    rows = [
        (1, "Text.\nLicensed under the Apache License, Version 2.0.\nmore"),
        (2, "released under the MIT LICENCE\nLicensed under CC BY-NC 4.0\nReleased under the MIT License."),
        (3, "Licensed under the Apache License, Version 2.0. And more."), (4, None), (5, ""), (None, "Licensed under CC BY 4.0."),
        (6, "SPDX-License-Identifier: MIT"), (6, "SPDX-License-Identifier: MIT"), (7, "Copyright 2020"), (8, "word " * 40_000),
    ]
    assert scan(spark, rows) == sorted(
        [
            (1, None, "Apache-2.0", 1), (2, None, "CC-BY-NC-4.0,MIT", 3), (3, None, None, 0), (4, None, None, 0),
            (5, None, None, 0), (None, "CC-BY-4.0", "CC-BY-4.0", 1), (6, "MIT", "MIT", 1), (6, "MIT", "MIT", 1),
            (7, None, None, 0), (8, None, None, 0),
        ],
        key=repr,
    )


def test_empty_tables(spark):
    assert scan(spark, []) == []
    docs = spark.createDataFrame([(1, licenses.MIT, 0, "")], SCHEMA)
    none = licenses.known_licences(spark).limit(0)
    assert [r["license_id"] for r in licenses.scan(docs, none).collect()] == [None]


def test_digests_do_not_depend_on_the_wrapping(spark):
    rows, expected = [], []
    for name, text in [("MIT", licenses.MIT), ("ISC", licenses.ISC)]:
        for width in [*range(40, 100), 10**6]:
            body = "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n"))
            rows.append((len(rows), "Copyright (c) 2001 Someone\n\n" + body))
            expected.append(name)
    assert [r[1] for r in sorted(scan(spark, rows))] == expected


def test_only_copyright_statements_go(spark):
    gone = [
        "Copyright 2020", "copyright (C) Someone", "  Copyright The Authors", "(c) 2001 Someone", "(c) Someone, 1999",
        "\u00a9 Someone", "(c) Copyright Someone", "Copyright: Someone", "COPYRIGHT\u00a9Someone", "Copyright, 2001 X",
    ]
    kept = [
        "copyright notice and this", "COPYRIGHT HOLDERS BE LIABLE", "copyright owner that", "copyright", "copyrighted 2001",
        "(c) You must retain, in the source form", "copyright license to reproduce", "copyright law",
    ]
    got = scan(spark, [(i, line + "\n" + licenses.MIT) for i, line in enumerate([*gone, *kept])])
    assert [r[1] for r in sorted(got)] == ["MIT"] * len(gone) + [None] * len(kept)


def test_the_sql_says_the_same_of_odd_texts(spark):
    """Rewrapped licences, statement lines of all kinds and notices: the rows of query and SQL."""
    texts = [None, "", "\n \n", "Copyright 2020\nCopyright The Authors\nsome text\n\n(c) 2001 X\r\n", "(c) 12020 x", "(c) a 1999b 20001"]
    for text in (licenses.MIT, licenses.ISC, licenses.BSD_2, licenses.BSD_3):
        for width in (40, 60, 72, 76, 80, 10**6):
            body = "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n"))
            texts += ["Copyright (c) 2001 Someone\nAll rights reserved.\n\n" + body, body.upper(), "  " + body + " x"]
    texts += [f"{line}\n{licenses.MIT}" for line in ("copyright  notice", "Copyright: A", "\u00a9 B", "(C) Copyright C", "copyright holders", "copyright <x>", "copyright")]
    texts += [f"text\n {n.upper()} \nmore\n{n}" for _, n in licenses.KNOWN if "\n" not in n]
    texts += ["re licenced\norganisation's favour; non commercial non\ncommercial", "copyright owner\ncopyright\nowner sub\nlicense"]
    docs = [(i, t) for i, t in enumerate(texts)]
    got = licenses.scan(
        spark.createDataFrame(docs, "doc_id long, text string"), licenses.known_licences(spark), more=licenses.known_digests(spark)
    )
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    sql = check_sql.license_scan(licenses.KNOWN, licenses.SPELLINGS, licenses.KNOWN_DIGESTS, licenses.PROSE)
    want = con.execute(sql).fetchall()
    columns = [d[0] for d in con.description]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want, key=repr)
    found = {r["license_id"] for r in got.collect()}
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"} <= found


TEXTS = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not TEXTS.exists(), reason="the published texts are not installed here")
def test_known_digests_are_those_of_the_published_texts(spark):
    rows = [(p.name, p.read_text(errors="replace")) for p in TEXTS.iterdir()]
    df = spark.createDataFrame(rows, "name string, text string")
    got = {r["d"] for r in df.select(licenses.whole_digest(licenses.canonical(F.col("text"))).alias("d")).collect()}
    assert {d for _, d in licenses.KNOWN_DIGESTS} <= got
