import pytest

from sievelake.llm import license_sql, licenses, queries
from sievelake.llm.license_texts import TEXTS, known_texts, stored_texts
from tests.oracle import compare, duck, rows_of


def found(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license_id string")
    return [r.license_id for r in sorted(licenses.scan(docs).collect(), key=lambda r: r.doc_id)]


def test_known_texts_find_themselves(spark):
    assert found(spark, [t for _, t in known_texts()]) == [i for i, _ in known_texts()]


def test_spelling_case_punctuation_and_copyright_lines(spark):
    bsd = next(t for i, t in TEXTS if i == "BSD-3-Clause")
    mit = next(t for i, t in TEXTS if i == "MIT")
    assert found(spark, [
        "Copyright (c) 2001, Somebody\nAll rights reserved.\n\n" + bsd.upper(),
        " * Copyright © 1999-2003 A & B\n" + bsd.replace("holder", "owner").replace("\n", "\r\n * "),
        mit.replace("MIT License", "The  MIT Licence".replace("The  ", "")).replace("sublicense", "sublicence").replace('"', "''"),
        mit + " And more.", mit[:-40], "", None, "...",
        "licensed under the Apache Licence - version 2.0",
    ]) == ["BSD-3-Clause", "BSD-3-Clause", "MIT", None, None, None, None, None, "Apache-2.0"]


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "Licensed under CC0 1.0"), (None, "Licensed under CC0 1.0"), (2, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.license_id) for r in licenses.scan(docs).collect()), key=str) == [(2, None), (None, "CC0-1.0"), (None, "CC0-1.0")]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_spellings_are_whole_words(spark):
    """Addresses with either scheme, neighbours, inflections; words that only hold a spelling stay."""
    rows = [
        ("see http://x.org now", "see https://x.org now"), ("a centre, centre", "A CENTER CENTER"), ("sub-licences and sublicensed", "sublicenses & sublicensed"),
        ("licencing organisations recognised", "licensing organizations recognized"), ("the copyright owners' favour", "the copyright holders favor"), ("non-infringement whilst", "noninfringement while"),
    ]
    frame = spark.createDataFrame(rows + [("while students", "students"), ("reality", "realize"), ("wholicence", "wholicense")], "a string, b string")
    got = [(r.x, r.y) for r in frame.select(licenses.canonical(frame.a).alias("x"), licenses.canonical(frame.b).alias("y")).collect()]
    assert all(x == y for x, y in got[:6]) and got[0][0] == "see http x org now"
    assert got[6:] == [("while students", "students"), ("reality", "realize"), ("wholicence", "wholicense")]


def license_files():
    """A corpus in which licence files occur: whole, restyled, respelt, cut, and among other texts."""
    rows = []
    for spdx, text in stored_texts() + TEXTS:
        again = "\n".join("# " + line for line in text.splitlines())
        rows += [(text, spdx), ("Copyright (c) 2020 Somebody\n\n" + again.upper(), spdx), (text.replace("license", "licence").replace("http:", "https:"), spdx), (text[: len(text) // 2], None), (text + "\nAnd also this.", None)]
    return [(i, t, s) for i, (t, s) in enumerate([*rows, ("plain words", None), ("", None), (None, None)])]


def test_license_files(spark):
    rows = license_files()
    digest_of = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, spdx string")).collect():
        digest_of[r.doc_id] = (r.text_digest, r.license_id)
    assert {i: s for i, _, s in rows} == {i: s for i, (_, s) in digest_of.items()}
    assert sum(s is not None for _, _, s in rows) > 90
    db = duck("/root/testdata/sf0.001")
    db.execute("CREATE TABLE files (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO files VALUES (?, ?)", [(i, t) for i, t, _ in rows])
    assert rows_of(["d", "t", "l"], db.execute(license_sql.scan_sql("files")).fetchall()) == rows_of(["d", "t", "l"], [(i, *x) for i, x in digest_of.items()])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_sql(spark, sf):
    assert compare(spark, queries.op3_license_digests, queries.oracle_sql()["op3_license_digests"], sf) == 1000
