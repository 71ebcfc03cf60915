import textwrap

import oracle
from pyspark.sql import functions as F

from seriesloom.llm import license_scan as ls
from seriesloom.plans.scratch import Scratch


def run(spark, rows, known=None):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, license string")
    return [(r["doc_id"], r["license"], r["line_licenses"]) for r in ls.scan(docs, ls.known_digests(spark, known), Scratch(spark, "t")).collect()]


def test_same_as_sql(spark):
    oracle.assert_same(spark, ls.op1, ls.OP1_SQL)
    assert {r["line_licenses"] for r in ls.op1(spark, oracle.SF).collect()} > {"MIT", "Apache-2.0"}


def test_equivalent_spellings_match_as_a_whole(spark):
    isc = next(t for n, t in ls.KNOWN if n == "ISC")
    zlib = next(t for n, t in ls.KNOWN if n == "Zlib")
    rows = [
        (1, "Copyright (c) 2020 A. Person\n\n" + isc.upper().replace(",", " ,\t"), "clash"),
        (2, zlib.replace("acknowledgment", "Acknowledgement"), None),
        (3, isc + " and one more word", None),
        (4, "word\nreleased under THE m.i.t licence\nReleased under the MIT licence\nreleased -- under the MIT license!!", None),
    ]
    got = dict((a, (b, c)) for a, b, c in run(spark, rows))
    assert got[1] == ("ISC", None) and got[2] == ("Zlib", None) and got[3] == (None, None) and got[4] == (None, ["MIT"])


def test_odd_inputs(spark):
    rows = [(None, None, None), (5, "", None), (5, "...", None), (7, "Licensed under CC BY-NC 4.0.", None), (7, "Licensed under CC BY-NC 4.0.", None), (8, "x " * 200_000, None)]
    got = run(spark, rows)
    assert len(got) == 6 and got.count((7, "CC-BY-NC-4.0", ["CC-BY-NC-4.0"])) == 2
    assert run(spark, []) == []
    own = spark.createDataFrame([("mine", "my own terms"), (None, "x"), ("none", "!!")], "license string, text string")
    assert sorted(run(spark, [(1, "My OWN terms.", None), (2, "x", None)], own)) == [(1, "mine", ["mine"]), (2, None, None)]


def test_wrapping_and_comment_marks_do_not_matter(spark):
    heads = ["", "Copyright (c) 2020 A. Person\n", "Copyright 2019-2021 The Authors. All rights reserved.\n\n", "(C) 2020 A. Person\nAll rights reserved.\n", "Copyright The Loom Authors\n", "© A. Person\n", "Copyright [yyyy] [name of copyright owner]\n"]
    wrap = lambda text, width: "\n".join(textwrap.fill(x, width, break_on_hyphens=False) for x in text.split("\n"))
    mark = lambda text, m: "\n".join((m + x).rstrip() for x in text.split("\n"))
    texts = [t for _, t in ls.KNOWN[4:]]
    rows = [(t, mark(heads[w % len(heads)] + wrap(texts[t], w), ["", "# ", " * ", "// ", "-- "][w % 5])) for t in range(len(texts)) for w in range(30, 110)]
    rows += [(t, mark(h + wrap(texts[t], 72).upper(), "# ")) for t in range(len(texts)) for h in heads]
    got = run(spark, [(i, text, None) for i, (_, text) in enumerate(rows)])
    assert [i for i, license, _ in got if license != ls.KNOWN[4 + rows[i][0]][0]] == []


def test_only_copyright_lines_go(spark):
    kept = ["copyright notice and this permission", "Copyright Holder", "copyright the software, and", "(c) You must retain", "# copyright law", "all rights reserved to others", "COPYRIGHT HOLDERS BE LIABLE"]
    gone = ["copyright 2020 x", "COPYRIGHT (C) X", "/* Copyright IBM Corp. */", "<!-- (c) Copyright 1999 -->", "; All Rights Reserved.", "%% © x", "// Copyright by Anna Person", "Copyright <year> <owner>"]
    lines = ls.canonical(spark.createDataFrame([(x,) for x in kept + gone], "t string"), F.col("t")).select("t", F.size("__lines").alias("n")).collect()
    assert {r["t"]: r["n"] for r in lines} == dict.fromkeys(kept, 1) | dict.fromkeys(gone, 0)


def test_common_licences_are_known_as_files_have_them(spark):
    texts = {f.stem: f.read_text() for f in ls.FOLDER.glob("*.txt")}
    assert set(texts) == {"Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"}
    apache = texts["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 A. Person")
    mit = next(t for n, t in ls.KNOWN if n == "MIT" and len(t) > 200)
    rows = [(n, "\n".join(f"// {x}" for x in t.upper().split("\n"))) for n, t in sorted(texts.items())] + [
        ("Apache-2.0", apache), ("Apache-2.0", apache.partition("   END OF TERMS")[0]), ("MIT", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + mit),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, A. Person\nAll rights reserved.\n\n" + texts["BSD-3-Clause"]), (None, apache.replace("perpetual", "brief")),
    ]
    got = {i: license for i, license, _ in run(spark, [(i, t, None) for i, (_, t) in enumerate(rows)])}
    assert [got[i] for i in range(len(rows))] == [n for n, _ in rows]


def test_every_other_spelling_is_found_and_kept_alike(spark):
    rows = [(i, f"{mark}{found.upper()}{mark}word", None) for i, (found, _) in enumerate(ls.SPELLINGS) for mark in (" ", "\r\n", "--")]
    forms = {(r["doc_id"], r["__form"]) for r in ls.canonical(spark.createDataFrame(rows, "doc_id bigint, text string, license string"), F.col("text")).collect()}
    assert forms == {(i, f"{keep} word") for i, (_, keep) in enumerate(ls.SPELLINGS)}


def test_very_long_texts(spark):
    isc = next(t for n, t in ls.KNOWN if n == "ISC")
    rows = [(1, "\n".join(f"line {i} of many" for i in range(300_000)) + "\nReleased under the MIT License.", None), (2, "\n" * 3_000_000 + isc, None)]
    assert sorted(run(spark, rows)) == [(1, None, ["MIT"]), (2, "ISC", None)]
