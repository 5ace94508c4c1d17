import hashlib
import re

from pyspark.sql import functions as F

from wayline.llm import licences


def plain(text):
    text = re.sub(licences.COPYRIGHT, "\n", text or "")
    text = text.translate(str.maketrans(licences.UPPER, licences.LOWER))
    text = f" {re.sub(licences.MARKS, ' ', text)} "
    for a, b in licences.SPELLINGS:
        text = text.replace(f" {a} ", f" {b} ")
    return text.strip(" ")


def test_whole_texts_are_found(spark):
    mit = licences.KNOWN["MIT"]
    rows = [
        (1, mit, "MIT"), (2, "Copyright (c) 2020 A\n(C) B\n\n" + mit.upper().replace(". ", ".\n   "), "MIT"), (3, mit + " extra", None), (4, None, None), (5, "", None),
        (6, "!!! ---", None), (7, "released under the mit licence", "MIT-notice"), (8, "// Copyright X\n" + licences.KNOWN["ISC"].replace(",", ""), "ISC"),
        (9, "é " * 50_000, None), (None, licences.KNOWN["0BSD"], "0BSD"), (1, mit, "MIT"),
    ]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in rows], "doc_id bigint, text string, licence_id string, digest string")
    got = licences.scan(frame, licences.known(spark)).collect()
    want = [(i, hashlib.sha256(plain(t).encode()).hexdigest(), k) for i, t, k in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_known_digests_differ(spark):
    assert len({plain(t) for t in licences.KNOWN.values()}) == len(licences.KNOWN)


def test_plan_stays_native_and_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    out = licences.scan(frame, licences.known(spark))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_whole_public_texts_with_their_titles(spark):
    from importlib import resources

    files = {f.name.removesuffix(".txt"): f.read_text() for f in resources.files("wayline.llm").joinpath("licence_texts").iterdir()}
    assert len(files) >= 15
    mit, isc = licences.KNOWN["MIT"], licences.KNOWN["ISC"]
    head, *points, tail = licences._BSD
    rows = [(t, k) for k, t in files.items()] + [(licences.unwrapped(t), k) for k, t in files.items()]
    rows += [(files[k][: files[k].index("END OF TERMS")], k) for k in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1")]
    rows += [(t + "\n extra", None) for t in files.values()]
    rows += [(f"{title}\n\nCopyright (c) 2021 A. Person\n\n{mit}", "MIT") for title in ("MIT License", "The MIT License (MIT)")]
    rows += [(f"ISC License\n\nCopyright (c) 2021, A\n\n{isc}", "ISC"), (f"BSD 3-Clause License\n\nCopyright (c) 2021, A\nAll rights reserved.\n\n{head}\n\n" + "\n\n".join(f"* {p}" for p in points) + f"\n\n{tail}", "BSD-3-Clause")]
    rows += [(f"BSD 2-Clause License\n\n{head}\n1. {points[0]}\n2. {points[1]}\n\n{tail}", "BSD-2-Clause")]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: r.licence_id for r in licences.scan(frame, licences.known(spark)).collect()}
    assert [got[i] for i in range(len(rows))] == [k for _, k in rows]


def test_no_text_is_two_licences():
    held = {}
    for name, text in licences.public_texts():
        held.setdefault(plain(text), set()).add(name)
    assert all(len(names) == 1 for names in held.values())


def wrapped(text, width):
    import textwrap

    parts = re.split("\n[ \t\f]*\n", text)
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in parts)


def test_licences_are_found_at_all_widths(spark):
    from importlib import resources

    apache = resources.files("wayline.llm").joinpath("licence_texts", "Apache-2.0.txt").read_text()
    bsd = "\n\n".join(licences._BSD)
    rows = [(wrapped(f"{title}\n\nCopyright (c) 2021 A. Person\n\n{body}", w), name) for w in range(40, 121) for title, body, name in (
        ("MIT License", licences.KNOWN["MIT"], "MIT"), ("ISC License", licences.KNOWN["ISC"], "ISC"), ("BSD 3-Clause License", "\n\n".join([licences._BSD[0], *[f"{k}. {p}" for k, p in enumerate(licences._BSD[1:4], 1)], licences._BSD[4]]), "BSD-3-Clause"))]
    rows += [(wrapped(apache, w), "Apache-2.0") for w in range(40, 121)]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: r.licence_id for r in licences.scan(frame, licences.known(spark)).collect()}
    assert [(i, got[i]) for i in range(len(rows)) if got[i] != rows[i][1]] == []
    assert len(bsd) > 100


def test_neighbouring_spellings_and_body_lines(spark):
    rows = ["licence licence sub-licence centre centre", "a\nCOPYRIGHT HOLDERS BE\n(c) You must\ncopyright notice\nCopyright Holder x", "a\nCopyright Ho Lee\nCopyright 2020\n(C) 2020 B\n(c) Copyright C\nCopyright [yyyy] [name\nof owner] x\nb", "Copyright " + "x [y] " * 200_000]
    got = [r.c for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").orderBy("i").select(licences.canonical(F.col("t")).alias("c")).collect()]
    assert got[:3] == ["license license sublicense center center", "a copyright holders be c you must copyright notice copyright holder x", "a b"]


def test_sql_finds_the_same(spark, tmp_path):
    import duckdb

    rows = [(i, f"{head}{text}") for i, (text, head) in enumerate((t, h) for t in [*licences.KNOWN.values(), "none of them", "", None] for h in ("", "Copyright (c) 2020 A\n", "(C) 2019\n"))]
    frame = spark.createDataFrame([(*r,) for r in rows], "doc_id bigint, text string")
    frame.coalesce(1).write.parquet(f"file://{tmp_path}/documents")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    want = sorted(con.sql(licences.oracle()).fetchall())
    got = sorted((r.doc_id, r.digest, r.licence_id) for r in licences.scan(frame, licences.known(spark)).collect())
    assert got == [tuple(w) for w in want] and sum(g[2] is not None for g in got) == 3 * len(licences.KNOWN)
