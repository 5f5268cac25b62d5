"""Documents that are a complete licence text."""

import re
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lagweave.llm import license_scan

FOLDER = Path(license_scan.__file__).with_name("licenses")
NAMES = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib"]


def whole(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted((r["doc_id"], r["license"]) for r in license_scan.license_matches(docs).where("unit = 'text'").collect())


def test_complete_texts_as_published(spark):
    texts = [(FOLDER / f"{n}.txt").read_text(encoding="utf-8") for n in NAMES]
    assert whole(spark, texts) == list(enumerate(NAMES))
    assert whole(spark, [t.upper().replace("\n", "\n    ") for t in texts]) == list(enumerate(NAMES))
    assert whole(spark, [t[: len(t) // 2] for t in texts]) == []
    extended = [t + "\nand a further condition" for t in texts]
    assert whole(spark, extended) == []


@pytest.mark.parametrize("name", ["BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense"])
def test_short_licences_as_handed_on(spark, name):
    text = (FOLDER / f"{name}.txt").read_text(encoding="utf-8")
    body = text.split("\n", 1)[1].strip() if text.startswith("Copyright") else text
    head = "Copyright (c) 2021, Some One\n"
    variants = [body, head + "\n" + body, f"{license_scan.TITLES[name][0]}\n\n{head}\n{body}"]
    if name.startswith("BSD"):
        bulleted = "\n".join("* " + line[3:] if line[:2] in ("1.", "2.", "3.") else line for line in body.split("\n"))
        variants += [f"{head}All rights reserved.\n\n{body}", head + "\n" + bulleted]
        variants.append(head + "\n" + "\n\n".join(textwrap.fill(p, 79) for p in body.split("\n\n")))
    assert whole(spark, variants) == [(k, name) for k in range(len(variants))]


def test_terms_without_what_follows_them(spark):
    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1"]
    end = "END OF TERMS AND CONDITIONS"
    texts = [(FOLDER / f"{n}.txt").read_text(encoding="utf-8") for n in names]
    assert whole(spark, [t[: t.index(end) + len(end)] for t in texts]) == list(enumerate(names))


def test_texts_with_lines_broken_anew(spark):
    texts = [(FOLDER / f"{n}.txt").read_text(encoding="utf-8") for n in NAMES]
    for width in (60, 100):
        fill = lambda p: textwrap.fill(" ".join(p.split()), width, break_long_words=False)
        assert whole(spark, ["\n\n".join(fill(p) for p in re.split(r"\n[ \t\f]*\n", t)) for t in texts]) == list(enumerate(NAMES))


def test_terms_that_begin_with_the_word_are_terms(spark):
    altered = []
    for name in NAMES:
        lines = (FOLDER / f"{name}.txt").read_text(encoding="utf-8").split("\n")
        for k, line in enumerate(lines):
            if re.match(r"\s*(copyright|\(c\)|©)", line, re.I) and not re.search(r"\d{4}|year|yyyy", line):
                altered.append("\n".join([*lines[:k], line + " not", *lines[k + 1 :]]))
    assert len(altered) > 15
    assert whole(spark, altered) == []
    apache = (FOLDER / "Apache-2.0.txt").read_text(encoding="utf-8")
    assert whole(spark, [apache.replace("(c) You must retain, in the Source form of any Derivative Works", "(c) You need not retain anything at all")]) == []


@pytest.mark.parametrize(
    "line, notice",
    [("Copyright (c) 2021 A", True), ("copyright 1999, B", True), ("(C) 2020 C", True), ("  © 2003 D", True), ("Copyright (c) The Regents", True),
     ("Copyright [yyyy] [name]", True), ("(c) the licenses granted", False), ("copyright license to", False), ("Copyright holders 2020", False), ("the copyright 2020", False)],
)
def test_notices(spark, line, notice):
    row = spark.createDataFrame([(f"a\n{line}\nb",)], "t string").select(license_scan.without_notices(F.lower("t")).alias("t")).first()
    assert (row["t"].split() == ["a", "b"]) == notice


def test_a_unit_gives_a_licence_once(spark):
    text = (FOLDER / "GPL-3.0.txt").read_text(encoding="utf-8")
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (1, text)], "doc_id long, text string")
    rows = license_scan.license_matches(docs).where("unit = 'text'").collect()
    assert [(r["doc_id"], r["license"]) for r in rows] == [(1, "GPL-3.0")] * 2
