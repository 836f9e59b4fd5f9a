"""Fill-in-the-middle against a plain cut of each text, with nulls, markers, repeats, clashing columns, long texts and no rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from textwarden.llm import fill_middle

SCHEMA = "doc_id long, text string, `row` string, n string, form int, output string, h int"
TEXTS = [
    "a plain text, with words", "", None, "x", "  \n\t", "<P> is a marker", "ends in <", "> begins", "<S", "über 日本語 🙂🙂 naïve", "abc" * 5000, "a1" * 9000, "$1 \\ $2 {3}", "line\nline\r\n line",
    "the same", "the same", "<M><S>", "p<P", "0" * 4096, "0" * 4097, "word " * 2048,
]


def expected(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    return [(100 * i + j, t) for i in range(12) for j, t in enumerate(TEXTS)] + [(None, "no key here"), (None, None), (7, "twice the key"), (7, "twice the key"), (-3, "negative")]


def frame(spark, pairs):
    return spark.createDataFrame([(k, t, "r", "n", 1, "o", 2) for k, t in pairs], SCHEMA)


@pytest.fixture(scope="module")
def made(spark):
    out = fill_middle.fill_in_middle(frame(spark, rows()).repartition(3))
    return out.withColumn("restored", fill_middle.restore(F.col("output"), F.col("form"))).collect()


def test_against_a_plain_cut(made):
    key = lambda r: str(r)
    found = [(r.row.doc_id, r.row.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made]
    assert sorted(found, key=key) == sorted(((k, t, *expected(k, t)) for k, t in rows()), key=key)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_restores_every_text(made):
    assert all(r.restored == (r.row.text or "") for r in made)


def test_other_shares(spark):
    out = fill_middle.fill_in_middle(frame(spark, rows()), seed="2", plain_from=100, spm_below=100).collect()
    assert {r.form for r in out if r.row.text and not re.search("<[PSM]>", r.row.text)} == {"spm"}


def test_no_rows(spark):
    assert fill_middle.fill_in_middle(frame(spark, [])).collect() == []


def test_one_match_of_a_long_text(spark):
    """Counted possessive groups don't recurse."""
    text = "ab 1" * 250_000
    r = fill_middle.fill_in_middle(spark.createDataFrame([(6, text)], "doc_id long, text string")).first()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(6, text) and r.form != "plain"
