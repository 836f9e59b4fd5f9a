"""The pipeline's stages on planted cases and against brute force, and its queries' SQL."""

import collections
import os
import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from textwarden.llm import packing, queries
from textwarden.runtime import materialise

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert 0 < docs.count() <= before
            before = docs.count()
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} and docs.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0


def test_stages_without_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def brute_exact(rows):
    """Of equal texts without blanks the longest, then the first."""
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups["".join(t.split())].append((-len(t), i, t))
    return sorted((i, t) for _, i, t in map(min, groups.values()))


def brute_near(rows):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in rows)}
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return [(i, t) for i, t in rows if group[i] == i]


def brute_cut(rows, width=200):
    data = {i: t.encode() for i, t in rows}
    seen = collections.Counter(d[k : k + width] for d in data.values() for k in range(len(d) - width + 1))
    out = []
    for i, d in data.items():
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - width + 1):
            if seen[d[k : k + width]] > 1:
                gone[k : k + width] = True
        left = np.frombuffer(d, "u1")[~gone].tobytes().decode("utf-8", "ignore")
        out += [(i, left)] if left or not gone.any() else []
    return out


def test_pipeline_by_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rnd = random.Random(11)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop"}
    line = lambda lang, n: " ".join("".join(rnd.choice(letters[lang]) for _ in range(rnd.randint(2, 7))) for _ in range(n))
    rows = [(i, line(lang, 80), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    passage = line("aa", 60)
    rows += [(200 + i, f"{line('aa', 70)} {passage} {line('aa', 70)}", "aa") for i in range(5)]
    rows += [(300 + i, rows[i][1].replace(" ", "\n", i), rows[i][2]) for i in range(6)]
    rows += [(400 + i, rows[10 + i][1] + " " + line(rows[10 + i][2], i), rows[10 + i][2]) for i in range(12)]
    rows += [(500, "1234 5678", "aa"), (501, "", "bb"), (502, None, "aa")]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    first = corpus_pipeline.keep_known_languages(spark, df, str(tmp_path)).select("doc_id", "text").collect()
    given = sorted((r.doc_id, r.text) for r in first)
    assert {i for i, _ in given} >= {i for i, t, _ in rows if t and t[0].isalpha()} and not {500, 501, 502} & {i for i, _ in given}
    kept = brute_cut(brute_near(brute_exact(given)))
    assert len(kept) < len(brute_exact(given)) < len(given)
    library = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    want = set()
    for i, t in kept:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(packing.cuts(len(ids), 2048))}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(found) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == want
    total = collections.Counter()
    for r in found:
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 2048 and len(total) <= -(-sum(total.values()) // 2048) + 1


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = queries.op10_language_id(spark, SF).join(docs, "doc_id").filter("held_out and lang is not null and lang_pred != 'und'").collect()
    assert len(found) > 30 and sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)


def test_oracle_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        found = queries.QUERIES[name](spark, SF)
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(found.columns)
        assert sorted(tuple(str(r[c]) for c in names) for r in found.collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())
