"""Segmentation inside the analysis against the segmenters and detectors by themselves."""

from pyspark.sql import functions as F

from textwarden.operators import segment
from textwarden.plans import analysis
from textwarden.queries import QUERIES, demo

TEXTS = ["theclownisonthetrash", "idiotmoron", "niceday", "", None, "scum " * 30, "加微信trash13812345678"]
WORDS = ["the", "clown", "is", "on", "trash", "idiot", "moron", "scum", "nice", "day", "加", "微信"]


def test_three_segmentations_and_their_results(spark):
    rows = [(i, t, "s", ["old"], 0) for i, t in enumerate(TEXTS)] + [(90, "idiot", "s", None, 2)]
    pages = spark.createDataFrame(rows, "id long, clean_text string, source_site string, seg_dp array<string>, processed int")
    words = spark.createDataFrame([(w, 1.0 + i / 8) for i, w in enumerate(WORDS)], "word string, cost double")
    stop = ["the", "on"]
    for source in ("jieba", "dp"):
        found = {r.id: r for r in analysis.segment_and_analyze(pages, words, demo(spark), stop, source=source, max_len=6).collect()}
        assert set(found) == {i for i, t in enumerate(TEXTS) if t}
        docs = pages.filter("processed < 2 and clean_text != ''").drop("seg_dp")
        alone = segment.segment_dag(docs, words, text="clean_text", out="seg_jieba", stopwords=stop)
        alone = segment.segment_bimm(alone, words, 6, text="clean_text", out="seg_maxmatch", stopwords=stop)
        alone = segment.segment_dp(alone, words, max_len=6, text="clean_text", out="seg_dp", stopwords=stop)
        want = analysis.analyze(alone, f"seg_{source}", demo(spark), source).collect()
        for w in want:
            assert all(found[w.id][c] == w[c] for c in (*analysis.SEGMENTED, *analysis.RESULTS, "processed", "analysis_seg_source")), w
    assert found[0].seg_jieba == ["clown", "is", "trash"] and found[0].processed == 2 and found[0].sensitivity_score > 0


def test_stored_with_its_words(spark, tmp_path):
    pages = spark.createDataFrame([(1, "idiotmoron", "s", 0)], "id long, clean_text string, source_site string, processed int")
    words = spark.createDataFrame([(w, 1.0) for w in WORDS], "word string, cost double")
    analysis.write_analysis(analysis.segment_and_analyze(pages, words, demo(spark)), str(tmp_path / "out"), buckets=2)
    r = analysis.analysis_store(spark, str(tmp_path / "out")).read().first()
    assert r.seg_jieba == '["idiot","moron"]' and r.analysis_seg_source == "jieba" and r.processed == 2


def test_registered_query(spark, tmp_path):
    spark.createDataFrame([(i, f"the clown on the trash {i}" if i else None, "en", "s", 30) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = QUERIES["q_d9_segment_and_analyze"](spark, str(tmp_path)).select("id", *analysis.SEGMENTED, F.col("sensitivity_score") > 0).collect()
    assert sorted((r.id, r.seg_jieba, r.seg_maxmatch, r.seg_dp) for r in found) == [(i, *["the clown on the trash"] * 3) for i in (1, 2, 3)]
    assert all(r[4] for r in found)
