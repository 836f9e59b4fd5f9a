"""Worked examples, and properties of the helpers."""

import itertools
import math

import pytest
from fixed_values import HARM_KEYWORDS, INTENSIFIERS, NEGATIONS
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textwarden.functions import text as T
from textwarden.operators import detect, hits, links, segment
from textwarden.plans import analysis
from textwarden.sources import dictionaries, pages
from textwarden.streaming import jobs

WORDS = {"研究": 50, "研究生": 5, "生命": 40, "命": 2, "起源": 10, "生": 8}
COSTS = segment.Words({w: math.log(sum(WORDS.values())) - math.log(n) for w, n in WORDS.items()})
LEXICON = {"优秀": "0.85", "一流": "0.85", "了不起": "0.80", "享受": "0.65", "差": "-0.60", "失望": "-0.60"}


@pytest.fixture(scope="module")
def words(spark):
    lexicon = LEXICON | {w: "-1.0" for w in NEGATIONS} | {w: "0.0" for w in INTENSIFIERS}
    return (
        spark.createDataFrame(list(lexicon.items()), "word string, polarity string"),
        spark.createDataFrame([(w,) for w in NEGATIONS], "word string"),
        spark.createDataFrame(list(INTENSIFIERS.items()), "word string, multiplier string"),
    )


@pytest.mark.parametrize(
    ("tokens", "score", "label", "confidence", "counts"),
    [
        ("这个 产品 极其 优秀", 0.9056, "positive", 0.1417, (1, 0)),
        ("产品 不 优秀", -0.7263, "negative", 0.2127, (0, 2)),
        ("不 产品 没 优秀", 0.2084, "negative", 0.0846, (2, 1)),
        ("优秀 一流 了不起 享受 优秀", 0.9265, "positive", 1.0, (5, 0)),
        ("稍微 极其 优秀", 0.4228, "neutral", 0.0425, (1, 0)),
        ("好", 0.0, "neutral", 0.0, (0, 0)),
        ("桌子 椅子", 0.0, "neutral", 0.0, (0, 0)),
    ],
)
def test_sentiment(spark, words, tokens, score, label, confidence, counts):
    docs = spark.createDataFrame([(1, tokens.split())], "doc_id long, tokens array<string>")
    r = detect.sentiment(docs, *words).first()
    assert (r.label, (r.n_positive, r.n_negative)) == (label, counts)
    assert r.score == pytest.approx(score, abs=2e-4) and r.confidence == pytest.approx(confidence, abs=2e-4)


def test_sensitivity(spark):
    docs = spark.createDataFrame([(1, "提供 各种 赌博 服务 投注 六合彩 赌博".split()), (2, ["赌博业"]), (3, [])], "doc_id long, tokens array<string>")
    table = spark.createDataFrame([("赌博", "gambling", "1.0"), ("六合彩", "gambling", "0.8")], "word string, category string, weight string")
    one, two, three = detect.sensitivity(docs, table).orderBy("doc_id").collect()
    assert (one.score, one.flags, one.matched, one.is_sensitive) == (0.0996, ["gambling"], ["赌博", "六合彩"], True)
    assert two.score == three.score == 0.0 and two.flags == [] and not three.is_sensitive


def test_harmful(spark):
    text = "加微信免费领取，兼职刷单日赚1000，银行卡号6222021234567890"
    tokens = "加 微信 免费领取 兼职 刷单 日赚 1000 银行卡号 6222021234567890".split()
    docs = spark.createDataFrame([(1, text, tokens), (2, text, tokens[:2])], "doc_id long, text string, tokens array<string>")
    table = dictionaries.keyword_table(spark, HARM_KEYWORDS)
    one, two = detect.harmful(docs, table).orderBy("doc_id").collect()
    assert (one.score, one.is_harmful, one.flags, one.details) == (0.366, True, ["fraud"], "欺诈+银行卡")
    assert {r.rule: r.n for r in one.l1} == {"wechat_id": 1, "bank_card": 1, "spam_words": 2}
    assert (two.score, two.is_harmful, two.flags) == (0.0, False, [])


def test_segmentation_golden():
    text = "研究生命起源"
    assert segment.forward(text, COSTS, 5) == ["研究生", "命", "起源"]
    assert segment.backward(text, COSTS, 5) == segment.bidirectional(text, COSTS, 5) == ["研究", "生命", "起源"]
    assert segment.cheapest(text, COSTS, 5, 15.0) == ["研究", "生命", "起源"]
    assert segment.cheapest("研究生命x起源", COSTS, 5, 15.0) == ["研究", "生命", "x", "起源"]
    assert segment.graph(text, COSTS, 5, "accurate") == ["研究", "生命", "起源"]
    assert "研究生" in segment.graph(text, COSTS, 5, "full")
    assert segment.graph("研究生", segment.Words({"研究生": 1.0, "研究": 1.0}), 5, "search") == ["研究", "研究生"]
    assert segment.cheapest("", COSTS, 5, 15.0) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab研究生命", max_size=9), st.dictionaries(st.text(alphabet="ab研究生命", min_size=1, max_size=3), st.floats(0.1, 9), max_size=8))
def test_segmentation_properties(text, costs):
    costs = segment.Words(costs)
    greedy = lambda t: [] if not t else (lambda n: [t[:n], *greedy(t[n:])])(next((n for n in range(min(5, len(t)), 1, -1) if t[:n] in costs), 1))
    assert segment.forward(text, costs, 5) == greedy(text)
    for split in (segment.forward, segment.backward, segment.bidirectional):
        assert "".join(split(text, costs, 5)) == text
    both = segment.bidirectional(text, costs, 5)
    assert len(both) <= min(len(segment.forward(text, costs, 5)), len(segment.backward(text, costs, 5)))
    price = lambda s: sum(costs.get(w, 15.0 * len(w)) for w in s)
    cuts = itertools.product([0, 1], repeat=max(0, len(text) - 1))
    every = []
    for c in cuts:
        at = [0] + [i + 1 for i, x in enumerate(c) if x] + [len(text)]
        every.append([text[a:b] for a, b in zip(at, at[1:], strict=False)])
    best = min((price(s) for s in every if all(len(w) <= 5 for w in s)), default=0.0)
    assert price(segment.cheapest(text, costs, 5, 15.0)) == pytest.approx(best)


@pytest.mark.parametrize("max_words", [100, 0])
def test_segmented(spark, max_words):
    """With a dictionary that is broadcast, and one of which each text gets its own part."""
    table = spark.createDataFrame(list(COSTS.items()), "word string, cost double")
    df = spark.createDataFrame([(1, "研究生命起源"), (2, None), (3, "")], "doc_id long, text string")
    rows = segment.segment_dp(df, table, out="t", max_words=max_words)
    rows = segment.segment_bimm(rows, table, out="u", stopwords=["起源"], max_words=max_words)
    rows = segment.segment_dag(rows, table, out="v", max_words=max_words).orderBy("doc_id").collect()
    assert rows[0].t == rows[0].v == ["研究", "生命", "起源"] and rows[0].u == ["研究", "生命"] and rows[1].t == rows[2].t == rows[2].v == []


def test_cleaning(spark):
    rows = [("a<script>x<b></script>c<STYLE t>\nq</STYLE>d",), ("１２ＡＢ　x",), ("see http://a.b/c me@x.yz end of line text",), ("&lt;p&gt; &amp; 中文",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(T.strip_html(F.col("t"))).collect()][:2] == ["acd", "１２ＡＢ　x"]
    assert df.select(T.normalize_for_segmentation(F.col("t"))).collect()[1][0] == "12AB x"
    assert df.select(T.remove_noise(F.col("t"))).collect()[2][0] == "see   end of line text"
    assert df.select(T.strip_html(F.col("t"))).collect()[3][0] == "<p> & 中文"
    assert df.select(T.clean_text(F.col("t"))).collect()[4][0] is None


def test_times(spark):
    df = spark.createDataFrame([("2024-01-05T03:04:05+08:00",), ("2024-1-5",), ("junk",), (None,)], "t string")
    found = [str(r[0]) for r in df.select(T.parse_publish_time(F.col("t"))).collect()]
    assert found == ["2024-01-05 03:04:05", "2024-01-05 00:00:00", "None", "None"]


def test_json_lists(spark):
    df = spark.createDataFrame([('["a","b"]',), ("",), ("{",), (None,)], "t string")
    assert [r[0] for r in df.select(T.tokens_from_json(F.col("t"))).collect()] == [["a", "b"], [], [], []]


def test_dictionaries(spark, tmp_path):
    (tmp_path / "lex.tsv").write_text("# c\nw\t0.7\t1.0\tjoy\nbad\tx\t1\nshort\t1\nw\t0.62\t1.0\n\n", encoding="utf-8")
    assert [tuple(r) for r in dictionaries.read_lexicon(spark, str(tmp_path / "lex.tsv")).collect()] == [("w", 0.62, 1.0, "sentiment")]
    (tmp_path / "sens.txt").write_text("fraud:0.9 two words\nfraud 1 x\nother:1 y\nfraud:z w\n", encoding="utf-8")
    assert [tuple(r) for r in dictionaries.read_sensitive_words(spark, str(tmp_path / "sens.txt"), ["fraud"]).collect()] == [("two words", "fraud", 0.9)]
    (tmp_path / "int.txt").write_text("very 2.0\nvery 1.5\nless 0.5\nbad x\n", encoding="utf-8")
    assert {tuple(r) for r in dictionaries.read_intensifiers(spark, str(tmp_path / "int.txt")).collect()} == {("very", 1.5, False), ("less", 0.5, True)}
    table = dictionaries.keyword_table(spark, {"a": ("0.8", ["x", "y"]), "b": ("0.4", ["x"])})
    assert {(r.word, r.category) for r in table.collect()} == {("x", "b"), ("y", "a")}


def test_shipped_dictionaries(spark):
    found = dictionaries.shipped(spark)
    assert {k: d.count() for k, d in found.items()} == {"sensitive": 36, "keywords": 26, "lexicon": 56, "negations": 8, "intensifiers": 13}
    texts = [(1, "you are a very stupid loser", "a"), (2, "not a good day at the excellent park", "b"), (3, "call 13812345678 for the casino jackpot", "c")]
    pages_ = spark.createDataFrame(texts, "id long, clean_text string, source_site string").withColumn("processed", F.lit(0))
    pages_ = pages_.withColumn("tokens", T.filter_tokens(T.tokenize_words(F.col("clean_text")), dictionaries.shipped_stopwords()))
    one, two, three = analysis.analyze(pages_, "tokens", found).orderBy("id").collect()
    assert one.sentiment_label == "negative" and one.sensitivity_flags == ["politics", "gambling"] and two.sensitivity_score == 0
    assert three.harmful_flags == ["gambling"] and three.harmful_details.details == "赌博+联系方式"


def test_keyword_hits_are_whole_tokens(spark):
    tokens = spark.createDataFrame([(1, 0, "ab"), (1, 1, "abc"), (1, 2, "ab")], "doc_id long, pos int, token string")
    table = spark.createDataFrame([("ab", "c", 1.0), ("bc", "c", 1.0)], "word string, category string, weight double")
    assert [(r.word, r.n, r.first_pos) for r in hits.keyword_hits(tokens, table).collect()] == [("ab", 2, 0)]


def test_fields_and_feeds(spark):
    page = '<html><head><title> T &amp; x </title></head><body><nav>n</nav><div class="c main"><h1 id=h>H</h1><p>' + "w " * 60 + '</p><time datetime="2024-01-05T03:04:05+08:00"></time></div></body></html>'
    df = spark.createDataFrame([(1, page), (2, ""), (3, None)], "page_id long, html string")
    one, two, three = links.extract_fields(df, title="#none::text, div.c h1::text", body="#none, .main").orderBy("page_id").collect()
    assert (one.title, one.publish_time_text) == ("H", "2024-01-05T03:04:05") and one.body_text.startswith("H w w")
    # What a selector chooses counts by the elements below it; with none of them the whole body does.
    below = links.extract_fields(df, body=".main p").orderBy("page_id").first()
    assert below.body_text.startswith("n H w w")
    assert (two.title, two.publish_time_text, two.body_text) == ("", None, "") and three.title == ""
    feeds = ["<rss><channel><item><link> http://a/1 </link></item></channel></rss>", '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="http://a/2"/></entry><entry><id>http://a/3</id></entry><entry><id>tag:x</id></entry></feed>', "<broken", None]
    df = spark.createDataFrame([(f,) for f in feeds], "x string")
    assert [r[0] for r in df.select(links.feed_links(F.col("x"))).collect()] == [["http://a/1"], ["http://a/2", "http://a/3"], [], []]


def test_nested_sitemaps(spark):
    index = lambda *maps: "<sitemapindex>" + "".join(f"<sitemap><loc> {m} </loc></sitemap>" for m in maps) + "</sitemapindex>"
    urls = lambda *found: "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in found) + "</urlset>"
    rows = [("a", "m1", index("m2", "gone", "m3")), ("b", "m2", index("m3", "m1")), ("c", "m3", index("m4")), ("d", "m4", urls("u1", "u2", "u1")), ("d", "m5", urls("u0", "u2")), ("e", "m6", "<broken"), ("f", "m7", None), ("g", "m8", index("m8"))]
    df = spark.createDataFrame(rows, "site_key string, url string, xml string")
    found = {}
    for r in links.sitemap_links(df).collect():
        found.setdefault(r.site_key, {})[r.pos] = r.url
    assert found["a"] == {0: "u1", 1: "u2"}
    assert {k: sorted(v.values()) for k, v in found.items()} == {"a": ["u1", "u2"], "b": ["u1", "u2"], "c": ["u1", "u2"], "d": ["u0", "u1", "u2"]}
    assert sorted(r.pos for r in links.sitemap_links(df, limit=1).collect()) == [0, 0, 0, 0]


def test_pages_round_trip(spark, tmp_path):
    schema = "url string, clean_text string, crawl_time timestamp, source_site string"
    first = spark.createDataFrame([("u", "b", None, "s"), ("u", "a", None, "s"), ("v", "c", None, "s")], schema)
    path = str(tmp_path / "pages")
    analysis.write_pages(first, path)
    analysis.write_pages(spark.createDataFrame([("v", "z", None, "s"), ("w", "d", None, "t")], schema), path)
    assert {(r.url, r.clean_text) for r in analysis.page_store(spark, path).read().collect()} == {("u", "a"), ("v", "c"), ("w", "d")}
    urls = spark.createDataFrame([("s", "u2"), ("s", "u1"), ("t", "v")], "site_key string, url string")
    whole = analysis.discovered(urls).agg(F.map_from_entries(F.collect_list(F.struct("site_key", F.struct("count", "urls")))).alias("sites"))
    whole.select(F.to_json(F.struct("sites"))).write.text(str(tmp_path / "found"))
    assert [(r.pos, r.url) for r in pages.read_discovered_urls(spark, str(tmp_path / "found"), "s", 1).collect()] == [(0, "u1")]
    assert pages.read_discovered_urls(spark, str(tmp_path / "found"), "nowhere").count() == 3


def test_stream_equals_batch(spark, tmp_path):
    raw = spark.createDataFrame([(f"u{i % 3}", "<p>" + "word " * 20 + "</p>") for i in range(6)] + [("short", "x")], "url string, raw_html string")
    raw = raw.withColumn("crawl_time", F.lit("2024-01-01").cast("timestamp"))
    raw.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    jobs.run_available(jobs.ingest(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u0", "u1", "u2"]
