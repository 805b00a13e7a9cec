"""Web sources against a local server and small cases; doubts, budgets, exports and numbers."""

from __future__ import annotations

import gzip
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import control
from corpusmill.sources import web

PAGES = {
    "/robots.txt": b"User-agent: *\nDisallow: /private",
    "/a": "日本語のページ".encode("cp932"),
    "/packed": gzip.compress(b"packed page"),
    "/long": b"x" * 5000,
    "/private/b": b"secret",
}


@pytest.fixture(scope="module")
def site():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            body = PAGES.get(self.path)
            self.send_response(503 if self.path == "/busy" else 200 if body else 404)
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_are_read_politely(spark, site):
    spark.dataSource.register(web.WebPages)
    urls = "\n".join(f"{site}{p}" for p in ("/a", "/packed", "/long", "/private/b", "/none", "/a", "/busy", "/packed?again"))
    got = {r.url.removeprefix(site): (r.status, r.text) for r in spark.read.format("corpusmill_web").option("urls", urls).option("spacing", "0").option("bytes", "1000").load().collect()}
    assert got == {"/a": (200, "日本語のページ"), "/packed": (200, "packed page"), "/long": (200, "x" * 1000), "/private/b": (403, None), "/none": (404, None), "/busy": (503, None), "/packed?again": (429, None)}
    assert spark.read.format("corpusmill_web").load().count() == 0


def test_rules_of_hosts(spark):
    rules = "User-agent: *\nDisallow: /x"
    rows = [(1, "http://a.org/x", rules), (2, "http://a.org/y", rules), (3, "http://a.org/x", None), (4, "https://ja.wikipedia.org/w/api.php?q", "User-agent: *\nDisallow: /"), (5, None, None)]
    got = spark.createDataFrame(rows, "id int, url string, robots string").select("id", web.allowed(F.col("url"), F.col("robots"), "me").alias("ok"))
    assert {r.id: r.ok for r in got.collect()} == {1: False, 2: True, 3: True, 4: True, 5: False}


def test_spacing_and_pauses(spark):
    asked = [("a", 0.0), ("a", 0.5), ("a", 10.0), ("a", 10.0), ("b", 3.0)]
    df = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(asked)], "i int, host string, t double")
    got = [r.s for r in df.withColumn("s", web.polite_start(F.col("t"), "host", ["t", "i"])).orderBy("i").collect()]
    assert got == [0.0, 2.0, 10.0, 12.0, 3.0]
    df = spark.createDataFrame([(0, None), (1, None), (3, None), (2, 500.0), (20, None)], "n int, wish double")
    assert [r[0] for r in df.select(web.pause(F.col("n"), F.col("wish"))).collect()] == [0.0, 30.0, 120.0, 500.0, 3600.0]


def test_records_become_text(spark):
    row = spark.range(1)
    links = ["/l/?uddg=http%3A%2F%2Fa.org%2Fx&r=1", "https://s.example/help", "http://b.org", "/rel", "http://b.org"]
    assert row.select(web.result_links(F.array(*map(F.lit, links)), "s.example")).first()[0] == ["http://a.org/x", "http://b.org"]
    json = '{"search":[{"label":"東京","description":"日本の首都"},{"label":"x","description":"ab"},{"label":null}]}'
    got = web.entity_sentences(spark.createDataFrame([(1, "ja", json), (2, "en", '{"search":[{"label":"Tokyo","description":"city"}]}'), (3, "en", "broken")], "id long, lang string, json string"))
    assert {r.id: r.text for r in got.collect()} == {1: "東京とは、日本の首都である。", 2: "Tokyo is a city."}
    page = "宇宙 (うちゅう)\n語源は古い言葉である、とされる。\nすべての天体を含む空間のこと。\n(名詞)\nIPA: utyuu\n短い"
    said = row.select(web.dictionary_text(F.lit("宇宙"), F.lit(page), F.lit("ja"))).first()[0]
    assert said.startswith("宇宙とは、すべての天体を含む空間のことである。\n宇宙 (うちゅう)\n") and "IPA" not in said
    assert row.select(web.extract_body(F.lit("a\n== b ==\n=== c ===\nd"))).first()[0] == "a\nd"
    assert row.select(web.feed_text(F.lit("題"), F.lit("長い" * 30))).first()[0] == "題。" + "長い" * 30


def test_datasets_and_sources(spark):
    lines = ["a\tb\ttrain\ttext\t2.5", "a\tb\ttrain\ttext\tx", "#a\tb\tc\td", "a\tb\tc", "a\tb\tc\tqa\t0.001", "a\tb\tc\tqa"]
    got = web.dataset_specs(spark.createDataFrame([(x,) for x in lines], "text string")).collect()
    assert [r.weight for r in got] == [2.5, 1.0, 0.05, 1.0]
    rows = [("t", "wikipedia", 0.9, 1.0, 2), ("t", "wikidata", 0.8, 1.0, 5), ("t", "wikibooks", 0.7, 1.0, 5), ("t", "other", 0.1, 1.0, 9), ("u", "wikinews", 1.0, 1.0, 1), ("u", "wikidata", 0.5, 1.0, 1)]
    plan = web.source_plan(spark.createDataFrame(rows, "topic string, source string, score double, weight double, found int")).collect()
    assert sorted(map(tuple, plan)) == [("t", "other", 1), ("t", "wikipedia", 2), ("u", "wikidata", 1), ("u", "wikinews", 1)]
    df = spark.createDataFrame([(0, 100, 250), (200, 50, 250), (100, 0, 250)], "o int, n int, t int")
    assert [r[0] for r in df.select(web.next_offset(F.col("o"), F.col("n"), F.col("t"))).collect()] == [100, 0, 0]


def test_doubts(spark):
    hits = spark.createDataFrame(
        [(1, 10, 0.9, 1, "月の話"), (1, 11, 0.8, 2, "東京タワーの高さは333"), (2, 20, 0.9, 1, "月の話"), (3, 30, 0.9, 1, "東京タワーは赤い"), (4, 40, 0.9, 1, "何か")],
        "id long, seq long, confidence double, rank long, text string",
    )
    questions = spark.createDataFrame(
        [(1, True, True, ["東京タワー"], "高さ", ["高さ"]), (2, True, True, ["カレー"], None, []), (3, True, True, ["東京タワー"], "高さ", ["高さ"]), (4, False, True, [], None, [])],
        "id long, known boolean, asks boolean, keys array<string>, attribute string, synonyms array<string>",
    )
    got = {(r.id, r.seq): (r.confidence, r["rank"]) for r in control.doubted(hits, questions, 0.4).collect()}
    assert got == {(1, 10): (0.2, 2), (1, 11): (0.8, 1), (2, 20): (0.2, 1), (3, 30): (0.2, 1), (4, 40): (0.2, 1)}


def test_budgets_thresholds_exports(spark):
    sizes = spark.createDataFrame([("ngrams", 500), ("ngrams", 100), ("vectors", 10)], "part string, bytes long")
    got = {r.part: r for r in control.budgets(sizes, 1000).collect()}
    assert got["ngrams"].over and not got["vectors"].over and got["ngrams"].budget == pytest.approx(382.5)
    assert got["ngrams"].admission == round((610 / 850 - 0.6) * 1.5, 6)
    log = spark.createDataFrame([(1, 1, True), (1, 2, False)] + [(2, i, False) for i in range(30)], "k long, at long, positive boolean")
    assert {r.k: r.threshold for r in control.threshold_after(log, "k", "at").collect()} == {1: 0.46, 2: 0.9}
    kept = spark.createDataFrame([(1, "aaaa", 0.5), (2, "bbbb", 0.9), (3, "cccc", 0.7)], "seq long, text string, quality double")
    dialogs = spark.createDataFrame([(1, 1, "u", "b"), (2, 1, "v", "x" * 201), (3, 1, "w", "c")], "conv_id long, turn long, user string, bot string")
    out = {(r.kind, r["at"]) for r in control.exported(kept, dialogs, most_chars=8, replay=1).collect()}
    assert out == {("doc", 2), ("doc", 3), ("dialog", 3001)}
    empty = kept.limit(0)
    assert control.seeded(empty, kept).count() == 3 and control.seeded(kept, kept).count() == 3


def test_numbers_as_text(spark):
    values = [0.0, 1234567.0, -1234.5, 3.14159265, 0.00001234, 123456.789, 1234567.5, 0.5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(control.number_text(F.col("v"))).collect()]
    assert got == [f"{int(v):,}" if v.is_integer() else f"{v:,.6g}" for v in values]
