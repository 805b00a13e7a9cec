from __future__ import annotations

import gzip
import lzma
import zipfile

from corpusmill.sources import markup, readers
from corpusmill.streaming import ingest


def test_html(spark):
    page = "<html><head><title>T</title><script>x()</script></head><body><nav>menu menu menu menu menu.</nav><div class='sidebar'>aside text that is long enough.</div><p>The body is long enough to stay here.</p><p>tiny</p><a href='/x'>link text</a></body></html>"
    r = markup.pages(spark.createDataFrame([(1, page), (2, None), (3, "<p>broken")], "page_id long, html string")).orderBy("page_id").collect()
    assert r[0].title == "T" and r[0].text == "The body is long enough to stay here." and r[0].links == ["/x"] and r[0].anchors[0].text == "link text"
    assert r[1].text == "" and r[2].page_id == 3


def test_feeds(spark):
    rss = "<rss><channel><item><title>A</title><link>http://a</link><description>&lt;p&gt;Hi &lt;b&gt;you&lt;/b&gt;&lt;/p&gt;</description></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>B</title><link href="http://b"/><summary>s</summary></entry></feed>'
    got = markup.feeds(spark.createDataFrame([(1, rss), (2, atom), (3, "<broken")], "id long, xml string")).orderBy("id").collect()
    assert [(r.id, r.title, r.link, r.summary) for r in got] == [(1, "A", "http://a", "Hi you"), (2, "B", "http://b", "s")]


def test_wikitext():
    source = "{{Infobox|a={{b}}}}'''東京タワー'''は[[東京都|東京]]の[[電波塔]]である。<ref>x</ref>\n== 見出し ==\n{| class=x\n| y\n|}\n[[ファイル:a.jpg|thumb]]\n* 高さは333メートル。<!-- c -->"
    assert markup.plain_wikitext(source) == "東京タワーは東京の電波塔である。\n高さは333メートル。"
    assert markup.plain_wikitext(None) == ""


def test_bytes():
    packed = gzip.compress(b"hello " * 5000)
    assert markup.gunzip_start(packed) == b"hello " * 5000
    assert markup.gunzip_start(packed[: len(packed) // 2]).startswith(b"hello")
    assert markup.gunzip_start(b"no") == b""
    assert markup.decoded("日本".encode("cp932")) == "日本"


def test_files_and_archives(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.bin").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.txt", "from zip")
        z.writestr("b.bin", "no")
        z.writestr("c.html", "<p>from page</p>")
    (tmp_path / "g.gz").write_bytes(gzip.compress(b"from gzip"))
    (tmp_path / "x.xz").write_bytes(lzma.compress(b"from xz"))
    assert sorted(r.text for r in readers.text_files(spark, str(tmp_path)).collect()) == ["one", "two"]
    got = {r.source: r.text.strip() for r in readers.archives(spark, str(tmp_path), "*.{zip,gz,xz}").collect()}
    assert got == {"z.zip/a.txt": "from zip", "z.zip/c.html": "from page", "g.gz": "from gzip", "x.xz": "from xz"}


def test_wiki_dump(spark, tmp_path):
    page = "<page><title>{}</title><ns>{}</ns><revision><text>{}</text></revision></page>"
    pages = [page.format(f"記事{i}", 0, f"記事{i}は、とても長い説明を持つ百科事典の項目である。" * 3) for i in range(30)]
    pages += [page.format("転送", 0, "#REDIRECT [[x]]" + " " * 60), page.format("議論", 4, "長い文。" * 40)]
    (tmp_path / "d.xml").write_text("<mediawiki>" + "".join(pages) + "</mediawiki>")
    assert readers.wiki_dump(spark, str(tmp_path / "d.xml")).count() == 30


def test_lists_tables_and_joins(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# c\nb\n\n a \nb\n")
    assert [r.line for r in readers.list_lines(spark, str(tmp_path / "l.txt")).collect()] == ["b", "a"]
    readers.save({"t": spark.range(3)}, str(tmp_path / "s"))
    assert readers.load(spark, str(tmp_path / "s"), ["t"])["t"].count() == 3
    q = spark.createDataFrame([(1, "Q", 7), (2, "R", None)], "id long, title string, accepted_answer_id long")
    a = spark.createDataFrame([(7, "A"), (8, "B")], "answer_id long, body string")
    assert [tuple(r) for r in readers.accepted_answers(q, a).collect()] == [("Q", "A")]
    book = spark.createDataFrame([("x *** START OF THE BOOK ***body*** END OF THE BOOK",)], "t string")
    assert book.select(readers.book_body(book.t).alias("b")).first().b == "body"
    x, y = spark.createDataFrame([("k", 1)], "key string, v int"), spark.createDataFrame([("k", 2), ("j", 3)], "key string, v int")
    assert [(r.key, r.v) for r in readers.ranked_union(x, y, key="key", limit=5).collect()] == [("k", 1), ("j", 3)]


def test_connector(spark):
    spark.dataSource.register(readers.LinesSource)
    got = spark.read.format("corpusmill_lines").option("source", "s").option("text", "a\nb\nc\nd\ne").load()
    assert sorted(r.text for r in got.collect()) == list("abcde")


def test_inbox_learns_each_sentence_once(spark, tmp_path):
    box, table, state = (str(tmp_path / x) for x in ("box", "table", "state"))
    (tmp_path / "box").mkdir()
    (tmp_path / "box/a.txt").write_text("東京タワーの高さは333メートルである。日本の首都は東京である。")
    ingest.run_to_end(lambda: ingest.learn(ingest.inbox(spark, box), table, state))
    (tmp_path / "box/b.txt").write_text("日本の首都は東京である。富士山は日本で一番高い山である。")
    ingest.run_to_end(lambda: ingest.learn(ingest.inbox(spark, box), table, state))
    texts = [r.text for r in spark.read.parquet(f"{table}/batch=*").collect()]
    assert sorted(texts) == sorted(["東京タワーの高さは333メートルである。", "日本の首都は東京である。", "富士山は日本で一番高い山である。"])
