"""Web sources: a reader of pages that asks politely, its rules as columns, and records of services as sentences."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType

from corpusmill.functions import text as T
from corpusmill.sources import markup

# Seconds between requests to a host, of the first and the longest pause, and bytes of a page.
SPACING, PAUSE, LONGEST, MOST_BYTES = 2.0, 30.0, 3600.0, 400_000
API_PATH = "/w/api.php"
API_HOSTS = (".wikipedia.org", ".wikimedia.org", "wikidata.org", ".wiktionary.org")


def is_api(url: str) -> bool:
    parts = urlsplit(url)
    return parts.path == API_PATH and parts.netloc.endswith(API_HOSTS)


def may_fetch(url: str | None, robots: str | None, agent: str) -> bool:
    """Whether a host's robots.txt allows a page; without one, and for public APIs, all is allowed."""
    if not url or robots is None or is_api(url):
        return bool(url)
    rules = urllib.robotparser.RobotFileParser()
    rules.parse(robots.splitlines())
    return rules.can_fetch(agent, url)


def allowed(url: Column, robots: Column, agent: str) -> Column:
    @F.pandas_udf(BooleanType())
    def test(urls: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([may_fetch(u, r, agent) for u, r in zip(urls, texts, strict=True)])

    return test(url, robots)


def polite_start(asked: Column, host: str, order: list[str], spacing: float = SPACING) -> Column:
    """When each request may start: in order, no sooner than it was asked, and ``spacing`` seconds after its host's last."""
    n = F.row_number().over(Window.partitionBy(host).orderBy(*order))
    before = Window.partitionBy(host).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.max(asked - spacing * n).over(before) + spacing * n


def pause(failures: Column, retry_after: Column) -> Column:
    """Seconds to leave a host alone after so many refusals (429, 503) in a row; a wish to wait longer is honoured."""
    own = F.least(F.lit(LONGEST), PAUSE * F.pow(F.lit(2.0), failures - 1))
    return F.when(failures <= 0, 0.0).otherwise(F.least(F.lit(LONGEST), F.greatest(own, F.coalesce(retry_after, F.lit(0.0)))))


class HostPages(InputPartition):
    def __init__(self, host: str, urls: list[str]):
        super().__init__(host)
        self.urls = urls


class WebPages(DataSource):
    """``spark.read.format("corpusmill_web").option("urls", "…\\n…")``: url, status, text; a host is one partition's.

    Options: ``agent``, ``spacing`` (seconds), ``bytes`` (of each page, later ones are not read), ``timeout``.
    """

    @classmethod
    def name(cls) -> str:
        return "corpusmill_web"

    def schema(self) -> str:
        return "url string, status int, text string"

    def reader(self, schema) -> DataSourceReader:
        return WebReader(dict(self.options))


class WebReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = list(dict.fromkeys(u.strip() for u in options.get("urls", "").split("\n") if u.strip()))
        self.agent = options.get("agent", "corpusmill")
        self.spacing, self.bytes, self.timeout = float(options.get("spacing", SPACING)), int(options.get("bytes", MOST_BYTES)), float(options.get("timeout", 12))

    def partitions(self) -> list[InputPartition]:
        hosts = defaultdict(list)
        for u in self.urls:
            hosts[urlsplit(u).netloc].append(u)
        return [HostPages(h, us) for h, us in hosts.items()] or [HostPages("", [])]

    def get(self, url: str) -> tuple[int, bytes, float]:
        """Status, the start of the body, and seconds that the host asks to wait; 0 for no answer."""
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout) as r:
                body = r.read(self.bytes)
                return r.status, markup.gunzip_start(body) if body[:2] == b"\x1f\x8b" else body, 0.0
        except urllib.error.HTTPError as e:
            wish = (e.headers.get("Retry-After") or "").strip()
            return e.code, b"", float(wish) if wish.isdigit() else 0.0
        except (OSError, ValueError):
            return 0, b"", 0.0

    def read(self, partition: HostPages) -> Iterator[tuple[str, int, str | None]]:
        robots, refused = None, False
        for i, url in enumerate(partition.urls):
            if i == 0:
                parts = urlsplit(url)
                status, body, _ = self.get(f"{parts.scheme}://{parts.netloc}/robots.txt")
                robots = markup.decoded(body) if status == 200 else None
            if refused or not may_fetch(url, robots, self.agent):
                yield url, 429 if refused else 403, None
                continue
            time.sleep(self.spacing)
            status, body, _ = self.get(url)
            refused = status in (429, 503)  # the host's other pages are for a later run, after its pause
            yield url, status, markup.decoded(body) if status == 200 else None


# Records of services


def result_links(links: Column, own_host: str, limit: int = 5) -> Column:
    """The targets of a result page's links, each once: a link that wraps its target (``uddg``), or one to another host."""
    wrapped = lambda x: F.try_url_decode(F.regexp_extract(x, r"[?&]uddg=([^&#]*)", 1))
    target = lambda x: F.when(F.instr(x, "uddg=") > 0, wrapped(x)).when(x.startswith("http") & (F.instr(x, own_host) == 0), x)
    return F.slice(F.array_distinct(F.filter(F.transform(links, target), lambda x: x.isNotNull() & (x != ""))), 1, limit)


def extract_body(text: Column) -> Column:
    """An extract without its headings."""
    return F.regexp_replace(text, r"\n=+[^=\n]+=+(?=\n)", "")


def defined(label: Column, description: Column, lang: Column) -> Column:
    """A sentence that defines a label by its description; null without either."""
    name, said = T.strip(label), T.strip(description)
    sentence = F.when(lang == "ja", F.concat(name, F.lit("とは、"), said, F.lit("である。"))).otherwise(F.concat(name, F.lit(" is a "), said, F.lit(".")))
    return F.when((name != "") & (F.length(said) > 3), sentence)


def entity_sentences(rows: DataFrame) -> DataFrame:
    """id and text of each search result (id, lang, json): its entities' definitions."""
    found = F.from_json("json", "search array<struct<label:string,description:string>>")["search"]
    lines = F.filter(F.transform(found, lambda e: defined(F.coalesce(e["label"], F.lit("")), F.coalesce(e["description"], F.lit("")), F.col("lang"))), lambda x: x.isNotNull())
    return rows.select("id", F.array_join(lines, "\n").alias("text")).where("text != ''")


def dictionary_text(topic: Column, text: Column, lang: Column) -> Column:
    """A dictionary's page as text: its lines that look like senses, twelve at most, after a sentence made of the first."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), T.strip), lambda x: F.length(x).between(6, 200) & (F.instr(x, "IPA") == 0) & ~x.rlike(r"^[(（\[＊*]"))

    def whole(kept: Column) -> Column:
        senses = F.filter(kept, lambda x: (F.length(x) >= 12) & ~F.startswith(x, topic) & (F.instr(F.substring(x, 1, 3), "語源") == 0))
        head = F.when((lang == "ja") & (F.size(senses) > 0), F.concat(topic, F.lit("とは、"), F.regexp_replace(F.get(senses, F.lit(0)), "。+$", ""), F.lit("である。\n"))).otherwise("")
        return F.when(F.size(kept) > 0, F.concat(head, F.array_join(F.slice(kept, 1, 12), "\n")))

    return T.let(lines, whole)


def feed_text(title: Column, summary: Column) -> Column:
    """Title and summary as one text, without saying the title twice; short ones are null."""
    both = F.when(F.startswith(summary, title), summary).otherwise(F.concat(title, F.lit("。"), summary))
    return F.when(F.length(both) > 40, both)


def dataset_specs(lines: DataFrame) -> DataFrame:
    """dataset, config, split, format, weight from tab-separated lines (text); a bad weight is 1, a small one 0.05."""
    parts = F.transform(F.split("text", "\t"), T.strip)
    rows = lines.select(parts.alias("p")).where((F.size("p") >= 4) & ~F.startswith(F.col("p")[0], F.lit("#")))
    weight = F.greatest(F.lit(0.05), F.coalesce(F.try_element_at("p", F.lit(5)).try_cast("double"), F.lit(1.0)))
    return rows.select(*[F.col("p")[i].alias(n) for i, n in enumerate(("dataset", "config", "split", "format"))], weight.alias("weight"))


def next_offset(offset: Column, read: Column, total: Column) -> Column:
    """Where to read on in a paged dataset: from the start again at its end."""
    return F.when((read == 0) | (offset + read >= total), F.lit(0)).otherwise(offset + read)


def source_plan(rows: DataFrame, most: int = 3) -> DataFrame:
    """topic, source, taken: how many pages of each source (topic, source, score, weight, found; few for each topic) are read.

    Sources are asked by score and weight until there are enough pages. Secondary ones are asked only while there is
    none, definitions only while two places are free.
    """
    secondary, brief = ("duckduckgo", "wikibooks", "wikinews"), ("wikidata", "wiktionary")  # fixed values
    lists = rows.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct((-F.col("score") * F.col("weight")).alias("k"), "source", F.col("found").cast("int").alias("found")))).alias("s"))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<source:string,taken:int>>").alias("out"))

    def add(state: Column, x: Column) -> Column:
        skip = (state["n"] >= most) | (x["source"].isin(*secondary) & (state["n"] > 0)) | (x["source"].isin(*brief) & (state["n"] >= most - 1))
        taken = F.when(skip, 0).otherwise(F.least(x["found"], most - state["n"]))
        return F.struct((state["n"] + taken).alias("n"), F.array_append(state["out"], F.struct(x["source"].alias("source"), taken.alias("taken"))).alias("out"))

    return lists.select("topic", F.inline(F.aggregate("s", start, add)["out"])).where("taken > 0")
