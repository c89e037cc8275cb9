"""Readers of the web interfaces, as Spark data sources for given values and as maps over a DataFrame of values.

The transport is an option, ``module:function`` of ``(url, params) -> (status,
body)``, so the readers run against recorded answers where there is no network.
Pace is an option too: ``concurrency`` partitions at most, hence requests in
flight, and ``gap`` seconds between the requests of each. Too many requests are
retried a bounded number of times with growing pauses; what failed for good
comes out as a row with its error instead of vanishing. A news search that is
still refused then stops the searches after it in its partition.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGES_API = "https://en.wikipedia.org/w/api.php"
NEWS_API = "https://newsapi.org/v2/everything"
BATCH = 50


def http_get(url: str, params: dict[str, str]) -> tuple[int, str]:
    """The transport used unless another is named."""
    from urllib import error, parse, request

    try:
        with request.urlopen(request.Request(f"{url}?{parse.urlencode(params)}", headers={"User-Agent": "rankweave/1.0"}), timeout=60) as r:
            return r.status, r.read().decode("utf-8")
    except error.HTTPError as e:
        return e.code, ""


class _Client:
    def __init__(self, options: dict[str, str]):
        module, _, name = options.get("transport", f"{__name__}:http_get").partition(":")
        self.get = getattr(importlib.import_module(module), name)
        self.retries, self.pause, self.gap = int(options.get("retries", 5)), float(options.get("pause", 5)), float(options.get("gap", 0.2))
        self.asked = 0

    def json(self, url: str, params: dict[str, str]) -> tuple[dict, str | None]:
        """The answer and no error, or nothing and what went wrong."""
        if self.asked:
            time.sleep(self.gap)
        self.asked += 1
        for k in range(self.retries + 1):
            try:
                status, body = self.get(url, params)
            except OSError as e:
                return {}, f"{type(e).__name__}: {e}"
            if status == 429 and k < self.retries:
                time.sleep(self.pause * 2**k)
                continue
            if status != 200:
                return {}, f"status {status}"
            try:
                return json.loads(body), None
            except ValueError as e:
                return {}, f"unreadable answer: {e}"
        return {}, "status 429"


def members(client: _Client, options: dict[str, str], category: str) -> Iterator[tuple]:
    """``(parent, child, kind, error)`` of one category, all pages of the answer."""
    for kind in ("page", "subcat"):
        more: dict[str, str] = {}
        while True:
            asked = {"action": "query", "format": "json", "list": "categorymembers", "cmtitle": category, "cmtype": kind, "cmlimit": "max", **more}
            answer, error = client.json(options.get("url", PAGES_API), asked)
            if error:
                yield category, None, kind, error
                break
            for m in answer.get("query", {}).get("categorymembers", []):
                yield category, m["title"], kind, None
            token = answer.get("continue", {}).get("cmcontinue")
            if not token:
                break
            more = {"cmcontinue": token}


def contents(client: _Client, options: dict[str, str], titles: list[str]) -> Iterator[tuple]:
    """``(pageid, title, wikitext, error)`` of up to fifty titles."""
    asked = {"action": "query", "format": "json", "prop": "revisions", "rvprop": "content", "rvslots": "main", "titles": "|".join(titles)}
    answer, error = client.json(options.get("url", PAGES_API), asked)
    if error:
        for title in titles:
            yield None, title, None, error
    for page_id, page in answer.get("query", {}).get("pages", {}).items():
        if page_id == "-1":
            continue
        rev = (page.get("revisions") or [{}])[0]
        yield int(page_id), page.get("title"), rev.get("slots", {}).get("main", {}).get("*") or rev.get("*"), None


def articles(client: _Client, options: dict[str, str], name: str) -> Iterator[tuple]:
    """``(article_ord, fighter, title, description, url, source, publishedAt, error)`` of one search."""
    asked = {"q": name, "from": options.get("from", ""), "language": "en", "sortBy": "publishedAt", "pageSize": "100", "apiKey": options.get("apikey", "")}
    answer, error = client.json(options.get("url", NEWS_API), asked)
    if error:
        yield None, name, None, None, None, None, None, error
    for k, a in enumerate(answer.get("articles") or []):
        yield k, name, a.get("title"), a.get("description"), a.get("url"), (a.get("source") or {}).get("name"), a.get("publishedAt"), None


def searches(client: _Client, options: dict[str, str], names: Iterable[str]) -> Iterator[tuple]:
    """Searches one after the other; after one that stays refused the rest isn't tried."""
    refused = False
    for name in names:
        if refused:
            yield None, name, None, None, None, None, None, "not tried after status 429"
            continue
        for row in articles(client, options, name):
            refused |= row[-1] == "status 429"
            yield row


def fetch(values: DataFrame, column: str, what: str, options: dict[str, str], concurrency: int) -> DataFrame:
    """Rows of ``what`` ("members", "contents" or "articles") for every different value of a column, which never goes through the driver.

    At most ``concurrency`` requests are in flight; null values are left out.
    """
    reads = {"members": MEMBERS, "contents": CONTENTS, "articles": ARTICLES}
    some = values.select(F.col(column).alias("v")).where(F.col("v").isNotNull()).distinct().repartition(concurrency, "v").sortWithinPartitions("v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = _Client(options)
        names = (v for b in batches for v in b["v"])
        if what == "contents":
            rows = (r for part in iter(lambda: list(islice(names, BATCH)), []) for r in contents(client, options, part))
        elif what == "members":
            rows = (r for v in names for r in members(client, options, v))
        else:
            rows = searches(client, options, names)
        columns = [x.split()[0] for x in reads[what].split(", ")]
        while got := list(islice(rows, 1000)):
            yield pd.DataFrame(got, columns=columns, dtype=object)

    return some.mapInPandas(run, reads[what])


MEMBERS = "parent string, child string, kind string, error string"
CONTENTS = "pageid long, title string, wikitext string, error string"
ARTICLES = "article_ord int, fighter string, title string, description string, url string, source string, publishedAt string, error string"


class _Part(InputPartition):
    def __init__(self, at: int, values: list[tuple[int, str]]):
        super().__init__(at)
        self.at, self.values = at, values


class _Reader(DataSourceReader):
    concurrency = 5

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.values = list(enumerate(json.loads(self.options.get("values", "[]"))))

    def partitions(self) -> list[InputPartition]:
        n = -(-len(self.values) // int(self.options.get("concurrency", self.concurrency))) or 1
        return [_Part(i, self.values[i : i + n]) for i in range(0, len(self.values), n)]


class _Members(_Reader):
    def read(self, part: _Part) -> Iterator[tuple]:
        client = _Client(self.options)
        for _, category in part.values:
            yield from members(client, self.options, category)


class _Contents(_Reader):
    concurrency = 1

    def read(self, part: _Part) -> Iterator[tuple]:
        client = _Client(self.options)
        for k in range(0, len(part.values), BATCH):
            some = part.values[k : k + BATCH]
            yield from ((some[0][0] // BATCH, *row) for row in contents(client, self.options, [v for _, v in some]))


class _Articles(_Reader):
    concurrency = 1

    def read(self, part: _Part) -> Iterator[tuple]:
        place = {name: i for i, name in part.values}
        yield from ((place[row[1]], *row) for row in searches(_Client(self.options), self.options, [v for _, v in part.values]))


class CategoryMembers(DataSource):
    """``(parent, child, kind, error)`` of the categories in ``values``, a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "wiki_categories"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return _Members(self.options)


class PageContents(DataSource):
    """``(batch, pageid, title, wikitext, error)`` of the titles in ``values``, fifty to a request."""

    @classmethod
    def name(cls) -> str:
        return "wiki_pages"

    def schema(self) -> str:
        return f"batch int, {CONTENTS}"

    def reader(self, schema) -> DataSourceReader:
        return _Contents(self.options)


class NewsSearch(DataSource):
    """Articles found for the names in ``values``, one request each."""

    @classmethod
    def name(cls) -> str:
        return "news_search"

    def schema(self) -> str:
        return f"query_ord int, {ARTICLES}"

    def reader(self, schema) -> DataSourceReader:
        return _Articles(self.options)


def register(spark: SparkSession) -> None:
    """Makes the readers known to a session."""
    for source in (CategoryMembers, PageContents, NewsSearch):
        spark.dataSource.register(source)
