"""A data source over the query API of an encyclopedia: `spark.read.format("page_api")`.

Options: endpoint, a URL with {lang}; kind, one of KINDS; items, a JSON list of [lang, what]; limit; interval and retries. Requests
to one language follow each other in one partition, as the service asks its clients to be gentle; languages run side by side.

    spark.dataSource.register(PageApi)
    spark.read.format("page_api").options(endpoint="https://{lang}.example.org/api.php", kind="extract", items='[["en", "India"]]').load()

readStream takes links, a batch per answer, and goes on where a stopped query's checkpoint says.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields
from itertools import islice
from typing import NamedTuple

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: Parameters of the API, by what is asked for.
COMMON = {"format": "json", "formatversion": "2", "maxlag": "5"}
PARAMETERS = {
    "extract": {"action": "query", "prop": "extracts|revisions|info", "redirects": "1", "explaintext": "1", "exsectionformat": "plain", "rvprop": "ids|timestamp", "inprop": "url"},
    "html": {"action": "parse", "prop": "text", "disablelimitreport": "1"},
    "links": {"action": "query", "prop": "links", "redirects": "1", "plnamespace": "0", "pllimit": "max"},
    "random": {"action": "query", "list": "random", "rnnamespace": "0", "rnlimit": "max"},
}
KINDS = {
    "extract": "pageid bigint, lang string, title string, text string, revid bigint, rev_timestamp string, url string",
    "html": "lang string, revid bigint, html string",
    "links": "lang string, page string, place bigint, target string",
    "random": "lang string, place bigint, title string",
}


class Outcome(NamedTuple):
    """What came of a request: an answer, a service that is behind, one that says how long to wait, or a failure."""

    kind: str
    answer: dict | None = None
    told: float = 0.0


@dataclass(frozen=True)
class Waits:
    """Seconds between requests, for a service that is behind, for one that is busy and does not say how long, on
    top of what it says, and per failed attempt."""

    interval: float = 1.0
    behind: float = 5.0
    unsaid: float = 30.0
    spare: float = 1.0
    backoff: float = 2.0

    def after(self, outcome: Outcome, attempt: int) -> float:
        """Seconds after the attempt of that number, from 1."""
        return {"behind": self.behind, "busy": (outcome.told or self.unsaid) + self.spare, "failed": self.backoff * attempt}.get(outcome.kind, 0.0)


@dataclass
class Client:
    """One service, asked once in waits.interval seconds at most; RuntimeError after `retries` attempts without an answer."""

    url: str
    retries: int = 8
    waits: Waits = field(default_factory=Waits)
    sleep: Callable[[float], None] = time.sleep
    ready: float = field(default=0.0)

    def request(self, parameters: dict[str, str]) -> Outcome:
        try:
            with urllib.request.urlopen(f"{self.url}?{urllib.parse.urlencode(COMMON | parameters)}", timeout=60) as response:
                answer = json.load(response)
        except urllib.error.HTTPError as e:
            return Outcome("busy", told=float(e.headers.get("Retry-After") or 0)) if e.code == 429 else Outcome("failed")
        except (urllib.error.URLError, OSError, ValueError):
            return Outcome("failed")
        return Outcome("behind") if answer.get("error", {}).get("code") == "maxlag" else Outcome("answered", answer)

    def ask(self, parameters: dict[str, str]) -> dict:
        outcomes = (self._in_turn(parameters, attempt) for attempt in range(1, self.retries + 1))
        found = next((o.answer for o in outcomes if o.kind == "answered"), None)
        if found is None:
            raise RuntimeError(f"{self.url} does not answer {parameters}")
        return found

    def _in_turn(self, parameters: dict[str, str], attempt: int) -> Outcome:
        self.sleep(max(0.0, self.ready - time.monotonic()))
        self.ready = time.monotonic() + self.waits.interval
        outcome = self.request(parameters)
        if pause := self.waits.after(outcome, attempt):
            self.sleep(pause)
        return outcome

    def pages(self, parameters: dict[str, str]) -> Iterator[dict]:
        """Answers, as long as one names where the next goes on."""
        more: dict[str, str] | None = {}
        while more is not None:
            answer = self.ask(parameters | more)
            yield answer
            more = answer.get("continue")


def extract(client: Client, lang: str, title: str, limit: int) -> Iterator[tuple]:
    """The current revision's plain text; nothing for a page that is missing."""
    for page in client.ask(PARAMETERS["extract"] | {"titles": title})["query"]["pages"][:1]:
        for revision in page.get("revisions", [])[:1]:
            yield page["pageid"], lang, page["title"], page.get("extract", ""), revision["revid"], revision["timestamp"], page.get("fullurl")


def rendered(client: Client, lang: str, revid: str, limit: int) -> Iterator[tuple]:
    yield lang, int(revid), client.ask(PARAMETERS["html"] | {"oldid": str(revid)})["parse"]["text"]


def linked(client: Client, lang: str, title: str, limit: int) -> Iterator[tuple]:
    targets = (x["title"] for answer in client.pages(PARAMETERS["links"] | {"titles": title}) for page in answer["query"]["pages"] for x in page.get("links", []))
    for place, target in enumerate(islice(targets, limit)):
        yield lang, title, place, target


def randomly(client: Client, lang: str, n: str, limit: int) -> Iterator[tuple]:
    """n titles; some may come twice."""
    place = 0
    while place < int(n):
        for x in client.ask(PARAMETERS["random"])["query"]["random"][: int(n) - place]:
            yield lang, place, x["title"]
            place += 1


_READ = {"extract": extract, "html": rendered, "links": linked, "random": randomly}


@dataclass
class Language(InputPartition):
    lang: str
    items: list[str]


def _client(options: dict[str, str], lang: str) -> Client:
    waits = {f.name: float(options[f.name]) for f in fields(Waits) if f.name in options}
    return Client(options["endpoint"].replace("{lang}", lang), int(options.get("retries", 8)), Waits(**waits))


class PageApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_api"

    def schema(self) -> str:
        return KINDS[self.options["kind"]]

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        if self.options["kind"] != "links":
            raise ValueError("only links go on from answer to answer")
        return LinkStream(dict(self.options))


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Language]:
        by_lang: dict[str, list[str]] = {}
        for lang, what in json.loads(self.options["items"]):
            by_lang.setdefault(lang, []).append(str(what))
        return [Language(lang, items) for lang, items in by_lang.items()]

    def read(self, partition: Language) -> Iterator[tuple]:
        client = _client(self.options, partition.lang)
        for what in partition.items:
            yield from _READ[self.options["kind"]](client, partition.lang, what, int(self.options.get("limit", 5000)))


class LinkStream(SimpleDataSourceStreamReader):
    """The links of pages, an answer of each page a batch. An offset says for every page how many links came before and how its
    next request goes on (nothing once it has ended), so that a query that was stopped asks for what it has not had, and a batch
    that is worked out again has the same links."""

    def __init__(self, options: dict[str, str]):
        self.options, self.limit = options, int(options.get("limit", 5000))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"pages": [[lang, str(title), 0, {}] for lang, title in json.loads(self.options["items"])]}

    def _answer(self, lang: str, title: str, at: int, more: dict) -> tuple[list[tuple], dict | None]:
        answer = _client(self.options, lang).ask(PARAMETERS["links"] | {"titles": title} | more)
        found = [x["title"] for page in answer["query"]["pages"] for x in page.get("links", [])][: self.limit - at]
        ended = at + len(found) >= self.limit
        return [(lang, title, at + k, x) for k, x in enumerate(found)], None if ended else answer.get("continue")

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, pages = [], []
        for lang, title, at, more in start["pages"]:
            found, then = ([], None) if more is None else self._answer(lang, title, at, more)
            rows += found
            pages.append([lang, title, at + len(found), then])
        return iter(rows), {"pages": pages}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        for (lang, title, at, more), (_, _, stop, _) in zip(start["pages"], end["pages"], strict=True):
            while at < stop and more is not None:
                found, more = self._answer(lang, title, at, more)
                yield from found[: stop - at]
                at += len(found)
