"""A data source for the business register's search interface, and for award notices by number.

Both fetch in tasks: a partition is a batch of numbers or a scroll. Requests go through `Client`,
which tests replace. Credentials come from options or the environment, never from code.
"""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Most numbers in a batch, attempts, notices in a chunk, requests at once, first and longest pause.
BATCH, ATTEMPTS, CHUNK, WORKERS, RETRIES, PAUSE, LONGEST = 3000, 3, 500, 3, 5, 2.0, 30.0
FINAL = ("ok", "not_found")


class RequestFailed(RuntimeError):
    pass


class Client:
    """JSON over POST with basic authentication."""

    def __init__(self, url: str, user: str | None = None, password: str | None = None, pause: float = 1.0):
        self.url, self.pause = url, pause
        self.user, self.password = user or os.environ.get("REGISTER_USER", ""), password or os.environ.get("REGISTER_PASSWORD", "")

    def send(self, path: str, body: dict) -> dict:
        token = base64.b64encode(f"{self.user}:{self.password}".encode()).decode()
        request = urllib.request.Request(f"{self.url}{path}", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Basic {token}"})
        with urllib.request.urlopen(request, timeout=120) as r:
            if r.status >= 300:
                raise RequestFailed(f"{path}: {r.status}")
            return json.load(r)

    def post(self, path: str, body: dict) -> dict:
        """Up to ATTEMPTS tries with growing pauses; an answer without hits is an error."""
        for i in range(1, ATTEMPTS + 1):
            try:
                out = self.send(path, body)
                if "hits" not in out:
                    raise RequestFailed(f"{path}: an answer without hits")
                return out
            except (RequestFailed, OSError, ValueError) as e:
                if i == ATTEMPTS:
                    raise RequestFailed(f"{path}: {e}") from e
                time.sleep(self.pause * i)
        raise AssertionError

    def scroll(self, path: str, body: dict) -> Iterator[dict]:
        """All hits of a search, page by page; fewer than announced is an error."""
        page, seen = self.post(path, body), 0
        total = page["hits"]["total"]
        total = total["value"] if isinstance(total, dict) else total
        while page["hits"]["hits"]:
            for hit in page["hits"]["hits"]:
                seen += 1
                yield hit["_source"]
            if seen >= total:
                break
            page = self.post("/_search/scroll", {"scroll": "5m", "scroll_id": page["_scroll_id"]})
        if seen != total:
            raise RequestFailed(f"{path}: {seen} of {total} hits")


class Batch(InputPartition):
    def __init__(self, numbers: list[str] | None):
        self.numbers = numbers


class RegisterReader(DataSourceReader):
    def __init__(self, options: dict, client: Callable[..., Client] = Client):
        self.options, self.client = options, client

    def partitions(self) -> list[Batch]:
        numbers = [n for n in self.options.get("numbers", "").split(",") if n]
        size = min(BATCH, int(self.options.get("batch", BATCH)))
        return [Batch(numbers[i : i + size]) for i in range(0, len(numbers), size)] or [Batch(None)]

    def read(self, partition: Batch) -> Iterator[tuple]:
        c = self.client(self.options["url"], self.options.get("user"), self.options.get("password"))
        query = {"match_all": {}} if partition.numbers is None else {"terms": {self.options.get("field", "Vrvirksomhed.cvrNummer"): partition.numbers}}
        body = {"size": int(self.options.get("page", 1000)), "query": query}
        most = int(self.options.get("limit", 0))
        for i, hit in enumerate(c.scroll(f"{self.options['index']}/_search?scroll=5m", body)):
            if most and i >= most:
                return
            yield (json.dumps(hit, ensure_ascii=False),)


class RegisterSource(DataSource):
    """Options: url, index, numbers (comma list; none: everything by scroll), batch, page, limit, field, user, password."""

    @classmethod
    def name(cls) -> str:
        return "register"

    def schema(self) -> str:
        return "document string"

    def reader(self, schema) -> DataSourceReader:
        return RegisterReader(dict(self.options))


def pause_after(attempt: int, told: str | None = None) -> float:
    """Seconds to wait: what the answer says, else twice as long each time, LONGEST at most."""
    return min(LONGEST, float(told) if told and told.isdigit() else PAUSE * 2**attempt)


def fetch_notice(number: str, url: str, get: Callable[[str], tuple[int, str, str | None]] | None = None, wait=time.sleep) -> tuple[str, str | None]:
    """(status, text) of a notice: ok, not_found, or the last trouble."""

    def over_http(address: str) -> tuple[int, str, str | None]:
        try:
            with urllib.request.urlopen(address, timeout=60) as r:
                return r.status, r.read().decode("utf-8", "replace"), r.headers.get("Retry-After")
        except urllib.error.HTTPError as e:
            return e.code, "", e.headers.get("Retry-After")

    status = "error"
    for i in range(RETRIES):
        try:
            code, text, told = (get or over_http)(url.format(number))
        except OSError:
            code, text, told = 599, "", None
        if code == 200:
            return "ok", text
        if code == 404:
            return "not_found", None
        status = f"http_{code}"
        if code not in (202, 429) and code < 500:
            break
        if i + 1 < RETRIES:
            wait(pause_after(i, told))
    return status, None


def notices(wanted: DataFrame, cache: DataFrame | None, url: str, key: str = "notice_id", get=None) -> DataFrame:
    """(key, fetch_status, xml): from the cache where it has a final answer, else fetched by at most WORKERS tasks."""
    ids = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    known = cache.where(F.col("fetch_status").isin(*FINAL)).select(key, "fetch_status", "xml") if cache is not None else None
    todo = ids.join(known.select(key), key, "left_anti") if known is not None else ids

    def run(batches):
        for b in batches:
            got = [fetch_notice(n, url, get) for n in b[key]]
            yield b.assign(fetch_status=[s for s, _ in got], xml=[t for _, t in got])[[key, "fetch_status", "xml"]]

    fetched = todo.repartition(WORKERS).mapInPandas(run, f"{key} string, fetch_status string, xml string")
    return fetched if known is None else known.join(ids, key, "left_semi").unionByName(fetched)
