"""Pull requests of a paged service as a Python data source, batch or stream.

Options: base_url, token, fetch (import path of a function used instead of HTTP, for tests: fetch(url) -> decoded JSON), and
the repositories: project, repo, since (highest id already read), or `repos`, a JSON list of [project, repo, since]. A batch
read has one partition a repository. The stream's offset is the highest pull request id of each repository.
"""

from __future__ import annotations

import base64
import importlib
import itertools
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

PAGE = 100
SCHEMA = "project string, repo string, pr_id bigint, title string, description string, created_date string, work_item_ids array<int>"


def session(token: str) -> Callable[[str], dict]:
    """A getter with basic authentication of an empty user and the token; transport retries on rate limits."""
    head = {"Authorization": "Basic " + base64.b64encode(f":{token}".encode()).decode(), "Accept": "application/json"}

    def get(url: str, attempts: int = 6) -> dict:
        for k in range(attempts):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=head), timeout=60) as r:
                    return json.load(r)
            except urllib.error.HTTPError as e:
                if e.code != 429 or k == attempts - 1:
                    raise
                time.sleep(backoff(e.headers.get("Retry-After"), k))
        raise AssertionError

    return get


def backoff(retry_after: str | None, attempt: int) -> float:
    """Seconds to wait: what the server says, else doubling up to a minute."""
    try:
        return float(retry_after)
    except (TypeError, ValueError):
        return float(min(60, 2 ** (attempt + 1)))


def pulls_url(base: str, project: str, repo: str, skip: int) -> str:
    query = urlencode({"searchCriteria.status": "all", "$top": PAGE, "$skip": skip, "api-version": "7.1"})
    return f"{base.rstrip('/')}/{quote(project)}/_apis/git/repositories/{quote(repo)}/pullrequests?{query}"


def items_url(base: str, project: str, repo: str, pr: int) -> str:
    return f"{base.rstrip('/')}/{quote(project)}/_apis/git/repositories/{quote(repo)}/pullRequests/{pr}/workitems?api-version=7.1"


def work_items(get: Callable, base: str, project: str, repo: str, pr: int) -> list[int]:
    return sorted(int(x["id"]) for x in get(items_url(base, project, repo, pr)).get("value", []))


def pages(get: Callable, base: str, project: str, repo: str) -> Iterator[list[dict]]:
    """The pages of a repository's pull requests, newest first, up to the first that is not full."""
    for k in itertools.count():
        page = get(pulls_url(base, project, repo, k * PAGE)).get("value", [])
        yield page
        if len(page) < PAGE:
            return


def new_pull_requests(get: Callable, base: str, project: str, repo: str, since: int) -> list[tuple]:
    """Rows of SCHEMA of the pull requests above SINCE by rising id; no page behind the first known one is asked for."""
    newest_first = itertools.chain.from_iterable(pages(get, base, project, repo))
    fresh = itertools.takewhile(lambda p: int(p["pullRequestId"]) > since, newest_first)
    rows = [(project, repo, int(p["pullRequestId"]), *(p.get(name) or "" for name in ("title", "description", "creationDate"))) for p in fresh]
    return [(*r, work_items(get, base, project, repo, r[2])) for r in sorted(rows)]


class _Service:
    def __init__(self, options: dict) -> None:
        self.base, self.token, self.named = options["base_url"], options.get("token", ""), options.get("fetch")
        listed = json.loads(options["repos"]) if "repos" in options else [[options["project"], options["repo"], options.get("since", 0)]]
        self.since = {(project, repo): int(since) for project, repo, since in listed}

    def getter(self) -> Callable:
        if self.named:
            module, _, name = self.named.rpartition(".")
            return getattr(importlib.import_module(module), name)
        return session(self.token)

    def rows(self, project: str, repo: str, since: int) -> list[tuple]:
        return new_pull_requests(self.getter(), self.base, project, repo, since)


class PullRequestSource(DataSource):
    """spark.dataSource.register(PullRequestSource); spark.read.format("pull_requests").options(...)."""

    @classmethod
    def name(cls) -> str:
        return "pull_requests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)


class _Repository(InputPartition):
    def __init__(self, project: str, repo: str, since: int) -> None:
        super().__init__((project, repo, since))


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.service = _Service(dict(options))

    def partitions(self) -> list[InputPartition]:
        return [_Repository(*key, since) for key, since in self.service.since.items()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.service.rows(*partition.value)


class _Stream(SimpleDataSourceStreamReader):
    """Offsets: {"project/repo as JSON": highest id}."""

    def __init__(self, options: dict) -> None:
        self.service = _Service(dict(options))

    def initialOffset(self) -> dict:
        return {json.dumps(key): since for key, since in self.service.since.items()}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = [r for key, since in start.items() for r in self.service.rows(*json.loads(key), int(since))]
        top: dict[str, int] = {}
        for r in rows:
            key = json.dumps((r[0], r[1]))
            top[key] = max(top.get(key, 0), r[2])
        return iter(rows), start | top

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows, _ = self.read(start)
        return (r for r in rows if r[2] <= int(end[json.dumps((r[0], r[1]))]))
