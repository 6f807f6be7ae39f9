"""A whole run: configuration, checkouts, files, plan, index, pull requests."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusloom.plans import indexing
from corpusloom.session import saved
from corpusloom.sources import config as cfg
from corpusloom.sources import files as src
from corpusloom.sources import git
from corpusloom.sources.pull_requests import PullRequestSource
from corpusloom.store import Store

log = logging.getLogger(__name__)


@dataclass
class Report:
    """What a run did: repositories by action, failures (project, name, error), counts of files read."""

    actions: dict[str, int] = field(default_factory=dict)
    failed: list[tuple[str, str, str]] = field(default_factory=list)
    files: int = 0
    bytes: int = 0


def run_index(store: Store, config: dict, base_url: str, folder: str, provider: Callable, model: str = "hash-96", progress: Callable[[Report], None] | None = None, pull_requests: dict | None = None) -> Report:
    """Synchronise all configured repositories below the shared FOLDER and bring the index up to date.

    A repository that cannot be synchronised is reported and left as it was; the others go on. Code and wikis are one plan
    over all repositories. Files are counted while they are read (`observe`), and PROGRESS is told after every step.
    PULL_REQUESTS: options of the data source (token, fetch) if pull requests are to be read.
    """
    spark, report = store.spark, Report()
    tell = progress or (lambda r: log.info("%s", r))
    kept = indexing.gate(store, model)
    repos = cfg.repos(spark, config)
    synced = saved(git.sync_all(repos, base_url, folder), "synced")
    report.failed = [(r["project"], r["name"], r["error"]) for r in synced.where("error is not null").collect()]  # a row a repository
    tell(report)
    good = synced.where("error is null").join(repos.select("project", "name", "content_type"), ["project", "name"])
    states = store.read("repo_index_state").select("project", "repo", F.col("commit_hash").alias("prior"))
    plan = good.select("project", F.col("name").alias("repo"), "content_type", "head").join(states, ["project", "repo"], "left")
    action = F.when(F.lit(kept) & (F.col("prior") == F.col("head")), "skip").when(F.lit(kept) & F.col("prior").isNotNull(), "incremental").otherwise("full")
    plan = saved(plan.withColumn("action", action), "plan")
    report.actions = {r[0]: r[1] for r in plan.groupBy("action").count().collect()}
    tell(report)
    todo = plan.where("action <> 'skip'")
    if not todo.isEmpty():
        seen = Observation("files")
        rows = src.read_files(spark, folder).drop("content_type").join(todo.select("project", "repo", "content_type"), ["project", "repo"])
        rows = saved(rows.observe(seen, F.count(F.lit(1)).alias("files"), F.sum("file_size_bytes").alias("bytes")), "files")
        report.files, report.bytes = seen.get["files"], seen.get["bytes"] or 0
        tell(report)
        named = todo.select("project", F.col("repo").alias("name"))
        commits = git.commit_map(named, folder, rows)
        full, some = todo.where("action = 'full'"), todo.where("action = 'incremental'")
        heads = lambda p: p.select("project", "repo", "content_type", F.col("head").alias("commit_hash"))
        if not full.isEmpty():
            indexing.full_index(store, rows, heads(full), provider, commits)
        if not some.isEmpty():
            indexing.incremental_index(store, saved(git.changed_paths(some, folder), "changed"), rows, heads(some), provider, commits)
    indexing.removed_repos(store, repos)
    if pull_requests is not None and cfg.option(config, "index_pull_requests"):
        indexing.index_pull_requests(store, read_pull_requests(store, good.where("content_type = 'code'"), base_url, pull_requests), provider)
    tell(report)
    return report


def read_pull_requests(store: Store, repos: DataFrame, base_url: str, options: dict) -> DataFrame:
    """Pull requests above the stored cursors of all repositories (project, name), a partition each."""
    spark = store.spark
    known = store.read("pr_state").select("project", F.col("repo").alias("name"), "last_pr_id")
    listed = [[r["project"], r["name"], r["last_pr_id"] or 0] for r in repos.select("project", "name").join(known, ["project", "name"], "left").collect()]  # a row a repository
    spark.dataSource.register(PullRequestSource)
    return spark.read.format("pull_requests").options(base_url=base_url, repos=json.dumps(listed), **options).load()
