"""An index run: which files, chunks, vectors, commits, and into which version."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.functions.chunking import OVERLAP, SIZE, chunk_rows
from corpusloom.functions.embedding import embedder
from corpusloom.operators.changes import new_pull_requests, pr_cursor, pr_documents
from corpusloom.operators.incremental import CHANGE_KEY, commit_positions, oldest_open, pending_records, positioned
from corpusloom.session import saved
from corpusloom.store import Store

PIPELINE_VERSION = 5


def fingerprint(model: str = "hash-96") -> str:
    """Hash of all settings that change what a chunk looks like or which files count."""
    settings = {"size": SIZE, "overlap": OVERLAP, "model": model, "skip_ext": sorted(t.SKIP_EXT), "skip_dirs": sorted(t.SKIP_DIRS), "skip_filenames": sorted(t.SKIP_FILENAMES), "max_file_bytes": t.MAX_FILE_BYTES, "pipeline_version": PIPELINE_VERSION}
    return hashlib.sha1(json.dumps(settings, sort_keys=True).encode()).hexdigest()


def gate(store: Store, model: str = "hash-96") -> bool:
    """Whether the index of this fingerprint goes on; otherwise it is emptied first."""
    store.ensure()
    now = fingerprint(model)
    if store.state().get("fingerprint") == now:
        return True
    store.reset(now)
    return False


def backfilled(chunks: DataFrame, commits: DataFrame) -> DataFrame:
    """Chunks with the commit of their path (either slash) where COMMITS (project, repo, path, commit_hash, commit_date) knows it."""
    keys = ["project", "repo", "path"]
    known = commits.select(*keys, F.col("commit_hash").alias("_h"), F.col("commit_date").alias("_d")).dropDuplicates(keys)
    rows = chunks.withColumn("path", F.replace("path", F.lit("\\"), F.lit("/"))).join(known, keys, "left")
    return rows.withColumn("commit_hash", F.coalesce("_h", "commit_hash")).withColumn("commit_date", F.coalesce("_d", "commit_date")).drop("_h", "_d")


def embedded(files: DataFrame, provider: Callable, commits: DataFrame | None = None) -> DataFrame:
    """Chunks with vectors and, if given, commits (project, repo, path, commit_hash, commit_date); unknown ones are empty."""
    chunks = chunk_rows(files)
    if commits is not None:
        chunks = backfilled(chunks, commits)
    return chunks.withColumn("embedding", embedder(provider)(F.col("embed_text"))).drop("embed_text")


def full_index(store: Store, files: DataFrame, heads: DataFrame, provider: Callable, commits: DataFrame | None = None) -> None:
    """Replace the repositories of HEADS (project, repo, content_type, commit_hash); data and state count together."""
    chunks = embedded(files.join(heads.select("project", "repo").distinct(), ["project", "repo"], "left_semi"), provider, commits)
    store.apply(new=chunks, repos=heads, also={"repo_index_state": store.states_with(heads)})


def incremental_index(store: Store, changes: DataFrame, files: DataFrame, heads: DataFrame, provider: Callable, commits: DataFrame | None = None) -> None:
    """Apply CHANGES (project, repo, path, status): every changed path is deleted, added and modified ones that FILES still
    holds are chunked again."""
    keys = ["project", "repo", "path"]
    again = files.join(changes.where("status <> 'D'").select(*keys).distinct(), keys, "left_semi")
    store.apply(new=embedded(again, provider, commits), paths=changes, also={"repo_index_state": store.states_with(heads)})


def begin_run(store: Store, run_id: str) -> None:
    """Record a run as open, before it reads anything."""
    store.ensure()
    others = store.read("index_runs").where(F.col("run_id") != run_id)
    mine = store.spark.range(1).select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit("running").alias("outcome"))
    store.write("index_runs", others.unionByName(mine))


def end_run(store: Store, run_id: str, outcome: str) -> DataFrame:
    """The table of runs once this one has ended."""
    mine = F.col("run_id") == run_id
    return store.read("index_runs").withColumn("finished_at", F.when(mine, F.current_timestamp()).otherwise(F.col("finished_at"))).withColumn("outcome", F.when(mine, outcome).otherwise(F.col("outcome")))


def run_changes(store: Store, run_id: str, changes: DataFrame, log: DataFrame, files: DataFrame, provider: Callable) -> int:
    """One run over the change feed (change_id, project, repo, commit_hash, status, path, received_at): how many changes it
    processed.

    It rereads what was received since the oldest run open at the last success began and leaves out what the ledger holds.
    Chunks, ledger, states and the run's outcome count from one commit on: a run that dies before leaves nothing, one that
    is started again after it finds nothing to do. A run that died stays open, so later ones reread from its start;
    a new start under its run_id or `abandon_run` ends that.
    """
    begin_run(store, run_id)
    low = oldest_open(store.read("index_runs").where(F.col("run_id") != run_id))
    positions = commit_positions(log)
    todo = saved(pending_records(positioned(changes, positions), store.read("processed"), CHANGE_KEY, "commit_seq", "received_at", low), "todo")
    count = todo.count()
    keys = ["project", "repo", "path"]
    touched = todo.where("path is not null").select(*keys).distinct()
    # the file as it is now decides, not the status of a change that may be late
    chunks = embedded(files.join(touched, keys, "left_semi"), provider)
    last = todo.groupBy("project", "repo").agg(F.max(F.struct("commit_seq", "commit_hash"))["commit_hash"].alias("commit_hash"), F.max("commit_seq").alias("seq"))
    # a late change does not set a repository's state back
    at = store.read("repo_index_state").join(positions.withColumnRenamed("commit", "commit_hash"), ["project", "repo", "commit_hash"]).select("project", "repo", F.col("commit_seq").alias("was"))
    heads = last.join(at, ["project", "repo"], "left").where("was is null or seq > was").select("project", "repo", "commit_hash")
    ledger = todo.select(*CHANGE_KEY, "commit_seq", "received_at", F.lit(run_id).alias("run_id"))
    store.apply(new=chunks, paths=touched, also={"repo_index_state": store.states_with(heads), "index_runs": end_run(store, run_id, "succeeded")}, ledger=(run_id, ledger) if count else None)
    return count


def abandon_run(store: Store, run_id: str) -> None:
    """Close a run that died."""
    store.write("index_runs", end_run(store, run_id, "failed"))


def index_repos(store: Store, plan: DataFrame, changes: DataFrame, files: DataFrame, provider: Callable, commits: DataFrame | None = None, model: str = "hash-96", content_type: str = "code") -> None:
    """One run over all repositories of PLAN (project, repo, head, action): all DataFrames, no loop over repositories."""
    kept = gate(store, model)
    heads = plan.select("project", "repo", F.lit(content_type).alias("content_type"), F.col("head").alias("commit_hash"), "action")
    full = heads.where("action = 'full'" if kept else "true")
    some = heads.where("action = 'incremental'" if kept else "false")
    if not full.isEmpty():
        full_index(store, files, full, provider, commits)
    if not some.isEmpty():
        incremental_index(store, changes.join(some.select("project", "repo"), ["project", "repo"], "left_semi"), files, some, provider, commits)


def index_pull_requests(store: Store, prs: DataFrame, provider: Callable) -> None:
    """Pull requests above the cursor become documents; the cursor follows the data, and without new ones nothing changes."""
    store.ensure()
    new = new_pull_requests(prs, store.read("pr_state").select("project", "repo", "last_pr_id"))
    if new.isEmpty():
        return
    docs = pr_documents(new).withColumn("language", F.lit("md")).withColumn("file_size_bytes", F.octet_length("text").cast("long"))
    store.upsert(embedded(docs, provider))
    store.record_prs(pr_cursor(new))


def removed_repos(store: Store, configured: DataFrame) -> None:
    """Drop chunks of repositories that are no longer configured (project, name)."""
    keys = configured.select("project", F.col("name").alias("repo")).distinct()
    store.apply(repos=store.read("chunks").select("project", "repo", "content_type").distinct().join(keys, ["project", "repo"], "left_anti"))
