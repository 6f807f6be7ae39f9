"""Repositories on disk: synchronising, heads, change listings and logs. Nothing here is on a query's path."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def git(root: str | Path, *args: str) -> str:
    return subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True, check=True).stdout


def repo_url(base: str, project: str, name: str) -> str:
    from urllib.parse import quote

    return f"{base.rstrip('/')}/{quote(project)}/_git/{quote(name)}"


def sync_repo(url: str, target: str, branch: str | None = None) -> str:
    """Clone, or bring up to date: a pinned branch is reset to its remote, else fast-forward only. Returns the head."""
    if not (Path(target) / ".git").exists():
        Path(target).parent.mkdir(parents=True, exist_ok=True)
        pin = ["--branch", branch] if branch else []
        subprocess.run(["git", "clone", "-q", "--single-branch", *pin, url, target], check=True, capture_output=True)
    elif branch:
        git(target, "fetch", "-q", "origin", branch)
        git(target, "checkout", "-q", "-B", branch, "FETCH_HEAD")
    else:
        git(target, "pull", "-q", "--ff-only")
    return head_commit(target)


def sync_all(repos: DataFrame, base: str, folder: str, parallel: int = 8) -> DataFrame:
    """project, name, head, error of every repository; a failure is a row, not the end. The folder must be shared."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                try:
                    rows.append((r.project, r.name, sync_repo(repo_url(base, r.project, r.name), f"{folder}/{r.project}/{r.name}", r.branch), None))
                except (subprocess.CalledProcessError, OSError) as e:
                    rows.append((r.project, r.name, None, str(getattr(e, "stderr", None) or e)[:500]))
            yield pd.DataFrame(rows, columns=["project", "name", "head", "error"])

    return repos.select("project", "name", "branch").repartition(parallel).mapInPandas(run, "project string, name string, head string, error string")


def head_commit(root: str | Path) -> str:
    return git(root, "rev-parse", "HEAD").strip()


def name_status(root: str | Path, old: str, new: str) -> list[tuple[str, str]]:
    """(status, path) between two commits, read in the form that quotes nothing."""
    parts = git(root, "diff", "--name-status", "-M", "-z", old, new).split("\0")
    out, i = [], 0
    while i < len(parts) - 1:
        kind = parts[i][:1]
        if kind in "RC":
            out += [("D", parts[i + 1])] * (kind == "R") + [("A", parts[i + 2])]
            i += 3
        else:
            out.append(("M" if kind == "T" else kind, parts[i + 1]))
            i += 2
    return out


def log_batches(root: str | Path, size: int = 10_000) -> Iterator[list[tuple[int, str, str, str]]]:
    """(position from the newest, hash, ISO date, path) of every change of the log, in lists of about SIZE while git runs."""
    command = ["git", "-C", str(root), "log", "--format=%x01%H%x09%cI", "--name-only", "-z"]
    rows: list[tuple[int, str, str, str]] = []
    seq, head, rest = -1, ("", ""), b""
    with subprocess.Popen(command, stdout=subprocess.PIPE) as run:
        while data := run.stdout.read(1 << 20):
            *parts, rest = (rest + data).replace(b"\0", b"\n").split(b"\n")
            for line in parts:
                if line.startswith(b"\x01"):
                    seq, head = seq + 1, tuple(line[1:].decode().split("\t"))
                elif line:
                    rows.append((seq, *head, line.decode("utf-8", "replace")))
            if len(rows) >= size:
                yield rows
                rows = []
    if rest.strip(b"\n") and not rest.startswith(b"\x01"):
        rows.append((seq, *head, rest.decode("utf-8", "replace")))
    yield rows


_COMMITS = "project string, repo string, seq long, commit_hash string, commit_date string, path string"


def commit_logs(repos: DataFrame, folder: str, parallel: int = 8) -> DataFrame:
    """Every change of the histories of all repositories (project, name) checked out below the shared FOLDER, read by the
    tasks: project, repo, seq (0 is the newest commit), commit_hash, commit_date, path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                for rows in log_batches(f"{folder}/{r.project}/{r.name}"):
                    yield pd.DataFrame([(r.project, r.name, *row) for row in rows], columns=["project", "repo", "seq", "commit_hash", "commit_date", "path"])

    return repos.select("project", "name").repartition(parallel).mapInPandas(run, _COMMITS)


def commit_map(repos: DataFrame, folder: str, live: DataFrame | None = None) -> DataFrame:
    """project, repo, path, commit_hash, commit_date of the newest commit of each path; of LIVE paths (project, repo, path)
    only, if given."""
    last = commit_logs(repos, folder).groupBy("project", "repo", "path").agg(F.min_by(F.struct("commit_hash", "commit_date"), "seq").alias("x"))
    last = last.select("project", "repo", "path", "x.*")
    return last if live is None else last.join(live.select("project", "repo", "path").distinct(), ["project", "repo", "path"], "left_semi")


def changed_paths(plan: DataFrame, folder: str, parallel: int = 8) -> DataFrame:
    """project, repo, status, path between `prior` and `head` of every repository of PLAN, read by the tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r.project, r.repo, *x) for r in f.itertuples() for x in name_status(f"{folder}/{r.project}/{r.repo}", r.prior, r.head)]
            yield pd.DataFrame(rows, columns=["project", "repo", "status", "path"])

    return plan.select("project", "repo", "prior", "head").repartition(parallel).mapInPandas(run, "project string, repo string, status string, path string")
