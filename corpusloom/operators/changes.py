"""Change feeds, commit maps and the plan of an index run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.incremental import instant

REPO = ["project", "repo"]


def parse_name_status(feed: DataFrame, line: str = "line") -> DataFrame:
    """Lines of a name-status listing into status and path, other columns kept: renames are a deletion and an addition,
    copies an addition, type changes modifications; blank lines and lines without a path are dropped."""
    rest = [c for c in feed.columns if c != line]
    part = F.split(F.regexp_replace(F.col(line), r"[\r\n]+$", ""), "\t")
    kind = F.left(F.element_at(part, 1), F.lit(1))
    row = lambda status, at: F.struct(status.alias("status"), F.get(part, F.lit(at)).alias("path"))
    rows = F.when(kind == "R", F.array(row(F.lit("D"), 1), row(F.lit("A"), 2))).when(kind == "C", F.array(row(F.lit("A"), 2))).otherwise(F.array(row(F.when(kind == "T", "M").otherwise(kind), 1)))
    return feed.where(F.trim(F.col(line)) != "").select(*rest, F.explode(rows).alias("r")).select(*rest, "r.status", "r.path").where("path is not null and status <> ''")


def last_commits(changes: DataFrame, log: DataFrame) -> DataFrame:
    """project, repo, path, commit_hash, commit_date of the newest commit of each live path (the last change is no
    deletion); later change_id decides within a commit."""
    pos = log.groupBy(*REPO, F.lower("commit_hash").alias("h")).agg(F.min("commit_seq").alias("seq"), F.min_by("commit_date", "commit_seq").alias("commit_date"))
    rows = changes.select(*REPO, "path", "status", "change_id", F.lower("commit_hash").alias("h")).join(pos, [*REPO, "h"])
    last = rows.groupBy(*REPO, "path").agg(F.max(F.struct("seq", "change_id", "status", "h", "commit_date")).alias("x"))
    return last.where("x.status <> 'D'").select(*REPO, "path", F.col("x.h").alias("commit_hash"), F.col("x.commit_date").alias("commit_date"))


def index_plan(log: DataFrame, states: DataFrame) -> DataFrame:
    """What a run does with each repository of the log: skip (head is indexed), incremental (prior commit is known) or full."""
    head = log.groupBy(*REPO).agg(F.lower(F.max_by("commit_hash", "commit_seq")).alias("head"))
    prior = states.withColumn("at", instant(F.col("indexed_at"))).where("at is not null").groupBy(*REPO).agg(F.max(F.struct("at", F.lower(F.coalesce("commit_hash", F.lit(""))).alias("c")))["c"].alias("prior"))
    known = log.select(*REPO, F.lower("commit_hash").alias("prior")).distinct().withColumn("known", F.lit(True))
    rows = head.join(prior, REPO, "left").join(known, [*REPO, "prior"], "left")
    action = F.when(F.col("head") == F.col("prior"), "skip").when(F.col("known"), "incremental").otherwise("full")
    return rows.select(*REPO, "head", "prior", action.alias("action"))


def pr_documents(prs: DataFrame) -> DataFrame:
    """Pull requests as documents: path, text with the linked work items, type, date."""
    title, body = F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))
    items = F.array_sort(F.coalesce("work_item_ids", F.array().cast("array<int>")))
    linked = F.when(F.size(items) > 0, F.concat(F.lit("\n\nLinked work items: "), F.array_join(F.transform(items, lambda x: F.concat(F.lit("#"), x.cast("string"))), ", "))).otherwise("")
    text = F.concat(F.lit("# "), title, F.lit("\n\n"), body, linked)
    return prs.select(*REPO, "pr_id", F.format_string("_pull_requests/%d.md", "pr_id").alias("path"), text.alias("text"), F.lit("pr").alias("content_type"), F.lit("").alias("commit_hash"), F.coalesce("created_date", F.lit("")).alias("commit_date")).distinct()


def pr_cursor(prs: DataFrame) -> DataFrame:
    """Highest pull request of each repository."""
    return prs.groupBy(*REPO).agg(F.max("pr_id").alias("last_pr_id"))


def new_pull_requests(prs: DataFrame, cursor: DataFrame) -> DataFrame:
    """Pull requests above their repository's cursor."""
    return prs.join(cursor, REPO, "left").where("last_pr_id is null or pr_id > last_pr_id").drop("last_pr_id")
