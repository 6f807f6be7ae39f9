"""Records that an incremental run still has to process (problem 7).

Every run rereads from a low-water mark, the start of the oldest run (transaction) that was open at the last success, and
anti-joins the (record key, version) pairs with a ledger of pairs already processed. The ledger is a stored table: a run
adds its pairs in the same commit as its data (`plans.indexing.run_changes` with `Store`), so a run that dies anywhere
leaves neither and its records are reread, and a record that arrives late, below positions already processed, is in no
ledger and is taken. A record delivered twice has one key and version and appears once.

`pending_changes` answers for repositories known by their states only: it first writes the ledger that the runs behind the
valid states stand for, a table like a run's own, and then rereads and anti-joins in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import saved

REPO = ["project", "repo"]
#: Repositories up to which their marks are broadcast (counted before; about 100 bytes each).
MARKS = 200_000
#: What makes two deliveries of a change one.
CHANGE_KEY = ["project", "repo", "commit_hash", "status", "path"]


def instant(text: Column) -> Column:
    """ISO text with any offset or none (UTC, whatever the session's zone) to a timestamp; null when it is none."""
    t = F.trim(text)
    day, bare = t.rlike(r"^\d{4}-\d{2}-\d{2}$"), ~t.rlike(r"(?i)(Z|UTC|GMT|[+-]\d{2}(:?\d{2})?)$")
    return F.try_to_timestamp(F.when(day, F.concat(t, F.lit("T00:00:00Z"))).when(bare, F.concat(t, F.lit("Z"))).otherwise(t))


def iso(at: Column) -> Column:
    """A timestamp as ISO text in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def commit_positions(log: DataFrame) -> DataFrame:
    """project, repo, commit (lower case), commit_seq, pushed_at if the log has it: each commit once; of several positions
    the first."""
    first = [F.min("commit_seq").alias("commit_seq")] + ([F.min("pushed_at").alias("pushed_at")] if "pushed_at" in log.columns else [])
    return log.where(F.col("commit_hash").isNotNull() & F.col("commit_seq").isNotNull()).groupBy(*REPO, F.lower("commit_hash").alias("commit")).agg(*first)


def counting_states(states: DataFrame, runs: DataFrame) -> DataFrame:
    """States confirmed by a succeeded run of their commit: project, repo, commit, at."""
    ok = runs.where(F.lower(F.trim("outcome")) == "succeeded").select(*REPO, F.lower("commit_hash").alias("commit")).distinct()
    return states.select(*REPO, F.lower("commit_hash").alias("commit"), instant(F.col("indexed_at")).alias("at")).where("at is not null and commit is not null").join(ok, [*REPO, "commit"], "left_semi")


def low_water(states: DataFrame, runs: DataFrame, positions: DataFrame) -> DataFrame:
    """Per repository the valid state's position `done_seq` and the reread position `low_seq`.

    low_seq is the position before the oldest run that had begun but not ended when the valid state was written, and
    never above done_seq; both are null where the valid state's commit is not in the log.
    """
    positions = positions.select(*REPO, "commit", "commit_seq")
    valid = counting_states(states, runs).join(positions, [*REPO, "commit"], "left")
    # ties of the instant: the later commit
    valid = valid.groupBy(*REPO).agg(F.max_by(F.struct("at", "commit_seq"), F.struct("at", F.coalesce("commit_seq", F.lit(-1)))).alias("v")).select(*REPO, "v.at", F.col("v.commit_seq").alias("done_seq"))
    began = runs.select(*REPO, F.lower("commit_hash").alias("commit"), "started_at", "finished_at").join(positions, [*REPO, "commit"])
    still = (
        began.join(valid.select(*REPO, "at"), REPO)
        .where((F.col("started_at") <= F.col("at")) & (F.col("finished_at").isNull() | (F.col("finished_at") > F.col("at"))))
        .groupBy(*REPO)
        .agg((F.min("commit_seq") - 1).alias("open_seq"))
    )
    return valid.join(still, REPO, "left").select(*REPO, "done_seq", F.when(F.col("done_seq").isNotNull(), F.least("done_seq", F.coalesce("open_seq", "done_seq"))).alias("low_seq"))


def unprocessed(records: DataFrame, ledger: DataFrame, key: list[str], version: str) -> DataFrame:
    """The records whose (key, version) is not in the ledger; nulls in the key are values like any other."""
    cond = records[version] == ledger[version]
    for c in key:
        cond = cond & records[c].eqNullSafe(ledger[c])
    return records.join(ledger, cond, "left_anti")


def positioned(changes: DataFrame, positions: DataFrame) -> DataFrame:
    """Changes whose commit is in the log, each once: CHANGE_KEY, commit_seq, smallest change_id, first received_at (if the
    feed has it; not before the commit was pushed, since a change counts once both it and its commit are there)."""
    first = [F.min("change_id").alias("change_id")] + ([F.min("received_at").alias("received_at")] if "received_at" in changes.columns else [])
    once = changes.withColumn("commit_hash", F.lower("commit_hash")).groupBy(*CHANGE_KEY).agg(*first)  # deliveries meet before any join
    known = once.join(positions.withColumnRenamed("commit", "commit_hash"), [*REPO, "commit_hash"])
    if "pushed_at" not in known.columns:
        return known
    return (known.withColumn("received_at", F.greatest("received_at", "pushed_at")) if "received_at" in known.columns else known).drop("pushed_at")


def pending_changes(changes: DataFrame, log: DataFrame, states: DataFrame, runs: DataFrame) -> DataFrame:
    """Change ids still to process, each change once (smallest change_id).

    Nulls: a change without project, repo or commit_hash cannot be in the log and is not pending; null status or path
    are values like any other. Empty tables give an empty result or, without states, every change in the log.
    """
    positions = saved(commit_positions(log), "positions")
    marks = saved(low_water(states, runs, positions), "marks")
    if marks.count() <= MARKS:  # a repository may hold a third of all changes: no shuffle by repository
        marks = F.broadcast(marks)
    known = saved(positioned(changes, positions).join(marks, REPO, "left"), "known")
    # what the runs behind the valid states have processed, as they would have recorded it
    ledger = saved(known.where(F.col("commit_seq") <= F.col("done_seq")).select(*CHANGE_KEY, "commit_seq"), "ledger")
    reread = known.where(F.col("low_seq").isNull() | (F.col("commit_seq") > F.col("low_seq")))
    return unprocessed(reread, ledger, CHANGE_KEY, "commit_seq").select("change_id").distinct()


def pending_records(records: DataFrame, ledger: DataFrame, key: list[str], version: str, position: str, low: object) -> DataFrame:
    """General form: records at or after the position `low` (None: all), each (key, version) once, without those in the
    ledger. A record without a position is always reread."""
    new = records.where(F.col(position).isNull() | (F.col(position) >= F.lit(low))) if low is not None else records
    return unprocessed(new.dropDuplicates([*key, version]), ledger.select(*key, version), key, version)


def oldest_open(runs: DataFrame, began: str = "started_at", ended: str = "finished_at", done: str = "outcome") -> object:
    """The start of the oldest transaction that was open at the last success; None rereads everything.

    A run that succeeded read what was there when it began, so it counts as open itself. One aggregate row comes to the
    driver.
    """
    ok = F.lower(F.trim(F.col(done))) == "succeeded"
    last = runs.where(ok).agg(F.max_by(F.struct(F.col(began).alias("b"), F.col(ended).alias("e")), ended).alias("t")).first()["t"]
    if last is None:
        return None
    still = runs.where((F.col(began) <= F.lit(last["b"])) & (F.col(ended).isNull() | (F.col(ended) >= F.lit(last["b"])))).agg(F.min(began).alias("t")).first()["t"]
    return still if still is not None else last["b"]
