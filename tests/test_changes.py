from datetime import datetime

from pyspark.sql import functions as F

from corpusloom.operators import changes, incremental

LOG = "project string, repo string, commit_seq bigint, commit_hash string, commit_date string, pushed_at timestamp"
FEED = "change_id bigint, project string, repo string, commit_hash string, status string, path string, received_at timestamp, outcome string"
STATE = "project string, repo string, commit_hash string, indexed_at string"
RUN = "run_id bigint, project string, repo string, commit_hash string, started_at timestamp, finished_at timestamp, outcome string"


def t(h):
    return datetime(2024, 1, 1, h)


def test_name_status(spark):
    feed = spark.createDataFrame([(x,) for x in ("R100\told\tnew", "T\ta", "M\tb c", "", "D\tz\r", "C75\ta\tb", "A")], "line string")
    assert sorted(map(tuple, changes.parse_name_status(feed).collect())) == sorted([("D", "old"), ("A", "new"), ("M", "a"), ("M", "b c"), ("D", "z"), ("A", "b")])


def pending(spark, feed, log, states, runs):
    d = spark.createDataFrame
    return sorted(r[0] for r in incremental.pending_changes(d(feed, FEED), d(log, LOG), d(states, STATE), d(runs, RUN)).collect())


LOGROWS = [("p", "r", k, f"c{k}", "x", t(0)) for k in (1, 2, 5, 9)] * 2 + [("p", "s", 1, "s1", "x", t(0))]
FEEDROWS = [(k, "p", "r", c, "M", path, t(1), "clash") for k, c, path in ((1, "c1", "a"), (2, "C5", "a"), (3, "c5", "a"), (4, "c9", None), (5, "c9", None), (6, "gone", "a"), (7, "c2", "b"))] + [(8, "p", "s", "s1", "A", "a", t(1), None), (9, None, "s", "s1", "A", "a", t(1), None)]


def test_pending(spark):
    runs = [(1, "p", "r", "C2", t(1), t(2), "Succeeded"), (2, "p", "r", "c9", t(3), None, "failed"), (3, "p", "r", "c1", t(1), None, None)]
    states = [("p", "r", "c2", "2024-01-01T02:00:00Z"), ("p", "r", "c2", "2024-01-01T02:00:00Z"), ("p", "r", "c9", "2024-01-02T00:00:00Z"), ("p", "r", None, None), ("p", "r", "", "x")]
    # the failed run's newer state does not count; a late change below the valid commit is not pending
    assert pending(spark, FEEDROWS, LOGROWS, states, runs) == [2, 4, 8]
    assert pending(spark, FEEDROWS, LOGROWS, [], runs) == [1, 2, 4, 7, 8]
    assert pending(spark, [], LOGROWS, states, runs) == [] and pending(spark, FEEDROWS, [], states, runs) == []
    # a valid state whose commit is not in the log covers nothing
    assert pending(spark, FEEDROWS, LOGROWS, [("p", "r", "zz", "2024-01-01T02:00:00+05:00")], [(1, "p", "r", "ZZ", t(1), t(2), "succeeded")]) == [1, 2, 4, 7, 8]


def test_general_form(spark):
    runs = spark.createDataFrame([(t(1), t(2), "succeeded"), (t(0), None, "running"), (t(5), t(6), "failed")], "started_at timestamp, finished_at timestamp, outcome string")
    assert incremental.oldest_open(runs) == t(0) and incremental.oldest_open(runs.limit(0)) is None
    rec = spark.createDataFrame([("k", 1, t(0)), ("k", 1, t(1)), ("k", 2, t(3)), ("l", 1, t(1))], "k string, v int, at timestamp")
    done = spark.createDataFrame([("k", 1)], "k string, v int")
    got = incremental.pending_records(rec, done, ["k"], "v", "at", t(0)).select("k", "v").collect()
    assert sorted(map(tuple, got)) == [("k", 2), ("l", 1)]


def test_plan_and_commits(spark):
    log = spark.createDataFrame(LOGROWS, LOG)
    states = spark.createDataFrame([("p", "r", "C5", "2024-01-01T02:00:00Z")], STATE)
    assert {(r["repo"], r["action"]) for r in changes.index_plan(log, states).collect()} == {("r", "incremental"), ("s", "full")}
    feed = spark.createDataFrame([*FEEDROWS[:3], (10, "p", "r", "c9", "D", "b", t(1), None), FEEDROWS[6]], FEED)
    assert [(r["path"], r["commit_hash"]) for r in changes.last_commits(feed, log).collect()] == [("a", "c5")]


def test_pr_documents(spark):
    prs = spark.createDataFrame([("p", "r", 3, "T", None, "d", [7, 2]), ("p", "r", 3, "T", None, "d", [7, 2]), ("p", "r", 9, None, "x", None, None)], "project string, repo string, pr_id bigint, title string, description string, created_date string, work_item_ids array<int>")
    rows = {r["pr_id"]: r for r in changes.pr_documents(prs).collect()}
    assert rows[3]["text"] == "# T\n\n\n\nLinked work items: #2, #7" and rows[9]["text"] == "# \n\nx" and rows[9]["path"] == "_pull_requests/9.md"
    cursor = spark.createDataFrame([("p", "r", 3)], "project string, repo string, last_pr_id bigint")
    assert [r["pr_id"] for r in changes.new_pull_requests(prs, cursor).collect()] == [9]


def test_instants_do_not_depend_on_the_session(spark):
    texts = ["2024-01-01T02:00:00Z", "2024-01-01T02:00:00", " 2024-01-01 04:00:00+02:00", "2024-01-01", "2024-01-01T02:00:00.5+0000", "x", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    want = ["2024-01-01T02:00:00Z"] * 3 + ["2024-01-01T00:00:00Z", "2024-01-01T02:00:00Z", None, None, None]
    for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [r[0] for r in rows.select(incremental.iso(incremental.instant(F.col("t")))).collect()] == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
