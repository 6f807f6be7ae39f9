import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.api import Api, Tools
from corpusloom.functions.embedding import hash_provider
from corpusloom.operators.changes import index_plan
from corpusloom.plans import indexing, queries, run
from corpusloom.sources import config, files, git
from corpusloom.sources import pull_requests as pr
from corpusloom.store import ConcurrentChange, IndexNotReady, Store
from corpusloom.streaming import pull_request_stream

PRS = [{"pullRequestId": i, "title": f"t{i}", "creationDate": "d"} for i in range(205, 0, -1)]
CALLS = []


def fake_fetch(url):
    CALLS.append(url)
    if "workitems" in url:
        return {"value": [{"id": "9"}, {"id": "4"}]}
    skip = int(url.split("skip=")[1].split("&")[0])
    return {"value": PRS[skip : skip + pr.PAGE]}


def test_config(spark, tmp_path):
    c = {"repos": {"b": None, "a": ["x", {"name": "y", "branch": "m"}, {"no": 1}, None, "null-ish"], "c": 5, "d": "z \"q\"", "e": {"name": "w"}, "f": []}, "azure_devops": {"index_wikis": True}}
    assert [tuple(r) for r in config.repo_rows(spark, c).collect()] == [("b", "b", None), ("a", "x", None), ("a", "y", "m"), ("a", "null-ish", None), ("d", 'z "q"', None), ("e", "w", None)]
    assert [(r["project"], r["problem"][:7]) for r in config.checked(spark, c).where("problem is not null").collect()] == [("a", "an entr"), ("a", "an entr"), ("c", "neither")]
    assert [r["name"] for r in config.repos(spark, c).where("content_type = 'wiki'").collect()] == ["a.wiki", "b.wiki", "d.wiki", "e.wiki"]
    assert config.option({}, "index_wikis") is False and config.repos(spark, {}).count() == 0
    (tmp_path / "c.json").write_text('{"repos": {"q": null}}')
    assert [tuple(r) for r in config.repo_rows(spark, config.load_config(str(tmp_path / "c.json"))).collect()] == [("q", "q", None)]


def test_paging():
    CALLS.clear()
    rows = pr.new_pull_requests(fake_fetch, "http://h", "p", "r", 203)
    assert rows == [("p", "r", 204, "t204", "", "d", [4, 9]), ("p", "r", 205, "t205", "", "d", [4, 9])]
    assert sum("workitems" not in c for c in CALLS) == 1
    assert len(pr.new_pull_requests(fake_fetch, "http://h", "p", "r", 0)) == 205
    assert pr.backoff("3", 0) == 3 and pr.backoff(None, 1) == 4 and pr.backoff("x", 9) == 60


def test_data_source(spark):
    spark.dataSource.register(pr.PullRequestSource)
    df = spark.read.format("pull_requests").options(base_url="http://h", project="p", repo="r", since=200, fetch="tests.test_index.fake_fetch").load()
    assert [r["pr_id"] for r in df.orderBy("pr_id").collect()] == [201, 202, 203, 204, 205]
    # one partition a repository
    many = spark.read.format("pull_requests").options(base_url="http://h", repos='[["p", "r", 203], ["p", "s", 204], ["q", "t", 205]]', fetch="tests.test_index.fake_fetch").load()
    assert many.rdd.getNumPartitions() == 3 and {(r["project"], r["repo"], r["pr_id"]) for r in many.collect()} == {("p", "r", 204), ("p", "r", 205), ("p", "s", 205)}
    stream = pr._Stream({"base_url": "http://h", "repos": '[["p", "r", 203], ["q", "t", 205]]', "fetch": "tests.test_index.fake_fetch"})
    rows, end = stream.read(stream.initialOffset())
    assert [r[2] for r in rows] == [204, 205] and list(end.values()) == [205, 205] and len(list(stream.readBetweenOffsets(stream.initialOffset(), end))) == 2


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "src" / "p" / "r"
    root.mkdir(parents=True)
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (root / "a.py").write_text("def alpha():\n    return 1\n")
    (root / "b.py").write_text("def beta():\n    return 2\n" * 3)
    (root / "c.py").write_text("def gamma():\n    return 3\n")
    run("add", ".")
    run("commit", "-qm", "1")
    first = git.head_commit(root)
    (root / "a.py").write_text("def alpha2():\n    return 1\n")
    (root / "c.py").unlink()
    run("mv", "b.py", "d.py")
    run("add", "-A")
    run("commit", "-qm", "2")
    return root, first


def test_git(repo, spark):
    root, first = repo
    assert sorted(git.name_status(root, first, git.head_commit(root))) == [("A", "d.py"), ("D", "b.py"), ("D", "c.py"), ("M", "a.py")]
    repos = spark.createDataFrame([("p", "r")], "project string, name string")
    folder = str(root.parents[1])
    assert {r["path"]: r["commit_hash"] for r in git.commit_map(repos, folder).collect()} == {"a.py": git.head_commit(root), "d.py": git.head_commit(root), "b.py": first, "c.py": git.head_commit(root)}
    live = spark.createDataFrame([("p", "r", "a.py")], "project string, repo string, path string")
    assert [r["path"] for r in git.commit_map(repos, folder, live).collect()] == ["a.py"]
    assert [len(b) for b in git.log_batches(root, 1)][0] >= 1 and sum(len(b) for b in git.log_batches(root)) == 6
    plan = spark.createDataFrame([("p", "r", first, git.head_commit(root))], "project string, repo string, prior string, head string")
    assert {(r["status"], r["path"]) for r in git.changed_paths(plan, folder).collect()} == {("A", "d.py"), ("D", "b.py"), ("D", "c.py"), ("M", "a.py")}
    assert git.repo_url("http://h/", "a b", "c") == "http://h/a%20b/_git/c"


def test_sync(repo, tmp_path, spark):
    root, _ = repo
    target = str(tmp_path / "clone")
    assert git.sync_repo(str(root), target) == git.head_commit(root) == git.sync_repo(str(root), target, "main")


def test_index_run(repo, tmp_path, spark):
    root, first = repo
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(IndexNotReady):
        store.read("chunks")
    assert indexing.gate(store) is False and indexing.gate(store) is True
    rows = files.read_files(spark, str(root.parents[1]))
    assert {(r["project"], r["repo"], r["path"], r["language"]) for r in rows.collect()} == {("p", "r", "a.py", "py"), ("p", "r", "d.py", "py")}
    log = "project string, repo string, commit_seq bigint, commit_hash string, commit_date string"
    head = git.head_commit(root)
    plan = lambda prior: index_plan(spark.createDataFrame([("p", "r", 1, first, "d"), ("p", "r", 2, head, "d")], log), spark.createDataFrame(prior, "project string, repo string, commit_hash string, indexed_at string"))
    none = spark.createDataFrame([], "project string, repo string, path string, status string")
    commits = git.commit_map(spark.createDataFrame([("p", "r")], "project string, name string"), str(root.parents[1]))
    indexing.index_repos(store, plan([]), none, rows, hash_provider, commits)
    assert {r["symbols"] for r in store.read("chunks").collect()} == {"alpha2", "beta"} and store.read("repo_index_state").first()["commit_hash"] == head
    assert {r["commit_hash"] for r in store.read("chunks").collect()} == {head}
    # an incremental run replaces changed paths only
    feed = spark.createDataFrame([("p", "r", s, p) for s, p in git.name_status(root, first, head)], "project string, repo string, status string, path string")
    indexing.index_repos(store, plan([("p", "r", first, "2024-01-01T00:00:00Z")]), feed, rows, hash_provider)
    assert {r["path"] for r in store.read("chunks").collect()} == {"a.py", "d.py"}
    # pull requests: cursor moves after the data, a second run adds nothing, a full run of code keeps them
    prs = spark.createDataFrame([("p", "r", 1, "fix alpha", "", "d", [3])], pr.SCHEMA)
    indexing.index_pull_requests(store, prs, hash_provider)
    indexing.index_pull_requests(store, prs, hash_provider)
    indexing.index_repos(store, plan([]), none, rows, hash_provider)
    assert store.read("chunks").where("content_type = 'pr'").count() == 1 and store.read("pr_state").first()["last_pr_id"] == 1
    api = Api(store, hash_provider)
    assert api.search("alpha2").first()["path"] == "a.py" and api.definitions("beta").count() == 1
    assert api.file("p", "r", "a.py").first()["text"].startswith("def alpha2") and api.repositories().count() == 2 and api.duplicates().count() == 0
    assert Tools(store, hash_provider).find_definition("alpha2").count() == 1
    store.apply(paths=spark.createDataFrame([("p", "r", "a.py")], "project string, repo string, path string"))
    assert {r["path"] for r in store.read("chunks", ["code"]).collect()} == {"d.py"}
    indexing.removed_repos(store, spark.createDataFrame([("p", "other", None)], config.REPO_SCHEMA))
    assert store.read("chunks").count() == 0


def chunk(spark, *rows):
    cols = ["id", "project", "repo", "path", "language", "content_type", "text"]
    df = spark.createDataFrame([(*r, "py", "code", "x = 1") for r in rows], ", ".join(f"{c} string" for c in cols))
    for f in schema.CHUNKS:
        if f.name not in cols:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df


def test_store_is_atomic(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.ensure()
    store.upsert(chunk(spark, *[(f"i{k}", "p", "r", f"f{k}.py") for k in range(40)]))
    before = store.state()
    # one file: only its partition is written
    store.replace_paths(spark.createDataFrame([("p", "r", "f1.py")], "project string, repo string, path string"), chunk(spark, ("new", "p", "r", "f1.py")))
    now = store.state()
    assert sum(v != before["tables"]["chunks"].get(k) for k, v in now["tables"]["chunks"].items()) == 1
    assert {r["id"] for r in store.read("chunks").collect()} == {f"i{k}" for k in range(40) if k != 1} | {"new"}
    # death between the data and the manifest, and half a manifest
    with monkeypatch.context() as m:
        m.setattr(Store, "_put", lambda *a: (_ for _ in ()).throw(OSError("dies here")))
        with pytest.raises(OSError):
            store.upsert(chunk(spark, ("lost", "p", "r", "f2.py")))
    assert store.state() == now and store.read("chunks").count() == 40
    assert store._put(store._numbers()[-1] + 1, "{broken") and store.state() == now
    store.upsert(chunk(spark, ("kept", "p", "r", "f2.py")))
    assert store.read("chunks").count() == 41
    # two writers: other partitions go together, the same one does not
    base = store.state()
    other, same = next(k for k in base["tables"]["chunks"]), "code-0-0x"
    store.commit(base, {"chunks": {same: "v1"}})
    store.commit(base, {"pr_state": {"all": "v2"}})
    assert store.state()["tables"]["chunks"][same] == "v1"
    store.commit(store.state(), {"chunks": {same: None, other: "v3"}})
    with pytest.raises(ConcurrentChange):
        store.commit(base, {"chunks": {other: "v4"}})


def test_dimension_is_checked_on_writing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.ensure()
    vec = lambda n: F.array(*[F.lit(1.0).cast("float")] * n)
    store.upsert(chunk(spark, ("a", "p", "r", "a.py")).withColumn("embedding", vec(3)))
    with pytest.raises(ValueError):
        store.upsert(chunk(spark, ("b", "p", "r", "b.py")).withColumn("embedding", vec(4)))
    assert store.read("chunks").count() == 1


def test_killed_runs_skip_and_repeat_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    log = spark.createDataFrame([("p", "r", k, f"c{k}") for k in range(1, 9)], "project string, repo string, commit_seq bigint, commit_hash string")
    t = lambda h: datetime(2024 if h < 4 else 2100, 1, 1, h)  # noqa: E731  # before and after the runs
    feed = lambda *rows: spark.createDataFrame([(i, "p", "r", c, "M", path, at) for i, c, path, at in rows], "change_id bigint, project string, repo string, commit_hash string, status string, path string, received_at timestamp")
    text = lambda *paths: spark.createDataFrame([("p", "r", x, "py", "code", 9, f"def {x[0]}():\n    return 1\n") for x in paths], "project string, repo string, path string, language string, content_type string, file_size_bytes bigint, text string")
    first = [(1, "c1", "a.py", t(1)), (2, "c3", "b.py", t(2)), (3, "C3", "b.py", t(3))]

    def dying():
        raise RuntimeError("provider is down")

    with pytest.raises(Exception, match="down"):
        indexing.run_changes(store, "one", feed(*first), log, text("a.py", "b.py"), dying)
    assert store.read("chunks").count() == 0 and store.read("processed").count() == 0
    with monkeypatch.context() as m:  # dies after its data is written, before the commit
        real = Store._put
        m.setattr(Store, "_put", lambda self, n, text: real(self, n, text) if '"processed": {}' in text else (_ for _ in ()).throw(OSError("dies here")))
        with pytest.raises(OSError):
            indexing.run_changes(store, "two", feed(*first), log, text("a.py", "b.py"), hash_provider)
    assert store.read("chunks").count() == 0 and store.read("processed").count() == 0
    assert indexing.run_changes(store, "three", feed(*first), log, text("a.py", "b.py"), hash_provider) == 2
    assert indexing.run_changes(store, "four", feed(*first), log, text("a.py", "b.py"), hash_provider) == 0
    # a late change below the state, delivered twice, and a new one
    late = [*first, (4, "c2", "c.py", t(5)), (5, "c2", "c.py", t(6)), (6, "c5", "a.py", t(5))]
    assert store.read("repo_index_state").first()["commit_hash"] == "c3"
    assert indexing.run_changes(store, "five", feed(*late[:4]), log, text("a.py", "b.py", "c.py"), hash_provider) == 1
    assert store.read("repo_index_state").first()["commit_hash"] == "c3"
    for run in ("one", "two"):
        indexing.abandon_run(store, run)
    assert indexing.run_changes(store, "six", feed(*late), log, text("a.py", "b.py", "c.py"), hash_provider) == 1
    assert store.read("repo_index_state").first()["commit_hash"] == "c5"
    pairs = [(r["commit_hash"], r["path"]) for r in store.read("processed").collect()]
    assert sorted(pairs) == [("c1", "a.py"), ("c2", "c.py"), ("c3", "b.py"), ("c5", "a.py")] and store.read("chunks").count() == 3
    monkeypatch.setattr(Store, "LEDGER_PARTS", 2)
    assert indexing.run_changes(store, "seven", feed(*late, (7, "c7", "b.py", t(8))), log, text("a.py", "b.py"), hash_provider) == 1
    assert store.read("processed").count() == 5 and len(store.state()["tables"]["processed"]) == 1


def test_whole_run(repo, tmp_path, spark):
    """From the configuration to the index: a failing repository is reported, a second run skips, a third is incremental."""
    root, _ = repo
    (tmp_path / "host" / "p").mkdir(parents=True)
    (tmp_path / "host" / "p" / "_git").symlink_to(root.parent)
    host = str(tmp_path / "host")
    store, folder = Store(spark, str(tmp_path / "store")), str(tmp_path / "checkouts")
    config = {"repos": {"p": ["r", "missing"]}, "azure_devops": {"index_pull_requests": True}}
    go = lambda: run.run_index(store, config, host, folder, hash_provider, pull_requests={"fetch": "tests.test_index.fake_fetch"})
    steps = []
    report = run.run_index(store, config, host, folder, hash_provider, progress=lambda r: steps.append(r.files), pull_requests={"fetch": "tests.test_index.fake_fetch"})
    assert report.actions == {"full": 1} and [x[:2] for x in report.failed] == [("p", "missing")] and report.files == 2 and report.bytes > 0 and steps == [0, 0, 2, 2]
    assert store.read("chunks", ["code"]).count() == 2 and store.read("chunks", ["pr"]).count() == 205 and store.read("pr_state").first()["last_pr_id"] == 205
    assert {r["commit_hash"] for r in store.read("chunks", ["code"]).collect()} == {git.head_commit(root)}
    assert go().actions == {"skip": 1}
    (root / "a.py").write_text("def alpha3():\n    return 1\n")
    subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e", "commit", "-qam", "3"], check=True)
    assert go().actions == {"incremental": 1}
    assert {r["symbols"] for r in store.read("chunks", ["code"]).collect()} == {"alpha3", "beta"} and store.read("chunks").count() == 207
    api = Api(store, hash_provider)
    assert api.total() == 207 and {r["language"] for r in api.languages().collect()} == {"py", "md"}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("p", "r", 4, "a", "b", "d", [1])], pr.SCHEMA).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):  # a second start finds nothing new
        stream = spark.readStream.schema(pr.SCHEMA).parquet(str(tmp_path / "in"))
        pull_request_stream.start(stream, store, hash_provider, str(tmp_path / "cp")).awaitTermination()
    assert store.read("chunks").count() == 1 and store.read("pr_state").first()["last_pr_id"] == 4


def test_documents_without_a_path_are_chunked(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(600))
    data = [(1, words, "s", "wiki", None), (2, "def f():\n    return 1", None, "code", "a/b.py"), (3, "short", "s", None, None), (4, None, "s", "wiki", None), (5, "", "s", "wiki", None)]
    spark.createDataFrame(data, "doc_id bigint, text string, source string, kind string, path string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.document_chunks(spark, str(tmp_path)).collect()
    assert {(r["path"], r["language"]) for r in got} == {("1/", ""), ("2/a/b.py", "py"), ("3/", "")}
    assert len({r["id"] for r in got}) == len(got) and set(words.split()) <= set(" ".join(r["text"] for r in got if r["path"] == "1/").split())
