import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import like_pattern
from corpusloom.operators import reports, search

SCHEMA = "id string, project string, repo string, path string, language string, content_type string, start_line int, end_line int, file_size_bytes bigint, chunk_tokens_estimate int, commit_hash string, commit_date string, content_hash string, symbols string, text string, embedding array<float>"


def chunk(id, text="t", repo="r", path="a.py", start=1, vec=(1.0, 0.0), symbols="", project="p", kind="code", language="py"):
    return (id, project, repo, path, language, kind, start, start, 1, 1, "h", "d", None, symbols, text, None if vec is None else [float(v) for v in vec])


def test_terms(spark):
    assert search.query_terms("Foo foo FOO bar x") == ["Foo", "bar"]
    assert search.query_terms(" . ") == [] and search.query_terms(None) == []
    assert len(search.query_terms(" ".join(f"w{i}" for i in range(30)))) == 16
    got = spark.createDataFrame([("Foo foo FOO bar x",)], "q string").select(search.query_terms_column(F.col("q"))).first()[0]
    assert got == ["foo", "bar"]


def test_path_filter(spark):
    assert like_pattern("tests\\unit_x%") == "%tests/unit\\_x\\%%"
    rows = spark.createDataFrame([("tests\\Unit_x%y",), ("tests/unitax",), (None,)], "path string")
    assert [r[0] for r in rows.where(search.filters(path_contains="tests/unit_X%")).collect()] == ["tests\\Unit_x%y"]
    assert rows.where(search.filters(repo="", language=None)).count() == 3


def legs(spark, v, x):
    as_df = lambda ids: spark.createDataFrame([(i, 1.0 - k / 100) for k, i in enumerate(ids)], "id string, score double")
    return as_df(v), as_df(x)


def test_fusion_prefers_agreement(spark):
    rows = {r["id"]: r for r in search.fuse(*legs(spark, ["a", "b", "c"], ["d", "e", "c"])).collect()}
    assert rows["c"]["rrf"] == pytest.approx(2 / 62) and rows["a"]["rrf"] == pytest.approx(1 / 60) and rows["c"]["matched_by"] == "both" and rows["d"]["score"] is None
    assert max(rows.values(), key=lambda r: r["rrf"])["id"] == "c"


def model(v, x, texts, top_k, min_score):
    """Sequential form of fusion and collapse."""
    rrf, score = {}, {}
    for k, i in enumerate(v):
        rrf[i], score[i] = rrf.get(i, 0) + 1 / (60 + k), 1.0 - k / 100
    for k, i in enumerate(x):
        rrf[i] = rrf.get(i, 0) + 1 / (60 + k)
    kept, by = [], {}
    for i in sorted(rrf, key=lambda i: (-rrf[i], i)):
        if min_score is not None and i not in x and score[i] < min_score:
            continue
        key = texts[i].lower().replace(" ", "")
        if key in by:
            if len(by[key][1]) < 5:
                by[key][1].append(i)
        elif len(kept) < top_k:
            by[key] = (i, [])
            kept.append(by[key])
    return kept


def test_collapse_equals_sequential_form(spark):
    rng = random.Random(3)
    for _ in range(12):
        ids = [f"i{k:02d}" for k in range(14)]
        texts = {i: rng.choice(["A b", "a B", "ab", "c", "d", "e", "f"]) for i in ids}
        v, x = rng.sample(ids, rng.randint(0, 9)), rng.sample(ids, rng.randint(0, 9))
        top, least = rng.randint(1, 5), rng.choice([None, 0.95])
        chunks = spark.createDataFrame([chunk(i, texts[i], path=i) for i in ids for _ in range(2)], SCHEMA)  # stored twice
        got = search.collapse(search.fuse(*legs(spark, v, x)), chunks, top, least).orderBy("rk").collect()
        assert [(r["id"], [d["path"] for d in r["duplicates"]]) for r in got] == [(k, c) for k, c in model(v, x, texts, top, least)]


def test_search_end_to_end(spark):
    rows = [chunk("a", "retry loop", vec=(1, 0)), chunk("b", "Retry  LOOP", vec=(0.9, 0.1), path="b.py"), chunk("c", "x" * 300, vec=(0, 1)), chunk("z", "retry", vec=(0, 0)), chunk("n", "retry", vec=None)]
    c = spark.createDataFrame(rows, SCHEMA)
    got = search.hybrid_search(c, "retry", [1.0, 0.0], compact=True).orderBy("rk").collect()
    assert got[0]["path"] == "a.py" and [d["path"] for d in got[0]["duplicates"]] == ["b.py"] and len(got[-1]["snippet"]) <= 200
    cut = search.hybrid_search(c, "", [0.0, 1.0], max_chars=100).orderBy("rk").collect()
    assert cut[0]["truncated"] is True and len(cut[0]["text"]) == 100 and cut[1]["truncated"] is None
    assert search.hybrid_search(c.limit(0), "retry", [1.0, 0.0]).count() == 0
    assert search.lexical_leg(c, "!", 5).count() == 0


def test_definitions(spark):
    c = spark.createDataFrame([chunk("a", symbols="Get-Thing get"), chunk("b", symbols="Thing"), chunk("c", symbols=None)], SCHEMA)
    assert [r["symbols"] for r in search.find_definitions(c, "get-thing").collect()] == ["Get-Thing get"]
    assert search.find_definitions(c, "--").count() == 0


def test_clusters(spark):
    long = "x" * 250
    c = spark.createDataFrame([chunk("a", long), chunk("a", long), chunk("b", long.upper(), repo="s", start=4), chunk("c", "short", repo="s"), chunk("d", None), chunk("e", long, repo="s", kind="wiki")], SCHEMA)
    (r,) = reports.duplicate_clusters(c).collect()
    assert (r["occurrence_count"], r["repo_count"], len(r["snippet"])) == (2, 2, 200) and [x["repo"] for x in r["locations"]] == ["r", "s"]
    assert reports.duplicate_clusters(c, min_repos=3).count() == 0


def test_stitching_against_model(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for f in range(25):
        chunks = sorted((rng.randint(1, 20), f"{f}-{k}") for k in range(rng.randint(1, 4)))
        lines: dict[int, str] = {}
        for start, i in chunks:
            body = [f"{i}.{k}" for k in range(rng.randint(1, 6))]
            rows.append(chunk(i, "\n".join(body), path=str(f), start=start))
            for k, line in enumerate(body):
                lines.setdefault(start + k, line)
        want[str(f)] = lines
    c = spark.createDataFrame(rows, SCHEMA)
    for lo, hi in ((None, None), (4, 12), (90, 99)):
        for r in reports.stitched(c, lo, hi).collect():
            lines = want[r["path"]]
            a, b = lo or 1, min(hi or max(lines), max(lines))
            assert r["text"] == "\n".join(lines[n] for n in sorted(lines) if a <= n <= b)
            missing = [n for n in range(a, b + 1) if n not in lines]
            assert [n for g in r["gaps"] for n in range(g["start_line"], g["end_line"] + 1)] == missing
    absent = reports.file_context(c, "p", "r", "none").first()
    assert absent["found"] is False and absent["text"] == ""


def test_inventory(spark):
    c = spark.createDataFrame([chunk("a"), chunk("a"), chunk("b", path="b", start=1), chunk("c", repo="s")], SCHEMA)
    s = spark.createDataFrame([("p", "r", "OLD", "2024-01-01T00:00:00Z"), ("p", "r", "new", "2024-01-01T03:00:00+02:00")], "project string, repo string, commit_hash string, indexed_at string")
    rows = {r["repo"]: r for r in reports.inventory(c, s).collect()}
    assert (rows["r"]["chunks"], rows["r"]["files"], rows["r"]["commit_hash"], rows["r"]["indexed_at"]) == (2, 2, "new", "2024-01-01T01:00:00Z") and rows["s"]["commit_hash"] is None
    assert reports.inventory(c).count() == 2


def test_postings_give_what_scanning_gives(spark):
    """Legs and definitions through the index, under filters; terms in one, several and no chunks; null texts and symbols."""
    rows = [chunk("a", "Foo foo bar_1 x", path="src/a.py", symbols="Foo bar"), chunk("b", "foo", repo="s", path="src/b.py", symbols=None), chunk("c", None, path="c.md", kind="wiki", symbols="foo foo"), chunk("d", "zz bar_1 foo " * 3, path="d", kind="pr")]
    c = spark.createDataFrame(rows, SCHEMA)
    index = search.postings(c)
    for query in ("foo", "FOO bar_1 nothing", "nothing", "x", ""):
        for cond in (None, search.filters(repo="r"), search.filters(path_contains="SRC\\a", content_type="code")):
            got, want = ([tuple(r) for r in leg.orderBy(F.desc("score"), "id").collect()] for leg in (search.indexed_lexical_leg(index, query, 3, cond), search.lexical_leg(c, query, 3, cond)))
            assert got == want
    assert search.indexed_lexical_leg(index, "foo", 3).count() == 3
    for name, n in (("foo", 2), ("bar foo", 1), ("none", 0), ("", 0)):
        got, want = ([r["path"] for r in search.find_definitions(c, name, index=i).collect()] for i in (index, None))
        assert got == want and len(got) == n
