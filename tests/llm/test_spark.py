"""Operators on small tables with nulls, repeated rows, clashing columns, ties and empty tables."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import canonical, markup, neardup, notwritten, packing, queries, secrets, sentences, similar, sums, tokenize

CH = "id string, project string, repo string, path string, language string, content_type string, text string, embedding array<float>, count int, key string, n int, sig string"


def rows(spark, data):
    base = dict(project="p", repo="r", path="a.py", language="py", content_type="code", text=None, embedding=None, count=1, key="k", n=None, sig="s")
    names = [c.split()[0] for c in CH.split(", ")]
    return spark.createDataFrame([tuple((base | d)[c] for c in names) for d in data], CH)


def test_copies(spark):
    data = [dict(id=i, text=t, language=x) for i, t, x in (("c", "Foo, bar!", "py"), ("a", "foo\nBAR", None), ("a", "foo\nBAR", None), ("b", "a: 1\nb: 2\n--", "yml"), ("d", "B 2\n\nA: 1", "env"), ("e", "a: 1 b: 2", "md"), ("f", None, "py"), ("g", "!!", "py"), ("h", " ", "py"), (None, "foobar", "py"))]
    c = rows(spark, data)
    assert sorted(map(tuple, canonical.copies(c).collect())) == [("a", "c"), ("b", "d"), ("g", "h")]
    assert {tuple(r) for r in canonical.copy_counts(c).collect()} == {("a", 2), ("b", 2), ("e", 1), ("g", 2)}
    assert canonical.copies(c.limit(0)).count() == 0


def test_tries_sum_partial_counts(spark):
    data = spark.range(0, 900, 1, 6).selectExpr("lpad(cast(id as string), 4, '0') as id", "cast(concat('key', id % 7) as binary) as canon")
    parts = canonical.partial_counts(data)
    assert parts.count() == 42 and parts.agg(F.sum("n")).first()[0] == 900
    want = {hashlib.sha256(f"key{i}".encode()).digest(): (len(range(i, 900, 7)), f"{i:04d}") for i in range(7)}
    # also where every bucket is too large, so that single keys are salted
    for limits in ({}, {"limit": 3}, {"limit": 1, "first": 1}):
        assert {bytes(r["key"]): (r["n"], r["least"]) for r in canonical.key_counts(data.union(data), **limits).collect()} == want


def test_radix_splits_to_the_limit(spark):
    """Keys that agree in their first hundreds of bytes are split by bytes behind these; the limit is the same at any size."""
    for front in (14, 700):
        texts = [("c" * front + f"{i:04d}" + "z" * (i % 5)).encode() for i in range(600)] + [b"", b"c", b"d"]
        keys = spark.createDataFrame([(bytearray(x), 1, "i") for x in texts], "canon binary, n long, least string")
        for limits in ({"limit": 50}, {"limit": 1000, "limit_bytes": 20_000}):
            got = canonical.radix_buckets(keys, **limits).groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.length("canon")).alias("b")).collect()
            assert sum(r["n"] for r in got) == 603 and max(r["n"] for r in got) <= limits["limit"] and max(r["b"] for r in got) <= limits.get("limit_bytes", 1 << 30)


def test_near_duplicates(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    edit = words[:15] + ["sechzehn"]
    data = [("a", " ".join(words)), ("b", " ".join(edit)), ("b", " ".join(edit)), ("c", " ".join(words).upper()), ("d", "x " + " ".join(words)), ("e", "one two"), ("f", None), ("g", "nothing in common with any other record of this table at all")]
    c = rows(spark, [dict(id=i, text=t) for i, t in data]).where("text is not null").withColumn("canon", canonical.canonical_key(F.col("text"), F.col("language")))
    got = set(map(tuple, neardup.near_duplicate_rows(c, 3, 7).collect()))

    def shing(t):
        w = re.findall("[a-z0-9_]+", t.lower())
        return set(zip(w, w[1:], w[2:]))

    texts = {i: t for i, t in data if t}
    plain = lambda t: re.sub(r"[\W_]", "", t.lower())
    want = {(x, y) for x in texts for y in texts if x < y and shing(texts[x]) and shing(texts[y]) and 10 * len(shing(texts[x]) & shing(texts[y])) >= 7 * len(shing(texts[x]) | shing(texts[y])) and plain(texts[x]) != plain(texts[y])}
    assert got == want and ("a", "c") not in got
    groups = {r["id"]: (r["group_id"], r["group_size"]) for r in neardup.near_duplicate_groups(c, 3, 7).collect()}
    assert set(groups) == {"a", "b", "c", "d"} and set(groups.values()) == {("a", 4)}
    assert neardup.near_duplicate_rows(c.limit(0), 3, 7).count() == 0


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 3)
    base = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20"
    c = rows(spark, [dict(id=f"{i:02d}", text=base + f" tail{i}") for i in range(12)]).withColumn("canon", canonical.canonical_key(F.col("text")))
    assert neardup.near_duplicate_rows(c, 3, 7).count() == 66


def test_near_duplicates_beyond_the_sketch(spark, monkeypatch):
    """Exact counts instead of the sketch, no filter, and deeper summing trees give the same pairs."""
    c = spark.read.parquet("/root/testdata/sf0.001/chunks.parquet").where("text is not null").withColumn("canon", canonical.canonical_key(F.col("text"), F.col("language")))
    pairs = lambda **o: {tuple(sorted(r)) for r in neardup.similar_classes(c.repartition(7), 3, 7, **o)[1].collect()}
    want = pairs()
    assert want and pairs(sketch_bits=1, filter_bits=1) == want
    monkeypatch.setattr(sums, "FAN_IN", 2)
    assert pairs(sketch_bits=12, filter_bits=13) == want


def stored(monkeypatch, module):
    """The tables that MODULE saves from now on, by name."""
    found, save = {}, module.saved

    def keep(df, what="part"):
        found[what] = out = save(df, what)
        return out

    monkeypatch.setattr(module, "saved", keep)
    return found


def test_only_the_rarest_shingles_travel_in_large_collections(spark, monkeypatch):
    """Also where the counts are of a share of the records in few cells, with the same pairs."""
    c = spark.read.parquet("/root/testdata/sf0.001/chunks.parquet").where("text is not null").withColumn("canon", canonical.canonical_key(F.col("text"), F.col("language")))
    pairs = lambda **o: {tuple(sorted(r)) for r in neardup.similar_classes(c, 3, 7, **o)[1].collect()}
    want = pairs()
    found = stored(monkeypatch, neardup)
    monkeypatch.setattr(neardup, "LOAD", 64)
    assert want and pairs(sketch_bits=7) == want
    sizes = found["classes"].agg(F.max(F.size("rare") - (F.col("n") - F.ceil(0.7 * F.col("n")))).alias("over"), F.sum(F.size("rare")).alias("rare")).first()
    assert sizes["over"] <= neardup.NEED and sizes["rare"] > 0 and "rarest" not in found


def test_one_of_two_classes_looks_into_the_others_group(spark, monkeypatch):
    found = stored(monkeypatch, neardup)
    base = " ".join(f"w{i}" for i in range(30))
    c = rows(spark, [dict(id=f"{i}", text=f"{base} tail{i}") for i in range(2)]).withColumn("canon", canonical.canonical_key(F.col("text")))
    assert list(map(tuple, neardup.near_duplicate_rows(c, 3, 7).collect())) == [("0", "1")]
    assert found["opened"].count() == 1


def test_only_members_below_a_class_travel_to_its_group(spark, monkeypatch):
    """And only rows of classes with a pair, or with rows that are no copies of each other, travel to be paired."""
    found = stored(monkeypatch, neardup)
    base = " ".join(f"w{i}" for i in range(30))
    data = [dict(id="0", text=f"{base} tail0"), dict(id="1", text=f"{base} tail1")] + [dict(id=f"x{i}", text=" ".join(f"v{i}x{j}" for j in range(9))) for i in range(50)]
    data += [dict(id=f"y{i}", text=f"same words in {x} these rows of the table", language=x) for i, x in enumerate(["ini", "ini"])] + [dict(id="z0", text="a b c d e é"), dict(id="z1", text="a b c d e")]
    c = rows(spark, data).withColumn("canon", canonical.canonical_key(F.col("text"), F.col("language")))
    assert sorted(map(tuple, neardup.near_duplicate_rows(c, 3, 7).collect())) == [("0", "1"), ("z0", "z1")]
    assert found["wanted"].count() == 1 and {"0", "1", "z0", "z1"} <= {r["id"] for r in found["members"].collect()} and found["members"].count() < 12


@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.int32])
def test_sums_travel_small(kind):
    rng = np.random.default_rng(1)
    cells = np.minimum(rng.geometric(0.7, 1 << 16) * (rng.random(1 << 16) < 0.2), 200).astype(kind)
    cells[:3] = np.iinfo(kind).max
    for x in (cells, np.zeros(64, kind), np.ones(5, kind), np.full(9, 7, kind)):
        assert (sums.unpacked(sums.packed(x), len(x), kind) == x).all()
    assert len(sums.packed(cells)) < 0.2 * len(cells)  # twice that by zlib alone at 2 bytes a number


def test_similar(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 96))
    x = (np.repeat(centre, 12, 0) + rng.normal(size=(144, 96)) * 0.15).astype(np.float32)
    x[5] = x[3]
    data = [dict(id=f"{i:03d}", embedding=[float(v) for v in x[i]]) for i in range(144)]
    bad = [dict(id="n1", embedding=None), dict(id="n2", embedding=[1.0] * 4), dict(id="n3", embedding=[0.0] * 96), dict(id="n4", embedding=[float("nan")] + [1.0] * 95), data[7]]
    got = set(map(tuple, similar.similar_pairs(rows(spark, data + bad)).collect()))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (u @ u.T).astype(float)
    np.fill_diagonal(s, -2)
    want = {tuple(sorted((f"{i:03d}", f"{j:03d}"))) for i in range(144) for j in sorted(range(144), key=lambda j: (-round(s[i, j], 6), j))[:5]}
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95 and ("003", "005") in got
    assert similar.similar_pairs(rows(spark, bad[:4])).count() == 0


def test_similar_beyond_the_largest_k(spark, monkeypatch):
    """With long lists, blocks of both halves and dense blocks split over salts, recall stays."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 96)).astype(np.float32)
    data = rows(spark, [dict(id=f"{i:03d}", embedding=[float(v) for v in x[i]]) for i in range(900)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {tuple(sorted((f"{i:03d}", f"{j:03d}"))) for i in range(900) for j in np.argsort(-s[i])[:5]}
    monkeypatch.setattr(similar, "ROWS_A_BLOCK", 100)
    monkeypatch.setattr(similar, "LARGEST_K", 4)  # 56 vectors a list, 9 blocks on 4 x 3 groups of centroids
    for block_rows in (65_536, 20):
        monkeypatch.setattr(similar, "BLOCK_ROWS", block_rows)
        monkeypatch.setattr(similar, "BLOCK_QUERIES", 16 * block_rows)
        got = set(map(tuple, similar.similar_pairs(data).collect()))
        assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)


def test_equal_vectors_take_the_smallest_ids(spark):
    one = [1.0] * 96
    data = [dict(id=f"{i:02d}", embedding=one) for i in range(30)] + [dict(id="zz", embedding=[1.0] * 95 + [2.0])]
    got = set(map(tuple, similar.similar_pairs(rows(spark, data)).collect()))
    assert {(a, b) for a, b in got if b != "zz"} == {(f"{i:02d}", f"{j:02d}") for j in range(30) for i in range(6) if i < j and (i < 5 or j <= 5)}


def shuffled(spark, run):
    """Bytes that RUN writes to shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._jvm.java.util.ArrayList()
    quantiles = sc._gateway.new_array(sc._jvm.double, 0)
    total = lambda: sum(x.shuffleWriteBytes() for x in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(none, False, False, quantiles, none)))
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = total()
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


def test_similar_shuffles_vectors_once_a_block(spark):
    """In one block no query brings its vector, no vector is shuffled to find that it is the only one of its kind, and names
    are shuffled only to be joined: two kilobytes a vector before."""
    x = np.random.default_rng(3).normal(size=(2000, 96)).astype(np.float32)
    data = spark.createDataFrame([(hashlib.sha1(b"%d" % i).hexdigest(), [float(v) for v in x[i]]) for i in range(2000)], "id string, embedding array<float>").cache()
    data.count()
    sample = 4 * 96 * 2000
    assert shuffled(spark, lambda: similar.similar_pairs(data).count()) - sample < 1200 * 2000


def test_centroids_met_together_share_a_block():
    rng = np.random.default_rng(2)
    groups = np.arange(60) % 5
    met = [set(rng.choice(np.flatnonzero(groups == g), 4, False).tolist()) for g in rng.integers(0, 5, 600)]
    start = rng.permutation(np.repeat(np.arange(5), 12)).astype(np.int32)
    touched = lambda b: np.mean([len({int(b[c]) for c in mine}) for mine in met])
    got = similar.gathered(start, met, np.ones(60))
    assert touched(got) < 0.7 * touched(start) and np.bincount(got, minlength=5).max() <= 15


def test_similar_names_copies_ties_and_ids_of_several_vectors(spark, monkeypatch):
    """Against a count over all pairs, with sets broadcast or joined."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(20, 96))
    x = (np.repeat(centre, 6, 0) + rng.normal(size=(120, 96)) * 0.2).astype(np.float32)
    x[40:48] = x[40]
    x[61] = x[60]
    data = [dict(id=f"{i:03d}", embedding=[float(v) for v in x[i]]) for i in range(120)]
    data += [dict(id="100", embedding=[float(v) for v in x[3]]), data[7], data[7]]
    members = sorted({(d["id"], tuple(d["embedding"])) for d in data})
    u = np.array([m[1] for m in members])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 5)
    want = {tuple(sorted((members[i][0], members[j][0]))) for i in range(len(members)) for j in sorted((j for j in range(len(members)) if members[j][1] != members[i][1] or members[j][0] != members[i][0]), key=lambda j: (-s[i, j], members[j][0]))[:5]}
    for few in (similar.FEW, 0):
        monkeypatch.setattr(similar, "FEW", few)
        got = list(map(tuple, similar.similar_pairs(rows(spark, data)).collect()))
        assert len(got) == len(set(got)) and set(got) == want


def test_not_hand_written(spark):
    letters = "kqzbxwvjyfghpmdnlrst"
    lib = "\n".join(f"def function_named_{c}(argument_{c}):" for c in letters)
    own = "\n".join(f"result_of_step_{c} = compute_step(value_{c})" for c in letters)
    data = [
        dict(id="1", path="third_party/lib/a.py", text=lib), dict(id="2", repo="s", path="src/a.py", text=lib.upper() + "\nedited_line_here = 1"), dict(id="3", repo="t", path="own.py", text=own),
        dict(id="4", repo="t", path="pasted.py", text=own + "\n" + "\n".join(lib.splitlines()[:5])), dict(id="5", path="g.py", text="# @generated by t from x.idl\nx"), dict(id="6", path=None, text="x"), dict(id="7", path="n.py", text=None), dict(id="8", path="w.md", content_type="wiki", text="# generated by x"),
        dict(id="9", repo="first", path="m.py", text=own.replace("step", "part")), dict(id="91", repo="t", path="extlib/first/m.py", text=own.replace("step", "part")),
    ]
    got = {(r["repo"], r["path"]) for r in notwritten.not_hand_written(rows(spark, data)).collect()}
    assert got == {("r", "third_party/lib/a.py"), ("s", "src/a.py"), ("r", "g.py"), ("t", "extlib/first/m.py")}
    assert notwritten.not_hand_written(rows(spark, data).limit(0)).count() == 0


def test_a_library_copied_under_many_names(spark):
    letters = "kqzbxwvjyfghpmdnlrst"
    lib = "\n".join(f"def function_named_{c}(argument_{c}):" for c in letters)
    usual = [f"import usual_module_{c}" for c in letters[:6]]
    data = [dict(id="seed", repo="r0", path="third_party/lib/a.py", text=lib + "\n" + "\n".join(usual))]
    data += [dict(id=f"c{i}", repo=f"r{i + 1}", path=f"src/name{i}.py", text=lib.upper() + "\nedited_line_here = 1") for i in range(12)]
    # six lines of the library are usual ones: no copy, though most lines of the short file agree
    data += [dict(id=f"u{i}", repo="own", path=f"u{i}.py", text="\n".join(usual + [f"own_statement_{c}_{'xyzvwabcdefg'[i]} = 1" for c in letters])) for i in range(12)]
    data += [dict(id="short", repo="own", path="short.py", text="\n".join([*usual, "short_statement_one = 1", "short_statement_two = 1"]))]
    # a library kept under many names of dependency folders has no rare line at all
    kept = lib.replace("function", "procedure")
    data += [dict(id=f"k{i}", repo=f"k{i}", path=f"vendor/kept{'abcdefghijkl'[i]}/k.py", text=kept) for i in range(12)] + [dict(id="kc", repo="r1", path="lib/k.py", text=kept)]
    got = {(r["repo"], r["path"]) for r in notwritten.not_hand_written(rows(spark, data)).collect()}
    assert got == {("r0", "third_party/lib/a.py"), ("r1", "lib/k.py")} | {(f"r{i + 1}", f"src/name{i}.py") for i in range(12)} | {(f"k{i}", f"vendor/kept{'abcdefghijkl'[i]}/k.py") for i in range(12)}


def test_elements_and_secrets(spark):
    c = rows(spark, [dict(id="1", content_type="wiki", language="md", text="# A"), dict(id="1", content_type="wiki", language="md", text="# A"), dict(id="2", content_type="pr", text=None), dict(id="3", text='password = "Maple5310"\nx = 1'), dict(id="4", text=None), dict(id="5", content_type=None, text="# B")])
    assert list(map(tuple, markup.elements(c).collect())) == [("1", "heading", "A")]
    assert sorted((r["id"], r["clean"]) for r in markup.clean_texts(c).collect()) == [("1", "# A"), ("2", None)]
    assert [(r["id"], r["secret"], r["redacted"]) for r in secrets.found_secrets(c).collect()] == [("3", "Maple5310", 'password = "*********"\nx = 1')]
    assert secrets.found_secrets(c.limit(0)).count() == 0


def docs(spark, data):
    return spark.createDataFrame(data, "doc_id bigint, text string, kind string, ids string, tokens string")


def test_tokens_and_packing(spark):
    d = docs(spark, [(1, "Hello world", "wiki", "x", "y"), (2, "", "wiki", None, None), (3, None, "wiki", None, None), (4, "a b " * 900, "wiki", None, None)])
    got = {r["doc_id"]: r["ids"] for r in tokenize.token_ids(d).collect()}
    assert got[2] == [] and got[3] is None and len(got[1]) == 2
    sizes = tokenize.token_counts(d).withColumnRenamed("doc_id", "item")
    budgets = spark.createDataFrame([(1, 512, "x"), (2, 1024, "y")], "budget_id int, capacity_tokens int, purpose string")
    out = packing.pack(sizes, budgets).collect()
    for b, cap in ((1, 512), (2, 1024)):
        mine = [r for r in out if r["budget_id"] == b]
        fill = {}
        for r in mine:
            if r["container_id"]:
                fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["tokens"]
        assert max(fill.values()) <= cap and sum(fill.values()) == len(got[1]) + len(got[4]) and len(fill) == -(-sum(fill.values()) // cap)
        assert {r["item"] for r in mine if r["container_id"] is None} == {2, 3}
    assert packing.pack(sizes.limit(0), budgets).count() == 0


def test_packing_over_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_A_PART", 400)
    items = spark.range(3000).selectExpr("id as item", "cast(1 + (id * 37) % 90 as int) as tokens")
    budgets = spark.createDataFrame([(1, 100)], "budget_id int, capacity_tokens int")
    out = packing.pack(items, budgets).groupBy("container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).toPandas()
    whole = packing.best_fit([1 + (i * 37) % 90 for i in range(3000)], 100)
    assert out["n"].sum() == 3000 and out["t"].max() <= 100 and len(out) <= 1.03 * len(whole)


@pytest.mark.parametrize("sizes", ["cast(1 + (id * 37) % 90 as int)", "cast(51 + (id * 7) % 30 as int)", "cast(if(id % 50 = 0, 20, 60 + (id * 3) % 25) as int)"])
def test_handing_on_few_bins_loses_nothing(spark, monkeypatch, sizes):
    """The same number of containers as when every underfull bin goes up, also where hardly any two fit together."""
    monkeypatch.setattr(packing, "ITEMS_A_PART", 60)
    items = spark.range(4000).selectExpr("id as item", f"{sizes} as tokens")
    budgets = spark.createDataFrame([(1, 100)], "budget_id int, capacity_tokens int")
    few = packing.pack(items, budgets).groupBy("container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).toPandas()
    assert few["n"].sum() == 4000 and few["t"].max() <= 100
    monkeypatch.setattr(packing, "handed_on", lambda bins, capacity: [True] * len(bins))
    every = packing.pack(items, budgets).select("container_id").distinct().count()
    assert len(few) == every


def test_sentence_positions(spark):
    d = docs(spark, [(1, "  The one is on. The two is off.\n", "wiki", None, None), (2, None, "wiki", None, None), (3, "", "pr", None, None), (4, "The x. The y.", "code", None, None), (5, "The x.", None, None, None), (5, "The x.", None, None, None)])
    got = sorted(map(tuple, sentences.sentences(d).collect()))
    assert got == [(1, 3, 16), (1, 18, 32), (5, 1, 6)]
    assert sentences.sentences(d.limit(0)).count() == 0


def test_learned_types_joined_or_broadcast(spark):
    """Without a broadcast model the join gives the same sentences."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, two = (set(map(tuple, sentences.sentences(d, most).collect())) for most in (sentences.MODEL_ROWS, 0))
    assert one == two and len(one) > 5000


def test_languages_are_learned_from_labels(spark):
    """Languages nobody listed are told apart, though labels are spelt in several ways and some are wrong."""
    text = {"it": "il gatto che dorme sulla sedia non vede la porta della casa e poi esce", "nl": "de kat die op de stoel slaapt ziet het huis niet en gaat dan naar buiten", "pt": "o gato que dorme na cadeira não vê a porta da casa e depois sai para a rua", "en": "the cat that sleeps on the chair does not see the door of the house and goes out"}
    data = [(k, " ".join(w for j, w in enumerate(t.split()) if (j + i) % 5), [x, x.upper(), f"{x}-XX", "en", None, "und"][min(i, 5) if i > 24 else i % 3]) for k, (x, t) in enumerate(text.items()) for i in range(30)]
    known = sentences.learn_languages(spark.createDataFrame(data, "doc_id int, text string, lang string"))
    assert set(known.names) == set(text) and all(sentences.language(t, known) == x for x, t in text.items())
    assert sentences.language("кошка спит на стуле и не видит дома", known) == "ru"
    assert sentences.learn_languages(spark.createDataFrame([(1, "x")], "doc_id int, text string")).names == []


def test_every_query_gives_distinct_rows(spark):
    for name, f in queries.queries().items():
        df = f(spark, "/root/testdata/sf0.001")
        pdf = df.toPandas().astype(str)
        assert len(pdf) == len(pdf.drop_duplicates()), name
    assert set(queries.oracle_sql()) <= set(queries.queries())
