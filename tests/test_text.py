import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import chunking, symbols, text
from corpusloom.functions.embedding import RateLimited, checked_dimension, hash_provider, with_retries


def one(spark, value, expr, name="t"):
    return spark.createDataFrame([(value,)], f"{name} string").select(expr(F.col(name)).alias("x")).first()[0]


def test_hash_ignores_layout_and_case(spark):
    rows = spark.createDataFrame([("Foo  Bar\n",), ("foobar",), ("foo 　bar",), (None,)], "t string").select(text.content_hash(F.col("t"))).collect()
    assert rows[0] == rows[1] == rows[2] and rows[0][0] == hashlib.sha1(b"foobar").hexdigest() and rows[3][0] is None


def test_ids_and_header(spark):
    row = spark.createDataFrame([("p", "r", "a\\b.py")], "p string, r string, x string").select(text.chunk_id(F.col("p"), F.col("r"), F.col("x"), F.lit(3)), text.embed_header(F.col("p"), F.col("r"), F.col("x"))).first()
    assert row[0] == hashlib.sha1(b"p/r/a\\b.py#3").hexdigest() and row[1] == "// p/r/a/b.py\n"


@pytest.mark.parametrize("path,name,skipped", [("a/yarn.lock", True, True), ("x/App.MIN.js", True, True), ("node_modules/a.py", False, True), ("src/a.PNG", False, True), ("vendor", False, False), ("src/build.py", False, False), ("a/Vendor/b.py", False, False), (".gitignore", False, False)])
def test_skipped_paths(spark, path, name, skipped):
    assert one(spark, path, text.filename_is_skipped) is name and one(spark, path, text.path_is_skipped) is skipped


def test_minified(spark):
    assert one(spark, "var a=1;" * 1000, text.is_minified) is True
    assert one(spark, "x" * 500, text.is_minified) is False
    assert one(spark, ("y" * 99 + "\n") * 30, text.is_minified) is False


def test_imports(spark):
    assert one(spark, "using A.B;\nusing C;\n\nusing D;\n", text.is_import_dominated) is True
    assert one(spark, "import a\nfrom b import c\nimport d\nimport e\nimport f\nx = 1", text.is_import_dominated) is True
    assert one(spark, "using var x = y;\nusing var z = y;\nusing var q = y;", text.is_import_dominated) is False
    assert one(spark, "import a\nimport b", text.is_import_dominated) is False
    assert one(spark, "", text.is_import_dominated) is False


def test_lines_as_python_has_them(spark):
    for s in ("a\nb\n", "", "a\r\nb\rc", "a\x0bb c", "\n"):
        assert one(spark, s, text.lines_of) == s.splitlines()


def test_decoding(spark):
    rows = spark.createDataFrame([(bytearray(b"\xef\xbb\xbfa\x00b"),), (bytearray(b"\xff\xfe"),), (bytearray(b"\xef\xbb\xbf"),), (bytearray(b" \n"),)], "c binary").select(text.decoded(F.col("c"))).collect()
    assert [r[0] for r in rows] == ["ab", None, None, None]


SNIPPETS = {
    "py": ("async def a(x):\n  def b(): pass\nclass C: pass\nx = defd", "C a b"),
    "cs": ("public record R(int A);\n  public async Task<int> Run (int a)\n  return Foo(1)\n  await Bar(2)", "R Run"),
    "ts": ("export const f = async (a) => a\nlet g = function() {}\nclass K {}\nfunction h() {}\nconst n = 3", "K f g h"),
    "go": ("func (s *T) Do(a int) error {\ntype T struct {", "Do T"),
    "ps1": ("Function Get-Thing {", "Get-Thing"),
    "c": ("static int *make (int a) {\nstruct node {", "make node"),
    "md": ("def a(): pass", ""),
}


@pytest.mark.parametrize("lang", SNIPPETS)
def test_symbols(spark, lang):
    src, want = SNIPPETS[lang]
    row = spark.createDataFrame([(src, lang)], "t string, l string").select(symbols.symbols(F.col("t"), F.col("l"))).first()
    assert row[0] == want


TYPED = [
    ("int add (int a)", ["add"]), ("  public static Foo<A, B>[] make_it(x)", ["make_it"]), ("return f(x)", []), ("naïve\tcall()", ["call"]), ("f(x)", []), ("a b c d e(", ["e"]),
    ("void\n f()", []), ("Foo::Bar *& get()\nint y = z(1)", ["get"]), ("new T(1)", []), ("newer T(1)", ["T"]), ("else if (x)", []), ("x.y z (", ["z"]), ("\tint f(\n  int g(", ["f", "g"]),
]


def test_typed_function(spark):
    """Literal cases, and long lines do not overflow the matcher."""
    got = spark.createDataFrame([(t,) for t, _ in TYPED], "t string").select(F.regexp_extract_all("t", F.lit(symbols.TYPED_FUNCTION), F.lit(1))).collect()
    assert [r[0] for r in got] == [want for _, want in TYPED]
    assert one(spark, "a " * 5000 + "b", lambda c: F.size(F.regexp_extract_all(c, F.lit(symbols.TYPED_FUNCTION), F.lit(1)))) == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n{}#-", max_size=400), st.sampled_from(["py", "md", "tf", "yml", ""]))
def test_chunks_cover_the_text(s, lang):
    spans = chunking.split_spans(s, lang, size=40, overlap=10)
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(i in covered for i, c in enumerate(s) if not c.isspace())
    assert all(0 < b - a <= 40 for a, b in spans) and spans == sorted(spans)


def test_lines_of_positions():
    starts = chunking.line_starts("a\nb")
    assert starts == [0, 2, 3] and [chunking.line_of(starts, p) for p in (0, 1, 2, 3)] == [1, 1, 2, 3]


def test_chunk_rows(spark):
    body = "import a\nimport b\nimport c\n" + "\n" + "def run():\n" + "    x = 1\n" * 400
    files = spark.createDataFrame([("p", "r", "a.py", "py", "code", 10, body, 9), ("p", "r", "e.py", "py", "code", 0, "", 9), ("p", "r", "n.py", "py", "code", 0, None, 9)], "project string, repo string, path string, language string, content_type string, file_size_bytes int, text string, extra int")
    rows = chunking.chunk_rows(files).orderBy("start_line").collect()
    assert len(rows) >= 2 and {r["path"] for r in rows} == {"a.py"} and rows[0]["embed_text"].startswith("// p/r/a.py\n")
    assert len({r["id"] for r in rows}) == len(rows)


def test_embedding():
    assert checked_dimension(hash_provider) == 96
    calls, waits = [], []

    def embed(texts):
        calls.append(1)
        if len(calls) < 3:
            raise RateLimited(7 if len(calls) == 1 else None)
        return [[1.0]]

    assert with_retries(embed, ["a"], sleep=waits.append) == [[1.0]] and waits == [7, 4]
    with pytest.raises(RateLimited):
        with_retries(lambda _: (_ for _ in ()).throw(RateLimited()), ["a"], attempts=2, sleep=waits.append)
    with pytest.raises(ValueError):
        checked_dimension(lambda: hash_provider(3000))
