"""Files nobody wrote by hand (problem 2): generated, minified, vendored, or data stored as code.

Vendored files: files in a dependency folder or under a third-party banner are seeds and name a library. The inverted
index holds the seeds' lines (hash of the letters and digits, so layout does not matter). Every file's lines are looked up
in it once, and a file of which a share of CONTAINED or more of the lines lies in a library of another repository is a copy,
edited or not. Common lines are left out of that share: those of more than RARE (in large collections SHARE of all)
unrelated files or libraries. A file of which a library holds RELATED or more of the lines is related to it and makes no
line common, however many copies there are and whatever their names; where fewer than three rare lines agree, the whole
line set has to agree too.
A library named like a repository of the collection is a first-party copy: it counts where it is kept as a dependency, but
the original and pasted pieces do not.

Remaining files are judged by token composition: share of white space and one-letter names (minified), of numeric and
encoded literals (data), numbered runs of one line shape and comment banners (generated).

Defined results: null project, repo or path make no file; null and empty texts show nothing; rows with equal id count
once; a null language is an ordinary language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tokenize import text_slices
from corpusloom.session import saved, spread

RARE, SHARE, RELATED, CONTAINED, LINE_CHARS, HEAD_LINES = 8, 0.001, 0.5, 0.7, 12, 14
FILE = ["project", "repo", "path"]

# Customary names of dependency folders and of tools' output files.
DEPENDENCY_FOLDERS = "vendor _vendor third_party third-party thirdparty 3rdparty node_modules bower_components jspm_components godeps deps external externals extlib extlibs site-packages pods carthage"
GENERATED_NAMES = (
    r"_pb2(_grpc)?\.pyi?$|\.pb(\.gw|\.validate)?\.(go|cc|h)$|_pb\.(js|ts|d\.ts)$|_grpc_pb\.js$|\.g\.(cs|dart)$|\.g\.i\.cs$|\.designer\.(cs|vb)$"
    r"|outerclass\.java$|\.generated\.\w+$|_generated\.\w+$|\.gen\.\w+$|_gen\.go$|_string\.go$|\.tab\.[ch]$|(^|/)lex\.yy\.c$|(^|/)zz_generated\.|(^|/)__generated__/|(^|/)generated-sources/|(^|/)generated/"
)
CONFIG = {"json", "yml", "yaml", "ini", "env", "toml", "xml", "properties", "tf", "md", "txt"}
SCRIPTS = {"js", "ts", "jsx", "tsx", "css", "mjs", "cjs"}

_folder = re.compile(r"(?i)(?:^|/)(?:%s)/(?:_workspace/)?(?:src/)?([^/]+)/" % "|".join(map(re.escape, DEPENDENCY_FOLDERS.split())))
_version = re.compile(r"[-@]v?\d[\w.]*$")
_generated_name = re.compile("(?i)" + GENERATED_NAMES)
_comment = re.compile(r"^\s*(?://|#|--|/\*|\*|<!--|;|%|\"\"\"|''')")
_blocks = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
_generated = re.compile(
    r"(?i)^\W*(?:<auto-?generated\b|(?:this (?:file|code) (?:was|is) )?(?:automatically |auto-?)generated\b(?!.*\b(?:header|client|copy|stub)s?\b.*\bfor\b)|(?:this (?:file|code) (?:was|is) )?generated (?:by|from|on|with|using)\b|code generated (?:by|from)\b|@generated\b"
    r"|.*\b(?:do not|don't) (?:edit|modify|change)\b.*|.*\bmanual changes? (?:gets?|will be) (?:overwritten|lost)\b|.*\bthis code was (?:produced|generated) by\b|.*changes (?:to this file )?will be lost\b)"
)
_banner = re.compile(r"(?im)^\W*(?:upstream:\s*([\w.-]+?)\s+v?\d[\w.]*,?\s+imported|@license\s+([\w.-]+?)@v?\d|([\w-]+)\s+v\d+\.\d+[\w.]*[ \t]*\r?\n\W*https?://\S+/license)")
_one_letter = re.compile(r"(?<![\w$])[a-z](?!\w)")
_word = re.compile(r"[A-Za-z_]\w*")
_number = re.compile(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?)(?![\w.])")
_encoded = re.compile(r"""(["'`])[A-Za-z0-9+/=_-]{40,}\1""")
_ints = re.compile(r"\d+")
_source_map = re.compile(r"(?m)^\s*(?://|/\*)[#@]\s*sourceMappingURL=")


def head(lines: list[str]) -> Iterator[tuple[str, bool]]:
    """The head of a file, (line, whether it is a comment): the leading comments however long, HEAD_LINES further lines, and
    the rest of the comments that begin among these."""
    left, code, end, before = HEAD_LINES, False, "", True
    for line in lines:
        inside, text = end, line.strip()
        if inside:
            end = "" if inside in text else inside
        else:
            start = next((x for x in _blocks if text.startswith(x)), "")
            end = _blocks[start] if start and _blocks[start] not in text[len(start) :] else ""
        comment = bool(_comment.match(line))
        quiet = bool(inside) or comment or not text
        code = code or not quiet
        if code and left:
            left -= 1
        elif code and not (quiet and before):
            return
        before = quiet
        # lines within a docstring lengthen the head but are no comments
        yield line, comment or inside in ("*/", "-->")


def is_generated(path: str, text: str, language: str | None) -> bool:
    if _generated_name.search(path):
        return True
    lines = text.splitlines()
    if any(comment and _generated.match(line) for line, comment in head(lines)):
        return True
    return (language or "").lower() not in CONFIG and numbered(lines)


def numbered(lines: list[str], least: int = 8) -> bool:
    """Most lines have one shape and carry a number that rises by one from line to line."""
    lines = [x for x in lines if x.strip()]
    if len(lines) < least:
        return False
    rows = [[int(n[:18]) for n in _ints.findall(x)] for x in lines]
    steps = sum(1 for a, b in zip(rows, rows[1:]) if a and len(a) == len(b) and any(y - x == 1 for x, y in zip(a, b)))
    return steps >= 0.6 * (len(lines) - 1)


def is_minified(path: str, text: str, language: str | None) -> bool:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in SCRIPTS and (language or "").lower() not in SCRIPTS:
        return False
    if _source_map.search(text):
        return True
    body = text.strip()
    if len(body) < 150:
        return False
    blanks = sum(map(body.count, " \t\n\r"))
    if blanks > 0.09 * len(body):
        return False
    words = _word.findall(body)
    return len(_one_letter.findall(body)) >= 0.15 * max(1, len(words))


def is_data(text: str, language: str | None) -> bool:
    if len(text) < 150 or (language or "").lower() in CONFIG:
        return False
    numbers = sum(len(x) + 1 for x in _number.findall(text))
    encoded = sum(m.end() - m.start() for m in _encoded.finditer(text))
    solid = len("".join(text.split()))
    return numbers + encoded >= 0.6 * solid


def dependency(path: str, text: str) -> tuple[str | None, bool]:
    """(library, seed): the library a dependency folder or a banner names."""
    m = _folder.search(path)
    if m:
        return _version.sub("", m.group(1)).lower(), True
    if _folder.search(path + "/") or re.search(r"(?i)(?:^|/)(?:%s)/[^/]+$" % "|".join(map(re.escape, DEPENDENCY_FOLDERS.split())), path):
        return path.rsplit("/", 1)[-1].lower(), True
    m = _banner.search("\n".join(line for line, _ in head(text.splitlines())))
    return (next(g for g in m.groups() if g).lower(), True) if m else (None, False)


def judged(rows: DataFrame) -> DataFrame:
    """project, repo, path, id, shown (the chunk alone shows it), lib (seeds) of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 5):
            shown, libs = [], []
            for path, language, text in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5))):
                text = text or ""
                lib, seed = dependency(path, text)
                libs.append(lib)
                shown.append(seed or is_generated(path, text, language) or is_minified(path, text, language) or is_data(text, language))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shown, pa.bool_()), pa.array(libs, pa.string())], names=["id", *FILE, "shown", "lib"])

    return rows.select("id", *FILE, "language", "text").mapInArrow(run, "id string, project string, repo string, path string, shown boolean, lib string")


def line_hashes(rows: DataFrame) -> DataFrame:
    """id, project, repo, path, lines (distinct hashes of lines with LINE_CHARS or more letters and digits)."""
    solid = F.filter(F.transform(F.split("text", "\r\n|\r|\n"), lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")), lambda x: F.length(x) >= LINE_CHARS)
    return rows.select("id", *FILE, F.array_distinct(F.transform(solid, lambda x: F.xxhash64(x))).alias("lines"))


def not_hand_written(chunks: DataFrame) -> DataFrame:
    """project, repo, path of the files to leave out."""
    code = spread(chunks.where("content_type = 'code' and project is not null and repo is not null and path is not null").select("id", *FILE, "language", "text"))
    marks = saved(judged(code).distinct(), "marks")
    lines = saved(line_hashes(code).where("size(lines) > 0").dropDuplicates(["id"]), "lines")
    repos = marks.select(F.lower("repo").alias("lib")).distinct()
    seeds = marks.where("lib is not null").select("id", "lib").join(repos, "lib", "left_anti")
    flat = lines.select("id", *FILE, F.explode("lines").alias("line"))
    indexed = saved(flat.join(seeds, "id").groupBy("line", "lib").agg(F.min("repo").alias("r1"), F.max("repo").alias("r2")), "index")
    total = lines.groupBy(*FILE).agg(F.sum(F.size("lines")).alias("total"))
    # a line meets the index once, however many libraries hold it; only files with half their lines there meet the libraries,
    # as no other can be related to one or a copy. A licence line of many files and many libraries so multiplies for copies only.
    known = saved(flat.join(indexed.select("line").distinct(), "line", "left_semi"), "known")
    near = known.groupBy(*FILE).agg(F.count("*").alias("inside")).join(total, FILE).where(F.col("inside") >= RELATED * F.col("total")).select(*FILE)
    known_near = saved(known.join(near, FILE, "left_semi"), "near")
    hits = saved(known_near.join(indexed, "line"), "hits")
    foreign = (F.col("repo") != F.col("r1")) | (F.col("repo") != F.col("r2"))
    shares = saved(hits.groupBy(*FILE, "lib").agg(F.count("*").alias("held"), F.count_if(foreign).alias("whole")).join(total, FILE), "shares")
    common_lines = saved(common(known, indexed, shares, total.count()), "common")
    skipped = known_near.join(common_lines, "line", "left_semi").groupBy(*FILE).agg(F.count("*").alias("skipped"))
    found = hits.where(foreign).join(common_lines, "line", "left_anti").groupBy(*FILE, "lib").agg(F.count("*").alias("found"))
    judged_by = shares.where("whole >= 3").join(skipped, FILE, "left").join(found, [*FILE, "lib"], "left").na.fill(0, ["skipped", "found"])
    # where fewer than three rare lines agree, the whole line set decides
    copies = judged_by.where(F.col("found") >= CONTAINED * (F.col("total") - F.col("skipped"))).where((F.col("found") >= 3) | (F.col("whole") >= CONTAINED * F.col("total"))).select(*FILE)
    return marks.where("shown").select(*FILE).unionByName(copies).distinct()


def common(known: DataFrame, indexed: DataFrame, shares: DataFrame, files: int) -> DataFrame:
    """line: the lines that too many unrelated files or different libraries hold; exact counts."""
    related = shares.where(F.col("held") >= RELATED * F.col("total")).select(*FILE).distinct()
    unrelated = known.join(related, FILE, "left_anti").select("line", *FILE).distinct().groupBy("line").count().where(F.col("count") > max(RARE, files * SHARE))
    libraries = indexed.select("lib").distinct().count()
    many = indexed.groupBy("line").count().where(F.col("count") > max(RARE, libraries * SHARE))
    return unrelated.select("line").union(many.select("line")).distinct()
