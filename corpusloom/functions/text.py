"""Column expressions over text and paths; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split sees it.
WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Line ends as Python's str.splitlines sees them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# What the index leaves out.
SKIP_DIRS = [".git", "node_modules", "bin", "obj", "dist", "build", "venv", ".venv", "target", "vendor", "packages", ".idea", ".vs", "testdata", "test-data", "fixtures", "__snapshots__", "locales", "i18n", "l10n"]
SKIP_EXT = [".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".dll", ".exe", ".so", ".pdb", ".woff", ".woff2", ".ttf", ".svg", ".csv", ".tsv", ".parquet", ".map"]
SKIP_FILENAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "cargo.lock", "composer.lock", "packages.lock.json", "pipfile.lock", "gemfile.lock", "bun.lock"]
MAX_FILE_BYTES = 1_000_000
#: Beginnings of lines that only import.
IMPORT_LINE = r"^\s*(?:using\s+[\w.]+\s*;|import\s|from\s+\S+\s+import\s|#include\s|require\s*\(|use\s+[\w:]+\s*;|extern\s+crate\s)"


def content_hash(text: Column) -> Column:
    """SHA-1 of the lower-cased text without white space; equal for copies that differ only in layout and case."""
    return F.sha1(F.lower(F.regexp_replace(text, WS, "")).cast("binary"))


def chunk_id(project: Column, repo: Column, path: Column, index: Column) -> Column:
    return F.sha1(F.concat(project, F.lit("/"), repo, F.lit("/"), path, F.lit("#"), index.cast("string")))


def token_estimate(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, WS), lambda x: x != ""))


def lines_of(text: Column) -> Column:
    """Lines without a last empty one; no lines for an empty text."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def filename_is_skipped(path: Column) -> Column:
    name = F.lower(file_name(path))
    return name.isin(*SKIP_FILENAMES) | name.endswith(".min.js") | name.endswith(".min.css")


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, empty if there is none; a leading dot makes no suffix."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def path_is_skipped(path: Column) -> Column:
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SKIP_DIRS])) | filename_is_skipped(path) | extension(path).isin(*SKIP_EXT)


def is_minified(text: Column) -> Column:
    """At least 2000 characters and more than 300 a line."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (F.length(text) >= 2000) & (F.length(text) / (newlines + 1) > 300)


#: Anything that is not white space in the sense of WS.
_SOLID = WS[:-1].replace("[", "[^", 1)


def is_import_dominated(text: Column) -> Column:
    """Of three or more lines that are not blank more than 0.8 import. Texts in which no import form occurs anywhere, most of
    all, are not cut into lines."""
    full = F.filter(lines_of(text), lambda x: x.rlike(_SOLID))
    marks = F.transform(full, lambda x: x.rlike(IMPORT_LINE))
    dominated = (F.size(marks) >= 3) & (F.size(F.filter(marks, lambda m: m)) / F.greatest(F.size(marks), F.lit(1)) > 0.8)
    return F.when(text.rlike(IMPORT_LINE.removeprefix(r"^\s*")), dominated).otherwise(F.lit(False))


def embed_header(project: Column, repo: Column, path: Column) -> Column:
    return F.concat(F.lit("// "), project, F.lit("/"), repo, F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/")), F.lit("\n"))


def vector_literal(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def decoded(content: Column) -> Column:
    """Bytes of a file as text: strict UTF-8 (else null), one leading byte order mark and all NULs dropped, blank to null."""
    text = F.try_validate_utf8(content.cast("string"))
    text = F.replace(F.regexp_replace(text, r"^\ufeff", ""), F.lit("\x00"), F.lit(""))
    return F.when(F.regexp_replace(text, WS, "") != "", text)


def like_pattern(needle: str) -> str:
    """ILIKE pattern of 'path contains': either slash matches, wildcards are literal."""
    return "%" + needle.replace("\\", "/").replace("%", r"\%").replace("_", r"\_") + "%"
