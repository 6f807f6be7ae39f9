"""Language-aware splitting of texts into overlapping chunks with line numbers.

A text is cut at the strongest separator of its language that occurs; pieces that are still too long are cut at the next
one. Pieces are merged up to the chunk size, and each chunk begins with up to OVERLAP characters of the one before.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.symbols import symbols
from corpusloom.functions.text import chunk_id, content_hash, embed_header, is_import_dominated, token_estimate

SIZE, OVERLAP = 1500, 200
GENERIC = ["\n\n", "\n", " ", ""]
# Separators of the two configuration languages.
_HCL = ["\n\n", "\n}\n", "\n}", "\n  ", "\n", " ", ""]
_YAML = ["\n---\n", "\n\n", "\n- ", "\n  ", "\n", " ", ""]
_BRACES = ["\nclass ", "\ninterface ", "\nenum ", "\nnamespace "]
#: Words that begin top-level constructs, strongest first.
_STARTS = {
    "py": ["\nclass ", "\ndef ", "\n    def ", "\n\tdef "],
    "cs": [*_BRACES, "\n    public ", "\n    private ", "\n    protected ", "\n    internal "],
    "ts": [*_BRACES, "\nexport ", "\nfunction ", "\nconst ", "\nlet "],
    "js": ["\nclass ", "\nexport ", "\nfunction ", "\nconst ", "\nlet ", "\nvar "],
    "java": [*_BRACES, "\n  public ", "\n  private ", "\n    public ", "\n    private "],
    "go": ["\nfunc ", "\ntype ", "\nvar ", "\nconst "],
    "rb": ["\nmodule ", "\nclass ", "\ndef ", "\n  def "],
    "php": ["\nclass ", "\nfunction ", "\n    public ", "\n    private "],
    "rs": ["\nmod ", "\nimpl ", "\ntrait ", "\npub fn ", "\nfn ", "\n    fn "],
    "kt": ["\nclass ", "\nobject ", "\nfun ", "\n    fun "],
    "scala": ["\nobject ", "\nclass ", "\ntrait ", "\ndef ", "\n  def "],
    "swift": ["\nclass ", "\nstruct ", "\nextension ", "\nfunc "],
    "ps1": ["\nfunction ", "\nparam ", "\nif ", "\nforeach "],
    "md": ["\n# ", "\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "\n```", "\n---\n"],
    "c": ["\nstruct ", "\nenum ", "\nstatic ", "\nint ", "\nvoid "],
    "lua": ["\nlocal function ", "\nfunction "],
}
SEPARATORS = {k: v + GENERIC for k, v in _STARTS.items()} | dict.fromkeys(("tf", "tfvars"), _HCL) | dict.fromkeys(("yaml", "yml"), _YAML)
for _new, _like in (("tsx", "ts"), ("jsx", "js"), ("psm1", "ps1"), ("cpp", "c"), ("h", "c")):
    SEPARATORS[_new] = SEPARATORS[_like]


def _cuts(text: str, a: int, b: int, size: int, seps: list[str]) -> Iterator[tuple[int, int]]:
    """Spans of [a, b) of at most SIZE characters; a separator stays with what follows it."""
    if b - a <= size:
        yield a, b
        return
    for k, sep in enumerate(seps):
        if not sep:
            yield from ((i, min(b, i + size)) for i in range(a, b, size))
            return
        at, starts = text.find(sep, a + 1, b), [a]
        while at != -1:
            starts.append(at)
            at = text.find(sep, at + len(sep), b)
        if len(starts) > 1:
            for x, y in zip(starts, [*starts[1:], b]):
                yield from _cuts(text, x, y, size, seps[k + 1 :] or [""])
            return
    yield from ((i, min(b, i + size)) for i in range(a, b, size))


def split_spans(text: str, language: str = "", size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of the chunks, white space at their ends left out; blank chunks are dropped."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    pieces = list(_cuts(text, 0, len(text), size, SEPARATORS.get(language, GENERIC)))
    out: list[tuple[int, int]] = []
    first = 0
    for i in range(len(pieces)):
        end = pieces[i][1]
        if i + 1 < len(pieces) and pieces[i + 1][1] - pieces[first][0] <= size:
            continue
        a, b = pieces[first][0], end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
        if i + 1 < len(pieces):
            # begin the next chunk with trailing pieces that fit the overlap and leave room for the next piece
            nxt = i + 1
            room = size - (pieces[nxt][1] - pieces[nxt][0])
            while nxt - 1 > first and pieces[i][1] - pieces[nxt - 1][0] <= min(overlap, room):
                nxt -= 1
            first = nxt
    return out


def line_starts(text: str) -> list[int]:
    out, at = [], 0
    for line in text.splitlines(keepends=True):
        out.append(at)
        at += len(line)
    return [*out, at] if text else [0]


def line_of(starts: list[int], position: int) -> int:
    """1-based line; a line end belongs to the line it ends, the end of the text counts as a further line."""
    return max(1, bisect_right(starts, position))


_KEPT = ["project", "repo", "path", "language", "content_type", "file_size_bytes", "commit_hash", "commit_date"]


def split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of files (_KEPT, text) to batches of their chunks (_KEPT, idx, start_line, end_line, text)."""
    text_at, language_at = len(_KEPT), _KEPT.index("language")
    for batch in batches:
        take, idx, first, last, parts = [], [], [], [], []
        for row, (text, language) in enumerate(zip(batch.column(text_at).to_pylist(), batch.column(language_at).to_pylist())):
            if not text:
                continue
            spans = split_spans(text, (language or "").lower())
            starts = line_starts(text)
            take += [row] * len(spans)
            idx += range(len(spans))
            first += [line_of(starts, a) for a, _ in spans]
            last += [line_of(starts, b) for _, b in spans]
            parts += [text[a:b] for a, b in spans]
        rows = pa.array(take, pa.int64())
        kept = [batch.column(i).take(rows) for i in range(text_at)]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.int32()) for x in (idx, first, last)), pa.array(parts, pa.string())], names=[*_KEPT, "idx", "start_line", "end_line", "text"])


def chunk_rows(files: DataFrame) -> DataFrame:
    """Chunks of files (project, repo, path, language, content_type, file_size_bytes, text, optional commit columns) with
    all derived columns and embed_text; the index counts chunks that are dropped as mere imports too."""
    for name in ("commit_hash", "commit_date"):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(""))
    kept = [F.col(c).cast("long" if c == "file_size_bytes" else "string").alias(c) for c in _KEPT]
    schema = ", ".join(f"{c} {'long' if c == 'file_size_bytes' else 'string'}" for c in _KEPT) + ", idx int, start_line int, end_line int, text string"
    rows = files.select(*kept, F.col("text").cast("string")).mapInArrow(split_batches, schema)
    rows = rows.where(~is_import_dominated(F.col("text")))
    ids = chunk_id(F.col("project"), F.col("repo"), F.col("path"), F.col("idx"))
    header: Column = embed_header(F.col("project"), F.col("repo"), F.col("path"))
    return rows.select(
        ids.alias("id"), "project", "repo", "path", "language", "content_type", "start_line", "end_line", "file_size_bytes",
        token_estimate(F.col("text")).alias("chunk_tokens_estimate"), "commit_hash", "commit_date", content_hash(F.col("text")).alias("content_hash"),
        symbols(F.col("text"), F.col("language")).alias("symbols"), "text", F.concat(header, F.col("text")).alias("embed_text"),
    )
