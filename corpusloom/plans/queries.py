"""Queries of the core operators over the driver's tables, and their SQL."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import chunking, symbols, text
from corpusloom.functions.embedding import embedder, hash_provider
from corpusloom.operators import changes, incremental, reports, search
from corpusloom.plans import indexing
from corpusloom.session import shared_dir, spread, table
from corpusloom.store import Store

FLAGSHIP = "hybrid_search"

#: A constant query for the search operators.
QUERY = "retry loop releases the lease, lease harbor_tide 12 Monolith"
VECTOR = [round(math.sin(i + 1), 3) for i in range(96)]
SYMBOL, PATH_PART, TOP = "storeTenant", "src\\lens", 20
MIN_SCORE = 0.25


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks")


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_leg(_chunks(spark, sf_dir), VECTOR, TOP).select("id", F.round("score", 6).alias("score"))


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lexical_leg(_chunks(spark, sf_dir), QUERY, TOP).select("id", F.round("score", 9).alias("score"))


def filtered_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    cond = search.filters(path_contains="SRC\\l", content_type="code")
    return search.lexical_leg(_chunks(spark, sf_dir), QUERY, TOP, cond).select("id", F.round("score", 9).alias("score"))


def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).where(search.filters(path_contains=PATH_PART)).select("id", "path").distinct()


def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pull_requests").select("project", "repo", "pr_id", "description").distinct()
    return rows.select("project", "repo", "pr_id", F.array_join(search.query_terms_column(F.coalesce("description", F.lit(""))), " OR ").alias("terms"))


def fused_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    fused = search.fuse(search.vector_leg(c, VECTOR, 40), search.lexical_leg(c, QUERY, 40))
    return fused.select("id", F.round("rrf", 9).alias("rrf"), F.round("score", 6).alias("score"), "matched_by")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.hybrid_search(_chunks(spark, sf_dir), QUERY, VECTOR, top_k=TOP, compact=True)
    copies = F.array_join(F.transform("duplicates", lambda d: F.concat_ws("/", d["project"], d["repo"], d["path"])), "|")
    return hits.select("rk", "project", "repo", "path", "start_line", "matched_by", F.round("score", 6).alias("score"), "snippet", copies.alias("duplicates"))


_stores: dict[tuple[int, str], Store] = {}


def _stored(spark: SparkSession, sf_dir: str) -> Store:
    """The chunks of a data directory in a store with its index, built at the first use in a session."""
    key = (id(spark), sf_dir)
    if key not in _stores:
        store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", (8, 1))
        store.ensure()
        store.upsert(_chunks(spark, sf_dir).where("id is not null").withColumn("embedding", F.lit(None).cast("array<float>")))
        _stores[key] = store
    return _stores[key]


def indexed_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lexical_search through a store's index of postings."""
    return search.indexed_lexical_leg(_stored(spark, sf_dir).read("postings"), QUERY, TOP).select("id", F.round("score", 9).alias("score"))


def indexed_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hybrid_search with the lexical leg through a store's index of postings."""
    hits = search.hybrid_search(_chunks(spark, sf_dir), QUERY, VECTOR, top_k=TOP, compact=True, index=_stored(spark, sf_dir).read("postings"))
    copies = F.array_join(F.transform("duplicates", lambda d: F.concat_ws("/", d["project"], d["repo"], d["path"])), "|")
    return hits.select("rk", "project", "repo", "path", "start_line", "matched_by", F.round("score", 6).alias("score"), "snippet", copies.alias("duplicates"))


def indexed_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_definitions through a store's index of postings."""
    store = _stored(spark, sf_dir)
    return search.find_definitions(store.read("chunks"), SYMBOL, top_k=50, index=store.read("postings")).select("project", "repo", "path", "start_line", "rk", "symbols")


def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reports.duplicate_clusters(_chunks(spark, sf_dir), limit=200)
    places = F.array_join(F.transform("locations", lambda x: F.concat_ws(":", x["project"], x["repo"], x["path"], x["start_line"], x["end_line"])), "|")
    return c.select("hash", "occurrence_count", "repo_count", "snippet", places.alias("locations"))


def duplicate_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.duplicate_locations(_chunks(spark, sf_dir), limit=200)


def min_score_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the vector leg alone need a score; those of the lexical leg stay. Texts are cut at 120 characters, flagged where cut."""
    hits = search.hybrid_search(_chunks(spark, sf_dir), QUERY, VECTOR, top_k=TOP, min_score=MIN_SCORE, content_type="code", max_chars=120)
    return hits.select("rk", "project", "repo", "path", "start_line", "matched_by", F.round("score", 6).alias("score"), "text", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def file_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 3 to 30 of the first file by name of the largest repository, and a file that is not there."""
    c = _chunks(spark, sf_dir)
    path = c.where("project = 'harborline' and repo = 'monolith-core'").agg(F.min("path")).first()[0]
    both = [reports.file_context(c, "harborline", "monolith-core", x, 3, 30, 400) for x in (path or "", "no/such/file")]
    rows = both[0].unionByName(both[1])
    none = F.lit(0)
    return rows.select("project", "repo", "path", "found", "text", F.coalesce("indexed_start", none).alias("indexed_start"), F.coalesce("indexed_end", none).alias("indexed_end"), F.coalesce("truncated", F.lit(False)).alias("truncated"), F.coalesce("note", F.lit("")).alias("note"))


def planted_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing ranges of the files' lines once every third chunk, by its hash, is taken away."""
    c = _chunks(spark, sf_dir).where("text is not null and ascii(substr(id, -1)) % 3 <> 0")
    return reports.gaps(reports.numbered_lines(c), 1, 200)


def import_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the import lines of a chunk alone would be left out: the first 5 import lines of every chunk with as many."""
    lines = F.filter(text.lines_of(F.col("text")), lambda x: x.rlike(text.IMPORT_LINE))
    rows = _chunks(spark, sf_dir).where("text is not null").select("id", lines.alias("l")).distinct()
    return rows.where("size(l) > 0").select("id", F.size("l").alias("imports"), text.is_import_dominated(F.array_join("l", "\n")).alias("dropped"))


def renamed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's deletions as renames to a new name and its modifications as copies, parsed from their lines."""
    kind = F.when(F.col("status") == "D", F.concat_ws("\t", F.lit("R087"), "path", F.concat("path", F.lit(".moved")))).when(F.col("status") == "M", F.concat_ws("\t", F.lit("C100"), "path", F.concat("path", F.lit(".copy")))).otherwise(F.concat_ws("\t", "status", "path"))
    return changes.parse_name_status(table(spark, sf_dir, "file_changes").select("change_id", kind.alias("line")).distinct())


def backfilled_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with the newest known commit of its path instead of its own."""
    c = _chunks(spark, sf_dir).select("id", "project", "repo", "path", "commit_hash", "commit_date").distinct()
    known = changes.last_commits(table(spark, sf_dir, "file_changes"), table(spark, sf_dir, "commit_log"))
    return indexing.backfilled(c, known).select("id", "commit_hash", "commit_date")


def upserted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's chunks after the table is stored, its first project is deleted, and all chunks of the feed's paths come back with
    a new text: stored ids once each, replaced rows replaced."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    c = _chunks(spark, sf_dir).where("id is not null").withColumn("embedding", F.lit(None).cast("array<float>"))
    named = c.where("project is not null and repo is not null and path is not null and content_type is not null and text is not null")
    store.ensure()
    store.upsert(named)
    first = named.agg(F.min("project")).first()[0]
    store.apply(repos=named.where(F.col("project") == F.lit(first)))
    touched = table(spark, sf_dir, "file_changes").select("project", "repo", "path").distinct()
    store.apply(new=named.join(touched, ["project", "repo", "path"], "left_semi").withColumn("text", F.lit("new")))
    return store.read("chunks").select("id", "project", "repo", "path", F.length("text").alias("chars"))


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: their bytes behind a byte order mark, with a NUL, decoded again; every fifth is no UTF-8."""
    raw = F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "utf-8"), F.unhex(F.when(F.col("doc_id") % 5 == 0, "FF").otherwise("00")))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.decoded(raw).alias("t"))
    return rows.select("doc_id", F.sha2("t", 256).alias("text_sha"))


def chunk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chunks of every document keep of it, borders being this engine's own: all its words' characters in order, lines
    within the document, sizes, ids, hashes."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").distinct()
    c = document_chunks(spark, sf_dir).select(F.substring_index("path", "/", 1).cast("long").alias("doc_id"), "id", "text", "start_line", "end_line", "content_hash")
    squeezed = lambda x: F.regexp_replace(x, text.WS, "")
    inside = F.col("d.text").contains(F.col("c.text"))
    per = d.alias("d").join(c.alias("c"), F.col("d.doc_id") == F.col("c.doc_id")).groupBy("d.doc_id").agg(
        F.bool_and(inside).alias("inside"),
        F.bool_and(F.length("c.text") <= chunking.SIZE).alias("sized"),
        (F.count("*") == F.count_distinct("c.id")).alias("ids"),
        F.bool_and((F.col("c.start_line") >= 1) & (F.col("c.start_line") <= F.col("c.end_line"))).alias("lines"),
        F.bool_and(F.col("c.content_hash") == text.content_hash(F.col("c.text"))).alias("hashed"),
        (F.sum(F.length(squeezed(F.col("c.text")))) >= F.length(squeezed(F.first("d.text")))).alias("covered"),
    )
    return per


def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension and length of every pull request document's vector by the hashing provider."""
    docs = changes.pr_documents(table(spark, sf_dir, "pull_requests"))
    v = docs.select("project", "repo", "pr_id", embedder(hash_provider)(F.col("text")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.select("project", "repo", "pr_id", F.size("v").alias("numbers"), F.round(norm, 4).alias("length"))


def stitched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reports.stitched(_chunks(spark, sf_dir))
    spans = F.array_join(F.transform("gaps", lambda g: F.concat(g["start_line"].cast("string"), F.lit("-"), g["end_line"].cast("string"))), ",")
    return s.select("project", "repo", "path", "n_lines", "indexed_start", "indexed_end", F.sha2("text", 256).alias("text_sha"), spans.alias("gaps"))


def stitched_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reports.stitched(_chunks(spark, sf_dir), 10, 40)
    return s.select("project", "repo", "path", "n_lines", F.sha2("text", 256).alias("text_sha"))


def file_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.gaps(reports.numbered_lines(_chunks(spark, sf_dir)))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.inventory(_chunks(spark, sf_dir), table(spark, sf_dir, "repo_index_state"))


def repo_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.freshness(table(spark, sf_dir, "repo_index_state"), _chunks(spark, sf_dir))


def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.languages(_chunks(spark, sf_dir))


def find_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_definitions(_chunks(spark, sf_dir), SYMBOL, top_k=50).select("project", "repo", "path", "start_line", "rk", "symbols")


def skipped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _chunks(spark, sf_dir).select("path").distinct().select("path", text.filename_is_skipped(p).alias("name_skipped"), text.path_is_skipped(p).alias("path_skipped"), text.extension(p).alias("ext"))


def minified_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", text.is_minified(F.col("text")).alias("minified"))


def import_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).where(text.is_import_dominated(F.col("text"))).select("id").distinct()


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return rows.select("doc_id", text.content_hash(F.col("text")).alias("hash"), text.token_estimate(F.col("text")).alias("tokens"))


def stale_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).where("text is not null").withColumn("now", text.content_hash(F.col("text")))
    return rows.where(~F.col("now").eqNullSafe(F.col("content_hash"))).select("id", "now").distinct()


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _chunks(spark, sf_dir).select("project", "repo", "path").distinct()
    return files.select("*", text.chunk_id(F.col("project"), F.col("repo"), F.col("path"), F.lit(0)).alias("first_id"), text.embed_header(F.col("project"), F.col("repo"), F.col("path")).alias("header"))


def chunk_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = [x for x in symbols.PATTERNS if x not in ("cs", "java", "c", "cpp")]
    rows = _chunks(spark, sf_dir).where(F.lower("language").isin(*langs) & F.col("text").isNotNull())
    return rows.select("id", symbols.symbols(F.col("text"), F.col("language")).alias("names")).distinct()


def typed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).where(F.lower("language").isin("cs", "java", "c", "cpp") & F.col("text").isNotNull())
    return rows.select("id", symbols.symbols(F.col("text"), F.col("language")).alias("names")).distinct()


def name_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = table(spark, sf_dir, "file_changes").select("change_id", F.concat_ws("\t", "status", "path").alias("line")).distinct()
    return changes.parse_name_status(feed)


def last_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.last_commits(table(spark, sf_dir, "file_changes"), table(spark, sf_dir, "commit_log"))


def index_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.index_plan(table(spark, sf_dir, "commit_log"), table(spark, sf_dir, "repo_index_state"))


def pr_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.pr_documents(table(spark, sf_dir, "pull_requests"))


def pr_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.pr_cursor(table(spark, sf_dir, "pull_requests"))


def upserted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks left after the feed's paths are deleted: the anti-join half of an incremental run."""
    gone = table(spark, sf_dir, "file_changes").select("project", "repo", "path").distinct()
    return _chunks(spark, sf_dir).select("id", "project", "repo", "path").distinct().join(gone, ["project", "repo", "path"], "left_anti").select("id")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path text to chunks over the documents; chunk borders are this engine's own, so there is no SQL. A document
    without a path has an empty one and no language."""
    d = table(spark, sf_dir, "documents").where("text is not null").withColumn("path", F.coalesce("path", F.lit("")))
    files = d.select(F.lit("docs").alias("project"), F.coalesce("source", F.lit("")).alias("repo"), F.concat_ws("/", F.col("doc_id").cast("string"), "path").alias("path"), F.ltrim(text.extension(F.col("path")), F.lit(".")).alias("language"), F.col("kind").alias("content_type"), F.octet_length("text").cast("long").alias("file_size_bytes"), "text")
    return chunking.chunk_rows(spread(files)).drop("embed_text")


def embedded_prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull request documents embedded by the hashing provider."""
    docs = changes.pr_documents(table(spark, sf_dir, "pull_requests"))
    return docs.select("project", "repo", "pr_id", text.vector_literal(F.transform(embedder(hash_provider)(F.col("text")), lambda x: F.round(x, 4))).alias("vector"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return incremental.pending_changes(t("file_changes"), t("commit_log"), t("repo_index_state"), t("index_runs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        hybrid_search, vector_search, lexical_search, filtered_lexical_search, path_filter, query_tokens, fused_legs, duplicate_clusters, stitched_files, stitched_window, file_gaps,
        inventory, repo_freshness, language_counts, find_definitions, skipped_paths, minified_texts, import_chunks, content_hashes, stale_hashes, chunk_ids, chunk_symbols, typed_symbols,
        name_status, last_commits, index_plan, pr_documents, pr_cursors, upserted_paths, document_chunks, embedded_prs, p7_found,
        indexed_lexical_search, indexed_hybrid_search, indexed_definitions, duplicate_locations, min_score_search, file_contexts, planted_gaps, import_shares, renamed_paths, backfilled_commits, upserted_chunks, decoded_texts, chunk_checks, vector_checks,
    )
    return {f.__name__: f for f in found}


# ---- SQL ------------------------------------------------------------------------------------------------------------

_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_EOL = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_ONE = "k AS (SELECT DISTINCT ON (id) * FROM chunks)"
_TERMS = search.query_terms(QUERY)
_HITS = " + ".join(f"(len(list_filter(w, lambda x: x = '{t.lower()}')) / (len(list_filter(w, lambda x: x = '{t.lower()}')) + {search.SATURATION}))" for t in _TERMS)
_VEC = "[" + ", ".join(map(str, VECTOR)) + "]::DOUBLE[]"
#: Lower case as Unicode has it: the dotted capital I and a sigma at a word's end, which DuckDB's lower() maps one by one.
_LOWER = lambda c: f"lower(regexp_replace(replace({c}, chr(304), 'i' || chr(775)), '(\\p{{L}})Σ(\\P{{L}}|$)', '\\1ς\\2', 'g'))"
_HASH = lambda c: f"sha1({_LOWER(f"regexp_replace({c}, '{_WS}', '', 'g')")})"


def _vec(n: int) -> str:
    return f"""v AS (SELECT id, list_cosine_similarity(embedding::DOUBLE[], {_VEC}) AS score FROM k
  WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  ORDER BY score DESC, id LIMIT {n})"""


def _lex(n: int, cond: str = "true") -> str:
    wanted = ", ".join(f"'{t.lower()}'" for t in _TERMS)
    return f"""lw AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}') AS w FROM k WHERE {cond}),
  x AS (SELECT id, {_HITS} AS score FROM lw WHERE len(list_filter(w, lambda x: x IN ({wanted}))) > 0 ORDER BY score DESC, id LIMIT {n})"""


_FUSED = """rv AS (SELECT id, score, 1.0 / (59 + row_number() OVER (ORDER BY score DESC, id)) AS r FROM v),
rx AS (SELECT id, 1.0 / (59 + row_number() OVER (ORDER BY score DESC, id)) AS r FROM x),
f AS (SELECT coalesce(rv.id, rx.id) AS id, coalesce(rv.r, 0) + coalesce(rx.r, 0) AS rrf, rv.score AS score,
  CASE WHEN rv.id IS NULL THEN 'lexical' WHEN rx.id IS NULL THEN 'semantic' ELSE 'both' END AS matched_by FROM rv FULL JOIN rx ON rv.id = rx.id)"""

_HYBRID = f"""WITH {_ONE}, {_vec(80)}, {_lex(80)}, {_FUSED},
h AS (SELECT f.*, k.project, k.repo, k.path, k.start_line, k.text, {_HASH('k.text')} AS key FROM f JOIN k ON k.id = f.id),
o AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, id) AS rk, row_number() OVER (PARTITION BY key ORDER BY rrf DESC, id) AS rn FROM h),
d AS (SELECT key, string_agg(project || '/' || repo || '/' || path, '|' ORDER BY rn) AS duplicates FROM o WHERE rn BETWEEN 2 AND 6 GROUP BY key)
SELECT rk::INTEGER AS rk, project, repo, path, start_line, matched_by, round(score, 6) AS score, left(text, 200) AS snippet, coalesce(duplicates, '') AS duplicates
FROM o LEFT JOIN d ON d.key = o.key WHERE rn = 1 ORDER BY rk LIMIT {TOP}"""

_MIN_SCORE = f"""WITH {_ONE.replace("FROM chunks)", "FROM chunks WHERE content_type = 'code')")}, {_vec(80)}, {_lex(80)}, {_FUSED},
h AS (SELECT f.*, k.project, k.repo, k.path, k.start_line, k.text, {_HASH('k.text')} AS key FROM f JOIN k ON k.id = f.id WHERE matched_by <> 'semantic' OR score >= {MIN_SCORE}),
o AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, id) AS rk, row_number() OVER (PARTITION BY key ORDER BY rrf DESC, id) AS rn FROM h)
SELECT rk::INTEGER AS rk, project, repo, path, start_line, matched_by, round(score, 6) AS score, left(text, 120) AS text, length(text) > 120 AS truncated FROM o WHERE rn = 1 ORDER BY rk LIMIT {TOP}"""

_CLUSTERS = f"""WITH {_ONE}, c AS (SELECT *, {_HASH('text')} AS hash FROM k WHERE content_type = 'code' AND length(text) >= 200)
SELECT hash, count(*) AS occurrence_count, count(DISTINCT (project, repo)) AS repo_count,
  left(first(text ORDER BY project, repo, path, start_line, id), 200) AS snippet,
  string_agg(concat_ws(':', project, repo, path, start_line, end_line), '|' ORDER BY project, repo, path, start_line, id) FILTER (WHERE rn <= 100) AS locations
FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY project, repo, path, start_line, id) AS rn FROM c) GROUP BY hash HAVING repo_count >= 2 ORDER BY repo_count DESC, occurrence_count DESC, hash LIMIT 200"""

_LINES = f"""WITH {_ONE}, e AS (SELECT project, repo, path, id, start_line, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM k WHERE text IS NOT NULL),
n AS (SELECT project, repo, path, start_line + i AS ln, first(line ORDER BY start_line, id) AS line FROM e GROUP BY ALL),
g AS (SELECT project, repo, path, lag(ln, 1, 0) OVER (PARTITION BY project, repo, path ORDER BY ln) + 1 AS start_line, ln - 1 AS end_line FROM n)"""
_LINES = _LINES.replace("GROUP BY ALL", "GROUP BY project, repo, path, start_line + i")

_SKIP_NAME = "(lower(regexp_extract(path, '[^/]*$')) IN (" + ", ".join(f"'{x}'" for x in text.SKIP_FILENAMES) + ") OR lower(path) LIKE '%.min.js' OR lower(path) LIKE '%.min.css')"
_EXT = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]+)$', 1))"
_DIRS = "list_has_any(string_split(path, '/')[:-2], [" + ", ".join(f"'{x}'" for x in text.SKIP_DIRS) + "])"
_FULL_LINES = f"list_filter(regexp_split_to_array(text, '{_EOL}'), lambda x: regexp_replace(x, '{_WS}', '', 'g') <> '')"


def _symbols_sql() -> str:
    """Definition forms without possessive repetition, which RE2 lacks; the flags differ only in name."""
    cases, langs = [], []
    by: dict[tuple, list[str]] = {}
    for lang, patterns in symbols.PATTERNS.items():
        if symbols.TYPED_FUNCTION not in patterns:
            by.setdefault(tuple(patterns), []).append(lang)
    for patterns, names in by.items():
        langs += names
        parts = []
        for p in patterns:
            flags = ("m" if "(?mdU)" in p else "") + ("i" if "(?iU)" in p else "")
            body = p.replace("(?mdU)", "").replace("(?iU)", "").replace("(?U)", "")
            parts.append(f"regexp_extract_all(text, '{'(?' + flags + ')' if flags else ''}{body}', 1)")
        cases.append(f"WHEN lower(language) IN ({', '.join(repr(n) for n in names)}) THEN list_sort(list_distinct(list_concat({', '.join(parts)})))" if len(parts) > 1 else f"WHEN lower(language) IN ({', '.join(repr(n) for n in names)}) THEN list_sort(list_distinct({parts[0]}))")
    return f"WITH {_ONE} SELECT id, coalesce(array_to_string(CASE {' '.join(cases)} END, ' '), '') AS names FROM k WHERE text IS NOT NULL AND lower(language) IN ({', '.join(repr(n) for n in langs)})"


def _typed_sql() -> str:
    """The typed languages line by line, so that RE2 needs no possessive repetition: a name before a bracket, what stands
    before it on the line made of type words, the first of which is no keyword."""
    kinds = {"cs": "class|interface|struct|enum|record", "java": "class|interface|enum|record", "c": "struct|enum|union", "cpp": "struct|class|enum|union"}
    word = r"[A-Za-z_][\w<>\[\],.:?]*[ \t*&]+"
    typed = rf"list_filter(list_transform(regexp_split_to_array(text, '\n'), lambda x: regexp_extract(x, '^[ \t]*(?:{word})+?([A-Za-z_]\w*)[ \t]*\(', 1)), lambda x, i: x <> '' AND NOT regexp_matches(regexp_split_to_array(text, '\n')[i], '^[ \t]*(?:return|if|for|while|switch|catch|foreach|else|do|await|yield|throw|new|lock|using)\b'))"
    cases = " ".join(f"WHEN '{lang}' THEN regexp_extract_all(text, '\\b(?:{words})\\s+(\\w+)', 1)" for lang, words in kinds.items()).replace("\\\\", "\\")
    return f"WITH {_ONE} SELECT id, array_to_string(list_sort(list_distinct(list_concat(CASE lower(language) {cases} END, {typed}))), ' ') AS names FROM k WHERE text IS NOT NULL AND lower(language) IN ('cs', 'java', 'c', 'cpp')"


_POS = "p AS (SELECT project, repo, lower(commit_hash) AS h, min(commit_seq) AS seq, arg_min(commit_date, commit_seq) AS commit_date FROM commit_log GROUP BY 1, 2, 3)"
_STATE = """s AS (SELECT project, repo, lower(coalesce(commit_hash, '')) AS prior, coalesce(commit_hash, '') AS c, try_cast(trim(indexed_at) AS TIMESTAMPTZ) AS ts, indexed_at FROM repo_index_state),
f AS (SELECT *, row_number() OVER (PARTITION BY project, repo ORDER BY ts DESC NULLS LAST, c DESC, indexed_at DESC) AS rn FROM s)"""

_P7 = """
WITH l AS (SELECT project, repo, lower(commit_hash) AS h, min(commit_seq) AS q FROM commit_log GROUP BY 1, 2, 3),
ok AS (SELECT DISTINCT project, repo, lower(commit_hash) AS h FROM index_runs WHERE lower(trim(outcome)) = 'succeeded'),
s AS (SELECT st.project, st.repo, lower(st.commit_hash) AS h, try_cast(trim(indexed_at) AS TIMESTAMPTZ) AS at FROM repo_index_state st
      JOIN ok ON ok.project = st.project AND ok.repo = st.repo AND ok.h = lower(st.commit_hash)),
v AS (SELECT s.project, s.repo, l.q, row_number() OVER (PARTITION BY s.project, s.repo ORDER BY s.at DESC, coalesce(l.q, -1) DESC) AS rn
      FROM s LEFT JOIN l ON l.project = s.project AND l.repo = s.repo AND l.h = s.h WHERE s.at IS NOT NULL)
SELECT min(change_id) AS change_id FROM file_changes c
JOIN l ON l.project = c.project AND l.repo = c.repo AND l.h = lower(c.commit_hash)
LEFT JOIN v ON v.project = c.project AND v.repo = c.repo AND v.rn = 1
WHERE v.q IS NULL OR l.q > v.q
GROUP BY c.project, c.repo, l.h, c.status, c.path"""


def oracle_sql() -> dict[str, str]:
    given = _oracle_sql()
    same = {"indexed_lexical_search": "lexical_search", "indexed_hybrid_search": "hybrid_search", "indexed_definitions": "find_definitions"}
    return given | {name: given[of] for name, of in same.items()}


def _oracle_sql() -> dict[str, str]:
    code = "replace(path, chr(92), '/') ILIKE '%src/l%' ESCAPE '\\' AND content_type = 'code'"
    return {
        "hybrid_search": _HYBRID,
        "vector_search": f"WITH {_ONE}, {_vec(TOP)} SELECT id, round(score, 6) AS score FROM v",
        "lexical_search": f"WITH {_ONE}, {_lex(TOP)} SELECT id, round(score, 9) AS score FROM x",
        "filtered_lexical_search": f"WITH {_ONE}, {_lex(TOP, code)} SELECT id, round(score, 9) AS score FROM x",
        "path_filter": "SELECT DISTINCT id, path FROM chunks WHERE replace(path, chr(92), '/') ILIKE '%src/lens%' ESCAPE '\\'",
        "query_tokens": """WITH d AS (SELECT DISTINCT project, repo, pr_id, description FROM pull_requests),
          w AS (SELECT *, list_transform(regexp_extract_all(coalesce(description, ''), '[A-Za-z0-9_]{2,}'), lambda x: lower(x)) AS w FROM d)
          SELECT project, repo, pr_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:16], ' OR ') AS terms FROM w""",
        "fused_legs": f"WITH {_ONE}, {_vec(40)}, {_lex(40)}, {_FUSED} SELECT id, round(rrf, 9) AS rrf, round(score, 6) AS score, matched_by FROM f",
        "duplicate_clusters": _CLUSTERS,
        "duplicate_locations": _CLUSTERS.replace("SELECT hash, count", ", t AS (SELECT hash, count", 1) + ") SELECT c.hash, project, repo, path, start_line, end_line FROM c JOIN t USING (hash)",
        "min_score_search": _MIN_SCORE,
        "file_contexts": _LINES + """, one AS (SELECT min(path) AS path FROM k WHERE project = 'harborline' AND repo = 'monolith-core'),
          t AS (SELECT project, repo, path, string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE ln BETWEEN 3 AND 30) AS text, min(ln) AS a, max(ln) AS b FROM n WHERE project = 'harborline' AND repo = 'monolith-core' AND path = (SELECT path FROM one) GROUP BY 1, 2, 3)
          SELECT project, repo, path, true AS found, left(coalesce(text, ''), 400) AS text, a::INTEGER AS indexed_start, b::INTEGER AS indexed_end, coalesce(length(text), 0) > 400 AS truncated, '' AS note FROM t
          UNION ALL SELECT 'harborline', 'monolith-core', 'no/such/file', false, '', 0, 0, false, 'no indexed chunks for this file'""",
        "planted_gaps": _LINES.replace("FROM k WHERE text IS NOT NULL", "FROM k WHERE text IS NOT NULL AND ascii(right(id, 1)) % 3 <> 0").replace("AS line FROM e GROUP BY", "AS line FROM e WHERE start_line + i BETWEEN 1 AND 200 GROUP BY") + " SELECT project, repo, path, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line FROM g WHERE end_line >= start_line",
        "import_shares": f"""WITH {_ONE}, l AS (SELECT id, list_filter(regexp_split_to_array(text, '{_EOL}'), lambda x: regexp_matches(x, '{text.IMPORT_LINE}')) AS l FROM k WHERE text IS NOT NULL)
          SELECT id, len(l)::INTEGER AS imports, len(l) >= 3 AS dropped FROM l WHERE len(l) > 0""",
        "renamed_paths": """SELECT DISTINCT change_id, CASE WHEN status = 'T' THEN 'M' WHEN status = 'M' THEN 'A' ELSE status END AS status, CASE WHEN status = 'M' THEN path || '.copy' ELSE path END AS path FROM file_changes
          UNION SELECT change_id, 'A', path || '.moved' FROM file_changes WHERE status = 'D'""",
        "backfilled_commits": f"""WITH {_POS}, c AS (SELECT f.project, f.repo, f.path, f.status, p.h, p.commit_date, row_number() OVER (PARTITION BY f.project, f.repo, f.path ORDER BY p.seq DESC, f.change_id DESC) AS rn
          FROM file_changes f JOIN p ON p.project = f.project AND p.repo = f.repo AND p.h = lower(f.commit_hash)), l AS (SELECT * FROM c WHERE rn = 1 AND status <> 'D')
          SELECT DISTINCT k.id, coalesce(l.h, k.commit_hash) AS commit_hash, coalesce(l.commit_date, k.commit_date) AS commit_date FROM chunks k LEFT JOIN l ON l.project = k.project AND l.repo = k.repo AND l.path = replace(k.path, chr(92), '/')""",
        "upserted_chunks": """WITH k AS (SELECT DISTINCT ON (id) * FROM chunks WHERE id IS NOT NULL AND project IS NOT NULL AND repo IS NOT NULL AND path IS NOT NULL AND content_type IS NOT NULL AND text IS NOT NULL),
          t AS (SELECT DISTINCT project, repo, path FROM file_changes), m AS (SELECT k.*, EXISTS (SELECT 1 FROM t WHERE t.project = k.project AND t.repo = k.repo AND t.path = k.path) AS again FROM k)
          SELECT id, project, repo, path, CASE WHEN again THEN 3 ELSE length(text) END::INTEGER AS chars FROM m WHERE again OR project <> (SELECT min(project) FROM k)""",
        "decoded_texts": f"SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND regexp_replace(text, '{_WS}', '', 'g') <> '' THEN sha256(replace(text, chr(0), '')) END AS text_sha FROM documents WHERE text IS NOT NULL",
        "chunk_checks": f"SELECT DISTINCT doc_id, true AS inside, true AS sized, true AS ids, true AS lines, true AS hashed, true AS covered FROM documents WHERE regexp_replace(text, '{_WS}', '', 'g') <> ''",
        "vector_checks": "SELECT DISTINCT project, repo, pr_id, 96 AS numbers, 1.0::DOUBLE AS length FROM pull_requests",
        "typed_symbols": _typed_sql(),
        "stitched_files": _LINES + """, t AS (SELECT project, repo, path, string_agg(line, chr(10) ORDER BY ln) AS text, count(*) AS n_lines, min(ln) AS a, max(ln) AS b FROM n GROUP BY 1, 2, 3),
          q AS (SELECT project, repo, path, string_agg(start_line || '-' || end_line, ',' ORDER BY start_line) AS gaps FROM g WHERE end_line >= start_line GROUP BY 1, 2, 3)
          SELECT t.project, t.repo, t.path, n_lines::INTEGER AS n_lines, a::INTEGER AS indexed_start, b::INTEGER AS indexed_end, sha256(text) AS text_sha, coalesce(gaps, '') AS gaps
          FROM t LEFT JOIN q USING (project, repo, path)""",
        "stitched_window": _LINES + """ SELECT project, repo, path, count(*) FILTER (WHERE ln BETWEEN 10 AND 40)::INTEGER AS n_lines,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE ln BETWEEN 10 AND 40), '')) AS text_sha FROM n GROUP BY 1, 2, 3""",
        "file_gaps": _LINES + " SELECT project, repo, path, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line FROM g WHERE end_line >= start_line",
        "inventory": f"""WITH {_STATE}, i AS (SELECT project, repo, content_type, count(DISTINCT id) AS chunks, count(DISTINCT path) AS files FROM chunks GROUP BY 1, 2, 3)
          SELECT i.*, f.c AS commit_hash, strftime(f.ts AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS indexed_at FROM i LEFT JOIN f ON f.project = i.project AND f.repo = i.repo AND f.rn = 1""",
        "repo_freshness": f"WITH {_STATE} SELECT project, repo, c AS commit_hash, strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS indexed_at FROM f WHERE rn = 1",
        "language_counts": "SELECT language, count(DISTINCT id) AS chunks FROM chunks GROUP BY 1",
        "find_definitions": f"""WITH {_ONE}, w AS (SELECT *, list_filter(regexp_extract_all(lower(symbols), '[a-z0-9_]+'), lambda x: x = '{SYMBOL.lower()}') AS w FROM k)
          SELECT project, repo, path, start_line, row_number() OVER (ORDER BY len(w) / (len(w) + {search.SATURATION}) DESC, id)::INTEGER AS rk, symbols FROM w WHERE len(w) > 0 ORDER BY rk LIMIT 50""",
        "skipped_paths": f"SELECT DISTINCT path, {_SKIP_NAME} AS name_skipped, ({_SKIP_NAME} OR {_DIRS} OR {_EXT} IN ({', '.join(repr(x) for x in text.SKIP_EXT)})) AS path_skipped, {_EXT} AS ext FROM chunks",
        "minified_texts": "SELECT doc_id, length(text) >= 2000 AND length(text) / (length(text) - length(replace(text, chr(10), '')) + 1) > 300 AS minified FROM documents WHERE text IS NOT NULL",
        "import_chunks": f"""WITH {_ONE}, l AS (SELECT id, {_FULL_LINES} AS l FROM k WHERE text IS NOT NULL)
          SELECT id FROM l WHERE len(l) >= 3 AND len(list_filter(l, lambda x: regexp_matches(x, '{text.IMPORT_LINE}'))) / len(l) > 0.8""",
        "content_hashes": f"SELECT doc_id, {_HASH('text')} AS hash, len(list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> ''))::INTEGER AS tokens FROM documents WHERE text IS NOT NULL",
        "stale_hashes": f"SELECT DISTINCT id, {_HASH('text')} AS now FROM chunks WHERE text IS NOT NULL AND {_HASH('text')} IS DISTINCT FROM content_hash",
        "chunk_ids": "SELECT DISTINCT project, repo, path, sha1(project || '/' || repo || '/' || path || '#0') AS first_id, '// ' || project || '/' || repo || '/' || replace(path, chr(92), '/') || chr(10) AS header FROM chunks",
        "chunk_symbols": _symbols_sql(),
        "name_status": "SELECT DISTINCT change_id, CASE WHEN status = 'T' THEN 'M' ELSE status END AS status, path FROM file_changes",
        "last_commits": f"""WITH {_POS}, c AS (SELECT f.project, f.repo, f.path, f.status, p.h, p.commit_date, row_number() OVER (PARTITION BY f.project, f.repo, f.path ORDER BY p.seq DESC, f.change_id DESC) AS rn
          FROM file_changes f JOIN p ON p.project = f.project AND p.repo = f.repo AND p.h = lower(f.commit_hash))
          SELECT project, repo, path, h AS commit_hash, commit_date FROM c WHERE rn = 1 AND status <> 'D'""",
        "index_plan": f"""WITH {_STATE}, h AS (SELECT project, repo, lower(arg_max(commit_hash, commit_seq)) AS head FROM commit_log GROUP BY 1, 2),
          q AS (SELECT project, repo, prior FROM (SELECT *, row_number() OVER (PARTITION BY project, repo ORDER BY ts DESC, prior DESC) AS r FROM s WHERE ts IS NOT NULL) WHERE r = 1),
          n AS (SELECT DISTINCT project, repo, lower(commit_hash) AS prior FROM commit_log)
          SELECT h.project, h.repo, head, q.prior, CASE WHEN head = q.prior THEN 'skip' WHEN n.prior IS NOT NULL THEN 'incremental' ELSE 'full' END AS action
          FROM h LEFT JOIN q ON q.project = h.project AND q.repo = h.repo LEFT JOIN n ON n.project = h.project AND n.repo = h.repo AND n.prior = q.prior""",
        "pr_documents": """SELECT DISTINCT project, repo, pr_id, '_pull_requests/' || pr_id || '.md' AS path, '# ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(description, '') ||
          CASE WHEN len(work_item_ids) > 0 THEN chr(10) || chr(10) || 'Linked work items: ' || array_to_string(list_transform(list_sort(work_item_ids), lambda x: '#' || x), ', ') ELSE '' END AS text,
          'pr' AS content_type, '' AS commit_hash, coalesce(created_date, '') AS commit_date FROM pull_requests""",
        "pr_cursors": "SELECT project, repo, max(pr_id) AS last_pr_id FROM pull_requests GROUP BY 1, 2",
        "upserted_paths": "SELECT DISTINCT id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM file_changes f WHERE f.project = c.project AND f.repo = c.repo AND f.path = c.path)",
        "p7_found": _P7,
    }
