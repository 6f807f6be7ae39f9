"""Duplicate clusters, file reconstruction and inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash
from corpusloom.operators.incremental import instant, iso
from corpusloom.session import saved

FILE = ["project", "repo", "path"]


#: Places that a cluster shows; duplicate_locations gives all.
SHOWN = 100
_PLACE = ["project", "repo", "path", "start_line", "id", "end_line"]


def _widest(chunks: DataFrame, min_repos: int, min_chars: int, limit: int, content_type: str, stored_hash: bool) -> tuple[DataFrame, DataFrame]:
    """(places, top): every chunk's hash and place once, and counts of the widest clusters (at most 200 rows)."""
    limit, min_repos = min(max(limit, 1), 200), max(min_repos, 1)
    key = F.col("content_hash") if stored_hash else content_hash(F.col("text"))
    rows = chunks.where((F.col("content_type") == content_type) & (F.length("text") >= min_chars)).select(key.alias("hash"), *_PLACE).where("hash is not null")
    places = saved(rows.dropDuplicates(["id"]), "places")  # the texts are hashed once and do not travel
    by_repo = places.groupBy("hash", "project", "repo").agg(F.count("*").alias("n"))
    top = by_repo.groupBy("hash").agg(F.sum("n").alias("occurrence_count"), F.count("*").alias("repo_count")).where(F.col("repo_count") >= min_repos)
    return places, saved(top.orderBy(F.desc("repo_count"), F.desc("occurrence_count"), "hash").limit(limit), "widest")


def duplicate_locations(chunks: DataFrame, min_repos: int = 2, min_chars: int = 200, limit: int = 50, content_type: str = "code", stored_hash: bool = False) -> DataFrame:
    """hash and place of every occurrence in the clusters that duplicate_clusters reports, one row each."""
    places, top = _widest(chunks, min_repos, min_chars, limit, content_type, stored_hash)
    return places.join(F.broadcast(top.select("hash")), "hash").drop("id")


def duplicate_clusters(chunks: DataFrame, min_repos: int = 2, min_chars: int = 200, limit: int = 50, content_type: str = "code", stored_hash: bool = False) -> DataFrame:
    """Texts that occur in several repositories: counts, snippet and the first SHOWN locations in order, widest first.

    The counts are of all occurrences; a cluster may hold a third of all chunks, so its list is cut before it reaches one
    task, and duplicate_locations has it whole. The hash is computed unless the stored column is asked for.
    """
    places, top = _widest(chunks, min_repos, min_chars, limit, content_type, stored_hash)
    rank = F.row_number().over(Window.partitionBy("hash").orderBy(*_PLACE[:5]))
    first = places.join(F.broadcast(top), "hash").withColumn("rank", rank).where(F.col("rank") <= SHOWN)
    shown = first.groupBy("hash", "occurrence_count", "repo_count").agg(F.min_by("id", F.struct(*_PLACE[:5])).alias("id"), F.array_sort(F.collect_list(F.struct(*_PLACE))).alias("p"))
    locations = F.transform("p", lambda x: F.struct(*[x[c].alias(c) for c in ("project", "repo", "path", "start_line", "end_line")]))
    snippets = chunks.select("id", F.left("text", F.lit(200)).alias("snippet")).join(F.broadcast(shown.select("id")), "id").dropDuplicates(["id"])  # at most 200 ids
    return shown.join(F.broadcast(snippets), "id").select("hash", "occurrence_count", "repo_count", "snippet", locations.alias("locations"))


def numbered_lines(chunks: DataFrame) -> DataFrame:
    """project, repo, path, ln, line: each line of a file once; of overlapping chunks the first by start line, id wins.

    Chunks, not lines, are shuffled by file; that one shuffle serves this and all later steps per file.
    """
    rows = chunks.where("text is not null").select(*FILE, "id", "start_line", "text").repartition(*FILE)
    rows = rows.select(*FILE, "id", "start_line", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return rows.groupBy(*FILE, (F.col("start_line") + F.col("i")).alias("ln")).agg(F.min_by("line", F.struct("start_line", "id")).alias("line"))


def gaps(lines: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """project, repo, path, start_line, end_line of the maximal missing ranges, those before and after the lines included
    when a window is given."""
    w = Window.partitionBy(*FILE).orderBy("ln")
    if lo is not None:
        lines = lines.where(F.col("ln") >= lo)
    if hi is not None:
        lines = lines.where(F.col("ln") <= hi)
    before = F.lag("ln", 1, (lo if lo is not None else 1) - 1).over(w)
    return lines.select(*FILE, (before + 1).alias("start_line"), (F.col("ln") - 1).alias("end_line")).where("end_line >= start_line")


def stitched(chunks: DataFrame, lo: int | None = None, hi: int | None = None, max_chars: int = 0) -> DataFrame:
    """One row a file: text of the window's lines, gaps (leading, inner and trailing), first and last indexed line.

    Every given file has its row; a window past its end gives an empty text.
    """
    lines = numbered_lines(chunks)
    per = lines.groupBy(*FILE).agg(F.min("ln").alias("first_line"), F.max("ln").alias("indexed_end"), F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("l"))
    start = F.lit(lo if lo is not None else 1)
    stop = F.least(F.lit(hi), F.col("indexed_end")) if hi is not None else F.col("indexed_end")
    per = per.withColumn("l", F.filter("l", lambda x: (x["ln"] >= start) & (x["ln"] <= stop)))
    nums = F.concat(F.array(start - 1), F.transform("l", lambda x: x["ln"]), F.array(stop + 1))
    spans = F.filter(F.zip_with(F.slice(nums, F.lit(1), F.size(nums) - 1), F.slice(nums, F.lit(2), F.size(nums) - 1), lambda a, b: F.struct((a + 1).alias("start_line"), (b - 1).alias("end_line"))), lambda g: g["end_line"] >= g["start_line"])
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    out = per.select(*FILE, text.alias("text"), F.size("l").alias("n_lines"), spans.alias("gaps"), F.col("first_line").alias("indexed_start"), "indexed_end")
    if max_chars and max_chars > 0:
        out = out.withColumn("truncated", F.length("text") > max_chars).withColumn("text", F.left("text", F.lit(max_chars)))
    else:
        out = out.withColumn("truncated", F.lit(False))
    return out


def file_context(chunks: DataFrame, project: str, repo: str, path: str, lo: int | None = None, hi: int | None = None, max_chars: int = 0) -> DataFrame:
    """The row of one file, or a row with found = false and a note."""
    one = stitched(chunks.where((F.col("project") == project) & (F.col("repo") == repo) & (F.col("path") == path)), lo, hi, max_chars)
    asked = chunks.sparkSession.createDataFrame([(project, repo, path)], "project string, repo string, path string")
    out = asked.join(one, FILE, "left").withColumn("found", F.col("indexed_end").isNotNull())
    return out.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("note", F.when(~F.col("found"), "no indexed chunks for this file"))


def freshness(states: DataFrame | None, like: DataFrame) -> DataFrame:
    """project, repo, commit_hash, indexed_at: the newest state of each repository; empty without a table."""
    if states is None:
        return like.sparkSession.createDataFrame([], "project string, repo string, commit_hash string, indexed_at string")
    at = instant(F.col("indexed_at"))
    last = states.groupBy("project", "repo").agg(F.max(F.struct(at.alias("at"), F.coalesce("commit_hash", F.lit("")).alias("c"), F.col("indexed_at").alias("t"))).alias("s"))
    return last.select("project", "repo", F.col("s.c").alias("commit_hash"), iso(F.col("s.at")).alias("indexed_at"))


def inventory(chunks: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Chunks and files by (project, repo, content_type) with the repository's freshness, nulls where unknown."""
    slim = chunks.groupBy("project", "repo", "content_type", "path").agg(F.count_distinct("id").alias("n"))
    per = slim.groupBy("project", "repo", "content_type").agg(F.sum("n").alias("chunks"), F.count("*").alias("files"))
    return per.join(freshness(states, chunks), ["project", "repo"], "left")


def languages(chunks: DataFrame) -> DataFrame:
    """Chunks by language, most first; ties by name."""
    return chunks.groupBy("language").agg(F.count_distinct("id").alias("chunks")).orderBy(F.desc("chunks"), "language")
