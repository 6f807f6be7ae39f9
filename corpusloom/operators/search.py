"""Hybrid search: filters, vector and lexical legs, reciprocal-rank fusion and collapse of copies.

Only ids and scores pass through the legs' top-n; texts are fetched for the at most 2 x 200 ids that remain. A row stored
twice (equal id) counts once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash, like_pattern
from corpusloom.functions.vectors import cosine, usable
from corpusloom.schema import HIT

RRF_K, MOST_TERMS, COPIES_SHOWN, SNIPPET = 60, 16, 5, 200
#: Saturation of a term's frequency in the lexical score.
SATURATION = 1.2


def filters(repo: str | None = None, language: str | None = None, path_contains: str | None = None, content_type: str | None = None) -> Column:
    """Conjunction of the given filters; empty and missing ones do not filter."""
    cond = F.lit(True)
    for name, value in (("repo", repo), ("language", language), ("content_type", content_type)):
        if value:
            cond = cond & (F.col(name) == value)
    if path_contains:
        cond = cond & F.replace("path", F.lit("\\"), F.lit("/")).ilike(like_pattern(path_contains))
    return cond


def query_terms(query: str | None) -> list[str]:
    """Words of two or more of [A-Za-z0-9_], each once whatever its case, the first 16."""
    seen: dict[str, str] = {}
    for t in re.findall(r"[A-Za-z0-9_]{2,}", query or ""):
        seen.setdefault(t.lower(), t)
    return list(seen.values())[:MOST_TERMS]


def query_terms_column(query: Column) -> Column:
    """The same over a column, lower-cased."""
    words = F.transform(F.regexp_extract_all(query, F.lit("([A-Za-z0-9_]{2,})"), F.lit(1)), F.lower)
    return F.slice(F.array_distinct(words), 1, MOST_TERMS)


def _top(scored: DataFrame, n: int) -> DataFrame:
    """The n best (id, score), each id once.

    A row stored twice has both equal, so the n best distinct pairs are those of dense rank n at most: every task keeps only
    these before anything is shuffled.
    """
    rank = F.dense_rank().over(Window.orderBy(F.desc("score"), "id"))
    return scored.select("id", "score").withColumn("rank", rank).where(F.col("rank") <= n).select("id", "score").distinct()


def vector_leg(chunks: DataFrame, vector: list[float], n: int, cond: Column | None = None) -> DataFrame:
    """id and score of the n chunks most similar to the vector; exact."""
    rows = chunks.where(cond if cond is not None else F.lit(True)).where(usable(F.col("embedding"), len(vector)))
    return _top(rows.select("id", cosine(F.col("embedding"), vector).alias("score")), n)


def _saturated(words: str, term: str) -> Column:
    """tf / (tf + SATURATION) of a term in an array column."""
    tf = F.size(F.filter(words, lambda w: w == term.lower()))
    return tf / (tf + SATURATION)


def lexical_score(text: Column, terms: list[str]) -> tuple[Column, Column]:
    """(words of the text that are terms, score over a column _hits of them): the sum of the terms' saturated frequencies."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]{2,})"), F.lit(1))
    hits = F.filter(words, lambda w: w.isin(*[t.lower() for t in terms]))
    return hits, sum((_saturated("_hits", t) for t in terms), F.lit(0.0))


def lexical_leg(chunks: DataFrame, query: str, n: int, cond: Column | None = None) -> DataFrame:
    """id and score of the n best chunks that hold any term; none without terms."""
    terms = query_terms(query)
    rows = chunks.where(cond if cond is not None else F.lit(True))
    if not terms:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    # a plain containment test first: most texts are dropped before they are cut into words
    near = F.lower("text")
    any_term = F.lit(False)
    for t in terms:
        any_term = any_term | near.contains(t.lower())
    hits, score = lexical_score(F.col("text"), terms)
    return _top(rows.where(any_term).select("id", hits.alias("_hits")).where("size(_hits) > 0").select("id", score.alias("score")), n)


#: What a posting says of its chunk besides the term, so that filters need no join.
POSTING = ["id", "project", "repo", "path", "language", "content_type"]


def postings(chunks: DataFrame) -> DataFrame:
    """field (text or symbols), term, tf and POSTING of every word of the chunks: what the legs below read of an index."""

    def named(field: str, pattern: str) -> Column:
        found = F.coalesce(F.regexp_extract_all(F.lower(field), F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))
        return F.transform(found, lambda w: F.struct(F.lit(field).alias("field"), w.alias("term")))

    words = F.explode(F.concat(named("text", "([a-z0-9_]{2,})"), named("symbols", "([a-z0-9_]+)")))
    rows = chunks.select(*POSTING, words.alias("w")).select(*POSTING, "w.field", "w.term")
    return rows.groupBy(*POSTING, "field", "term").agg(F.count("*").cast("int").alias("tf"))


def _posted(index: DataFrame, field: str, terms: list[str], cond: Column | None) -> tuple[DataFrame, Column]:
    """(id with a column of the frequency of each term, score): only the postings of the terms are read."""
    low = [t.lower() for t in terms]
    rows = index.where((F.col("field") == field) & F.col("term").isin(*low) & (cond if cond is not None else F.lit(True)))
    wide = rows.groupBy("id").agg(*[F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(low)])
    return wide, sum((F.col(f"tf{i}") / (F.col(f"tf{i}") + SATURATION) for i in range(len(low))), F.lit(0.0))


def indexed_lexical_leg(index: DataFrame, query: str, n: int, cond: Column | None = None) -> DataFrame:
    """lexical_leg from an index of postings."""
    terms = query_terms(query)
    if not terms:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    rows, score = _posted(index, "text", terms, cond)
    return _top(rows.select("id", score.alias("score")), n)


def _ranked(leg: DataFrame) -> DataFrame:
    """A leg's 0-based ranks; a leg has at most 200 rows."""
    return leg.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)


def fuse(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """id, rrf, score (of the vector leg), matched_by of the union of both legs."""
    v = _ranked(vector).select("id", "score", (1 / (RRF_K + F.col("rank"))).alias("rv"))
    x = _ranked(lexical).select("id", (1 / (RRF_K + F.col("rank"))).alias("rx"))
    both = v.join(x, "id", "full_outer")
    how = F.when(F.col("rv").isNull(), "lexical").when(F.col("rx").isNull(), "semantic").otherwise("both")
    return both.select("id", (F.coalesce("rv", F.lit(0.0)) + F.coalesce("rx", F.lit(0.0))).alias("rrf"), "score", how.alias("matched_by"))


def collapse(fused: DataFrame, chunks: DataFrame, top_k: int, min_score: float | None = None) -> DataFrame:
    """Keepers with at most five copies each, in order; copies attach to their keeper even past top_k.

    fused has at most 400 rows, so it is broadcast to fetch the hits; the windows then run over those rows only.
    """
    if min_score is not None:
        fused = fused.where((F.col("matched_by") != "semantic") | (F.col("score") >= min_score))
    rows = chunks.select("id", *HIT).join(F.broadcast(fused), "id").dropDuplicates(["id"]).withColumn("key", content_hash(F.col("text")))
    order = [F.desc("rrf"), F.asc("id")]
    rows = rows.withColumn("rk", F.row_number().over(Window.orderBy(*order))).withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    copy = F.struct(F.col("rn"), F.struct("project", "repo", "path", "start_line").alias("at"))
    shown = rows.where(F.col("rn").between(2, COPIES_SHOWN + 1)).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(copy)), lambda x: x["at"]).alias("duplicates"))
    keepers = rows.where("rn = 1").orderBy("rk").limit(top_k)
    return keepers.join(shown, "key", "left").withColumn("duplicates", F.coalesce("duplicates", F.array().cast("array<struct<project:string,repo:string,path:string,start_line:int>>"))).drop("rn")


def shaped(hits: DataFrame, compact: bool = False, max_chars: int = 0) -> DataFrame:
    """Output form: a snippet, or the text cut at max_chars with a flag that is set only when it was cut."""
    hits = hits.drop("key", "rrf", "id")
    if compact:
        return hits.withColumn("snippet", F.left("text", F.lit(SNIPPET))).drop("text")
    if max_chars and max_chars > 0:
        long = F.length("text") > max_chars
        return hits.withColumn("truncated", F.when(long, True)).withColumn("text", F.when(long, F.left("text", F.lit(max_chars))).otherwise(F.col("text")))
    return hits.withColumn("truncated", F.lit(None).cast("boolean"))


def hybrid_search(
    chunks: DataFrame,
    query: str,
    vector: list[float],
    top_k: int = 8,
    min_score: float | None = None,
    repo: str | None = None,
    language: str | None = None,
    path_contains: str | None = None,
    content_type: str | None = None,
    compact: bool = False,
    max_chars: int = 0,
    index: DataFrame | None = None,
) -> DataFrame:
    """Both legs under the same filters, over-fetched four times, fused, collapsed and shaped; ordered by rk. With an INDEX of
    postings the lexical leg reads only those of the query's terms."""
    top_k = min(max(top_k, 1), 50)
    n = min(max(4 * top_k, 40), 200)
    cond = filters(repo, language, path_contains, content_type)
    lexical = lexical_leg(chunks, query, n, cond) if index is None else indexed_lexical_leg(index, query, n, cond)
    fused = fuse(vector_leg(chunks, vector, n, cond), lexical)
    return shaped(collapse(fused, chunks, top_k, min_score), compact, max_chars)


def find_definitions(chunks: DataFrame, name: str, repo: str | None = None, language: str | None = None, path_contains: str | None = None, top_k: int = 8, max_chars: int = 0, index: DataFrame | None = None) -> DataFrame:
    """Chunks whose symbols hold every token of the name, best first (saturated frequency, then id); with an INDEX of postings
    only those of the name are read."""
    terms = list(dict.fromkeys(t.lower() for t in re.findall(r"[A-Za-z0-9_]+", name or "")))
    top_k = min(max(top_k, 1), 50)
    rows = chunks.where(filters(repo, language, path_contains))
    if not terms:
        return rows.select(*HIT, "symbols").limit(0)
    if index is not None:
        hit, score = _posted(index, "symbols", terms, filters(repo, language, path_contains))
        for i in range(len(terms)):
            hit = hit.where(F.col(f"tf{i}") > 0)
    else:
        words = F.regexp_extract_all(F.lower("symbols"), F.lit("([a-z0-9_]+)"), F.lit(1))
        hit, score = rows.where(F.col("symbols").isNotNull()).select("id", words.alias("_w")), sum((_saturated("_w", t) for t in terms), F.lit(0.0))
        for t in terms:
            hit = hit.where(F.array_contains("_w", t))
    best = _top(hit.select("id", score.alias("score")), top_k)
    found = chunks.select("id", *HIT, "symbols").join(F.broadcast(best), "id").dropDuplicates(["id"])
    found = found.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).drop("score")
    return shaped(found, max_chars=max_chars)
