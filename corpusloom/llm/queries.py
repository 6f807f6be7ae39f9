"""Queries of the training-data operators and their SQL where SQL can say the same over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import canonical, markup, neardup, notwritten, packing, secrets, sentences, similar, tokenize
from corpusloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_pairs(table(spark, sf_dir, "chunks").select("id", "embedding"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notwritten.not_hand_written(table(spark, sf_dir, "chunks"))


def _shingled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunks").where("text is not null and id is not null")
    return rows.select("id", canonical.canonical_key(F.col("text"), F.col("language")).alias("canon"), "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_rows(_shingled(spark, sf_dir), k=3, tenths=7)


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_groups(_shingled(spark, sf_dir), k=3, tenths=7)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.copies(table(spark, sf_dir, "chunks"))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.copy_counts(table(spark, sf_dir, "chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.elements(table(spark, sf_dir, "chunks"))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_texts(table(spark, sf_dir, "chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found_secrets(table(spark, sf_dir, "chunks")).select("id", "secret").distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found_secrets(table(spark, sf_dir, "chunks")).select("id", "redacted").distinct()


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: whether no redacted text still holds a secret of its chunk, redaction keeps lengths and line ends, and every
    chunk comes out."""
    found = secrets.found_secrets(table(spark, sf_dir, "chunks")).distinct()
    texts = table(spark, sf_dir, "chunks").where("content_type = 'code'").select("id", "text").dropDuplicates(["id"])
    breaks = lambda c: F.regexp_replace(c, r"[^\r\n]", "x")
    rows = found.join(texts, "id")
    return rows.agg(F.bool_and(~F.contains("redacted", "secret")).alias("clean"), F.bool_and(breaks("redacted") == breaks("text")).alias("layout"), F.bool_and(F.contains("text", "secret")).alias("present"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.token_ids(table(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip: digest of the text that the ids of each document spell."""
    return tokenize.decoded(p8_ids(spark, sf_dir)).select("doc_id", F.sha2("text", 256).alias("text_sha"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokenize.token_counts(table(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "item")
    return packing.pack(sizes, table(spark, sf_dir, "pack_budgets")).withColumnRenamed("item", "doc_id")


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By budget: documents, whether no container is over its capacity, every document is whole, only those above the capacity
    are split, and the containers are within one percent and two of the least number possible."""
    rows = p9_containers(spark, sf_dir).join(F.broadcast(table(spark, sf_dir, "pack_budgets").select("budget_id", "capacity_tokens").distinct()), "budget_id")
    sizes = tokenize.token_counts(table(spark, sf_dir, "documents")).withColumnRenamed("tokens", "size")
    per_bin = rows.where("container_id is not null").groupBy("budget_id", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("fill"))
    bins = per_bin.groupBy("budget_id").agg(F.bool_and(F.col("fill") <= F.col("capacity_tokens")).alias("fits"), (F.count("*") <= 1.01 * F.ceil(F.sum("fill") / F.max("capacity_tokens")) + 2).alias("tight"))
    per_doc = rows.groupBy("budget_id", "capacity_tokens", "doc_id").agg(F.sum("tokens").alias("placed"), F.count("*").alias("pieces")).join(sizes, "doc_id")
    least = F.greatest(F.ceil(F.col("size") / F.col("capacity_tokens")), F.lit(1))
    docs = per_doc.groupBy("budget_id").agg(F.count("*").alias("documents"), F.bool_and(F.col("placed") == F.col("size")).alias("whole"), F.bool_and(F.col("pieces") == least).alias("unsplit"))
    return docs.join(bins, "budget_id")


def p10_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: whether sentences lie within their documents, begin and end on no white space, and do not overlap."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").dropDuplicates(["doc_id"])
    before = F.lag("end_pos", 1, 0).over(Window.partitionBy("doc_id").orderBy("start_pos"))
    rows = p10_found(spark, sf_dir).withColumn("before", before).join(texts, "doc_id")
    part = F.substring("text", F.col("start_pos"), F.col("end_pos") - F.col("start_pos") + 1)
    return rows.agg(F.bool_and((F.col("start_pos") >= 1) & (F.col("end_pos") >= F.col("start_pos")) & (F.col("end_pos") <= F.length("text"))).alias("inside"), F.bool_and(F.length(F.trim(part)) == F.length(part)).alias("trimmed"), F.bool_and(F.col("start_pos") > F.col("before")).alias("apart"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p2_found, p3_found, p3_groups, p4_found, p4_counts, p5_found, p5_clean, p6_found, p6_redacted, p6_checks, p8_ids, p8_decoded, p9_containers, p9_checks, p10_found, p10_checks)
    return {f.__name__: f for f in found}


_CANON = r"""
WITH c AS (SELECT DISTINCT id, CASE WHEN lower(coalesce(language, '')) IN ('yml', 'json', 'env', 'ini')
    THEN 'F' || array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(lower(text), '\r\n|\r|\n'),
        lambda x: regexp_replace(x, '[^\p{L}\p{N}]+', '', 'g')), lambda x: x <> '')), chr(10))
    ELSE 'T' || regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') END AS canon
  FROM chunks WHERE text IS NOT NULL AND id IS NOT NULL),
g AS (SELECT canon, min(id) AS keep_id, count(*) AS n_copies FROM c GROUP BY canon)"""

_SHINGLES = r"""
w AS (SELECT DISTINCT id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM chunks WHERE text IS NOT NULL AND id IS NOT NULL),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS t FROM w WHERE len(w) > 2),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _CANON + " SELECT g.keep_id, c.id AS copy_id FROM c JOIN g USING (canon) WHERE c.id <> g.keep_id",
        "p4_counts": _CANON + " SELECT keep_id, n_copies FROM g",
        "p3_groups": "WITH RECURSIVE" + _SHINGLES + """,
e AS (SELECT p.id_a AS a, p.id_b AS b FROM p JOIN n x ON p.id_a = x.id JOIN n y ON p.id_b = y.id WHERE 10 * k >= 7 * (x.n + y.n - k)),
t AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS root FROM t UNION SELECT t.b, r.root FROM r JOIN t ON t.a = r.id),
g AS (SELECT id, min(root) AS group_id FROM r GROUP BY id) SELECT id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM g""",
        "p6_checks": "SELECT true AS clean, true AS layout, true AS present",
        "p8_decoded": "SELECT doc_id, sha256(text) AS text_sha FROM documents",
        "p9_checks": "SELECT budget_id, count(DISTINCT doc_id) AS documents, true AS whole, true AS unsplit, true AS fits, true AS tight FROM documents, pack_budgets GROUP BY budget_id",
        "p10_checks": "SELECT true AS inside, true AS trimmed, true AS apart",
        "p3_found": _CANON + "," + _SHINGLES + " SELECT p.id_a, p.id_b FROM p JOIN n x ON p.id_a = x.id JOIN n y ON p.id_b = y.id JOIN c ca ON ca.id = p.id_a JOIN c cb ON cb.id = p.id_b WHERE 10 * k >= 7 * (x.n + y.n - k) AND ca.canon <> cb.canon",
    }
