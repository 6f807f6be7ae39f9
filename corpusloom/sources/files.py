"""Files of checked-out repositories as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import MAX_FILE_BYTES, decoded, extension, is_minified, path_is_skipped


def read_files(spark: SparkSession, root: str, project: str | None = None, name: str | None = None, content_type: str = "code") -> DataFrame:
    """project, repo, path, language, content_type, file_size_bytes, text of the files worth indexing below ROOT.

    Without project and name the first two folders below ROOT name them. Skipped paths, large, undecodable and blank files
    and (not for wikis' sake but for all) minified texts are left out; the size filter is pushed into the listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= MAX_FILE_BYTES)
    base = "/" + root.split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/"
    rel = F.element_at(F.split(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.lit("\\Q" + base + "\\E"), F.lit(2)), 2)
    part = F.split(rel, "/")
    if project is not None:
        rows = files.withColumn("project", F.lit(project)).withColumn("repo", F.lit(name)).withColumn("rel", rel)
    else:
        rows = files.withColumn("project", F.get(part, F.lit(0))).withColumn("repo", F.get(part, F.lit(1))).withColumn("rel", F.array_join(F.slice(part, F.lit(3), F.size(part)), "/"))
    rows = rows.where((F.col("rel") != "") & ~path_is_skipped(F.col("rel")))
    rows = rows.select("project", "repo", F.col("rel").alias("path"), F.ltrim(extension(F.col("rel")), F.lit(".")).alias("language"), F.lit(content_type).alias("content_type"), F.col("length").alias("file_size_bytes"), decoded(F.col("content")).alias("text"))
    return rows.where(F.col("text").isNotNull() & ~is_minified(F.col("text")))
