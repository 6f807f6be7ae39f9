"""Tables of the index."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i, _l = T.StringType(), T.IntegerType(), T.LongType()

CHUNKS = T.StructType(
    [T.StructField(n, _s, n not in ("id", "project", "repo", "path", "language", "content_type", "text")) for n in ("id", "project", "repo", "path", "language", "content_type")]
    + [T.StructField("start_line", _i), T.StructField("end_line", _i), T.StructField("file_size_bytes", _l), T.StructField("chunk_tokens_estimate", _i)]
    + [T.StructField(n, _s, n != "text") for n in ("commit_hash", "commit_date", "content_hash", "symbols", "text")]
    + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
)
POSTINGS = T.StructType([T.StructField(n, _s) for n in ("field", "term", "id", "project", "repo", "path", "language", "content_type")] + [T.StructField("tf", _i)])
STATE = T.StructType([T.StructField(n, _s) for n in ("project", "repo", "commit_hash", "indexed_at")])
PR_STATE = T.StructType([T.StructField("project", _s), T.StructField("repo", _s), T.StructField("last_pr_id", _l), T.StructField("indexed_at", _s)])
RUNS = T.StructType([T.StructField("run_id", _s), T.StructField("started_at", T.TimestampType()), T.StructField("finished_at", T.TimestampType()), T.StructField("outcome", _s)])
#: The ledger: a processed change (its key), its version and the run that processed it.
PROCESSED = T.StructType([T.StructField(n, _s) for n in ("project", "repo", "commit_hash", "status", "path")] + [T.StructField("commit_seq", _l), T.StructField("received_at", T.TimestampType()), T.StructField("run_id", _s)])
PULL_REQUEST = T.StructType([T.StructField("pr_id", _l), T.StructField("title", _s), T.StructField("description", _s), T.StructField("created_date", _s), T.StructField("work_item_ids", T.ArrayType(_i))])

#: Columns of a search hit; the vector is never returned.
HIT = ["project", "repo", "path", "language", "content_type", "start_line", "end_line", "file_size_bytes", "chunk_tokens_estimate", "commit_hash", "commit_date", "text"]
#: Largest dimension a vector index takes.
LARGEST_DIMENSION = 2000
