"""A versioned Parquet store: data first, then one numbered manifest that makes it count.

A manifest (manifests/N.json) names for every table the folder of each of its partitions. A commit writes new folders,
then creates manifest N + 1; nothing is deleted or renamed, so a reader sees whole versions, a crash at any point leaves the
version before, and of two writers the second finds N + 1 taken, looks again and goes on only if the other touched other
partitions.

Chunks are partitioned by content type, a bucket of the repository and a bucket of the path; a change reads and writes the
touched partitions only. The postings of their words are an index in the same partitions, sorted by term, written in the
same commit; a search for a term reads the pages of the term. The other tables have one partition, the ledger of processed changes one a run.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom import schema
from corpusloom.operators.search import postings
from corpusloom.session import saved


class IndexNotReady(Exception):
    """The index has not been built yet."""


class ConcurrentChange(Exception):
    """Another writer has changed the same partitions since they were read."""


#: Buckets of repositories and of paths of a new store: a partition should hold some 100 MB, so more for 100 TB.
BUCKETS = (64, 8)


def utc_now() -> Column:
    """The present time as ISO text, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def part_of(content_type: Column, buckets: tuple[int, int]) -> Column:
    """Partition name of a chunk (project, repo, path)."""
    return F.concat_ws("-", content_type, F.pmod(F.xxhash64("project", "repo"), F.lit(buckets[0])), F.pmod(F.xxhash64("path"), F.lit(buckets[1])))


class Store:
    """Tables chunks, postings, repo_index_state, pr_state, index_runs and processed below a shared folder."""

    SCHEMAS = {"chunks": schema.CHUNKS, "postings": schema.POSTINGS, "repo_index_state": schema.STATE, "pr_state": schema.PR_STATE, "index_runs": schema.RUNS, "processed": schema.PROCESSED}
    KEEP = 3
    #: Ledger partitions from which they are merged into one.
    LEDGER_PARTS = 64

    def __init__(self, spark: SparkSession, root: str, buckets: tuple[int, int] = BUCKETS) -> None:
        """BUCKETS: of repositories and of paths, if the store is new; an existing one keeps its own."""
        self.spark, self.root, self._new_buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm

    # ---- manifests --------------------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list[str]:
        fs, path = self._fs(), self._path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._list("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, number: int) -> dict | None:
        stream = self._fs().open(self._path(f"manifests/{number}.json"))
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            found = json.loads(text)
        except ValueError:  # a writer is at it, or died
            return None
        return found if isinstance(found, dict) else None

    def state(self) -> dict:
        """The newest whole manifest; {} before the first."""
        for n in reversed(self._numbers()):
            if (found := self._manifest(n)) is not None:
                return found
        return {}

    def _put(self, number: int, text: str) -> bool:
        """Create manifest NUMBER; false if it exists."""
        try:
            out = self._fs().create(self._path(f"manifests/{number}.json"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def commit(self, base: dict, parts: dict[str, dict[str, str | None]], **settings: object) -> None:
        """Make PARTS (table -> partition -> version, None: gone) count, given the manifest BASE they were computed from."""
        while True:
            now = self.state()
            for table, changed in parts.items():
                old, seen = base.get("tables", {}).get(table, {}), now.get("tables", {}).get(table, {})
                if any(old.get(k) != seen.get(k) for k in changed):
                    raise ConcurrentChange(f"{table} was changed by another run")
            tables = dict(now.get("tables", {}))
            for table, changed in parts.items():
                tables[table] = {k: v for k, v in (tables.get(table, {}) | changed).items() if v is not None}
            number = max(self._numbers(), default=0) + 1
            if self._put(number, json.dumps(now | settings | {"tables": tables}, sort_keys=True)):
                self._prune()
                return

    def _prune(self) -> None:
        """Delete manifests but the last KEEP and folders that none of these names, unless they are newer than all."""
        fs, numbers = self._fs(), self._numbers()
        kept = [m for n in numbers[-self.KEEP :] if (m := self._manifest(n)) is not None]
        named = {(t, v, k) for m in kept for t, parts in m.get("tables", {}).items() for k, v in parts.items()}
        newest = max((v for _, v, _ in named), default="")
        for n in numbers[: -self.KEEP]:
            fs.delete(self._path(f"manifests/{n}.json"), False)
        for table in self.SCHEMAS:
            for version in self._list(table):
                if version >= newest:
                    continue
                if not any(t == table and v == version for t, v, _ in named):
                    fs.delete(self._path(f"{table}/{version}"), True)
                else:
                    for part in self._list(f"{table}/{version}"):
                        if part.startswith("part=") and (table, version, part[5:]) not in named:
                            fs.delete(self._path(f"{table}/{version}/{part}"), True)

    # ---- tables -----------------------------------------------------------------------------------------------------

    def ensure(self) -> None:
        """Create what is missing; repeated calls change nothing."""
        now = self.state()
        missing = {name: {} for name in self.SCHEMAS if name not in now.get("tables", {})}
        if missing:
            self.commit(now, missing, buckets=now.get("buckets") or list(self._new_buckets))

    def reset(self, fingerprint: str) -> None:
        """Empty tables under a new fingerprint."""
        now = self.state()
        self.commit(now, {name: dict.fromkeys(now.get("tables", {}).get(name, {})) for name in self.SCHEMAS}, fingerprint=fingerprint, dimension=None)

    def _open(self, name: str, parts: dict[str, str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(*[f"{self.root}/{name}/{v}/part={k}" for k, v in sorted(parts.items())])

    def read(self, name: str, content_types: list[str] | None = None) -> DataFrame:
        """A table, or of chunks the partitions of some content types."""
        parts = self.state().get("tables", {}).get(name)
        if parts is None:
            raise IndexNotReady(f"{name} has not been written below {self.root}; run an index first")
        if content_types is not None:
            parts = {k: v for k, v in parts.items() if k.rsplit("-", 2)[0] in content_types}
        return self._open(name, parts)

    def _store(self, name: str, df: DataFrame, part: Column) -> dict[str, str]:
        """Write DF as new folders; partition -> version."""
        wanted: StructType = self.SCHEMAS[name]
        version = "v" + datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
        out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted], part.alias("part"))
        order = {"chunks": ["project", "repo", "path"], "postings": ["field", "term"]}.get(name)
        if order:
            out = out.repartition("part").sortWithinPartitions("part", *order)
        out.write.partitionBy("part").parquet(f"{self.root}/{name}/{version}")
        return {p[5:]: version for p in self._list(f"{name}/{version}") if p.startswith("part=")}

    def write(self, name: str, df: DataFrame) -> None:
        """Replace a whole table other than chunks and their index, which `apply` changes."""
        if name in ("chunks", "postings"):
            raise ValueError("chunks are changed by apply")
        base = self.state()
        self.commit(base, {name: self._whole(base, name, df)})

    def _whole(self, base: dict, name: str, df: DataFrame) -> dict[str, str | None]:
        return dict.fromkeys(base.get("tables", {}).get(name, {})) | self._store(name, df, F.lit("all"))

    def apply(self, new: DataFrame | None = None, paths: DataFrame | None = None, repos: DataFrame | None = None, also: dict[str, DataFrame] | None = None, ledger: tuple[str, DataFrame] | None = None) -> None:
        """One commit: chunks of PATHS (project, repo, path) and REPOS (project, repo, content_type) go, NEW rows replace those
        with their id (of new rows with equal id any one stays), ALSO replaces small tables, and LEDGER (run, rows) adds a
        run's processed changes. Only partitions that hold such chunks are read and written."""
        base = self.state()
        have = base.get("tables", {}).get("chunks", {})
        buckets_of = tuple(base.get("buckets") or self._new_buckets)
        part = part_of(F.col("content_type"), buckets_of)
        suffix = F.substring_index(part_of(F.lit("x"), buckets_of), "-", -2)
        parts: dict[str, dict[str, str | None]] = {}
        settings: dict[str, object] = {}
        touched: set[str] = set()
        if new is not None:
            new = saved(new.select(*[f.name for f in schema.CHUNKS]).dropDuplicates(["id"]), "new")
            sizes = new.agg(F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).where("hi > 0").first()
            if sizes is not None:
                settings["dimension"] = self._dimension(base, sizes["lo"], sizes["hi"])
            buckets = {r[0] for r in new.select(suffix).distinct().collect()}  # at most one a pair of buckets
            touched |= {k for k in have if "-".join(k.rsplit("-", 2)[1:]) in buckets}
        if paths is not None:
            paths = paths.select("project", "repo", "path").distinct()
            buckets = {r[0] for r in paths.select(suffix).distinct().collect()}
            touched |= {k for k in have if "-".join(k.rsplit("-", 2)[1:]) in buckets}
        if repos is not None:
            repos = repos.select("project", "repo", "content_type").distinct()
            of = F.concat_ws("-", "content_type", F.pmod(F.xxhash64("project", "repo"), F.lit(buckets_of[0])))
            kinds = {r[0] for r in repos.select(of).distinct().collect()}
            touched |= {k for k in have if k.rsplit("-", 1)[0] in kinds}
        if new is not None or touched:
            kept = self._open("chunks", {k: have[k] for k in touched})
            if new is not None:
                kept = kept.join(new.select("id"), "id", "left_anti")
            if paths is not None:
                kept = kept.join(paths, ["project", "repo", "path"], "left_anti")
            if repos is not None:
                kept = kept.join(repos, ["project", "repo", "content_type"], "left_anti")
            rows = kept if new is None else kept.unionByName(new)
            stored = self._store("chunks", rows, part)
            parts["chunks"] = dict.fromkeys(touched) | stored
            parts["postings"] = dict.fromkeys(touched) | self._store("postings", postings(self._open("chunks", stored)), part)
        for name, df in (also or {}).items():
            parts[name] = self._whole(base, name, df)
        if ledger is not None:
            run, rows = ledger
            old = base.get("tables", {}).get("processed", {})
            if len(old) >= self.LEDGER_PARTS:
                parts["processed"] = dict.fromkeys(old) | self._store("processed", self._open("processed", old).unionByName(rows.select(*[f.name for f in schema.PROCESSED])), F.lit(run))
            else:
                parts["processed"] = self._store("processed", rows, F.lit(run))
        self.commit(base, parts, **settings)

    @staticmethod
    def _dimension(base: dict, lo: int, hi: int) -> int:
        known = base.get("dimension") or hi
        if hi > schema.LARGEST_DIMENSION or not 0 <= lo == hi == known:
            raise ValueError(f"vectors of {lo} to {hi} numbers; the index holds {known}, at most {schema.LARGEST_DIMENSION} are possible")
        return hi

    def upsert(self, chunks: DataFrame) -> None:
        """Rows replace those with their id."""
        self.apply(new=chunks)

    def replace_paths(self, paths: DataFrame, chunks: DataFrame) -> None:
        """Delete all chunks of PATHS (project, repo, path) and add CHUNKS, in one version."""
        self.apply(new=chunks, paths=paths)

    def replace_repos(self, repos: DataFrame, chunks: DataFrame) -> None:
        """Delete the repositories' chunks of the given content types (project, repo, content_type) and add CHUNKS; other
        types, such as pull requests beside code, stay."""
        self.apply(new=chunks, repos=repos)

    def states_with(self, heads: DataFrame) -> DataFrame:
        """Freshness of all repositories once HEADS (project, repo, commit_hash) are indexed."""
        new = heads.select("project", "repo", "commit_hash").withColumn("indexed_at", utc_now())
        return self.read("repo_index_state").join(new.select("project", "repo"), ["project", "repo"], "left_anti").unionByName(new)

    def record_repos(self, heads: DataFrame) -> None:
        """Freshness of repositories, one row each; after the data, never before."""
        self.write("repo_index_state", self.states_with(heads))

    def record_prs(self, cursor: DataFrame) -> None:
        """Cursors (project, repo, last_pr_id); no row leaves the state as it is."""
        new = cursor.select("project", "repo", "last_pr_id").withColumn("indexed_at", utc_now())
        old = self.read("pr_state").join(new.select("project", "repo"), ["project", "repo"], "left_anti")
        self.write("pr_state", old.unionByName(new))
