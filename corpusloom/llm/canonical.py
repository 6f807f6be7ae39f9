"""Duplicates hidden by formatting (problem 4): canonical bytes, radix partitioning and tries with terminal counters.

The canonical bytes of a text are a kind byte and the UTF-8 of the lower-cased text without anything but letters and
digits; for field languages every line is a field, and the fields that hold a letter or digit are sorted. Repeated rows are
dropped first; then exact copies are counted within each partition, so a group of copies that holds a third of all rows is
an entry or a few of each partition.

Radix partitioning works on the canonical bytes themselves: a bucket is all entries that begin with the same FIRST bytes; a
bucket of more than BUCKET entries or BUCKET_BYTES bytes is split by further bytes, level by level, until each fits. Both
limits are constants. Only the entries of oversized buckets go on to the next level. A bucket that no bytes can split holds
one key (the partial counts of a hot group): it is salted. The tries of the buckets sum the partial counts at their
terminals; where a bucket was salted its sums are added once more.

Defined results: a null text equals no other; texts without letters or digits equal each other; a null language is an
ordinary language; rows with equal id count once; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tokenize import text_slices
from corpusloom.session import saved

FIELD_LANGUAGES = ("yml", "json", "env", "ini")
#: Entries and bytes a bucket may hold, the bytes of the first level, and what a further level multiplies them by.
BUCKET, BUCKET_BYTES, FIRST, FURTHER = 50_000, 32 << 20, 4, 3
#: Distinct keys and bytes a partition counts before it hands them on.
PARTIAL, PARTIAL_BYTES = 200_000, 64 << 20
#: Repeated ids up to which they are broadcast (counted; about 60 bytes each).
REPEATED = 500_000
#: Rows of one key from which its members are joined by broadcast of the few hot keys instead of by shuffle.
HOT = 20_000


def letters_digits(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def canonical_bytes(text: Column, language: Column | None = None) -> Column:
    """Canonical bytes of a text, the kind byte first."""
    plain = F.concat(F.lit("T"), letters_digits(text))
    if language is not None:
        fields = F.array_join(F.array_sort(F.filter(F.transform(F.split(text, "\r\n|\r|\n"), letters_digits), lambda x: x != "")), "\n")
        plain = F.when(F.lower(language).isin(*FIELD_LANGUAGES), F.concat(F.lit("F"), fields)).otherwise(plain)
    return F.encode(plain, "utf-8")


def canonical_key(text: Column, language: Column | None = None) -> Column:
    """Digest of the canonical bytes: of bounded length, for joins."""
    return F.unhex(F.sha2(canonical_bytes(text, language), 256))


class Trie:
    """Byte trie whose nodes are expanded only where two keys meet; leaves are terminals with counter and smallest id."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, count: int, least: str) -> None:
        node, d = self.root, 0
        while True:
            c = key[d] if d < len(key) else -1
            nxt = node.get(c)
            if nxt is None:
                node[c] = [key, count, least]
                return
            if isinstance(nxt, list):
                if nxt[0] == key:
                    nxt[1] += count
                    nxt[2] = min(nxt[2], least)
                    return
                node[c] = inner = {}
                inner[nxt[0][d + 1] if d + 1 < len(nxt[0]) else -1] = nxt
                nxt = inner
            node, d = nxt, d + 1

    def terminals(self):
        stack = [self.root]
        while stack:
            for v in stack.pop().values():
                if isinstance(v, dict):
                    stack.append(v)
                else:
                    yield v


def partial_counts(rows: DataFrame) -> DataFrame:
    """canon, n, least of the rows (id, canon) of every partition; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(found.keys(), pa.binary()), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.string())]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, names=["canon", "n", "least"])

        for batch in text_slices(batches):
            for i, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = found.get(key)
                if x is None:
                    found[key] = [1, i]
                    held += len(key)
                else:
                    x[0] += 1
                    x[1] = min(x[1], i)
            if len(found) > PARTIAL or held > PARTIAL_BYTES:
                yield flush()
                held = 0
        yield flush()

    return rows.select("id", "canon").mapInArrow(run, "canon binary, n long, least string")


def radix_buckets(entries: DataFrame, limit: int = BUCKET, limit_bytes: int = BUCKET_BYTES, first: int = FIRST) -> DataFrame:
    """ENTRIES (canon binary, n, least) with columns bucket (long) and salted: the entries of a bucket agree in as many
    leading bytes as it took to bring it below the limits.

    A bucket's name is a hash of its leading bytes; names that meet by chance share a trie, which changes nothing.
    """
    size = F.length("canon")
    out, left, depth = None, entries, first
    while True:
        named = left.withColumn("bucket", F.xxhash64(F.lit(depth), F.substring("canon", 1, depth)))
        sizes = named.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"), F.max(size).alias("longest"))
        over = saved(sizes.where((F.col("rows") > limit) | (F.col("bytes") > limit_bytes) & (F.col("rows") > 1)), "over")
        many = over.count()
        if not many:
            fits = named.withColumn("salted", F.lit(False))
            return fits if out is None else out.unionByName(fits)
        over = over if many > 100_000 else F.broadcast(over)
        fits = named.join(over.select("bucket"), "bucket", "left_anti").withColumn("salted", F.lit(False))
        # one key cannot be split by bytes; its entries are partial counts, each of at least one partition's flush
        salts = F.ceil(F.greatest(F.col("rows") / limit, F.col("bytes") / limit_bytes))
        one = named.join(over.where(F.col("longest") <= depth), "bucket").withColumn("bucket", F.xxhash64("bucket", F.pmod(F.xxhash64("least", "n"), salts))).withColumn("salted", F.lit(True))
        fits = fits.unionByName(one.select(*fits.columns))
        out = fits if out is None else out.unionByName(fits)
        left = saved(named.join(over.where(F.col("longest") > depth).select("bucket"), "bucket", "left_semi").drop("bucket"), "left")
        depth *= FURTHER


def count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One trie a bucket; the rows (bucket, salted, canon, n, least) come with each bucket's together."""
    trie, now = Trie(), None

    def sums() -> pa.RecordBatch:
        found = list(trie.terminals())
        columns = [pa.array([hashlib.sha256(k).digest() for k, _, _ in found], pa.binary()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([i for _, _, i in found], pa.string()), pa.array([bool(now and now[1])] * len(found), pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["key", "n", "least", "salted"])

    held: list[pa.RecordBatch] = []  # many buckets are small: their sums go out together
    for batch in batches:
        for bucket, salted, key, n, least in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (bucket, salted) != now:
                held.append(sums())
                trie, now = Trie(), (bucket, salted)
                if sum(x.num_rows for x in held) > 10_000 or len(held) > 2000:
                    yield pa.concat_batches(held)
                    held.clear()
            trie.add(key, n, least)
    yield pa.concat_batches([*held, sums()])


def keyed(chunks: DataFrame) -> DataFrame:
    """id, canonical bytes and a number of every row, stored; a row stored twice has id and bytes equal."""
    rows = chunks.where("text is not null and id is not null").select("id", canonical_bytes(F.col("text"), F.col("language")).alias("canon"))
    return numbered(rows)


def numbered(rows: DataFrame) -> DataFrame:
    return saved(rows.withColumn("uid", F.monotonically_increasing_id()), "canon")


def each_once(rows: DataFrame) -> DataFrame:
    """ROWS (id, canon, uid) without repeated ids: only ids are shuffled, the few repeated ones come back to the texts."""
    twice = saved(rows.groupBy("id").agg(F.count("*").alias("times"), F.min("uid").alias("first")).where("times > 1").select("id", "first"), "twice")
    twice = F.broadcast(twice) if twice.count() <= REPEATED else twice
    return rows.join(twice, "id", "left").where("first is null or uid = first").drop("first", "uid")


def key_counts(rows: DataFrame, **limits: int) -> DataFrame:
    """key (digest), n, least of every group of equal rows (id, canon), groups of one row included."""
    entries = saved(partial_counts(each_once(rows if "uid" in rows.columns else numbered(rows))), "entries")
    order = ["bucket", "salted"]
    tries = radix_buckets(entries, **limits).select(*order, "canon", "n", "least").repartition(*order).sortWithinPartitions(*order)
    counted = saved(tries.mapInArrow(count_buckets, "key binary, n long, least string, salted boolean"), "counted")
    again = counted.where("salted").groupBy("key").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    return counted.where("not salted").drop("salted").unionByName(again)


def copy_groups(rows: DataFrame) -> DataFrame:
    """key, n, least of every group of two or more equal rows (id, canon)."""
    return key_counts(rows).where("n > 1")


def copies(chunks: DataFrame) -> DataFrame:
    """keep_id and copy_id of every copy."""
    rows = keyed(chunks)
    groups = saved(copy_groups(rows), "groups")
    rows = rows.select("id", F.unhex(F.sha2("canon", 256)).alias("key"))
    hot = groups.where(F.col("n") > HOT)  # at most rows / HOT keys
    cold = groups.where(F.col("n") <= HOT)
    many = hot.count() > 10_000
    pairs = rows.join(cold, "key").unionByName(rows.join(hot if many else F.broadcast(hot), "key"))
    return pairs.where("id <> least").select(F.col("least").alias("keep_id"), F.col("id").alias("copy_id")).distinct()


def copy_counts(chunks: DataFrame) -> DataFrame:
    """keep_id and n_copies of every distinct text, unique ones included."""
    return key_counts(keyed(chunks)).select(F.col("least").alias("keep_id"), F.col("n").alias("n_copies"))
