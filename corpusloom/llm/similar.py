"""Most similar vectors for every vector (problem 1) by an inverted multi-index.

Both halves of the unit vectors are quantised separately with K centroids each, fitted by k-means on a sample of at most
SAMPLE vectors a centroid; every vector is indexed under its pair of centroids. A query walks the centroid pairs in order of
the summed distance with a heap (multi-sequence traversal) until the pairs' lists hold enough vectors, and reranks these by
cosine. K grows with the root of the collection up to LARGEST_K, so lists keep their length and the work grows in
proportion; beyond, at 50 million vectors, lists grow and a query takes the more of them: CANDIDATES, or LISTS lists' worth
where that is more. Lists live in blocks of neighbouring centroids, of the first half and, where a centroid of it has
more than a block, of both; the number of blocks grows with the collection. Centroids of the first half that the walks of a
sample meet together are then moved into the same block, as far as blocks stay of like size. A query travels once to each block it touches, as
16 bit integers, and without its vector to the block that holds this anyway; the queries of a block are spread over tasks of
about BLOCK_QUERIES (counted on a sample), its vectors (one dense list) over tasks of BLOCK_ROWS. A task returns one row a query.

Equal vectors are one entry of the index with their six smallest ids: however many copies a vector has, each copy's
neighbours among them are those, so no group of copies is ever paired with itself. Only rows of repeated vectors are shuffled
to find one of each. Neighbours with one id each are paired by vector and named afterwards; ids are ranked for the others only.

Defined results: null vectors, other lengths than DIM, null or NaN components and all-zero vectors are left out; rows with
equal id count once; ties go to the smaller id; with fewer than k + 1 usable rows each gets all others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.sums import SLICED, SLICES, by_slice, tree_sum
from corpusloom.session import saved

DIM = 96
#: Vectors a walk collects at least, and in lists of average length.
CANDIDATES, LISTS = 400, 24
#: Vectors of the fitting sample by centroid and at least; with LARGEST_K at most about 160,000 come to the driver (64 MB).
SAMPLE, LEAST_SAMPLE = 40, 24_000
#: The lists' counts, LARGEST_K squared numbers of 4 bytes, are broadcast.
ROWS_A_CELL, LARGEST_K = 3, 4096
#: Nearest centroids of each half that are sorted at first.
WIDTH = 64
BLOCK_ROWS, BLOCK_QUERIES, ROWS_A_BLOCK = 65_536, 65_536, 32_768
#: Partitions the blocks are spread over at most; beyond, a task holds several blocks one after the other.
PARTITIONS = 20_000
#: Queries whose walks tell which centroids belong together and how many queries come to a block.
ASKED_SAMPLE = 4_000
#: Vectors up to which a set of them is broadcast (counted; 8 bytes each); beyond, a shuffle join.
FEW = 1_000_000


def usable(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """id, vid (equal for equal vectors) and embedding of the usable rows."""
    e = F.col("embedding")
    good = (F.size(e) == dim) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x)) & F.exists(e, lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & e.isNotNull() & good).select("id", F.xxhash64(e).alias("vid"), e.cast("array<float>").alias("embedding"))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances but for what is equal in a row."""
    return (c * c).sum(1) - 2 * (x @ c.T)


def nearest_centroids(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(64, (1 << 22) // len(c))
    return np.concatenate([np.argmin(distances(x[i : i + step], c), axis=1) for i in range(0, len(x), step)])


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = nearest_centroids(x, c)
        order = np.argsort(near, kind="stable")
        n = np.bincount(near, minlength=k)
        full = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0)
        c[full] = sums / n[full, None]
        if len(full) < k:
            c[n == 0] = x[rng.choice(len(x), k - len(full))]
    return c


def blocks_of(c: np.ndarray, blocks: int, weight: np.ndarray) -> np.ndarray:
    """Block of each centroid: halving by weight (vectors a centroid has) along the widest direction, so that neighbours
    share a block and blocks are of like size."""
    out = np.zeros(len(c), np.int32)
    parts = [np.arange(len(c))]
    while len(parts) < blocks:
        parts.sort(key=lambda p: (len(p) > 1, weight[p].sum()))
        p = parts.pop()
        if len(p) < 2:
            parts.append(p)
            break
        x = c[p] - c[p].mean(0)
        direction = np.linalg.svd(x, full_matrices=False)[2][0]
        p = p[np.argsort(x @ direction, kind="stable")]
        half = np.cumsum(weight[p])
        cut = min(max(1, int(np.searchsorted(half, half[-1] / 2)) + 1), len(p) - 1)
        parts += [p[:cut], p[cut:]]
    for b, p in enumerate(parts):
        out[p] = b
    return out


def gathered(blocks: np.ndarray, met: list[set[int]], weight: np.ndarray, room: float = 1.25, rounds: int = 8) -> np.ndarray:
    """Blocks of centroids such that the queries that MET these sets of them touch fewer blocks: a centroid moves where it
    saves most, while no block outgrows ROOM times the mean, or the largest there was."""
    out, n = blocks.copy(), int(blocks.max()) + 1
    inside = np.zeros((len(met), n), np.int16)
    by: list[list[int]] = [[] for _ in out]
    for i, mine in enumerate(met):
        for c in mine:
            inside[i, out[c]] += 1
            by[c].append(i)
    load = np.bincount(out, weights=weight, minlength=n)
    most = max(room * load.mean(), load.max())
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0
        for c in rng.permutation(len(out)).tolist():
            a, rows = out[c], inside[by[c]]
            gain = (rows[:, a] == 1).sum() - (rows == 0).sum(axis=0)
            gain[a] = 0
            gain[load + weight[c] > most] = 0
            z = int(gain.argmax())
            if gain[z] > 0:
                inside[by[c], a] -= 1
                inside[by[c], z] += 1
                load[a] -= weight[c]
                load[z] += weight[c]
                out[c] = z
                moved += 1
        if moved <= len(out) // 100:
            break
    return out


def walk(l1: list[int], d1: list[float], l2: list[int], d2: list[float], counts, k: int, want: int, whole: bool = True) -> list[int] | None:
    """Cells by rising summed distance until they hold WANT vectors: the multi-sequence traversal. Lists that are not WHOLE
    give None if their end is reached before."""
    heap = [(d1[0] + d2[0], 0, 0)]
    cells, got = [], 0
    m, n = len(l1), len(l2)
    while heap and got < want:
        _, i, j = heapq.heappop(heap)
        c = l1[i] * k + l2[j]
        if counts[c]:
            cells.append(c)
            got += counts[c]
        if not whole and got < want and (j + 1 == n or j == 0 and i + 1 == m):
            return None
        if j + 1 < n:
            heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
        if j == 0 and i + 1 < m:
            heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
    return cells


def cells_of(d1: np.ndarray, d2: np.ndarray, counts, k: int, want: int, width: int = WIDTH) -> Iterator[list[int]]:
    """The cells of every row of distances to the centroids of both halves: first from the WIDTH nearest centroids of each
    half, and from all of them where those do not suffice."""
    width = min(k, width)
    near = []
    for d in (d1, d2):
        o = np.argpartition(d, width - 1, axis=1)[:, :width] if width < k else np.tile(np.arange(k), (len(d), 1))
        v = np.take_along_axis(d, o, 1)
        s = np.argsort(v, axis=1)
        near.append((np.take_along_axis(o, s, 1).tolist(), np.take_along_axis(v, s, 1).tolist()))
    (l1, v1), (l2, v2) = near
    for i in range(len(d1)):
        cells = walk(l1[i], v1[i], l2[i], v2[i], counts, k, want, width == k)
        if cells is None:
            o1, o2 = np.argsort(d1[i]), np.argsort(d2[i])
            cells = walk(o1.tolist(), d1[i][o1].tolist(), o2.tolist(), d2[i][o2].tolist(), counts, k, want)
        yield cells


def as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def packed(x: np.ndarray) -> list[bytes]:
    """Unit vectors as 16 bit integers; only the direction counts."""
    scale = 32767 / np.abs(x).max(axis=1, keepdims=True)
    return [r.tobytes() for r in np.rint(x * scale).astype(np.int16)]


def unpacked(column, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column), np.int16).reshape(-1, dim).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def opened(cells: bytes, k: int) -> Iterator[int]:
    """The lists that a query names within a block."""
    a, i = np.frombuffer(cells, np.uint16).tolist(), 0
    while i < len(a):
        first, n = a[i] * k, a[i + 1]
        for two in a[i + 2 : i + 2 + n]:
            yield first + two
        i += 2 + n


def nearest(vectors: pa.Table, queries: pa.Table, top: int, dim: int, k: int) -> pa.Table:
    """Rerank within a block: TOP most similar (v, by rising d, the negated cosine) of each query's cells."""
    out = pa.schema([("q", pa.int64()), ("v", pa.list_(pa.int64())), ("d", pa.list_(pa.float32()))])
    if not vectors.num_rows or not queries.num_rows:
        return out.empty_table()
    cell, vid = vectors["cell"].to_numpy(), vectors["vid"].to_numpy()
    order = np.argsort(cell, kind="stable")
    cell, vid, x = cell[order], vid[order], unpacked(vectors["vec"].to_pylist(), dim)[order]
    names, starts = np.unique(cell, return_index=True)
    ends = [*starts[1:].tolist(), len(cell)]
    at = {c: (s, e) for c, s, e in zip(names.tolist(), starts.tolist(), ends)}
    me = queries["vid"].to_numpy()
    by_vid = np.argsort(vid)
    v, d = np.zeros((len(me), top + 1), np.int64), np.full((len(me), top + 1), np.inf, np.float32)
    for start in range(0, len(me), 16_384):
        some = queries.slice(start, 16_384)
        sent = some["vec"].is_valid().to_numpy()
        q = np.empty((len(sent), dim), np.float32)
        if sent.any():
            q[sent] = unpacked(some["vec"].drop_null().to_pylist(), dim)
        q[~sent] = x[by_vid[np.searchsorted(vid, some["vid"].to_numpy()[~sent], sorter=by_vid)]]
        for i, cells in enumerate(some["cells"].to_pylist(), start):
            spans = [at[c] for c in opened(cells, k) if c in at]
            if not spans:
                continue
            far = -np.concatenate([x[s:e] @ q[i - start] for s, e in spans])
            ids = np.concatenate([vid[s:e] for s, e in spans])
            if len(far) > top + 1:
                best = np.argpartition(far, top)[: top + 1]
                far, ids = far[best], ids[best]
            v[i, : len(far)], d[i, : len(far)] = ids, far
    d[v == me[:, None]] = np.inf
    best = np.lexsort((v, d), axis=1)[:, :top]
    v, d = np.take_along_axis(v, best, 1), np.take_along_axis(d, best, 1)
    good = d < np.inf
    some = good.any(axis=1)
    offsets = np.concatenate([[0], np.cumsum(good.sum(axis=1)[some])]).astype(np.int32)
    return pa.Table.from_arrays([pa.array(me[some]), pa.ListArray.from_arrays(offsets, v[good]), pa.ListArray.from_arrays(offsets, d[good])], schema=out)


def fit(rows: DataFrame, n: int, dim: int) -> dict:
    """Centroids of both halves and their blocks, from a sample of bounded size."""
    k = int(min(LARGEST_K, max(2, 2 ** round(np.log2(max(1, n / ROWS_A_CELL) ** 0.5)))))
    most = max(LEAST_SAMPLE, SAMPLE * k)
    share = min(1.0, most / max(n, 1))
    sample = rows.where(F.pmod(F.xxhash64("vid"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).select("embedding").limit(2 * most)
    x = unit(as_matrix(sample.toArrow()["embedding"].combine_chunks(), dim))
    half = dim // 2
    c1, c2 = kmeans(x[:, :half], k), kmeans(x[:, half:], k)
    blocks = -(-n // ROWS_A_BLOCK)
    weights = [np.bincount(nearest_centroids(h, c), minlength=k) + 1.0 for h, c in ((x[:, :half], c1), (x[:, half:], c2))]
    b1, b2 = blocks_of(c1, min(k, blocks), weights[0]), blocks_of(c2, min(k, -(-blocks // k)), weights[1])
    return {"k": k, "c1": c1, "c2": c2, "b1": b1, "b2": b2, "wide": int(b2.max()) + 1, "asked": x[:: -(-len(x) // ASKED_SAMPLE)]}


def list_sizes(index: DataFrame, k: int) -> np.ndarray:
    """Vectors in every list."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(max(k * k, SLICES), np.int32)
        for batch in batches:
            at, n = np.unique(batch.column(0).to_numpy(), return_counts=True)
            cells[at] += n.astype(np.int32)
        yield by_slice(cells)

    cells = index.select("cell")
    return tree_sum(cells.mapInArrow(count, SLICED), cells.rdd.getNumPartitions(), max(k * k, SLICES), np.int32, np.add)[: k * k]


def indexed(rows: DataFrame, model, dim: int) -> DataFrame:
    """vid, cell, vec of every row: all vectors are indexed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, half = model.value, dim // 2
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(as_matrix(batch.column(1), dim))
            near = [nearest_centroids(h, c) for h, c in ((x[:, :half], m["c1"]), (x[:, half:], m["c2"]))]
            cell = near[0] * m["k"] + near[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array(packed(x), pa.binary())], names=["vid", "cell", "vec"])

    return rows.select("vid", "embedding").mapInArrow(run, "vid long, cell int, vec binary")


def walks(x: np.ndarray, m: dict, counts: np.ndarray, want: int) -> Iterator[list[int]]:
    """The cells every vector's query looks into."""
    k, half, n = m["k"], x.shape[1] // 2, memoryview(counts)
    step = max(64, min(4096, (1 << 22) // k))
    for i in range(0, len(x), step):
        y = x[i : i + step]
        yield from cells_of(distances(y[:, :half], m["c1"]), distances(y[:, half:], m["c2"]), n, k, want)


def blocks_at(cell: np.ndarray, m: dict) -> np.ndarray:
    """The block that holds each list."""
    return m["b1"][cell // m["k"]] * m["wide"] + m["b2"][cell % m["k"]]


def queries_sent(m: dict, x: np.ndarray, met: list[list[int]], n: int, whole: np.ndarray) -> np.ndarray:
    """About how many of N vectors' queries come to each block with their vector, by the cells that the queries X of a sample
    MET; to their own block, if it is WHOLE, they come without."""
    half = x.shape[1] // 2
    home = blocks_at(nearest_centroids(x[:, :half], m["c1"]) * m["k"] + nearest_centroids(x[:, half:], m["c2"]), m).tolist()
    sent = np.zeros(len(whole))
    for mine, cells in zip(home, met):
        sent[[b for b in set(blocks_at(np.array(cells), m).tolist()) if b != mine or not whole[b]]] += 1
    return sent * (n / len(x))


def probes(index: DataFrame, model, counts, whole: np.ndarray, want: int, dim: int) -> DataFrame:
    """vid, block, cells, vec: the cells each vector's query looks into, by block; no vec where the block is WHOLE in each of
    its tasks and holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        k, b1, b2 = m["k"], (m["b1"] * m["wide"]).tolist(), m["b2"].tolist()
        for all_rows in batches:
            for at in range(0, all_rows.num_rows, 4096):
                batch = all_rows.slice(at, 4096)
                home = blocks_at(batch.column(2).to_numpy(), m).tolist()
                rows, blocks, cells, held = [], [], [], []
                for i, mine in enumerate(walks(unpacked(batch.column(1).to_pylist(), dim), m, counts.value, want)):
                    by: dict[int, dict[int, list[int]]] = {}
                    for c in mine:
                        one, two = divmod(c, k)
                        by.setdefault(b1[one] + b2[two], {}).setdefault(one, []).append(two)
                    for b, lists in by.items():
                        rows.append(i)
                        blocks.append(b)
                        held.append(b == home[i] and bool(whole[b]))
                        # first centroid, number of second centroids, second centroids
                        cells.append(np.array([x for one, twos in lists.items() for x in (one, len(twos), *twos)], np.uint16).tobytes())
                pick = np.array(rows, np.int64)
                sent = batch.column(1).take(pa.array(pick, mask=np.array(held, bool)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pick)), pa.array(blocks, pa.int32()), pa.array(cells, pa.binary()), sent], names=["vid", "block", "cells", "vec"])

    return index.select("vid", "vec", "cell").mapInArrow(run, "vid long, block int, cells binary, vec binary")


def small(vids: DataFrame, what: str) -> DataFrame:
    """A stored set, broadcast in joins if there are few."""
    vids = saved(vids, what)
    return F.broadcast(vids) if vids.count() <= FEW else vids


def members_of(good: DataFrame) -> DataFrame:
    """id, vid, n of the distinct (id, vid) and the number of their rows; n is null for an id of several vectors."""
    ids = saved(good.groupBy("id").agg(F.min("vid").alias("vid"), F.max("vid").alias("last"), F.count("*").alias("n")), "ids")
    one = ids.where("vid = last").select("id", "vid", "n")
    several = ids.where("vid <> last").select("id")
    if several.isEmpty():
        return one
    several = small(several, "several")
    return saved(one.unionByName(good.join(several, "id", "left_semi").select("id", "vid").distinct().withColumn("n", F.lit(None).cast("long"))), "members")


def similar_pairs(rows: DataFrame, top: int = 5, want: int = CANDIDATES, dim: int = DIM) -> DataFrame:
    """id_a < id_b of rows (id, embedding) of which one is among the TOP most similar of the other."""
    spark = rows.sparkSession
    good = usable(rows, dim)
    members = members_of(good)
    n = members.count()
    empty = spark.createDataFrame([], "id_a string, id_b string")
    if n < 2:
        return empty
    members, repeated = members.select("id", "vid"), members.groupBy("vid").agg(F.count("*").alias("ids"), F.sum("n").alias("rows"), F.count("n").alias("known")).where("rows is null or rows > 1 or known < ids")
    # vectors of several rows, and of these the ones that have several ids or an id of several vectors
    again = saved(repeated, "again")
    several = small(again.where("ids > 1 or known < ids").select("vid"), "several")
    again = F.broadcast(again.select("vid")) if again.count() <= FEW else again.select("vid")
    model = fit(good, n, dim)
    k, wide, sample = model["k"], model["wide"], model.pop("asked")
    sent = spark.sparkContext.broadcast(model)
    once = indexed(good.join(again, "vid", "left_anti"), sent, dim)
    index = saved(once.unionByName(indexed(good.join(again, "vid", "left_semi"), sent, dim).dropDuplicates(["vid"])), "index")
    sizes = list_sizes(index, k)
    want = max(want, -(-LISTS * n // (k * k)))
    met = list(walks(sample, model, sizes, want))
    model = model | {"b1": gathered(model["b1"], [{c // k for c in cells} for cells in met], sizes.reshape(k, k).sum(axis=1).astype(float))}
    sent = spark.sparkContext.broadcast(model)
    per_block = np.zeros((int(model["b1"].max()) + 1, wide), np.int64)
    for i in range(k):
        per_block[model["b1"][i]] += np.bincount(model["b2"], weights=sizes[i * k : (i + 1) * k], minlength=wide).astype(np.int64)
    per_block = per_block.ravel()
    # a task takes BLOCK_QUERIES of a block's queries, or more where that would copy the block's vectors too often, and
    # BLOCK_ROWS vectors of a dense list
    vs = np.maximum(1, -(-per_block // BLOCK_ROWS))
    qs = np.maximum(1, np.ceil(np.minimum(4 * per_block, queries_sent(model, sample, met, n, vs == 1)) / BLOCK_QUERIES)).astype(int)
    first = np.cumsum(vs * qs) - vs * qs
    tasks = int((vs * qs).sum())
    asked = probes(index, sent, spark.sparkContext.broadcast(sizes), vs == 1, want, dim)
    at = lambda of, c: F.element_at(F.lit([int(b) for b in of]), c.cast("int") + 1)
    held = index.withColumn("block", at(model["b1"] * wide, F.floor(F.col("cell") / k)) + at(model["b2"], F.col("cell") % k))
    splits = spark.createDataFrame([(b, int(f), int(v), int(q)) for b, (f, v, q) in enumerate(zip(first, vs, qs))], "block int, first int, vs int, qs int")  # n / ROWS_A_BLOCK rows
    splits = F.broadcast(splits) if len(per_block) <= 100_000 else splits
    salts = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    held = held.join(splits, "block").withColumn("qsalt", salts("qs")).select((F.col("first") + F.pmod(F.xxhash64("vid"), F.col("vs")).cast("int") * F.col("qs") + F.col("qsalt")).alias("task"), "vid", "cell", "vec")
    asked = asked.join(splits, "block").withColumn("vsalt", salts("vs")).select((F.col("first") + F.col("vsalt") * F.col("qs") + F.pmod(F.hash("vid"), F.col("qs")).cast("int")).alias("task"), "vid", "cells", "vec")
    parts = min(PARTITIONS, max(8 * tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = held.repartition(parts, "task").groupBy("task").cogroup(asked.repartition(parts, "task").groupBy("task")).applyInArrow(lambda a, b: nearest(a, b, top, dim, k), "q long, v array<long>, d array<float>")
    # the few best classes of each class; six ids a class suffice
    best = found.repartition("q").groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "v")))), 1, top).alias("near"))
    best = saved(best.select("q", F.explode("near").alias("e")).select("q", "e.d", "e.v"), "near")
    return named(best, members, several, top)


def named(best: DataFrame, members: DataFrame, several: DataFrame, top: int) -> DataFrame:
    """id_a < id_b of the members (id, vid) by the TOP best classes (q, d, v) of each class; SEVERAL are the classes with more
    than one id, or with an id that other classes have too. What has to do with none of them is a matter of classes only."""
    is_several = lambda c: several.withColumnRenamed("vid", c)
    ranked = small(several.union(best.join(is_several("v"), "v", "left_semi").select("q")).distinct(), "ranked")
    plain = best.join(ranked.withColumnRenamed("vid", "q"), "q", "left_anti").select(F.least("q", "v").alias("lo"), F.greatest("q", "v").alias("hi"))
    rest = best.join(ranked.withColumnRenamed("vid", "q"), "q", "left_semi")
    asking = members.join(ranked, "vid", "left_semi")
    shown = small(rest.select(F.col("v").alias("vid")).union(ranked).distinct(), "shown")
    rank = F.row_number().over(Window.partitionBy("vid").orderBy("id"))
    heads = members.join(shown, "vid", "left_semi").withColumn("rn", rank).where(F.col("rn") <= top + 1).groupBy("vid").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    heads = saved(heads, "heads")
    lists = rest.join(heads.withColumnRenamed("vid", "v"), "v").select("q", "v", F.explode(F.slice("ids", 1, top)).alias("id"), "d").groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id", "v"))), 1, top).alias("far"))
    known = heads.join(lists, heads["vid"] == lists["q"], "left").select("vid", F.transform("ids", lambda x: F.struct(x.alias("id"), F.col("vid").alias("v"))).alias("own"), F.transform(F.coalesce("far", F.array().cast("array<struct<d:float,id:string,v:bigint>>")), lambda x: F.struct(x["id"].alias("id"), x["v"].alias("v"))).alias("far"))
    me = F.col("id")
    others = asking.join(known, "vid").select("id", "vid", F.explode(F.slice(F.concat(F.filter("own", lambda x: x["id"] != me), F.col("far")), 1, top)).alias("other")).select("id", "vid", F.col("other.id").alias("other"), F.col("other.v").alias("v"))
    mark = lambda c, m: several.select(F.col("vid").alias(c), F.lit(True).alias(m))
    others = saved(others.join(mark("vid", "a"), "vid", "left").join(mark("v", "b"), "v", "left").withColumn("plain", F.col("a").isNull() & F.col("b").isNull()), "others")
    edges = plain.union(others.where("plain").select(F.least("vid", "v"), F.greatest("vid", "v"))).where("lo is not null and hi is not null")
    edges = edges.repartition("lo").dropDuplicates(["lo", "hi"])
    names = members.where("id is not null and vid is not null").join(several, "vid", "left_anti").repartition("vid")  # one shuffle serves both joins
    pairs = edges.join(names.select(F.col("vid").alias("lo"), F.col("id").alias("a")), "lo").join(names.select(F.col("vid").alias("hi"), F.col("id").alias("b")), "hi").select("a", "b")
    order = lambda df, a, b: df.select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"))
    return order(pairs, "a", "b").unionByName(order(others.where("not plain"), "id", "other").distinct())
