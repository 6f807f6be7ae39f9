"""Filling fixed-capacity containers (problem 9) by hierarchical residual packing.

Level 0: items are hashed into parts of about ITEMS_A_PART and packed best-fit decreasing within each part. Bins filled to
at least 1 - TOLERANCE are done; of the underfull ones only name and fill go up as items of the next level, where FAN_IN
parts are merged and packed again, up to one part. What a level merges is a small table of renamed bins; the members are
joined with it once at the end.

What goes up is bounded without loss. Best fit leaves at most one bin of a part filled to half or less, and two bins above
half never fit together, so a merge of FAN_IN parts can use at most FAN_IN bins of any one fill: of each fill a part hands
on the first FAN_IN, and the others could not have been used. A task so meets at most FAN_IN * FAN_IN bins of each of at
most capacity / 2 fills, whatever the data.

Defined results: an item above the capacity is split into full containers and a rest, which is packed; items of size 0
or null take no space and come out with a null container; repeated item keys are separate items only by their key and
piece, so callers give distinct keys.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import saved

ITEMS_A_PART, FAN_IN, TOLERANCE = 20_000, 8, 0.002

#: Merged bins up to which their new names are broadcast (counted; about 60 bytes each).
RENAMED = 500_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: positions of SIZES by bin. A bitmap of the rooms in use finds the tightest bin at once."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, bins = 0, []
    for k in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[k]
        fitting = used >> s
        if fitting:
            room = s + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                used ^= 1 << room
            bins[b].append(k)
        else:
            room, b = capacity, len(bins)
            bins.append([k])
        left = room - s
        if left:
            rooms[left].append(b)
            used |= 1 << left
    return bins


def handed_on(bins: list[tuple[str, int]], capacity: int) -> list[bool]:
    """Which bins (name, fill) of a packed part go up."""
    seen: Counter[int] = Counter()
    up = [False] * len(bins)
    for k in sorted(range(len(bins)), key=lambda i: bins[i][0]):
        fill = bins[k][1]
        if fill < capacity * (1 - TOLERANCE):
            seen[fill] += 1
            up[k] = seen[fill] <= FAN_IN
    return up


def pack_items(pdf: pd.DataFrame) -> pd.DataFrame:
    """Level 0: the items of a part with their bins; the first row of a bin that goes up carries its fill."""
    capacity = int(pdf["capacity"].iat[0])
    pdf = pdf.sort_values("bin", kind="stable").reset_index(drop=True)
    names, sizes = pdf["bin"].tolist(), pdf["tokens"].tolist()
    members = best_fit(sizes, capacity)
    bins = [(min(names[k] for k in m), sum(sizes[k] for k in m)) for m in members]
    name, fill = [""] * len(pdf), np.zeros(len(pdf), np.int32)
    for m, (bin_name, total), up in zip(members, bins, handed_on(bins, capacity)):
        for k in m:
            name[k] = bin_name
        if up:
            fill[m[0]] = total
    pdf["bin"], pdf["fill"] = name, fill
    return pdf[["budget_id", "capacity", "part", "item", "piece", "tokens", "bin", "fill"]]


def pack_bins(pdf: pd.DataFrame) -> pd.DataFrame:
    """A further level: bins of merged parts; `was` is a bin's old name, `fill` is set on one row of a bin that goes up."""
    capacity = int(pdf["capacity"].iat[0])
    pdf = pdf.sort_values("bin", kind="stable").reset_index(drop=True)
    names, fills = pdf["bin"].tolist(), pdf["fill"].tolist()
    members = best_fit(fills, capacity)
    bins = [(min(names[k] for k in m), sum(fills[k] for k in m)) for m in members]
    rows = []
    for m, (name, total), up in zip(members, bins, handed_on(bins, capacity)):
        rows += [(names[k], name, total if up and k == m[0] else 0) for k in m if len(m) > 1 or up]
    out = pd.DataFrame(rows, columns=["was", "bin", "fill"])
    out["budget_id"], out["capacity"], out["part"] = pdf["budget_id"].iat[0], capacity, pdf["part"].iat[0]
    return out[["budget_id", "capacity", "part", "was", "bin", "fill"]]


def pack(items: DataFrame, budgets: DataFrame) -> DataFrame:
    """budget_id, container_id, item, piece, tokens of every item (columns item long, tokens int) for every budget.

    budgets: budget_id, capacity_tokens; a fixed small table that is broadcast after its size has been read.
    """
    rows = budgets.select("budget_id", "capacity_tokens").where("capacity_tokens > 0").distinct()
    caps = [(int(r[0]), int(r[1])) for r in rows.limit(1001).collect()]
    if len(caps) > 1000:
        raise ValueError("more than 1000 container sizes")
    spark = items.sparkSession
    sized = saved(items.select(F.col("item").cast("long").alias("item"), F.coalesce(F.col("tokens"), F.lit(0)).alias("tokens")), "sizes")
    n = sized.count()
    cross = sized.withColumn("b", F.explode(F.array(*[F.struct(F.lit(b).alias("budget_id"), F.lit(c).alias("capacity")) for b, c in caps]) if caps else F.array().cast("array<struct<budget_id:int,capacity:int>>"))).select("item", "tokens", "b.budget_id", "b.capacity")
    pieces = cross.where("tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / F.col("capacity")).cast("int")))).withColumn("tokens", F.least(F.col("capacity"), F.col("tokens") - F.col("piece") * F.col("capacity")))
    parts = max(1, -(-n // ITEMS_A_PART))
    level = pieces.select(
        "budget_id",
        "capacity",
        F.pmod(F.xxhash64("item", "piece"), F.lit(parts)).alias("part"),
        F.concat_ws(".", F.lpad(F.col("item").cast("string"), 20, "0"), "piece").alias("bin"),
        "item",
        "piece",
        "tokens",
    )
    packed = saved(level.groupBy("budget_id", "part").applyInPandas(pack_items, "budget_id int, capacity int, part long, item long, piece int, tokens int, bin string, fill int"), "items")
    bins = packed.where("fill > 0").select("budget_id", "capacity", "part", "bin", "fill")
    renamed = None  # budget_id, was, bin: the name a bin has after all levels so far
    while parts > 1:
        parts = -(-parts // FAN_IN)
        merged = saved(bins.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("budget_id", "part").applyInPandas(pack_bins, "budget_id int, capacity int, part long, was string, bin string, fill int"), "bins")
        bins = merged.where("fill > 0").select("budget_id", "capacity", "part", "bin", "fill")
        moved = merged.where("was <> bin").select("budget_id", "was", "bin")
        if renamed is None:
            renamed = moved
        else:  # a bin renamed before may be renamed again
            again = moved.select("budget_id", F.col("was").alias("bin"), F.col("bin").alias("now"))
            renamed = saved(renamed.join(again, ["budget_id", "bin"], "left").select("budget_id", "was", F.coalesce("now", "bin").alias("bin")).unionByName(moved), "renamed")
    flat = packed.select("budget_id", F.col("bin").alias("was"), "item", "piece", "tokens")
    if renamed is None:
        flat = flat.withColumnRenamed("was", "container_id")
    else:
        small = renamed.count() <= RENAMED
        flat = flat.join(F.broadcast(renamed) if small else renamed, ["budget_id", "was"], "left").select("budget_id", F.coalesce("bin", "was").alias("container_id"), "item", "piece", "tokens")
    empty = cross.where("tokens <= 0").select("budget_id", F.lit(None).cast("string").alias("container_id"), "item", F.lit(0).alias("piece"), F.lit(0).alias("tokens"))
    return flat.select("budget_id", "container_id", "item", "piece", "tokens").unionByName(empty)
