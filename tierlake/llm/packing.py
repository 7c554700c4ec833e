"""Items of varying length into containers of fixed capacity by vector best-fit."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlake.session import ensure_checkpoint_dir, python_partitions

#: Items packed by one task at a time, blocks whose loose containers are packed again together, and the fill below which a container is loose.
BLOCK_ITEMS, MERGE_BLOCKS, LOOSE = 4096, 64, 0.98
MAX_PROFILES = 1000


def best_fit(tokens: np.ndarray, capacity: int, max_items: int, max_cost: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.25, 0.25)) -> np.ndarray:
    """Bin of each item. ``tokens`` is in descending order, each at most ``capacity``.

    A bin has three residual capacities: tokens, items and attention cost (the sum of squared lengths). Of the bins
    that hold an item under every constraint the one with the smallest weighted norm of what would remain (``norm``)
    or the largest weighted dot product of item and residual (``dot``) is taken, the oldest on ties; else a new one.
    """
    n = len(tokens)
    scale = (float(capacity), float(max_items), float(max_cost))
    s0, s1, s2 = (np.sqrt(w) / x for w, x in zip(weights, scale, strict=True))
    left0, left1, left2, ids = (np.empty(64) for _ in range(4))  # residuals and numbers of open bins
    out, bins, used = np.empty(n, np.int64), 0, 0
    smallest = float(tokens[-1]) if n else 0.0
    for k, size in enumerate(tokens.astype(np.float64).tolist()):
        cost = size * size
        fits = ((left0[:used] >= size) & (left1[:used] >= 1) & (left2[:used] >= cost)).nonzero()[0]
        if fits.size:
            if rule == "dot":
                score = -(left0[fits] * (size * s0 * s0) + left1[fits] * (s1 * s1) + left2[fits] * (cost * s2 * s2))
            else:
                d0, d1, d2 = (left0[fits] - size) * s0, (left1[fits] - 1) * s1, (left2[fits] - cost) * s2
                score = d0 * d0 + d1 * d1 + d2 * d2
            j = fits[score.argmin()]
            left0[j] -= size
            left1[j] -= 1
            left2[j] -= cost
            out[k] = ids[j]
            continue
        if used == len(left0):  # drop bins that can take nothing any more before growing
            live = ((left0 >= smallest) & (left1 >= 1)).nonzero()[0]
            used = len(live)
            room = np.empty(len(left0) * (2 if used > len(left0) // 2 else 1) - used)
            left0, left1, left2, ids = (np.concatenate([old[live], room]) for old in (left0, left1, left2, ids))
        left0[used], left1[used], left2[used], ids[used] = scale[0] - size, scale[1] - 1, scale[2] - cost, bins
        out[k] = bins
        bins, used = bins + 1, used + 1
    return out


def _pack(max_items: int | None, cost_factor: float, rule: str):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("tokens", "descending"), ("item_id", "ascending"), ("piece", "ascending")])
        tokens = t["tokens"].to_numpy()
        capacity = t["capacity"][0].as_py()
        most, cost = max_items or max(1, capacity), int(cost_factor * capacity * capacity)
        bins = best_fit(tokens, capacity, most, cost, rule)
        count = np.bincount(bins)
        used = (np.bincount(bins, weights=tokens) / capacity, count / most, np.bincount(bins, weights=tokens.astype(np.float64) ** 2) / max(1, cost))
        fill = np.maximum.reduce(used)  # a container is as full as its scarcest capacity
        # the emptiest bin, and more while they hold a small share of the items, so that merged blocks stay as small as blocks
        order = np.argsort(fill, kind="stable")
        loose = np.zeros(len(fill), bool)
        loose[order] = (np.cumsum(count[order]) * MERGE_BLOCKS <= len(tokens)) | (np.arange(len(fill)) == 0)
        loose &= fill < LOOSE
        return t.append_column("bin", pa.array(bins)).append_column("loose", pa.array(loose[bins]))

    return run


def pack_containers(items: DataFrame, containers: DataFrame, *, item_id: str = "doc_id", size: str = "n_tokens", profile: str = "profile", capacity: str = "capacity_tokens", max_items: int | None = None, cost_factor: float = 1.0, rule: str = "norm", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(profile, container_id, item_id, piece, n_tokens, start_token): every item in containers of each capacity.

    Method: items longer than a container can hold are cut into full pieces, each a container of its own, and a rest;
    a container holds ``capacity`` tokens, ``max_items`` items (None: as many as tokens, which never binds) and an
    attention cost (the sum of squared lengths) of ``cost_factor`` squares of the capacity (1: never binds), so a piece
    has at most the capacity and the root of that cost. The others are spread over blocks of about ``block_items`` by
    hash of their row, so that no source, id or group can be hot, and each block is packed by vector best-fit,
    decreasing (:func:`best_fit`). Each block's emptiest containers (filled to less than LOOSE in every capacity,
    holding at most one item in MERGE_BLOCKS, or one container) are emptied, and the items of MERGE_BLOCKS blocks packed
    again together, until one block is left.

    Defined cases: an item of no tokens (an empty or null text) is given with a null container; an item as long as
    the longest piece fills a container; a null or non-positive capacity, number of items or cost is refused; a repeated
    or null id is packed once a row, and its rows never share a full container. No items give no rows.
    """
    spark = items.sparkSession
    ensure_checkpoint_dir(spark)
    profiles = containers.select(F.col(profile).cast("string"), F.col(capacity).cast("int")).distinct().limit(MAX_PROFILES + 1).collect()
    if len(profiles) > MAX_PROFILES or any(c is None or c < 1 for _, c in profiles):
        raise ValueError("capacities must be positive, in a bounded number of profiles")
    if (max_items is not None and max_items < 1) or any(int(cost_factor * c * c) < 1 for _, c in profiles):
        raise ValueError("a container must hold at least one item of one token")
    longest = {c: min(c, isqrt(int(cost_factor * c * c))) for _, c in profiles}
    each = F.array(*(F.struct(F.lit(p).alias("profile"), F.lit(c).alias("capacity"), F.lit(longest[c]).alias("full")) for p, c in sorted(profiles, key=repr))) if profiles else F.array().cast("array<struct<profile:string,capacity:int,full:int>>")
    sized = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("n"), F.monotonically_increasing_id().alias("row")).checkpoint()  # which fixes the rows' numbers
    n_blocks = max(1, -(-sized.where("n > 0").count() // block_items))
    wide = sized.select("item_id", "row", "n", F.inline(each))
    step = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.floor((F.col("n") - 1) / F.col("full")).cast("int"))).otherwise(F.array(F.lit(0)))
    pieces = wide.select("profile", "capacity", "full", "item_id", "row", "n", F.explode(step).alias("piece"))
    start = F.col("piece") * F.col("full")
    pieces = pieces.select("profile", "capacity", "full", "item_id", "row", "piece", start.alias("start"), F.least(F.col("full"), F.col("n") - start).alias("tokens"))
    name = lambda *parts: F.concat_ws("-", "profile", *parts)
    # a full piece is packed already; an empty item needs no container
    alone = pieces.where("tokens = full or tokens = 0").withColumn("container_id", F.when(F.col("tokens") > 0, name(F.lit("full"), "item_id", "row", "piece")))
    columns = ["profile", "container_id", "item_id", "piece", "start", "tokens"]
    result = alone.select(*columns)
    # by row, as an id may be repeated without end
    todo = pieces.where("tokens > 0 and tokens < full").withColumn("block", F.pmod(F.xxhash64("row", "piece"), F.lit(n_blocks)))
    kind = items.schema[item_id].dataType.simpleString()
    schema = "profile string, capacity int, item_id " + kind + ", piece int, start int, tokens int, block long, bin long, loose boolean"
    level = 0
    while True:
        packed = todo.select("profile", "capacity", "item_id", "piece", "start", "tokens", "block").repartition(python_partitions(spark), "profile", "block").groupBy("profile", "block").applyInArrow(_pack(max_items, cost_factor, rule), schema).checkpoint()
        last = n_blocks == 1
        tight = packed if last else packed.where("not loose")
        result = result.unionByName(tight.withColumn("container_id", name(F.lit(level), "block", "bin")).select(*columns))
        if last:
            break
        n_blocks, level = -(-n_blocks // MERGE_BLOCKS), level + 1
        todo = packed.where("loose").withColumn("block", F.pmod("block", F.lit(n_blocks)))
    return result.select(F.col("profile").alias(profile), "container_id", F.col("item_id").alias(item_id), "piece", F.col("tokens").alias(size), F.col("start").alias("start_token"))


def fill_report(packed: DataFrame, containers: DataFrame, *, size: str = "n_tokens", profile: str = "profile", capacity: str = "capacity_tokens", max_items: int | None = None, cost_factor: float = 1.0) -> DataFrame:
    """(profile, n_containers, n_tokens, n_pieces, n_least, over_full) of a packing.

    ``n_least`` is the least number of containers by the sums of tokens, pieces and cost, whichever needs most;
    ``over_full`` the number of containers that break a capacity. Pieces without a container (empty items) don't count.
    """
    room = F.col(capacity).cast("double")
    most, cost = F.lit(max_items).cast("double") if max_items is not None else room, F.floor(cost_factor * room * room)
    each = packed.where("container_id is not null").groupBy(profile, "container_id").agg(F.sum(size).alias("_t"), F.count(F.lit(1)).alias("_n"), F.sum(F.col(size).cast("double") * F.col(size)).alias("_c"))
    each = each.join(containers.select(profile, capacity).distinct(), profile)
    over = (F.col("_t") > room) | (F.col("_n") > most) | (F.col("_c") > cost)
    totals = [F.count(F.lit(1)).alias("n_containers"), F.sum("_t").alias("n_tokens"), F.sum("_n").alias("n_pieces"), F.sum("_c").alias("_c"), F.count_if(over).alias("over_full")]
    least = F.ceil(F.greatest(F.col("n_tokens") / room, F.col("n_pieces") / most, F.col("_c") / cost))
    return each.groupBy(profile, capacity).agg(*totals).select(profile, "n_containers", "n_tokens", "n_pieces", least.alias("n_least"), "over_full")
