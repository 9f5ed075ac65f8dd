"""Filling containers of fixed capacity (problem 4).

Sizes are grouped into length buckets: dynamic programming over the *global*
histogram of sizes chooses the bucket boundaries of least padding (the sum of
bucket bound minus size). Token-budget batches are then formed inside each
bucket: a batch is a pattern of sizes that fits the capacity. Batches that leave
more than a small share of it unused are given up, and their items are batched
across the buckets, so that short items top up what long ones leave.

The batches of a group (manual, language) are planned on the group's
*histogram*, never on its rows: a capacity of C allows at most C different
sizes, so a plan is bounded however many rows the group has. A plan is a short
list of (pattern, how often). Rows then learn their container by a join on
(group, size, rank within that size); nothing is gathered in one task.

No item is split unless it alone exceeds the capacity; then it is cut into
full containers and a rest that is packed like an item.

Defined results: null and empty sources have size 0 and go into a container of
their group like any item; a group of such rows alone has one container; null
group values form groups of their own. Repeated ids count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 12
SLACK = 0.005  # of the capacity that a batch of one bucket may leave unused
SPREAD = 1 << 12  # rows of a group and size that one ranking task may hold on average


def bucket_bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding.

    Dynamic programming over all distinct sizes. The best cut never moves down as
    the size grows, so each layer is found by divide and conquer.
    """
    if not histogram:
        return []
    sizes = sorted(histogram)
    x = np.array(sizes, dtype=np.float64)
    n = np.array([histogram[s] for s in sizes], dtype=np.float64)
    count, total = np.concatenate(([0.0], np.cumsum(n))), np.concatenate(([0.0], np.cumsum(n * x)))
    m = len(sizes)
    best = x * count[1:] - total[1:]  # one bucket up to each size
    back = [np.zeros(m, dtype=int)]
    for _ in range(1, min(buckets, m)):
        new, frm = best.copy(), np.full(m, -1)
        todo = [(1, m - 1, 0, m - 2)]  # sizes from, to; cuts from, to
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            end = min(last, j - 1) + 1
            pad = best[first:end] + x[j] * (count[j + 1] - count[first + 1 : end + 1]) - (total[j + 1] - total[first + 1 : end + 1])
            i = first + int(pad.argmin())
            if pad[i - first] < new[j]:
                new[j], frm[j] = pad[i - first], i
            todo += [(low, j - 1, first, i), (j + 1, high, i, last)]
        back.append(frm)
        best = new
    bounds, j, k = [], m - 1, len(back) - 1
    while True:
        bounds.append(sizes[j])
        while k > 0 and back[k][j] < 0:
            k -= 1
        if k == 0:
            break
        j, k = int(back[k][j]), k - 1
    return bounds[::-1]


def plan_group(sizes: dict[int, int], capacity: int, bounds: list[int]) -> list[tuple[dict[int, int], int]]:
    """Batches of one group as (pattern: size -> items, how often), from its histogram of sizes <= capacity.

    Every bucket forms its own batches; those that leave more than ``SLACK`` of
    the capacity are given up, and their items are batched across the buckets.
    """
    edges = sorted(set(bounds) | {capacity})
    buckets: list[dict[int, int]] = [{} for _ in range(len(edges))]
    for s, n in sizes.items():
        if n > 0:
            buckets[int(np.searchsorted(edges, s))][s] = n
    plans: list[tuple[dict[int, int], int]] = []
    rest: dict[int, int] = {}
    for inside in reversed(buckets):
        for pattern, times in _batches(inside, capacity):
            if capacity - sum(s * k for s, k in pattern.items()) <= SLACK * capacity:
                plans.append((pattern, times))
            else:
                for s, k in pattern.items():
                    rest[s] = rest.get(s, 0) + k * times
    return plans + _batches(rest, capacity)


def _batches(sizes: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Batches of all ``sizes``: the longest item opens one, shorter ones spend what is left of its budget."""
    left = dict(sizes)
    plans: list[tuple[dict[int, int], int]] = []
    order = sorted(left, reverse=True)
    while order:
        room, pattern = capacity, {}
        for s in order:
            if s <= room:
                k = left[s] if s == 0 else min(left[s], room // s)
                pattern[s] = k
                room -= k * s
        _fill_better(pattern, left, room)
        times = min(left[s] // k for s, k in pattern.items())
        for s, k in pattern.items():
            left[s] -= k * times
        plans.append((pattern, times))
        order = [s for s in order if left[s] > 0]
    return plans


def _fill_better(pattern: dict[int, int], left: dict[int, int], room: int) -> None:
    """Exchange one item of the pattern for a longer one that uses the rest of the room exactly or best."""
    if room <= 0:
        return
    free = {s for s, n in left.items() if n > pattern.get(s, 0)}
    best = None
    for s in pattern:
        for extra in range(room, 0, -1):
            if s + extra in free:
                if best is None or extra > best[1]:
                    best = (s, extra)
                break
    if best:
        s, extra = best
        pattern[s] -= 1
        if not pattern[s]:
            del pattern[s]
        pattern[s + extra] = pattern.get(s + extra, 0) + 1


def _pieces(items: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per limit and item, or piece of one that exceeds the capacity, with its size."""
    caps = limits.select("limit_name", F.col("capacity_chars").alias("capacity")).filter("capacity > 0")
    sized = items.select("segment_id", "manual_id", "lang_out", F.coalesce(F.length("src"), F.lit(0)).alias("n")).dropDuplicates(["segment_id"])
    each = sized.crossJoin(F.broadcast(caps))  # one copy of each row per limit: a bounded table
    pieces = each.withColumn("piece", F.explode(F.expr("sequence(0, greatest(0, int(ceil(n / capacity)) - 1))")))
    return pieces.withColumn("size", F.expr("CASE WHEN n = 0 THEN 0 WHEN (piece + 1) * capacity <= n THEN capacity ELSE n - piece * capacity END"))


def pack(items: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_name, manual_id, lang_out, segment_id, piece, size, container_id, capacity), one row per item or piece.

    ``items`` has segment_id, manual_id, lang_out, src; ``limits`` (a bounded
    table of capacities) has limit_name, capacity_chars.
    """
    pieces = _pieces(items, limits)
    key = ["limit_name", "manual_id", "lang_out"]
    histogram = pieces.groupBy(*key, "capacity", "size").count()
    # The global histogram has at most one row per possible size and limit; it alone comes to the driver.
    overall = histogram.groupBy("limit_name", "size").agg(F.sum("count").alias("n")).collect()
    bounds: dict[str, list[int]] = {}
    for name in {r.limit_name for r in overall}:
        bounds[name] = bucket_bounds({r["size"]: r.n for r in overall if r.limit_name == name})

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for g in part.itertuples():
                sizes = {int(h["size"]): int(h["count"]) for h in g.histogram}
                taken: dict[int, int] = {}
                first = 0
                for pattern, times in plan_group(sizes, int(g.capacity), bounds[g.limit_name]):
                    for s, k in pattern.items():
                        # Ranks taken .. taken + k * times of this size fill containers first .. first + times, k in each.
                        rows.append((g.gid, s, taken.get(s, 0), k, first))
                        taken[s] = taken.get(s, 0) + k * times
                    first += times
            yield pd.DataFrame(rows, columns=["gid", "size", "from_rank", "per", "first_container"])

    gid = F.xxhash64(F.struct(*key)).alias("gid")
    groups = histogram.groupBy(gid, "limit_name", "capacity").agg(F.collect_list(F.struct("size", "count")).alias("histogram"))
    plans = groups.mapInPandas(plan, "gid long, size int, from_rank long, per long, first_container long")
    # Rank of every item among those of its group and size, salted: count per salt first, then rank inside it.
    tagged = pieces.select("*", gid).withColumn("salt", F.pmod(F.xxhash64("segment_id", "piece"), F.lit(64)).cast("int"))
    base = tagged.groupBy("gid", "size", "salt").count()
    before = base.withColumn("base", F.sum("count").over(Window.partitionBy("gid", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    inner = Window.partitionBy("gid", "size", "salt").orderBy("segment_id", "piece")
    ranked = tagged.withColumn("r", F.row_number().over(inner) - 1).join(before.select("gid", "size", "salt", F.coalesce("base", F.lit(0)).alias("base")), ["gid", "size", "salt"])
    ranked = ranked.withColumn("rank", F.col("r") + F.col("base"))
    # A size has few plan entries per group; the one that covers the rank is found by its start.
    steps = plans.groupBy("gid", "size").agg(F.array_sort(F.collect_list(F.struct("from_rank", "per", "first_container"))).alias("steps"))
    placed = ranked.join(steps, ["gid", "size"]).withColumn("s", F.expr("element_at(filter(steps, x -> x.from_rank <= rank), -1)"))
    container = F.col("s.first_container") + F.expr("(rank - s.from_rank) DIV s.per")
    return placed.select(*key, "segment_id", "piece", "size", container.alias("container_id"), "capacity")


def bucket_report(items: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_name, bound, items, padding) of the chosen length buckets over all items; longer items count by their pieces, as in ``pack``."""
    spark = items.sparkSession
    histogram = _pieces(items, limits).groupBy("limit_name", "size").count().collect()
    rows = []
    for name in sorted({r.limit_name for r in histogram}):
        h = {r["size"]: r["count"] for r in histogram if r.limit_name == name}
        low = -1
        for bound in bucket_bounds(h):
            inside = {s: n for s, n in h.items() if low < s <= bound}
            rows.append((name, int(bound), sum(inside.values()), sum((bound - s) * n for s, n in inside.items())))
            low = bound
    return spark.createDataFrame(rows, "limit_name string, bound int, items long, padding long")
