"""Filling fixed-capacity containers with documents (problem 7).

Plan. Only how many items of each size there are decides the packing: the counts by size (at most
``capacity`` of them, as longer documents are cut) come to the driver, where whole classes of equal
containers are planned at once. Large items (over a third of the capacity) are matched greedily, at
most two to a container, the larger with the largest partner that fits; smaller ones are best-fitted
into the remaining gaps, largest first, and what fits nowhere opens new containers. Every document
then finds its place by size and rank: ranks come from counts per (size, slice), so neither a
frequent size nor any container class is gathered in one task.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitloom.llm.tokens import VOCABULARY, with_tokens
from gaitloom.session import durable

#: Rows a slice of one size should hold at most, for ranking.
SLICE_ROWS = 200_000


class _Gaps:
    """Classes of open containers by free room: room -> list of (first container, containers, items in each)."""

    def __init__(self) -> None:
        self.by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        self.rooms: list[int] = []

    def add(self, room: int, first: int, n: int, items: int) -> None:
        if n and room > 0:
            if not self.by[room]:
                bisect.insort(self.rooms, room)
            self.by[room].append((first, n, items))

    def fitting(self, size: int) -> int | None:
        i = bisect.bisect_left(self.rooms, size)
        return self.rooms[i] if i < len(self.rooms) else None

    def take(self, room: int) -> tuple[int, int, int]:
        got = self.by[room].pop()
        if not self.by[room]:
            self.rooms.remove(room)
        return got


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(segments, containers). A segment (size, rank, items, container, each, position) places items of one
    size: those of rank ``rank`` and on go to container ``container`` and on, ``each`` to a container,
    the first at ``position``.
    """
    left = {s: n for s, n in counts.items() if s > 0 and n > 0}
    used: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps, opened = _Gaps(), 0

    def place(size: int, items: int, container: int, each: int, position: int) -> None:
        out.append((size, used[size], items, container, each, position))
        used[size] += items
        left[size] -= items

    large = sorted(s for s in left if 3 * s > capacity)
    for a in reversed(large):
        while left[a]:
            i = bisect.bisect_right(large, capacity - a) - 1
            while i >= 0 and (not left[large[i]] or large[i] > a):
                i -= 1
            b = large[i] if i >= 0 else None
            if b is None or (b == a and left[a] == 1):
                n = left[a]
                place(a, n, opened, 1, 0)
                gaps.add(capacity - a, opened, n, 1)
            elif b == a:
                n = left[a] // 2
                place(a, 2 * n, opened, 2, 0)
                gaps.add(capacity - 2 * a, opened, n, 2)
            else:
                n = min(left[a], left[b])
                place(a, n, opened, 1, 0)
                place(b, n, opened, 1, 1)
                gaps.add(capacity - a - b, opened, n, 2)
            opened += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            room = gaps.fitting(s)
            if room is None:
                each = capacity // s
                n, rest = divmod(left[s], each)
                if n:
                    place(s, n * each, opened, each, 0)
                    gaps.add(capacity - each * s, opened, n, each)
                    opened += n
                if rest:
                    place(s, rest, opened, rest, 0)
                    gaps.add(capacity - rest * s, opened, 1, rest)
                    opened += 1
                continue
            first, n, items = gaps.take(room)
            each = room // s
            full = min(n, left[s] // each)
            if full:
                place(s, full * each, first, each, items)
                gaps.add(room - each * s, first, full, items + each)
            rest = min(left[s], each - 1 if full < n else 0)
            if full < n and rest:
                place(s, rest, first + full, rest, items)
                gaps.add(room - rest * s, first + full, 1, items + rest)
                gaps.add(room, first + full + 1, n - full - 1, items)
            elif full < n:
                gaps.add(room, first + full, n - full, items)
    return out, opened


def pack(documents: DataFrame, limits: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Every document's place for every profile.

    Columns: profile, container, position, doc_id, piece, tokens, fill (tokens in the container),
    capacity. A document longer than the capacity is cut into pieces 0, 1, ... of full capacity and a
    rest; all others are whole (piece 0). No container exceeds its capacity.

    Documents without tokens (null or empty text) take no room and are spread over the containers
    after their other items. Rows without doc_id are left out; profiles without a positive capacity
    are ignored; an empty table gives no rows; ties between equally long documents fall by doc_id.
    Repeated rows are packed as often as they occur. Extra columns are ignored.
    """
    spark = documents.sparkSession
    sized = durable(with_tokens(documents, path).select("doc_id", "n_tokens"))
    profiles = [(r.profile, r.capacity_tokens) for r in limits.where("profile is not null and capacity_tokens > 0").dropDuplicates(["profile"]).sort("profile").collect()]  # fixed table
    empty = spark.createDataFrame([], "profile string, container bigint, position bigint, doc_id bigint, piece int, tokens int, fill bigint, capacity int")
    if not profiles:
        return empty
    caps = spark.createDataFrame(profiles, "profile string, capacity int")
    items = sized.crossJoin(F.broadcast(caps))  # profiles: a fixed handful
    pieces = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int"), F.lit(1))
    items = items.select("profile", "capacity", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    items = items.select("profile", "capacity", "doc_id", "piece", F.least(F.col("n_tokens") - F.col("piece") * F.col("capacity"), F.col("capacity")).cast("int").alias("tokens"))
    n_slices = max(1, -(-sized.count() // SLICE_ROWS))
    items = items.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_slices)).cast("int"))
    per = items.groupBy("profile", "tokens", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("profile", "tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(F.col("profile").alias("_p"), F.col("tokens").alias("_t"), F.col("slice").alias("_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows, totals = [], []
    counts: dict[str, dict[int, int]] = defaultdict(dict)
    for r in per.groupBy("profile", "tokens").agg(F.sum("n").alias("n")).collect():  # at most capacity + 1 per profile
        counts[r.profile][r.tokens] = r.n
    for name, capacity in profiles:
        segments, opened = plan(counts[name], capacity)
        rows += [(name, *s) for s in segments]
        totals.append((name, max(opened, 1)))
    segments = spark.createDataFrame(rows, "_sp string, _size int, _rank bigint, _items bigint, _container bigint, _each bigint, _position bigint")
    opened = spark.createDataFrame(totals, "_op string, _opened bigint")
    rank = F.row_number().over(Window.partitionBy("profile", "tokens", "slice").orderBy("doc_id", "piece")) - 1
    ranked = items.withColumn("_local", rank).join(offsets, (F.col("profile") == F.col("_p")) & (F.col("tokens") == F.col("_t")) & (F.col("slice") == F.col("_s"))).withColumn("rank", F.col("offset") + F.col("_local"))
    put = ranked.where("tokens > 0").join(segments, (F.col("profile") == F.col("_sp")) & (F.col("tokens") == F.col("_size")) & (F.col("rank") >= F.col("_rank")) & (F.col("rank") < F.col("_rank") + F.col("_items")))
    turn = F.col("rank") - F.col("_rank")
    put = put.select("profile", (F.col("_container") + F.floor(turn / F.col("_each"))).alias("container"), (F.col("_position") + turn % F.col("_each")).alias("position"), "doc_id", "piece", "tokens", "capacity")
    none = ranked.where("tokens = 0").join(opened, F.col("profile") == F.col("_op"))
    none = none.select("profile", (F.col("rank") % F.col("_opened")).alias("container"), (F.lit(2**20) + F.floor(F.col("rank") / F.col("_opened"))).alias("position"), "doc_id", "piece", "tokens", "capacity")
    put = put.unionByName(none)
    w = Window.partitionBy("profile", "container")  # a container holds at most its capacity of items with tokens
    return put.select("profile", "container", (F.row_number().over(w.orderBy("position", "doc_id")) - 1).cast("bigint").alias("position"), "doc_id", "piece", "tokens", F.sum("tokens").over(w).alias("fill"), "capacity")
