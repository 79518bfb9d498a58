"""Exact inner-product search: candidates bucketed by length, pruned by local cosine thresholds, products verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nivo.llm.shared import Scratch, workers_find_package
from nivo.llm.vectors import matrix

#: Bytes of candidates (a lane) and of queries (a group) that a task holds; a task has one of each.
LANE_BYTES, LEAST_LANE_BYTES, GROUP_BYTES = 32 << 20, 1 << 20, 16 << 20
#: A bucket ends after so many vectors, or where lengths fall below this share of its longest.
BUCKET, LEAST_BUCKET, SIMILAR = 1024, 32, 0.9
#: Queries that are compared with a bucket at a time.
BLOCK = 512
#: Local cosine thresholds from here on are tested on the query's strongest coordinates, lesser ones by length alone.
COORDINATES_FROM, FOCUS = 0.8, 4
#: Room for rounding in bounds; products are exact.
SLACK = 1e-9
EXACT = float(1 << 53)

FOUND = "number long, query_id long, candidate long, vec_id long, score long"
NAMES = ["number", "query_id", "candidate", "vec_id", "score"]


class Side:
    """Vectors of one length of a lane or group, by falling norm: exact numbers and rounded norms."""

    def __init__(self, table: pa.Table, floats: bool):
        self.x = matrix(table.column("x"), table.column("dims")[0].as_py())
        self.x = self.x.astype(float) if floats else self.x.astype(object)
        near = self.x.astype(float)
        self.norms = np.sqrt((near * near).sum(axis=1)) if near.size else np.zeros(len(near))
        # NULL keys come last among ties.
        self.keys = table.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()
        self.unknown = table.column("id").is_null().to_numpy()
        self.numbers = table.column("number").to_numpy()

    def sort(self) -> Side:
        order = np.lexsort((self.numbers, self.keys, -self.norms))
        return self.part(order)

    def part(self, at) -> Side:
        some = Side.__new__(Side)
        for name, values in vars(self).items():
            setattr(some, name, values[at])
        return some

    def units(self) -> np.ndarray:
        return self.x.astype(float) / np.where(self.norms > 0, self.norms, 1.0)[:, None]


def buckets(norms: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of similar length of falling norms."""
    cuts, at = [], 0
    while at < len(norms):
        similar = int(np.searchsorted(-norms, -SIMILAR * norms[at], side="right"))
        end = min(len(norms), at + BUCKET, max(similar, at + LEAST_BUCKET))
        cuts.append((at, end))
        at = end
    return cuts


class Best:
    """The ``k`` best candidates so far of each query of a block: score, key and place in the lane."""

    def __init__(self, queries: int, k: int, kind):
        self.k = k
        self.scores = np.full((queries, k), -np.inf, dtype=kind)
        self.keys = np.full((queries, k), np.iinfo(np.int64).max)
        self.places = np.full((queries, k), -1)

    @property
    def least(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, keys: np.ndarray, places: np.ndarray) -> None:
        """Offers found pairs: row of the query, score, key and place of the candidate."""
        held = np.unique(rows)
        mine = self.places[held] >= 0
        all_rows = np.r_[rows, np.repeat(held, mine.sum(axis=1))]
        all_scores = np.r_[scores, self.scores[held][mine]]
        all_keys = np.r_[keys, self.keys[held][mine]]
        all_places = np.r_[places, self.places[held][mine]]
        order = np.lexsort((all_places, all_keys, -all_scores, all_rows))
        all_rows = all_rows[order]
        starts = np.flatnonzero(np.r_[True, all_rows[1:] != all_rows[:-1]])
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        top = rank < self.k
        at, rank, order = all_rows[top], rank[top], order[top]
        self.scores[at, rank] = all_scores[order]
        self.keys[at, rank] = all_keys[order]
        self.places[at, rank] = all_places[order]


def _survivors(units: np.ndarray, query: np.ndarray, cosine: float, sorted_by: dict) -> np.ndarray:
    """Places in a bucket whose strongest query coordinates allow a cosine of ``cosine`` with the query.

    A unit vector within an angle of the query has, in each coordinate, a value between the cosines of
    the two angles that the query's own value is apart from. The narrowest range of the
    sorted coordinate lists is read, the other ranges are tested on what it holds.
    """
    focus = np.argsort(-np.abs(query))[:FOCUS]
    own, wide = np.arccos(np.clip(query[focus], -1.0, 1.0)), np.arccos(min(1.0, max(-1.0, cosine - SLACK)))
    low = np.cos(np.minimum(own + wide, np.pi)) - SLACK
    high = np.cos(np.maximum(own - wide, 0.0)) + SLACK
    ranges = []
    for f, a, b in zip(focus, low, high):
        if f not in sorted_by:
            order = np.argsort(units[:, f], kind="stable")
            sorted_by[f] = (order, units[order, f])
        order, values = sorted_by[f]
        ranges.append((np.searchsorted(values, a, "left"), np.searchsorted(values, b, "right")))
    best = min(range(len(focus)), key=lambda j: ranges[j][1] - ranges[j][0])
    start, end = ranges[best]
    at = sorted_by[focus[best]][0][start:end]
    for j, f in enumerate(focus):
        if j != best:
            at = at[(units[at, f] >= low[j]) & (units[at, f] <= high[j])]
    return at


def search_block(lane: Side, asked: Side, need: np.ndarray, k: int, cuts: list[tuple[int, int]]) -> Best:
    """The best of a lane for a block of queries that have no use for scores below ``need``.

    Buckets come by falling length, so thresholds rise early. A bucket is left out for a query if even its
    longest vector in the query's direction stays below the threshold, and no later bucket is
    opened once that holds for all queries.
    """
    best = Best(len(asked.x), k, asked.x.dtype)
    keys, units = lane.keys, asked.units() if asked.x.shape[1] else None
    for start, end in cuts:
        # Scores at the threshold count: a tie may have the smaller key.
        floor = np.maximum(best.least.astype(float), need)
        reach = asked.norms * lane.norms[start]
        open_ = (floor <= reach * (1 + SLACK)) | np.isneginf(floor)
        if not open_.any():
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(reach > 0, floor / reach, -np.inf)
        by_coordinate = open_ & (cosine >= COORDINATES_FROM) & (units is not None)
        found = []
        if (rows := np.flatnonzero(open_ & ~by_coordinate)).size:
            # Length: the bucket up to where the product of norms falls below the least threshold.
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(asked.norms[rows] > 0, floor[rows] / asked.norms[rows], -np.inf).min()
            stop = start + int(np.searchsorted(-lane.norms[start:end], -least * (1 - SLACK) + 1e-300, "right"))
            stop = end if least <= 0 else max(stop, start + 1)
            scores = asked.x[rows] @ lane.x[start:stop].T
            found.append((np.repeat(rows, stop - start), scores.ravel(), np.tile(np.arange(start, stop), len(rows))))
        bucket_units, sorted_by = None, {}
        for row in np.flatnonzero(by_coordinate):
            if bucket_units is None:
                bucket_units = lane.x[start:end].astype(float) / np.maximum(lane.norms[start:end], 1e-300)[:, None]
            at = _survivors(bucket_units, units[row], cosine[row], sorted_by) + start
            if at.size:
                found.append((np.full(len(at), row), lane.x[at] @ asked.x[row], at))
        for rows, scores, places in found:
            worst, worst_key = best.least[rows], best.keys[rows, -1]
            better = (scores > worst) | ((scores == worst) & (keys[places] < worst_key))
            better &= asked.numbers[rows] != lane.numbers[places]
            if better.any():
                best.add(rows[better], scores[better], keys[places[better]], places[better])
    return best


def search_cell(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The ``k`` best candidates of a lane for each query of a group."""
    kinds = [pa.int64()] * 5
    if not (left.num_rows and right.num_rows):
        return pa.table([pa.array([], kind) for kind in kinds], NAMES)
    most = max(
        (max(abs(int(c.max())), abs(int(c.min()))) for t in (left, right) if (c := matrix(
            t.column("x"), t.column("dims")[0].as_py())).size), default=0,
    )
    # Sums of products below 2 ** 53 are exact as doubles; larger numbers are Python's own.
    floats = float(most) ** 2 * max(left.column("dims")[0].as_py(), 1) < EXACT
    lane, out = Side(left, floats).sort(), []
    cuts = buckets(lane.norms)
    need = right.column("need").to_numpy(zero_copy_only=False).astype(float)
    need = np.where(np.isnan(need), -np.inf, need)
    asked = Side(right, floats)
    for start in range(0, len(asked.x), BLOCK):
        block = asked.part(slice(start, start + BLOCK))
        best = search_block(lane, block, need[start : start + BLOCK], k, cuts)
        row, rank = np.nonzero(best.places >= 0)
        places, scores = best.places[row, rank], best.scores[row, rank]
        limit = np.iinfo(np.int64)
        scores = scores.astype(np.int64) if floats else [min(max(int(s), limit.min), limit.max) for s in scores]
        out.append(
            [
                pa.array(block.numbers[row], pa.int64()),
                pa.array(block.keys[row], pa.int64(), mask=block.unknown[row]),
                pa.array(lane.numbers[places], pa.int64()),
                pa.array(lane.keys[places], pa.int64(), mask=lane.unknown[places]),
                pa.array(scores, pa.int64()),
            ]
        )
    return pa.concat_tables([pa.table(columns, NAMES) for columns in out])


def search(vectors: DataFrame, asks: Column, k: int = 10, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """``query_id``, ``rank`` (from 1), the candidate's ``vec_id`` and ``score``: the ``k`` largest integer inner
    products of each row that ``asks`` holds for, with all other rows.

    Vectors are arrays of longs. Rows are range-partitioned by falling norm into lanes of bounded size and
    queries dealt into groups of bounded size; a task compares one group with one lane, bucket
    by bucket. The lane of the longest vectors comes first and gives each query a threshold; a
    query goes to another lane only if its norm times the lane's longest reaches that, so short vectors
    are not touched. Every row is a candidate; nothing is sampled, approximated or left out.

    Ties go to the smaller key, NULL keys last. A query is compared with every row but itself:
    a repeated row is another row, and repeated queries are answered one by one. Rows whose vector
    is NULL or holds NULL take no part, vectors of different lengths are not compared, and empty ones score 0.
    With fewer than ``k`` others all are returned. NULL keys ask as keys of their own only if
    ``asks`` holds. Scores beyond a long are cut to it. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    workers_find_package(spark)
    scratch = Scratch(spark, "topk")
    x = F.col(f"`{vector}`")
    usable = F.coalesce(F.forall(x, lambda c: c.isNotNull()), F.lit(False))
    rows = vectors.where(usable).select(
        F.col(f"`{key}`").cast("long").alias("id"),
        x.cast("array<long>").alias("x"),
        F.size(x).alias("dims"),
        F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))).alias("norm"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
        F.monotonically_increasing_id().alias("number"),
    )
    size = F.sum(F.size("x") * 8 + 16)
    total, asked = rows.agg(size, F.sum(F.when(F.col("asks"), F.size("x") * 8 + 16))).first()
    tasks = 2 * spark.sparkContext.defaultParallelism
    lane_bytes = min(LANE_BYTES, max(LEAST_LANE_BYTES, (total or 0) // tasks))
    lanes, groups = -(-(total or 1) // lane_bytes), -(-(asked or 1) // GROUP_BYTES)
    order = [F.col("dims"), F.col("norm").desc(), F.col("id"), F.col("number")]
    placed = scratch.write(
        rows.repartitionByRange(int(lanes), *order).withColumn("lane", F.spark_partition_id()), "lanes"
    )
    candidates = spark.read.schema(placed.schema).parquet(scratch.path("lanes"))
    extents = placed.groupBy("dims", "lane").agg(F.max("norm").alias("longest"))
    heads = extents.groupBy("dims").agg(F.min("lane").alias("head"))
    extents = scratch.write(extents.join(heads, "dims"), "extents")
    asked = placed.where("asks").select(
        "dims", "id", "number", "x", "norm", F.pmod(F.xxhash64("number"), F.lit(int(groups))).alias("part")
    )
    cell = ["dims", "lane", "part"]
    wide = int(min(max(lanes * groups, tasks), 20_000))

    def compared(queries: DataFrame) -> DataFrame:
        # Lanes are read once per group that has queries for them.
        wanted = queries.select(*[F.col(c).alias(c) for c in cell]).distinct()
        left = candidates.select("dims", "lane", "id", "number", "x").join(wanted, ["dims", "lane"])
        left = left.repartition(wide, *cell).groupBy(*cell)
        right = queries.select(*cell, "id", "number", "x", "need").repartition(wide, *cell).groupBy(*cell)
        return left.cogroup(right).applyInArrow(lambda a, b: search_cell(a, b, k), FOUND)

    first = asked.join(extents.select("dims", "lane").where("lane = head"), "dims")
    first = scratch.write(compared(first.withColumn("need", F.lit(None).cast("double"))), "first")
    least = first.groupBy(F.col("number").alias("of")).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("need")
    )
    reach = F.col("norm") * F.col("longest") * (1 + SLACK)
    others = (
        asked.join(least, F.col("number") == F.col("of"), "left")
        .join(extents.where("lane > head"), "dims")
        .where(F.col("need").isNull() | (F.col("need") <= reach))
    )
    found = scratch.write(first.unionByName(compared(others)), "found")
    scratch.drop("first", "extents")
    by_score = Window.partitionBy("number").orderBy(
        F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "candidate"
    )
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
