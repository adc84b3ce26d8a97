"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table's hash is `floor((a x + b) / w)` for several Gaussian directions a. A query
visits its own bucket and perturbed ones, in the order of their estimated success:
the sum of squared distances to the cell borders that a perturbation crosses,
smallest first. Buckets of all tables are dealt over tasks by a hash of (table,
bucket); a task ranks the candidates of a query's buckets by their exact distance in
double precision and hands on the nearest, which are then merged over tables.

Equal vectors are one class, represented by its smallest id and searched once; a
class keeps its k + 1 smallest ids, more can not appear in one answer. Buckets with
more than `CHUNK` classes are split by a salt, and queries visit every part. A query
for which fewer than k neighbours were found is searched again against all rows, in
blocks. The cell width follows the spread of at most `SAMPLE` vectors; that sample
sets no other thing, and every row is indexed.

Defined results: vectors that are null, zero or hold null or non-finite components
take no part, nor do those of another length than the most common one (ties: the
shorter), nor rows without id; rows that repeat id and vector count once; rows that
share an id only never answer for that id; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.session import park

#: Classes in one part of a bucket, and about the index rows in a task.
CHUNK = 20_000
TASK_ROWS = 60_000
SAMPLE = 2_000
NEAR = "query bigint, candidate bigint, score double"


def usable(table: DataFrame, vector: str, key: str) -> DataFrame:
    """`id`, `v`: distinct rows whose vectors can take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = table.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    )
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0)).distinct()


def classes(rows: DataFrame, k: int) -> DataFrame:
    """`cid`, `v`, `ids`: each vector once, with its smallest id and its k + 1 smallest ids."""
    rank = F.row_number().over(W.partitionBy("v").orderBy("id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("cid"), "v", "ids")


class Hashing:
    """Directions, offsets and probe orders of all tables."""

    def __init__(self, dim: int, scale: float, tables: int, width: int, cell: float, probes: int, seed: int):
        random = np.random.default_rng(seed)
        self.tables, self.width, self.probes, self.cell = tables, width, probes, cell * scale
        self.a = random.normal(size=(tables, width, dim))
        self.b = random.random((tables, width)) * self.cell
        self.mix = random.integers(1, 1 << 62, size=width, dtype=np.int64) | 1

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.a[table].T + self.b[table]) / self.cell

    def bucket(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells.astype(np.int64) * self.mix).sum(axis=-1)

    def visits(self, place: np.ndarray) -> np.ndarray:
        """Cells to visit from a place within the grid, best first."""
        home = np.floor(place)
        to_low = place - home
        cost = np.concatenate([to_low**2, (1 - to_low) ** 2])
        order = np.argsort(cost)
        cost, m = cost[order], self.width
        out, heap = [home], [(cost[0], (0,))]
        while heap and len(out) < self.probes:
            total, chosen = heapq.heappop(heap)
            last = chosen[-1]
            if last + 1 < 2 * m:
                heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
                heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
            axes = [order[i] % m for i in chosen]
            if len(set(axes)) == len(axes):
                cell = home.copy()
                for i in chosen:
                    cell[order[i] % m] += -1 if order[i] < m else 1
                out.append(cell)
        return np.array(out)


def vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def hashed(points: DataFrame, hashing: Hashing, probe: bool) -> DataFrame:
    """`cid`, `v`, `table`, `bucket`: where a class lies, or what a query visits."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors(batch.column(1))
            for table in range(hashing.tables):
                places = hashing.cells(x, table)
                if probe:
                    found = [hashing.bucket(hashing.visits(p)) for p in places]
                    take = np.repeat(np.arange(len(x)), [len(f) for f in found])
                    buckets = np.concatenate(found)
                else:
                    take, buckets = np.arange(len(x)), hashing.bucket(np.floor(places))
                rows = batch.take(pa.array(take))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(np.full(len(take), table, np.int32)), pa.array(buckets)], names=["cid", "v", "table", "bucket"]
                )

    kind = points.schema["v"].dataType.simpleString()
    return points.select("cid", "v").mapInArrow(run, f"cid bigint, v {kind}, table int, bucket bigint")


def ranked(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Nearest k + 1 classes of each query among those with its (`task`, `bucket`) keys.

    Both sides have `cid`, `v`, `task`, `bucket`; a task's rows are ranked together.
    """

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query": [], "candidate": [], "score": []}
        schema = pa.schema([("query", pa.int64()), ("candidate", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return pa.table(empty, schema)
        x, cids, buckets = vectors(left["v"]), left["cid"].to_numpy(), left["bucket"].to_numpy()
        order = np.argsort(buckets, kind="stable")
        x, cids, buckets = x[order], cids[order], buckets[order]
        q, qids, asked = vectors(right["q_v"]), right["q_cid"].to_numpy(), right["q_bucket"].to_numpy()
        low, high = np.searchsorted(buckets, asked), np.searchsorted(buckets, asked, side="right")
        by_query = np.argsort(qids, kind="stable")
        edges = np.flatnonzero(np.diff(qids[by_query])) + 1
        out = []
        for rows in np.split(by_query, edges):
            spans = [np.arange(low[r], high[r]) for r in rows if high[r] > low[r]]
            if not spans:
                continue
            near = np.concatenate(spans)
            _, first = np.unique(cids[near], return_index=True)
            near = near[first]
            score = np.sqrt(((x[near] - q[rows[0]]) ** 2).sum(axis=1))
            best = np.lexsort((cids[near], score))[: k + 1]
            out.append((np.full(len(best), qids[rows[0]]), cids[near][best], score[best]))
        if not out:
            return pa.table(empty, schema)
        return pa.table(dict(zip(schema.names, map(np.concatenate, zip(*out, strict=True)), strict=True)), schema)

    asked = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    return points.groupBy("task").cogroup(asked.groupBy("q_task")).applyInArrow(rank, NEAR)


def search(
    table: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", key: str = "vec_id",
    tables: int = 12, width: int = 8, cell: float = 2.0, probes: int = 80, seed: int = 3,
) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: k nearest found for every query row.

    `is_query` is a condition over `id`. The rest sets the number of tables, of
    directions per table, the cell width in units of the vectors' spread, and visits.
    """
    rows = park(usable(table, vector, key), "nearest-rows")
    every = park(classes(rows, k), "nearest-classes")
    sample = [r["v"] for r in every.select("v").orderBy(F.xxhash64("cid")).limit(SAMPLE).collect()]
    if not sample:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    drawn = np.array(sample, dtype=np.float64)
    scale = float(np.sqrt(max(drawn.var(axis=0).sum(), 1e-300)))
    hashing = Hashing(drawn.shape[1], scale, tables, width, cell, probes, seed)
    asking = rows.where(is_query).join(every.select("v", "cid"), "v").select(F.col("id").alias("query_id"), "cid")
    queries = park(asking.select("cid").distinct().join(every, "cid").select("cid", "v"), "nearest-queries")

    # dealing: buckets go to tasks by hash, crowded ones in several parts
    index, visits = hashed(every, hashing, False), hashed(queries, hashing, True)
    n_classes = every.count()
    tasks = max(1, -(-n_classes * tables // TASK_ROWS))
    crowded = park(
        index.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts")).where("parts > 1"), "nearest-crowded"
    )
    task = F.pmod(F.xxhash64("table", "bucket", "part"), F.lit(tasks)).cast("int").alias("task")
    parts = F.coalesce("parts", F.lit(1))
    near_key = F.xxhash64("table", "bucket").alias("bucket")
    index = index.join(crowded, ["table", "bucket"], "left").withColumn("part", F.pmod(F.xxhash64("cid"), parts).cast("int"))
    visits = visits.join(crowded, ["table", "bucket"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    found = ranked(index.select("cid", "v", near_key, task), visits.select("cid", "v", near_key, task), k)
    found = park(found.groupBy("query", "candidate").agg(F.min("score").alias("score")), "nearest-found")
    answers = answered(found, every, asking, k)

    # too few found: against all rows, in blocks
    enough = answers.groupBy("query_id").count().where(F.col("count") >= k)
    short = asking.join(enough, "query_id", "left_anti").select("cid").distinct().join(every, "cid").select("cid", "v")
    blocks = max(1, -(-n_classes // TASK_ROWS))
    whole = ranked(
        every.select("cid", "v", F.lit(0).cast("bigint").alias("bucket"), F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int").alias("task")),
        short.select("cid", "v", F.lit(0).cast("bigint").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("task")),
        k,
    )
    exact = answered(whole, every, asking, k)
    return answers.join(exact.select("query_id").distinct(), "query_id", "left_anti").unionByName(exact)


def answered(found: DataFrame, every: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """Classes found, spelled out as ids of rows, ranked for every query row."""
    nearest = W.partitionBy("query").orderBy("score", "candidate")
    few = found.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1)
    pairs = few.join(every.select(F.col("cid").alias("candidate"), "ids"), "candidate").select("query", "score", F.explode("ids").alias("vec_id"))
    best = W.partitionBy("query").orderBy("score", "vec_id")
    pairs = pairs.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    own = pairs.join(asking.withColumnRenamed("cid", "query"), "query").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return own.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
