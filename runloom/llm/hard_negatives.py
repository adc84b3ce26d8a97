"""Hard negatives by Fagin's threshold algorithm, over blocks of candidates.

Every dimension of a block has its candidates sorted by that component. An anchor
reads these lists from the end that raises its score (from the top where its own
component is positive, from the bottom where it is negative), all to the same depth,
and scores the rows it meets by their integer inner product (random access). What
it has not met scores at most the threshold: the sum of the components at that depth,
times its own. It stops once the threshold is strictly below the worst score that
still counts: the kth of the positives, or for negatives the kth of each window (its
lower end, while the window holds fewer). Strictly, since a row as good as the kth
may have a smaller id. Depth doubles from `STEP`.

Candidates are dealt into blocks by a hash of their id; anchors come in blocks of
`ANCHORS`, and every block of anchors meets every block of candidates in a task of
its own, which hands on its best few per anchor and window. Positives are looked for
in blocks of one label, so that a label with a third of all rows is many blocks.
With many dimensions and vectors without structure the threshold falls slowly and
most of a block is met: the algorithm saves work, and never drops any.

Defined results: rows with a null label, id or vector, or with null or non-finite
components, take no part, nor do vectors of another length than the most common one
(ties: the shorter). Rows that repeat id, label and vector count once; rows that
share an anchor's id never answer for it; rows with one id and other contents are
rows of their own. Where too few rows fit, all of them are returned; an anchor
without positives, or with none in a window, has no rows there. An empty table gives
no rows. Components whose scores would not fit 64 bits raise an `OverflowError`.
Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.session import park

#: Candidates in a block, anchors in a block, and the first depth of sorted access.
BLOCK, ANCHORS, STEP = 8192, 4096, 64
SCORED = "anchor_id bigint, anchor_row bigint, id bigint, score bigint"
WINDOWED = "anchor_id bigint, anchor_row bigint, window int, id bigint, score bigint"


def usable(table: DataFrame, vector: str, key: str, label: Column, scale: int) -> DataFrame:
    """`id`, `label`, `v`: distinct rows that take part, components as integers, and `row`, a hash of all three."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = table.select(F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))).distinct()
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (common["n"] if common else 0))
    return rows.withColumn("row", F.xxhash64("id", "label", "v"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Lists:
    """A block's candidates with one sorted list per dimension."""

    def __init__(self, v: np.ndarray, anchors: np.ndarray):
        most = [max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0 for x in (v, anchors)]
        bound = most[0] * most[1] * v.shape[1]
        if bound >= 1 << 63:
            raise OverflowError("inner products of these vectors do not fit 64 bits")
        # doubles hold integers below 2^53 exactly and multiply faster
        self.v = v.astype(np.float64) if bound < 1 << 53 else v
        self.order = np.argsort(v, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.v, self.order, axis=0)

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Rows met anew, their scores, and the threshold for those not met yet, deeper and deeper."""
        n, anchor = len(self.v), anchor.astype(self.v.dtype)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) and not len(down):
            up = np.arange(1)  # all scores are 0: read one list to its end
        met, start, stop = np.zeros(n, bool), 0, min(STEP, n)
        while start < n:
            fresh = np.zeros(n, bool)
            fresh[self.order[n - stop : n - start, up].ravel()] = True
            fresh[self.order[start:stop, down].ravel()] = True
            rows = np.flatnonzero(fresh & ~met)
            met[rows] = True
            limit = self.sorted[n - stop, up] @ anchor[up] + self.sorted[stop - 1, down] @ anchor[down]
            yield rows, (self.v[rows] @ anchor).astype(np.int64), int(limit)
            start, stop = stop, min(2 * stop, n)


def best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows: highest score, then smallest id."""
    return np.lexsort((ids[rows], -scores))[:k]


def gather(lists: Lists, anchor: np.ndarray, allowed: np.ndarray, done: Callable[[np.ndarray, int], bool]) -> tuple[np.ndarray, np.ndarray]:
    """Allowed rows met, with scores, until `done(scores, threshold)`."""
    rows, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    for more, own, limit in lists.walk(anchor):
        fits = allowed[more]
        rows, scores = np.concatenate([rows, more[fits]]), np.concatenate([scores, own[fits]])
        if done(scores, limit):
            break
    return rows, scores


def kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k])


def tabled(schema: pa.Schema, parts: list[tuple]) -> pa.Table:
    if not parts:
        return schema.empty_table()
    return pa.table([pa.array(np.concatenate(x), f.type) for x, f in zip(zip(*parts, strict=True), schema, strict=True)], schema=schema)


def nearest_own(k: int):
    """The k best rows of a block with the anchor's label, for each anchor of a block."""
    schema = pa.schema([(c, pa.int64()) for c in ("anchor_id", "anchor_row", "id", "score")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, v, label = left["id"].to_numpy(), matrix(left["v"]), left["label"].to_numpy()
        asked, asked_row, asked_label = right["a_id"].to_numpy(), right["a_row"].to_numpy(), right["a_label"].to_numpy()
        anchors, parts = matrix(right["a_v"]), []
        for one in np.unique(asked_label):
            own = np.flatnonzero(label == one)
            if not len(own):
                continue
            lists, own_ids = Lists(v[own], anchors), ids[own]
            for i in np.flatnonzero(asked_label == one):
                enough = lambda scores, limit: len(scores) >= k and limit < kth(scores, k)
                rows, scores = gather(lists, anchors[i], own_ids != asked[i], enough)
                top = best(rows, scores, own_ids, k)
                parts.append((np.full(len(top), asked[i]), np.full(len(top), asked_row[i]), own_ids[rows[top]], scores[top]))
        return tabled(schema, parts)

    return run


def nearest_others(k: int, low: int, high: int):
    """The k best rows of a block with another label in every window of an anchor."""
    kinds = [("anchor_id", pa.int64()), ("anchor_row", pa.int64()), ("window", pa.int32()), ("id", pa.int64()), ("score", pa.int64())]
    schema = pa.schema(kinds)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, v, label = left["id"].to_numpy(), matrix(left["v"]), left["label"].to_numpy()
        anchors, parts = matrix(right["a_v"]), []
        lists = Lists(v, anchors)
        for i, row in enumerate(right.select(["a_id", "a_row", "a_label", "positives"]).to_pylist()):
            # scores s with low * positive <= 100 * s <= high * positive, ends as integers
            windows = [(-(-low * p // 100), high * p // 100) for p in row["positives"]]
            open_ = [w for w in windows if w[0] <= w[1]]
            if not open_:
                continue

            def done(scores: np.ndarray, limit: int, open_=open_) -> bool:
                for least, most in open_:
                    inside = scores[(scores >= least) & (scores <= most)]
                    if limit >= (kth(inside, k) if len(inside) >= k else least):
                        return False
                return True

            rows, scores = gather(lists, anchors[i], (label != row["a_label"]) & (ids != row["a_id"]), done)
            for n, (least, most) in enumerate(windows):
                inside = np.flatnonzero((scores >= least) & (scores <= most))
                top = inside[best(rows[inside], scores[inside], ids, k)]
                parts.append((
                    np.full(len(top), row["a_id"]), np.full(len(top), row["a_row"]), np.full(len(top), n), ids[rows[top]], scores[top],
                ))
        return tabled(schema, parts)

    return run


def met(rows: DataFrame, anchors: DataFrame, run, schema: str) -> DataFrame:
    """`run` over all pairs of a candidate block and an anchor block that share `block` and `crew`."""
    return rows.groupBy("block", "crew").cogroup(anchors.groupBy("block", "crew")).applyInArrow(run, schema)


def mine(
    table: DataFrame, is_anchor: Column, vector: str = "embedding", key: str = "vec_id", label: Column | None = None, scale: int = 256,
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """`anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score`.

    `is_anchor` is a condition over `id`; `low` and `high` bound a negative's score in
    hundredths of the positive's.
    """
    rows = park(usable(table, vector, key, F.col("label") if label is None else label, scale), "negatives-rows")
    per_label = park(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_anchor, 1)).alias("asking")), "negatives-labels")
    whole = per_label.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("asking"), F.lit(0)).alias("asking")).first()
    parts, crews = (max(1, -(-int(whole[c]) // size)) for c, size in (("n", BLOCK), ("asking", ANCHORS)))
    spread = lambda column, n: F.pmod(F.hash(column), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cut = lambda column, size: F.greatest(F.lit(1), F.ceil(F.col(column) / size)).cast("int")

    # positives: blocks of one label, small labels together in one block
    sizes = per_label.select("label", cut("n", BLOCK).alias("n_parts"), cut("asking", ANCHORS).alias("n_crews"))
    sized = rows.join(sizes, "label")
    block = lambda part: F.pmod(F.hash("label", part), F.lit(parts)).cast("int")
    of_label = sized.withColumn("block", block(spread("row", F.col("n_parts")))).withColumn("crew", every(F.col("n_crews")))
    of_part = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("n_parts") - 1), block))
    asking = sized.where(is_anchor).withColumn("block", F.explode(of_part)).withColumn("crew", spread("row", F.col("n_crews")))
    a = [F.col("id").alias("a_id"), F.col("row").alias("a_row"), F.col("label").alias("a_label"), F.col("v").alias("a_v")]
    own = met(of_label.select("id", "label", "v", "block", "crew"), asking.select(*a, "block", "crew"), nearest_own(positives), SCORED)
    of_anchor = W.partitionBy("anchor_id", "anchor_row").orderBy(F.desc("score"), "id")
    own = own.withColumn("place", F.row_number().over(of_anchor)).where(F.col("place") <= positives)
    listed = F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("own")
    own = park(own.groupBy("anchor_id", "anchor_row").agg(listed), "negatives-positives")

    # negatives: blocks of all labels
    asking = rows.where(is_anchor).join(own.select(F.col("anchor_id").alias("id"), F.col("anchor_row").alias("row"), "own"), ["id", "row"])
    asking = asking.select(*a, F.col("own.score").alias("positives"), every(F.lit(parts)).alias("block"), spread("row", F.lit(crews)).alias("crew"))
    others = rows.select("id", "label", "v", spread("row", F.lit(parts)).alias("block"), every(F.lit(crews)).alias("crew"))
    found = met(others, asking, nearest_others(negatives, low, high), WINDOWED)
    of_window = W.partitionBy("anchor_id", "anchor_row", "window").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(of_window)).where(F.col("rank") <= negatives)
    positive = F.col("own")[F.col("window")]
    return found.join(own, ["anchor_id", "anchor_row"]).select(
        "anchor_id", positive["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )
