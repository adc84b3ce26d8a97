"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Rows lie in partitions. How many rows of each partition go to each shard is drawn
first, from the law that a uniform permutation of all rows would give
(multivariate hypergeometric, one partition after the other). Then every
partition deals its rows out along a local permutation, and every shard permutes
what it received. The result is a uniform permutation, and shard sizes are exact:
they differ by one at most (law `rows`).

All of it is DataFrame work. The matrix is drawn by one expression over the array
of partition counts: each entry is an inverse transform of the hypergeometric law,
summed over a window of 12 standard deviations around its mode, with a hash of
(seed, partition, shard) as the uniform number, so a repeated task draws the same.

Rows get a number and a partition when they are first written to the shared
folder; everything later derives from that table, so lost tasks are recomputed
alike. A shard is permuted in buckets by a hash, with offsets from counts, so no
task sorts a whole shard.

Defined results: null text has size 1 and the checksum of the empty text; null
and repeated ids keep one place per row; an empty table gives no rows; columns
not named by `keep` are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.session import park

from .text import let

#: Rows in a bucket of a shard's second permutation, about.
BUCKET_ROWS = 200_000
SPREAD = 12


def uniform(*of: Column) -> Column:
    """A number in [0, 1) from a hash of the arguments."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / F.lit(float(1 << 53))


def hypergeometric(total: Column, marked: Column, draws: Column, u: Column) -> Column:
    """Marked ones among `draws` out of `total`, by inverse transform of `u`.

    Weights relative to the mode follow the ratio of neighbouring probabilities
    upwards and downwards; those further than `SPREAD` standard deviations (and 20)
    from the mode weigh less than 1e-30 together and are left out.
    """
    zero, nothing = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")

    # every step binds what the next ones use in their loops, so nothing is computed twice
    def bounds(x: Column) -> Column:
        low = F.greatest(zero, x["draws"] - (x["total"] - x["marked"]))
        high = F.least(x["draws"], x["marked"])
        mode = F.floor((x["draws"] + 1).cast("double") * (x["marked"] + 1) / (x["total"] + 2)).cast("bigint")
        p = x["marked"].cast("double") / F.greatest(x["total"], zero + 1)
        width = (F.lit(20.0) + SPREAD * F.sqrt(x["draws"] * p * (1 - p))).cast("bigint")
        return F.struct(low.alias("low"), high.alias("high"), F.least(high, F.greatest(low, mode)).alias("mode"), width.alias("width"))

    def draw(x: Column, b: Column) -> Column:
        near = F.struct(
            F.greatest(b["low"], b["mode"] - b["width"]).alias("start"), F.least(b["high"], b["mode"] + b["width"]).alias("stop"),
            b["mode"].alias("mode"),
        )
        return F.when(b["low"] >= b["high"], b["low"]).otherwise(let(near, lambda n: around(x, n)))

    def around(x: Column, n: Column) -> Column:
        #: p(k + 1) / p(k)
        ratio = lambda k: (x["marked"] - k).cast("double") * (x["draws"] - k) / (
            (k + 1).cast("double") * (x["total"] - x["marked"] - x["draws"] + k + 1)
        )

        def tail(places: Column, step) -> Column:
            """Sum and last of the weights along `places`, from weight 1 at the mode."""
            return F.aggregate(
                places,
                F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")),
                lambda acc, k: let(acc["w"] * step(k), lambda w: F.struct(w.alias("w"), (acc["sum"] + w).alias("sum"))),
            )

        def pick(g: Column) -> Column:
            return F.aggregate(
                F.sequence(n["start"], n["stop"]),
                F.struct(g["first"].alias("w"), F.lit(0.0).alias("sum"), n["start"].alias("k")),
                lambda acc, k: F.struct(
                    F.when(k < n["stop"], acc["w"] * ratio(k)).otherwise(0.0).alias("w"),
                    (acc["sum"] + acc["w"]).alias("sum"),
                    F.when(acc["sum"] + acc["w"] <= g["goal"], F.least(n["stop"], k + 1)).otherwise(acc["k"]).alias("k"),
                ),
                lambda acc: acc["k"],
            )

        up = F.when(n["mode"] < n["stop"], F.sequence(n["mode"], n["stop"] - 1)).otherwise(nothing)
        down = F.when(n["mode"] > n["start"], F.sequence(n["mode"] - 1, n["start"], zero - 1)).otherwise(nothing)
        ends = F.struct(tail(up, ratio).alias("up"), tail(down, lambda k: 1 / ratio(k)).alias("down"))
        goal = lambda e: F.struct(e["down"]["w"].alias("first"), (x["u"] * (1 + e["up"]["sum"] + e["down"]["sum"])).alias("goal"))
        return let(ends, lambda e: let(goal(e), pick))

    given = F.struct(total.alias("total"), marked.alias("marked"), draws.alias("draws"), u.alias("u"))
    return let(given, lambda x: let(bounds(x), lambda b: draw(x, b)))


def matrix(parts: DataFrame, shards: int, seed: int) -> DataFrame:
    """`part`, `counts` (an array with a number for each shard) from `part`, `n`.

    One row holds the array of partition counts, as many as there are partitions;
    the fold carries what each shard can still take.
    """
    zero = F.lit(0).cast("bigint")
    one_row = parts.groupBy().agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"), F.sum("n").alias("total"))
    shard_ids = F.sequence(F.lit(0), F.lit(shards - 1))
    sizes = F.transform(
        shard_ids, lambda s: F.floor(F.col("total") / shards).cast("bigint") + F.when(s < F.col("total") % shards, 1).otherwise(0)
    )

    def deal(acc: Column, part: Column) -> Column:
        """A partition's rows dealt to the shards in turn, each draw out of what is left."""
        room = F.aggregate(acc["free"], zero, lambda a, x: a + x)
        drawn = F.aggregate(
            shard_ids,
            F.struct(part["n"].alias("left"), room.alias("room"), F.array().cast("array<bigint>").alias("out")),
            lambda a, s: let(
                hypergeometric(a["room"], F.get(acc["free"], s), a["left"], uniform(F.lit(seed), part["part"], s)),
                lambda k: F.struct((a["left"] - k).alias("left"), (a["room"] - F.get(acc["free"], s)).alias("room"), F.concat(a["out"], F.array(k)).alias("out")),
            ),
            lambda a: a["out"],
        )
        return let(drawn, lambda row: F.struct(
            F.zip_with(acc["free"], row, lambda f, k: f - k).alias("free"),
            F.concat(acc["rows"], F.array(F.struct(part["part"].alias("part"), row.alias("counts")))).alias("rows"),
        ))

    start = F.struct(sizes.alias("free"), F.array().cast("array<struct<part:int,counts:array<bigint>>>").alias("rows"))
    return one_row.where(F.col("total") > 0).select(
        F.explode(F.aggregate("parts", start, deal, lambda acc: acc["rows"])).alias("r")
    ).select("r.part", "r.counts")


def shuffle(rows: DataFrame, shards: int = 16, seed: int = 20, keep: Sequence[str] | None = None) -> DataFrame:
    """`rows` with `shard` and the gapless `slot` (from 0) in it."""
    keep = list(keep or rows.columns)
    numbered = park(
        rows.select(F.struct(*keep).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("rid")),
        "sharding",
    )
    counts = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    drawn = matrix(counts, shards, seed)
    # local permutation; the running sums of the partition's counts say which shard takes which rank
    ends = F.transform("counts", lambda c, i: F.aggregate(F.slice("counts", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x))
    rank = F.row_number().over(W.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), F.lit(1), "rid"), "rid"))
    dealt = (
        numbered.withColumn("rank", rank)
        .join(drawn.select("part", ends.alias("ends")), "part")
        .select("row", "rid", F.size(F.filter("ends", lambda e: e < F.col("rank"))).alias("shard"))
    )
    # second permutation, by buckets of the shard; their number follows the number of rows
    wide = max(1, -(-numbered.count() // (BUCKET_ROWS * shards)))
    mixed = dealt.withColumn("h", F.xxhash64(F.lit(seed), F.lit(2), "rid"))
    mixed = mixed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(3), "h"), F.lit(wide)).cast("int"))
    sized = mixed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sized.select(
        "shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before")
    )
    within = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("h", "rid")) - 1
    return (
        mixed.withColumn("within", within)
        .join(before, ["shard", "bucket"])
        .select(*[F.col("row").getField(c).alias(c) for c in keep], "shard", (F.col("before") + F.col("within")).alias("slot"))
    )


def sized(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`doc_id`, `size` (UTF-8 bytes plus one) and `text_crc32` of every document."""
    raw = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(raw, "UTF-8")).alias("text_crc32"),
    )
