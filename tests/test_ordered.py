import random

import pytest
from pyspark.sql import functions as F

from runloom.operators import ordered
from runloom.operators.ordered import Ordering, fill_down, number_breaks, over_key, with_next, with_place, with_previous
from runloom.operators.sequences import assign_sequences, number_runs, run_lengths
from runloom.operators.transitions import count_transitions, direction_shares, transition_differences


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for i in range(400):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 15)}"
        data.append((key, i, rng.choice("aab"), rng.choice([None, i])))
    return spark.createDataFrame(data, "k string, row long, v string, f long").repartition(5).cache()


def everything(df, order):
    out = number_breaks(df, order, ["v"], lambda before, now: before["v"] != now["v"])
    out = out.withColumnRenamed("_at", "at").withColumnRenamed("_opens", "opens").withColumnRenamed("_closes", "closes")
    a = {r["row"]: tuple(r) for r in out.select("k", "row", "run_no", "at", "opens", "closes").collect()}
    b = {r["row"]: tuple(r) for r in with_next(df, order, ["v"]).select("row", "next_v").collect()}
    c = {r["row"]: tuple(r) for r in with_previous(df, order, ["v"]).select("row", "prev_v").collect()}
    d = {r["row"]: tuple(r) for r in fill_down(df, order, ["f"]).select("row", "f").collect()}
    e = {r["row"]: tuple(r) for r in with_place(df, order, total="n").select("row", "place", "n").collect()}
    f = {r["row"]: tuple(r) for r in over_key(df, order, top=F.max("f")).select("row", "top").collect()}
    return a, b, c, d, e, f


def test_crowded_keys_give_the_plain_result(rows):
    plain = Ordering(("k",), "row").inspect(rows)
    cut = Ordering(("k",), "row", block=16).inspect(rows)
    assert plain.hot is None and cut.hot.count() >= 1
    assert everything(rows, plain) == everything(rows, cut)


def test_one_global_order_in_blocks(rows):
    whole = rows.withColumn("k", F.lit("all"))
    assert everything(whole, Ordering(("k",), "row")) == everything(whole, Ordering((), "row", block=16))


def test_borders_are_ranks_not_values(spark, rows):
    """Order values 2^33 apart, crowded at one end: blocks of at most `block` rows, few of them, and the same results."""
    wide = rows.withColumn("row", F.when(F.col("row") < 300, F.col("row") * (1 << 33)).otherwise(F.lit(300 << 33) + F.col("row")))
    plain = Ordering(("k",), "row").inspect(wide)
    for order in (Ordering(("k",), "row", block=32).inspect(wide), Ordering((), "row", block=32).inspect(wide)):
        sizes = order.with_block(order.hot_rows(wide)).groupBy(*order.keys, "_blk").count().collect()
        n = sum(r["count"] for r in sizes)
        assert max(r["count"] for r in sizes) <= 32 and len(sizes) <= 2 + 4 * n // 32
        if order.keys:
            assert everything(wide, plain) == everything(wide, order)
    whole = wide.withColumn("k", F.lit("all"))
    assert everything(whole, Ordering(("k",), "row")) == everything(whole, Ordering((), "row", block=32).inspect(whole))


def test_sampled_borders_of_a_long_key(spark):
    long = spark.range(200_000).select(F.lit("a").alias("k"), (F.col("id") * (1 << 33)).alias("row"))
    order = Ordering(("k",), "row", block=1 << 14).inspect(long)
    sizes = [r["count"] for r in order.with_block(long).groupBy("_blk").count().collect()]
    assert max(sizes) <= 1 << 14 and len(sizes) <= 60 and sum(sizes) == 200_000
    assert with_place(long, order).where(F.col("place") != F.col("row") / (1 << 33) + 1).count() == 0


def test_plan_of_a_keyed_scan_has_no_single_partition(rows):
    order = Ordering(("k",), "row", block=16).inspect(rows)
    plan = number_runs(rows.withColumn("sequence_id", F.col("v")), order)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_runs_by_adjacency(spark):
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(["a", "a", "b", "b", "b", "a", None, ""])], "k string, row long, sequence_id string")
    found = run_lengths(df, Ordering(("k",), "row")).orderBy("run_no").collect()
    assert [(r["sequence_id"], r["run_length"]) for r in found] == [("a", 2), ("b", 3), ("a", 1), ("sequence_0", 2)]


def episodes(spark, ids, **fields):
    base = {"sheet_name": "s", "athlete_id": "a", "weight_class": "", "opponent_name": "", "tournament_name": "", "event_date": ""}
    base.update(fields)
    names = list(base)
    return spark.createDataFrame(
        [(i, e, *[base[n] for n in names]) for i, e in enumerate(ids)],
        "source_row_index long, episode_id string, " + ", ".join(f"{n} string" for n in names),
    )


def sequences(df, **how):
    return assign_sequences(df, **how).orderBy("source_row_index").collect()


def test_blocks_restart_where_numbers_fall(spark):
    found = sequences(episodes(spark, ["1", "2", "1", "2"]))
    assert [r["sequence_id"][-2:] for r in found] == ["00", "00", "01", "01"]
    assert found[0]["sequence_id"] == "s::a::w=::opp=::tour=::date=::block_00"
    assert found[0]["sequence_quality_flag"] == "medium" and found[0]["sequence_quality_reason"] == "surrogate_episode_only"


def test_a_missing_number_breaks_the_comparison(spark):
    assert {r["sequence_id"][-2:] for r in sequences(episodes(spark, ["1", "x", "1"]))} == {"00"}


def test_more_than_99_blocks_and_blocked_scan(spark):
    ids = ["1"] * 120
    plain, cut = sequences(episodes(spark, ids)), sequences(episodes(spark, ids), block=7)
    assert plain[-1]["sequence_id"].endswith("::block_119")
    assert [r["sequence_id"] for r in plain] == [r["sequence_id"] for r in cut]
    assert [r["sequence_quality_flag"] for r in plain] == [r["sequence_quality_flag"] for r in cut]


def test_quality_steps(spark):
    rich = sequences(episodes(spark, ["1"], weight_class="60", opponent_name="o"))[0]
    assert (rich["sequence_quality_flag"], rich["sequence_quality_reason"]) == ("high", "surrogate_context_and_episode_id")
    part = sequences(episodes(spark, ["ep_a"], weight_class="60"))[0]
    assert (part["sequence_quality_flag"], part["sequence_quality_reason"]) == ("medium", "surrogate_partial_context")
    bare = sequences(episodes(spark, ["ep_a", "ep_b"]))[0]
    assert (bare["sequence_quality_flag"], bare["sequence_quality_reason"]) == ("low", "surrogate_no_context")


def test_explicit_ids(spark):
    found = sequences(episodes(spark, ["1", "1"]).withColumn("bout", F.lit(" b7 ")), explicit="bout")
    assert {r["sequence_id"] for r in found} == {"s::explicit::b7"} and found[0]["sequence_quality_flag"] == "high"


def test_transitions_stay_inside_runs(spark):
    df = spark.createDataFrame(
        [("s", i, seq, st) for i, (seq, st) in enumerate([("a", 0), ("a", 1), ("a", 1), ("b", 0), ("b", 2), ("a", 2)])],
        "k string, row long, sequence_id string, hidden_state int",
    )
    for order in (Ordering(("k",), "row"), Ordering(("k",), "row", block=2).inspect(df), Ordering((), "row", block=2)):
        counts = count_transitions(df, order)
        assert {(r["from_state"], r["to_state"]): r["count"] for r in counts.collect()} == {(0, 1): 1, (1, 1): 1, (0, 2): 1}
    shares = direction_shares(counts).first()
    assert round(shares["forward_share"], 6) == 0.666667 and round(shares["self_share"], 6) == 0.333333
    assert transition_differences(counts, counts).count() == 0
    assert direction_shares(counts.where("false")).first()["self_share"] == 1.0


def test_hot_keys_are_those_of_a_full_count(spark, rows, monkeypatch):
    """Keys that share a slot of hashed keys, or have nulls in some column, are told apart again; keys are not counted where no slot is crowded."""
    want = {r["k"] for r in rows.groupBy("k").count().where("count > 16").collect()}
    for slots, few in ((1, 1 << 10), (3, 1), (1 << 16, 1 << 10)):
        monkeypatch.setattr(ordered, "SLOTS", slots)
        monkeypatch.setattr(ordered, "FEW_SLOTS", few)
        found = Ordering(("k",), "row", block=16).inspect(rows).hot.select("k").collect()
        assert {r["k"] for r in found} == want and len(found) == len(want)
    monkeypatch.setattr(ordered, "SLOTS", 1)
    assert Ordering(("k",), "row", block=300).inspect(rows).hot is None  # a crowded slot without a crowded key
