"""Quality rules, URL filter, mixing and sharding against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.llm import mixing, quality_rules, sharding, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h a b c d e f g h i", "x " * 40, "line one\nline one\nother\n\nline one", "é ü\x0bß # $ %",
    "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3, "lone " * 7, "<a> *b* " * 30, "\x1cnot space\x85here", "k" * 5000 + " " + "q " * 9000,
]


def measured(text):
    text = text or ""
    found = WORD.findall(text)
    windows = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    inside = {i + k for i in range(len(found) - 7) if windows[tuple(found[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(inside)
    )


def test_measurements(spark, documents):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "a b", "s"), (3, "one", "s")]
    got = quality_rules.ledger(documents(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        assert tuple(by_id[i][m] for m in quality_rules.MEASURES) == measured(t), i


def test_policies_and_ablation(spark, documents):
    entries = quality_rules.ledger(documents([(i, t, "s") for i, t in enumerate(TEXTS)])).cache()
    bits = [r.failed_bits for r in entries.collect()]
    for version, names in quality_rules.POLICIES.items():
        own = quality_rules.mask(names)
        assert entries.where(quality_rules.passes(version)).count() == sum(b & own == 0 for b in bits)
        for r in quality_rules.ablation(entries, version).collect():
            bit = quality_rules.mask([r.rule])
            assert (r.n_failed, r.n_only, r.n_docs) == (sum(b & bit > 0 for b in bits), sum(b & own == bit for b in bits), len(bits))
    empty = documents([])
    assert quality_rules.ledger(empty).count() == 0 and quality_rules.apply_policy(empty).columns == empty.columns


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
URLS = [
    None, "", "no scheme", "http://Example.ORG/es/1", "http://a.example.org/en/12?x=/es/", "http://example.org/en/2", "http://xexample.org/es/",
    "https://b.com/fr", "https://b.com/fr/?q", "ftp://c.de.com/de/#f", "http://org", "http://bad.net/x", "http://sub.bad.net", "http://bad.net.org/",
    "http://x.org://y.com/fr/", "http://one.net/only", "http://one.net/only/more", "http://u:p@h.com:80/de/", "http://nl.com/de/a\nb",
]


def judged(url, listed, exact):
    _, sep, rest = (url or "").partition("://")
    rest = rest if sep else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in RULES:
        h, _, p = rule.partition("/")
        if ("." + host).endswith("." + h) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    own = "block" if any(("." + host).endswith("." + h) for h in listed) or host + path in exact else "allow"
    return host, path, best and best[0], best[1] if best else own


@pytest.mark.parametrize("blocks", [1, 1 << 10])
def test_urls(spark, monkeypatch, blocks):
    monkeypatch.setattr(url_filter, "blocks_for", lambda n: blocks)  # one block: nearly everything passes the filter
    lists = [(r, v, "prefix", "rule") for r, v in RULES] + [("bad.net", "block", "prefix", "list"), ("one.net/only", "block", "exact", "list")]
    listed = spark.createDataFrame(lists, "rule string, verdict string, kind string, tier string")
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[3], "x"), (3, URLS[3], "x")], "page_id bigint, url string, host string")
    got = url_filter.judge(pages, listed).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = URLS[3] if r.page_id is None else URLS[r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == judged(url, ["bad.net"], ["one.net/only"]), url
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, listed.limit(0)).collect()} == {"allow"}


def test_bloom_filter_drops_most(spark):
    keys = spark.range(1000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("key"))
    n = url_filter.blocks_for(1000)
    filled = url_filter.bloom(keys, n)
    asked = spark.range(20000).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("key")).union(keys)
    hit = asked.select("key", url_filter._block(F.col("key"), n).alias("block")).join(filled, "block")
    for i, m in enumerate(url_filter._masks(F.col("key"))):
        hit = hit.where(F.col(f"w{i}").bitwiseAND(m) != 0)
    passed = hit.select("key").collect()
    assert sum(r.key[0] == "p" for r in passed) == 1000 and len(passed) < 1000 + 0.05 * 20000


def filled(sizes, weights, budget, cap):
    goal, free, rest = {}, dict(weights), budget
    while free:
        level = rest / sum(free.values())
        over = [s for s, w in free.items() if level * w >= cap * sizes[s]]
        if not over:
            return goal | {s: level * w for s, w in free.items()}
        for s in over:
            goal[s] = cap * sizes[s]
            rest -= goal[s]
            del free[s]
    return goal


def test_mix(spark, documents):
    random = np.random.default_rng(1)
    sources = ["b", "a", None, "Z", "é"]
    rows = [(i, "w " * int(random.integers(0, 40)), sources[min(int(random.integers(0, 9)), 4)]) for i in range(3000)]
    rows += [(None, "w w w", "a"), (5, "w w", "b"), (5, "w w", "b"), (9001, None, "a"), (9002, "", "none but this")]
    got = mixing.mix(documents(rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal = filled(sizes, weights, 1.5 * sum(sizes.values()), 2)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source], abs=1e-5) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 20.5, s
    again = mixing.mix(documents(rows[::-1]).repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)
    docs = documents(rows)
    repeated = mixing.repeat(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r.times for r in got)
    assert mixing.mix(documents([])).count() == 0 and mixing.repeat(documents([])).count() == 0


def test_buckets_of_the_order_give_the_same_mix(spark, documents, monkeypatch):
    rows = [(i, "w " * (i % 23), "ab"[i % 3 == 0]) for i in range(2000)]
    plain = Counter(mixing.mix(documents(rows)).collect())
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    assert Counter(mixing.mix(documents(rows)).collect()) == plain


@pytest.mark.parametrize("n, shards", [(0, 4), (1, 4), (5, 16), (1000, 16), (1003, 7)])
def test_shards(spark, monkeypatch, n, shards):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    docs = spark.range(n, numPartitions=5).select((F.col("id") % 300).alias("doc_id"), F.when(F.col("id") % 4 > 0, F.lit("té")).alias("text"), F.lit(1).alias("shard_"))
    got = sharding.shuffle(sharding.sized(docs), shards).collect()
    assert Counter(r.doc_id for r in got) == Counter(i % 300 for i in range(n))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.size in (1, 4)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_draws_follow_the_law(spark):
    for total, marked, draws in ((100, 30, 20), (1000, 10, 500), (60000, 3750, 6000)):
        args = [F.lit(x).cast("bigint") for x in (total, marked, draws)]
        got = [r.k for r in spark.range(4000).select(sharding.hypergeometric(*args, sharding.uniform(F.col("id"))).alias("k")).collect()]
        mean = draws * marked / total
        var = mean * (1 - marked / total) * (total - draws) / (total - 1)
        assert abs(np.mean(got) - mean) < 5 * (var / 4000) ** 0.5 and abs(np.var(got) / var - 1) < 0.15
        assert min(got) >= max(0, draws - total + marked) and max(got) <= min(draws, marked)


def test_matrix_margins(spark):
    parts = spark.createDataFrame([(0, 50), (1, 3), (4, 947)], "part int, n bigint")
    rows = {r.part: r.counts for r in sharding.matrix(parts, 6, 1).collect()}
    assert {p: sum(c) for p, c in rows.items()} == {0: 50, 1: 3, 4: 947}
    assert sorted(sum(c[s] for c in rows.values()) for s in range(6)) == [166, 166, 167, 167, 167, 167]


def test_shuffle_is_uniform(spark):
    rows = spark.range(64, numPartitions=4)
    seen = np.zeros((64, 4))
    for seed in range(30):
        for r in sharding.shuffle(rows.withColumnRenamed("id", "i"), 4, seed).collect():
            seen[r.i, r.shard] += 1
    # 30 draws with chance 1/4 for each cell
    assert abs(seen.mean() - 7.5) < 1e-9 and ((seen - 7.5) ** 2).mean() == pytest.approx(30 * 0.25 * 0.75, rel=0.35)


def test_sharding_query(spark, documents, tmp_path):
    """Every column of op7_sharding against plain Python: sizes, checksums, law, shards, slots."""
    import zlib

    from runloom.llm import catalog

    rows = [(i, t, "s") for i, t in enumerate(TEXTS * 9)] + [(None, "no id", "s"), (None, None, "s"), (3, "same id", "s"), (3, "same id", "s")]
    documents(rows).repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.op7_sharding(spark, str(tmp_path)).collect()
    data = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(data(t)) + 1, zlib.crc32(data(t))) for i, t, _ in rows)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(16)]
    assert set(slots) == set(range(16)) and max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
