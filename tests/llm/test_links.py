"""Nearest neighbours, the n-gram join and the pipeline against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runloom.llm import catalog, components, mixing, nearest, ngram_join, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n):
    found = WORD.findall((text or "").translate(UPPER))
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} or ({tuple(found)} if found else set())


def brute_components(rows, n, similarity):
    """doc index -> root index."""
    sets = [grams(t, n) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return sets, [top(i) for i in range(len(rows))]


def corpus(seed, groups=12, others=40):
    """Near copies at several distances, chains of them, shared passages, and strangers."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=60)
    rows = []
    for g in range(groups):
        base = rng.choices(words, k=rng.choice([6, 40, 120]))
        for _ in range(rng.randint(2, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if g % 3 == 0:
                base = copy  # a chain
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    for _ in range(others):
        rows.append(" ".join(rng.choices(words, k=rng.randint(1, 80)) + (passage if rng.random() < 0.5 else [])))
    rows += [rows[0]] * 5 + [None, "", " \n", "one", "ONE", "two words", "two  words", "a b c", "x " * 900]
    rng.shuffle(rows)
    return [(i, t, "s") for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed, n, similarity, chunk", [(1, 4, 85, 400), (2, 5, 80, 3), (3, 1, 50, 7), (4, 2, 100, 400)])
def test_join(spark, documents, monkeypatch, seed, n, similarity, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    rows = corpus(seed)
    sets, roots = brute_components(rows, n, similarity)
    got = {r.doc_id: r for r in ngram_join.linked(documents(rows), n, similarity).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        assert got[i].n_shingles == len(sets[i]) and got[i].component_id == roots[i], (i, t)


def linkable(most, similarity):
    """Sizes of two sets, the larger one first, with the least overlap that links them."""
    for a, b in itertools.combinations_with_replacement(range(most, 0, -1), 2):
        overlap = -(-similarity * (a + b) // (100 + similarity))
        if overlap <= b:
            yield a, b, overlap


@pytest.mark.parametrize("similarity", [50, 80, 85, 95, 100])
def test_fronts_of_all_sizes(similarity):
    """The n-grams that only one of two linked sets has come first: the fewest that are counted twice."""
    for a, b, overlap in linkable(200, similarity):
        left, right = [range(n - overlap) for n in (a, b)]
        left, right = [*(("a", i) for i in left), *range(overlap)], [*(("b", i) for i in right), *range(overlap)]
        (la, da), (lb, db) = (ngram_join.front_and_demand(n, similarity) for n in (a, b))
        both = len(set(left[:la]) & set(right[:lb]))
        assert both >= max(da, db) and min(da, db) >= 1, (a, b)


def test_join_of_sizes_whose_fronts_differ(spark, documents):
    """Pairs that nothing else repeats, of all linkable sizes, with the words that one lacks first in order of their hashes."""
    got = ngram_join.linked(documents([(1, "a b c d e f g h i j", "s"), (2, "a b c d e f g h i", "s")]), 4, 85).collect()
    assert [r.component_id for r in got] == [1, 1]
    pairs = [p for p in linkable(45, 85)]
    known = ngram_join.Words()
    words = [f"w{i}" for i in range(sum(a + b - o for a, b, o in pairs))]
    words = iter(sorted(words, key=lambda w: ngram_join.ngram_hashes([w.encode()], 1, known)[0]))
    rows = []
    for a, b, o in pairs:
        left, right, shared = ([next(words) for _ in range(n)] for n in (a - o, b - o, o))
        rows += [(len(rows), " ".join(left + shared), "s"), (len(rows) + 1, " ".join(right + shared), "s")]
    got = ngram_join.linked(documents(rows), 1, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i // 2 * 2 for i in range(len(rows))}


def test_join_without_ids_and_rows(spark, documents):
    rows = [(None, "a b c d e", "s"), (4, "a b c d e", "s"), (None, "no id at all", "s"), (4, "other words in here", "s"), (4, "a b c d e", "s"), (None, None, "s")]
    got = ngram_join.linked(documents(rows), 4, 85).collect()
    assert sorted(str(r.component_id) for r in got) == sorted(["4", "4", "None", "4", "4", "None"])
    docs = documents(rows).withColumn("__same", F.lit("own"))
    kept = ngram_join.keep_one(docs, 4, 85)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [
        ("4", "a b c d e"), ("4", "other words in here"), ("None", "None"), ("None", "no id at all")]
    assert ngram_join.linked(documents([])).count() == 0 and ngram_join.keep_one(documents([])).count() == 0


def test_near_copies_make_few_pairs(spark, documents, monkeypatch):
    """A large group of near copies, in many chunks: components meet by one pair each, not by all of theirs."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    bases = [rng.choices(words, k=200) for _ in range(2)]
    rows = []
    for i in range(5000):
        copy = list(bases[i % 50 == 0])
        for _ in range(rng.randint(1, 2)):
            copy[rng.randrange(200)] = rng.choice(words)
        rows.append((i, " ".join(copy), "s"))
    rows += [(5000 + i, " ".join(bases[0][:100] + rng.choices(words, k=100)), "s") for i in range(300)]  # share words, are not linked
    counts, park = [], ngram_join.park

    def counted(df, name="table"):
        out = park(df, name)
        if name == "pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "park", counted)
    monkeypatch.setattr(ngram_join, "CHUNK", 60)
    monkeypatch.setattr(ngram_join, "PART", 700)
    got = {r.doc_id: r.component_id for r in ngram_join.linked(documents(rows), 4, 85).collect()}
    assert {got[i] for i in range(0, 5000, 50)} == {0} and {got[i] for i in range(5000) if i % 50} == {1}
    assert all(got[i] == i for i in range(5000, 5300))
    assert sum(counts) < 10_000, counts


def test_hashes_tell_ngrams_apart():
    known = ngram_join.Words()
    one = lambda text, n: ngram_join.ngram_hashes(text.encode().split(), n, known).tolist()
    assert len(one("a b c a b c a b", 3)) == 3 and one("", 3) == [] and len(one("a", 3)) == 1 == len(one("a b", 3))
    assert len({one(t, 3)[0] for t in ("a", "b", "a b", "b a", "ab", "a b c", "c b a", "a a b", "a a", "a a a")}) == 10
    assert one("x y z", 3) == one("x  y\tz", 3) and set(one("a b c d", 2)) == set(one("a b", 2)) | set(one("b c", 2)) | set(one("c d", 2))
    many = one(" ".join(f"w{i}" for i in range(50_000)), 4)
    assert len(many) == 49_997 and many == sorted(many)
    import pyarrow as pa

    assert list(ngram_join.words_of(pa.array([None, "", "É A\u00a0b\x1cK\x0bK"]))) == [[], [], ["É".encode(), "a\u00a0b\x1ck".encode(), b"k"]]


def test_trie_finds_all_partners():
    rng = np.random.default_rng(5)
    base = rng.permutation(200)[:60]
    sets = []
    for _ in range(60):
        s = np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.1, 0.4]), rng.integers(0, 200, 60), base))
        sets.append(s[: rng.integers(1, len(s) + 1)] if rng.random() < 0.2 else s)
    sets += [sets[0], sets[1][:5]]
    for similarity in (50, 80, 85, 100):
        trie = ngram_join.Trie(sets, similarity)
        for i, a in enumerate(sets):
            want = [j for j, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= similarity * len(np.union1d(a, b))]
            assert sorted(trie.partners(i)) == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(20, 40)] + [(3, 3), (20, 9), (500, 499), (499, 500)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in (7, 9, *range(20, 40))}, 499: 499, 500: 499}


def exact(rows, query, k):
    q = np.array(dict(rows)[query])
    found = [(float(np.sqrt(((np.array(v) - q) ** 2).sum())), i) for i, v in rows if i != query]
    return sorted(found)[:k]


def test_few_vectors_are_found_whole(spark):
    """Ties, equal vectors, and tables smaller than k: all candidates, in order."""
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(0, 1000, 25)] + [(7, [0.5, 0.5, -3.0])]
    bad = [(1100, None), (1200, [0.0, 0.0, 0.0]), (1300, [1.0, nan, 1.0]), (1400, [inf, 1.0, 1.0]), (1500, [1.0, None, 1.0]), (1600, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    rows = spark.createDataFrame([(i, v, "x") for i, v in good + bad + good[:3]], "vec_id bigint, embedding array<float>, score string")
    for k in (3, 10, 60):
        got = nearest.search(rows, F.col("id") % 100 == 0, k)
        found = {}
        for r in got.orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert sorted(found) == list(range(0, 1000, 100))
        for q, answers in found.items():
            want = exact(good, q, k)
            assert [a[1] for a in answers] == [e[1] for e in want] and [a[0] for a in answers] == pytest.approx([e[0] for e in want])
    assert nearest.search(rows.limit(0), F.col("id") % 100 == 0).count() == 0


def test_crowded_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CHUNK", 20)
    monkeypatch.setattr(nearest, "TASK_ROWS", 100)
    rng = np.random.default_rng(1)
    good = [(i, (np.ones(8) + 0.01 * rng.normal(size=8)).tolist()) for i in range(300)]
    rows = spark.createDataFrame(good, "vec_id bigint, embedding array<double>")
    got = nearest.search(rows, F.col("id") % 100 == 0, 5).orderBy("query_id", "rank").collect()
    for q in (0, 100, 200):
        assert [r.vec_id for r in got if r.query_id == q] == [i for _, i in exact(good, q, 5)]


def test_visits_go_from_likely_to_unlikely():
    hashing = nearest.Hashing(4, 1.0, 1, 3, 1.0, 20, 0)
    place = np.array([0.1, 0.5, 0.95])
    visits = hashing.visits(place)
    assert len({tuple(v) for v in visits}) == 20 and tuple(visits[0]) == (0, 0, 0) and tuple(visits[1]) == (0, 0, 1)
    cost = [sum((p - np.floor(p)) ** 2 if d < 0 else (1 - p + np.floor(p)) ** 2 if d > 0 else 0 for p, d in zip(place, v - np.floor(place), strict=True)) for v in visits]
    assert cost == sorted(cost)


def test_recall_on_the_given_table(spark, sf):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in catalog.table(spark, sf, "embeddings").collect()]
    got = catalog.op3_nearest(spark, sf).collect()
    hits = total = 0
    for q in {r.query_id for r in got}:
        want = {i for _, i in exact(rows, q, 10)}
        hits += len(want & {r.vec_id for r in got if r.query_id == q})
        total += len(want)
    assert hits >= 0.9 * total


def test_pipeline(spark, sf):
    """run() against the same decisions taken in plain Python."""
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(catalog.vocabulary())
    docs = catalog.table(spark, sf, "documents")
    good = {r.doc_id for r in quality_rules.ledger(docs).where(quality_rules.passes("v2")).collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.orderBy("doc_id").collect() if r.doc_id in good]
    _, roots = brute_components(rows, 5, 80)
    kept = [r for i, r in enumerate(rows) if roots[i] == i]
    taken = {r.doc_id: r.times for r in mixing.mix(spark.createDataFrame(kept, "doc_id bigint, text string, source string")).collect()}
    want = sorted((i, library.encode(t, add_special_tokens=False).ids) for i, t, _ in kept for _ in range(taken[i]))
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_the_columns(spark, sf):
    docs = catalog.table(spark, sf, "documents").limit(50)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_stages_take_odd_rows(spark):
    """Nulls in all columns, empty and very long texts, repeated rows, empty tables and clashing names, for every stage."""
    long = " ".join(f"word{i}" for i in range(60_000))
    good = " ".join(f"good{i}" for i in range(40))
    rows = [(1, good, "en", "a", 9), (1, good, "en", "a", 9), (2, None, None, None, None), (None, good + " tail", None, None, None), (3, "", "en", "b", 0),
            (4, long, "en", "b", 1), (5, " \n", "en", None, 1), (None, None, None, None, None), (6, good + " tail", "de", "a", 7)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema)
    counts = {"quality_rules": 5, "ngram_join": 6}
    for name, stage in corpus_pipeline.STAGES:
        wide = docs.selectExpr("*", "1 AS n", "'x' AS same", "'y' AS size", "2 AS ids", "3 AS rid", "4 AS __same", "5 AS root")
        assert stage(spark, docs.limit(0), "").count() == 0, name
        for table in (docs, wide):
            made = stage(spark, table, "")
            found = made.count()
            assert found == counts.get(name, found), name
            if name != "bpe":
                assert made.columns == table.columns, name
    assert {r.doc_id: r.n_tokens > 0 for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()}[4]
