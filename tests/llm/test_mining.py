"""Collocations, hard negatives and licence scans against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runloom.llm import collocations, hard_negatives, license_scan

DOCS = "doc_id bigint, text string, lang string, n bigint, rank string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def collocated(rows, least, longest, cover, top, scale):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything."""
    counts, sizes = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least}
        kept = []
        for p, a in found.items():
            around = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if len(p) > 1 and not any(100 * b >= cover * a for b in around):
                score, _, l, r = min((scale * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


PHRASES = [
    (1, "New York is New York. new york, NEW\tYORK\nnew\x0byork", "en", 1, "x"), (2, None, "en", 1, "x"), (3, "", None, 1, "x"),
    (4, "a b c d " * 9 + ". b c d", "en", 1, "x"), (4, "a b c d " * 9 + ". b c d", "en", 1, "x"), (None, "é ü é ü é ü; İ K k É É", None, 1, "x"),
    (5, "zwei drei " * 3000, "de", 1, "x"), (6, " \t.,;:!?\n", "fr", 1, "x"), (7, "x.y,z y z y z", "", 1, "x"), (8, "new york" + "." * 9, None, 1, "x"),
]


def test_phrases_of_odd_rows(spark):
    got = collocations.mine(spark.createDataFrame(PHRASES, DOCS), least=2, top=5)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == collocated(PHRASES, 2, 4, 80, 5, 2_000_000)
    assert collocations.mine(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.mine(spark.createDataFrame(PHRASES[1:3], DOCS)).count() == 0


@pytest.mark.parametrize("size", [1 << 21, 50])
def test_phrases_over_many_blocks(spark, size):
    draw = np.random.default_rng(5)
    text = lambda: " ".join(draw.choice(["a", "B", "c", "d", "."], 60, p=[0.4, 0.3, 0.1, 0.05, 0.15]))
    rows = [(i, text(), str(draw.choice(["en", "de"])), 1, "x") for i in range(60)]
    want = collocated(rows, 5, 4, 80, 500, 2_000_000)
    assert len({r[0] for r in want}) == 2 and max(len(r[2].split()) for r in want) == 4
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    assert sorted(map(tuple, collocations.mine(docs, least=5, top=500, block_words=size).collect())) == want


@pytest.mark.parametrize("bucket", [1, 40, 1 << 21])
def test_phrases_counted_in_buckets(spark, monkeypatch, bucket):
    """However many buckets there are, also more than groups, no group is lost or counted apart."""
    monkeypatch.setattr(collocations, "BUCKET", bucket)
    monkeypatch.setattr(collocations, "LISTED", 3)
    draw = np.random.default_rng(6)
    text = lambda: " ".join(draw.choice(["é", "B", "c", "same", "."], 40, p=[0.4, 0.3, 0.1, 0.05, 0.15]))
    rows = [(i, text(), [None, "de"][i % 2], 1, "x") for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert sorted(map(tuple, collocations.mine(docs, least=3, top=500, block_words=100).collect())) == collocated(rows, 3, 4, 80, 500, 2_000_000)


def test_pairs_are_shuffled_in_packed_rows():
    """A row for each block and bucket, of a few bytes for each pair, with nothing left out."""
    import pyarrow as pa

    draw = np.random.default_rng(7)
    pairs = np.unique(draw.integers(0, 20_000, (50_000, 2)) * (1, 1 << 33), axis=0)
    lists = pa.table({"block": [5 << 32], "lang": ["en"], "first": pa.array([0], pa.int32()), "lefts": [pairs[:, 0]], "rights": [pairs[:, 1]], "counts": [np.ones(len(pairs), np.int32)]})
    rows = collocations.block_pieces(lists, 16)
    assert sorted(rows["bucket"].to_pylist()) == list(range(16)) and rows.nbytes < 7 * len(pairs)
    got = []
    for r in rows.to_pylist():
        codes = np.cumsum(collocations.unpack(r["codes"], r["n"]))
        lefts, rights = np.cumsum(collocations.unpack(r["names"][0], r["n"], "<i8")), collocations.unpack(r["names"][1], r["n"], "<i8")
        assert collocations.unpack(r["counts"], r["n"]).tolist() == [1] * r["n"]
        got += zip(codes.tolist(), lefts.tolist(), rights.tolist(), strict=True)
    assert sorted(got) == [(i, a, b) for i, (a, b) in enumerate(pairs.tolist())]


def test_joins_make_the_pieces_of_their_pairs(spark, monkeypatch):
    """Relations of pairs are parked packed: no plan that counts pairs sends lists of them to Python."""
    plans, put = [], collocations.Shelf.put

    def spied(shelf, df, name="table"):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString(), df.dtypes))
        return put(shelf, df, name)

    monkeypatch.setattr(collocations.Shelf, "put", spied)
    rows = [(i, "a b c a b d. a b", "en", 1, "x") for i in range(6)] + [(9, "p. q. p. q.", "fr", 1, "x")] * 3
    got = collocations.mine(spark.createDataFrame(rows, DOCS), least=3)
    assert sorted(map(tuple, got.collect())) == collocated(rows, 3, 4, 80, 2000, 2_000_000)
    counted = [plan for name, plan, _ in plans if name == "phrases-frequent"]
    assert [plan.count("MapInArrow") for plan in counted] == [1, 0, 0, 0]
    assert all(("codes", "binary") in kinds and "array<bigint>" not in dict(kinds).values() for name, _, kinds in plans if name == "phrases-pairs")


def test_words_of_any_bytes():
    import pyarrow as pa

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text(alphabet="aB é€\U0001f600.\t\n\x0b\x00", max_size=12), max_size=6))
    def same(texts):
        data, lengths, fresh = collocations.cut(pa.array(texts, pa.string()))
        ends = np.cumsum(lengths)
        got = [data.tobytes()[e - n : e].decode() for e, n in zip(ends, lengths, strict=True)]
        pieces = [re.findall(r"[^\x20\x09]+", p) for t in texts for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(t))]
        assert got == [w for p in pieces for w in p]
        assert fresh.tolist() == [i == 0 for p in pieces for i in range(len(p))]

    same()


def test_groups_are_listed_in_bounded_rows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "LISTED", 3)
    ids = pa.array(range(8))
    rows = collocations.block_rows(collocations.PAIRS, 5, "en", np.array([2, 1]), np.array([7, 0]), ids, ids, ids).to_pylist()
    assert [r["lefts"] for r in rows] == [None, [0, 1, 2], [3, 4, 5], [6, 7]] and [r["first"] for r in rows] == [None, 0, 3, 6]
    assert collocations.unpack(rows[0]["code"], 2).tolist() == [7, 0] and all(r["step"] is None for r in rows[1:])


def test_counts_past_32_bits(spark):
    """Scores whose products pass 64 bits: counts are raised between the rounds and the ranking."""
    big = 9_000_000_000_000_000_000
    one = spark.createDataFrame(
        [(9, "en", ["a", "b"], big, 1, 2, [big, big], [big - 7, big])],
        "id bigint, lang string, words array<string>, total bigint, lefts bigint, rights bigint, firsts array<bigint>, lasts array<bigint>",
    )
    sizes = spark.createDataFrame([("en", big)], "lang string, n bigint")
    row = collocations.ranked([one], sizes, 80, 10, 2_000_000).first()
    assert row.score == 2_000_000 * big // (big + big - 7) and (row.l, row.r) == (big, big - 7)


VECTORS = "vec_id bigint, embedding array<float>, label int, id string"


def mined(rows, k_pos=5, k_neg=5):
    """Hard negatives by scoring all pairs."""
    used = set()
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        used.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)))
    lengths = Counter(len(v) for _, _, v in used)
    usual = max(lengths, key=lambda n: (lengths[n], -n)) if lengths else 0
    used = [r for r in used if len(r[2]) == usual]
    out = []
    for i, label, v in used:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, other) for j, other, w in used if j != i)
        for p, j, other in [x for x in scored if x[2] == label][:k_pos]:
            inside = [(s, m) for s, m, o in scored if o != label and -80 * p <= -100 * s <= -100 * p][:k_neg]
            out += [(i, j, rank, m, -p, -s) for rank, (s, m) in enumerate(inside, 1)]
    return sorted(out)


def turned():
    label = F.col("label").cast("bigint")
    return F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)


def vectors(n, dim, seed, labels=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(labels, dim))
    return [(i, [float(x) for x in (centres[i % labels] + draw.normal(size=dim)).astype(np.float32)], i % labels, "x") for i in range(n)]


@pytest.mark.parametrize("block, anchors", [(8192, 4096), (40, 2)])
def test_hard_negatives(spark, monkeypatch, block, anchors):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "STEP", 4)
    rows = vectors(600, 6, 1)
    same = [0.5] * 6
    rows += [(1000 + i, same, i % 2, "x") for i in range(30)] + [(2000 + i, [0.0] * 6, 1, "x") for i in range(12)]  # ties
    rows += [rows[100], rows[100], (200, rows[300][1], 1, "x"), (None, same, 1, "x"), (3000, None, 1, "x"), (3100, same, None, "x")]
    rows += [(3200, [None] + same[1:], 1, "x"), (3300, [float("nan")] + same[1:], 1, "x"), (3400, [float("-inf")] + same[1:], 1, "x"), (3500, [1.0], 1, "x")]
    rows += [(4000, [x * -1 for x in same], 9, "x"), (-100, same, 2, "x")]
    table = spark.createDataFrame(rows, VECTORS)
    got = sorted(map(tuple, hard_negatives.mine(table, F.col("id") % 100 == 0, label=turned()).collect()))
    want = mined(rows)
    assert got == want and len(want) > 100


def test_hard_negatives_of_odd_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(none, F.col("id") % 100 == 0).count() == 0
    lone = spark.createDataFrame([(100, [1.0, 2.0], 1, "x")], VECTORS)
    assert hard_negatives.mine(lone, F.col("id") % 100 == 0).count() == 0
    huge = spark.createDataFrame([(i, [3e38, 1.0], i % 2, "x") for i in range(100, 104)], VECTORS)
    with pytest.raises(Exception, match="do not fit 64 bits"):
        hard_negatives.mine(huge, F.col("id") % 100 == 0).collect()


def test_walk_stops_early():
    """The threshold ends a walk long before its lists where vectors have structure, and never too early."""
    draw = np.random.default_rng(2)
    v = np.vstack([draw.integers(-5, 5, (5000, 4)), draw.integers(900, 1000, (20, 4))])
    lists = hard_negatives.Lists(v, v[-1:])
    rows, scores = hard_negatives.gather(lists, v[-1], np.ones(len(v), bool), lambda s, limit: len(s) >= 5 and limit < hard_negatives.kth(s, 5))
    assert len(rows) < 500
    assert sorted(scores)[-5:] == sorted(v @ v[-1])[-5:]


NOTICE = "Licensed under the Apache License, Version 2.0."
SCANS = [
    None, "", " .,\n", "plain words only", NOTICE, f"x {NOTICE} y {NOTICE}", "cc by cc by CC-BY", "MIT License gnu general public license", "GNU General Public",
    "licensed UNDER the apache-license version 2", "Released under the MIT License.", "ccé by", "K cc by", "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.", "licensed under the gnu general public license version 2 " * 400,
    "apache license version 2 0", "w" * 200_000 + " mit license", "public license general gnu", "x " * 30_000 + NOTICE, "version 2 0 license apache the under licensed",
    "license license license mit mit license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this program",
]


def scanned(texts, templates):
    """(n_words, n_base, first, last, base labels, labels, score) of every text, place by place."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) for t in texts]
    known = {w for t in templates for w in t.text.split()}
    held = Counter(w for ws in words for w in set(ws) & known)
    entries = license_scan.index(templates, {w: held[w] for w in known}, len(texts))
    out = []
    for ws in words:
        base = [(i, label) for p, label in license_scan.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        labels, share = {label for _, label in base}, 0.5 if base else 0.0
        places = defaultdict(list)
        for i, w in enumerate(ws):
            places[w].append(i)
        for (label, text, keys), postings, need, weights in entries:
            begins = Counter(i - p for w, p in postings for i in places[w])
            for begin in [b for b, n in begins.items() if n >= need]:
                span = ws[max(begin, 0) : max(begin + len(weights), 0)]
                if all(any(span[i : i + len(k.split())] == k.split() for i in range(len(span))) for k in keys):
                    labels.add(label)
                    put = sum(x for p, (w, x) in enumerate(zip(text.split(), weights, strict=True)) if 0 <= begin + p < len(ws) and ws[begin + p] == w)
                    share = max(share, round(put / sum(weights), 6))
        spots = [i for i, _ in base]
        out.append((
            len(ws), len(base), min(spots, default=None), max(spots, default=None), ",".join(sorted({label for _, label in base})), ",".join(sorted(labels)), share
        ))
    return out


@pytest.mark.parametrize("templates", [license_scan.TEMPLATES, license_scan.TEMPLATES[1:4], ()])
def test_license_scan(spark, templates):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(SCANS)], "doc_id bigint, text string, words string, license string")
    found = license_scan.scan(docs, templates)
    assert found.columns == [*docs.columns, "_license"]
    got = found.orderBy("doc_id").select("_license.*").drop("matches").collect()
    want = scanned(SCANS, templates)
    for i, (g, w) in enumerate(zip(got, want, strict=True)):
        assert tuple(g)[:-1] == w[:-1] and g.score == pytest.approx(w[-1], abs=2e-6), (i, g, w)
    if templates == license_scan.TEMPLATES:
        assert want[4][5] == "apache,apache-2.0" and want[13][5] == "cc-by,cc-by-nc-4.0" and want[14][5] == "gpl,gpl-3.0"


def test_license_scan_of_odd_tables(spark):
    schema = "doc_id bigint, text string"
    assert license_scan.scan(spark.createDataFrame([], schema)).count() == 0
    twice = license_scan.scan(spark.createDataFrame([(1, NOTICE), (1, NOTICE), (None, NOTICE)], schema)).select("license.labels").collect()
    assert [r.labels for r in twice] == ["apache,apache-2.0"] * 3
