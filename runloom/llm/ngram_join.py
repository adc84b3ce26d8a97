"""Jaccard join of word n-gram sets by prefix trees.

Sets are ordered globally: n-grams first that few documents share, then by hash. A
set that is linked to another one shares an n-gram with it among its first
`misses + 1`, where `misses` is what it may lack (15 % of it at a similarity of 85).

1. The n-grams in a somewhat longer front of each set are counted over all
   documents. Those that occur twice go into a Bloom filter and the most frequent into
   a table, both of bounded size. A document with too few repeated n-grams in its
   front to be linked with a set of any size is done; exact copies are one class.
2. Classes that share front n-grams form groups (by the smallest class that they
   meet), which are cut into chunks of bounded size, each with the group's smallest
   class. A chunk's ordered sets are stored in a trie with shared paths, and every
   set runs through it: the overlap with a path is counted once for all sets on it,
   and subtrees are left as soon as what remains in them and in the set can no longer
   give the needed overlap. That is done twice, with different smallest classes.
3. What is linked so far is joined into components. For n-grams whose documents lie
   in different components (one n-gram of those that the same documents share stands
   for the others), pairs across components are compared by signatures: the
   parity of the n-grams that fall on each of `SIGNATURE` places. Signatures differ in
   at most as many places as sets differ in n-grams, so pairs that differ in more can be
   left out; the others are checked exactly. First each two components get the one pair
   that differs least: a link is all that is needed to join them, however many pairs
   of near copies they have between them. What is still apart then gets all its pairs.
   So no link between components is lost, and none is spelled out within them.
   Crowded n-grams are dealt out in parts that meet two by two.

Defined results: texts that are null or without words have an empty set, are linked
with nothing, and are their own component; a text with fewer words than an n-gram has
its whole sequence as one; equal sets are linked; repeated rows each keep their row; a
row without id gets the smallest id of its component or null; an empty table gives no
rows; columns not named by `keep` are left out.

N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.session import park

from .arrow import finish, slices
from .components import components
from .text import ascii_lower, own_name, words

#: Bounds of what is broadcast: frequent n-grams and bits of the Bloom filter.
MAX_FREQUENT = 1 << 18
MAX_BITS = 1 << 27
FREQUENT = 16
#: Words whose hashes a task keeps.
KEPT_WORDS = 100_000
#: Classes in a chunk that one trie holds.
CHUNK = 400
#: Places of a signature.
SIGNATURE = 2048
#: Classes of a crowded n-gram in one part, rows of a task, and pairs whose signatures are compared at once.
PART, TASK_ROWS, AT_ONCE = 1024, 20_000, 1 << 16


class Words(dict):
    """64-bit hashes of words, kept for those met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        known = self[word] = xxhash.xxh64_intdigest(word)
        return known


def mixed(hashes: Sequence[np.ndarray]) -> np.ndarray:
    """One hash for each row of these columns, by position."""
    out = np.full(len(hashes[0]), len(hashes), np.uint64)
    with np.errstate(over="ignore"):
        for h in hashes:
            out = (out ^ h) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
    return out


def ngram_hashes(words: Sequence[bytes], n: int, known: Words) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of a text's words."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) >= n:
        found = mixed([h[k : len(h) - n + 1 + k] for k in range(n)])
    else:
        found = mixed([h[k : k + 1] for k in range(len(h))]) if len(h) else h
    return np.unique(found.view(np.int64))


def words_of(texts: pa.Array) -> Iterator[list[bytes]]:
    """Words of every text, A-Z in lower case; bytes are parted at just the blanks of the word rule."""
    for text in texts.cast(pa.large_binary()).to_pylist():
        yield text.lower().split() if text else []


def misses(n: Column, similarity: int) -> Column:
    """How many n-grams a set of size n may lack of a linked one."""
    return (n - F.floor((n * similarity + 99) / 100)).cast("int")


@cache
def front_and_demand(size: int, similarity: int) -> tuple[int, int]:
    """Length of a set's counted front (half as many again as may be missed, and one), and how many n-grams of it any linked set has in its own front too.

    Of sets of sizes a and b with an overlap of o, the k-th shared n-gram lies among the
    first k + a - o of one and k + b - o of the other. Fronts of linked sets differ in
    length, so the least is taken over all sizes b that can be linked.
    """

    def length(n: np.ndarray) -> np.ndarray:
        lack = n - (n * similarity + 99) // 100
        return np.minimum(n, lack + -(-lack // 2) + 1)

    other = np.arange(-(-size * similarity // 100), size * 100 // similarity + 1)
    overlap = -(-similarity * (size + other) // (100 + similarity))
    own = int(length(np.array(size)))
    both = np.minimum(own - (size - overlap), length(other) - (other - overlap))
    return own, int(both[overlap <= np.minimum(size, other)].min())


def bloom_bits(tokens: DataFrame) -> tuple[np.ndarray, int]:
    """Bloom filter of the `token` column as 64-bit words, and its size in bits."""
    want = max(64, 16 * tokens.count())
    bits = min(MAX_BITS, 1 << (want - 1).bit_length())
    place = lambda h: h.bitwiseAND(F.lit(bits - 1))
    both = tokens.select(F.explode(F.array(place(F.col("token")), place(F.shiftrightunsigned("token", 32)))).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
    filled = both.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[filled["word"].to_numpy()] = filled["bits"].to_numpy()
    return out.view(np.uint64), bits


def frequent(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent tokens and their counts; the threshold rises until they are few enough."""
    least = FREQUENT
    while tokens.where(F.col("n") >= least).count() > MAX_FREQUENT:
        least *= 2
    found = tokens.where(F.col("n") >= least).toArrow()
    token, n = found["token"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def ordered_sets(docs: DataFrame, text: str, key: str, n: int, similarity: int) -> DataFrame:
    """`rid`, `doc_id`, `same` (equal for equal word sequences), `n`, `tokens` in global order, and `signature`.

    The last two are null for documents that can not be linked to another text.
    """
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for part in slices(batch, 0):
                fronts = []
                for found in words_of(part.column(0)):
                    t = ngram_hashes(found, n, known)
                    fronts.append(t[: front_and_demand(len(t), similarity)[0]] if len(t) else t)
                token, times = np.unique(np.concatenate(fronts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(times)], names=["token", "n"])
        finish()

    counted = source.select("text").mapInArrow(count, "token bigint, n bigint")
    repeated = park(counted.groupBy("token").agg(F.sum("n").alias("n")).where("n > 1"), "ngrams")
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((*bloom_bits(repeated), *frequent(repeated)))

    def order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, bits, hot, hot_n = shared.value
        mask = np.uint64(bits - 1)

        def repeated_in(t: np.ndarray) -> int:
            u = t.view(np.uint64)
            hit = np.ones(len(u), bool)
            for at in (u & mask, (u >> np.uint64(32)) & mask):
                hit &= (words_[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            return int(hit.sum())

        def ordered(t: np.ndarray) -> np.ndarray | None:
            length, demand = front_and_demand(len(t), similarity) if len(t) else (0, 1)
            if repeated_in(t[:length]) < demand:
                return None
            if not len(hot):
                return t
            at = np.minimum(np.searchsorted(hot, t), len(hot) - 1)
            return t[np.lexsort((t, np.where(hot[at] == t, hot_n[at], 0)))]

        known, longs = Words(), pa.list_(pa.int64())
        for batch in batches:
            for part in slices(batch, 1):
                same, sizes, out, signs = [], [], [], []
                for found in words_of(part.column(1)):
                    t = ngram_hashes(found, n, known)
                    same.append(hashlib.md5(b" ".join(found)).digest())
                    sizes.append(len(t))
                    out.append(ordered(t))
                    odd = None if out[-1] is None else np.bincount((out[-1] >> 40) & (SIGNATURE - 1), minlength=SIGNATURE) & 1
                    signs.append(None if odd is None else np.packbits(odd.astype(np.uint8)).view(np.int64))
                columns = [part.column(0), pa.array(same, pa.binary()), pa.array(sizes, pa.int32()), pa.array(out, longs), pa.array(signs, longs)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "same", "n", "tokens", "signature"])
        finish()

    made = source.mapInArrow(order, "doc_id bigint, same binary, n int, tokens array<bigint>, signature array<bigint>")
    return park(made.select(F.monotonically_increasing_id().alias("rid"), "*"), "sets")


class Trie:
    """Ordered sets with shared paths; a node holds the tokens between two branchings."""

    def __init__(self, sets: list[np.ndarray], similarity: int):
        self.similarity = similarity
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        names, local = np.unique(flat, return_inverse=True)
        self.names = len(names)
        self.sets = np.split(local, np.cumsum(self.sizes)[:-1])
        spelled = [s.astype(">u4").tobytes() for s in self.sets]
        order = sorted(range(len(sets)), key=spelled.__getitem__)
        parents, starts, ends, holders, at_node = [-1], [0], [0], [order[0]], {}
        path, last = [0], None
        for i in order:
            common = 0
            if last is not None:
                a, b = self.sets[last], self.sets[i]
                m = min(len(a), len(b))
                differ = np.flatnonzero(a[:m] != b[:m])
                common = int(differ[0]) if len(differ) else m
            left = None
            while ends[path[-1]] > common:
                left = path.pop()
            if ends[path[-1]] < common:  # branch inside the node that was left: cut it there
                node = len(parents)
                parents.append(path[-1]), starts.append(starts[left]), ends.append(common), holders.append(holders[left])
                parents[left], starts[left] = node, common
                path.append(node)
            if len(self.sets[i]) > common:
                node = len(parents)
                parents.append(path[-1]), starts.append(common), ends.append(len(self.sets[i])), holders.append(i)
                path.append(node)
            at_node[i] = path[-1]
            last = i
        self.parents, self.ends = np.array(parents), np.array(ends)
        self.parts = [self.sets[h][s:e] for h, s, e in zip(holders, starts, ends, strict=True)]
        count = len(parents)
        self.smallest, self.largest = np.full(count, 1 << 30), np.zeros(count, np.int64)
        self.held: list[list[int]] = [[] for _ in range(count)]
        for i, node in at_node.items():
            self.held[node].append(i)
            while node >= 0:
                self.smallest[node] = min(self.smallest[node], self.sizes[i])
                self.largest[node] = max(self.largest[node], self.sizes[i])
                node = parents[node]
        self.below: list[list[int]] = [[] for _ in range(count)]
        for node in range(1, count):
            self.below[parents[node]].append(node)

    def partners(self, i: int) -> list[int]:
        """Sets that reach the similarity with set i, itself included."""
        mine = np.zeros(self.names, bool)
        mine[self.sets[i]] = True
        size, s = int(self.sizes[i]), self.similarity
        out, todo = [], [(0, 0)]
        while todo:
            node, overlap = todo.pop()
            overlap += int(np.count_nonzero(mine[self.parts[node]]))
            smallest, largest = int(self.smallest[node]), int(self.largest[node])
            # overlap >= s / (100 + s) * (sum of sizes), with the smallest set below
            needed = -(-s * (size + smallest) // (100 + s))
            if overlap + min(largest - int(self.ends[node]), size - overlap) < needed:
                continue
            for j in self.held[node]:
                if (100 + s) * overlap >= s * (size + int(self.sizes[j])):
                    out.append(j)
            todo += [(below, overlap) for below in self.below[node]]
        return out


def chunk_links(ids: np.ndarray, sets: list[np.ndarray], similarity: int) -> list[tuple[int, int]]:
    """Edges that join what is linked within a chunk, at most one for each set."""
    if len(ids) < 2:
        return []
    trie = Trie(sets, similarity)
    root = list(range(len(ids)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges = []
    for i in range(len(ids)):
        for j in trie.partners(i):
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((int(ids[i]), int(ids[j])))
    return edges


def grouped_links(sets: DataFrame, labels: DataFrame, similarity: int, tasks: int) -> DataFrame:
    """Edges `a`, `b` found by tries in the chunks of each group's classes.

    `labels` has `cid`, `kind` and `head`: a class is in one group for each kind, and
    the head is in all chunks of its group.
    """
    group = ["kind", "head"]
    sized = labels.groupBy(*group).agg(F.ceil((F.count(F.lit(1)) + 1) / CHUNK).cast("int").alias("chunks"))
    placed = labels.join(sized, group).select("cid", *group, F.pmod(F.xxhash64("cid", F.lit(5)), F.col("chunks")).cast("int").alias("chunk"))
    heads = sized.select(F.col("head").alias("cid"), *group, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    placed = placed.union(heads).distinct()
    task = F.pmod(F.xxhash64(*group, "chunk"), F.lit(tasks)).cast("int").alias("task")
    rows = sets.join(placed, "cid").select("cid", "tokens", F.xxhash64(*group).alias("label"), "chunk", task)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("label", "ascending"), ("chunk", "ascending"), ("cid", "ascending")])
        label, chunk, cid = (table[c].to_numpy() for c in ("label", "chunk", "cid"))
        lists = table["tokens"].combine_chunks()
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        edges: list[tuple[int, int]] = []
        for part in np.split(np.arange(len(cid)), np.flatnonzero((np.diff(label) != 0) | (np.diff(chunk) != 0)) + 1):
            edges += chunk_links(cid[part], [values[offsets[r] : offsets[r + 1]] for r in part], similarity)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return rows.groupBy("task").applyInArrow(run, "a bigint, b bigint")


SIDES = ("token", "cid", "n", "pos", "root", "signature")


def two_by_two(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within each group of rows, in pieces of bounded size."""
    for size in np.unique(sizes):
        own = starts[sizes == size]
        step = max(1, AT_ONCE // int(size))
        for first in range(0, int(size) - 1, step):  # rows of a large group a few at a time
            i, j = np.triu_indices(int(size), 1) if size <= 64 else (x.ravel() for x in np.meshgrid(np.arange(first, min(first + step, size)), np.arange(size), indexing="ij"))
            i, j = i[i < j], j[i < j]
            several = max(1, AT_ONCE // max(1, len(i)))
            for at in range(0, len(own), several):
                base = own[at : at + several, None]
                yield (base + i).ravel(), (base + j).ravel()
            if size <= 64:
                break


def across(sides: DataFrame, similarity: int, nearest: bool) -> DataFrame:
    """`cid_a`, `cid_b`, `others`: pairs of classes of different components that share an n-gram and may be linked.

    With `nearest`, each two components get at most one pair from a task, the one whose
    signatures differ least; `others` counts those left out.
    """
    sized = sides.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    placed = sides.join(sized, "token").withColumn("part", F.pmod(F.xxhash64("cid", F.lit(9)), F.col("parts")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("low"), F.greatest("part", j).alias("high")))
    placed = placed.withColumn("meets", F.explode(meets)).select(*SIDES, "part", "meets.low", "meets.high")
    tasks = max(1, -(-sides.count() // TASK_ROWS))
    placed = placed.withColumn("task", F.pmod(F.xxhash64("token", "low", "high"), F.lit(tasks)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([(c, "ascending") for c in ("token", "low", "high", "cid")])
        token, low, high, part, cid, n, pos, root = (table[c].to_numpy() for c in ("token", "low", "high", "part", "cid", "n", "pos", "root"))
        sign = table["signature"].combine_chunks().flatten().to_numpy().reshape(len(cid), -1).view(np.uint64)
        change = (np.diff(token) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        found = []
        for i, j in two_by_two(starts, np.diff(np.append(starts, len(cid)))):
            both = n[i] + n[j]
            # at the first n-gram that a pair shares, the overlap can not exceed what follows it
            most = np.minimum(n[i] - pos[i], n[j] - pos[j])
            fits = (root[i] != root[j]) & ((low[i] == high[i]) | (part[i] != part[j])) & (100 * np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
            fits &= (100 + similarity) * most >= similarity * both
            i, j, both = i[fits], j[fits], both[fits]
            apart = np.bitwise_count(sign[i] ^ sign[j]).sum(axis=1, dtype=np.int64)
            # overlap = (sum of sizes - difference) / 2
            fits = (100 + similarity) * (both - apart) >= 2 * similarity * both
            found.append((i[fits], j[fits], apart[fits]))
        i, j, apart = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        others = np.zeros(len(i), np.int64)
        if nearest and len(i):
            roots = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
            order = np.lexsort((cid[j], cid[i], apart, *roots))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (np.diff(roots[0][order]) != 0) | (np.diff(roots[1][order]) != 0)
            first = np.flatnonzero(fresh)
            pairs = np.stack([np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])])[:, order]
            others = np.array([len(np.unique(pairs[:, a:b], axis=1).T) - 1 for a, b in zip(first, np.append(first[1:], len(order)), strict=True)])
            i, j = i[order][first], j[order][first]
        return pa.table({"cid_a": np.minimum(cid[i], cid[j]), "cid_b": np.maximum(cid[i], cid[j]), "others": others.astype(np.int64)})

    return placed.groupBy("task").applyInArrow(run, "cid_a bigint, cid_b bigint, others bigint")


def checked(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Those of the pairs that are linked, as edges `a`, `b`."""
    a = sets.select(F.col("cid").alias("cid_a"), F.col("tokens").alias("tokens_a"))
    b = sets.select(F.col("cid").alias("cid_b"), F.col("tokens").alias("tokens_b"))
    overlap = F.size(F.array_intersect("tokens_a", "tokens_b"))
    near = (100 + similarity) * overlap >= similarity * (F.size("tokens_a") + F.size("tokens_b"))
    found = pairs.select("cid_a", "cid_b").distinct().join(a, "cid_a").join(b, "cid_b").where(near)
    return found.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))


def linked(docs: DataFrame, n: int = 5, similarity: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`doc_id`, `same`, `root`, `n_shingles` and `component_id` of every document.

    Two documents are linked when 100 * intersection >= similarity * union of their
    n-gram sets; `component_id` is the smallest id reachable over links. `same` is
    equal for equal word sequences and `root` for a component's rows, also where ids are
    null or stand for several texts.
    """
    rows = ordered_sets(docs, text, key, n, similarity)
    picks = park(rows.groupBy("same").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    open_rows = rows.where(F.col("tokens").isNotNull())
    # copies are taken out rather than first ones picked: of the two the smaller table
    several = picks.where("copies > 1").select(F.col("same").alias("same_"), "cid")
    copies = open_rows.select("rid", "same").join(several, F.col("same") == F.col("same_")).where("rid <> cid").select("rid")
    sets = open_rows.select("rid", "n", "tokens", "signature").join(park(copies, "copies"), "rid", "left_anti")
    sets = park(sets.withColumnRenamed("rid", "cid"), "open")
    tasks = max(1, -(-sets.count() // CHUNK))

    # n-grams in the fronts that several classes share, with the smallest class of two orders
    fronts = sets.select("cid", "n", F.posexplode(F.slice("tokens", F.lit(1), misses(F.col("n"), similarity) + 1)).alias("pos", "token"))
    meets = fronts.groupBy("token").agg(
        F.count(F.lit(1)).alias("df"), F.min("cid").alias("head"), F.min(F.struct(F.xxhash64("cid"), F.col("cid")))["cid"].alias("other")
    ).where("df > 1")
    shared = park(fronts.join(meets, "token"), "fronts")
    every = park(shared.groupBy("cid").agg(F.min("head").alias("head"), F.min(F.struct(F.xxhash64("other"), F.col("other")))["other"].alias("other")), "heads")
    both = every.select("cid", F.lit(0).alias("kind"), "head").union(every.where("head <> other").select("cid", F.lit(1), "other"))
    edges = park(grouped_links(sets, both, similarity, 2 * tasks), "links")
    roots = components(edges)

    # n-grams that lie in several components: pairs across them
    placed = shared.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    of_token = placed.groupBy("token").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("df"), F.bit_xor(F.xxhash64("cid")).alias("who"),
        F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("who2"), F.min(F.struct("cid", "pos"))["pos"].alias("pos"),
    ).where("low < high")
    # n-grams of one passage have the same classes: the first in global order stands for all
    crossing = of_token.groupBy("df", "who", "who2").agg(F.min_by("token", "pos").alias("token")).select("token")
    sides = park(placed.join(crossing, "token").join(sets.select("cid", "signature"), "cid").select(*SIDES), "crossing")
    nearest = park(across(sides, similarity, True), "pairs")
    more = park(checked(nearest, sets, similarity), "links")
    if more.limit(1).count():
        edges = edges.union(more)
        roots = components(edges)
    if nearest.where("others > 0").limit(1).count():
        named = roots.withColumnsRenamed({"node": "cid", "root": "now"})
        again = sides.join(named, "cid", "left").withColumn("root", F.coalesce("now", "root")).drop("now")
        several = again.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
        rest = park(across(again.join(several, "token"), similarity, False).select("cid_a", "cid_b").distinct(), "pairs")
        more = park(checked(rest, sets, similarity), "links")
        if more.limit(1).count():
            roots = components(edges.union(more))

    whole = picks.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = whole.groupBy("root").agg(F.min("first").alias("component"))
    named = park(whole.join(least, "root").select("same", "root", "component"), "named")
    return rows.join(named, "same").select(
        "doc_id", "same", "root", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    )


def keep_one(docs: DataFrame, n: int = 5, similarity: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each component, with the columns of `docs`: that with the smallest id."""
    own_id, own_same = own_name(docs, "__id"), own_name(docs, "__same")
    found = linked(docs, n, similarity, text, key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")).alias("k")
    kept = found.where("n_shingles > 0").groupBy("root").agg(first).select("k.doc_id", "k.same").withColumnsRenamed({"doc_id": own_id, "same": own_same})
    same = F.unhex(F.md5(F.array_join(words(ascii_lower(F.col(text))), " ")))
    marked = docs.withColumn(own_same, same)
    with_words = F.col(own_same) != F.unhex(F.md5(F.lit("")))
    one = marked.where(with_words).join(kept, marked[key].eqNullSafe(kept[own_id]) & (marked[own_same] == kept[own_same]), "left_semi")
    one = one.dropDuplicates([key, own_same])
    return one.unionByName(marked.where(~with_words)).drop(own_same)
