"""Phrase collocations by set-oriented mining over occurrence relations.

An occurrence relation R_k has one entry per place at which a frequent phrase of k
words begins. A place is a running number of words that skips one where a piece
ends, so two neighbouring places always lie in one piece. Relations are kept sorted
by place, packed in blocks of one language; they are tables in the shared folder.
A block is one row with its packed places and codes, and rows of the groups which the
codes stand for: lists of `LISTED` words each in R_1, the pieces named below in the
others.

Each round takes R_k to R_(k+1):

* merge-join: R_k with itself on the same piece and the next place, in one pass over
  the sorted block (a block holds whole pieces);
* group-count: a block counts its own pairs first, so that a phrase reaches the
  shuffle once per block however often it occurs. Groups are dealt to buckets, and
  what a block has for a bucket is one packed row, a piece; Spark brings the pieces
  of a bucket together and a task adds their counts. The join itself makes the pieces
  of its pairs: lists of them, unpacked, would go to Python once more, many megabytes
  at a time;
* semi-join: the frequent groups go back to the blocks in which they occur, by block,
  packed as well, and the others leave the relation before the next round.

Groups are named by the pair of frequent phrases that they are made of (first k and
last k words), whose ids are exact: hashes say which bucket a group is counted in,
never which group it is. The number of buckets grows with the places of the relation
(of pairs, with the places of the frequent phrases that they begin with, which are no
fewer), so a bucket has `BUCKET` groups at most, about. Every part of a frequent
phrase is frequent, so the counts of all cuts are at hand from earlier rounds. A
candidate lies in a longer one that covers it just when it lies in one that is one
word longer and covers it: the words between add no occurrences.

Defined results: null texts are empty; null languages count as `und`; repeated rows
and rows that share an id count as they are (ids are not looked at); an empty table
or one without frequent phrases gives no rows; ties rank by count, then by phrase in
byte order; further columns are left out. A text of any length is taken whole; its
bytes are held several times over while its words are cut out.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.session import Shelf, park

from . import arrow

#: Words after which a task closes its blocks.
BLOCK_WORDS = 1 << 21
#: Groups listed in one row.
LISTED = 1 << 13
#: Places of a relation for each bucket in which its groups are counted.
BUCKET = 1 << 21
#: Bytes that end a piece and bytes that part words, as the contract fixes them.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)] = 1
KIND[list(PIECE_ENDS)] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

ENTRY = "lang string, n int, step binary, code binary, first int"
WORD_BLOCK = f"block bigint, {ENTRY}, words array<string>, counts array<int>"
PAIR_BLOCK = "block bigint, lang string, n int, step binary, code binary, bucket int, codes binary, names array<binary>, counts binary"
OF_BLOCK = [("block", pa.int64()), ("lang", pa.string()), ("n", pa.int32()), ("step", pa.binary()), ("code", pa.binary()), ("first", pa.int32())]
WORDS = pa.schema([*OF_BLOCK, ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))])
PIECE = "bucket int, block bigint, lang string, n int, codes binary, names array<binary>, counts binary"
PIECES = pa.schema([
    ("bucket", pa.int32()), ("block", pa.int64()), ("lang", pa.string()), ("n", pa.int32()), ("codes", pa.binary()), ("names", pa.list_(pa.binary())),
    ("counts", pa.binary()),
])
KEPT_ROW = "block bigint, n int, codes binary, ids binary, id bigint, total bigint, lang string, word string, lefts bigint, rights bigint"
KEPT = pa.schema([
    ("block", pa.int64()), ("n", pa.int32()), ("codes", pa.binary()), ("ids", pa.binary()), ("id", pa.int64()), ("total", pa.int64()),
    ("lang", pa.string()), ("word", pa.string()), ("lefts", pa.int64()), ("rights", pa.int64()),
])
PAIRS = pa.schema([*OF_BLOCK, ("lefts", pa.list_(pa.int64())), ("rights", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])
#: A block's row, or one of its pieces.
PACKED = pa.schema([*OF_BLOCK[:5], *(PIECES.field(c) for c in ("bucket", "codes", "names", "counts"))])


#: 64-bit numbers, as `pack` and `unpack` take them.
WIDE = "<i8"


def pack(numbers: np.ndarray, kind: str = "<i4") -> bytes:
    """Numbers with all lowest bytes first and so on, compressed: the upper ones hardly differ."""
    plain = np.ascontiguousarray(numbers, kind)
    return pa.compress(plain.view("u1").reshape(-1, plain.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, kind: str = "<i4") -> np.ndarray:
    width = np.dtype(kind).itemsize
    plain = np.frombuffer(pa.decompress(data, decompressed_size=width * n, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(plain.T).view(kind).reshape(n)


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words in a row, their lengths, and whether a new piece begins before each."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, bool)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    first = offsets[:-1] - offsets[0]
    kind = KIND[data]
    word = kind == 0
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = first[first < len(data)]
    begins[first] = word[first]  # a text begins anew, whatever byte stands before it
    ends = kind == 2
    starts = np.flatnonzero(begins)
    piece = np.cumsum(ends, dtype=np.int32)[starts] + np.searchsorted(first, starts, side="right")
    kept = np.cumsum(word, dtype=np.int64)[starts] - 1
    fresh = np.ones(len(starts), bool)
    fresh[1:] = piece[1:] != piece[:-1]
    return LOWER[data[word]], np.diff(kept, append=int(word.sum())), fresh


def bounded(data: np.ndarray, lengths: np.ndarray, fresh: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same words in parts that begin with a piece and hold about `size` words at most."""
    pieces, ends, start = np.flatnonzero(fresh), np.append(0, np.cumsum(lengths)), 0
    while start < len(lengths):
        later = pieces[np.searchsorted(pieces, start + size) :]
        stop = int(later[0]) if len(later) else len(lengths)
        yield data[ends[start] : ends[stop]], lengths[start:stop], fresh[start:stop]
        start = stop


def block_rows(schema: pa.Schema, block: int, lang: str, step: np.ndarray, code: np.ndarray, *groups: pa.Array) -> pa.Table:
    """The row of a block and the rows that list its groups."""
    n_lists = -(-len(groups[0]) // LISTED)
    firsts = np.arange(n_lists, dtype=np.int32) * LISTED
    edges = pa.array(np.append(firsts, len(groups[0])), pa.int32())
    head = pa.table([[block], [lang], [len(code)], [pack(step)], [pack(code)], [None], *[[None] for _ in groups]], schema=schema)
    lists = [pa.ListArray.from_arrays(edges, g.cast(f.type.value_type)) for g, f in zip(groups, list(schema)[-len(groups):], strict=True)]
    none = [pa.nulls(n_lists, f.type) for f in list(schema)[2:5]]
    return pa.concat_tables([head, pa.table([pa.array([block] * n_lists, pa.int64()), pa.array([lang] * n_lists), *none, pa.array(firsts), *lists], schema=schema)])


def word_block(block: int, lang: str, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """One block of R_1, with its own list of distinct words and their counts."""
    data, lengths, fresh = (np.concatenate(x) for x in zip(*parts, strict=True))
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    words = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy()
    counts = np.bincount(code, minlength=len(coded.dictionary))
    return block_rows(WORDS, block, lang, 1 + fresh, code, coded.dictionary, pa.array(counts))


def word_blocks(docs: DataFrame, text: str, lang: str, block_words: int) -> DataFrame:
    """R_1 before its semi-join: blocks of sorted word occurrences."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = defaultdict(list), 0
        numbers = itertools.count(TaskContext.get().partitionId() << 32)

        def close() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                yield from word_block(next(numbers), name, parts).to_batches()
            held.clear()

        for batch in batches:
            for part in arrow.slices(batch, 1):
                langs = part.column(0)
                for name in pc.unique(langs):
                    for own in bounded(*cut(part.column(1).filter(pc.equal(langs, name))), block_words):
                        held[name.as_py()].append(own)
                        n += len(own[1])
                        if n >= block_words:
                            yield from close()
                            n = 0
        yield from close()

    source = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.where(F.col("text") != "").mapInArrow(blocks, WORD_BLOCK)


def bucket_of(lefts: np.ndarray, rights: np.ndarray, buckets: int) -> np.ndarray:
    mixed = lefts.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rights.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def block_pieces(lists: pa.Table, buckets: int) -> pa.RecordBatch:
    """Pieces of the groups in rows that list those of one block: words with their buckets, or pairs."""
    lists = lists.combine_chunks()
    n = pc.list_value_length(lists["counts"]).to_numpy()
    codes = np.repeat(lists["first"].to_numpy() - np.cumsum(n) + n, n) + np.arange(n.sum())
    flat = {c: pc.list_flatten(lists[c]).combine_chunks() for c in lists.column_names[3:]}
    bucket = flat["bucket"].to_numpy() if "bucket" in flat else bucket_of(flat["lefts"].to_numpy(), flat["rights"].to_numpy(), buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
    codes, counts = codes[order], flat["counts"].to_numpy()[order]
    if "words" in flat:
        _, ends, data = flat["words"].cast(pa.large_string()).take(pa.array(order)).buffers()
        ends, data = np.frombuffer(ends, np.int64), memoryview(data)
        named = lambda a, z: [pa.compress(data[ends[a] : ends[z]], codec="zstd", asbytes=True), pack(np.diff(ends[a : z + 1]))]
    else:
        lefts, rights = flat["lefts"].to_numpy()[order], flat["rights"].to_numpy()[order]
        named = lambda a, z: [pack(np.diff(lefts[a:z], prepend=0), WIDE), pack(rights[a:z], WIDE)]
    block, lang = lists["block"][0].as_py(), lists["lang"][0].as_py()
    return pa.RecordBatch.from_pylist(
        [
            {"bucket": int(bucket[order[a]]), "block": block, "lang": lang, "n": int(z - a), "codes": pack(np.diff(codes[a:z], prepend=0)), "names": named(a, z), "counts": pack(counts[a:z])}
            for a, z in itertools.pairwise(edges)
        ],
        PIECES,
    )


def word_pieces(relation: DataFrame, buckets: int) -> DataFrame:
    """What each block of R_1 has for each bucket, packed in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.Table.from_batches([batch])
            for block in pc.unique(lists["block"]):
                yield block_pieces(lists.filter(pc.equal(lists["block"], block)), buckets)
        arrow.finish()

    lists = relation.where("step IS NULL").select("block", "lang", "first", "words", "counts")
    return lists.withColumn("bucket", F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))).mapInArrow(run, PIECE)


def pair_pieces(relation: DataFrame) -> DataFrame:
    """The same of a relation of pairs, as its join has made them."""
    return relation.where("bucket IS NOT NULL").select(*PIECES.names)


def same_words(rows: list[dict]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Which group each entry of pieces is, and the groups' languages and words. Pieces of a language stand together."""
    own, words, langs = [], [], []
    for lang, some in itertools.groupby(rows, lambda r: r["lang"]):
        some = list(some)
        lengths = np.concatenate([unpack(r["names"][1], r["n"]) for r in some])
        offsets = np.append(0, np.cumsum(lengths, dtype=np.int64))
        sizes = [int(unpack(r["names"][1], r["n"]).sum(dtype=np.int64)) for r in some]
        data = b"".join(pa.decompress(r["names"][0], decompressed_size=size, codec="zstd", asbytes=True) for r, size in zip(some, sizes, strict=True))
        coded = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        own.append(coded.indices.to_numpy() + sum(map(len, words)))
        words.append(coded.dictionary.cast(pa.string()))
        langs.append(pa.repeat(pa.scalar(lang, pa.string()), len(coded.dictionary)))
    return np.concatenate(own), {"lang": pa.concat_arrays(langs), "word": pa.concat_arrays(words)}


def same_pairs(rows: list[dict]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Which group each entry of pieces is, and the groups' parts, in ascending order."""
    lefts, left = np.unique(np.concatenate([np.cumsum(unpack(r["names"][0], r["n"], WIDE)) for r in rows]), return_inverse=True)
    rights, right = np.unique(np.concatenate([unpack(r["names"][1], r["n"], WIDE) for r in rows]), return_inverse=True)
    pairs, own = np.unique(left * len(rights) + right, return_inverse=True)
    return own, {"lefts": pa.array(lefts[pairs // len(rights)]), "rights": pa.array(rights[pairs % len(rights)])}


def frequent(counted: DataFrame, names: list[str], least: int) -> DataFrame:
    """Semi-join of pieces with the groups counted `least` times or more.

    A row for each piece that keeps groups, with their codes in the block and their ids, and a row for each of these groups.
    """

    def run(found: pa.Table) -> pa.Table:
        rows = found.sort_by([("lang", "ascending"), ("block", "ascending")]).to_pylist()
        own, group = same_words(rows) if names == ["words"] else same_pairs(rows)
        counts = np.concatenate([unpack(r["counts"], r["n"]) for r in rows])
        total = np.zeros(int(own.max()) + 1, np.int64)
        np.add.at(total, own, counts)
        kept = total >= least
        ids = np.cumsum(kept) - 1 + (rows[0]["bucket"] << 32)
        out, at = [], 0
        for r in rows:
            mine = own[at : at + r["n"]]
            at += r["n"]
            stay = kept[mine]
            if stay.any():
                codes = np.cumsum(unpack(r["codes"], r["n"]))[stay]
                out.append({"block": r["block"], "n": len(codes), "codes": pack(np.diff(codes, prepend=0)), "ids": pack(np.diff(ids[mine[stay]], prepend=0), WIDE)})
        group = {"id": pa.array(ids[kept]), "total": pa.array(total[kept])} | {c: g.filter(pa.array(kept)) for c, g in group.items()}
        whole = pa.table([group.get(f.name, pa.nulls(int(kept.sum()), f.type)) for f in KEPT], schema=KEPT)
        return pa.concat_tables([pa.Table.from_pylist(out, KEPT), whole])

    return counted.groupBy("bucket").applyInArrow(run, KEPT_ROW)


def joined(left: pa.Table, right: pa.Table, buckets: int) -> pa.Table:
    """Next relation of a block: what its semi-join keeps, merge-joined with itself on the next place.

    `left` is the block's row, `right` has the codes and ids of its frequent groups.
    """
    if not left.num_rows or not right.num_rows:
        return PACKED.empty_table()
    rows = block_rows(PAIRS, left["block"][0].as_py(), left["lang"][0].as_py(), *meeting(left, right))
    if rows.num_rows == 1:
        return PACKED.empty_table()
    lists = rows.slice(1).select(["block", "lang", "first", "lefts", "rights", "counts"])
    return pa.concat_tables([
        pa.table([t[f.name] if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in PACKED], schema=PACKED)
        for t in (rows.slice(0, 1).drop_columns(["counts"]), pa.Table.from_batches([block_pieces(lists, buckets)]))
    ])


def meeting(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array, pa.Array]:
    """Places and codes of a block's pairs, and the pairs in the order of their ids: left and right parts and counts."""
    row, kept = left.to_pylist()[0], right.to_pylist()
    place, code = np.cumsum(unpack(row["step"], row["n"]), dtype=np.int64), unpack(row["code"], row["n"])
    codes = np.concatenate([np.cumsum(unpack(r["codes"], r["n"])) for r in kept])
    ids = np.concatenate([np.cumsum(unpack(r["ids"], r["n"], WIDE)) for r in kept])
    order = np.argsort(ids)  # so that pairs come out in the order of their ids
    codes, ids = codes[order], ids[order]
    own = np.full(max(int(code.max()), int(codes.max())) + 1, -1, np.int64)
    own[codes] = np.arange(len(codes))
    group = own[code]
    place, group = place[group >= 0], group[group >= 0]
    meets = np.flatnonzero(np.diff(place) == 1)
    pairs, code, counts = np.unique(group[meets] * len(ids) + group[meets + 1], return_inverse=True, return_counts=True)
    return np.diff(place[meets], prepend=0), code, pa.array(ids[pairs // len(ids)]), pa.array(ids[pairs % len(ids)]), pa.array(counts)


def extended(relation: DataFrame, kept: DataFrame, buckets: int) -> DataFrame:
    """R_(k+1), before its semi-join, from R_k and the pieces that R_k's semi-join keeps."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return joined(left, right, buckets)

    blocks = relation.where("step IS NOT NULL").select("block", "lang", "n", "step", "code")
    kept = kept.where("block IS NOT NULL").select("block", "n", "codes", "ids")
    return blocks.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(run, PAIR_BLOCK)


def buckets_for(sizes: DataFrame, places: str) -> int:
    """Buckets in which a relation of so many places is counted."""
    return max(1, -(-(sizes.agg(F.sum(places)).first()[0] or 0) // BUCKET))


def spelled(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Words of the groups, and the counts of all their first and last parts, shortest first."""
    first = parts.select(F.col("id").alias("lefts"), "lang", F.col("words").alias("head"), "firsts")
    last = parts.select(F.col("id").alias("rights"), F.element_at("words", -1).alias("tail"), "lasts")
    return pairs.join(first, "lefts").join(last, "rights").select(
        "id", "lang", F.concat("head", F.array("tail")).alias("words"), "total", "lefts", "rights",
        F.concat("firsts", F.array("total")).alias("firsts"), F.concat("lasts", F.array("total")).alias("lasts"),
    )


#: Lowest-scoring cut; products and sums are decimals, since they may pass 64 bits.
CUTS = """array_min(transform(sequence(1, size(words) - 1), k -> struct(
    (cast({scale} as decimal(18,0)) * cast(total as decimal(19,0)))
      div (cast(firsts[k - 1] as decimal(19,0)) + cast(lasts[size(words) - k - 1] as decimal(19,0))) as score,
    k as k, firsts[k - 1] as l, lasts[size(words) - k - 1] as r)))"""


def mine(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, cover: int = 80, top: int = 2000,
    scale: int = 2_000_000, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """`lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`: each language's best phrases of 2 to `longest` words."""
    with Shelf(docs.sparkSession) as shelf:
        relation = shelf.put(word_blocks(docs, text, lang, block_words), "phrases-words")
        sizes = shelf.put(relation.groupBy("lang").agg(F.sum(F.col("n").cast("bigint")).alias("n")), "phrases-sizes")
        kept = shelf.put(frequent(word_pieces(relation, buckets_for(sizes, "n")), ["words"], least), "phrases-frequent")
        one = F.array("total")
        groups = [shelf.put(
            kept.where("id IS NOT NULL").select("id", "lang", F.array("word").alias("words"), "total", one.alias("firsts"), one.alias("lasts")), "phrases-1"
        )]
        for k in range(2, longest + 1):
            longer = shelf.put(extended(relation, kept, buckets_for(groups[-1], "total")), "phrases-pairs")
            shelf.drop(relation, kept)
            relation = longer
            kept = shelf.put(frequent(pair_pieces(relation), ["lefts", "rights"], least), "phrases-frequent")
            pairs = kept.where("id IS NOT NULL").select("id", "lefts", "rights", "total")
            groups.append(shelf.put(spelled(pairs, groups[-1]), f"phrases-{k}"))
        return park(ranked(groups[1:], sizes, cover, top, scale), "phrases")


def ranked(groups: list[DataFrame], sizes: DataFrame, cover: int, top: int, scale: int) -> DataFrame:
    """Candidates that no longer one covers, scored and ranked within their language."""
    found = None
    for k, own in enumerate(groups):
        if k + 1 < len(groups):
            longer = groups[k + 1]
            around = longer.select(F.col("lefts").alias("id"), F.col("total").alias("around"))
            around = around.union(longer.select("rights", "total")).groupBy("id").agg(F.max("around").alias("around"))
            wide = lambda c: F.col(c).cast("decimal(19,0)")
            covered = F.coalesce(100 * wide("around") >= cover * wide("total"), F.lit(False))
            own = own.join(around, "id", "left").where(~covered)
        own = own.select("lang", "words", "total", F.expr(CUTS.format(scale=scale)).alias("cut"))
        found = own if found is None else found.unionByName(own)
    found = found.select(
        "lang", F.array_join("words", " ").alias("phrase"), F.col("total").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        F.col("cut.score").alias("score"),
    )
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    placed = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).join(sizes, "lang")
    return placed.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
