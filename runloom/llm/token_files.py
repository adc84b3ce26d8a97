"""Token ids in files of coded blocks, in ascending document order.

A file holds a head (the ids that occur in it with their counts), blocks of up to
`BLOCK` ids that are coded independently (see `range_coder`), each with its length, size
and CRC-32 of its ids, and an index of the documents: id and number of tokens. Head and
index carry checksums too. Files follow each other in document order; a manifest of the
committed files says how many ids each holds.

Documents are dealt to tasks by ranges of their id (ties by a hash of the text, then by
the row's place), each task encodes and writes its range. File names are new for every
attempt, and the manifest lists only the files of successful ones.

Defined results: null text counts as empty and still gets the end id; null ids come
first and are read back as null; repeated ids and rows keep one entry each; an empty
table writes an empty archive; other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import finish, slices
from .bpe import ENTRY, byte_alphabet, spread
from .range_coder import BLOCK, Shares, decode, encode
from .warc import store

MAGIC = b"IDRC2\n"
#: UTF-8 bytes of text for a file, about.
FILE_BYTES = 24 << 20
#: Ids that a task holds before it closes a file.
FILE_IDS = 12_000_000
MANIFEST = "manifest.parquet"
#: UTF-8 bytes of texts that are encoded together.
TOGETHER = 32 << 20
#: Bytes of chunks and of words that are kept from one lot of texts to the next.
KEPT_CHUNKS, KEPT_WORDS = 96 << 20, 40 << 20
#: Words that the library is asked for at once.
ASKED = 1 << 16
#: Characters that NFC leaves as they are and that have one lower case each, whatever stands beside them.
PLAIN = regex.compile(r"[\x00-\x1b!-\x7f\u00A1-\u00AC\u00AE-\u012F\u0131-\u024F]")
#: The pattern that `cut` follows.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Where the characters end that may be plain, and their kinds: letter, number, all else, not plain.
LIMIT, LETTER, NUMBER, OTHER, ODD = 0x250, 0, 1, 2, 3
KINDS = np.array([({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) if PLAIN.fullmatch(chr(c)) else ODD) for c in range(LIMIT + 1)], np.uint8)
KINDS[LIMIT] = ODD
LOWER = np.array([ord(chr(c).lower()) if PLAIN.fullmatch(chr(c)) else c for c in range(LIMIT)], "<u4")


def cuts_words(spec: dict) -> bool:
    """Whether the file normalises and splits as `PLAIN` and `cut` ask for: NFC, lower case, `WORDS`, bytes.

    Each word then ends with the one token that has the word-end suffix.
    """
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    model = spec["model"]
    if steps not in (["NFC", "Lowercase"], ["NFC", "Replace", "Lowercase"]) or [x["type"] for x in parts] != ["Split", "ByteLevel"] or spec["post_processor"]:
        return False
    if "Replace" in steps and (spec["normalizer"]["normalizers"][1]["pattern"], spec["normalizer"]["normalizers"][1]["content"]) != ({"Regex": r"\s+"}, " "):
        return False
    split, plain = parts
    if (split["behavior"], split["invert"], plain["add_prefix_space"], plain["use_regex"]) != ("Removed", True, False, False) or split["pattern"] != {"Regex": WORDS}:
        return False
    suffix = model.get("end_of_word_suffix")
    if model["type"] != "BPE" or not suffix or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "ignore_merges")):
        return False
    return all(c in model["vocab"] and c + suffix in model["vocab"] for c in byte_alphabet())


def cut(points: np.ndarray, starts: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """Words of plain chunks as `WORDS` finds them in lower case, and where each chunk's begin among them.

    `points` are the code points of all chunks, `starts` where each begins and the last ends.
    """
    kind, low = KINDS[points], np.append(LOWER[points], np.zeros(3, "<u4"))
    first = np.zeros(len(low), bool)
    first[starts] = True
    begins = first.copy()
    begins[1 : len(kind)] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    # an apostrophe that begins a word takes the letters of a contraction and no more
    at = np.flatnonzero(begins[: len(kind)] & (low[: len(kind)] == ord("'")))
    one, two, apart = low[at + 1], low[at + 2], first[at + 2]
    at, one, two, apart = (x[~first[at + 1]] for x in (at, one, two, apart))
    for long, found in (
        (1, np.isin(one, [ord(c) for c in "stmd"])),
        (2, ~apart & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))),
    ):
        begins[at[found] + 1] = False
        begins[at[found] + 1 + long] = True
    low, begins = low[: len(kind)], begins[: len(kind)]
    wide = np.append(0, np.cumsum(1 + (low >= 0x80) + (low >= 0x800)))
    spots = np.append(np.flatnonzero(begins), len(low))
    data = low.tobytes().decode("utf-32-le").encode()
    words = pa.StringArray.from_buffers(len(spots) - 1, pa.py_buffer(wide[spots].astype(np.int32)), pa.py_buffer(data))
    return words, np.append(0, np.cumsum(begins))[starts]


def lists(ids: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(ids, pa.int32()))


class Known:
    """Ids of strings, one string after another."""

    def __init__(self, size: int):
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.made, self.held = lists(np.empty(0, "<i4"), np.empty(0, int)), 0

    def add(self, keys: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.place.update(zip(keys, range(len(self.place), len(self.place) + len(keys)), strict=True))
        self.made = pa.concat_arrays([self.made, lists(ids, lengths)])
        self.held += ENTRY * len(keys) + sum(map(len, keys)) + 4 * len(ids)

    def find(self, keys: list[str]) -> pa.ListArray:
        """Ids of these strings."""
        return self.made.take(pa.array([self.place[k] for k in keys], pa.int64()))

    def forget(self) -> None:
        """Bounds what is kept; a lot of texts needs no more than its own strings."""
        if self.held > self.size:
            self.clear()


class LibraryEncoder:
    """The tokenizers library over chunks between ASCII white space, which parts words always.

    Each chunk of a lot of texts is looked at once. Many chunks share few words, so plain
    chunks are cut into words first and the library encodes each new word once; all other
    chunks it gets as they are.
    """

    def __init__(self, content: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        spec = json.loads(content)
        self.whole = Tokenizer.from_str(content.decode())
        self.whole.no_truncation()
        self.whole.no_padding()
        #: The same model for words that are normalised, cut and spelt in the byte alphabet already.
        self.tokenizer = Tokenizer(self.whole.model)
        self.tokenizer.pre_tokenizer = CharDelimiterSplit(" ")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.mark = added[0] if added else None
        self.mark_id = self.whole.token_to_id(self.mark) if added else -1
        self.chunks = Known(KEPT_CHUNKS)
        self.words, self.made = pa.array([], pa.string()), lists(np.empty(0, "<i4"), np.empty(0, int))
        self.alphabet = np.array([ord(c) for c in byte_alphabet()], "<u4")
        self.kinds = np.full_like(KINDS, ODD)
        if cuts_words(spec):
            suffix = spec["model"]["end_of_word_suffix"]
            self.ends = np.zeros(self.whole.get_vocab_size(), bool)
            self.ends[[i for token, i in spec["model"]["vocab"].items() if token.endswith(suffix)]] = True
            self.kinds = KINDS.copy()
            self.kinds[[min(ord(t[0]), LIMIT) for t in added]] = ODD  # may begin a special token

    def one(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<i4")

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [self.one(t) for t in texts]
        return np.concatenate(made), np.array([len(m) for m in made])

    def by_marks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks and how many each has, from one text in which a special token parts them."""
        if self.mark is None:
            return self.each(chunks)
        ids = self.one(f" {self.mark} ".join(chunks))
        marks = ids == self.mark_id
        return ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1, append=len(ids)) - 1

    def as_they_are(self, chunks: list[str]) -> pa.ListArray:
        """Ids of chunks, each asked for as a whole; those with special tokens alone."""
        new = list(set(chunks).difference(self.chunks.place))
        special = [c for c in new if self.special and self.special.search(c)]
        other = list(set(new).difference(special))
        for some, encoded in ((special, self.each), (other, self.by_marks)):
            if some:
                self.chunks.add(some, *encoded(some))
        return self.chunks.find(chunks)

    def ask(self, words: pa.StringArray) -> pa.ListArray:
        """Ids of words, from one text of all of them."""
        data, ends = flat(words)
        spelt = np.insert(self.alphabet[data], ends[1:-1], ord(" ")).tobytes().decode("utf-32-le")
        ids = np.array(self.tokenizer.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, "<i4")
        lengths = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        return lists(*((ids, lengths) if len(lengths) == len(words) else self.each(words.to_pylist())))

    def by_words(self, points: np.ndarray, starts: np.ndarray) -> pa.ListArray:
        """Ids of plain chunks, from those of their words."""
        words, parts = cut(points, starts)
        coded = words.dictionary_encode()
        new = coded.dictionary.filter(pc.is_null(pc.index_in(coded.dictionary, value_set=self.words)))
        made = pa.concat_arrays([self.made, *(self.ask(new[at : at + ASKED]) for at in range(0, len(new), ASKED))])
        words = pa.concat_arrays([self.words, new])
        found = made.take(pc.index_in(coded.dictionary, value_set=words).take(coded.indices))
        kept = words.nbytes + made.nbytes <= KEPT_WORDS
        self.words, self.made = (words, made) if kept else (pa.array([], pa.string()), lists(np.empty(0, "<i4"), np.empty(0, int)))
        return pa.ListArray.from_arrays(found.offsets.take(pa.array(parts)), found.values)

    def encode(self, chunks: pa.StringArray) -> pa.ListArray:
        """Ids of different chunks."""
        data, ends = flat(chunks)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        starts = np.append(0, np.cumsum((data & 0xC0) != 0x80))[ends]
        odd = np.append(0, np.cumsum(self.kinds[np.minimum(points, LIMIT)] == ODD))[starts]
        plain = odd[1:] == odd[:-1]
        if plain.all():
            return self.by_words(points, starts)
        sizes = np.diff(starts)
        made = [self.as_they_are(chunks.filter(pa.array(~plain)).to_pylist())]
        if plain.any():
            made.append(self.by_words(points[np.repeat(plain, sizes)], np.append(0, np.cumsum(sizes[plain]))))
        place = np.where(plain, np.cumsum(plain) - 1 + len(made[0]), np.cumsum(~plain) - 1)
        return pa.concat_arrays(made).take(pa.array(place))

    def all(self, texts: pa.StringArray, end: bytes) -> list[bytes]:
        """Ids of whole texts, with `end` behind each; null counts as empty."""
        parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        coded = parts.values.dictionary_encode()
        found = self.encode(coded.dictionary).take(coded.indices)
        self.chunks.forget()
        stops = found.offsets.take(parts.offsets).to_numpy().tolist()
        raw = memoryview(found.values.to_numpy().tobytes())
        return [bytes(raw[4 * a : 4 * z]) + end for a, z in zip(stops, stops[1:], strict=False)]

    def __call__(self, texts: list[str | None], end: bytes) -> list[bytes]:
        return self.all(pa.array(texts, pa.string()), end)


def flat(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of strings without nulls, one after another, and where they end, from 0."""
    _, ends, data = strings.buffers()
    ends = np.frombuffer(ends, np.int32)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int32)
    data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


_READY: dict[str, LibraryEncoder] = {}


def ready(content: bytes) -> LibraryEncoder:
    """The encoder of a file's contents, made once in each Python worker; words that it met serve the worker's next tasks too."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _READY:
        _READY.clear()
        _READY[key] = LibraryEncoder(content)
    return _READY[key]


def packed(array: np.ndarray) -> bytes:
    body = zlib.compress(array.tobytes(), 6)
    return struct.pack("<III", len(array), len(body), zlib.crc32(body)) + body


def unpacked(data: memoryview, at: int, kind: str) -> tuple[np.ndarray, int]:
    count, size, check = struct.unpack_from("<III", data, at)
    body = bytes(data[at + 12 : at + 12 + size])
    if zlib.crc32(body) != check:
        raise ValueError("damaged head or index of a token file")
    return np.frombuffer(zlib.decompress(body), kind, count), at + 12 + size


def tally(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids, the place of each id among them, and how often they occur."""
    if not len(ids) or int(ids.max()) >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    names = np.flatnonzero(counts)
    return names.astype("<u4"), (np.cumsum(counts > 0, dtype=np.int32) - 1)[ids], counts[names]


def write_file(doc_ids: list[int | None], tokens: list[bytes]) -> bytes:
    """Contents of a file."""
    ids = np.frombuffer(b"".join(tokens), "<i4").view("<u4")
    names, local, counts = tally(ids)
    blocks = [local[i : i + BLOCK] for i in range(0, len(local), BLOCK)]
    coded = encode(blocks, Shares(counts)) if blocks else []
    out = [MAGIC, packed(names), packed(counts.astype("<u8"))]
    out.append(packed(np.array([0 if d is None else d for d in doc_ids], "<i8")))
    out.append(packed(np.array([d is None for d in doc_ids], "u1")))
    out.append(packed(np.array([len(t) // 4 for t in tokens], "<u8")))
    out.append(struct.pack("<I", len(blocks)))
    for at, body in enumerate(coded):
        own = ids[at * BLOCK : (at + 1) * BLOCK]
        out += [struct.pack("<III", len(own), len(body), zlib.crc32(own.tobytes())), body]
    return b"".join(out)


def read_file(data: memoryview) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, numbers of tokens, and all ids of a file; damaged blocks are refused."""
    if bytes(data[: len(MAGIC)]) != MAGIC:
        raise ValueError("not a token file")
    names, at = unpacked(data, len(MAGIC), "<u4")
    counts, at = unpacked(data, at, "<u8")
    docs, at = unpacked(data, at, "<i8")
    none, at = unpacked(data, at, "u1")
    lengths, at = unpacked(data, at, "<u8")
    (n,) = struct.unpack_from("<I", data, at)
    at += 4
    bodies, sizes, checks = [], [], []
    for _ in range(n):
        size, length, check = struct.unpack_from("<III", data, at)
        bodies.append(bytes(data[at + 12 : at + 12 + length]))
        sizes.append(size)
        checks.append(check)
        at += 12 + length
    blocks = [names[b] for b in decode(bodies, sizes, Shares(counts))] if n else []
    for block, check in zip(blocks, checks, strict=True):
        if zlib.crc32(block.tobytes()) != check:
            raise ValueError("damaged block of a token file")
    ids = np.concatenate(blocks) if blocks else np.zeros(0, "<u4")
    return [None if missing else int(d) for d, missing in zip(docs, none, strict=True)], lengths.astype(np.int64), ids


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 1, text: str = "text", key: str = "doc_id") -> None:
    """Encodes all documents with the tokenizers library and writes them to a new folder."""
    content = spread(docs, tokenizer)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumns(
        {"h": F.xxhash64("text"), "rid": F.monotonically_increasing_id()}
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.repartitionByRange(max(1, -(-total // FILE_BYTES)), "doc_id", "h", "rid").sortWithinPartitions("doc_id", "h", "rid")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, folder = store(path)
        fs.create_dir(folder, recursive=True)
        coder, last = ready(content.value), struct.pack("<i", end)
        part, turn = TaskContext.get().partitionId(), 0
        docs_held: list[int | None] = []
        tokens: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal held, turn
            name = f"{part:06d}-{turn:04d}-{uuid.uuid4().hex}.ids"
            with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(write_file(docs_held, tokens))
            row = pa.RecordBatch.from_pydict({"part": [part], "turn": [turn], "file": [name], "n_docs": [len(docs_held)], "n_ids": [held]}, pa.schema([("part", pa.int32()), ("turn", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            docs_held.clear()
            tokens.clear()
            held, turn = 0, turn + 1
            return row

        def add(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal held
            whole = pa.Table.from_batches(pieces).combine_chunks()
            for doc_id, made in zip(whole.column(0).to_pylist(), coder.all(whole.column(1).chunk(0), last), strict=True):
                docs_held.append(doc_id)
                tokens.append(made)
                held += len(made) // 4
                if held >= FILE_IDS:
                    yield close()

        pieces: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for piece in slices(batch, 1):
                own = pc.sum(pc.binary_length(piece.column(1))).as_py() or 0
                if pieces and size + own > TOGETHER:
                    yield from add(pieces)
                    pieces, size = [], 0
                pieces.append(piece)
                size += own
        if pieces:
            yield from add(pieces)
        if docs_held:
            yield close()
        del pieces
        finish()

    files = rows.select("doc_id", "text").mapInArrow(run, "part int, turn int, file string, n_docs bigint, n_ids bigint")
    files.write.parquet(f"{path}/{MANIFEST}")


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """`doc_id`, `start`, `n_tokens`, `ids_crc32` and, if asked for, `ids` of every document."""
    files = spark.read.parquet(f"{path}/{MANIFEST}")
    order = W.orderBy("part", "turn").rowsBetween(W.unboundedPreceding, -1)
    files = files.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).cast("bigint")).select("file", "start")
    count = max(1, files.count())
    place = F.row_number().over(W.orderBy("file"))
    files = files.withColumn("place", place).repartitionByRange(count, "place").select("file", "start")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if ids else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = store(path)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as file:
                    docs, lengths, found = read_file(memoryview(file.read()))
                yield from entries(docs, lengths, found, start, ids)

    return files.mapInArrow(run, schema)


def entries(docs: list, lengths: np.ndarray, found: np.ndarray, start: int, ids: bool) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(lengths)
    starts = ends - lengths
    for at in range(0, len(docs), 1000):
        span = range(at, min(at + 1000, len(docs)))
        own = [found[starts[i] : ends[i]] for i in span]
        columns = [
            pa.array(docs[span.start : span.stop], pa.int64()), pa.array(starts[span.start : span.stop] + start), pa.array(lengths[span.start : span.stop]),
            pa.array([zlib.crc32(o.astype("<u4").tobytes()) for o in own], pa.int64()),
        ]
        if ids:
            columns.append(pa.array([o.astype(np.int64) for o in own], pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
