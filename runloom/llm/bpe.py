"""BPE by a tokenization automaton.

The automaton reads token labels and accepts exactly the token sequences that BPE
makes. It is built merge by merge with gadgets. A state is known by the label of
the arcs that enter it, so the automaton is the relation "label y may leave the
state behind label x". At first all base symbols may follow each other. The gadget
of merge k, (u, v) -> w, does three things:

- w enters a copy of the state behind v, so what may follow w is what may follow v
  at this time;
- w leaves every state that u leaves, except the state behind u when u = v;
- the state behind u is split off without its v arc.

Copies made by a gadget are never written out: a table of gadgets (parts and rank
of each label, rank of each removed arc) is enough to follow them back, so each
question about an arc is answered once by table look-ups and then kept in a table
of arcs. Composed with the labels' spelling it reads symbols: a second table leads
from symbol to symbol and says which labels end at a place. Every prefix of a word
has one accepted path, so one pass over a word finds it: at each place there is one
label that ends there and whose arc exists. Encoding emits the ids of that path,
decoding the labels of ids.

Texts are parted, normalised and split into words as the tokenizer file says (NFC,
lower case, one pattern, byte alphabet, `</w>` behind the last symbol); special
tokens in a text are ids of their own. White space parts words always, so each
task keeps the ids of the chunks between white space that it has seen.

Defined results: a null text is encoded as empty, with no ids; null ids decode to
the empty text; unknown ids are skipped; repeated rows and null keys stay; empty
tables stay empty; columns not named by `keep` are left out.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import add_columns

#: Bytes of a generation of kept chunks and words, and arcs kept before the table starts afresh.
KEPT_CHUNKS, KEPT_WORDS, KEPT_ARCS = 56 << 20, 20 << 20, 400_000
#: What an entry takes besides its key and value, in bytes.
ENTRY = 200
#: Symbol behind a word's last one; stands for the file's word-end suffix.
END = "\0"
#: ASCII separators that Python takes for white space and the tokenizers do not.
ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it has one, else from 256 upwards."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table, spare = [], 256
    for b in range(256):
        table.append(chr(b if b in plain else spare))
        spare += b not in plain
    return table


class Automaton:
    """The tokenization automaton of a list of merges over a vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[tuple[str, str]], suffix: str):
        self.suffix = suffix
        self.size = max(vocab.values()) + 1
        self.parts: dict[int, tuple[int, int, int]] = {}  # label -> left, right, rank of its gadget
        self.removed: dict[int, int] = {}  # arc -> rank of the gadget that removes it
        self.arcs: dict[int, bool] = {}
        made = set()
        for rank, (left, right) in enumerate(merges):
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            if not self.arc(u, v, rank):
                continue  # no path uses u v any more, so nothing can be merged
            self.parts[w] = (u, v, rank)
            self.removed[u * self.size + v] = rank
            made.add(w)
        self.arcs.clear()
        cut = len(suffix)
        self.length: dict[int, int] = {}
        finals = {}
        for text, label in vocab.items():
            final = bool(suffix) and text.endswith(suffix) and len(text) > cut
            if final:
                text = text[:-cut] + END
            if label in made or len(text) == 1 + final:
                finals[text] = label
                self.length[label] = len(text)
        self.table(finals)

    def table(self, labels: dict[str, int]) -> None:
        """Transitions over symbols: where to go, where to fall back, which labels end here."""
        self.go, self.back, self.found = [{}], [0], [()]
        own: list[int] = [-1]
        for text, label in labels.items():
            at = 0
            for c in text:
                after = self.go[at].get(c)
                if after is None:
                    after = self.go[at][c] = len(self.go)
                    self.go.append({})
                    self.back.append(0)
                    self.found.append(())
                    own.append(-1)
                at = after
            own[at] = label
        level = [0]
        while level:  # by depth, so that shorter strings are ready
            below = []
            for at in level:
                for c, after in self.go[at].items():
                    fall = self.back[at]
                    while fall and c not in self.go[fall]:
                        fall = self.back[fall]
                    self.back[after] = self.go[fall].get(c, 0) if at else 0
                    rest = self.found[self.back[after]]
                    self.found[after] = ((own[after], self.length[own[after]]), *rest) if own[after] >= 0 else rest
                    below.append(after)
            level = below

    def arc(self, x: int, y: int, before: int) -> bool:
        """Whether the state behind x has a y arc just before gadget `before`."""
        while True:
            gone = self.removed.get(x * self.size + y)
            if gone is not None and gone < before:
                return False
            px, py = self.parts.get(x), self.parts.get(y)
            rx, ry = px[2] if px else -1, py[2] if py else -1
            if rx < 0 and ry < 0:
                return True
            if rx >= ry:  # x's state is the copy of that behind its right part
                x, before = px[1], rx
                if rx == ry:  # x = y: its own arc was copied with its left part's
                    y = py[0]
            else:  # y leaves where its left part leaves, after the gadget's removal
                y, before = py[0], ry + 1 if x == py[0] else ry

    def step(self, x: int, y: int) -> bool:
        """The arc as the finished automaton has it, added to the table of arcs."""
        if len(self.arcs) >= KEPT_ARCS:
            self.arcs.clear()
        known = self.arcs[x * self.size + y] = self.arc(x, y, 1 << 60)
        return known

    def path(self, word: str) -> list[int]:
        """Labels of the one accepted path over a word's symbols."""
        if self.suffix:
            word += END
        go, back, found, arcs, size = self.go, self.back, self.found, self.arcs, self.size
        ends = [-1] * (len(word) + 1)  # label that ends at each place
        node, at = 0, 0
        for c in word:
            at += 1
            after = go[node].get(c)
            while after is None and node:
                node = back[node]
                after = go[node].get(c)
            node = after or 0
            for y, length in found[node]:
                if length == at:
                    ends[at] = y
                    break
                x = ends[at - length]
                if x >= 0:
                    known = arcs.get(x * size + y)
                    if known is None:
                        known = self.step(x, y)
                    if known:
                        ends[at] = y
                        break
        out, lengths = [], self.length
        while at:
            out.append(ends[at])
            at -= lengths[ends[at]]
        return out[::-1]


class Kept(dict):
    """What was made for recent keys: a full generation becomes the old one, whose entries come back when asked for.

    `unit` is what one item of a value takes; what is larger than a generation is not kept.
    """

    def __init__(self, make, size: int, unit: int):
        super().__init__()
        self.make, self.size, self.unit, self.held, self.old = make, size, unit, 0, {}

    def put(self, key: str, value) -> None:
        cost = ENTRY + len(key) + self.unit * len(value)
        if cost > self.size:
            return
        if self.held + cost > self.size:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self.held += cost
        self[key] = value

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value


class Tokenizer:
    """Encoder and decoder for a tokenizer file's contents."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.labels = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self.alphabet = byte_alphabet()
        self.words = Kept(self.word, KEPT_WORDS, 36)
        self.chunks = Kept(lambda chunk: array("i", self.ids(chunk)).tobytes(), KEPT_CHUNKS, 1)

    @functools.cached_property
    def automaton(self) -> Automaton:
        """Compiled when a first word asks for it; decoding needs the labels only."""
        made = Automaton(self.vocab, self.merges, self.suffix)
        del self.merges
        return made

    def word(self, word: str) -> list[int]:
        alphabet = self.alphabet
        return self.automaton.path(word if word.isascii() and word.isalnum() else "".join([alphabet[b] for b in word.encode()]))

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        out: list[int] = []
        for w in self.pattern.findall(text):
            out += self.words[w]
        return out

    def ids(self, text: str) -> list[int]:
        if self.special is None or "<" not in text:
            return self.plain(text)
        out, last = [], 0
        for m in self.special.finditer(text):
            out += self.plain(text[last : m.start()])
            out.append(self.added[m[0]])
            last = m.end()
        return out + self.plain(text[last:])

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if not text:
            return b""
        if ODD_SPACE.search(text):
            return np.array(self.ids(text), "<i4").tobytes()
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def decode(self, ids: Sequence[int]) -> str:
        """Labels of the ids, parted by blanks, as the library does for files without a decoder."""
        labels = self.labels
        try:
            return " ".join(map(labels.__getitem__, ids))
        except KeyError:
            return " ".join(labels[i] for i in ids if i in labels)


_READY: dict[str, Tokenizer] = {}


def ready(content: bytes) -> Tokenizer:
    """The tokenizer of a file's contents, compiled once in each Python worker."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _READY:
        _READY.clear()
        _READY[key] = Tokenizer(content)
    return _READY[key]


def forget() -> None:
    """Leaves a worker the compiled automaton only, without what was kept of a task's texts."""
    for tokenizer in _READY.values():
        for kept in (tokenizer.words, tokenizer.chunks):
            kept.clear()
            kept.old, kept.held = {}, 0
        if "automaton" in tokenizer.__dict__:
            tokenizer.automaton.arcs.clear()


def spread(df: DataFrame, path: str):
    """The file's contents (a few MB, whatever the input) for all tasks."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """Kept columns and the token ids of every whole text."""
    content = spread(docs, path)

    def make():
        tokenizer = ready(content.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            found = [tokenizer.encode(t) for t in texts.to_pylist()]
            ends = np.cumsum([0, *(len(b) // 4 for b in found)], dtype=np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))]

        return work

    return add_columns(docs, text, keep, make, [T.StructField(ids, T.ArrayType(T.IntegerType()))], forget)


def decode(coded: DataFrame, path: str, ids: str = "ids", keep: Sequence[str] = ("doc_id", "ids"), text: str = "decoded") -> DataFrame:
    """Kept columns and the text of the ids."""
    content = spread(coded, path)

    def make():
        tokenizer = ready(content.value)

        def work(lists: pa.Array) -> list[pa.Array]:
            return [pa.array([tokenizer.decode(i.tolist()) for i in _numpy_lists(lists)], pa.string())]

        return work

    return add_columns(coded, ids, keep, make, [T.StructField(text, T.StringType())])


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",), ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Kept columns, the token ids of every whole text and the text of these ids: one pass, one tokenizer in each worker."""
    content = spread(docs, path)

    def make():
        tokenizer = ready(content.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            found = [tokenizer.encode(t) for t in texts.to_pylist()]
            ends = np.cumsum([0, *(len(b) // 4 for b in found)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
            return [lists, pa.array([tokenizer.decode(np.frombuffer(b, "<i4").tolist()) for b in found], pa.string())]

        return work

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]
    return add_columns(docs, text, keep, make, fields)


def _numpy_lists(lists: pa.Array):
    """Each list as a NumPy array; null lists as empty ones."""
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
