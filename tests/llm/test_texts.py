"""Extraction, tokens, archives and token files against brute force and exact round trips."""

import base64
import gzip
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.llm import bpe, catalog, html_text, token_files, warc
from runloom.llm.range_coder import BLOCK, Shares, decode, encode

tokenizers = pytest.importorskip("tokenizers")
TEXTS = [
    None, "", "  ", "Hello  wörld's <|endoftext|> foo🙂 ﬁ 12", "a\x1cb c\x1f", "ΑΣ ΟΔΟΣ İstanbul", "<|startoftext|><|endoftext|>x", "é café x",
    "he'll it's 'tis l'd", "=" * 500, "banana bananananana mississippi", "x" * 3000 + " " + "the of " * 5000, "aaaaaaaaaaaaaaa aaaa", '"quoted" "',
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(catalog.vocabulary())


@pytest.fixture(scope="module")
def own():
    with open(catalog.vocabulary(), "rb") as file:
        return bpe.Tokenizer(file.read())


def test_automaton_equals_the_library(own, library):
    rng = random.Random(4)
    pieces = [t.replace("</w>", "") for t in own.vocab]
    made = ["".join(rng.choices(pieces, k=rng.randint(1, 4))) for _ in range(3000)]
    made += ["".join(rng.choices("abcdefginorst", k=rng.randint(1, 30))) for _ in range(3000)]
    for text in [t for t in TEXTS if t is not None] + made:
        ids = np.frombuffer(own.encode(text), "<i4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False), text


def brute_bpe(word, ranks):
    while True:
        found = [(ranks[p], i) for i, p in enumerate(itertools.pairwise(word)) if p in ranks]
        if not found:
            return word
        _, i = min(found)
        word = [*word[:i], word[i] + word[i + 1], *word[i + 2 :]]


def test_gadgets_on_a_small_alphabet():
    """All words over two letters, for merges with equal parts and with merges of merges."""
    for merges in ([("a", "a"), ("aa", "a"), ("a", "b")], [("a", "b"), ("b", "a"), ("ab", "ab"), ("b", "b"), ("abab", "b")], [("b", "b"), ("a", "bb"), ("abb", "abb"), ("a", "a")]):
        names = ["a", "b", *(x + y for x, y in merges)]
        vocab = {t: i for i, t in enumerate(names)}
        machine = bpe.Automaton(vocab, merges, "")
        ranks = {m: i for i, m in enumerate(merges)}
        for n in range(1, 11):
            for word in itertools.product("ab", repeat=n):
                assert [names[i] for i in machine.path("".join(word))] == brute_bpe(list(word), ranks)


def test_encode_and_decode_tables(spark, documents, library):
    docs = documents([(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "a b", "s"), (3, TEXTS[3], "s")])
    coded = bpe.encode(docs, catalog.vocabulary(), keep=("doc_id", "text", "size"))
    back = bpe.decode(coded, catalog.vocabulary(), keep=("doc_id", "text", "ids", "size")).collect()
    assert len(back) == len(TEXTS) + 2
    for r in back:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False) and r.size == "x"
    assert bpe.encode(documents([]), catalog.vocabulary()).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [1, 10**6, 2])], "doc_id int, ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, catalog.vocabulary()).orderBy("doc_id").collect()] == ["", "", "\" #"]


def test_range_coder_round_trip():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 3, 3 * BLOCK + 5), rng.zipf(1.3, 2 * BLOCK) % 60000, np.zeros(BLOCK, int), rng.integers(0, 90000, 40000), np.array([7]), np.tile(np.arange(500), 40)):
        names, local, counts = np.unique(ids, return_inverse=True, return_counts=True)
        shares = Shares(counts)
        blocks = [local[i : i + BLOCK] for i in range(0, len(local), BLOCK)]
        coded = encode(blocks, shares)
        assert all((a == b).all() for a, b in zip(blocks, decode(coded, [len(b) for b in blocks], shares), strict=True))
        # a block is read without its neighbours
        assert (decode(coded[-1:], [len(blocks[-1])], shares)[0] == blocks[-1]).all()
    assert sum(map(len, coded)) < 0.3 * len(ids)  # a cycle is predicted
    with pytest.raises(ValueError):
        Shares(np.ones(1 << 18, int))


def test_token_files(spark, documents, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 10_000)
    rows = [(i * 7 % 31, t, "s") for i, t in enumerate(TEXTS * 3)] + [(None, "b", "s"), (None, None, "s")]
    token_files.write(documents(rows).repartition(5), str(tmp_path / "ids"), catalog.vocabulary())
    got = token_files.read(spark, str(tmp_path / "ids")).collect()
    assert len(list((tmp_path / "ids").glob("*.ids"))) > 1
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 1
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    plain = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _ in rows]
    order = lambda x: (-1 if x[0] is None else x[0], x[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=order) == sorted(plain, key=order)
    token_files.write(documents([]), str(tmp_path / "none"), catalog.vocabulary())
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("kept", [0, 600, 1 << 20])
def test_token_files_keep_chunks_by_bytes(library, monkeypatch, kept):
    """Whatever is kept or forgotten, also a chunk larger than a generation, the ids are the library's."""
    monkeypatch.setattr(token_files, "KEPT_CHUNKS", kept)
    with open(catalog.vocabulary(), "rb") as file:
        coder = token_files.LibraryEncoder(file.read())
    texts = [*TEXTS, None, "word " * 50, "x" * 1000, *TEXTS]
    for batch in (texts[:3], texts, texts[::-1]):
        got = [np.frombuffer(b, "<i4").tolist() for b in coder(batch, np.array([1], "<i4").tobytes())]
        assert got == [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in batch]
        assert coder.chunks.held <= kept


def test_words_are_encoded_once(library):
    """Plain chunks get the library's ids from those of their words, each asked for once; all other chunks from the library itself."""
    with open(catalog.vocabulary(), "rb") as file:
        coder = token_files.LibraryEncoder(file.read())
    asked = []
    ask = coder.tokenizer

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(w for t in texts for w in t.split())
            return ask.encode_batch_fast(texts, **options)

        def encode(self, text, **options):
            return ask.encode(text, **options)

    coder.tokenizer = Counting()
    letters = [c for c in map(chr, range(0x21, 0x250)) if not c.isspace()]
    texts = ["Word, word. WORD! (word) word's 'Word'S''s word1 word12 'LL'll'd 'x", " ".join(letters), " ".join(f"a{c}B{c}{c}'{c}9" for c in letters)]
    texts += [" ".join(a + b for a in letters[i::7] for b in letters[:40]) for i in range(7)]
    texts += ["e\u0301 \u0130I \u03a3\u03a3 \u4e00\u4e8c \u1e9e\ufb01 \u0149", "a<|endoftext|>b <|ENDOFTEXT|> <|x|>", "a\x00b \x7f \x01", "", None, "a\x1cb"]
    for batch in (texts[:1], texts, texts[::-1]):
        got = [np.frombuffer(b, "<i4").tolist() for b in coder(batch, b"")]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in batch]
    assert asked.count("word") == 1 and len(asked) == len(set(asked))


def test_plain_chunks_are_cut_as_the_pattern_says():
    rng = random.Random(7)
    letters = [c for c in map(chr, range(0x250)) if token_files.PLAIN.fullmatch(c) and not c.isspace()]
    chunks = ["", "'", "''s", "'S", "x'LL", "'l", "l'", "r'e", "'re've'm'd't", "1's2'", "'ll'", "\u023a'S\u023e", "\u00b2\u00bdx", ""]
    chunks += ["".join(rng.choices("'lLvVeErRsdmtx1.\u00e9", k=rng.randint(0, 8))) for _ in range(3000)]
    chunks += ["".join(rng.choices(letters, k=rng.randint(1, 8))) for _ in range(3000)]
    for some in (chunks, chunks[::-1], ["a'"], ["", ""], ["'s"]):
        points = np.array([ord(c) for chunk in some for c in chunk], "<u4")
        words, parts = token_files.cut(points, np.append(0, np.cumsum([len(c) for c in some])))
        assert [words[a:z].to_pylist() for a, z in itertools.pairwise(parts.tolist())] == [token_files.regex.findall(token_files.WORDS, c.lower()) for c in some]


def test_words_of_earlier_tasks_are_not_asked_again(library, monkeypatch):
    """The encoder of a worker goes on from task to task; each lot's chunks are looked at once, and what is kept is bounded."""
    with open(catalog.vocabulary(), "rb") as file:
        content = file.read()
    asked, seen = [], []
    monkeypatch.setattr(token_files, "_READY", {})
    coder = token_files.ready(content)
    ask, encode = coder.ask, coder.encode
    monkeypatch.setattr(coder, "ask", lambda words: asked.append(words.to_pylist()) or ask(words))
    monkeypatch.setattr(coder, "encode", lambda chunks: seen.append(chunks.to_pylist()) or encode(chunks))
    texts = ["one two, one", "Two\u3000three one four\u4e00", None, "", "five <|endoftext|> two"]
    for batch in (texts, texts[::-1]):
        got = [np.frombuffer(b, "<i4").tolist() for b in token_files.ready(content)(batch, b"")]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in batch]
    assert [sorted(a) for a in asked] == [[",", "five", "one", "two"]]
    assert all(len(s) == len(set(s)) for s in seen)
    monkeypatch.setattr(token_files, "KEPT_WORDS", 40)
    for batch in (["six"], ["six seven eight nine ten eleven"], ["twelve six"]):
        assert [np.frombuffer(b, "<i4").tolist() for b in coder(batch, b"")] == [library.encode(t, add_special_tokens=False).ids for t in batch]
        assert coder.words.nbytes + coder.made.nbytes <= 40


def test_a_prediction_that_was_hardly_ever_right_can_still_be_coded():
    """Order 2 nearly sure, order 1 nearly never right in the same context, and then order 1 is right after all."""
    ids, fresh = [], 100
    for turn in range(1100):
        i = turn % 6
        wrong = turn < 850 and turn % 5 == 4
        fresh += wrong
        ids += [1 + i, 0, fresh if wrong else 20 + i]
        if turn > 1050 and turn % 7 == 0:
            ids[-1] = ids[-4]
    names, local, counts = np.unique(ids, return_inverse=True, return_counts=True)
    shares = Shares(counts)
    assert (decode(encode([local], shares), [len(local)], shares)[0] == local).all()


def test_a_block_with_damage_at_its_end_is_refused():
    """Also where the damage is too small to change an id."""
    blocks = [np.arange(600) % 7, np.zeros(5, int)]
    shares = Shares(np.bincount(np.concatenate(blocks)))
    coded = encode(blocks, shares)
    for at in (-1, -4, -8):
        bad = bytearray(coded[0])
        bad[at] ^= 1
        with pytest.raises(ValueError):
            decode([bytes(bad), coded[1]], [600, 5], shares)


def test_ids_are_tallied():
    for ids in ([3, 1, 3, 0], [7], [], [1 << 31, 5, 1 << 31]):
        ids = np.array(ids, "<u4")
        names, local, counts = token_files.tally(ids)
        assert names.tolist() == sorted(set(ids.tolist())) and names[local].tolist() == ids.tolist()
        assert counts.tolist() == [ids.tolist().count(n) for n in names.tolist()]


def test_damage_is_found():
    data = bytearray(token_files.write_file([1, None], [np.arange(50, dtype="<i4").tobytes(), np.array([1], "<i4").tobytes()]))
    docs, lengths, ids = token_files.read_file(memoryview(data))
    assert docs == [1, None] and lengths.tolist() == [50, 1] and ids.tolist() == [*range(50), 1]
    data[-3] ^= 255
    with pytest.raises(ValueError):
        token_files.read_file(memoryview(data))


PAGES = [
    (3, "http://a.org/1", "<p>same</p>"), (1, "http://a.org/2", "<p>same</p>"), (2, None, "other é"), (4, "http://b.org/\r\nX: y", None), (None, "u", ""),
    (5, "u", "<p>same</p>"), (1, "http://a.org/2", "<p>same</p>"), (7, "é", "x" * 200_000), (8, "w", "line\r\n\r\nWARC/1.1\r\n\r\n"), (None, "v", "only without id"),
]


@pytest.mark.parametrize("roll", [1, 1 << 20])
def test_archive_round_trip(spark, tmp_path, monkeypatch, roll):
    monkeypatch.setattr(warc, "ROLL_BYTES", roll)
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id bigint, url string, html string, payload string")
    path = str(tmp_path / "w")
    warc.write(warc.records(pages), path)
    got = warc.read(spark, path).collect()
    assert len(got) == len(PAGES)
    first = {}
    for i, _, h in PAGES:
        own = [j for j, _, g in PAGES if (g or "") == (h or "") and j is not None]
        first[h or ""] = min(own) if own else None
    want = []
    for i, u, h in PAGES:
        raw = (h or "").encode()
        response = first[h or ""] is None or first[h or ""] == i
        want.append((
            i, u and u.replace("\r", "%0D").replace("\n", "%0A"), "response" if response else "revisit", base64.b32encode(hashlib.sha1(raw).digest()).decode(),
            len(raw), None if response else first[h or ""], raw if response else None,
        ))
    key = lambda r: str(r)
    assert sorted((tuple(r[:6]) + ((bytes(r.payload) if r.payload is not None else None),) for r in got), key=key) == sorted(want, key=key)
    headers = warc.read(spark, path, ["page_id", "record_type", "payload"]).where("record_type = 'revisit' AND page_id >= 3")
    assert sorted(r.page_id for r in headers.collect()) == [3, 5]
    assert "PushedFilters" in headers._jdf.queryExecution().toString() or headers.count() == 2
    warc.write(warc.records(pages.limit(0)), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_small_payloads_can_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id bigint, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.records(pages, min_bytes=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_filters_skip_records_before_their_payload():
    rows = [(i, f"http://h/{i}", "response", "D", 3, None, b"abc") for i in range(5)] + [(9, None, "revisit", "D", 3, 1, None)]
    plain = b"".join(warc.compose(*r) for r in rows)
    packed = b"".join(gzip.compress(warc.compose(*r)) for r in rows)
    from pyspark.sql.datasource import EqualTo, In, StringStartsWith

    for data, zipped in ((plain, False), (packed, True)):
        read = lambda *f, wanted=True, d=data, z=zipped: list(warc.parsed(memoryview(d), z, f, wanted))
        assert [r[0] for r in read()] == [0, 1, 2, 3, 4, 9]
        assert [r[0] for r in read(EqualTo(("record_type",), "revisit"))] == [9]
        assert [r[0] for r in read(In(("page_id",), (2, 4)), StringStartsWith(("url",), "http://h/"))] == [2, 4]
        assert {r[-1] for r in read(wanted=False)} == {None}


def test_long_headers_do_not_end_a_plain_archive():
    rows = [(i, "http://h/" + "x" * (300_000 if i == 1 else 1), "response", "D", 3, None, b"abc") for i in range(4)]
    plain = b"".join(warc.compose(*r) for r in rows)
    got = list(warc.parsed(memoryview(plain), False, (), True))
    assert [(r[0], len(r[1]), bytes(r[-1])) for r in got] == [(i, len(u), b"abc") for i, u, *_ in rows]
    with pytest.raises(ValueError, match="without end"):
        list(warc.parsed(memoryview(plain + b"WARC/1.1\r\nA: b"), False, (), True))


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head>
<body class="menu-open"><header><a href=/>Site</a></header><nav><ul>{links}</ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><h1>Title {i} &amp; more</h1><p>First <b>bold{i}</b>, &lt;tag&gt; &eacute;&nbsp;end.<br>next
line {i}<p>Second {i}</p><div class="share-buttons">Share</div><p class=note>Standing offer to all readers</p><ul><li>one {i}<li>two</ul></article>
<aside>More {i} text here that is long enough</aside><section id="comments"><p>A comment {i} of a reader that is rather long, longer than the article maybe</p></section></main>
<form><p>Name</p><input></form><div class="ad">Buy {i}</div><footer>&copy; {i}</footer></body></html>"""


def page(i):
    return PAGE.format(i=i, links="".join(f"<li><a href=/{k}>menu {k} {i}</a>" for k in range(i % 4 + 1)))


def text_of(i, offer):
    blocks = [f"Title {i} & more", f"First bold{i}, <tag> é end. next line {i}", f"Second {i}"]
    return "\n".join([*blocks, *(["Standing offer to all readers"] if offer else []), f"one {i}", "two"])


def test_article_text(spark):
    rows = [(i, "http://big.org/x", page(i), "c") for i in range(20)] + [(100, "http://one.org/", page(100), "c"), (101, None, page(101), "c")]
    rows += [(102, "http://big.org/", None, "c"), (103, "http://big.org/", "", "c"), (104, "http://big.org/", "<div><p>Other <i>lay</i>out</p></div>", "c")]
    rows += [(None, "http://big.org/", "plain text < only & all", "c"), (105, "http://cut.org/", "<article><p>cut of<p>here <a hre", "c"), (0, "http://big.org/x", page(0), "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    plans = html_text.wrappers(pages)
    got = {(r.page_id, r.url): r.text for r in html_text.main_text(pages, plans).collect()}
    for i in range(20):
        # twenty pages of one host share the offer, but it stands in the article
        assert got[i, "http://big.org/x"] == text_of(i, offer=True), i
    assert got[100, "http://one.org/"] == text_of(100, offer=True) and got[101, None] == text_of(101, offer=True)
    assert got[102, "http://big.org/"] == "" == got[103, "http://big.org/"]
    assert got[104, "http://big.org/"] == "Other layout" and got[None, "http://big.org/"] == "plain text < only & all"
    assert got[105, "http://cut.org/"] == "cut of\nhere"
    assert html_text.main_text(pages, plans).count() == len(rows)
    assert html_text.main_text(pages.limit(0), html_text.wrappers(pages.limit(0))).count() == 0


def host_texts(pages):
    """Texts of the pages of one host."""
    whole = html_text.wrap(html_text.parse(pages[0]))
    for p in pages[1:]:
        whole = html_text.merge(whole, html_text.wrap(html_text.parse(p)))
    return [html_text.extract(p, html_text.plan(whole)) for p in pages]


MENU = "<nav><a href=/>Home</a></nav>"


@pytest.mark.parametrize("count", [1, 3, 12])
@pytest.mark.parametrize("form, blocks", [
    ("<article><h1>T{i}</h1><div class=content><p>body {i} of some length</p><p>and more {i}</p></div></article>", ["T{i}", "body {i} of some length", "and more {i}"]),
    ("<article><div class=lead>lead {i} words</div><div class=body>body {i} of the article, that is longer</div></article>", ["lead {i} words", "body {i} of the article, that is longer"]),
    ("<div><section id=one><p>first {i}</p></section><section id=two><p>second {i}, a good deal longer than it</p></section></div>", ["first {i}", "second {i}, a good deal longer than it"]),
    ("<div class='layout has-sidebar'><article><p>text {i} of it</p></article><div class=sidebar>more {i}</div></div>", ["text {i} of it"]),
    ("<div id=page class='site header-fixed'><div><p>text {i} of it</p></div></div>", ["text {i} of it"]),
    ("<form id=f><main><p>text {i} of it</p></main></form>", ["text {i} of it"]),
    ("<article><p>before {i}<svg-icon></svg-icon><object-view></object-view><template-x></template-x><p>after {i}</article>", ["before {i}", "after {i}"]),
    ("<article><h2>Summary</h2><p>text {i}</p><p>A shared passage.</p></article>", ["Summary", "text {i}", "A shared passage."]),
    ("<article><p class=intro>The same intro</p><p>text {i}</p></article>", ["The same intro", "text {i}"]),
    ("<article><header><h1>Title {i}</h1></header><p>text {i}</p></article>", ["Title {i}", "text {i}"]),
    ("<article><p>body {i}</p><div class='comment-list'><p>" + "a long reader comment " * 20 + "</p></div></article>", ["body {i}"]),
    ("<article><p>body {i}</p><section id=replies><p>" + "a long reply " * 20 + "</p></section><div class=discussion>more words</div></article>", ["body {i}"]),
    ("<article><p title='never closed>body {i}</p><p>more {i}</p></article>", ["body {i}", "more {i}"]),
])
def test_whole_article(count, form, blocks):
    pages = [f"<html><body>{MENU}{form.format(i=i)}<footer>end</footer></body></html>" for i in range(count)]
    assert host_texts(pages) == ["\n".join(b.format(i=i) for b in blocks) for i in range(count)]


def test_template_counts_pages_and_keeps_to_its_place():
    one = "<div><dl>" + "".join(f"<dt>Q{i}<dd>Yes" for i in range(8)) + "</dl></div>"
    assert host_texts([one])[0].count("Yes") == 8
    form = "<body><div><p class=ad-note>{first}</p><p>own {i}</p><blockquote>{again}</blockquote></div></body>"
    got = host_texts([form.format(first="Shared line", i=i, again="Shared line" if i == 3 else f"other {i}") for i in range(12)])
    assert got == [f"own {i}\n" + ("Shared line" if i == 3 else f"other {i}") for i in range(12)]


def test_deep_and_long_pages(spark):
    deep = "<article>" + "<div>" * 50_000 + "<p>deep text</p>" + "</div>" * 50_000 + "<p>after</p></article>"
    open_ended = "<article><p>first</p>" + "<div><span>" * 50_000 + "last"
    long = "<article>" + "".join(f"<p>paragraph {i} of a page with very many of them</p>" for i in range(100_000)) + "</article>"
    assert len(long) > 5_000_000
    pages = spark.createDataFrame([(1, "http://a.org/", deep), (2, "http://a.org/", open_ended), (3, "http://b.org/", long)], "page_id int, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(pages, html_text.wrappers(pages)).collect()}
    assert got[1] == "deep text\nafter" and got[2] == "first\nlast"
    assert got[3].count("\n") == 99_999 and got[3].endswith("paragraph 99999 of a page with very many of them")


def test_wrappers_of_mixed_pages_stay_small():
    draw = random.Random(1)
    names = ["p", "h2", "ul", "div class=note", "blockquote", "section", "table", "figure"]

    def mixed(i, depth=0):
        kids = []
        for k in range(draw.randint(5, 40)):
            name = draw.choice(names)
            body = mixed(i, depth + 1) if depth < 2 and draw.random() < 0.1 else f"text {i} {k}"
            kids.append(f"<{name}>{body}</{name.split()[0]}>")
        return "".join(kids)

    def size(node):
        return 1 + sum(map(size, node[4]))

    whole, sizes = None, []
    for i in range(1000):
        own = html_text.wrap(html_text.parse(f"<html><body><article>{mixed(i)}</article></body></html>"))
        whole = own if whole is None else html_text.merge(whole, own)
        sizes.append(size(whole))
    assert sizes[-1] < 1.5 * sizes[200] + 200 and sizes[-1] < 6000, sizes[::100]
    assert html_text.plan(whole)["path"][-1] == "article"


def test_wrapper_expression():
    parts = [html_text.wrap(html_text.parse(h)) for h in ("<p>a</p><h2>x</h2><p>b</p><h2>y</h2>", "<p>a</p><h2>z</h2><div>only</div>", "<p>a</p><h2>x</h2>")]
    whole = html_text.merge(html_text.merge(parts[0], parts[1]), parts[2])
    assert html_text.expression(html_text.wrap(html_text.parse("<li>a<li>b<li>c"))) == "(<li>#</>)+"
    assert html_text.expression(parts[0]) == "(<p>#</><h2>#</>)+"
    assert "(<div>#</>)?" in html_text.expression(whole)


def test_given_pages(spark, sf):
    """Every page of the table against a plain reading of its article element."""
    import html as entities
    import re

    pages = catalog.table(spark, sf, "pages")
    raw = {r.page_id: r.html or "" for r in pages.collect()}
    for r in catalog.op1_html_text(spark, sf).collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", raw[r.page_id])[1].replace("<br>", " ")
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


def test_round_trip_digests(spark, documents, library, tmp_path):
    """The digest columns of op4_bpe, from the library."""
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in catalog.op4_bpe(spark, str(tmp_path)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        want = (i, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
        assert tuple(got[i]) == want, i


def test_kept_entries_are_bounded_by_bytes():
    kept = bpe.Kept(lambda key: key.encode() * 50, 20_000, 1)
    for i in range(3000):
        assert kept[f"word{i}"] == f"word{i}".encode() * 50
        assert kept.held <= 20_000 and len(kept) + len(kept.old) <= 2 * 20_000 // bpe.ENTRY
    assert len(kept["x" * 1000]) == 50_000 and "x" * 1000 not in kept
