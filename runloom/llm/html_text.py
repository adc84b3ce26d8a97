"""Main text of web pages by wrappers inferred per host.

A page becomes a stream of tokens (open, close, text), in which elements nest. The
streams of a host's pages are aligned one after the other into a union-free regular
expression, the wrapper: at each level the two sequences of elements are aligned by
name; what only one side has becomes an optional group, what follows itself (one
element or a run of up to four) a repeated group, and texts become slots. A slot
knows how many pages fill it, how much of its text is links, and whether its text is
the same everywhere, in which case it is part of the template.

From the wrapper a host's plan is read: the path to the innermost element that holds
all varying, unlinked text outside menus, headers, footers, sidebars, notices, adverts,
forms and comments, or to `article` or `main` where these hold most of it; and the texts
inside it that are template. A page's text are the blocks under that path. A page that
has nothing there (another layout) is its own wrapper.

Class words make an element furniture only if no `article` or `main` lies in it, and
where none lies beside it only if it holds at most half of the text around it; reader
comments inside an article are out whatever their size. Inside `article` and `main` all
other texts are kept, shared ones and those of the article's own header included.

A wrapper's size is bounded by the names of elements that a host uses, not by its
pages: where a level has more than `WIDE` kids, neighbours that only some pages have
become one repeated group of optional ones, in which each name stands once. Elements
deeper than `DEPTH` become siblings at that depth, as in browsers.

Wrappers merge, so each task infers one per host from its pages and only these are
shuffled, in two rounds for hosts that lie in many tasks. A host with a third of all
pages costs what any other costs after that. Pages meet their host's plan in a join.

Defined results: null and empty html give the empty text; a null url belongs to the
host ""; broken markup (open elements, cut tags) is read as browsers do, a `p` ends
at the next block; repeated rows each keep their text; an empty table gives no rows;
columns not named by `keep` are left out; texts of any length and elements of any
depth are read whole; an attribute whose quotation mark is never closed ends with its tag.
"""

from __future__ import annotations

import difflib
import html
import json
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .url_filter import host_of

# fixed values: HTML's own element classes, and words that name page furniture
RAW = ("script", "style", "textarea", "title", "iframe", "noscript", "template", "svg", "object", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split()
)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote ul ol dl dt dd table thead tbody tr td th figure figcaption address".split())
OUT = frozenset("head nav header footer aside form button select option menu dialog fieldset".split())
NEVER_OUT = frozenset("html body main article".split())
#: Elements of OUT that can lie around a whole page.
AROUND = frozenset("header form fieldset".split())
OUT_WORDS = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header "
    "masthead comment comments cookie cookies consent notice alert banner share sharing social related newsletter subscribe popup modal "
    "pagination pager widget login search toolbar replies discussion discussions disqus respond".split()
)
COMMENT_WORDS = frozenset("comment comments replies discussion discussions disqus respond".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TOKEN = regex.compile(
    r"<!--.*?(?:-->|$)|<(" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)"
    r"|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", regex.S | regex.I
)
NAMES = regex.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", regex.I)
LONGEST_RUN = 4
#: Depth from which elements are siblings, and kids of a wrapper's level from which optional neighbours are grouped.
DEPTH, WIDE = 128, 48
#: A text that this many pages share, next to others that vary, is template.
TEMPLATE_PAGES = 8

# An element is [name, kids]; a kid is an element or a text (text, characters in links).
# The name of page furniture begins with "!".


def named(tag: str, attributes: str) -> str:
    """Tag with the letters of its classes, id and role."""
    if not attributes:
        return tag
    words = [w for m in NAMES.finditer(attributes) for w in regex.findall(r"[a-z]+", regex.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[1] or m[2] or m[3] or "").lower())]
    return ".".join([tag, *words])


def furniture(name: str) -> bool:
    """Whether an element of this name is no part of an article."""
    return name.startswith("!")


def tag_of(name: str) -> str:
    return name.lstrip("!").split(".", 1)[0]


def mark(root: list) -> None:
    """Names the furniture of a page."""
    known: dict[int, tuple[int, bool]] = {}  # unlinked characters of an element, and whether article or main lies in it

    def measure(e: list) -> tuple[int, bool]:
        size, below = 0, False
        for k in e[1]:
            if isinstance(k, tuple):
                size += len(k[0]) - k[1]
                continue
            inner, holds = measure(k)
            size += inner
            below |= holds or tag_of(k[0]) in ("article", "main")
        tag = tag_of(e[0])
        if tag in OUT and not (below and tag in AROUND):
            size, below = 0, False
        known[id(e)] = size, below
        return size, below

    def visit(e: list, around: int, article: bool, inside: bool) -> None:
        for k in e[1]:
            if isinstance(k, tuple):
                continue
            size, below = known[id(k)]
            tag, *words = k[0].split(".")
            if tag in OUT and not (inside and tag == "header"):
                out = not (below and tag in AROUND)
            else:
                few = article or 2 * size <= around or (inside and not COMMENT_WORDS.isdisjoint(words))
                out = tag not in NEVER_OUT and not below and few and not OUT_WORDS.isdisjoint(words)
            if out:
                k[0] = "!" + k[0]
            else:
                visit(k, *((size, below, True) if tag in ("article", "main") else (around, article, inside)))

    visit(root, *measure(root), False)


def parse(page: str) -> list:
    """The page as nested elements and texts."""
    root = ["", []]
    stack, here, text, links, in_link = [root], root, [], 0, False
    tags, open_ = [""], Counter()  # of all open elements; the stack holds those that are not too deep

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                here[1].append((joined, min(links, len(joined))))
            text.clear()
        links = 0

    def leave() -> str:
        nonlocal here
        tag = tags.pop()
        open_[tag] -= 1
        if len(tags) < len(stack):
            stack.pop()
        here = stack[-1]
        return tag

    def put(raw: str) -> None:
        nonlocal links
        if raw:
            text.append(raw)
            if in_link:
                links += len(raw)

    last = 0
    for m in TOKEN.finditer(page):
        put(page[last : m.start()])
        last = m.end()
        closing, tag, attributes = m[2] or m[5], m[3] or m[6], m[4] or m[7]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        if closing:
            if open_[tag]:
                while leave() != tag:
                    pass
            continue
        in_link = False
        if tags[-1] == "p" or tag in CLOSED_BY.get(tags[-1], ()):
            leave()
        element = [named(tag, attributes), []]
        stack[-1][1].append(element)
        tags.append(tag)
        open_[tag] += 1
        if len(tags) <= DEPTH:
            stack.append(element)
        here = element
    put(page[last:])
    flush()
    mark(root)
    return root


# A wrapper node is [name, optional, repeated, stats, kids]; a slot has the name "#" and
# the stats [pages, characters, characters in links, text hash or None]; a run has the name "()".


def slot(text: str, links: int) -> list:
    return ["#", 0, 0, [1, len(text), links, zlib.crc32(text.encode())], []]


def wrap(element: list) -> list:
    """One page's element as a wrapper."""
    kids = folded([slot(*k) if isinstance(k, tuple) else wrap(k) for k in element[1]])
    made = [element[0], 0, 0, None, kids]
    if not element[0]:
        once(made)
    return made


def once(node: list) -> None:
    """A text that a page repeats is on one page."""
    if node[3] is not None:
        node[3][0] = 1
    for k in node[4]:
        once(k)


def folded(kids: list[list]) -> list[list]:
    """Runs of up to `LONGEST_RUN` elements that follow themselves become repeated groups."""
    for run in range(1, LONGEST_RUN + 1):
        out, at = [], 0
        while at < len(kids):
            names = [k[0] for k in kids[at : at + run]]
            n = 1
            while len(names) == run and [k[0] for k in kids[at + n * run : at + (n + 1) * run]] == names:
                n += 1
            if n == 1 or (run == 1 and names == ["#"]):
                out.append(kids[at])
                at += 1
                continue
            merged = kids[at : at + run]
            for i in range(1, n):
                merged = [merge(a, b) for a, b in zip(merged, kids[at + i * run : at + (i + 1) * run], strict=True)]
            if run == 1:
                merged[0][2] = 1
                out.append(merged[0])
            else:
                out.append(["()", 0, 1, None, merged])
            at += n * run
        kids = out
    return kids


def merge(a: list, b: list) -> list:
    """Two nodes of one name aligned into one."""
    stats = None
    if a[3] is not None:
        stats = [a[3][0] + b[3][0], a[3][1] + b[3][1], a[3][2] + b[3][2], a[3][3] if a[3][3] == b[3][3] else None]
    return [a[0], a[1] | b[1], a[2] | b[2], stats, aligned(a[4], b[4])]


def aligned(a: list[list], b: list[list]) -> list[list]:
    """Two sequences of nodes; what only one has becomes optional."""
    left, right = [k[0] for k in a], [k[0] for k in b]
    if left == right:
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    out: list[list] = []
    for kind, i, j, k, n in difflib.SequenceMatcher(None, left, right, False).get_opcodes():
        if kind == "equal":
            out += [merge(x, y) for x, y in zip(a[i:j], b[k:n], strict=True)]
        else:
            out += [[x[0], 1, *x[2:]] for x in [*a[i:j], *b[k:n]]]
    return grouped(out) if len(out) > WIDE else out


def grouped(kids: list[list]) -> list[list]:
    """Optional neighbours as one repeated group of optional ones, each name once."""
    out: list[list] = []
    held: dict[str, list] = {}

    def close() -> None:
        if len(held) > 1:
            out.append(["()", 1, 1, None, list(held.values())])
        else:
            out.extend([k[0], 1, 1, *k[3:]] for k in held.values())
        held.clear()

    for k in kids:
        if not k[1]:
            close()
            out.append(k)
            continue
        for own in opened([k]):
            own = [own[0], 1, *own[2:]]
            held[own[0]] = merge(held[own[0]], own) if own[0] in held else own
    close()
    return out


def expression(node: list) -> str:
    """The wrapper as a regular expression over tokens."""
    inner = "".join(expression(k) for k in node[4])
    body = "#" if node[0] == "#" else inner if node[0] in ("()", "") else f"<{node[0].lstrip('!')}>{inner}</>"
    mark = {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[node[1], node[2]]
    return f"({body}){mark}" if mark else body


def mass(node: list) -> float:
    """Varying, unlinked text under a node, without page furniture."""
    if node[0] == "#":
        pages, chars, links, same = node[3]
        return 0.0 if same is not None and pages >= TEMPLATE_PAGES else chars - links
    return 0.0 if furniture(node[0]) else sum(map(mass, node[4]))


def plan(wrapper: list) -> dict:
    """Path to the main element, and the template texts in it with their places."""
    path, nodes = [], [wrapper]
    while not path or tag_of(path[-1]) != "article":
        own: dict[str, list[list]] = {}
        for k in opened(kid for n in nodes for kid in n[4]):
            if k[0] != "#" and tag_of(k[0]) not in LEAVES:
                own.setdefault(k[0], []).append(k)
        whole = sum(map(mass, nodes))
        name, parts = max(own.items(), key=lambda x: sum(map(mass, x[1])), default=("", []))
        most = sum(map(mass, parts))
        main = any(map(holds_article, parts))
        if not most or most < whole and (2 * most < whole or not main or any(tag_of(p) == "main" for p in path)):
            break
        if not main and any(tag_of(p) == "main" for p in path):
            break
        others = [k for n, ks in own.items() if n != name for k in ks]
        if most < whole and any(holds_article(k) and mass(k) for k in others):
            break
        path.append(name)
        nodes = parts
    same: dict[str, int] = {}
    if any(map(mass, nodes)):
        inside = any(tag_of(p) in ("article", "main") for p in path)
        for node in nodes:
            template(node, "", inside, False, same)
    return {"path": path, "same": same}


def opened(kids: Iterable[list]) -> Iterator[list]:
    """Kids, with those of runs in place of the runs."""
    for k in kids:
        if k[0] == "()":
            yield from opened(k[4])
        else:
            yield k


def holds_article(node: list) -> bool:
    return tag_of(node[0]) in ("article", "main") or (not furniture(node[0]) and any(map(holds_article, node[4])))


def template(node: list, place: str, inside: bool, repeated: bool, same: dict[str, int]) -> None:
    """Adds the texts that stand on all pages, by place and hash; what only some pages have is never template.

    The value is how often a page has it there, or -1 for any number. Inside `article`
    and `main` nothing is template.
    """
    if node[1]:
        return
    repeated = repeated or bool(node[2])
    for k in node[4]:
        if k[0] == "#":
            if k[1] or k[3][3] is None or k[3][0] < TEMPLATE_PAGES:
                continue
            if inside:
                continue
            at = f"{place}#{k[3][3]}"
            same[at] = -1 if repeated or same.get(at) == -1 else same.get(at, 0) + 1
        elif k[0] == "()":
            template(k, place, inside, repeated, same)
        elif not furniture(k[0]):
            template(k, f"{place}/{k[0]}", inside or tag_of(k[0]) in ("article", "main"), repeated, same)


def blocks(node: list, same: dict[str, int], place: str = "") -> Iterator[str]:
    """Texts of an element; `same` is counted down."""
    for k in node[1]:
        if isinstance(k, tuple):
            at = f"{place}#{zlib.crc32(k[0].encode())}" if same else ""
            left = same.get(at, 0)
            if left > 0:
                same[at] = left - 1
            if not left:
                yield k[0]
        elif not furniture(k[0]):
            yield from blocks(k, same, f"{place}/{k[0]}" if same else "")


def extract(page: str | None, known: dict | None) -> str:
    """Text of a page under its host's plan, or its own where that leads to nothing."""
    if not page:
        return ""
    root = parse(page)
    for use in (known, None):
        use = use or plan(wrap(root))
        found = [root]
        for name in use["path"]:
            found = [k for e in found for k in e[1] if not isinstance(k, tuple) and k[0] == name]
        same = dict(use["same"])
        out = "\n".join(b for e in found for b in blocks(e, same))
        if out:
            return out
    return ""


#: Hosts whose wrappers a task holds at a time.
HELD_HOSTS = 2_000


def wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """`host`, `wrapper` (JSON), `expression` and `plan` (JSON) of every host."""

    def infer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def done() -> pa.RecordBatch:
            hosts, made = list(held), [json.dumps(w) for w in held.values()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(made, pa.string())], names=["host", "wrapper"])

        for batch in batches:
            for part in slices(batch, 1):
                for host, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if not text:
                        continue
                    own = wrap(parse(text))
                    held[host] = merge(held[host], own) if host in held else own
                    if len(held) > HELD_HOSTS:
                        yield done()
        if held:
            yield done()

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for text in sorted(group["wrapper"]):
            one = json.loads(text)
            whole = one if whole is None else merge(whole, one)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(whole)]})

    def final(group: pd.DataFrame) -> pd.DataFrame:
        out = joined(group)
        whole = json.loads(out["wrapper"][0])
        return out.assign(expression=expression(whole), plan=json.dumps(plan(whole)))

    parts = pages.select(host_of(F.col(url)).alias("host"), F.col(page).alias("html")).mapInArrow(infer, "host string, wrapper string")
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(64)))
    half = parts.groupBy("host", "salt").applyInPandas(joined, "host string, wrapper string")
    return half.groupBy("host").applyInPandas(final, "host string, wrapper string, expression string, plan string")


def main_text(pages: DataFrame, plans: DataFrame, url: str = "url", page: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Kept columns and `text` of every page, by the plans of `wrappers`."""
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(page).alias("html"), host_of(F.col(url)).alias("host"))
    rows = rows.join(plans.select("host", "plan"), "host", "left").drop("host")
    schema = ", ".join(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))) + ", text string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            for part in slices(batch, len(keep)):
                texts = []
                for text, using in zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist(), strict=True):
                    if using is not None and using not in known:
                        if len(known) > HELD_HOSTS:
                            known.clear()
                        known[using] = json.loads(using)
                    texts.append(extract(text, known.get(using)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(texts, pa.string())], names=[*(f"k{i}" for i in range(len(keep))), "text"]
                )

    return rows.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text")
