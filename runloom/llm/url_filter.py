"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

A list holds canonical URLs (host and path without scheme, `example.org/es/`)
with a verdict. Entries of tier `rule` are reported and come first; entries of tier
`list` decide where no rule fits. An entry of kind `prefix` fits its host and all subdomains where
the URL's path starts with the entry's path; an entry of kind `exact` fits the
one URL. Both become keys: `p` or `e`, host, path. A page's keys are its host and
every parent domain, each with the path cut to every path length in the list,
plus its exact URL; so one lookup structure serves both kinds.

The Bloom filter is a table of blocks (256 bits in four longs); a key sets one bit
in each long of one block. Its size is bounded by `MAX_BLOCKS` whatever the list's
length, which makes it safe to broadcast: beyond that bound only the share of false
positives grows, and the exact join removes those. Of each tier the longest fitting entry wins
(ties: the smaller text).

Verdicts are looked up once per distinct (host, path) and joined back, so a URL
that a third of the pages share is looked up once and is spread by the skew join.

Defined results: null URLs and URLs without `://` have empty host and path and get
the default verdict unless an entry with empty host and path lists them; repeated
pages each keep their row; an empty list gives the default everywhere; an empty
page table gives no rows. Columns of the pages that `keep` does not name are left
out, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ascii_lower

BITS_PER_KEY = 16
WORDS = 4
#: 2^17 blocks of 36 bytes are under 5 MB.
MAX_BLOCKS = 1 << 17
SEP = "\x1f"


def host_of(url: Column) -> Column:
    """Host part after the first `://`, A-Z lowered; empty if there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def entries(listed: DataFrame) -> DataFrame:
    """Keys of a list with columns `rule`, `verdict`, `kind` (`prefix` or `exact`) and `tier` (`rule` or `list`)."""
    host = ascii_lower(F.substring_index("rule", "/", 1))
    path = F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")
    kind = F.when(F.col("kind") == "exact", "e").otherwise("p")
    return (
        listed.where(F.col("rule").isNotNull())
        .select("tier", "rule", "verdict", F.concat(kind, host, F.lit(SEP), path).alias("key"), kind.alias("k"), F.length(path).alias("path_len"))
        .groupBy("key", "k", "path_len", "tier")
        .agg(F.min(F.struct("rule", "verdict")).alias("r"))
        .select("key", "k", "path_len", "tier", "r.rule", "r.verdict")
    )


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """One bit for each long of the block, from six bits each of a second hash."""
    h = F.xxhash64(key, F.lit(7))
    place = lambda i: F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), place(i)) for i in range(WORDS)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """Blocks that hold at least one key: `block`, `w0` .. `w3`."""
    marked = keys.select(_block(F.col("key"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def blocks_for(n_keys: int) -> int:
    """A power of two that gives each key `BITS_PER_KEY` bits, up to the bound."""
    want = max(1, n_keys * BITS_PER_KEY // (64 * WORDS))
    return min(MAX_BLOCKS, 1 << (want - 1).bit_length())


def judge(
    pages: DataFrame, listed: DataFrame, default: str = "allow", url: str = "url", keep: Sequence[str] = ("page_id",)
) -> DataFrame:
    """Kept columns, `host`, `path`, `rule` (null if none fits) and `verdict`."""
    table = entries(listed)
    shape = table.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("k") == "p", F.col("path_len"))).alias("lens")).first()
    blocks = blocks_for(shape["n"])
    split = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = split.select("host", "path").distinct()

    # host, parent domains: 'a.b.c' -> a.b.c, b.c, c
    parts = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    cuts = F.array(*[F.lit(n) for n in sorted(shape["lens"])]).cast("array<int>")
    fitting = F.filter(cuts, lambda n: n <= F.length("path"))
    keys = F.concat(
        F.flatten(F.transform(parents, lambda d: F.transform(fitting, lambda n: F.concat(F.lit("p"), d, F.lit(SEP), F.substring(F.col("path"), F.lit(1), n))))),
        F.array(F.concat(F.lit("e"), F.col("host"), F.lit(SEP), F.col("path"))),
    )
    asked = urls.select("host", "path", F.explode(keys).alias("key"))
    asked = asked.select("*", _block(F.col("key"), blocks).alias("block"))
    filled = F.broadcast(bloom(table, blocks))
    possible = asked.join(filled, "block")
    for i, m in enumerate(_masks(F.col("key"))):
        possible = possible.where(F.col(f"w{i}").bitwiseAND(m) != 0)
    hits = possible.select("host", "path", "key").join(table.select("key", "tier", "rule", "verdict"), "key")
    longest = F.struct((-F.length("rule")).alias("n"), "rule", "verdict")
    best = lambda tier: F.min(F.when(F.col("tier") == tier, longest)).alias(tier)
    ruled = hits.groupBy("host", "path").agg(best("rule"), best("list"))
    ruled = ruled.select("host", "path", F.col("rule.rule").alias("rule"), F.coalesce("rule.verdict", "list.verdict").alias("verdict"))
    return split.join(ruled, ["host", "path"], "left").select(
        *keep, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
