"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements
and one bit per failed rule, so that policies (sets of rules with a version)
and ablations are bit arithmetic over two columns and never read a text again.

Defined results: null text counts as empty (no words, so `few_words` fails);
null ids and repeated rows stay, one ledger row per input row; an empty table
gives an empty ledger; columns of the input that are not asked for by `keep`
are not carried, so clashing names cannot occur.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A named test over the measurements; true means failed."""

    name: str
    fails: str


#: The place in this list is the rule's bit; add new rules at the end only.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbol_heavy", "2 * n_symbols > n_words AND n_symbols > 0"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("glued_words", "n_words > 0 AND word_chars > 40 * n_words"),
)
#: Policies by version; each names the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbol_heavy"),
    "v2": ("few_words", "repeated_windows", "symbol_heavy", "repeated_lines", "glued_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words inside `window`-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes of their words' hashes. Sorting the
    (hash, place) pairs brings equal windows together; that is done only for
    texts in which a hash occurs twice.
    """

    def covered(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    def places(pairs: Column) -> Column:
        same = lambda e, i: F.coalesce(F.get(pairs, i)["h"] == e["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(pairs, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["p"]))

    def count(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, lambda s: covered(places(s)))
        ).otherwise(0)

    def windows(h: Column) -> Column:
        return F.when(
            F.size(h) >= window,
            F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])),
        ).otherwise(F.array().cast("array<bigint>"))

    return let(let(F.transform(found, lambda w: F.xxhash64(w)), windows), count)


def measure(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns and the measurements of every text."""
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(raw, "\n", -1)
    with_word = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = docs.select(*keep, raw.alias("__text"), words(F.col(text)).alias("__words"), with_word.alias("__lines"))
    as_long = lambda c, name: c.cast("bigint").alias(name)
    return found.select(
        *keep,
        as_long(F.size("__words"), "n_words"),
        as_long(F.length(F.array_join("__words", "")), "word_chars"),
        as_long(F.length(F.regexp_replace("__text", rf"[^{SYMBOLS}]+", "")), "n_symbols"),
        as_long(F.size("__lines"), "n_lines"),
        as_long(F.size("__lines") - F.size(F.array_distinct("__lines")), "n_dup_lines"),
        as_long(repeated_words(F.col("__words")), "n_repeat_words"),
    )


def ledger(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """Kept columns, measurements and `failed_bits`: bit i is set when rule i fails."""
    bits = F.lit(0).cast("bigint")
    for at, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << at)).otherwise(F.lit(0)).cast("bigint"))
    return measure(docs, text, keep).withColumn("failed_bits", bits)


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    """Bits of the named rules."""
    at = {rule.name: i for i, rule in enumerate(rules)}
    return sum(1 << at[name] for name in names)


def passes(version: str, rules: Sequence[Rule] = RULES) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[version], rules)).cast("bigint")) == 0


def ablation(entries: DataFrame, version: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of a policy: documents failing it, and those that only it rejects.

    Documents are first counted per bit pattern (at most 2^rules rows, combined
    map-side), so the rest works on a table whose size does not depend on them.
    """
    own = mask(POLICIES[version], rules)
    patterns = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(own).cast("bigint")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("bigint").alias("bit")) for i, r in enumerate(rules) if own >> i & 1
    ]))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (
        patterns.select("bits", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum("n").alias("n_docs"),
        )
        .withColumn("policy", F.lit(version))
    )


def apply_policy(docs: DataFrame, version: str = "v2", text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their own columns."""
    own = [c for c in docs.columns]
    packed = docs.select(F.struct(*own).alias("__row"), F.col(text).alias("__t"))
    kept = ledger(packed, "__t", ("__row",)).where(passes(version))
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in own])
