"""Licence scan with a positional index of rare licence words.

The words of all templates are counted in the whole corpus (documents that hold
them). A template is indexed under its rarest words only, the ones of highest inverse
document frequency, each with its positions in the template. A file looks up the
places of its words in this index; each place and posting give the place at which
the template would begin, and where enough of a template's postings agree on one
beginning, it is a candidate. A candidate counts if the template's mandatory key
phrases stand, word by word, inside the span that the template takes up there.

The index follows from the templates, so its size is theirs, whatever the corpus.
Everything is worked out row by row from the words of one text: nothing is shuffled
but the counts of the templates' words.

Defined results: null texts have no words; words of any length and texts of any
length are taken whole; rows that repeat or share an id are judged one by one and
ties of templates all keep their labels; an empty table gives no rows; an empty list
of templates leaves the base labels; other columns are handed on by `scan`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ascii_lower, let, own_name

#: What parts words once A-Z are in lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels (fixed values).
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


class Template(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]


#: Notices of common licences and the phrases without which they would be another one.
TEMPLATES = (
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license", "version 3")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template(
        "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions"
        " are met", ("redistribution and use in source and binary forms", "with or without modification"),
    ),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template(
        "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "with or without fee"),
    ),
    Template("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ("lesser general public license", "version 3")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted free of charge",),
    ),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)
#: Rarest words under which a template is indexed, and how many hundredths of their postings must agree on a beginning.
RARE, AGREE = 4, 75


class Entry(NamedTuple):
    """A template as the index has it: its postings, how many must agree, and the weight of each of its words."""

    template: Template
    postings: list[tuple[str, int]]
    need: int
    weights: list[int]


def tokens(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def holders(docs: DataFrame, templates: Sequence[Template], text: str = "text") -> tuple[dict[str, int], int]:
    """How many documents hold each template word, and how many there are. Both are as small as the list of templates."""
    known = sorted({w for t in templates for w in t.text.split()})
    held = F.array_intersect(tokens(F.col(text)), F.lit(known).cast("array<string>"))
    # an empty word stands for the document itself
    counts = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}
    return {w: found.get(w, 0) for w in known}, found.get("", 0)


def index(templates: Sequence[Template], held: dict[str, int], n_docs: int, rare: int = RARE, agree: int = AGREE) -> list[Entry]:
    """Postings of each template's rarest words (ties: by the word), and the weights of all its words in thousandths."""
    entries = []
    for one in templates:
        words = one.text.split()
        kept = set(sorted(set(words), key=lambda w: (held[w], w))[:rare])
        postings = [(w, p) for p, w in enumerate(words) if w in kept]
        weights = [round(1000 * (1 + math.log((n_docs + 1) / (held[w] + 1)))) for w in words]
        entries.append(Entry(one, postings, -(-agree * len(postings) // 100), weights))
    return entries


def at(words: Column, place: Column) -> Column:
    """The word at a place counted from 0, null outside."""
    return F.get(words, place)


def stands(words: Column, place: Column, phrase: str) -> Column:
    """Whether the words of a phrase stand from a place on."""
    here = F.lit(True)
    for n, word in enumerate(phrase.split()):
        here = here & F.coalesce(at(words, place + n) == word, F.lit(False))
    return here


def base_places(words: Column, places: Column) -> list[tuple[str, Column]]:
    """Label and beginnings, in order, of every base phrase."""

    def of(phrase: str) -> Column:
        return F.filter(places, lambda p: stands(words, p, phrase))

    return [(label, of(phrase)) for phrase, label in PHRASES]


def matches(words: Column, places: Column, entries: Sequence[Entry]) -> Column:
    """Candidates that verify, as structs of the label and the share of the template's weight that is in place."""
    if not entries:
        return F.array().cast("array<struct<label:string,share:double>>")
    postings: dict[str, list] = {}
    for n, entry in enumerate(entries):
        for word, p in entry.postings:
            postings.setdefault(word, []).append((n, p, entry.need))
    listed = F.create_map(*[
        F.lit(x) if isinstance(x, str) else F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(y, ("t", "p", "need"), strict=True)]) for y in x])
        for pair in sorted(postings.items()) for x in pair
    ])
    known = F.create_map(*[
        x for n, e in enumerate(entries)
        for x in (F.lit(n), F.struct(
            F.lit(e.template.label).alias("label"), F.lit(e.template.text.split()).cast("array<string>").alias("words"),
            F.lit(e.weights).cast("array<int>").alias("weights"), F.lit(list(e.template.keys)).cast("array<string>").alias("keys"),
        ))
    ])

    # where each posting of a looked-up word would have its template begin
    hits = F.flatten(F.transform(
        F.filter(places, lambda p: at(words, p).isin(*postings)),
        lambda p: F.transform(listed[at(words, p)], lambda x: F.struct(x["t"].alias("t"), (p - x["p"]).alias("begin"), x["need"].alias("need"))),
    ))

    def agreed(sorted_hits: Column) -> Column:
        """Beginnings on which enough postings agree: equal entries stand together, so the last one needed is looked at."""
        one = lambda i: sorted_hits[i]
        enough = lambda i: F.coalesce(F.get(sorted_hits, i + one(i)["need"] - 1) == one(i), F.lit(False))
        return F.array_distinct(F.transform(F.filter(F.sequence(F.lit(0), F.size(sorted_hits) - 1), enough), one))

    def verified(hit: Column) -> Column:
        def judge(template: Column) -> Column:
            first = F.greatest(hit["begin"], F.lit(0))
            n = F.greatest(hit["begin"] + F.size(template["words"]) - first, F.lit(0))
            span = F.concat(F.lit(" "), F.array_join(F.slice(words, first + 1, n), " "), F.lit(" "))
            kept = F.forall(template["keys"], lambda k: F.contains(span, F.concat(F.lit(" "), k, F.lit(" "))))
            placed = F.zip_with(
                F.sequence(F.lit(0), F.size(template["words"]) - 1), template["weights"],
                lambda p, w: F.when(F.get(words, hit["begin"] + p) == F.get(template["words"], p), w).otherwise(0),
            )
            add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
            share = F.round(add(placed) / add(template["weights"]), 6)
            return F.when(kept, F.struct(template["label"].alias("label"), share.alias("share")))

        return let(known[hit["t"]], judge)

    found = let(F.array_sort(hits), lambda h: F.when(F.size(h) > 0, F.transform(agreed(h), verified)))
    return F.filter(F.coalesce(found, F.array()), lambda x: x.isNotNull())


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text: str = "text", rare: int = RARE, agree: int = AGREE) -> DataFrame:
    """The columns of `docs` and `license`, a struct (`_license` where `docs` has a `license`).

    Its fields: `n_words`; `n_base`, `first_word`, `last_word` and `base_labels` of the
    base phrases; `matches`, the templates found with their shares; `labels` of both;
    and `score`: the best share, half at least where a base phrase stands, else 0.
    """
    entries = index(templates, *holders(docs, templates, text), rare, agree)
    wanted = sorted({w for e in entries for w, _ in e.postings} | {phrase.split()[0] for phrase, _ in PHRASES})

    def judged(words: Column) -> Column:
        places = F.when(
            F.arrays_overlap(words, F.lit(wanted).cast("array<string>")),
            F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda p: at(words, p).isin(*wanted)),
        )
        return let(places, lambda p: F.struct(F.size(words).cast("bigint").alias("n_words"), *results(words, p)))

    def results(words: Column, places: Column) -> list[Column]:
        based = base_places(words, places)
        labels = F.array_compact(F.array(*[F.when(F.size(p) > 0, label) for label, p in sorted(based, key=lambda x: x[0])]))
        everything = F.array_sort(F.flatten(F.array(*[p for _, p in based])))
        body = lambda b, l, m: F.struct(  # noqa: E731, E741
            F.size(b).cast("bigint").alias("n_base"), F.get(b, F.lit(0)).cast("bigint").alias("first_word"),
            F.get(b, F.size(b) - 1).cast("bigint").alias("last_word"), F.array_join(l, ",").alias("base_labels"), m.alias("matches"),
            F.array_join(F.array_sort(F.array_distinct(F.concat(l, m["label"]))), ",").alias("labels"),
            F.greatest(F.coalesce(F.array_max(m["share"]), F.lit(0.0)), F.when(F.size(b) > 0, 0.5).otherwise(0.0)).alias("score"),
        )
        found = F.when(
            places.isNotNull(), let(everything, lambda b: let(labels, lambda l: let(matches(words, places, entries), lambda m: body(b, l, m))))
        )
        none = F.array().cast("array<struct<label:string,share:double>>")
        other = F.struct(
            F.lit(0).cast("bigint").alias("n_base"), F.lit(None).cast("bigint").alias("first_word"), F.lit(None).cast("bigint").alias("last_word"),
            F.lit("").alias("base_labels"), none.alias("matches"), F.lit("").alias("labels"), F.lit(0.0).alias("score"),
        )
        return [F.coalesce(found, other).alias("found")]

    into = own_name(docs, "license")
    held = docs.withColumn(into, let(tokens(F.col(text)), judged))
    flat = [F.col(f"{into}.n_words").alias("n_words"), *[F.col(f"{into}.found.{c}").alias(c) for c in FIELDS]]
    return held.withColumn(into, F.struct(*flat))


FIELDS = ("n_base", "first_word", "last_word", "base_labels", "matches", "labels", "score")
