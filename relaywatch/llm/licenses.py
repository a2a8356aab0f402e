"""License scans: a positional index of the rarest licence words.

The words of a text are the maximal runs of digits, lower-cased ASCII letters
and characters beyond ASCII. A template is a label and its mandatory key phrase.
The index holds, for each template, its key phrase's words of highest IDF with
their positions; document frequencies of all licence words are counted over the
whole corpus first. A file looks up where its rare licence words stand; each
place proposes a template start (place minus posting position), the proposals
of the second rarest word are intersected with those of the first by relative
position, and the whole key phrase is verified there.

Only DataFrame functions are used. The template table is fixed; the only thing
collected is the document frequency of its words (at most ``len(vocabulary())``
rows). Each row is judged by itself: null text is empty text, repeated rows and
null ids give equal results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base labels and phrases, then further labels and key phrases.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
TEMPLATES = (
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "apache license version 2 0"),
    ("boost", "boost software license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("cc-by", "creative commons attribution"),
    ("epl", "eclipse public license"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "gnu lesser general public license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mpl-2.0", "mozilla public license version 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HALF_SCORE = 5.0     # IDF mass of a key phrase that scores one half


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def vocabulary() -> list[str]:
    return sorted({w for _, phrase in (*BASE, *TEMPLATES) for w in phrase.split()})


def idf(docs: DataFrame) -> dict[str, float]:
    """IDF of every licence word over all rows of ``docs``."""
    known = F.array(*[F.lit(w) for w in vocabulary()])
    held = docs.select(F.array_append(F.array_intersect(words(F.col("text")), known), F.lit("")).alias("held"))
    seen = {r["w"]: r["n"] for r in held.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = seen.get("", 0)
    return {w: math.log((1 + total) / (1 + seen.get(w, 0))) + 1 for w in vocabulary()}


def rare_words(phrase: str, weight: dict[str, float]) -> list[tuple[str, int]]:
    """The two words of highest IDF of a key phrase, with their positions."""
    parts = phrase.split()
    return sorted(((w, parts.index(w)) for w in dict.fromkeys(parts)), key=lambda p: (-weight[p[0]], p[1]))[:2]


def _starts(phrase: str, weight: dict[str, float]) -> str:
    """SQL array of the places where ``phrase`` stands, from the rare-word places ``hits``."""
    (first, at), (second, beside) = rare_words(phrase, weight)
    size = len(phrase.split())
    key = "array(" + ", ".join(f"'{w}'" for w in phrase.split()) + ")"
    return (f"filter(transform(filter(hits, i -> get(words, i) = '{first}'), i -> i - {at}), "
            f"s -> s >= 0 and get(words, s + {beside}) = '{second}' and slice(words, s + 1, {size}) = {key})")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    weight = idf(docs)
    anchors = sorted({rare_words(p, weight)[0][0] for _, p in (*BASE, *TEMPLATES)})
    anchor_list = ", ".join(f"'{w}'" for w in anchors)
    every = (*BASE, *TEMPLATES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "words", F.expr(
        f"case when arrays_overlap(words, array({anchor_list})) then "
        f"filter(sequence(0, size(words) - 1), i -> get(words, i) in ({anchor_list})) else cast(array() as array<int>) end").alias("hits"))
    empty = "cast(array() as array<int>)"
    rows = rows.selectExpr("doc_id", "size(words) as n_words", *[
        f"case when size(hits) > 0 then {_starts(p, weight)} else {empty} end as t{k}" for k, (_, p) in enumerate(every)])
    base = "concat(" + ", ".join(f"t{k}" for k in range(len(BASE))) + ")"

    def labels(which) -> str:
        named = ", ".join(f"case when size(t{k}) > 0 then '{every[k][0]}' end" for k in which)
        return f"array_join(array_sort(array_distinct(array_compact(array({named})))), ',')"

    mass = {k: sum(weight[w] for w in p.split()) for k, (_, p) in enumerate(every)}
    scores = ", ".join(f"case when size(t{k}) > 0 then {m / (m + HALF_SCORE)!r}D else 0D end" for k, m in mass.items())
    return rows.selectExpr(
        "doc_id", "cast(n_words as long) as n_words", f"cast(size({base}) as long) as n_base",
        f"cast(array_min({base}) as long) as first_word", f"cast(array_max({base}) as long) as last_word",
        f"{labels(range(len(BASE)))} as base_labels", f"{labels(range(len(every)))} as labels",
        f"greatest({scores}) as score")
