"""Scores of catalog candidates against local hints, and the choice of one with a margin.

Everything is a Column but the sequence ratio of two short keys, which is an Arrow UDF.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.operators import matching as M

#: Words that say nothing about a title's identity.
NOISE = [
    "a", "adaptation", "adventure", "an", "and", "audio", "audiobook", "book", "by", "complete", "credits", "disc", "disk", "dramatized",
    "edition", "end", "full", "light", "litrpg", "novel", "of", "opening", "series", "the", "tmpfiles", "unabridged", "vol", "volume",
]
#: The fields that count when equal candidates compete.
FIELDS = ["cover_url", "description", "isbn", "publisher"]


def _named(text: Column) -> Column:
    """Words in order, without noise."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: ~w.isin(NOISE))


def _key(text: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(_named(text))), " ")


def _variants(title: Column) -> Column:
    """The title, its parts between colons, bars and spaced dashes, and the title without a last parenthesis."""
    title = F.coalesce(title, F.lit(""))
    return F.concat(F.array(title, F.regexp_replace(title, r"\s*\([^)]*\)\s*$", "")), F.split(title, r"\s*[:|]\s*|\s+[-–—]\s+"))


@F.pandas_udf(DoubleType())
def _closest(left: pd.Series, right: pd.Series) -> pd.Series:
    """Per row the best pair of the two lists of keys: 0.65 x Jaccard of their words + 0.35 x sequence ratio; empty keys score 0."""

    def pair(a: str, b: str) -> float:
        x, y = set(a.split()), set(b.split())
        return 0.65 * len(x & y) / len(x | y) + 0.35 * SequenceMatcher(None, a, b).ratio() if x and y else 0.0

    return pd.Series([max((pair(a, b) for a in set(xs) for b in set(ys)), default=0.0) for xs, ys in zip(left, right, strict=True)], dtype="float64")


def title_similarity(a: Column, b: Column) -> Column:
    """0.65 x Jaccard of the word sets + 0.35 x sequence ratio of the sorted words, without noise; 0 where either has none."""
    return _closest(F.array(_key(a)), F.array(_key(b)))


def _people(names: Column) -> Column:
    return F.concat_ws(" ", names)


def scored(pairs: DataFrame) -> DataFrame:
    """pairs of (hint, candidate) structs with score, 0 to 100.

    hint: title, authors, series, isbn, runtime_minutes, narrators; candidate: the same and further fields. Null or empty
    fields neither add nor take points. Titles give 65, authors 25 (or 20 where only the candidate has them and the
    titles are one), an equal ISBN 20, the series in the title 5, narrators 10, and the runtime +10 or -20.
    """
    h, c = (lambda f: F.col(f"hint.{f}")), (lambda f: F.col(f"candidate.{f}"))
    keys = lambda t: F.transform(_variants(t), _key)
    whole = lambda t: F.filter(F.transform(_variants(t), lambda v: F.array_join(_named(v), " ")), lambda v: v != "")
    likeness = lambda f: _closest(F.array(_key(_people(h(f)))), F.array(_key(_people(c(f)))))
    has = lambda side, f: _people(side(f)) != ""
    both = lambda f: has(h, f) & has(c, f)
    rows = pairs.withColumns({"title_": _closest(keys(h("title")), keys(c("title"))), "author_": likeness("authors"), "narrator_": likeness("narrators")})
    same = (F.col("title_") >= 0.95) & F.arrays_overlap(whole(h("title")), whole(c("title")))
    gap = F.abs(h("runtime_minutes") - c("runtime_minutes")) / h("runtime_minutes")
    points = [
        F.bround(F.col("title_") * 65),
        F.when(both("authors"), F.bround(F.col("author_") * 25)).when(~has(h, "authors") & has(c, "authors") & same, 20.0),
        F.when((h("isbn") != "") & (h("isbn") == c("isbn")), 20.0),
        F.when((h("series") != "") & F.contains(F.lower(c("title")), F.lower(h("series"))), 5.0),
        F.when(h("runtime_minutes") > 0, F.when(gap <= 0.01, 10.0).when(gap > 0.05, -20.0)),
        F.when(both("narrators"), F.bround(F.col("narrator_") * 10)),
    ]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in points), F.lit(0.0))
    return rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")).drop("title_", "author_", "narrator_")


def collapsed(pairs: DataFrame, key: str, place: str) -> DataFrame:
    """One candidate of each key's equals (title without a last parenthesis, and authors, as word sets): that with most
    FIELDS filled, the first by place among equals. A partial aggregate, so copies meet before the shuffle."""
    c = lambda f: F.col(f"candidate.{f}")
    filled = sum((F.coalesce(c(f).cast("string") != "", F.lit(False)).cast("int") for f in FIELDS), F.lit(0))
    identity = [_key(F.regexp_replace(c("title"), r"\s*\([^)]*\)\s*$", "")).alias("title_"), _key(_people(c("authors"))).alias("authors_")]
    best = F.max_by(F.struct(*[F.col(n) for n in pairs.columns if n != key]), F.struct(filled, -F.col(place)))
    return pairs.groupBy(key, *identity).agg(best.alias("best_")).select(key, "best_.*")


def chosen(pairs: DataFrame, key: str, place: str, threshold: int = 80, margin: int = 5) -> DataFrame:
    """Each key's best candidate with its score, its lead over the next (null if alone) and whether it wins.

    Ties go to the lower place, which must differ within a key.
    """
    return M.top_with_margin(scored(collapsed(pairs, key, place)), key, "score", place, threshold, margin)
