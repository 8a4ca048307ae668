"""Catalog classes of file groups, and titles held against published outputs by their aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import matching as M

#: Endings that mark a part of a title.
PARTS = [
    r"(?i)\s*\[\s*\d{1,3}(?:\s*[-–]\s*\d{1,3})?\s*\]\s*$",
    r"(?i)\s*\(\s*(?:disk|disc)\s*\d+\s*\)\s*(?:author interview)?\s*$",
    r"(?i)\s*[,\-]?\s*(?:part|pt)\.?\s*\d+\s*$",
    r"(?i)\s*\(\s*\d+\s+of\s+\d+\s*\)\s*$",
    r"(?i)\s+\d+\s+of\s+\d+\s*$",
]
#: Endings of single-file books, and words that only name an edition.
CONTAINERS, EDITIONS = ["m4a", "m4b"], r"\b(?:unabridged|graphic audio|dramatized adaptation)\b"


def plain(text: Column) -> Column:
    """Lower-cased runs of letters and digits joined by blanks; null gives the empty text."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def part_base(title: Column) -> Column:
    """The plain title without its part ending, by the first ending that applies; null where none does."""
    cut = lambda p: F.regexp_replace(F.regexp_replace(F.trim(title), p, ""), r"^[ ,\-–]+|[ ,\-–]+$", "")
    return F.coalesce(*[F.when(cut(p) != F.trim(title), plain(cut(p))) for p in PARTS])


def title_aliases(title: Column, series: Column) -> Column:
    """The plain title; without a leading "the"; without its own series in front; without edition words. At least three characters each."""
    name, own = plain(title), plain(series)
    after = F.when((own != "") & F.startswith(name, F.concat(own, F.lit(" "))), F.substring(name, F.length(own) + 2, F.length(name)))
    every = F.array(name, F.regexp_replace(name, "^the ", ""), F.coalesce(after, name), F.trim(F.regexp_replace(name, EDITIONS, "")))
    return F.array_distinct(F.filter(every, lambda a: F.length(a) >= 3))


def runtime_matches(minutes: Column, seconds: Column) -> Column:
    """Within 15 minutes or 8 % of the expected runtime, both positive; null matches nothing."""
    expected = minutes.try_cast("double") * 60
    return F.coalesce((expected > 0) & (seconds > 0) & (F.abs(seconds - expected) <= F.greatest(F.lit(900.0), expected * 0.08)), F.lit(False))


def catalog_classes(members: DataFrame, files: DataFrame) -> DataFrame:
    """(group_key, class) of members (group_key, relative_path) by files (relative_path, error). Unknown paths do not count."""
    suffix = F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1))
    known = members.select("group_key", "relative_path").join(files.select("relative_path", "error"), "relative_path")
    n = known.groupBy("group_key").agg(F.count("*").alias("n"), F.count_if(suffix.isin(CONTAINERS)).alias("whole"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("broken"))
    every = members.select("group_key").distinct().join(n, "group_key", "left").na.fill(0)
    rules = [
        ("needs_attention", F.col("broken") > 0), ("existing_m4b", F.expr("n = 1 and whole = 1")), ("single_conversion", F.col("n") == 1),
        ("multipart_conversion", F.col("whole") == 0), ("mixed_with_m4b", F.col("whole") == 1),
    ]
    return every.select("group_key", M.first_match(rules, "ambiguous").alias("class"))


def represented(books: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """(key, class) of books (key, title, author, series) held against outputs (author, titles, series), by equal aliases.

    represented_title: an output shares an alias, its author contains or is contained, its series does not differ;
    review_author_or_edition: only an alias is shared; missing_candidate: none is; review_identity: the title has no
    alias. An equi-join on the alias, aggregated at once; every output counts, no list of partners is built. Aliases
    inside an output's path are not looked for.
    """
    own = books.select(key, plain(F.col("author")).alias("by_"), plain(F.col("series")).alias("in_"), title_aliases(F.col("title"), F.col("series")).alias("aliases_"))
    theirs = outputs.select(plain(F.col("author")).alias("author_"), plain(F.col("series")).alias("series_"), F.explode(F.array_distinct("titles")).alias("alias_")).distinct()
    person = (F.col("by_") != "") & (F.col("author_") != "") & (F.contains("author_", "by_") | F.contains("by_", "author_"))
    series = (F.col("in_") == "") | (F.col("series_") == "") | (F.col("in_") == F.col("series_"))
    hits = own.select(key, "by_", "in_", F.explode("aliases_").alias("alias_")).join(theirs, "alias_").groupBy(key).agg(F.bool_or(person & series).alias("whole_"))
    rules = [("review_identity", F.size("aliases_") == 0), ("represented_title", F.col("whole_")), ("review_author_or_edition", F.col("whole_").isNotNull())]
    return own.join(hits, key, "left").select(key, M.first_match(rules, "missing_candidate").alias("class"))
