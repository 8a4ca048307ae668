"""Checks of published outputs, sources and books before work: the first reason that fails, or codes of all issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import imports as I
from tessera.operators import matching as M
from tessera.operators.paths import folders
from tessera.sources.media import directory, last_part, suffix

#: Titles that are likely wrong, words of libraries, and the largest gap of durations in seconds and as a share.
RISKY = ["end credits", "opening credits", "a litrpg adventure", "audiobook full", "001", "20"]
LIBRARY_WORDS = ["audio", "audiobook", "audiobooks", "book", "books", "collection", "complete", "library", "series"]
SECONDS, SHARE = 5.0, 0.005


def same_length(expected: Column, found: Column) -> Column:
    """Within SECONDS or SHARE of the expected length; null or no expected length is not."""
    return F.coalesce((expected > 0) & (F.abs(found - expected) <= F.greatest(F.lit(SECONDS), expected * SHARE)), F.lit(False))


def length_gap(a: Column, b: Column) -> Column:
    """A struct: do two lengths agree (both positive, within SECONDS or SHARE of the longer), by how much they differ, and as a share of the longer or of a second."""
    a, b = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    gap, longer = F.abs(a - b), F.greatest(a, b)
    return F.struct(((a > 0) & (b > 0) & (gap <= F.greatest(F.lit(SECONDS), longer * SHARE))).alias("agree"), gap.alias("gap"), (gap / F.greatest(longer, F.lit(1.0))).alias("share"))


def readable_aac(codec: Column, duration: Column) -> Column:
    return F.coalesce((codec == "aac") & (duration > 0), F.lit(False))


def _held(key: Column, other: Column) -> Column:
    """Is one key the other's whole words, either way?"""
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (key != "") & (other != "") & (F.contains(spaced(other), spaced(key)) | F.contains(spaced(key), spaced(other)))


def output_problem(whole_words: bool = True) -> Column:
    """Why an output is not the one that is wanted; null where it is. The first failing check counts.

    Columns: codec, duration, chapters, titles, authors (keys of its tags, lists), and want_duration, want_chapters,
    want_title, want_authors (keys). With whole_words an author may be part of the other's name; else the first wanted
    author must be among the tags.
    """
    some = F.exists("want_authors", lambda w: F.exists("authors", lambda a: _held(w, a)))
    first = F.coalesce(F.get("want_authors", F.lit(0)), F.lit(""))
    author = some if whole_words else (first != "") & F.array_contains("authors", first)
    yes = lambda c: F.coalesce(c, F.lit(False))
    title = (F.coalesce("want_title", F.lit("")) != "") & F.array_contains("titles", F.coalesce("want_title", F.lit("")))
    rules = [
        ("not readable AAC audio", ~readable_aac(F.col("codec"), F.col("duration"))), ("duration differs", ~same_length(F.col("want_duration"), F.col("duration"))),
        ("chapter count differs", ~F.col("chapters").eqNullSafe(F.col("want_chapters"))), ("embedded title differs", ~yes(title)), ("embedded author differs", ~yes(author)),
    ]
    return F.nullif(M.first_match(rules, ""), F.lit(""))


def canonical_source() -> Column:
    """Is a book's only file its published output: an m4b at the planned place, whose tags hold title, first author and, if there is one, series?"""
    first = F.coalesce(F.get("want_authors", F.lit(0)), F.lit(""))
    place = (F.size("files") == 1) & (suffix(F.get("files", F.lit(0))) == "m4b") & (F.get("files", F.lit(0)) == F.col("planned"))
    names = F.array_contains("titles", F.col("want_title")) & (F.col("want_title") != "") & F.array_contains("authors", first) & (first != "")
    series = F.coalesce("want_series", F.lit(""))
    return F.coalesce(place & names & ((series == "") | (series == F.coalesce("grouping", F.lit("")))), F.lit(False))


def eligible(state: Column, title: Column, authors: Column, series: Column) -> Column:
    """Books to convert: with matched metadata, or with local metadata that is usable."""
    return F.coalesce((state == "metadata_matched") | ((state == "local_metadata") & I.usable(title, authors, series)), F.lit(False))


def blocked(state: Column, classification: Column, metadata: Column, failure: Column) -> Column:
    """Quarantined books with metadata that were not quarantined by their files, nor for a claimed output."""
    claimed = F.startswith(F.coalesce(failure, F.lit("")), F.lit("output path is already claimed"))
    return F.coalesce((state == "quarantined") & (classification != "quarantine") & metadata.isNotNull() & ~claimed, F.lit(False))


def rechecks(books: DataFrame) -> DataFrame:
    """books (state, title, issues: a list) that are complete and have conflicts, with severity: high for several or a risky title, else review."""
    found = books.withColumn("conflicts", F.filter("issues", lambda i: F.contains(i, F.lit("conflict")))).where((F.col("state") == "complete") & (F.size("conflicts") > 0))
    risky = F.lower(F.coalesce("title", F.lit(""))).isin(RISKY)
    return found.withColumn("severity", F.when((F.size("conflicts") > 1) | risky, "high").otherwise("review"))


def output_issues() -> Column:
    """The issue codes of an output, sorted and joined by commas.

    Columns: error, codec, claims (books that name it), author_folder, title_folder (do the folders fit?), author_tags, title_tags
    (lists), author_tag, title_tag (does one fit?), series_fits (null where there is no series).
    """
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return M.issue_codes([
        ("unreadable_output", F.coalesce("error", F.lit("")) != ""), ("unexpected_output_codec", ~F.col("codec").eqNullSafe(F.lit("aac"))), ("multiple_current_book_claims", F.col("claims") > 1),
        ("output_author_folder_mismatch", no("author_folder")), ("output_title_folder_mismatch", no("title_folder")), ("missing_output_author_tag", empty("author_tags")), ("output_author_tag_mismatch", ~empty("author_tags") & no("author_tag")),
        ("missing_output_title_tag", empty("title_tags")), ("output_title_tag_mismatch", ~empty("title_tags") & no("title_tag")), ("output_series_mismatch", F.col("series_fits") == False),  # noqa: E712
    ])


def source_issues() -> Column:
    """The issue codes of a book's sources. Columns: metadata (null: none), author and title (null or a placeholder: missing), absent and
    broken (files that are not there, or not readable), author_status and title_status (aligned, conflict or unverified)."""
    has = F.col("metadata").isNotNull()
    missing = lambda c, words: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin(words)
    status = [(f"source_{n}_{s}", F.col(f"{n}_status") == s) for n in ("author", "title") for s in ("conflict", "unverified")]
    return M.issue_codes([
        ("missing_canonical_metadata", ~has), ("missing_canonical_author", has & missing("author", I.NO_AUTHOR)), ("missing_canonical_title", has & missing("title", I.NO_TITLE)),
        ("missing_source_file", F.col("absent") > 0), ("source_probe_problem", F.col("broken") > 0), *status,
    ])


def published(paths: DataFrame) -> DataFrame:
    """(path, author, series, title) of published outputs: m4b files that lie in no folder that starts with _; the first folder is the author, the second of
    three the series, and the title stands behind the first " - " of the name."""
    path = F.col("path")
    rows = paths.where((suffix(path) == "m4b") & ~F.exists(folders(path), lambda p: F.startswith(p, F.lit("_"))))
    stem = F.regexp_replace(last_part(path), r"\.[^.]*$", "")
    return rows.select("path", F.get(F.split(path, "/"), F.lit(0)).alias("author"), F.when(F.size(folders(path)) == 3, F.get(folders(path), F.lit(1))).alias("series"), F.regexp_replace(stem, "^.*? - ", "").alias("title"))


def empty_folders(folders_: DataFrame, files: DataFrame) -> DataFrame:
    """(path, depth, author) of folders that hold neither files nor folders and are not internal (no part starts with _ or a dot), deepest first."""
    inner = folders_.select(directory(F.col("path")).alias("path")).unionByName(files.select(directory(F.col("path")).alias("path"))).distinct()
    own = folders_.where(~F.col("path").rlike(r"(?:^|/)[_.]")).join(inner, "path", "left_anti")
    parts = F.split("path", "/")
    return own.select("path", F.size(parts).alias("depth"), F.get(parts, F.lit(0)).alias("author")).orderBy(F.desc("depth"), "path")


def archive_id(path: Column) -> Column:
    return F.concat(F.lit("archive:"), F.left(F.sha2(path, 256), F.lit(24)))


def destination(path: Column, identifier: Column) -> Column:
    """An output's path with an id behind the name of its folder."""
    return F.concat(directory(path), F.lit(" ["), identifier, F.lit("]/"), last_part(path))


def inside(path: Column, root: Column) -> Column:
    """Does a normalized path lie below a root, without a part that leads out?"""
    return F.startswith(path, F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))) & ~path.rlike(r"(?:^|/)\.\.(?:/|$)")


def name_like(text: Column) -> Column:
    """Two to five words of letters, a capital, no library word, and no "the" in front."""
    words = F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))
    plain = F.transform(words, F.lower)
    return F.size(words).between(2, 5) & ~F.arrays_overlap(plain, F.array(*map(F.lit, LIBRARY_WORDS))) & ~F.startswith(F.lower(text), F.lit("the ")) & text.rlike(r"\p{Lu}")


def path_supports(author: Column, path_keys: Column) -> Column:
    """Does one of an author's contributors stand in a path part as whole words? path_keys: the parts' plain keys."""
    names = F.filter(F.transform(F.split(author, r"(?i)\s+(?:and|&)\s+|[,;]"), lambda n: F.trim(F.regexp_replace(F.lower(n), r"[^\p{L}\p{N}]+", " "))), lambda n: n != "")
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return F.exists(names, lambda n: F.exists(path_keys, lambda p: F.contains(spaced(p), spaced(n))))


def title_in_path(title: Column, path: Column) -> Column:
    """Is a title's key that of the file's name or folder, or a part of either of at least five characters?"""
    key = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    own = key(title)
    parts = [key(F.regexp_replace(last_part(path), r"\.[^.]*$", "")), key(last_part(directory(path)))]
    return (own != "") & ((own == parts[0]) | (own == parts[1]) | ((F.length(own) >= 5) & (F.contains(parts[0], own) | F.contains(parts[1], own))))


def similar_titles(books: DataFrame, outputs: DataFrame, key: str, least: float = 0.86, size: int = 12) -> DataFrame:
    """(key, path) of books (key, author, title) and outputs (path, author, title) by one author whose compact titles, both of `size`
    characters or more, are equal or alike by the longest matching blocks. Authors meet by an equi-join; lengths that cannot reach the ratio are cut."""
    side = lambda f, n: f.select(n, T.person_key("author").alias("by"), T.compact_key("title").alias(f"{n}_title")).where(f"by <> '' and length({n}_title) >= {size}")
    pairs = side(books, key).join(side(outputs, "path"), "by")
    a, b = F.length(f"{key}_title"), F.length("path_title")
    pairs = pairs.where(2 * F.least(a, b) >= least * (a + b))
    return pairs.where(T.sequence_ratio(f"{key}_title", "path_title") >= least).select(key, "path")
