"""Numbered sets, import outcomes, ledgers, archives and drifted paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import matching as M
from tessera.operators.entities import with_group

#: Fixed values: "3 of 12" anywhere, and "_3_12" at the end of an mp3's name.
EXPLICIT, TRAILING = r"(?i)(?<!\d)(\d{1,3})\s*(?:of|/)\s*(\d{1,3})(?!\d)", r"_(\d{1,3})_(\d{1,3})$"
#: An ASIN in a path, titles and authors that stand for nothing, sound files.
ASIN, NO_TITLE, NO_AUTHOR, AUDIO = r"(?i)(?<![a-z0-9])(b0[a-z0-9]{8})(?![a-z0-9])", ["", "untitled", "unknown title"], ["", "unknown", "unknown author", "no artist"], r"(?i)\.(?:mp3|m4a|m4b|flac|wav|ogg)$"

#: Fixed value: credits that are roles or organizations.
ROLES = r"(?i)graphic\s*audio|narrat(?:ed|or)|read\s+by|publisher|press|audio\s*(?:llc)?|no\s+artist|^artist$"


def numbered_sets(files: DataFrame) -> DataFrame:
    """(group_key, state, missing, unreadable) of files (group_key, relative_path, duration).

    state: unnumbered (a file without "n of m", or a number that means something else), invalid, conflicting_totals,
    duplicates, incomplete or complete. A set is at most 500 parts, so its numbers are sums, not lists. A file counts as
    readable with a duration above 0; missing and unreadable are 0 unless incomplete.
    """
    stem = F.regexp_replace(F.regexp_extract("relative_path", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    n = lambda pattern, k: F.regexp_extract(stem, pattern, k).try_cast("int")
    rows = with_group(files.select("group_key", "relative_path", F.coalesce(F.col("duration") > 0, F.lit(False)).alias("ok")), ["group_key"], size=F.count("*"))
    trailing = (F.col("size") >= 2) & F.lower("relative_path").endswith(".mp3")
    rows = rows.select("group_key", "ok", n(EXPLICIT, 1).alias("a"), n(EXPLICIT, 2).alias("b"), F.when(trailing, n(TRAILING, 1)).alias("c"), F.when(trailing, n(TRAILING, 2)).alias("d"))
    rows = rows.select("group_key", "ok", F.coalesce("a", "c").alias("number"), F.when(F.col("a").isNotNull(), F.col("b")).otherwise(F.col("d")).alias("total"), (F.col("a").isNull() & (F.col("c") > F.col("d"))).alias("volume"))
    parts = rows.groupBy("group_key", "number").agg(
        F.count("*").alias("n"), F.bool_or("ok").alias("ok"), F.min("total").alias("low"), F.max("total").alias("high"), F.coalesce(F.bool_or("volume"), F.lit(False)).alias("volume"),
        F.bool_or((F.col("number") < 1) | (F.col("number") > F.col("total")) | (F.col("total") > 500)).alias("invalid"),
    )
    sets = parts.groupBy("group_key").agg(
        F.count("number").alias("present"), F.bool_or(F.col("number").isNull() | F.col("volume")).alias("plain"), F.bool_or("invalid").alias("invalid"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("n").alias("most"), F.count_if("ok").alias("readable"),
    )
    rules = [
        ("unnumbered", F.col("plain")), ("invalid", F.col("invalid")), ("unnumbered", (F.col("present") == 1) & (F.col("low") < F.col("high"))),
        ("conflicting_totals", F.col("low") < F.col("high")), ("duplicates", F.col("most") > 1), ("incomplete", F.col("readable") < F.col("high")),
    ]
    out = sets.withColumn("state", M.first_match(rules, "complete"))
    short = lambda c: F.when(F.col("state") == "incomplete", c).otherwise(0)
    return out.select("group_key", "state", short(F.col("high") - F.col("present")).alias("missing"), short(F.col("present") - F.col("readable")).alias("unreadable"))


def latin(text: Column) -> Column:
    """Are all letters Latin? Null has none, so it is."""
    return ~F.coalesce(text, F.lit("")).rlike(r"[\p{L}&&[^\p{IsLatin}]]")


def usable(title: Column, authors: Column, series: Column) -> Column:
    """Title and authors that say something: no placeholder, no title or series for an author, no role, digits, brackets or " of " in the first author."""
    key = lambda t: F.trim(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    names = F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.trim(F.coalesce(a, F.lit(""))))
    first = F.coalesce(F.get(names, F.lit(0)), F.lit(""))
    odd = first.rlike(ROLES) | first.rlike(r"(?i)^tmp |\d|[\[\]]| of ") | ((key(series) != "") & (key(series) == key(first)))
    named = (F.size(names) > 0) & F.forall(names, lambda a: ~key(a).isin(NO_AUTHOR))
    return ~F.lower(F.trim(F.coalesce(title, F.lit("")))).isin(NO_TITLE) & named & ~odd & (key(title) != key(first))


def import_outcomes(books: DataFrame, library: DataFrame, key: str, free: float, reserve: float) -> DataFrame:
    """(key, action) of books (key, destination, asin, bytes) held against a library's paths (path), first rule first.

    review_destination_exists: the path is taken, in any case of letters; review_existing_asin: the ASIN stands in some
    path; review_book_folder_has_audio: the folder holds a sound file; review_target_collision: two proposed books have one
    path; defer_disk_budget: all proposed books, when what is free, less them and the largest, is under the reserve.
    Else proposed_copy. All by equi-joins; near titles are a similarity join of their own.
    """
    paths = library.select(F.lower("path").alias("path_")).distinct()
    folder = lambda p: F.lower(F.regexp_extract(p, "^(.*)/[^/]*$", 1))
    mark = lambda name: F.lit(True).alias(name)
    tokens = library.select(F.explode(F.regexp_extract_all(F.lower("path"), F.lit(ASIN), F.lit(1))).alias("token_")).distinct().select("token_", mark("asin_known"))
    folders = library.where(F.col("path").rlike(AUDIO)).select(folder(F.col("path")).alias("folder_")).distinct().select("folder_", mark("folder_used"))
    rows = books.select(key, F.lower("destination").alias("to_"), F.lower("asin").alias("asin_"), "bytes")
    rows = rows.join(paths.select("path_", mark("taken")), F.col("to_") == F.col("path_"), "left").join(tokens, F.col("asin_") == F.col("token_"), "left").join(folders, folder(F.col("to_")) == F.col("folder_"), "left")
    rules = [("review_destination_exists", F.col("taken")), ("review_existing_asin", F.col("asin_known")), ("review_book_folder_has_audio", F.col("folder_used"))]
    rows = rows.select(key, "to_", "bytes", M.first_match(rules, "proposed_copy").alias("action"))
    proposed = F.col("action") == "proposed_copy"
    rows = with_group(rows, ["to_"], claims=F.count_if(proposed))
    rows = rows.withColumn("action", F.when(proposed & (F.col("claims") > 1), "review_target_collision").otherwise(F.col("action")))
    over = rows.where(proposed).agg((F.lit(free) - F.sum("bytes") - F.max("bytes") < reserve).alias("over"))
    return rows.select(key, F.when(proposed & F.coalesce(over.scalar(), F.lit(False)), "defer_disk_budget").otherwise(F.col("action")).alias("action"))


def verify_ledger(plan: DataFrame, ledger: DataFrame, key: str, fields: list[str], place: str) -> DataFrame:
    """(key, outcome) of each planned row: no_entry, several_entries, identity_differs (a field, nulls equal), relocated (place differs) or verified."""
    entries = ledger.groupBy(F.col(key).alias("key_")).agg(F.count("*").alias("n_"), F.min(F.struct(*fields, place)).alias("entry_"))
    both = plan.join(entries, F.col(key) == F.col("key_"), "left")
    same = F.struct(*fields).eqNullSafe(F.struct(*[F.col(f"entry_.{f}") for f in fields]))
    rules = [("no_entry", F.col("n_").isNull()), ("several_entries", F.col("n_") > 1), ("identity_differs", ~same), ("relocated", ~F.col(place).eqNullSafe(F.col(f"entry_.{place}")))]
    return both.select(key, M.first_match(rules, "verified").alias("outcome"))


def path_drift(remote: DataFrame, local: DataFrame) -> DataFrame:
    """(path, state) over both sides' (path, size): same, size_changed, remote_only or local_only. Paths are unique on a side."""
    a, b = remote.select("path", F.struct("size").alias("a_")), local.select("path", F.struct("size").alias("b_"))
    state = F.when(F.col("a_").isNull(), "local_only").when(F.col("b_").isNull(), "remote_only").when(F.col("a_").eqNullSafe(F.col("b_")), "same").otherwise("size_changed")
    return a.join(b, "path", "full").select("path", state.alias("state"))


def archive_members(members: DataFrame, files: DataFrame) -> DataFrame:
    """members (member, size) with loose, the number of files (path, size) of equal base name (in any case) and size, and the first of them."""
    base = lambda p: F.lower(F.regexp_extract(p, r"([^/]*)$", 1))
    loose = files.groupBy(base(F.col("path")).alias("base_"), F.col("size").alias("size_")).agg(F.count("*").alias("n_"), F.min("path").alias("first"))
    both = members.join(loose, (base(F.col("member")) == F.col("base_")) & (F.col("size") == F.col("size_")), "left")
    return both.select("member", "size", F.coalesce("n_", F.lit(0)).alias("loose"), "first")
