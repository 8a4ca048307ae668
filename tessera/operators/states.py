"""The state of books, decisions, claims and runs as tables: every change takes a table and gives the next one.

Keys are columns, so a change is one equi-join or one aggregate. A table is written as a whole or merged by the caller;
that makes each change restartable. Rows that are not named stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import matching as M

#: Decisions that count, states that end a run, what superseded books are told.
DECISIONS, ENDED = ("confirm", "reject", "defer"), ("complete", "failed")
WAITING = "awaiting reevaluation by current discovery pass"
REQUIRED = "title, provider, and provider_id are required"


def _same(left: DataFrame, right: DataFrame, key: Sequence[str]) -> Column:
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in key])


def rediscovery(books: DataFrame) -> DataFrame:
    """All books superseded until they are seen again; those that were superseded before keep their reason. Claims of the run go as a whole."""
    old = F.col("state") == "superseded"
    return books.withColumns({"failure": F.when(old, F.col("failure")).otherwise(WAITING), "state": F.lit("superseded")})


def detected(books: DataFrame, found: DataFrame, key: Sequence[str], reset: Sequence[str]) -> DataFrame:
    """found replaces books of the same key; the reset columns become null, other columns of books stay. New keys are added.

    found has key and state columns, one row a key; null keys are keys.
    """
    new = found.select(*(F.col(c).alias(f"new_{c}") for c in found.columns), F.lit(True).alias("seen"))
    both = books.join(new, reduce(and_, [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in key]), "full")
    kept = lambda c: F.col(c) if c in books.columns else F.lit(None)
    value = {c: F.when(F.col("seen"), F.lit(None)).otherwise(F.col(c)) if c in reset else kept(c) for c in books.columns}
    value |= {c: F.when(F.col("seen"), F.col(f"new_{c}")).otherwise(kept(c)) for c in found.columns}
    return both.select(*(v.alias(c) for c, v in value.items()))


def decided(saved: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """saved (key, decision, note, decided_at, updated_at) after new (key, decision, note, at): the first decided_at stays, the rest is the
    latest; decisions outside DECISIONS change nothing and are in `refused`, null decisions among them."""
    ok = F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False))
    last = new.where(ok).groupBy(key).agg(F.max_by(F.struct("decision", "note", "at"), "at").alias("n"), F.min("at").alias("first_"))
    refused = new.where(~ok).groupBy(key).agg(F.count("*").alias("refused"))
    both = saved.join(last, key, "full").join(refused, key, "full")
    pick = lambda c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c))
    return both.select(key, pick("decision").alias("decision"), pick("note").alias("note"), F.coalesce("decided_at", "first_").alias("decided_at"), F.coalesce("n.at", "updated_at").alias("updated_at"), F.coalesce("refused", F.lit(0)).alias("refused"))


def released(claims: DataFrame, releases: DataFrame, path: Sequence[str], owner: str) -> DataFrame:
    """claims without those that their own owner released; others' releases do nothing."""
    key = [*path, owner]
    return claims.join(releases.select(key).distinct(), key, "left_anti")


def adopted(books: DataFrame) -> DataFrame:
    """books (files, alternates, selected, all lists) with outcome and the lists afterwards.

    A selection must name known files, each once; then it becomes the files and the other known ones, in order of first
    sight, the alternates. No selection (null) leaves the lists. An empty or foreign one is an error and changes nothing.
    """
    known = F.array_distinct(F.concat("files", "alternates"))
    bad = F.col("selected").isNotNull() & ((F.size("selected") == 0) | (F.size(F.array_distinct("selected")) < F.size("selected")) | ~is_subset(F.col("selected"), known))
    moved = ~bad & F.col("selected").isNotNull()
    return books.withColumns({"outcome": F.when(bad, "error").otherwise("complete"), "files": F.when(moved, F.col("selected")).otherwise(F.col("files")), "alternates": F.when(moved, F.array_except(known, F.col("selected"))).otherwise(F.col("alternates"))})


def rebuilt(books: DataFrame) -> DataFrame:
    """books (files, alternates, selected) prepared anew: the selection is the files, the alternates lose it, and the former files join them."""
    rest = F.array_except(F.array_distinct(F.concat("alternates", "files")), F.col("selected"))
    return books.withColumns({"alternates": rest, "files": F.col("selected")})


def registered(known: DataFrame, new: DataFrame, key: Sequence[str], facts: Sequence[str]) -> DataFrame:
    """new with outcome: registered (key unknown), unchanged (all facts as known) or conflict. Null facts equal null ones."""
    own = known.select(*key, *(F.col(f).alias(f"known_{f}") for f in facts), F.lit(True).alias("known_"))
    same = reduce(and_, [F.col(f).eqNullSafe(F.col(f"known_{f}")) for f in facts], F.lit(True))
    return new.join(own, list(key), "left").withColumn("outcome", M.first_match([("registered", F.col("known_").isNull()), ("unchanged", same)], "conflict")).select(*new.columns, "outcome")


def approved(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest approved metadata (title, provider, provider_id) a key, and why a row is refused: any of the three is blank or null."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    told = rows.withColumn("error", F.when(blank("title") | blank("provider") | blank("provider_id"), REQUIRED))
    return told.groupBy(key).agg(F.max_by(F.struct("title", "provider", "provider_id"), F.when(F.col("error").isNull(), F.col(order))).alias("m"), F.count("error").alias("refused")).select(key, "m.title", "m.provider", "m.provider_id", "refused")


def resumable(runs: DataFrame, key: Sequence[str], run: str, status: str) -> DataFrame:
    """(key, run): the newest run of each key that has not ended."""
    return runs.where(~F.col(status).isin(*ENDED)).groupBy(*key).agg(F.max(run).alias(run))


def updated_run(runs: DataFrame, changes: DataFrame, run: str) -> DataFrame:
    """runs (status, finished_at) after changes (run, status, at), one a run: finished_at moves with `complete` alone."""
    new = changes.select(F.col(run), F.col("status").alias("new_"), "at")
    both = runs.join(new, run, "left")
    return both.withColumns({"finished_at": F.when(F.col("new_") == "complete", F.col("at")).otherwise(F.col("finished_at")), "status": F.coalesce("new_", "status")}).drop("new_", "at")


def corrections(wanted: DataFrame, books: DataFrame, key: str, states: Sequence[str]) -> DataFrame:
    """wanted with outcome: missing (no book of the key), state (its state is none of states) or planned."""
    found = books.select(key, F.col("state").alias("state_"))
    return wanted.join(found, key, "left").withColumn("outcome", M.first_match([("missing", F.col("state_").isNull()), ("planned", F.col("state_").isin(*states))], "state")).drop("state_")


def is_subset(part: Column, whole: Column) -> Column:
    """Are all entries of one list in the other? The empty list is in every one."""
    return F.size(F.array_except(part, whole)) == 0


def same_set(a: Column, b: Column) -> Column:
    """Do two lists hold the same entries, each once in both?"""
    return (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))) & (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))


def with_decisions(items: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """items (key, fingerprint) with status (unreviewed where there is no decision) and stale: was the decision made on other evidence?"""
    own = decisions.select(key, F.col("decision").alias("decision_"), F.col("fingerprint").alias("seen_"), F.lit(True).alias("there_"))
    both = items.join(own, key, "left")
    stale = F.coalesce(F.col("there_") & ~F.col("fingerprint").eqNullSafe(F.col("seen_")), F.lit(False))
    return both.withColumns({"status": F.when(F.col("there_"), F.col("decision_")).otherwise("unreviewed"), "stale": stale}).drop("decision_", "seen_", "there_")


def filtered(items: DataFrame, band: str | None = None, decision: str | None = None) -> DataFrame:
    """Reviewed items (band, status) of one band and one status, where these are given."""
    out = items if band is None else items.where(F.col("band") == band)
    return out if decision is None else out.where(F.col("status") == decision)


def gaps(sides: dict[str, tuple[DataFrame, DataFrame]], key: str) -> DataFrame:
    """(gap, key): for each name the distinct keys of its first table that its second lacks."""
    return reduce(DataFrame.unionByName, [a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").select(F.lit(n).alias("gap"), key) for n, (a, b) in sides.items()])


def claimed_outputs(outputs: DataFrame, records: DataFrame, path: str, book: str) -> DataFrame:
    """(path, state, claims, extra): current, untracked or missing paths, how many books claim each, and how many too many do."""
    seen = outputs.select(path).distinct().withColumn("there_", F.lit(True))
    claims = records.where(F.col(path).isNotNull()).groupBy(path).agg(F.countDistinct(book).alias("claims"))
    state = M.first_match([("missing", F.col("there_").isNull()), ("untracked", F.col("claims").isNull())], "current")
    return seen.join(claims, path, "full").select(path, state.alias("state"), F.coalesce("claims", F.lit(0)).alias("claims"), F.greatest(F.coalesce("claims", F.lit(0)) - 1, F.lit(0)).alias("extra"))


def strongest(claims: DataFrame, key: Sequence[str], score: str, place: str) -> DataFrame:
    """The strongest claim a key; of equal scores the first by place."""
    return claims.groupBy(*key).agg(F.max_by(F.struct(*claims.columns), F.struct(score, -F.col(place))).alias("c")).select("c.*")


def near_best(rows: DataFrame, key: Sequence[str], score: str, least: float, within: float) -> DataFrame:
    """Rows of at least the least score that are within so much of their key's best."""
    from tessera.operators.entities import with_group

    return with_group(rows, list(key), best_=F.max(score)).where((F.col(score) >= least) & (F.col(score) >= F.col("best_") - within)).drop("best_")


def batch_status(blocked: Column, approved: Column, exists: Column) -> Column:
    """skipped for blocked classes, needs_metadata without an approval, skipped where the output is there, else ready; null is no."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return M.first_match([("skipped", yes(blocked)), ("needs_metadata", ~yes(approved)), ("skipped", yes(exists))], "ready")


def compact_list(values: Column) -> Column:
    """Trimmed entries in order of first sight, without blanks and nulls; case and spacing do not make an entry new."""
    clean = F.filter(F.transform(values, lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.filter(clean, lambda v, i: F.array_position(F.transform(clean, F.lower), F.lower(v)) == i + 1)


def first_tag(tags: Column, *names: str) -> Column:
    """The first of the named tags that is not blank, trimmed; empty where there is none."""
    return F.coalesce(*(F.nullif(F.trim(F.try_element_at(tags, F.lit(n))), F.lit("")) for n in names), F.lit(""))


def chapter_escaped(text: Column) -> Column:
    """A chapter title for a metadata file: backslash, =, ; and # get a backslash, line feeds become blanks."""
    out = text
    for mark in ("\\", "=", ";", "#"):
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return F.replace(out, F.lit("\n"), F.lit(" "))
