"""Which files of a group are the book: the choice among its representations.

A representation is the readable files below one root folder. What paths say is worked out once and stored, as columns. Files are
aggregated by root and by kind, and these sums meet the files that may be whole books by an equi-join on bands of the durations'
logarithms: other sums as they are, a file's own sums, less the file itself, by their half. So neither files nor representations
are paired with each other; windows see one row for each representation.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import imports as I
from tessera.operators import matching as M
from tessera.operators import paths as P
from tessera.operators.shared import stored

NEAR, NEARER = 0.01, 0.005
_WIDTH = -math.log(1 - NEAR)
#: Window frames need whole numbers: logarithms in trillionths, and how far they may be apart.
_SCALE = 1e12
_STEPS = math.ceil(_WIDTH * _SCALE) + 1
#: Bands are so wide that a sum, with all that is near it, seldom lies in two; the reach leaves room for rounding.
_BAND, _REACH = 8 * _WIDTH, _WIDTH + 1e-9
#: Each rule's outcome and confidence. equivalent sums are a case of corroborated ones and need no rule.
OUTCOMES = {
    "identity_conflict": ("quarantine", 0.2), "unreadable": ("quarantine", 0.0), "original_whole": ("complete_m4b", 0.95), "disc_tree_over_target": ("combine_components", 0.92),
    "numbered_originals": ("combine_components", 0.95), "one_target": (None, 0.98), "several_targets": (None, 0.9), "sequence_conflict": ("quarantine", 0.1),
    "disc_tree": ("combine_components", 0.9), "partial_conversion": ("combine_components", 0.9), "corroborated": (None, 0.93), "like_containers": ("complete_m4b", 0.92),
    "only_file": (None, 0.9), "components_over_other_edition": ("combine_components", 0.76), "ordered_mp3": ("combine_components", 0.86),
    "containers": ("combine_components", 0.8), "unexplained": ("quarantine", 0.35),
}


def described(files: DataFrame) -> DataFrame:
    """files (group_key, relative_path, size, duration; format_name, codec, chapters and position if there are) with what the rules need."""
    has = lambda c, kind: F.col(c).cast(kind) if c in files.columns else F.lit(None).cast(kind)
    path, duration = F.col("relative_path"), F.col("duration")
    rows = files.select(
        "group_key", "relative_path", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"), F.when(F.coalesce(F.col("duration") > 0, F.lit(False)), F.col("duration").cast("double")).alias("duration"),
        has("format_name", "string").alias("format_name"), has("codec", "string").alias("codec"), F.coalesce(has("chapters", "int"), F.lit(0)).alias("chapters"),
        F.col("position") if "position" in files.columns else F.lit(None).cast("long").alias("position"),
    )
    rows = rows.select("group_key", "relative_path", "size", "duration", "chapters", "position", F.lower("relative_path").alias("order_"), P.is_container(path, F.col("format_name"), F.col("codec")).alias("container"), (P.suffix(path) == "mp3").alias("mp3"))
    stem = P.stem(path)
    number = F.regexp_extract(P.last_part(path), r"^(\d+)[ ._-]", 1).try_cast("int")
    return rows.withColumns({
        "valid": duration.isNotNull(), "root": P.representation_root(path, duration), "disc": P.disc_parent(path, duration), "legacy": P.legacy(path),
        "under_way": P.under_way(path), "explicit": P.explicit_whole(path), "number": number, "segment": F.lower(P.last_part(P.directory(path))), "marked": F.coalesce(stem.rlike(I.EXPLICIT) | stem.rlike(I.TRAILING), F.lit(False)), "disc_root": P.directory(P.directory(path)),
    }).withColumn("target", F.col("valid") & (F.col("container") | F.col("explicit") | (F.col("mp3") & (duration >= P.BOOK_SECONDS))))


def _roots(valid: DataFrame) -> DataFrame:
    whole = F.count_if("container") == F.count("*")
    return valid.groupBy("group_key", "root").agg(
        F.count("*").alias("n"), F.sum("duration").alias("total"), F.sum("size").alias("bytes"), whole.alias("containers"),
    )


def matched_targets(valid: DataFrame) -> DataFrame:
    """(group_key, relative_path, duration, size, legacy, container, copies, n): the files that may be whole and whose duration a set of two or more
    others adds up to; copies is how many files are alike in all of these, n the least size of such a set. Sets: the others below one root, the
    other mp3 files, the other containers."""
    roots = valid.groupBy("group_key", "root").agg(F.count("*").alias("n"), F.sum("duration").alias("total")).select("group_key", F.concat(F.lit("/"), "root").alias("set_"), "n", "total")
    kind = lambda c: valid.where(c).groupBy("group_key").agg(F.lit(c).alias("set_"), F.count("*").alias("n"), F.sum("duration").alias("total"))
    sets = reduce(DataFrame.unionByName, [roots, kind("mp3"), kind("container")]).where("n >= 2")
    key = ["group_key", "relative_path", "duration", "size", "legacy", "container"]
    targets = valid.where("target").select(*key, "mp3", F.concat(F.lit("/"), "root").alias("root_"), F.floor(F.log("duration") / _BAND).alias("band_"))
    # a file is close to the rest of its own set only if it is closer still to half of the set
    ways = F.array(F.struct(F.lit(False).alias("own"), F.col("total").alias("near")), F.struct(F.lit(True).alias("own"), (F.col("total") / 2).alias("near")))
    reach = lambda sign: F.floor((F.log("way.near") + F.lit(sign * _REACH)) / _BAND)
    sets = sets.withColumn("way", F.explode(ways)).where("n >= 3 or not way.own").withColumn("band_", F.explode(F.array_distinct(F.array(reach(-1), reach(1)))))
    member = (F.col("set_") == F.col("root_")) | ((F.col("set_") == "mp3") & F.col("mp3")) | ((F.col("set_") == "container") & F.col("container"))
    rest = F.when(F.col("way.own"), F.col("total") - F.col("duration")).otherwise(F.col("total"))
    found = targets.join(sets, ["group_key", "band_"]).where((F.col("way.own") == member) & P.close(F.col("duration"), rest))
    alike = found.groupBy(*key, "set_").agg(F.count("*").alias("copies"), F.min(F.col("n") - F.col("way.own").cast("int")).alias("n"))
    return alike.groupBy(key).agg(F.max("copies").alias("copies"), F.min("n").alias("n"))


def disc_trees(valid: DataFrame) -> DataFrame:
    """(group_key, disc_tree, disc_total): the longest tree of two or more discs, unless the second is not as long as it."""
    trees = valid.where("disc").groupBy("group_key", "disc_root").agg(F.sum("duration").alias("total"), F.sum("size").alias("bytes"), (F.min("segment") < F.max("segment")).alias("several")).where("several")
    order = Window.partitionBy("group_key").orderBy(F.desc("total"), F.desc("bytes"), "disc_root")
    top = trees.withColumn("rank_", F.row_number().over(order)).where("rank_ <= 2").withColumn("next_", F.lead("total").over(order)).where("rank_ = 1")
    return top.where(F.col("next_").isNull() | P.close(F.col("total"), F.col("next_"))).select("group_key", F.col("disc_root").alias("disc_tree"), F.col("total").alias("disc_total"))


def corroborated(valid: DataFrame) -> DataFrame:
    """(group_key, best_root, best_n, best_whole): of the representations within NEAR of each other around the longest such cluster,
    if that reaches 98 % of the longest representation, the one of containers alone, then the largest, then the longest."""
    roots = _roots(valid).withColumn("log_", F.round(F.log("total") * _SCALE).cast("long"))
    near, every = Window.partitionBy("group_key").orderBy("log_").rangeBetween(-_STEPS, _STEPS), Window.partitionBy("group_key")
    seen = roots.select("*", F.count("*").over(near).alias("like"), F.max("total").over(near).alias("most"), F.max("total").over(every).alias("top"))
    centre = F.max(F.when(F.expr("like >= 2 and most >= 0.98 * top"), F.struct("most", (-F.col("log_")).alias("low")))).over(every)
    cluster = seen.withColumn("centre", -centre["low"]).where(F.abs(F.col("log_") - F.col("centre")) <= _STEPS)
    best = F.max_by(F.struct("root", "n", "containers"), F.struct("containers", "bytes", "total", "root")).alias("best")
    return cluster.groupBy("group_key").agg(best).select("group_key", F.col("best.root").alias("best_root"), F.col("best.n").alias("best_n"), F.col("best.containers").alias("best_whole"))


def _summary(rows: DataFrame) -> DataFrame:
    """One row a group of sums over its files."""
    v, original, explicit = F.col("valid"), F.col("valid") & ~F.col("legacy"), F.col("valid") & F.col("explicit")
    part = F.col("valid") & F.col("mp3") & ~F.col("explicit")
    numbered = original & F.col("mp3")
    pick = lambda c, when: F.max(F.when(when, F.col(c)))
    return rows.groupBy("group_key").agg(
        F.count_if(v).alias("valid_"), F.count_if(~v).alias("broken"), F.count_if(~F.col("marked")).alias("unmarked"), F.count_if(v & F.col("container")).alias("containers"), F.count_if(v & F.col("mp3")).alias("mp3s"),
        F.count_if(original).alias("originals"), F.count_if(original & F.col("container")).alias("original_containers"), F.count_if(numbered).alias("original_mp3s"),
        pick("duration", original & F.col("container")).alias("container_length"), pick("duration", numbered).alias("mp3_length"), pick("chapters", original & F.col("container")).alias("container_chapters"),
        pick("relative_path", original & F.col("container")).alias("original_path"), F.sum(F.when(numbered, F.col("duration"))).alias("numbered_total"),
        (F.min(F.when(numbered, F.col("root"))) == F.max(F.when(numbered, F.col("root")))).alias("numbered_one_root"), F.min(F.when(numbered, F.col("number"))).alias("number_low"),
        F.max(F.when(numbered, F.col("number"))).alias("number_high"), F.count(F.when(numbered, F.col("number"))).alias("numbers"), F.sum(F.when(numbered, F.col("number"))).alias("number_sum"),
        (F.min(F.when(v & F.col("mp3"), F.col("root"))) == F.max(F.when(v & F.col("mp3"), F.col("root")))).alias("mp3_one_root"),
        F.sum(F.when(v & F.col("mp3"), F.col("duration"))).alias("mp3_total"), F.sum(F.when(v & F.col("container"), F.col("duration"))).alias("container_total"),
        F.bool_and(F.when(v & F.col("container"), F.col("under_way"))).alias("all_under_way"), F.min(F.when(v & F.col("container"), F.struct("order_", "position", "duration")))["duration"].alias("first_container"),
        F.min(F.when(v & F.col("container"), F.col("duration"))).alias("least_container"), F.max(F.when(v & F.col("container"), F.col("duration"))).alias("most_container"),
        F.max_by("relative_path", F.when(v & F.col("container"), F.struct("duration", "size", "relative_path"))).alias("long_container"), F.min(F.when(v, F.col("relative_path"))).alias("one_path"),
        F.count_if(explicit).alias("explicits"), F.count_if(part).alias("parts"), F.max(F.when(part, F.col("duration"))).alias("longest_part"), F.sum(F.when(part, F.col("duration"))).alias("part_total"),
    )


def decide(files: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row a group: group_key, state, rule, confidence, conflicts (a list), and the columns that say what was chosen.

    files: group_key, relative_path, size, duration in seconds (null or 0: unreadable), and if known format_name, codec,
    chapters (their number) and position (anything that can be ordered). groups: group_key, reasons (a list). Equal targets go to the one
    whose path sorts last; equal trees and clusters to the path that sorts first. Repeated paths count as files of their own; of those that
    sort first the one of the least position is the first container, or the shortest where positions are unknown. An empty table gives no rows. What the paths say is written to the shared folder, once, and stays there.
    """
    rows = stored(described(files))
    valid = rows.where("valid")
    one = _summary(rows)
    best = F.max(F.struct("duration", "size", "relative_path", "legacy", "container")).alias("t")
    one = one.join(matched_targets(valid).groupBy("group_key").agg(F.sum("copies").alias("targets"), best), "group_key", "left")
    one = one.join(disc_trees(valid), "group_key", "left").join(corroborated(valid), "group_key", "left")
    # a file without a number makes its group an unnumbered one
    sets = I.numbered_sets(rows.where("marked").select("group_key", "relative_path", "duration"))
    one = one.join(sets.select("group_key", F.col("state").alias("numbering"), "missing", "unreadable"), "group_key", "left")
    other = valid.where("explicit").select("group_key", "duration").join(one.select("group_key", "part_total"), "group_key").groupBy("group_key").agg(F.bool_or(P.close(F.col("duration"), F.col("part_total"))).alias("explicit_matches"))
    one = one.join(other, "group_key", "left")
    conflict = F.lit(False)
    if groups is not None:
        marked = groups.select("group_key", F.array_contains("reasons", "directory and filename identities conflict").alias("conflicting")).groupBy("group_key").agg(F.bool_or("conflicting").alias("conflicting"))
        one, conflict = one.join(marked, "group_key", "left"), F.col("conflicting")
    has_target, n = F.col("targets") > 0, F.col("original_mp3s")
    # numbers 1 to n: as many as files, least 1, greatest n, and their sum; repeats would break the sum or the greatest
    sequence = (F.col("numbers") == n) & (F.col("number_low") == 1) & (F.col("number_high") == n) & (F.col("number_sum") == n * (n + 1) / 2)
    rules = [
        ("identity_conflict", conflict), ("unreadable", F.col("valid_") == 0),
        ("original_whole", (F.col("originals") == 2) & (F.col("valid_") > 2) & (F.col("original_containers") == 1) & (n == 1) & (F.col("container_chapters") >= 2) & (F.col("container_length") >= P.BOOK_SECONDS) & P.close(F.col("container_length"), F.col("mp3_length"), NEARER)),
        ("disc_tree_over_target", has_target & (F.col("disc_total") > 1.1 * F.col("t.duration"))),
        ("numbered_originals", has_target & F.col("t.legacy") & (n >= 2) & F.col("numbered_one_root") & sequence & P.close(F.col("numbered_total"), F.col("t.duration"), NEARER)),
        ("one_target", F.col("targets") == 1), ("several_targets", F.col("targets") > 1),
        ("sequence_conflict", (F.col("unmarked") == 0) & F.col("numbering").isin("invalid", "conflicting_totals", "duplicates", "incomplete")),
        ("disc_tree", F.col("disc_total").isNotNull()),
        ("partial_conversion", F.col("mp3_one_root") & (F.col("containers") > 0) & (F.col("mp3s") >= 2) & (F.col("container_total") < 0.98 * F.col("mp3_total")) & F.col("all_under_way")),
        ("corroborated", F.col("best_root").isNotNull()),
        ("like_containers", (F.col("containers") > 1) & P.close(F.col("first_container"), F.col("least_container")) & P.close(F.col("first_container"), F.col("most_container"))),
        ("only_file", F.col("valid_") == 1),
        ("components_over_other_edition", (F.col("containers") == 0) & (F.col("explicits") > 0) & (F.col("parts") > 0) & (F.col("longest_part") < P.BOOK_SECONDS) & ~F.col("explicit_matches")),
        ("ordered_mp3", (F.col("mp3s") > 0) & (F.col("containers") == 0)), ("containers", (F.col("containers") > 0) & (F.col("mp3s") == 0)),
    ]
    one = one.withColumn("rule", M.first_match(rules, "unexplained"))
    whole = F.when(F.col("rule").isin("one_target", "several_targets"), F.col("t.container")).when(F.col("rule") == "corroborated", (F.col("best_n") == 1) & F.col("best_whole")).otherwise(F.col("containers") > 0)
    single = F.when(whole, "complete_m4b").otherwise(F.when(F.col("rule") == "corroborated", "combine_components").otherwise("convert_single"))
    fixed = F.create_map(*[F.lit(x) for r, (s, _) in OUTCOMES.items() if s for x in (r, s)])
    confidence = F.create_map(*[F.lit(x) for r, (_, c) in OUTCOMES.items() for x in (r, c)])
    said = {
        "identity_conflict": F.lit("directory and filename identify different books"), "unreadable": F.lit("no readable audio representation"),
        "several_targets": F.lit("multiple complete-container candidates"), "components_over_other_edition": F.lit("alternate complete MP3 duration differs from component tree"),
        "unexplained": F.lit("competing representations do not reconcile by duration"),
        "sequence_conflict": F.when(F.col("numbering") == "incomplete", F.concat(F.lit("numbered edition is incomplete: "), F.col("missing"), F.lit(" missing, "), F.col("unreadable"), F.lit(" unreadable"))).otherwise(F.concat(F.col("numbering"), F.lit(" part numbers"))),
    }
    reason = reduce(lambda c, r: F.when(F.col("rule") == r, said[r]).otherwise(c), said, F.lit(None).cast("string"))
    files_lost = F.when((F.col("broken") > 0) & ~F.col("rule").isin("identity_conflict", "unreadable", "sequence_conflict"), F.concat(F.col("broken"), F.lit(" unreadable file(s)")))
    return one.withColumns({"state": F.coalesce(F.try_element_at(fixed, F.col("rule")), single), "confidence": F.element_at(confidence, F.col("rule")), "conflicts": F.array_compact(F.array(files_lost, reason))}).select(
        "group_key", "state", "rule", "confidence", "conflicts", F.col("t.relative_path").alias("target_path"), "original_path", "disc_tree", "best_root", "long_container", "one_path"
    )


def _is_chosen(rule: Column) -> Column:
    path = F.col("relative_path")
    cases: dict[str, Column] = {
        "original_whole": path == F.col("original_path"), "disc_tree_over_target": F.col("disc") & (F.col("disc_root") == F.col("disc_tree")), "disc_tree": F.col("disc") & (F.col("disc_root") == F.col("disc_tree")),
        "numbered_originals": F.col("mp3") & ~F.col("legacy"), "one_target": path == F.col("target_path"), "several_targets": path == F.col("target_path"),
        "partial_conversion": F.col("mp3"), "corroborated": F.col("root") == F.col("best_root"), "like_containers": path == F.col("long_container"), "only_file": F.lit(True),
        "components_over_other_edition": F.col("mp3") & ~F.col("explicit"), "ordered_mp3": F.col("mp3"), "containers": F.col("container"),
    }
    return reduce(lambda c, r: F.when(rule == r, cases[r]).otherwise(c), cases, F.lit(False))


def roles(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """(group_key, relative_path, role): chosen, alternate or problem (unreadable) for every file, by decide's rows."""
    rows = described(files).join(decisions, "group_key")
    unread = F.when(F.col("rule") == "identity_conflict", "alternate").otherwise("problem")
    # rules that keep a part of the readable files and name no alternates leave the others out
    left = F.when(F.col("rule").isin("ordered_mp3", "containers"), "unused").otherwise("alternate")
    role = F.when(~F.col("valid"), unread).when(_is_chosen(F.col("rule")), "chosen").otherwise(left)
    return rows.select("group_key", "relative_path", role.alias("role"))
