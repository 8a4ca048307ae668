"""Which files of a group were made from which: whole files from components, and parallel conversions.

A group's files are aggregated by kind, and every target meets these sums, not the files. For components of a target's
own kind its share is subtracted, so no pairs of files are made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import matching as M

#: Names of sequence members, folders and marks of conversions under way, tags that agree, kinds by suffix.
SEQUENCE = r"(?i)^(?:(?:cd|disc|disk|part|track|chapter|ch)?[ _.-]*\d+(?:[ _.-]*of[ _.-]*\d+)?$|\d+[ _.-])"
UNDER_WAY, MARKS = r"(?i)(?:[-_ ]tmpfiles|[-_ ]temp|[-_ ]conversion)$", "(?i)finished|converting"
TAGS = ["album", "artist", "album_artist"]
KINDS = {"mp3": "mp3", "m4a": "whole", "m4b": "whole"}


def _described(files: DataFrame) -> DataFrame:
    """Readable files of a known kind with what relationships need; one row of the input is one file."""
    path = F.col("relative_path")
    stem = F.trim(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    kind = reduce(lambda w, s: w.when(suffix == s, KINDS[s]), KINDS, F.when(F.lit(False), ""))
    tags = [F.nullif(F.lower(F.trim(F.element_at("tags", t))), F.lit("")).alias(f"tag_{t}") for t in TAGS]
    out = files.select(
        "group_key", "relative_path", kind.alias("kind"), F.col("duration").cast("decimal(18,6)").alias("length"), F.coalesce("chapters", F.lit(0)).alias("chapters"),
        stem.rlike(SEQUENCE).alias("member"), stem.rlike(MARKS).alias("marked"), F.regexp_extract(path, "^(.*)/[^/]*$", 1).rlike(UNDER_WAY).alias("under_way"), *tags,
    )
    return out.where("kind is not null and length > 0")


def combined(files: DataFrame) -> DataFrame:
    """(group_key, relationship, target, score, conflicts): whole files that a group's mp3 files, or its other whole files,
    add up to. files: group_key, relative_path, duration, chapters, tags (a map with lower-case names).

    At least two components. The nearness of the durations gives up to 50 points, one chapter a component 25, marks of
    a conversion 17, sequence names of three quarters of the components 7, a target whose name is no sequence member 5,
    the group 5, each tag that a component shares 4; a conflict (durations 3 % apart, other or no chapters) takes 4.
    Scores from 50 stay, up to 100. Unreadable files and other kinds take no part.
    """
    rows = _described(files)
    sums = rows.groupBy("group_key", "kind").agg(F.count("*").alias("n_"), F.sum("length").alias("sum_"), F.count_if("member").alias("members_"), F.count_if("marked").alias("marks_"))
    targets = rows.where("kind = 'whole'").withColumn("source_", F.explode(F.array(F.lit("mp3"), F.lit("whole"))))
    own = F.col("source_") == "whole"
    for tag in TAGS:
        seen = rows.where(F.col(f"tag_{tag}").isNotNull()).groupBy(F.col("group_key"), F.col("kind").alias("source_"), f"tag_{tag}").agg(F.count("*").alias(f"n_{tag}"))
        targets = targets.join(seen, ["group_key", "source_", f"tag_{tag}"], "left")
    less = lambda c, part: F.col(c) - F.when(own, part).otherwise(0)
    flag = lambda c: F.col(c).cast("int")
    both = targets.join(sums.withColumnRenamed("kind", "source_"), ["group_key", "source_"])
    both = both.withColumns({"n": less("n_", F.lit(1)), "total": less("sum_", F.col("length")).cast("double"), "members": less("members_", flag("member")), "marks": less("marks_", flag("marked")), "d": F.col("length").cast("double")}).where("n >= 2")
    agree: Column = reduce(lambda a, b: a + b, (F.when(less(f"n_{t}", F.lit(1)) > 0, 4).otherwise(0) for t in TAGS))
    apart = F.abs(F.col("d") - F.col("total")) / F.greatest("d", "total", F.lit(1.0)) > 0.03
    conflicts = apart.cast("int") + (F.col("chapters") != F.col("n")).cast("int")
    points = (
        M.duration_points(F.col("d"), F.col("total")) + 5 + F.when(F.col("chapters") == F.col("n"), 25).otherwise(0) + F.when(F.col("member"), 0).otherwise(5)
        + F.when(F.col("members") / F.col("n") >= 0.75, 7).otherwise(0) + F.when(F.col("under_way") & (F.col("marks") / F.col("n") >= 0.75), 17).otherwise(0) + agree
    )
    name = F.when(own, "combined_from_m4b_components").otherwise("combined_from_mp3_components")
    score = F.least(points - 4 * conflicts, F.lit(100)).cast("double")
    return both.select("group_key", name.alias("relationship"), F.col("relative_path").alias("target"), score.alias("score"), conflicts.alias("conflicts")).where("score >= 50")


def parallel(files: DataFrame) -> DataFrame:
    """The same columns, without a target: groups with as many mp3 files as whole files with sequence names, two at least,
    whose durations in natural order are mostly within two seconds. 25 points and 55 x the share of such pairs."""
    rows = _described(files).where("kind = 'mp3' or member")
    place = F.row_number().over(Window.partitionBy("group_key", "kind").orderBy(*T.natural_keys(F.lower("relative_path"))))
    rows = rows.select("group_key", "kind", "length", place.alias("place"))
    # a place with both kinds is a pair: unequal counts leave a place with one
    pairs = rows.groupBy("group_key", "place").agg(F.max(F.when(F.col("kind") == "mp3", F.col("length"))).alias("a"), F.max(F.when(F.col("kind") == "whole", F.col("length"))).alias("b"))
    near = F.count_if(F.abs(F.col("a") - F.col("b")) <= 2) / F.count("*")
    out = pairs.groupBy("group_key").agg(F.count("*").alias("n"), F.count("a").alias("n_a"), F.count("b").alias("n_b"), near.alias("near")).where("n >= 2 and n = n_a and n = n_b")
    return out.select("group_key", F.lit("parallel_intermediate_conversion").alias("relationship"), F.lit(None).cast("string").alias("target"), (55 * F.col("near") + 25).alias("score"), (F.col("near") < 0.8).cast("int").alias("conflicts")).where("score >= 50")


def relationships(files: DataFrame) -> DataFrame:
    """All relationships with their bands."""
    return combined(files).unionByName(parallel(files)).withColumn("band", M.band_name(F.col("score")))


def review(files: DataFrame, found: DataFrame) -> DataFrame:
    """(group_key, reasons, comma-joined): unreadable files, several files without a relationship, uncertain or conflicting ones, several plausible targets."""
    groups = files.groupBy("group_key").agg(F.count_if(F.col("duration") > 0).alias("valid"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("broken"))
    strong = F.when((F.col("score") >= 80) & F.col("target").isNotNull(), F.col("target"))
    claims = found.groupBy("group_key").agg(F.count("*").alias("claims"), F.count_if((F.col("score") < 95) | (F.col("conflicts") > 0)).alias("unsure"), (F.min(strong) < F.max(strong)).alias("several"))
    both = groups.join(claims, "group_key", "left")
    rules = [
        ("unreadable", F.col("broken") > 0), ("unexplained", (F.col("valid") > 1) & F.col("claims").isNull()),
        ("uncertain", F.col("unsure") > 0), ("several_targets", F.col("several")),
    ]
    return both.select("group_key", M.issue_codes(rules).alias("reasons"))
