"""Media inventories: file candidates, directories and probe reports as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that are media; MAGIC holds where a file without a suffix shows its kind.
SUFFIXES = ("mp3", "m4a", "m4b", "mp4")
#: A probe report: streams and format as a prober prints them.
PROBE = """streams array<struct<codec_type string, codec_name string, sample_rate string, channels int, bit_rate string, tags map<string, string>>>,
format struct<duration string, format_name string, bit_rate string, tags map<string, string>>, chapters array<struct<start_time string, end_time string, tags map<string, string>>>"""


def suffix(path: Column) -> Column:
    """Lower-cased suffix of the last path part, empty where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def is_candidate(path: Column, head: Column) -> Column:
    """A media suffix, or no suffix and a head that starts with ID3 or has ftyp at byte 4; a null head does not."""
    kind = (F.substring(head, 5, 4) == F.lit(b"ftyp")) | (F.substring(head, 1, 3) == F.lit(b"ID3"))
    return suffix(path).isin(*SUFFIXES) | ((suffix(path) == "") & F.coalesce(kind, F.lit(False)))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative_path, size, modified) of the candidates below root; relative_path is spelled as the file system does.

    Content is read of files without a suffix alone. Spark's listing leaves out names that start with _ or a dot.
    """
    files = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    named = files("*.*").where(suffix(F.col("path")).isin(*SUFFIXES)).select("path", "length", "modificationTime")
    bare = files("*").where(suffix(F.col("path")) == "").where(is_candidate(F.col("path"), F.col("content"))).select("path", "length", "modificationTime")
    relative = F.regexp_replace("path", "^.*?" + _quoted(root.split("://")[-1].rstrip("/")) + "/", "")
    return named.unionByName(bare).select("path", relative.alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def parse_probe(reports: DataFrame, column: str) -> DataFrame:
    """Adds probe (duration, codec, channels, tags, chapters) and error. A report that can't be read, has no audio stream,
    or has a chapter without whole times has a null probe and the reason; null reports are unreadable."""
    r = F.from_json(column, PROBE)
    audio = F.get(F.filter(r["streams"], lambda s: s["codec_type"] == "audio"), F.lit(0))
    chapters = F.transform(F.coalesce(r["chapters"], F.array()), lambda c: F.struct(c["start_time"].try_cast("double").alias("start"), c["end_time"].try_cast("double").alias("end")))
    broken = F.exists(F.col("chapters_"), lambda c: F.coalesce((c["start"] < 0) | (c["end"] < c["start"]) | F.isnan(c["start"]) | F.isnan(c["end"]) | (F.abs(c["end"]) == float("inf")), F.lit(True)))
    lower = lambda m: F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    tags = F.map_from_entries(F.array_distinct(F.map_entries(F.map_filter(lower(audio["tags"]), lambda k, _: ~F.map_contains_key(lower(r["format"]["tags"]), k)))))
    tags = F.map_concat(lower(r["format"]["tags"]), tags)
    found = reports.withColumn("report_", r).withColumn("audio_", audio).withColumn("chapters_", chapters)
    error = F.when(F.col("report_.format").isNull() & F.col("report_.streams").isNull(), "unreadable").when(F.col("audio_").isNull(), "no audio stream").when(broken, "invalid chapters")
    duration = F.col("report_.format.duration").try_cast("double")
    probe = F.struct(duration.alias("duration"), F.col("audio_.codec_name").alias("codec"), F.col("audio_.channels").alias("channels"), tags.alias("tags"), F.col("chapters_").alias("chapters"))
    return found.withColumn("error", error).withColumn("probe", F.when(F.col("error").isNull(), probe)).drop("report_", "audio_", "chapters_")


#: Names of folders that hold one disc or part.
DISC_FOLDER = r"(?i)^(?:(?:cd|disc|disk|part)[ _.-]*\d+|\(?\d+\s*(?:of|/)\s*\d+\)?)$"


def directory(path: Column) -> Column:
    """The part of a path before its last slash; empty where there is none."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def last_part(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def group_directory(relative_path: Column) -> Column:
    """A file's directory, or the one above where that is a disc's or part's (CD 1, Disc.2, Part 3, (1 of 3))."""
    folder = directory(relative_path)
    return F.when(last_part(folder).rlike(DISC_FOLDER), directory(folder)).otherwise(folder)
