"""Parts of relative paths and what a file's place and name say about it, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.sources.media import DISC_FOLDER, directory, last_part, suffix

#: Folders of other versions, names of whole books, kinds by suffix.
VARIANT_FOLDER = r"(?i)^alt(?:\.|ernate|ernative)?\s+versions?$"
WHOLE_NAME = r"(?i)(?:\b(?:complete|full(?:\s+audiobook)?|unabridged)\b|\d+complete\b)"
#: Folders of other versions and of conversions under way, anywhere in a directory; a folder may end in a line's end as $ lets them.
_END = r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?(?:/|\z)"
_ANY_VARIANT, _ANY_UNDER_WAY = r"(?i)(?:\A|/)alt(?:\.|ernate|ernative)?\s+versions?" + _END, r"(?i)(?:\A|[-_ /])tmpfiles?" + _END
CONTAINERS = ("m4a", "m4b", "mp4")
#: Seconds from which a file may be a whole book, and from which a part counts as a long one.
BOOK_SECONDS, PART_SECONDS = 7200.0, 1200.0


def stem(path: Column) -> Column:
    """The file name without its suffix."""
    return F.regexp_replace(last_part(path), r"(?<=.)\.[^.]*$", "")


def folders(path: Column) -> Column:
    """The path's directories, outermost first."""
    return F.filter(F.split(directory(path), "/"), lambda p: p != "")


def depth(path: Column) -> Column:
    """Number of path parts, the file's own included."""
    return F.size(folders(path)) + 1


def under_way(path: Column) -> Column:
    """Does a folder belong to a conversion under way?"""
    return directory(path).rlike(_ANY_UNDER_WAY)


def legacy(path: Column, marks: str = r"(?i)^tmp_") -> Column:
    """A temporary file by its name or by a folder; detection also takes `tmp-` and `tmp ` for such a name."""
    return stem(path).rlike(marks) | under_way(path)


def is_container(path: Column, format_name: Column, codec: Column) -> Column:
    """By suffix, or AAC in a format list that names mp4, m4a or mov."""
    listed = F.arrays_overlap(F.split(F.lower(F.coalesce(format_name, F.lit(""))), r"\s*,\s*"), F.array(*map(F.lit, ("mp4", "m4a", "mov", "m4b"))))
    return suffix(path).isin(*CONTAINERS) | (listed & F.coalesce(F.lower(codec) == "aac", F.lit(False)))


def disc_parent(path: Column, duration: Column) -> Column:
    """Is the folder a disc's or part's, or a bare number below two others around a file of under two hours?"""
    folder = last_part(directory(path))
    return folder.rlike(DISC_FOLDER) | (folder.rlike(r"^\d{1,3}$") & directory(path).rlike("[^/]/+[^/]") & F.coalesce((duration > 0) & (duration < BOOK_SECONDS), F.lit(False)))


def representation_root(path: Column, duration: Column) -> Column:
    """The folder that holds one whole representation: above discs, then above folders of other versions."""
    folder = F.when(disc_parent(path, duration), directory(directory(path))).otherwise(directory(path))
    return F.when(last_part(folder).rlike(VARIANT_FOLDER), directory(folder)).otherwise(folder)


def explicit_whole(path: Column) -> Column:
    """An mp3 that calls itself whole, or lies in a folder of other versions."""
    return (suffix(path) == "mp3") & (stem(path).rlike(WHOLE_NAME) | directory(path).rlike(_ANY_VARIANT))


def close(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Both positive, and apart by no more than the tolerance's share of the longer; null is not close."""
    return F.coalesce((a > 0) & (b > 0) & (F.abs(a - b) <= tolerance * F.greatest(a, b)), F.lit(False))
