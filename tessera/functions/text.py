"""Text identities as Columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

_RUNS = re.compile(r"[^\W_]+")


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, in order; null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def title_key(text: Column) -> Column:
    """Sorted distinct tokens joined by blanks."""
    return F.array_join(F.array_sort(F.array_distinct(tokens(text))), " ")


def finite(text: Column, kind: str = "double") -> Column:
    """The number in a text, or null for none, NaN and infinity."""
    number = text.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number).cast(kind)


def containment(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller token set; 0 where either is empty or null."""
    smaller = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.coalesce(F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller), F.lit(0.0))


def safe_name(text: Column, limit: int = 160) -> Column:
    """A file name: characters that paths forbid become blanks, blanks collapse, blanks and dots at the ends go, also
    those where a name of more than limit characters is cut; what is empty, or null, becomes Unknown."""
    ends = r"^[ .]+|[ .]+$"
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', " "), r"\s+", " "), ends, "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(clean, 1, limit), ends, ""), F.lit("")), F.lit("Unknown"))


def natural_keys(text: Column) -> list[Column]:
    """Sort keys: the text with its numbers blanked, the numbers by size, the text itself."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("bigint"))
    return [F.regexp_replace(F.lower(text), "[0-9]+", "#"), numbers, text]


def aliases(title: Column) -> Column:
    """The lower-cased title, without its first word, and without its last; those of three characters or more."""
    low = F.lower(title)
    return F.array_distinct(F.filter(F.array(low, F.regexp_replace(low, "^[^ ]+ ", ""), F.regexp_replace(low, " [^ ]+$", "")), lambda a: F.length(a) >= 3))


def position_label(position: Column) -> Column:
    """A place in a series: whole numbers of two digits, fractions as they are; null and blanks give none."""
    text = F.trim(position.cast("string"))
    whole = F.regexp_replace(text, r"\.0+$", "")
    return F.nullif(F.when(whole.rlike("^[0-9]+$"), F.when(F.length(whole) < 2, F.lpad(whole, 2, "0")).otherwise(whole)).otherwise(text), F.lit(""))


def output_path(author: Column, series: Column, position: Column, title: Column, suffix: str) -> Column:
    """author/[series/][NN - ]title/author - title.suffix, of safe names; series and place may be null or empty."""
    held = F.nullif(F.trim(series), F.lit(""))
    place = F.when(held.isNotNull(), position_label(position))
    folder = F.concat(F.coalesce(F.concat(place, F.lit(" - ")), F.lit("")), safe_name(title))
    return F.concat_ws("/", safe_name(author), F.when(held.isNotNull(), safe_name(series)), folder, F.concat(safe_name(author), F.lit(" - "), safe_name(title), F.lit(f".{suffix}")))


def json_digest(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON with sorted names; null fields are written, so a field is never like its absence.

    Names inside structs stand as the structs have them; give structs sorted names.
    """
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())]), {"ignoreNullFields": "false"}), 256)


def both_ends(text: Column, limit: int) -> Column:
    """Texts over the limit lose their middle."""
    mark = " [..] "
    half = (limit - len(mark)) // 2
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(half)), F.lit(mark), F.right(text, F.lit(half)))).otherwise(text)


def _mapped(function: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """An Arrow UDF that maps texts one by one; null stays null."""
    return F.pandas_udf(lambda text: text.map(function, na_action="ignore"), StringType())


def person_name(text: str) -> str:
    return " ".join(_RUNS.findall(unicodedata.normalize("NFKC", text).casefold()))


def display_name(text: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip().casefold()


#: Identity of a person's name: NFKC, case-folded, runs of letters and digits joined by blanks.
person_key = _mapped(person_name)
#: Identity of a spelling: NFKC, case-folded, blanks collapsed; punctuation counts.
display_key = _mapped(display_name)
#: The letters and digits of the person key, without blanks.
compact_key = _mapped(lambda text: person_name(text).replace(" ", ""))


def spelling_rank(text: Column) -> Column:
    """How well a name is presented, greater is better: mixed case before capitals before the rest, then words that
    begin with a capital, then ". ", then capitals."""
    capitals, words = F.regexp_count(text, F.lit(r"\p{Lu}")), F.regexp_count(text, F.lit(r"(?<![\p{L}])\p{Lu}"))
    lower = text.rlike(r"\p{Ll}")
    case = F.when((capitals > 0) & lower, 2).when(capitals > 0, 1).otherwise(0)
    return F.struct(case.alias("case"), words.alias("words"), F.regexp_count(text, F.lit(r"\. ")).alias("dots"), capitals.alias("capitals"))


@F.pandas_udf(StringType())
def normalized(text: pd.Series) -> pd.Series:
    """NFKC, case-folded, runs of letters and digits joined by blanks; null stays null. Spark has neither NFKC nor case folding."""
    return text.map(lambda t: " ".join(_RUNS.findall(unicodedata.normalize("NFKC", t).casefold())), na_action="ignore")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over all characters, for short keys; null where either is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
