"""Books among media files: a title for every file from tags, names and folders, then buckets of one title joined and parted.

Files that no rule tells apart are one class: those of one folder, with the same tags and marks, and also of one name and length where a rule
looks at these. Every step sees classes, with how many files and seconds they hold, and the files meet their class's book at the end.
Classes are aggregated by title, root folder and top folder; titles meet titles on a shared word and a band of their durations'
logarithms, so no bucket is paired with all others. Each step is an aggregate or an equi-join, and the
transitive ones are connected components.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import titles as T
from tessera.operators import matching as M
from tessera.operators import paths as P
from tessera.operators import states as S
from tessera.operators.components import components
from tessera.operators.entities import with_group
from tessera.operators.shared import saved, stored
from tessera.sources.media import DISC_FOLDER, directory, last_part, suffix

#: A numbered item of a collection, words that make it a part, marks of dramatized editions, temporary names.
COLLECTION, PART_WORDS = r"^(.+?)\s+-\s+(\d{1,3}(?:\.\d+)?)\s+-\s+(.+)$", r"(?i)\b(?:chapter|disc|part|track)\b|\b\d+\s+of\s+\d+\b"
DRAMATIZED_FOLDER, DRAMATIZED_CREDIT, TEMPORARY = r"(?i)(?:^|[-_ ])ga\s*$", r"(?i)^graphic\s*audio(?:,?\s*llc\.?)?$", r"(?i)^tmp[_ -]"
AUTHORS = ("author", "album_artist", "artist")
CREDIT_NOISE = ["audio", "graphic", "graphicaudio", "llc"]
TOLERANCE = 0.005
#: Columns of a class: its place (folder, for files without one their name, below two hours or not, first tags) and its marks.
TAGS = {"album_tag": ("album",), "title_tag": ("title",), "author_tag": ("album_artist", "artist", "author"), "by_tag": AUTHORS, "credit": ("album_artist", "artist"), "said_tag": ("author", "artist", "album_artist")}
PLACE, MARKS = ["folder", "lone", "short", *TAGS], ["container", "probed", "readable", "lengthy", "long", "temporary_name", "tmp"]
_WIDTH = -math.log(1 - TOLERANCE)


def overlap(a: Column, b: Column) -> Column:
    return X.containment(T.words(a), T.words(b))


def structural_root(path: Column) -> Column:
    """The file's folder, or the one above a disc's."""
    folder = directory(path)
    return F.when(last_part(folder).rlike(DISC_FOLDER), directory(folder)).otherwise(folder)


def effective_root(path: Column, short: Column) -> Column:
    """Above folders that are packaging of short files, then above folders of other versions."""
    root = structural_root(path)
    packed = last_part(root).rlike(T.PACKAGING) & (P.depth(path) >= 3) & short
    root = F.when(packed, directory(root)).otherwise(root)
    return F.when(last_part(root).rlike(P.VARIANT_FOLDER) & (directory(root) != ""), directory(root)).otherwise(root)


def _conflict(title: Column) -> Column:
    """Does a file's own name speak of another book than the title?"""
    name, compact = F.col("file_title"), lambda c: F.regexp_replace(c, "[^a-z0-9]+", "")
    silent = (F.col("plain_album") != "") | ((F.col("tag_title") != "") & (overlap(title, F.col("tag_title")) >= 0.5)) | (name == "") | name.rlike("^[0-9]+$") | name.isin("audio", "audiobook", "track")
    held = (F.length(compact(title)) >= 8) & F.contains(compact(name), compact(title))
    return ~silent & ~held & (F.size(T.words(title)) > 0) & (overlap(title, name) < 0.5)


def described(files: DataFrame) -> DataFrame:
    """files (relative_path, duration, tags) with their length and the columns of PLACE and MARKS."""
    path, tags = F.col("relative_path"), F.coalesce(F.col("tags"), F.create_map().cast("map<string,string>"))
    rows = files.select(path, F.col("duration").cast("double").alias("duration"), *(S.first_tag(tags, *names).alias(c) for c, names in TAGS.items()))
    rows = rows.withColumns({"length": F.coalesce("duration", F.lit(0.0)), "folder": F.coalesce(directory(path), F.lit("")), "container": F.coalesce(suffix(path).isin("m4a", "m4b"), F.lit(False))})
    length, no = F.col("length"), F.lit(False)
    return rows.select(
        path, "length", "folder", F.when(~F.col("folder").rlike("[^/]"), F.coalesce(last_part(path), F.lit(""))).otherwise("").alias("lone"), F.coalesce(F.col("duration") < P.BOOK_SECONDS, no).alias("short"), *TAGS,
        "container", F.col("duration").isNotNull().alias("probed"), (length > 0).alias("readable"), (length >= P.PART_SECONDS).alias("lengthy"), (length >= P.BOOK_SECONDS).alias("long"),
        F.coalesce(P.stem(path).rlike(TEMPORARY), no).alias("temporary_name"), (F.col("container") & F.coalesce(P.stem(path).rlike(r"(?i)^tmp_"), no)).alias("tmp"),
    )


def places(rows: DataFrame) -> DataFrame:
    """described rows' distinct places, numbered, with what folders and tags say. quiet: there is an album tag, and it
    or the folder names the book; then no rule looks at the names of short files."""
    at = F.concat("folder", F.lit("/"))
    out = rows.select(*PLACE).distinct().withColumns({"root": effective_root(at, F.col("short")), "seat": structural_root(at), "depth": P.depth(at), "under_way": P.under_way(at)})
    out = out.withColumn("top_folder", F.when(F.col("depth") > 1, F.element_at(P.folders(at), 1)).otherwise(F.col("lone")))
    out = saved(out.withColumns({
        "album0": T.book_title("album_tag"), "plain_album": T.plain("album_tag"), "tag_title": T.book_title("title_tag"), "author": T.plain("author_tag"), "by": T.plain("by_tag"), "said": T.plain("said_tag"),
        "top": T.plain("top_folder"), "root_title": T.book_title(last_part(F.col("root"))), "root_plain": T.plain(last_part(F.col("root"))), "folder_title": T.book_title(last_part(F.col("folder"))),
    }))
    album0, by = F.col("album0"), F.when(F.col("depth") > 1, F.col("top")).otherwise("")
    out = out.withColumns({"structure": T.without_author(F.col("root_title"), by), "support_album": T.without_author(album0, by)})
    backed = (F.col("structure") != "") & (F.col("support_album") != "") & (overlap(F.col("structure"), F.col("support_album")) >= 0.8)
    album = T.without_author(F.when(album0.isin(T.PLACEHOLDERS), "").otherwise(album0), by)
    album = F.when(album.rlike(T.PACKAGING) & (F.col("structure") != "") & ~F.col("structure").rlike(T.PACKAGING), "").otherwise(album)
    out = out.withColumns({"backed": backed, "album1": album})
    generic = (F.col("album1") != "") & ((F.col("album1") == F.col("author")) | (F.col("album1") == F.col("root_plain")) | F.col("album1").isin(T.GENERIC))
    out = out.withColumns({"generic": generic, "album": F.when(generic & (F.col("structure") != "") & ~F.col("structure").isin([*T.GENERIC_FILES, *T.PLACEHOLDERS]), "").otherwise(F.col("album1"))})
    return stored(out.withColumns({"quiet": F.coalesce((F.col("plain_album") != "") & ((F.col("album") != "") | (F.col("structure") != "")), F.lit(False)), "place": F.monotonically_increasing_id()}))


CLASS = ["place", *MARKS, "stem", "exact"]


def with_class(rows: DataFrame, known: DataFrame) -> DataFrame:
    """described rows with the columns of CLASS, by the places: name and length (stem, exact) are left empty where no rule looks at them."""
    rows = rows.join(known.select(*PLACE, "place", "quiet"), PLACE)
    own = ~F.col("quiet") | F.col("long") | (F.col("container") & F.col("probed"))
    return rows.withColumns({"stem": F.when(own, F.coalesce(P.stem(F.col("relative_path")), F.lit(""))).otherwise(""), "exact": F.when(own, F.col("length")).otherwise(-1.0)})


def titled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The classes of described rows with title, rule (where it comes from), conflicting, and what later steps need: n files, seconds
    in all, length of the longest.

    Titles come, in this order, from: a numbered item of a collection, a dramatized edition's folder, a
    part of a conversion, a container of its own, a long file of a flat folder, a folder behind a series code, the album,
    the folder, the file's name.
    """
    rows = with_class(rows, known).groupBy(*CLASS).agg(F.count("*").alias("n"), F.sum("length").alias("seconds"), F.max("length").alias("length"))
    rows = rows.join(known, "place").withColumn("temporary", F.col("temporary_name") | F.col("under_way"))
    rows = rows.withColumns({
        "stem_title": T.book_title("stem"), "file_title": T.file_title("stem"), "plain_stem": T.plain("stem"), "bare_title": T.book_title(F.regexp_replace("stem", T.FLAT_PREFIX, "")), "item_title": T.plain(F.regexp_extract("stem", COLLECTION, 3)),
    }).withColumn("collection", F.regexp_extract("stem", COLLECTION, 3))
    rows = saved(rows)
    rows = with_group(rows, ["folder"], siblings=F.sum("n"))
    rows = with_group(rows, ["root"], supports=F.sum(F.when(F.col("backed"), F.col("n")).otherwise(0)), support_length=F.sum(F.when(F.col("backed"), F.col("seconds")).otherwise(0.0)))
    length, by = F.col("length"), F.when(F.col("depth") > 1, F.col("top")).otherwise("")
    item = F.when(F.col("long") & ~F.col("collection").rlike(PART_WORDS), F.col("item_title")).otherwise("")
    own = (F.col("tag_title") != "") & ~F.col("tag_title").isin([*T.GENERIC, *T.PLACEHOLDERS]) & (F.col("tag_title") != F.col("by")) & (F.col("tag_title") != F.col("top"))
    flat = F.when((F.col("depth") == 2) & F.col("long"), F.when(own, F.col("tag_title")).when(~F.col("bare_title").isin(T.GENERIC), F.col("bare_title")).otherwise("")).otherwise("")
    rows = saved(rows).withColumns({"item": item, "flat": flat, "standalone": _standalone()})
    marked = last_part(F.col("root")).rlike(DRAMATIZED_FOLDER)
    drama = F.when(marked, F.trim(F.regexp_replace("root_title", r"\s+ga$", ""))).otherwise(F.col("album1"))
    fits = (F.size(T.identity_words(drama)) > 0) & ((F.size(T.identity_words(F.col("album1"))) == 0) | S.is_subset(T.identity_words(drama), T.identity_words(F.col("album1"))))
    part = F.when(F.col("flat") != "", F.col("flat")).otherwise(F.col("album1"))
    base = F.trim(F.regexp_replace(part, T.PART_ENDING, ""))
    base_words, root_words = T.identity_words(base), T.identity_words(F.col("structure"))
    joined = F.col("temporary") & part.rlike(T.PART_ENDING) & (F.size(base_words) > 0) & (F.size(root_words) > 0) & (S.is_subset(base_words, root_words) | S.is_subset(root_words, base_words))
    title_by = [
        ("collection_item", F.col("item") != "", F.col("item")), ("dramatized", (marked | F.col("credit").rlike(DRAMATIZED_CREDIT)) & fits, F.concat(drama, F.lit(" graphic audio"))), ("conversion_part", joined, base),
        ("container", (F.col("standalone") != "") & ((F.col("album") == "") | (overlap(F.col("standalone"), F.col("album")) < 0.5)), F.col("standalone")),
        ("flat_file", (F.col("flat") != "") & ((F.col("album") == "") | F.col("generic")), F.col("flat")), ("series_code", T.coded(F.col("album"), F.col("structure")), F.col("structure")),
        ("album", F.col("album") != "", F.col("album")), ("folder", F.col("structure") != "", F.col("structure")), ("file", F.lit(True), F.col("file_title")),
    ]
    rule = M.first_match([(n, c) for n, c, _ in title_by], "file")
    rows = rows.withColumn("rule", rule)
    value = F.col("file_title")
    for name, _, column in reversed(title_by):
        value = F.when(F.col("rule") == name, column).otherwise(value)
    rows = rows.withColumn("title", value)
    numbered = F.regexp_extract("plain_stem", r"^([1-9]\d+)\s+.+$", 1) != ""
    other = F.when(numbered, F.col("plain_stem")).otherwise(F.col("file_title"))
    strays = (F.col("album") == "") & (F.col("title") == F.col("structure")) & ~F.col("temporary") & (F.col("supports") >= 2) & (length > 0) & (length >= 0.8 * F.col("support_length")) & _conflict(F.col("structure")) & (other != "") & ~other.isin(T.GENERIC_FILES)
    return rows.withColumn("conflicting", F.coalesce(strays, F.lit(False))).withColumn("title", F.when(F.col("conflicting"), other).otherwise(F.col("title")))


def _standalone() -> Column:
    """A container's own title: its title tag or its name, where these are not the album's, or its lone folder, or its numbered name."""
    fine = lambda c: (c != "") & ~c.isin([*T.GENERIC_FILES, *T.PLACEHOLDERS]) & ~c.rlike(T.PACKAGING)
    tag, name, album = F.col("tag_title"), F.col("stem_title"), F.col("album0")
    shared = (F.col("siblings") > 1) & F.col("lengthy") & ~F.col("temporary")
    by_tag = shared & fine(tag) & (album != "") & (overlap(tag, album) < 0.5)
    by_name = shared & (F.size(T.identity_words(name)) >= 2) & fine(name) & ((album == "") | (overlap(name, album) < 0.5)) & ((tag == "") | tag.rlike(T.PACKAGING) | (overlap(name, tag) < 0.5))
    lone = (F.col("siblings") == 1) & ~last_part(F.col("folder")).rlike(P.VARIANT_FOLDER) & (F.col("folder_title") != "") & (F.col("folder_title") != F.col("by")) & ~F.col("folder_title").isin(T.GENERIC_FILES)
    cut = F.col("stem").rlike(T.FLAT_PREFIX) & (F.col("bare_title") != "") & ~F.col("bare_title").isin(T.GENERIC_FILES)
    out = F.when(by_tag, tag).when(by_name, name).when(F.col("long") & lone, F.col("folder_title")).when(F.col("long") & cut, F.col("bare_title")).otherwise("")
    return F.when(F.col("container") & F.col("probed"), out).otherwise("")


def attached(rows: DataFrame) -> DataFrame:
    """Titles without a readable file go to the one other title that has readable files in their folders."""
    readable = rows.where("readable").select("folder", F.col("title").alias("near")).distinct()
    lost = rows.groupBy("title").agg(F.max("length").alias("most")).where("most <= 0").select("title")
    seats = rows.select("title", "folder").distinct().join(lost, "title").join(readable, "folder").where("near <> title")
    moved = seats.groupBy("title").agg(F.min("near").alias("to"), F.max("near").alias("other")).where("to = other").select("title", "to")
    return rows.join(moved, "title", "left").withColumn("title", F.coalesce("to", "title")).drop("to")


def signatures(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, seconds): each key's totals by structural root, and its long containers; from PART_SECONDS on."""
    read = rows.where("readable")
    roots = read.groupBy(*key, "seat").agg(F.sum("seconds").alias("seconds")).select(*key, "seconds")
    whole = read.where("container").select(*key, F.col("length").alias("seconds"))
    return roots.unionByName(whole).where(F.col("seconds") >= P.PART_SECONDS).distinct()


def _near(sigs: DataFrame, on: list[str], node: str) -> DataFrame:
    """(a, b) of nodes a < b with equal `on` columns and a pair of seconds within TOLERANCE of the longer. That is above 5 s here."""
    band = F.floor(F.log("seconds") / _WIDTH)
    left = sigs.select(*on, F.col(node).alias("a"), F.col("seconds").alias("x"), band.alias("band"))
    right = sigs.select(*on, F.col(node).alias("b"), F.col("seconds").alias("y"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: band + k)).alias("band"))
    return left.join(right, [*on, "band"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("x") - F.col("y")) <= TOLERANCE * F.greatest("x", "y"))).select("a", "b").distinct()


def partition_authors(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, top_folder, author): a title's author by top folder: the folder's name if a tag holds all of its two or more
    words, else the shortest tag, null without tags."""
    tag = F.array_join(F.filter(T.words(F.col("by")), lambda w: ~w.isin(CREDIT_NOISE)), " ")
    known = rows.withColumn("tag", F.nullif(tag, F.lit("")))
    in_top = (F.size(T.words(F.col("top"))) >= 2) & S.is_subset(T.words(F.col("top")), T.words(F.col("tag")))
    least = F.min(F.when(F.col("tag").isNotNull(), F.struct(F.size(T.words(F.col("tag"))).alias("n"), F.length("tag").alias("size"), "tag")))
    out = known.groupBy(*key, "top_folder").agg(F.coalesce(F.bool_or(in_top), F.lit(False)).alias("own"), F.min("top").alias("top"), least.alias("least"))
    return out.select(*key, "top_folder", F.when(F.col("own"), F.col("top")).otherwise(F.col("least.tag")).alias("author"))


def _word_key(author: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(T.words(author))), " ")


def merged(rows: DataFrame) -> DataFrame:
    """Titles that a conversion or a whole file ties together: like words, no other numbers, and equal durations. Adds joined_titles."""
    info = rows.groupBy("title").agg(F.sum("n").alias("n"), F.bool_or("temporary").alias("temporary"), F.max("length").alias("length"), F.bool_or("tmp").alias("tmp"))
    info = info.select("title", (F.col("temporary") | ((F.col("n") == 1) & (F.col("length") >= P.PART_SECONDS))).alias("may"), ((F.col("n") == 1) & F.col("tmp")).alias("target"), T.identity_words(F.col("title")).alias("words"), T.identity_numbers(F.col("title")).alias("numbers"))
    sigs = signatures(rows, ["title"]).join(info.select("title", F.explode("words").alias("word")), "title")
    side = lambda s: info.select(*(F.col(c).alias(f"{s}_{c}") for c in info.columns))
    pairs = _near(sigs, ["word"], "title").distinct().join(side("a"), F.col("a") == F.col("a_title")).join(side("b"), F.col("b") == F.col("b_title")).where("a_may or b_may")
    authors = partition_authors(rows, ["title"]).where("author is not null").select("title", _word_key(F.col("author")).alias("key")).distinct()
    shared = pairs.select("a", "b").join(authors.select(F.col("title").alias("a"), "key"), "a").join(authors.select(F.col("title").alias("b"), "key"), ["b", "key"]).select("a", "b").distinct().withColumn("shared", F.lit(True))
    both = F.size(F.array_intersect("a_words", "b_words"))
    few = F.when(F.col("a_target") | F.col("b_target") | F.coalesce("shared", F.lit(False)), 1).otherwise(2)
    other = (F.size("a_numbers") > 0) & (F.size("b_numbers") > 0) & (F.col("a_numbers") != F.col("b_numbers"))
    pairs = pairs.join(shared, ["a", "b"], "left").where(~other & (both >= few) & (both >= 0.9 * F.least(F.size("a_words"), F.size("b_words")))).select("a", "b")
    groups = saved(components(pairs)).withColumnRenamed("node", "title")
    named = groups.groupBy("root").agg(F.min(F.struct(F.size(T.identity_words(F.col("title"))).alias("n"), F.length("title").alias("size"), "title")).alias("best"))
    names = groups.join(named, "root").select("title", F.col("best.title").alias("to"))
    return rows.join(names, "title", "left").withColumns({"joined_titles": F.col("to").isNotNull(), "title": F.coalesce("to", "title")}).drop("to")


def parted(rows: DataFrame) -> DataFrame:
    """Adds part: top folders of one title that are by different authors, all known, are books of their own, unless their durations agree."""
    authors = partition_authors(rows, ["title"])
    mixed = authors.groupBy("title").agg(F.count("*").alias("n"), F.count("author").alias("known"), (F.min("author") < F.max("author")).alias("several")).where("n > 1 and known = n and several").select("title")
    node = F.concat_ws("\u0001", "title", "top_folder")
    tops = authors.join(mixed, "title").select("title", _word_key(F.col("author")).alias("key"), node.alias("node"))
    same = tops.join(tops.groupBy("title", "key").agg(F.min("node").alias("low")), ["title", "key"]).where("node > low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    near = _near(signatures(rows.join(mixed, "title").withColumn("node", node), ["title", "node"]), ["title"], "node")
    roots = components(same.unionByName(near))
    parts = tops.join(roots, "node", "left").select(F.col("node").alias("at"), F.coalesce("root", "node").alias("part"))
    return rows.join(parts, node == F.col("at"), "left").drop("at").withColumn("part", F.coalesce("part", F.lit("")))


def detect(files: DataFrame) -> DataFrame:
    """(relative_path, group_key, title, part, reason): the book of every file. group_key is "author — title", with the author
    if all tags agree; part tells books of one title apart. duration is null or 0 for unreadable files; tags is a map with lower-case
    names, null where there are none. Paths must be unique. An empty table gives no rows. What is stored stays in the shared folder."""
    # files are read three times, so what steps need of them is stored; classes are few where tags name the books
    described_ = stored(described(files))
    known = places(described_)
    # every step reads the one before several times, so each is saved: else plans would hold one another many times over
    rows = saved(parted(saved(merged(saved(attached(saved(titled(described_, known))))))))
    rows = rows.withColumn("said", F.nullif("said", F.lit("")))
    own_name = (F.col("standalone") == F.col("title")) & (F.col("album0") != "") & (F.col("album0") != F.col("title"))
    totals = {
        "members": F.sum("n"), "tagged": F.sum(F.when(F.col("plain_album") != "", F.col("n")).otherwise(0)), "one_author": F.when(F.min("said") == F.max("said"), F.min("said")), "any_item": F.bool_or(F.col("item") == F.col("title")),
        "any_own": F.bool_or(own_name), "strays": F.bool_or(F.col("conflicting") | _conflict(F.col("title"))), "ties": F.bool_or("joined_titles"),
    }
    rows = with_group(rows, ["title", "part"], **totals)
    reason = M.first_match([
        ("duration-matched alternate representation joined to its source book", F.col("ties")), ("directory and filename identities conflict", (F.col("members") == 1) & F.col("strays")),
        ("long-form collection files split into individual books", F.col("any_item")), ("audiobook-sized containers split from a shared collection album", F.col("any_own")),
        ("tag and normalized path identity reconciled equivalent representations", (F.col("tagged") > 0) & (F.col("tagged") < F.col("members"))), ("embedded album identity grouped these files", F.col("tagged") > 0),
    ], "normalized directory/disc structure grouped untagged files")
    label = F.coalesce(F.nullif(F.concat_ws(" — ", "one_author", F.nullif(F.col("title"), F.lit(""))), F.lit("")), F.lit("unknown"))
    books = stored(rows.select(*CLASS, label.alias("group_key"), "title", "part", reason.alias("reason"), "rule"))
    return with_class(described_, known).join(books, CLASS).select("relative_path", "group_key", "title", "part", "reason", "rule")
