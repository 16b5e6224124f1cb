"""Choosing one value among a package's records: contributors, series, dates, pages, subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.dates import normalize_metadata_date
from foliant.functions.formats import FIXED_PAGES
from foliant.functions.ordering import Key, running_sum
from foliant.functions.tagging import first_spellings, normalize_tag_list, normalize_tag_name
from foliant.functions.text import let, lookup, strip

AUTHOR_ROLES, EDITOR_ROLES = ("aut", "author"), ("edt", "editor")
DATE_EVENTS = {"publication": "1", "": "2", "original-publication": "3", "ops-publication": "4"}
# Page-count declarations in order of preference.
PAGE_KEYS = ["schema:numberofpages", "#pages", "#pagecount", "#page_count", "bookorbit:page_count"]
COLUMN_PREFIX = "calibre:user_metadata:"


def plain_role(role: Column) -> Column:
    return F.substring_index(F.lower(strip(role)), ":", -1)


def creator_role(own: Column, refined: Column) -> Column:
    """The attribute role, else an author among the refinements, else an editor, else the first."""
    roles = F.filter(F.transform(F.coalesce(refined, F.array().cast("array<string>")), lambda r: plain_role(r)), lambda r: r != "")
    authors = F.filter(roles, lambda r: r.isin(*AUTHOR_ROLES))
    editors = F.filter(roles, lambda r: r.isin(*EDITOR_ROLES))
    return F.when(plain_role(own) != "", plain_role(own)).otherwise(
        F.coalesce(F.get(authors, F.lit(0)), F.get(editors, F.lit(0)), F.get(roles, F.lit(0)), F.lit("")))


def select_contributors(creators: DataFrame) -> DataFrame:
    """Ordered authors per book: author roles, else unroled, else editors.

    Input (book_id, idx, name, file_as, role, refined_roles, display_seq).
    Numbered creators come first; a combined ``A & B`` sort form is dropped.
    """
    role = creator_role(F.coalesce("role", F.lit("")), F.col("refined_roles"))
    rank = F.when(role.isin(*AUTHOR_ROLES), 1).when(role == "", 2).when(role.isin(*EDITOR_ROLES), 3)
    file_as = strip(F.coalesce("file_as", F.lit("")))
    rows = creators.select(
        "book_id", "idx", strip(F.col("name")).alias("name"), "display_seq", role.alias("role"), rank.alias("rank"),
        F.when(file_as.contains(" & "), F.lit("")).otherwise(file_as).alias("sort_name"),
    ).where("name <> '' AND rank IS NOT NULL")
    best = rows.groupBy("book_id").agg(F.min("rank").alias("best"))
    kept = rows.join(best, "book_id").where("rank = best")
    late = F.col("display_seq").isNull()
    keys = [Key(late), Key(F.col("display_seq")), Key(F.col("idx"))]
    slices = F.struct(late, F.floor(F.coalesce("display_seq", "idx") / 4096))
    return running_sum(kept, ["book_id"], keys, slices, F.lit(1), "place").select(
        "book_id", F.col("place").cast("long").alias("place"), "name", "sort_name", "role")


def select_series(collections: DataFrame) -> DataFrame:
    """First collection typed series, else the first untyped one with a position.

    Input (book_id, idx, name, collection_type, position).
    """
    kind = F.coalesce("collection_type", F.lit(""))
    rank = F.when(kind == "series", 1).when((kind == "") & F.col("position").isNotNull(), 2)
    rows = collections.withColumn("rank", rank).where((strip(F.col("name")) != "") & F.col("rank").isNotNull())
    return rows.groupBy("book_id").agg(
        F.min_by(F.struct(strip(F.col("name")).alias("series"), F.coalesce("position", F.lit(0.0)).alias("series_index")),
                 F.struct("rank", "idx")).alias("s")).select("book_id", "s.series", "s.series_index")


def select_publication_date(dates: DataFrame) -> DataFrame:
    """First readable date of the best event kind. Input (book_id, idx, text, event)."""
    rank = lookup(DATE_EVENTS, F.lower(strip(F.coalesce("event", F.lit("")))))
    rows = dates.select("book_id", "idx", rank.alias("rank"), normalize_metadata_date(F.col("text")).alias("date"))
    return rows.where("rank IS NOT NULL AND date <> ''").groupBy("book_id").agg(
        F.min_by("date", F.struct("rank", "idx")).alias("published_date"))


def positive_count(text: Column) -> Column:
    number = strip(text).try_cast("int")
    return F.when(strip(text).rlike(r"^[+-]?[0-9]+$") & (number > 0), number)


def _column_count(raw: Column) -> Column:
    return positive_count(F.get_json_object(raw, "$['#value#']"))


def select_page_count(metas: DataFrame) -> DataFrame:
    """Declared page count per book: canonical property, then custom columns in order, then the vendor key.

    Input (book_id, idx, key, value, refines); refined metas are ignored.
    """
    key = F.lower(strip(F.col("key")))
    column = F.when(key.startswith(COLUMN_PREFIX), F.substr(key, F.lit(len(COLUMN_PREFIX) + 1)))
    single = F.struct(F.coalesce(column, key).alias("name"),
                      F.when(column.isNotNull(), _column_count(F.col("value"))).otherwise(positive_count(F.col("value"))).alias("count"))
    whole = F.array(*[
        F.struct(F.lit(name).alias("name"), _column_count(F.get_json_object("value", f"$['{name}']")).alias("count"))
        for name in PAGE_KEYS[1:4]])
    found = F.when(key == COLUMN_PREFIX[:-1], whole).otherwise(F.array(single))
    rank = lookup({name: str(i) for i, name in enumerate(PAGE_KEYS)}, F.col("f.name"))
    rows = metas.where(F.coalesce(strip(F.col("refines")), F.lit("")) == "").select("book_id", "idx", F.explode(found).alias("f"))
    ranked = rows.select("book_id", "idx", rank.alias("rank"), F.col("f.count").alias("count")).where("rank IS NOT NULL AND count IS NOT NULL")
    return ranked.groupBy("book_id").agg(F.min_by("count", F.struct("rank", "idx")).cast("long").alias("page_count"))


def choose_page_count(format_key: Column, file_pages: Column, sidecar_pages: Column, fixed_layout: Column) -> Column:
    """Structural counts beat a sidecar; a sidecar beats counts declared in reflowable files."""
    none = F.coalesce(sidecar_pages, F.lit(0)) == 0
    return (
        F.when(none | fixed_layout | format_key.isin(*FIXED_PAGES), file_pages)
        .when(format_key.isin("epub", "kepub", "fb2"), sidecar_pages)
        .when(file_pages == 0, sidecar_pages).otherwise(file_pages)
    )


def column_values(raw: Column) -> Column:
    """Names in a custom column's JSON: a list, or one comma text; null if neither."""
    listed = F.from_json(raw, "struct<`#value#`:array<string>>")["#value#"]
    text = F.get_json_object(raw, "$['#value#']")
    names = first_spellings(F.filter(F.transform(F.flatten(F.transform(listed, lambda v: F.split(v, ","))),
                                                 lambda n: normalize_tag_name(n)), lambda n: n != ""))
    return F.when(listed.isNotNull(), names).when(text.isNotNull(), normalize_tag_list(text))


def classify_subjects(subjects: Column, genre_json: Column, extra_json: Column) -> Column:
    """struct(genres, tags): subjects are tags beside a genre column, else genres; null tags mean unknown."""
    names = first_spellings(F.filter(F.transform(F.flatten(F.transform(subjects, lambda v: F.split(v, ","))),
                                                 lambda n: normalize_tag_name(n)), lambda n: n != ""))
    genres, extra = column_values(genre_json), column_values(extra_json)
    merged = first_spellings(F.concat(names, F.coalesce(extra, F.array().cast("array<string>"))))
    return (
        F.when(genres.isNotNull(), F.struct(genres.alias("genres"), merged.alias("tags")))
        .when(extra.isNotNull(), F.struct(names.alias("genres"), extra.alias("tags")))
        .otherwise(F.struct(names.alias("genres"), F.lit(None).cast("array<string>").alias("tags")))
    )


def merge_overrides(stored: Column, fields: Column) -> Column:
    """Add edited field names to the stored JSON object; keys come out sorted, bad JSON counts as empty."""
    current = F.coalesce(F.from_json(stored, "map<string,boolean>"), F.expr("map()").cast("map<string,boolean>"))
    added = F.map_from_entries(F.transform(F.array_distinct(fields), lambda f: F.struct(f, F.lit(True))))
    kept = F.map_filter(current, lambda k, v: ~F.array_contains(fields, k) & v.isNotNull())

    def ordered(m: Column) -> Column:
        return F.to_json(F.map_from_entries(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k, m[k]))))

    return let(F.map_concat(kept, added), ordered)
