"""Text and page corpus jobs built from the column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import markup
from foliant.functions.dates import normalize_metadata_date
from foliant.functions.identifiers import format_identifiers, identifier_from_scheme, is_internal
from foliant.functions.language import normalize_language
from foliant.functions.ordering import Key, running_sum
from foliant.functions.people import parse_author_list
from foliant.functions.prose import heading_lines, heading_slug, paragraphs, search_in_text, sentences
from foliant.functions.text import lookup, strip


def exploded(docs: DataFrame, key: str, items: Column, name: str) -> DataFrame:
    """One row per array item with its 0-based place."""
    return docs.select(key, F.posexplode(items).alias("place", name)).withColumn("place", F.col("place").cast("long"))


def paragraph_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return exploded(docs, key, paragraphs(F.col(text)), "paragraph")


def sentence_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return exploded(docs, key, sentences(F.col(text)), "sentence")


def outline(docs: DataFrame, key: str, headings: Column) -> DataFrame:
    """Headings in document order with unique anchor ids; repeated slugs are numbered from 2.

    ``headings`` is array<struct<line, level, title>>.
    """
    rows = docs.select(key, F.explode(headings).alias("h")).select(key, "h.line", "h.level", "h.title")
    slug = heading_slug(F.col("title"))
    named = rows.withColumn("slug", F.when(slug == "", F.concat(F.lit("heading-"), F.col("line").cast("string"))).otherwise(slug))
    counted = running_sum(named, [key, "slug"], [Key(F.col("line"))], F.floor(F.col("line") / 65536), F.lit(1), "before")
    anchor = F.when(F.col("before") == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), (F.col("before") + 1).cast("string")))
    return counted.select(key, "line", "level", "title", anchor.alias("anchor"))


def html_headings(source: Column) -> Column:
    """array<struct<line, level, title>> of h1-h6 elements, the place standing in for the line."""
    found = F.regexp_extract_all(source, F.lit(r"(?is)(<h[1-6]\b[^>]*>.*?</h[1-6]\s*>)"), F.lit(1))
    return F.transform(found, lambda h, i: F.struct(
        i.cast("long").alias("line"), F.regexp_extract(h, r"(?i)^<h([1-6])", 1).cast("long").alias("level"),
        strip(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", ""), r"\s+", " ")).alias("title")))


def search_in_book(pages: DataFrame, key: str, text: str, q: str) -> DataFrame:
    """Literal matches per page with context, per page."""
    return pages.select(key, F.explode(search_in_text(F.col(text), q)).alias("m")).select(key, "m.at", "m.pre", "m.match", "m.post")


def html_metadata(pages: DataFrame, key: str, source: str) -> DataFrame:
    """Title, authors, publisher, language, description, date, series, tags and identifiers per page.

    Attributes of comments beat meta tags; within a source the earlier value wins.
    """
    html = F.col(source)
    stated = pages.select(key, F.posexplode(markup.declarations(html)).alias("n", "d"))
    attributes = stated.select(key, "d.rank", "n", F.posexplode(
        F.regexp_extract_all("d.src", F.lit(markup.ATTRIBUTE), F.lit(1))).alias("i", "attr"))
    pairs = attributes.select(key, "rank", "n", "i", F.lower(F.regexp_extract("attr", markup.ONE_ATTRIBUTE, 1)).alias("name"),
                              markup.inline_text(F.regexp_extract("attr", markup.ONE_ATTRIBUTE, 2)).alias("value"))
    meta = pairs.where("rank = 1").groupBy(key, "rank", "n").agg(
        *[F.max_by("value", F.when(F.col("name") == a, F.col("i"))).alias(a) for a in ("name", "property", "content", "scheme")])
    called = F.lower(strip(F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(F.col("property"))))
    dotted = F.replace(called, F.lit(":"), F.lit("."))
    scheme = F.lower(strip(F.coalesce("scheme", F.lit(""))))
    identifier = F.when(dotted.isin("dc.identifier", "dcterms.identifier") & (scheme != ""), scheme).otherwise(
        strip(F.regexp_extract(dotted, r"^(?:dc|dcterms)\.identifier\.(.*)$", 1)))
    field = F.coalesce(lookup(markup.META_FIELDS, dotted), F.when(identifier != "", F.concat(F.lit("identifier:"), identifier)))
    from_meta = meta.select(key, "rank", "n", F.lit(0).alias("i"), field.alias("field"), strip(F.col("content")).alias("value"))
    from_notes = pairs.where("rank = 0").select(key, "rank", "n", "i", lookup(markup.COMMENT_FIELDS, F.col("name")).alias("field"), "value")
    values = from_meta.unionByName(from_notes).where("field IS NOT NULL AND value <> ''")
    best = values.groupBy(key, "field").agg(F.min("rank").alias("best"))
    kept = values.join(best, [key, "field"]).where("rank = best")
    place = F.struct("n", "i")
    # The values of one page: a handful of attributes.
    fields = kept.groupBy(key).agg(
        *[F.min_by("value", F.when(F.col("field") == f, place)).alias(f) for f in ("title", "publisher", "language", "description", "date", "series", "series_index")],
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("n", "i", "value")))), lambda s: s["value"]).alias(f) for f in ("authors", "tags")],
        F.collect_list(F.when(F.col("field").startswith("identifier:"), F.struct("field", "n", "value"))).alias("ids"))
    rank = lambda f: F.when(f == "identifier:isbn", 0).when(f == "identifier:doi", 1).when(f == "identifier:url", 2).otherwise(100)
    ordered = F.array_sort(F.transform("ids", lambda s: F.struct(rank(s["field"]).alias("rank"), s["field"].alias("field"), s["n"].alias("n"), s["value"].alias("value"))))
    firsts = F.filter(ordered, lambda s, i: (i == 0) | (F.get(ordered, i - 1)["field"] != s["field"]))
    typed = F.filter(F.transform(firsts, lambda s: identifier_from_scheme(F.substr(s["field"], F.lit(12)), s["value"])),
                     lambda i: (i["value"] != "") & ~is_internal(i))
    none = F.array().cast("array<string>")
    joined = pages.select(key, markup.inline_text(markup.page_title(html)).alias("page_title")).join(fields, key, "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return joined.select(
        key, F.coalesce("title", "page_title").alias("title"),
        F.array_join(F.flatten(F.transform(F.coalesce("authors", none), lambda a: parse_author_list(a))), "; ").alias("authors"),
        text("publisher").alias("publisher"), normalize_language(text("language")).alias("language"), text("description").alias("description"),
        normalize_metadata_date(text("date")).alias("date"), text("series").alias("series"),
        F.coalesce(F.col("series_index").try_cast("double"), F.lit(0.0)).alias("series_index"),
        F.array_join(F.filter(F.transform(F.flatten(F.transform(F.coalesce("tags", none), lambda t: F.split(t, ","))), lambda t: strip(t)), lambda t: t != ""), ", ").alias("tags"),
        F.coalesce(format_identifiers(typed), F.lit("")).alias("identifiers"))
