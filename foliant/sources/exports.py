"""Sinks: annotation collections as JSON-LD and as Markdown, one document per book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.ordering import Key, running_sum
from foliant.functions.text import strip


def _rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def annotation_json(library: str) -> Column:
    """One Web Annotation: text-quote selector, refined page fragment for page locators, optional comment."""
    quote = F.struct(F.lit("TextQuoteSelector").alias("type"), F.col("quote").alias("exact"),
                     F.coalesce("context_before", F.lit("")).alias("prefix"), F.coalesce("context_after", F.lit("")).alias("suffix"))
    page = F.struct(F.lit("FragmentSelector").alias("type"), F.concat(F.lit("page="), F.col("page").cast("string")).alias("value"),
                    F.lit("http://tools.ietf.org/rfc/rfc3778").alias("conformsTo"), quote.alias("refinedBy"))
    source = F.concat(F.lit(f"urn:{library}:asset:"), F.col("asset_id").cast("string"))
    target = lambda selector: F.struct(F.lit("SpecificResource").alias("type"), F.struct(source.alias("id")).alias("source"), selector.alias("selector"))
    body = F.when(F.coalesce("note", F.lit("")) != "", F.struct(
        F.lit("TextualBody").alias("type"), F.col("note").alias("value"), F.lit("text/plain").alias("format"), F.lit("commenting").alias("purpose")))

    def document(selector: Column) -> Column:
        return F.to_json(F.struct(
            F.concat(F.lit(f"urn:{library}:annotation:"), F.col("id").cast("string")).alias("id"), F.lit("Annotation").alias("type"),
            F.lit("highlighting").alias("motivation"), _rfc3339(F.col("created_at")).alias("created"), _rfc3339(F.col("updated_at")).alias("modified"),
            target(selector).alias("target"), body.alias("body"), F.col("color").alias("color"), F.col("revision").alias("revision")))

    return F.when(F.col("page") > 0, document(page)).otherwise(document(quote))


def numbered(annotations: DataFrame) -> DataFrame:
    """Live annotations with their 0-based place in their book: by file, then creation, then id."""
    return running_sum(annotations.where("deleted = 0"), ["book_id"], [Key(F.col("asset_id")), Key(F.col("created_at")), Key(F.col("id"))],
                       F.struct("asset_id", F.floor(F.col("created_at") / 86400)), F.lit(1), "place")


def export_annotations_jsonld(annotations: DataFrame, library: str) -> DataFrame:
    """(book_id, place, total, item): items of each book's collection page in order.

    Items stay rows; :func:`collection_head` gives the lines around them, and
    ``write`` with ``partitionBy('book_id')`` puts a collection in one folder.
    """
    totals = annotations.where("deleted = 0").groupBy("book_id").agg(F.count(F.lit(1)).alias("total"))
    return numbered(annotations).join(totals, "book_id").select(
        "book_id", F.col("place").cast("long").alias("place"), "total", annotation_json(library).alias("item"))


def collection_head(annotations: DataFrame, library: str) -> DataFrame:
    """(book_id, head): the collection document around a book's items."""
    own = F.concat(F.lit(f"urn:{library}:annotations:"), F.col("book_id").cast("string"))
    counts = annotations.groupBy("book_id").agg(F.count_if(F.col("deleted") == 0).alias("total"))
    first = F.when(F.col("total") > 0, F.struct(F.concat(own, F.lit(":page:1")).alias("id"), F.lit("AnnotationPage").alias("type"), F.lit(0).alias("startIndex")))
    return counts.select("book_id", F.to_json(F.struct(
        F.lit("http://www.w3.org/ns/anno.jsonld").alias("@context"), own.alias("id"), F.lit("AnnotationCollection").alias("type"),
        F.col("total"), first.alias("first"))).alias("head"))


def escape_markdown(text: Column) -> Column:
    plain = F.regexp_replace(text, "\r\n?", "\n")
    return F.replace(F.replace(F.regexp_replace(plain, r"([\\`*_\[\]])", r"\\$1"), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def quote_lines(text: Column) -> Column:
    return F.replace(F.concat(F.lit("> "), F.replace(escape_markdown(text), F.lit("\n"), F.lit("\n> ")), F.lit("\n")), F.lit("> \n"), F.lit(">\n"))


def export_annotations_markdown(annotations: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, place, block): each book's Markdown in blocks, the heading block at place -1."""
    stamp = lambda c: F.date_format(F.timestamp_seconds(c), "d MMM yyyy, HH:mm 'UTC'")
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("\n### Note\n\n"), escape_markdown(F.col("note")), F.lit("\n"))).otherwise(F.lit(""))
    updated = F.when(F.col("updated_at") > F.col("created_at"), F.concat(F.lit(" · Updated "), stamp("updated_at"))).otherwise(F.lit(""))
    block = F.concat(
        F.lit("\n## Highlight "), (F.col("place") + 1).cast("string"), F.lit("\n\n"), quote_lines(F.col("quote")), note,
        F.lit("\nHighlighted "), stamp("created_at"), updated, F.lit("\n\nColor: "), escape_markdown(F.col("color")), F.lit("\n"))
    items = numbered(annotations).select("book_id", F.col("place").cast("long").alias("place"), block.alias("block"))
    counts = annotations.groupBy("book_id").agg(F.count_if(F.col("deleted") == 0).alias("n"))
    titled = counts.join(books.select(F.col("id").alias("book_id"), strip(F.col("title")).alias("title")), "book_id", "left")
    summary = F.when(F.col("n") == 0, F.lit("No highlights")).when(F.col("n") == 1, F.lit("1 highlight")).otherwise(
        F.concat(F.col("n").cast("string"), F.lit(" highlights")))
    title = F.when(F.coalesce("title", F.lit("")) == "", F.lit("Untitled")).otherwise(F.col("title"))
    head = F.concat(F.lit("# "), escape_markdown(title), F.lit("\n\n"), summary, F.lit("\n"),
                    F.when(F.col("n") == 0, F.lit("\n_No highlights or notes for this book._\n")).otherwise(F.lit("")))
    return items.unionByName(titled.select("book_id", F.lit(-1).cast("long").alias("place"), head.alias("block")))
