"""Provider candidates for a book, and delivery plans for devices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.dates import normalize_metadata_date
from foliant.functions.identifiers import clean_isbn, external_identifiers, format_identifiers, pair, parse_identifiers, valid_isbn
from foliant.functions.ordering import Key, running_sum
from foliant.functions.people import author_sort
from foliant.functions.text import let, lookup, strip

CATALOG_ROW = ("key string, title string, author_name array<string>, publisher array<string>, isbn array<string>, language array<string>, "
               "subject array<string>, first_publish_year int, publish_year array<int>, cover_i bigint")
VOLUME_ROW = ("id string, volumeInfo struct<title:string, subtitle:string, authors:array<string>, publisher:string, publishedDate:string, "
              "description:string, language:string, categories:array<string>, "
              "industryIdentifiers:array<struct<type:string, identifier:string>>, imageLinks:map<string,string>>")


def _list(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def first_filled(values: Column) -> Column:
    kept = F.filter(F.transform(_list(values), lambda v: strip(v)), lambda v: v != "")
    return F.coalesce(F.get(kept, F.lit(0)), F.lit(""))


def unique_trimmed(values: Column, limit: int | None = None) -> Column:
    """Trimmed values without repeats in any case, the first ``limit`` of them."""
    def firsts(items: Column) -> Column:
        low = F.transform(items, lambda v: F.lower(v))
        once = F.filter(items, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)
        return F.slice(once, 1, limit) if limit else once

    return let(F.filter(F.transform(_list(values), lambda v: strip(v)), lambda v: v != ""), firsts)


def normalize_catalog_rows(rows: DataFrame, subjects: int | None = None) -> DataFrame:
    """Candidates from open-catalogue search rows; ``rows`` is (query_id, idx, json).

    ``subjects`` keeps that many genres of a candidate; None keeps all.
    """
    # Inlined, a row is parsed once; as a plain column the filter would parse it again, before the rows are dealt over the cores.
    doc = rows.select("query_id", "idx", F.inline(F.array(F.from_json("json", CATALOG_ROW))))
    isbns = F.filter(F.transform(_list(F.col("isbn")), lambda v: clean_isbn(v)), lambda v: valid_isbn(v))
    ids = F.transform(F.slice(isbns, 1, 1), lambda v: pair("isbn", v))
    year = F.when(F.col("first_publish_year") > 0, F.col("first_publish_year")).otherwise(F.get("publish_year", F.lit(0)))
    return doc.where(F.coalesce(F.col("title"), F.lit("")) != "").select(
        "query_id", "idx", F.lit("openlibrary").alias("provider"), F.col("key").alias("provider_id"), F.col("title").alias("title"),
        unique_trimmed(F.col("author_name")).alias("authors"), first_filled(F.col("publisher")).alias("publisher"),
        F.coalesce(normalize_metadata_date(year.cast("string")), F.lit("")).alias("date"), first_filled(F.col("language")).alias("language"),
        format_identifiers(external_identifiers(ids)).alias("identifier"), unique_trimmed(F.col("subject"), subjects).alias("genres"),
        (F.coalesce(F.col("cover_i"), F.lit(0)) > 0).alias("has_cover"))


def normalize_volume_rows(rows: DataFrame, subjects: int | None = None) -> DataFrame:
    """Candidates from volume search rows; ``rows`` is (query_id, idx, json); ``subjects`` as above."""
    doc = rows.select("query_id", "idx", F.inline(F.array(F.from_json("json", VOLUME_ROW)))).select("query_id", "idx", "id", "volumeInfo.*")
    none = F.array().cast("array<struct<type:string,identifier:string>>")
    isbns = F.filter(F.coalesce("industryIdentifiers", none), lambda i: F.upper(strip(i["type"])).isin("ISBN_10", "ISBN_13") & valid_isbn(clean_isbn(i["identifier"])))
    ids = F.concat(F.transform(isbns, lambda i: pair("isbn", clean_isbn(i["identifier"]))),
                   F.filter(F.array(pair("google", F.coalesce("id", F.lit("")))), lambda i: i["value"] != ""))
    title, sub = strip(F.coalesce("title", F.lit(""))), strip(F.coalesce("subtitle", F.lit("")))
    full = F.when((sub != "") & ~title.contains(sub), F.concat(title, F.lit(": "), sub)).otherwise(title)
    covers = F.transform(F.array(*[F.lit(n) for n in ("extraLarge", "large", "medium", "small", "thumbnail", "smallThumbnail")]), lambda n: F.coalesce(F.col("imageLinks")[n], F.lit("")))
    return doc.where(full != "").select(
        "query_id", "idx", F.lit("google").alias("provider"), F.col("id").alias("provider_id"), full.alias("title"), unique_trimmed(F.col("authors")).alias("authors"),
        F.coalesce("publisher", F.lit("")).alias("publisher"), F.coalesce(normalize_metadata_date(F.col("publishedDate")), F.lit("")).alias("date"),
        F.coalesce("language", F.lit("")).alias("language"), format_identifiers(external_identifiers(ids)).alias("identifier"),
        unique_trimmed(F.col("categories"), subjects).alias("genres"), (first_filled(covers) != "").alias("has_cover"))


def contains_fold(text: Column, part: Column) -> Column:
    text, part = F.lower(strip(text)), F.lower(strip(part))
    return (text != "") & (part != "") & F.contains(text, part)


def score_candidates(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of each query by falling score: ISBN 70, title 18, author 12, cover 3; ties keep their order.

    ``queries`` is (query_id, isbn, title, author).
    """
    asked = queries.select("query_id", clean_isbn(F.coalesce("isbn", F.lit(""))).alias("q_isbn"), F.coalesce("title", F.lit("")).alias("q_title"),
                           F.coalesce("author", F.lit("")).alias("q_author"))
    rows = candidates.join(asked, "query_id")
    same_isbn = (F.col("q_isbn") != "") & F.exists(parse_identifiers(F.col("identifier")), lambda i: (i["type"] == "isbn") & (clean_isbn(i["value"]) == F.col("q_isbn")))
    same_title = contains_fold(F.col("title"), F.col("q_title")) | contains_fold(F.col("q_title"), F.col("title"))
    same_author = F.exists("authors", lambda a: contains_fold(a, F.col("q_author")) | contains_fold(F.col("q_author"), a))
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    score = points(same_isbn, 70) + points(same_title, 18) + points(same_author, 12) + points(F.col("has_cover"), 3)
    scored = rows.withColumn("score", score.cast("long"))
    placed = running_sum(scored, ["query_id"], [Key(F.col("score"), desc=True), Key(F.col("idx"))],
                         F.struct(-F.col("score"), F.floor(F.col("idx") / 4096)), F.lit(1), "place")
    return placed.select("query_id", "idx", (F.col("place") + 1).cast("long").alias("rn"), "score")


def author_metas(names: Column) -> Column:
    """array<struct<name, sort_name>> of unique author names."""
    return F.transform(unique_trimmed(names), lambda n: F.struct(n.alias("name"), author_sort(n).alias("sort_name")))


# --- delivery ------------------------------------------------------------------------

MB = 1024 * 1024
DEFAULT_LIMIT_MB, MESSAGE_OVERHEAD = 25, 4096
# Formats a device takes as they are, in order, and formats turned into EPUB for it.
DIRECT = {"kindle": ["epub", "pdf", "docx", "rtf", "txt", "html"],
          "pocketbook": ["epub", "fb2", "pdf", "mobi", "azw", "prc", "djvu", "docx", "rtf", "txt", "html", "cbz"]}
TEXTUAL = ["txt", "txtz", "markdown", "html", "xhtml", "htmlz", "mobi", "azw", "azw3", "prc", "pdb", "kfx"]
TO_EPUB = {"kindle": ["fb2", *TEXTUAL], "pocketbook": TEXTUAL}
TO_PDF = ["azw4"]


def preset_from_email(email: Column) -> Column:
    """The device family an address belongs to."""
    domain = F.regexp_extract(F.lower(strip(email)), r"(@[^@]*)$", 1)
    return F.when(domain.isin("@kindle.com", "@free.kindle.com", "@kindle.cn", "@free.kindle.cn"), F.lit("kindle")).when(
        domain == "@pbsync.com", F.lit("pocketbook")).otherwise(F.lit("generic"))


def encoded_size(raw: Column) -> Column:
    """Bytes of a mail attachment: base64 in 76-byte lines plus headers."""
    encoded = F.floor((raw + 2) / 3) * 4
    return F.when(raw <= 0, F.lit(0)).otherwise(encoded + F.floor((encoded + 75) / 76) * 2 + MESSAGE_OVERHEAD)


def plan_delivery(requests: DataFrame, assets: DataFrame, limit_mb: int = DEFAULT_LIMIT_MB) -> DataFrame:
    """The file to send for each request (request_id, book_id, preset), or why there is none.

    Every file gets the rank of its best use on the device - as it is, or
    converted - and the lowest rank wins, default files and low ids first. On
    Kindle an EPUB conversion comes before a fixed-page PDF. The best file of a
    book is found once for each kind of device; a request meets that one row.
    """
    limit = (limit_mb if limit_mb > 0 else DEFAULT_LIMIT_MB) * MB
    size = F.coalesce("current_size", "original_size", F.lit(0))
    kind, too_large = F.col("format"), (F.col("size") > 0) & (encoded_size(F.col("size")) > limit)
    best = {}
    for name, order in DIRECT.items():
        direct = lookup({f: str(10 * (i + 1)) for i, f in enumerate(order)}, kind).cast("int")
        late = F.when(kind.isin(*TO_EPUB[name]), 1000).when(kind.isin(*TO_PDF), 2000)
        if name == "kindle":
            early = [f for f in TO_EPUB[name] if f not in order]
            late = F.when(kind.isin(*early), 10 * order.index("pdf") + 15 - 10).otherwise(late)
        as_is = F.when(~F.col("too_large"), direct)
        rank = F.least(as_is, late)
        target = F.when(as_is.isNotNull() & (as_is <= F.coalesce(late, F.lit(9999))), F.lit("")).when(kind.isin(*TO_PDF), F.lit("pdf")).otherwise(F.lit("epub"))
        use = F.struct(rank.alias("rank"), (~F.col("is_primary")).alias("other"), "asset_id", "format", target.alias("target"))
        best[name] = F.struct(F.min(F.when(rank.isNotNull(), use)).alias("p"), F.bool_or(F.col("too_large") & direct.isNotNull()).alias("oversize"))
    files = assets.select("book_id", F.col("id").alias("asset_id"), "format", "is_primary", size.alias("size")).withColumn("too_large", too_large)
    uses = files.groupBy("book_id").agg(*[column.alias(f"for_{name}") for name, column in best.items()])
    mine = reduce(lambda rest, name: F.when(F.col("preset") == name, F.col(f"for_{name}")).otherwise(rest), DIRECT, F.lit(None))
    plans = requests.join(uses, "book_id", "left").select("request_id", mine.alias("mine")).groupBy("request_id").agg(
        F.min("mine.p").alias("p"), F.coalesce(F.bool_or("mine.oversize"), F.lit(False)).alias("oversize"))
    reason = F.when(F.col("p").isNotNull(), F.lit("")).when(F.col("oversize"), F.lit("too_large")).otherwise(F.lit("no_compatible_format"))
    return plans.select("request_id", "p.asset_id", "p.format", "p.target", reason.alias("reason"))
