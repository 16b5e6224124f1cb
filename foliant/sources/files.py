"""File-level ingest: discovery, grouping, hashing, duplicate checks, metadata overlay, intake gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.formats import book_extension, filename_metadata, known_extension
from foliant.functions.ordering import Key, previous_row, running_sum
from foliant.functions.people import author_sort
from foliant.functions.text import let, strip
from foliant.session import written

SAMPLE = 1024
# Sampled offsets 0, 1K, 4K, ... 1G, the sidecar names and the ignored suffixes.
OFFSETS = [0, *[SAMPLE << (2 * i) for i in range(0, 11)]]
SIDECARS = ("metadata.opf", "cover.jpg", "cover.jpeg", "cover.png", "cover.webp", "cover.gif")
IGNORED = (".tmp", ".part", ".crdownload")


def list_files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(path, size, mtime[, content]) of all files below a folder; content is only read when asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    columns = [F.regexp_replace("path", "^file:", "").alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime")]
    return files.select(*columns, *(["content"] if content else []))


def scan_folder(files: DataFrame) -> DataFrame:
    """(path, source_group, is_group, skipped): known book files, grouped where a folder holds metadata.opf.

    Below such a folder nothing else is discovered; unknown leaves are skipped.
    """
    name = F.substring_index("path", "/", -1)
    folder = F.substring(F.col("path"), F.lit(1), F.length("path") - F.length(name) - 1)
    rows = files.select("path", folder.alias("folder"), name.alias("name"), (known_extension(name) != "").alias("is_book"))
    groups = rows.groupBy("folder").agg(F.bool_or(F.col("name") == "metadata.opf").alias("opf"), F.bool_or("is_book").alias("books")).where("opf AND books")
    # A folder belongs to the topmost group folder above it (paths are shallow).
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = rows.select("folder").distinct().select("folder", F.posexplode(above).alias("depth", "up"))
    owner = folders.join(groups.select(F.col("folder").alias("up")), "up").groupBy("folder").agg(F.min_by("up", "depth").alias("owner"))
    placed = rows.join(owner, "folder", "left")
    direct = F.col("owner") == F.col("folder")
    kept = placed.where(F.col("owner").isNull() | direct)
    return kept.where(F.col("owner").isNull() | F.col("is_book")).select(
        "path", F.coalesce("owner", "path").alias("source_group"), F.col("owner").isNotNull().alias("is_group"), (~F.col("is_book")).alias("skipped"))


def intake_candidate(path: Column) -> Column:
    """False for hidden, half-written and sidecar files in an incoming folder."""
    name = F.substring_index(path, "/", -1)
    low = F.lower(name)
    ignored = name.startswith(".") | low.isin(*SIDECARS)
    for suffix in IGNORED:
        ignored = ignored | low.endswith(suffix)
    return ~ignored


def content_hash(content: Column) -> Column:
    """Content identity: the first 16 bytes of SHA-256 as hex text."""
    return F.substring(F.sha2(content, 256), 1, 32)


def sampled_md5(content: Column) -> Column:
    """Sync identity: MD5 over 1024-byte samples at offsets 0, 1K, 4K, 16K, ... 1G."""
    return F.md5(F.concat(*[F.substring(content, off + 1, SAMPLE) for off in OFFSETS]))


def dedupe_import(candidates: DataFrame, assets: DataFrame, books: DataFrame) -> DataFrame:
    """Outcome per candidate (id, size, hash): imported, duplicate, or duplicate of a trashed book.

    Of candidates with equal bytes that the catalogue doesn't know, the one with the
    smallest id is imported and the others are duplicates of it, without an asset yet.
    A match needs a known size and a known hash, the original or the current one. Hashes are
    by far the widest keys: candidates are shuffled with theirs once, to meet each other and
    the assets; what matched goes on without them, to its size and its book.
    """
    own = assets.select("id", "book_id", "original_hash", "current_hash", "original_size", "current_size")
    sizes = own.select(F.explode(F.array_distinct(F.array("original_size", "current_size"))).alias("size")).where("size IS NOT NULL").distinct()
    hashes = own.select(F.explode(F.array_distinct(F.array("original_hash", "current_hash"))).alias("hash"), F.col("id").alias("asset_id"), "book_id")
    first = hashes.where("hash IS NOT NULL").groupBy("hash").agg(F.min_by("book_id", "asset_id").alias("book_id"), F.min("asset_id").alias("asset_id"))
    equal = candidates.select("id", "size", "hash", F.when(F.col("hash").isNotNull(), F.min("id").over(Window.partitionBy("hash"))).alias("first_id"))
    met = written(equal.join(first, "hash", "left").select("id", "size", "first_id", "asset_id", "book_id"))
    trash = books.select(F.col("id").alias("book_id"), F.col("deleted_at").isNotNull().alias("trashed"))
    known = met.where("book_id IS NOT NULL").join(sizes, "size", "left_semi").join(trash, "book_id").select("id", "asset_id", "book_id", "trashed")
    return met.select("id", "first_id").join(known, "id", "left").select(
        "id", F.when(F.col("asset_id").isNull(), F.when(F.col("first_id") < F.col("id"), F.lit("duplicate")).otherwise(F.lit("imported"))).when(F.col("trashed"), F.lit("duplicate_trashed")).otherwise(F.lit("duplicate")).alias("status"),
        "asset_id", "book_id")


def resolve_groups(sources: DataFrame, assets: DataFrame, books: DataFrame) -> DataFrame:
    """How each group of files attaches: new book, known book (restored if trashed and bytes are new), or conflict.

    ``sources`` is (group_id, source_id, hash); repeated bytes in a group count once.
    """
    known = assets.select(F.explode(F.array_distinct(F.array("original_hash", "current_hash"))).alias("hash"), "book_id").groupBy("hash").agg(
        F.min("book_id").alias("book_id"))
    once = sources.groupBy("group_id", "hash").agg(F.count(F.lit(1)).alias("copies"))
    rows = once.join(known, "hash", "left")
    groups = rows.groupBy("group_id").agg(
        F.count_if(F.col("book_id").isNull()).alias("new_files"), F.sum(F.col("copies") - 1).alias("repeats"),
        F.min("book_id").alias("book_id"), F.max("book_id").alias("other"))
    trash = books.select(F.col("id").alias("book_id"), F.col("deleted_at").isNotNull().alias("trashed"))
    judged = groups.join(trash, "book_id", "left")
    outcome = (
        F.when(F.col("other") != F.col("book_id"), F.lit("conflict")).when(F.col("book_id").isNull(), F.lit("new_book"))
        .when(F.col("new_files") == 0, F.lit("all_known")).otherwise(F.lit("attached"))
    )
    return judged.select("group_id", outcome.alias("outcome"), F.when(F.col("other") == F.col("book_id"), F.col("book_id")).alias("book_id"),
                         "new_files", "repeats", (F.coalesce("trashed", F.lit(False)) & (outcome == "attached")).alias("restored"))


def resolve_source_metadata(sources: DataFrame) -> DataFrame:
    """Overlay embedded, sidecar and file-name metadata field by field.

    Input: id, filename and, each for ``e_`` (embedded) and ``s_`` (sidecar),
    title, sort_title, authors (array), identifier, tags (array or null).
    A sidecar with title and authors replaces everything embedded; a sidecar
    tag list counts even when empty.
    """
    text = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    listed = lambda c: F.when(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0, F.col(c))
    complete = text("s_title").isNotNull() & listed("s_authors").isNotNull()

    def pick(side: Column, own: Column) -> Column:
        return F.when(complete, side).otherwise(F.coalesce(side, own))

    base = F.substring_index("filename", "/", -1)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(book_extension(base)))
    rows = sources.withColumn("f", filename_metadata(F.col("filename")))
    title = F.coalesce(pick(text("s_title"), text("e_title")), F.col("f.title"), stem)
    authors = F.coalesce(pick(listed("s_authors"), listed("e_authors")), F.when(F.col("f").isNotNull(), F.array("f.author")), F.array().cast("array<string>"))
    identifier = F.coalesce(pick(text("s_identifier"), text("e_identifier")), F.col("f.identifier"), F.lit(""))
    return rows.select(
        "id", title.alias("title"), F.coalesce(pick(text("s_sort_title"), text("e_sort_title")), title).alias("sort_title"),
        authors.alias("authors"), let(authors, lambda a: F.transform(a, lambda n: author_sort(n))).alias("author_sorts"),
        identifier.alias("identifier"), pick(F.col("s_tags"), F.col("e_tags")).alias("tags"))


def resolve_added_at(stamp: Column, mtimes: Column, now: Column) -> Column:
    """Seconds: a plausible sidecar timestamp, else the earliest plausible file time, else now."""
    iso = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"
    told = F.when(strip(stamp).rlike(iso), F.unix_timestamp(F.try_to_timestamp(strip(stamp))))
    plausible = lambda t: (t > 0) & (t <= now)
    return F.coalesce(F.when(plausible(told), told), F.array_min(F.filter(mtimes, plausible)), now)


def stability_gate(scans: DataFrame, n: int) -> DataFrame:
    """(path, fingerprint, released_at): first scan at which a file was seen unchanged ``n`` times in a row.

    ``scans`` is (scan, path, fingerprint), scans counted from 0; a scan
    without the path forgets it.
    """
    keys, order, slices = ["path"], [Key(F.col("scan"))], F.floor(F.col("scan") / 4096)
    seen = previous_row(scans.select("scan", "path", "fingerprint"), keys, order, slices, ["scan", "fingerprint"], "before")
    same = (F.col("before.scan") == F.col("scan") - 1) & (F.col("before.fingerprint") == F.col("fingerprint"))
    marked = seen.withColumn("starts", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).drop("before")
    runs = running_sum(marked, keys, order, slices, F.col("starts"), "earlier").withColumn("run", F.col("earlier") + F.col("starts"))
    spans = runs.groupBy("path", "run", "fingerprint").agg(F.min("scan").alias("a"), F.max("scan").alias("z"))
    return spans.where(F.col("z") - F.col("a") + 1 >= n).select("path", "fingerprint", (F.col("a") + n - 1).alias("released_at"))
