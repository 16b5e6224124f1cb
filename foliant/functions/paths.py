"""Storage paths rendered from a template; the template is read once on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.people import author_sort
from foliant.functions.text import let, squeeze, strip

DEFAULT_TEMPLATE = "{author_bucket}/{author_sort}/{title} [a{asset_id}]{dot_ext}"
MAX_SEGMENT_BYTES = 255


def bucket(value: Column) -> Column:
    """Top folder of a sort key: its initial for Latin and Russian letters, 0-9, else a catch-all."""
    first = F.upper(F.substring(strip(value), 1, 1))
    return (
        F.when(first == "", F.lit("_Unknown")).when(first.rlike("^[A-ZА-ЯЁ]"), F.substring(first, 1, 1))
        .when(first.rlike("^[0-9]"), F.lit("0-9")).otherwise(F.lit("_Other"))
    )


def _default(value: Column, fallback: str, use: bool) -> Column:
    text = strip(value)
    return F.when(text == "", F.lit(fallback)).otherwise(text) if use else text


def _field(row: dict[str, Column], name: str, use: bool) -> Column:
    sort, author, series = strip(row["author_sort"]), row["author"], strip(row["series"])
    ext = F.lower(F.regexp_replace(strip(row["ext"]), r"^\.", ""))
    if name == "title":
        return _default(row["title"], "Untitled", use)
    if name == "sort_title":
        own = strip(row["sort_title"])
        return F.when(own == "", _default(row["title"], "Untitled", True)).otherwise(own) if use else own
    if name == "author":
        return _default(author, "Unknown Author", use)
    if name == "author_sort":
        if not use:
            return sort
        return F.when(sort != "", sort).otherwise(
            let(author_sort(author), lambda d: F.when(d != "", d).otherwise(F.lit("Unknown Author"))))
    if name == "author_bucket":
        filled = let(F.when(sort == "", author_sort(author)).otherwise(sort), bucket)
        return filled if use else F.when(sort == "", F.lit("")).otherwise(filled)
    if name == "series":
        return _default(row["series"], "_No Series", use)
    if name == "series_bucket":
        return F.when(series == "", F.lit("_No Series" if use else "")).otherwise(bucket(series))
    if name in ("series_index", "original_filename"):
        return strip(row[name])
    if name in ("asset_id", "book_id"):
        return row[name].cast("string")
    if name == "ext":
        return ext
    if name == "dot_ext":
        return F.when(ext == "", F.lit("")).otherwise(F.concat(F.lit("."), ext))
    raise ValueError(f"unknown book path field {name!r}")


# What ``safe_segment`` changes: signs to drop, white space that is no single space inside, a leading dot.
UNSAFE = r'[<>:"/\\|?*\p{Cc}]|[\p{Z}&&[^ ]]|  |^[. ]| $'


def safe_segment(text: Column) -> Column:
    def cleaned(raw: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(raw, r'[<>:"/\\|?*\x00]', ""), r"\p{Cc}", " ")
        return F.regexp_replace(squeeze(plain), r"^[. ]+", "")

    return let(text, lambda raw: F.when(raw.rlike(UNSAFE), cleaned(raw)).otherwise(raw))


def short_segment(text: Column) -> Column:
    """Keep both ends of names over 255 bytes, with 8 hash bytes between them."""
    raw = F.encode(text, "UTF-8")
    marker = F.concat(F.lit("~"), F.substring(F.sha2(raw, 256), 1, 16), F.lit("~"))
    head = (MAX_SEGMENT_BYTES - 18) // 2
    tail = MAX_SEGMENT_BYTES - 18 - head
    # Whole characters only: count how many fit from either end. A character has a byte or more, so no more than these can fit.
    sizes = lambda part: F.transform(F.split(part, ""), lambda c: F.octet_length(c))

    def fitting(items: Column, room: int) -> Column:
        start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))
        return F.aggregate(items, start, lambda s, b: F.struct(
            (s["used"] + b).alias("used"),
            (s["n"] + F.when(s["open"] & (s["used"] + b <= room), 1).otherwise(0)).alias("n"),
            (s["open"] & (s["used"] + b <= room)).alias("open")), lambda s: s["n"])

    first, last = fitting(sizes(F.left(text, F.lit(head))), head), fitting(F.reverse(sizes(F.right(text, F.lit(tail)))), tail)
    short = F.concat(F.substring(text, F.lit(1), first), marker, F.substring(text, F.length(text) - last + 1, last))
    return F.when(F.octet_length(text) > MAX_SEGMENT_BYTES, short).otherwise(text)


def render_book_path(template: str, row: dict[str, Column]) -> Column:
    """Relative path of a file; null where a segment renders empty.

    ``row`` maps title, sort_title, author, author_sort, series, series_index,
    asset_id, book_id, ext and original_filename to columns.
    """
    template = template.strip() or DEFAULT_TEMPLATE
    if template.startswith("/"):
        raise ValueError("book path template must be relative")
    segments = []
    for raw in template.split("/"):
        if not raw or re.sub(r"\{[^{}]*\}", "", raw).strip("{}") != re.sub(r"\{[^{}]*\}", "", raw):
            raise ValueError("book path template has an empty segment or an unmatched brace")
        parts = []
        for piece in re.findall(r"\{[^{}]*\}|[^{}]+", raw):
            if not piece.startswith("{"):
                parts.append(F.lit(piece))
                continue
            name, bar, fallback = piece[1:-1].partition("|")
            value = _field(row, name.strip(), not bar)
            parts.append(F.when(strip(value) == "", F.lit(fallback.strip())).otherwise(value) if bar else value)
        segments.append(let(safe_segment(F.concat(*parts)), lambda s: F.when(s != "", short_segment(s))))
    return let(F.array(*segments), lambda made: F.when(F.forall(made, lambda s: s.isNotNull()), F.array_join(made, "/")))
