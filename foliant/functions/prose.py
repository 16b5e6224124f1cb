"""Plain text: decoding, cleaning, paragraphs, sentences, headings, page estimates, literal search."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.dates import normalize_metadata_date
from foliant.functions.language import normalize_language
from foliant.functions.people import parse_author_list
from foliant.functions.text import SPACE, let, squeeze, strip

PAGE_COLUMNS, PAGE_LINES = 70, 36
CONTEXT = 72
TERMINATORS, CLOSERS = ".!?…。！？", "'\"”’“)]}"
LABELS = ("title", "author", "authors", "year", "date", "language", "lang")


def _upper_half(codec: str) -> str:
    """The characters of bytes 80-FF; bytes a code page leaves open stay control characters."""
    return "".join(bytes([b]).decode(codec, errors="ignore") or chr(b) for b in range(0x80, 0x100))


_BYTES = "".join(chr(b) for b in range(0x80, 0x100))
_CP1252, _CP1251 = _upper_half("cp1252"), _upper_half("cp1251")


def _legacy_score(text: Column) -> Column:
    """How much a decoding looks like prose: letters and spaces count for it, control characters against it."""
    cyrillic = F.regexp_count(text, F.lit(r"\p{IsCyrillic}"))
    run = text.rlike(r"\p{IsCyrillic}{3}")
    return (
        F.regexp_count(text, F.lit(r"[\p{L}\p{Nd}]")) * 3 - F.regexp_count(text, F.lit(r"\p{Cc}")) * 10
        + F.regexp_count(text, F.lit(r"[  ]")) * 2 + F.regexp_count(text, F.lit(r"\p{P}"))
        + F.when(run, cyrillic * 4).otherwise(-cyrillic * 6)
    )


def decode_text(raw: Column) -> Column:
    """Bytes to text: byte-order marks, valid UTF-8, else the better of two single-byte code pages."""
    mark = F.hex(F.substring(raw, 1, 3))
    even = F.length(raw) - F.length(raw) % 2

    def wide(codec: str) -> Column:
        text = F.decode(F.substring(raw, F.lit(3), even - 2), codec)
        return F.when(F.length(raw) % 2 == 1, F.concat(text, F.lit("�"))).otherwise(text)

    flat = F.decode(raw, "ISO-8859-1")
    latin, russian = F.translate(flat, _BYTES, _CP1252), F.translate(flat, _BYTES, _CP1251)
    legacy = F.when(_legacy_score(russian) > _legacy_score(latin), russian).otherwise(latin)
    return (
        F.when(mark == "EFBBBF", F.make_valid_utf8(F.substring(raw, F.lit(4), F.length(raw)).cast("string")))
        .when(mark.startswith("FFFE"), wide("UTF-16LE")).when(mark.startswith("FEFF"), wide("UTF-16BE"))
        .when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(legacy)
    )


def line_endings(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def clean_text(text: Column) -> Column:
    """Unix line endings, no control characters but tab and newline."""
    return F.regexp_replace(line_endings(text), r"[\x00-\x08\x0b-\x1f]", "")


def paragraphs(text: Column) -> Column:
    """Array of paragraphs: blank-line blocks, or single lines where every line ends like a sentence.

    The second reading needs six lines or more, none blank in between, two
    thirds of them ending in sentence punctuation.
    """
    body = clean_text(text)
    inner = F.regexp_replace(body, rf"^(?:{SPACE}*\n)+|(?:\n{SPACE}*)+$", "")

    def read(t: Column) -> Column:
        lines = F.split(t, "\n")
        full = ~F.exists(lines, lambda s: strip(s) == "")
        ended = F.size(F.filter(lines, lambda s: F.regexp_replace(strip(s), r"""[ '"”’)\]}]+$""", "").rlike(r"[.!?:;]$")))
        by_line = (F.size(lines) >= 6) & full & (ended * 3 >= F.size(lines) * 2)
        blocks = F.transform(F.split(t, rf"\n(?:{SPACE}*\n)+"),
                             lambda b: F.array_join(F.transform(F.split(b, "\n"), lambda s: F.regexp_replace(s, r"[ \t]+$", "")), " "))
        own = F.transform(lines, lambda s: strip(s))
        return F.filter(F.when(by_line, own).otherwise(blocks), lambda p: strip(p) != "")

    return let(inner, read)


def sentences(text: Column) -> Column:
    """Array of sentences, each with the one space that follows it."""
    end = f"[{TERMINATORS}][{TERMINATORS}{CLOSERS.replace(']', chr(92) + ']')}]*"
    return F.regexp_extract_all(text, F.lit(rf"(?s)((?:[^{TERMINATORS}])*{end}{SPACE}?|[^{TERMINATORS}]+$)"), F.lit(1))


def markdown_metadata(text: Column) -> Column:
    """struct(title, authors, date, language) from the leading run of labelled headings."""
    lines = F.filter(F.transform(F.split(line_endings(text), "\n"), lambda s: strip(s)), lambda s: s != "")
    label = r"(?i)^#{1,6} +(" + "|".join(sorted(LABELS, key=len, reverse=True)) + r")\s*:\s*(\S.*)$"

    def read(rows: Column) -> Column:
        stop = F.array_position(F.transform(rows, lambda s: s.rlike(label)), F.lit(False))
        lead = F.when(stop == 0, rows).otherwise(F.slice(rows, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")))

        def first(*names: str, fn=lambda v: v) -> Column:
            mine = F.filter(lead, lambda s: F.lower(F.regexp_extract(s, label, 1)).isin(*names))
            values = F.filter(F.transform(mine, lambda s: fn(strip(F.regexp_extract(s, label, 2)))), lambda v: v != "")
            return F.coalesce(F.get(values, F.lit(0)), F.lit(""))

        return F.struct(first("title").alias("title"), first("author", "authors", fn=lambda v: F.array_join(parse_author_list(v), "; ")).alias("authors"),
                        first("year", "date", fn=normalize_metadata_date).alias("date"), first("language", "lang", fn=normalize_language).alias("language"))

    return let(lines, read)


def heading_lines(text: Column) -> Column:
    """array<struct<line, level, title>> of the Markdown headings of a text."""
    lines = F.transform(F.split(line_endings(text), "\n"), lambda s, i: F.struct(
        i.cast("long").alias("line"), F.length(F.regexp_extract(strip(s), r"^(#{1,6}) ", 1)).cast("long").alias("level"),
        strip(F.regexp_extract(strip(s), r"^#{1,6} (.*)$", 1)).alias("title")))
    return F.filter(lines, lambda h: (h["level"] > 0) & (h["title"] != ""))


def heading_slug(title: Column) -> Column:
    """Letters and digits in lower case joined by hyphens, led by a letter; empty if none."""
    plain = F.regexp_replace(F.regexp_replace(squeeze(title), r"[^\p{L}\p{Nd}]+", "-"), "^-+|-+$", "")
    low = F.lower(plain)
    return F.when((low != "") & ~low.rlike(r"^[\p{L}_]"), F.concat(F.lit("heading-"), low)).otherwise(low)


def _wide_class() -> str:
    """Regex class of the characters that fill two cells, from the character database."""
    ranges, start, last = [], None, None
    for code in range(0x1100, 0x40000):
        if unicodedata.east_asian_width(chr(code)) in "WF":
            if start is None:
                start = code
            last = code
        elif start is not None:
            ranges.append((start, last))
            start = None
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


WIDE = _wide_class()
NO_CELL = r"[\p{Mn}\p{Me}\p{Cf}\p{Cc}­]"


def cell_width(word: Column) -> Column:
    """Cells that a word fills: two for wide characters, none for marks."""
    return F.when(F.length(word) == F.octet_length(word), F.length(word)).otherwise(
        F.length(F.regexp_replace(word, NO_CELL, "")) + F.regexp_count(word, F.lit(WIDE)))


def layout_step(state: Column, width: Column) -> Column:
    """Greedy wrap into 70 columns; a negative width is a blank line. State is struct(lines, column)."""
    lines, column = state["lines"], state["column"]
    wraps = (column > 0) & (column + 1 + width > PAGE_COLUMNS)
    base = F.when(wraps | (column == 0), 0).otherwise(column + 1)
    end = base + width
    over = end > PAGE_COLUMNS
    new_lines = lines + F.when(wraps, 1).otherwise(0) + F.when(over, F.floor((end - 1) / PAGE_COLUMNS)).otherwise(0)
    new_column = F.when(over, (end - 1) % PAGE_COLUMNS + 1).otherwise(end)
    broken = F.struct((lines + F.when(column > 0, 1).otherwise(0)).cast("long").alias("lines"), F.lit(0).cast("long").alias("column"))
    moved = F.struct(new_lines.cast("long").alias("lines"), new_column.cast("long").alias("column"))
    return F.when(width < 0, broken).when(width == 0, state).otherwise(moved)


def estimate_pages_text(text: Column) -> Column:
    """Pages of 70 columns by 36 lines, words wrapped greedily, blank lines ending a line."""
    marked = F.regexp_replace(F.concat(F.lit("\n"), text, F.lit("\n")), rf"\n[\s\u0085\p{{Z}}&&[^\n]]*(?=\n)", "\n\x00 ")
    words = F.filter(F.split(marked, rf"{SPACE}+"), lambda w: w != "")
    width = lambda w: F.when(w == "\x00", -1).otherwise(cell_width(w)).cast("long")
    widths = F.concat(F.transform(words, lambda w: width(w)), F.array(F.lit(-1).cast("long")))
    start = F.struct(F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("column"))
    return F.aggregate(widths, start, layout_step, lambda s: F.ceil(s["lines"] / PAGE_LINES).cast("long"))


def search_ready(q: str) -> bool:
    """Two characters or more, or a single Han one."""
    q = " ".join(q.split())
    return len(q) >= 2 or (len(q) == 1 and "CJK UNIFIED" in unicodedata.name(q, ""))


def search_in_text(text: Column, q: str) -> Column:
    """array<struct<at, pre, match, post>> of case-insensitive literal matches with their surroundings."""
    if not search_ready(q):
        raise ValueError("type at least two characters")
    q = " ".join(q.split())
    special = "\\.[]{}()*+?^$|"
    literal = "(?iu)" + "".join("\\" + c if c in special else c for c in q)

    def read(parts: Column, found: Column) -> Column:
        # Matched on the text itself, so that places are its own: the pieces between matches and the matches add up to them.
        begin = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("starts"))
        pieces = F.arrays_zip(F.slice(parts, F.lit(1), F.size(found)).alias("piece"), found.alias("match"))
        starts = F.aggregate(pieces, begin, lambda s, p: F.struct(
            (s["next"] + F.length(p["piece"]) + F.length(p["match"])).alias("next"),
            F.array_append(s["starts"], s["next"] + F.length(p["piece"])).alias("starts")), lambda s: s["starts"])

        def match(at: Column, text_of: Column) -> Column:
            end = at + F.length(text_of)
            start = F.greatest(at - CONTEXT, F.lit(0))
            stop = F.least(end + CONTEXT, F.length(text))
            return F.struct(
                at.cast("long").alias("at"),
                F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), F.substring(text, start + 1, at - start)).alias("pre"),
                text_of.alias("match"),
                F.concat(F.substring(text, end + 1, stop - end), F.when(stop < F.length(text), F.lit("…")).otherwise(F.lit(""))).alias("post"))

        return F.zip_with(starts, found, match)

    return let(F.split(text, literal, -1), lambda parts: let(F.regexp_extract_all(text, F.lit(literal), F.lit(0)), lambda found: read(parts, found)))
