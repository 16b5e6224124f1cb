"""The book-format dictionary and what is read from file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.identifiers import valid_isbn
from foliant.functions.text import let, lookup, squeeze, words

_ZIP = "application/zip"
# Format key, label, reader kind, and media type per extension.
FORMATS = [
    ("epub", "EPUB", "reflow", {".epub": "application/epub+zip"}),
    ("kepub", "KEPUB", "reflow", {".kepub": "application/epub+zip", ".kepub.epub": "application/epub+zip"}),
    ("pdf", "PDF", "pdf", {".pdf": "application/pdf"}),
    ("fb2", "FB2", "reflow", {".fb2": "application/x-fictionbook+xml", ".fb2.zip": _ZIP, ".fb2.gz": "application/gzip", ".fbz": _ZIP}),
    ("mobi", "MOBI", "reflow", {".mobi": "application/x-mobipocket-ebook"}),
    ("azw", "AZW", "reflow", {".azw": "application/x-mobipocket-ebook"}),
    ("azw3", "AZW3", "reflow", {".azw3": "application/vnd.amazon.ebook"}),
    ("azw4", "AZW4", "", {".azw4": "application/vnd.amazon.ebook"}),
    ("prc", "PRC", "reflow", {".prc": "application/x-mobipocket-ebook"}),
    ("pdb", "PDB", "", {".pdb": "application/vnd.palm"}),
    ("kfx", "KFX", "reflow", {".kfx": "application/vnd.amazon.ebook", ".kfx-zip": _ZIP, ".kfx.zip": _ZIP}),
    ("cbz", "CBZ", "reflow", {".cbz": "application/vnd.comicbook+zip"}),
    ("cbr", "CBR", "reflow", {".cbr": "application/vnd.comicbook-rar"}),
    ("cb7", "CB7", "reflow", {".cb7": "application/x-7z-compressed"}),
    ("djvu", "DJVU", "djvu", {".djvu": "image/vnd.djvu", ".djv": "image/vnd.djvu"}),
    ("txt", "TXT", "", {".txt": "text/plain", ".text": "text/plain"}),
    ("txtz", "TXTZ", "", {".txtz": _ZIP}),
    ("markdown", "Markdown", "", {".md": "text/markdown", ".markdown": "text/markdown"}),
    ("textile", "Textile", "", {".textile": "text/x-textile"}),
    ("html", "HTML", "", {".html": "text/html", ".htm": "text/html"}),
    ("xhtml", "XHTML", "", {".xhtml": "application/xhtml+xml", ".xhtm": "application/xhtml+xml"}),
    ("htmlz", "HTMLZ", "", {".htmlz": _ZIP}),
    ("docx", "DOCX", "", {".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}),
    ("docm", "DOCM", "", {".docm": "application/vnd.ms-word.document.macroEnabled.12"}),
    ("odt", "ODT", "", {".odt": "application/vnd.oasis.opendocument.text"}),
    ("rtf", "RTF", "", {".rtf": "application/rtf"}),
    ("chm", "CHM", "", {".chm": "application/vnd.ms-htmlhelp"}),
]
READING_ORDER = ["epub", "kepub", "fb2", "azw3", "mobi", "kfx", "cbz", "cbr", "cb7", "pdf", "djvu"]
FIXED_PAGES = ("pdf", "djvu", "cbz", "cbr", "cb7")
WRITABLE = ("epub", "fb2", "kepub")

KEY_OF = {ext: key for key, _, _, media in FORMATS for ext in media}
LABEL_OF = {key: label for key, label, _, _ in FORMATS}
READER_OF = {key: reader for key, _, reader, _ in FORMATS}
MEDIA_OF = {ext: kind for _, _, _, media in FORMATS for ext, kind in media.items()}
_KNOWN = "(" + "|".join(sorted((e.replace(".", r"\.") for e in KEY_OF), key=len, reverse=True)) + ")$"


def known_extension(name: Column) -> Column:
    """The longest known extension in lower case, empty if none."""
    return F.regexp_extract(F.lower(name), _KNOWN, 1)


def book_extension(name: Column) -> Column:
    """The known extension as spelled in the name, else the text from the last dot."""
    known = known_extension(name)
    base = F.substring_index(name, "/", -1)
    return F.when(known != "", F.substring(name, F.length(name) - F.length(known) + 1, F.length(known))).otherwise(
        F.regexp_extract(base, r"(\.[^.]*)$", 1))


def classify_format(name: Column) -> Column:
    """struct(extension, format, label, media_type, reader) of a file name."""
    def of(ext: Column) -> Column:
        key = F.coalesce(lookup(KEY_OF, ext), F.lit("unknown"))
        return F.struct(
            ext.alias("extension"), key.alias("format"), F.coalesce(lookup(LABEL_OF, key), F.lit("Unknown")).alias("label"),
            F.coalesce(lookup(MEDIA_OF, ext), F.lit("application/octet-stream")).alias("media_type"),
            F.coalesce(lookup(READER_OF, key), F.lit("")).alias("reader"))

    return let(known_extension(name), of)


def reading_priority(key: Column) -> Column:
    """Rank of a format as a book's default file, lower is better."""
    rank = {k: str(i) for i, k in enumerate(READING_ORDER)}
    rank.update({"azw": rank["mobi"], "prc": rank["mobi"]})
    readable = [k for k, reader in READER_OF.items() if reader]
    return F.when(~key.isin(*readable) | key.isNull(), len(READING_ORDER) + 1).otherwise(
        F.coalesce(lookup(rank, key).cast("int"), F.lit(len(READING_ORDER))))


def filename_metadata(name: Column) -> Column:
    """struct(title, author, identifier) of 'Title -- Author -- ... -- ISBN/Year' names, else null."""
    base = F.substring_index(name, "/", -1)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(book_extension(base)))
    parts = F.split(stem, " -- ")

    def isbn(part: Column) -> Column:
        label = F.replace(F.regexp_replace(F.lower(words(part)[0]), "^:+|:+$", ""), F.lit("-"), F.lit(""))
        value = F.array_join(F.slice(words(part), F.lit(2), F.size(words(part))), " ")
        return F.when((F.size(words(part)) >= 2) & label.isin("isbn", "isbn10", "isbn13") & valid_isbn(value), value)

    def read(fields: Column) -> Column:
        rest = F.slice(fields, F.lit(3), F.size(fields))
        isbns = F.filter(F.transform(rest, lambda p: isbn(p)), lambda v: v.isNotNull())
        signal = (F.size(isbns) > 0) | F.exists(rest, lambda p: p.rlike("^[0-9]{4}$") & p.between("1000", "2099"))
        return F.when((F.size(parts) >= 4) & (F.size(fields) >= 4) & signal, F.struct(
            fields[0].alias("title"), fields[1].alias("author"),
            F.coalesce(F.concat(F.lit("isbn:"), F.get(isbns, F.lit(0))), F.lit("")).alias("identifier")))

    return let(F.filter(F.transform(parts, lambda p: squeeze(p)), lambda p: p != ""), read)
