"""Literal table tests of the column functions."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import dates, formats, identifiers, language, people, paths, tagging
from foliant.operators import records


def run(spark, fn, values, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, " + schema)
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


CASES = {
    "normalize_language": (language.normalize_language, {
        "en": "en", "EN": "en", " en ": "en", "eng": "en", "en-US": "en-US", "EN-us": "en-US", "pt_BR": "pt-BR",
        "fra-be": "fr-BE", "zh_hans": "zh-Hans", "zh-hant-hk": "zh-Hant-HK", "ger": "de", "jp": "ja", "und": "",
        "English": "", "": "", "xx": "xx", "tlh": "tlh", "klingon": "", "en--US": ""}),
    "language_name": (language.language_name, {"en-US": "English (US)", "xx": "xx", "eng": "English", "": "", "klingon": "klingon"}),
    "date": (lambda c: F.concat_ws("|", dates.parse_partial_date(c)["normalized"], dates.parse_partial_date(c)["precision"]), {
        "2026-04-30T19:57:11+00:00": "2026-04-30|day", "2020-2-17": "2020-02-17|day", "2020/2/7": "2020-02-07|day",
        "2021-2-29": "|", "2026-04": "2026-04|month", "2026": "2026|year", "April 2026": "2026-04|month",
        "Apr 2026": "2026-04|month", "30 April 2026": "2026-04-30|day", "April 30, 2026": "2026-04-30|day",
        "1st May 2026": "2026-05-01|day", "  2026-04-30 ": "2026-04-30|day", "2026-13-01": "|", "999": "|", "Garbage": "|", "": "|"}),
    "metadata_date": (dates.normalize_metadata_date, {
        "1951-06-01T00:00:00+00:00": "1951-06-01", "2024-03": "2024-03", "Published 1999 by Foo": "1999",
        "0101-01-01T00:00:00+00:00": "", "not a date": ""}),
    "format_year": (dates.format_year, {"1968-01-01T00:00:00+00:00": "1968", "Published in 2024": "2024", "0999": "", "2100": ""}),
    "date_human": (dates.format_date_human, {"2026": "2026", "2026-04": "April 2026", "2026-04-30": "30 April 2026", "Garbage": "Garbage", "": ""}),
    "author_sort": (people.author_sort, {
        "Isaac Asimov": "Asimov, Isaac", "Mrs. Jane Q. Doe III": "Doe, Jane Q. III", "John [x] von Neumann (III)": "Neumann, John von",
        "Acme Inc.": "Acme Inc.", "Don Team Smith": "Don Team Smith", "Cher": "Cher", "Asimov, Isaac": "Asimov, Isaac",
        "Dr. Prof.": "Dr. Prof.", "A (b [c) d] e": "e, A", "": "", "  ": ""}),
    "author_list": (lambda c: F.array_join(people.parse_author_list(c), "|"), {
        "Isaac Asimov; Robert Silverberg": "Isaac Asimov|Robert Silverberg", "A & B": "A|B", "AT&T Labs": "AT&T Labs",
        "Research && Development": "Research & Development", "; ;": "", "Le Guin, Ursula K.": "Le Guin, Ursula K."}),
    "identifiers": (lambda c: identifiers.format_identifiers(identifiers.parse_identifiers(c)), {
        "9780000000001": "isbn:9780000000001", "https://doi.org/10.1/x?y": "doi:10.1/x", "http://a.b/c": "url:http://a.b/c",
        "ISBN 978-1": "isbn:978-1", "urn:isbn:123": "isbn:123", "amazon:B00, , x:y": "amazon:B00, x:y", "": ""}),
    "valid_isbn": (identifiers.valid_isbn, {
        "0-306-40615-2": True, "0306406153": False, "080442957X": True, "978-0-306-40615-7": True, "9780306406158": False, "": False, "abc": False}),
    "from_scheme": (lambda c: F.concat_ws(":", identifiers.identifier_from_scheme(F.lit(""), c)["type"], identifiers.identifier_from_scheme(F.lit(""), c)["value"]), {
        "urn:isbn:978": "isbn:978", "ASIN:B1": "amazon:B1", "https://x.y": "url:https://x.y", "goodreads:12": "goodreads:12",
        "0306406152": "isbn:0306406152", "hello": "unknown:hello"}),
    "tag_list": (lambda c: F.array_join(tagging.normalize_tag_list(c), "|"), {
        " Space , space,Fiction. Fantasy ,": "Space|Fiction.Fantasy", "a..b": "a..b", ",".join(["x"] * 3): "x",
        ".".join("abcdefghijklmnopq"): ".".join("abcdefghijklmnopq")}),
    "extension": (lambda c: formats.classify_format(c)["format"], {
        "a.FB2.zip": "fb2", "x.kepub.epub": "kepub", "b.epub": "epub", "n.doc": "unknown", "d.md": "markdown"}),
    "filename": (lambda c: F.coalesce(F.concat_ws("|", formats.filename_metadata(c)["title"], formats.filename_metadata(c)["author"], formats.filename_metadata(c)["identifier"]), F.lit("")), {
        "Dune -- Frank Herbert -- Ace -- 1990.epub": "Dune|Frank Herbert|",
        "Dune -- Frank Herbert -- Ace -- isbn13 978-0-306-40615-7.epub": "Dune|Frank Herbert|isbn:978-0-306-40615-7",
        "Dune -- Frank Herbert -- Ace -- Tor.epub": "", "Dune -- Frank.epub": ""}),
    "overrides": (lambda c: records.merge_overrides(c, F.array(F.lit("title"), F.lit("a"))), {
        '{"z":true,"a":false}': '{"a":true,"title":true,"z":true}', "": '{"a":true,"title":true}', "oops": '{"a":true,"title":true}'}),
    "bucket": (paths.bucket, {"asimov": "A", "Ёж": "Ё", "чехов": "Ч", "9": "0-9", "": "_Unknown", "Élan": "_Other"}),
    "segment": (paths.safe_segment, {".NET  Core: A/B": "NET Core AB", "..": "", "a\tb": "a b"}),
}


@pytest.mark.parametrize("name", CASES)
def test_table(spark, name):
    fn, table = CASES[name]
    assert dict(zip(table, run(spark, fn, list(table)))) == table


def test_tag_modes(spark):
    df = spark.createDataFrame([(["A", "b"], ["a", "C", "c"])], "cur array<string>, vals array<string>")
    out = df.select(*[tagging.apply_tag_mode(F.col("cur"), F.lit(m), F.col("vals")).alias(m)
                      for m in ("add", "remove", "replace", "clear")]).first()
    assert out.asDict() == {"add": ["A", "b", "C"], "remove": ["b"], "replace": ["a", "C", "c"], "clear": []}


def test_long_segment(spark):
    text = "é" * 200 + ".epub"
    short = run(spark, paths.short_segment, [text])[0]
    assert len(short.encode()) <= 255 and short.endswith(".epub") and "~" in short
    assert run(spark, paths.short_segment, ["short"]) == ["short"]


def test_subjects(spark):
    df = spark.createDataFrame([
        (1, ["Sci-Fi", "x"], '{"#value#": ["Novel"]}', None), (2, ["Sci-Fi"], None, '{"#value#": "b, a"}'), (3, ["Sci-Fi,sci-fi"], None, None)],
        "i int, s array<string>, g string, e string")
    out = df.orderBy("i").select(records.classify_subjects(F.col("s"), F.col("g"), F.col("e")).alias("o")).collect()
    assert [(r.o.genres, r.o.tags) for r in out] == [(["Novel"], ["Sci-Fi", "x"]), (["Sci-Fi"], ["b", "a"]), (["Sci-Fi"], None)]
