"""Book identifiers: parsing, typing, check digits, noise removal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import let, lookup, strip, words

DOI_URL = r"(?i)^https?://(?:dx\.)?doi\.org/"
WEB_URL = r"(?i)^https?://"
LABELS = {"isbn": "isbn", "isbn-10": "isbn", "isbn-13": "isbn", "doi": "doi"}
# Identifier prefixes and the type each stands for.
PREFIXES = {"urn:isbn:": "isbn", "isbn:": "isbn", "urn:doi:": "doi", "doi:": "doi", "amazon:": "amazon", "asin:": "amazon"}
INTERNAL = ("uuid", "calibre")
UUID = r"(?i)^(?:(?:urn:uuid:)?[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|\{[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\}|[0-9a-f]{32})$"


def pair(kind: Column | str, value: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("type"), value.alias("value"))


def _after_colon(text: Column) -> Column:
    return F.substring(text, F.locate(":", text) + 1, F.length(text))


def parse_identifier(token: Column) -> Column:
    """One trimmed token of the identifier field as struct(type, value)."""
    doi = F.regexp_extract(strip(F.regexp_replace(token, DOI_URL, "")), r"^([^?#]*)", 1)
    first = words(token)[0]
    label = lookup(LABELS, F.lower(F.regexp_replace(first, "^[ :]+|[ :]+$", "")))
    labelled = strip(F.substring(token, F.length(first) + 1, F.length(token)))
    kind = F.lower(strip(F.substring_index(token, ":", 1)))
    value = strip(_after_colon(token))
    nested = (kind == "urn") & value.contains(":")
    return (
        F.when(token.rlike(DOI_URL) & (doi != ""), pair("doi", doi))
        .when(token.rlike(WEB_URL), pair("url", token))
        .when((F.size(words(token)) >= 2) & label.isNotNull(), pair(label, labelled))
        .when(~token.contains(":"), pair("isbn", token))
        .when(nested, pair(F.lower(strip(F.substring_index(value, ":", 1))), strip(_after_colon(value))))
        .otherwise(pair(kind, value))
    )


def parse_identifiers(text: Column) -> Column:
    """Comma list to array<struct<type,value>>."""
    tokens = F.filter(F.transform(F.split(text, ","), lambda t: strip(t)), lambda t: t != "")
    return F.filter(F.transform(tokens, lambda t: parse_identifier(t)), lambda i: (i["type"] != "") | (i["value"] != ""))


def format_identifiers(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.concat(i["type"], F.lit(":"), i["value"])), ", ")


def clean_isbn(value: Column) -> Column:
    return F.translate(strip(value), "- ", "")


def valid_isbn(value: Column) -> Column:
    """ISBN-10 (mod 11, X allowed last) or ISBN-13 (mod 10) with a right check digit."""
    clean = F.translate(value, "- ", "")

    def verdict(isbn: Column) -> Column:
        def digit(i: int) -> Column:
            return F.position(F.upper(F.substring(isbn, i, 1)), F.lit("0123456789X")) - 1

        ten = reduce(lambda a, b: a + b, [digit(i) * (11 - i) for i in range(1, 11)])
        thirteen = reduce(lambda a, b: a + b, [digit(i) * (3 if i % 2 == 0 else 1) for i in range(1, 14)])
        return (isbn.rlike(r"^[0-9]{9}[0-9Xx]$") & (ten % 11 == 0)) | (isbn.rlike(r"^[0-9]{13}$") & (thirteen % 10 == 0))

    return let(clean, verdict)


def identifier_from_scheme(scheme: Column, value: Column) -> Column:
    """Typed identifier of a declared scheme or a recognised prefix; both fields empty for blank input."""
    def typed(text: Column) -> Column:
        lead = F.regexp_extract(F.lower(text), "^(urn:isbn:|isbn:|urn:doi:|doi:|amazon:|asin:)", 1)
        rest = F.when(lead != "", strip(F.substring(text, F.length(lead) + 1, F.length(text)))).otherwise(text)
        named = F.lower(strip(scheme))
        plain_type = F.lower(strip(F.substring_index(rest, ":", 1)))
        plain_value = strip(_after_colon(rest))
        plain = rest.contains(":") & plain_type.rlike("^[a-z0-9_.-]+$") & ~plain_type.isin("urn", "http", "https") & (plain_value != "")
        return (
            F.when(text == "", pair("", F.lit("")))
            .when(named != "", pair(named, rest))
            .when(lead != "", pair(lookup(PREFIXES, lead), rest))
            .when(rest.rlike(WEB_URL), pair("url", rest))
            .when(plain, pair(plain_type, plain_value))
            .when(valid_isbn(rest), pair("isbn", rest))
            .otherwise(pair("unknown", rest))
        )

    return let(strip(value), typed)


def is_internal(identifier: Column) -> Column:
    return identifier["type"].isin(*INTERNAL) | strip(identifier["value"]).rlike(UUID)


def external_identifiers(ids: Column) -> Column:
    """Drop internal and empty identifiers and repeats of (type, value in any case)."""
    tidy = F.transform(ids, lambda i: pair(F.lower(strip(i["type"])), strip(i["value"])))
    kept = F.filter(tidy, lambda i: (i["type"] != "") & (i["value"] != "") & ~is_internal(i))

    def firsts(items: Column) -> Column:
        keys = F.transform(items, lambda i: F.concat(i["type"], F.lit("\0"), F.lower(i["value"])))
        return F.filter(items, lambda i, n: F.array_position(keys, F.concat(i["type"], F.lit("\0"), F.lower(i["value"]))) == n + 1)

    return let(kept, firsts)
