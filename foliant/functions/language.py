"""Language codes: canonical tags and display names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import let, lookup, strip

# English names of primary languages.
NAMES = {
    "en": "English", "ru": "Russian", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian",
    "pt": "Portuguese", "nl": "Dutch", "pl": "Polish", "uk": "Ukrainian", "cs": "Czech", "sv": "Swedish",
    "no": "Norwegian", "da": "Danish", "fi": "Finnish", "ja": "Japanese", "zh": "Chinese", "ko": "Korean",
    "ar": "Arabic", "he": "Hebrew", "tr": "Turkish", "el": "Greek", "hu": "Hungarian", "ro": "Romanian",
    "bg": "Bulgarian", "sr": "Serbian", "hr": "Croatian", "sk": "Slovak", "sl": "Slovenian", "lt": "Lithuanian",
    "lv": "Latvian", "et": "Estonian", "ca": "Catalan", "eu": "Basque", "ga": "Irish", "is": "Icelandic",
    "fa": "Persian", "hi": "Hindi", "bn": "Bengali", "ta": "Tamil", "th": "Thai", "vi": "Vietnamese",
    "id": "Indonesian", "ms": "Malay", "la": "Latin",
}
# Three-letter, old and mistyped codes with the primary code they stand for.
ALIASES = {
    "eng": "en", "rus": "ru", "ger": "de", "deu": "de", "fre": "fr", "fra": "fr", "spa": "es", "ita": "it",
    "por": "pt", "dut": "nl", "nld": "nl", "pol": "pl", "ukr": "uk", "cze": "cs", "ces": "cs", "swe": "sv",
    "nor": "no", "dan": "da", "fin": "fi", "jpn": "ja", "chi": "zh", "zho": "zh", "kor": "ko", "ara": "ar",
    "heb": "he", "tur": "tr", "gre": "el", "ell": "el", "hun": "hu", "rum": "ro", "ron": "ro", "bul": "bg",
    "srp": "sr", "hrv": "hr", "slo": "sk", "slk": "sk", "slv": "sl", "lit": "lt", "lav": "lv", "est": "et",
    "cat": "ca", "baq": "eu", "eus": "eu", "gle": "ga", "ice": "is", "isl": "is", "per": "fa", "fas": "fa",
    "hin": "hi", "ben": "bn", "tam": "ta", "tha": "th", "vie": "vi", "ind": "id", "may": "ms", "msa": "ms",
    "lat": "la", "iw": "he", "ji": "yi", "in": "id", "jp": "ja",
}


def normalize_language(raw: Column) -> Column:
    """Canonical tag such as ``pt-BR``; empty for blank, undetermined or non-code text."""
    code = F.translate(strip(raw), "_", "-")
    first = F.lower(F.substring_index(code, "-", 1))
    primary = F.coalesce(lookup(ALIASES, first), first)
    rest = F.slice(F.split(code, "-"), F.lit(2), F.size(F.split(code, "-")))

    def subtag(part: Column) -> Column:
        low = F.lower(part)
        return F.when(low.rlike("^[a-z]{4}$"), F.initcap(low)).when(low.rlike("^[a-z]{2}$"), F.upper(low)).otherwise(low)

    valid = (first != "und") & primary.rlike("^[a-z]{2,3}$") & F.forall(rest, lambda p: p.rlike("^[A-Za-z0-9]{2,8}$"))
    return F.when(valid, F.array_join(F.concat(F.array(primary), F.transform(rest, lambda p: subtag(p))), "-")).otherwise("")


def language_name(code: Column) -> Column:
    """English name, with the rest of the tag in parentheses; unknown codes stay as they are."""
    plain = strip(code)

    def named(tag: Column) -> Column:
        primary = F.substring_index(tag, "-", 1)
        name = lookup(NAMES, primary)
        rest = F.substring(tag, F.length(primary) + 2, F.length(tag))
        return (
            F.when(tag == "", plain).when(name.isNull(), tag).when(rest == "", name)
            .otherwise(F.concat(name, F.lit(" ("), rest, F.lit(")")))
        )

    return let(normalize_language(plain), named)
