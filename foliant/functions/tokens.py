"""Word tokens of the catalogue search: letters and digits, case and accents folded."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}\p{Co}]+"
MARKS = "[̀-̱]"


def _fold_table() -> tuple[str, str]:
    """Lower-case Latin letters with one accent, and the plain letters they fold to."""
    source, target = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if letter == letter.lower() and len(parts) == 2 and parts[0].isascii() and parts[0].isalpha():
            source.append(letter)
            target.append(parts[0])
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _fold_table()


def fold(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(text), MARKS, ""), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(f"({WORD})"), F.lit(1))


def python_tokens(text: str) -> list[str]:
    """The same tokens for a query string on the driver."""
    folded = re.sub(MARKS, "", text.lower()).translate(str.maketrans(ACCENTED, PLAIN))
    out, word = [], ""
    for char in folded + " ":
        if unicodedata.category(char)[0] in "LN" or unicodedata.category(char) == "Co":
            word += char
        elif word:
            out.append(word)
            word = ""
    return out
