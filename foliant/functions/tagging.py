"""Tag names: keys, dotted paths, list parsing and list edits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import SPACE, strip

MAX_DEPTH = 16


def _literal(name: Column) -> Column:
    """True for names with an empty component or more than 16 levels: they are no path."""
    dots = F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))
    return (dots >= MAX_DEPTH) | name.rlike(rf"^\.|\.$|\.{SPACE}*\.")


def normalize_tag_name(name: Column) -> Column:
    """Trimmed name with trimmed path components; malformed or too deep names stay literal."""
    name = strip(name)
    return F.when(_literal(name), name).otherwise(F.regexp_replace(name, rf"{SPACE}*\.{SPACE}*", "."))


def tag_parts(name: Column) -> Column:
    """Dot-separated components; malformed or too deep names stay one literal part."""
    tidy = normalize_tag_name(name)
    return F.when(tidy == "", F.array().cast("array<string>")).when(_literal(tidy), F.array(tidy)).otherwise(F.split(tidy, r"\."))


def tag_key(name: Column) -> Column:
    return F.lower(normalize_tag_name(name))


def path_prefixes(name: Column) -> Column:
    """Every leading path of a normalized name, shortest first, the name itself last."""
    levels = F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1
    return F.when(_literal(name), F.array(name)).otherwise(
        F.transform(F.sequence(F.lit(1), levels), lambda n: F.call_function("substring_index", name, F.lit("."), n)))


def first_spellings(names: Column) -> Column:
    """Drop later names that repeat an earlier key."""
    keys = F.transform(names, lambda n: F.lower(n))
    return F.filter(names, lambda n, i: F.array_position(keys, F.lower(n)) == i + 1)


def normalize_tag_list(text: Column) -> Column:
    """Comma text to ordered unique names; the first spelling of a name wins."""
    names = F.transform(F.split(text, ","), lambda n: normalize_tag_name(n))
    return first_spellings(F.filter(names, lambda n: n != ""))


def apply_tag_mode(current: Column, mode: Column, values: Column) -> Column:
    """Edit an ordered tag array: add, remove, replace or clear."""
    def absent_from(names: Column):
        keys = F.transform(names, lambda n: tag_key(n))
        return lambda n: ~F.array_contains(keys, tag_key(n))

    added = F.concat(current, first_spellings(F.filter(values, absent_from(current))))
    return (
        F.when(mode == "clear", F.array().cast("array<string>"))
        .when(mode == "replace", values)
        .when(mode == "remove", F.filter(current, absent_from(values)))
        .when(mode == "add", added)
        .otherwise(current)
    )
