"""Author names: sort form and list editing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import let, strip, words

# Words that mark an organisation, honorific prefixes, and name suffixes.
ORGANISATION = (
    "agency", "association", "bureau", "center", "centre", "co", "co.", "collective", "college", "committee",
    "company", "corp", "corp.", "corporation", "council", "department", "foundation", "group", "guild", "inc",
    "inc.", "institute", "laboratory", "labs", "llc", "ltd", "ltd.", "media", "ministry", "office",
    "organization", "organisation", "press", "project", "publisher", "publishers", "publishing", "society",
    "studio", "studios", "team", "university")
PREFIX = (
    "mr", "mr.", "mrs", "mrs.", "ms", "ms.", "miss", "miss.", "dr", "dr.", "prof", "prof.", "sir", "dame")
SUFFIX = (
    "jr", "jr.", "sr", "sr.", "esq", "esq.", "ph.d", "ph.d.", "phd", "phd.", "md", "md.", "m.d", "m.d.", "i",
    "i.", "ii", "ii.", "iii", "iii.", "iv", "iv.", "v", "v.", "junior", "junior.", "senior", "senior.")
OPEN, CLOSE = "([{", ")]}"


def without_brackets(name: Column) -> Column:
    """Drop bracketed text, nested and mixed kinds included; unmatched closers stay."""
    start = F.struct(F.lit(0).alias("depth"), F.array(F.lit(0), F.lit(0), F.lit(0)).alias("open"), F.lit("").alias("out"))

    def step(state: Column, char: Column) -> Column:
        opens, closes = F.position(char, F.lit(OPEN)), F.position(char, F.lit(CLOSE))
        kind = F.greatest(opens, closes)
        matched = (closes > 0) & (F.element_at(state["open"], F.greatest(kind, F.lit(1))) > 0)
        delta = F.when(opens > 0, 1).when(matched, -1).otherwise(0)
        counts = F.transform(state["open"], lambda n, i: n + F.when(i + 1 == kind, delta).otherwise(0))
        kept = (delta == 0) & (state["depth"] == 0)
        return F.struct((state["depth"] + delta).alias("depth"), counts.alias("open"),
                        F.when(kept, F.concat(state["out"], char)).otherwise(state["out"]).alias("out"))

    stripped = F.aggregate(F.split(name, ""), start, step, lambda s: s["out"])
    return F.when(name.rlike(r"[\[\](){}]"), stripped).otherwise(name)


def author_sort(name: Column) -> Column:
    """'Last, First' form; comma forms, organisations and single words are kept."""
    def of_author(author: Column) -> Column:
        return let(strip(without_brackets(author)), lambda source: of_words(author, source, words(source)))

    def of_words(author: Column, source: Column, tokens: Column) -> Column:
        return let(tokens, lambda t: F.when(source.contains(",") | (F.size(t) <= 1), author).otherwise(invert(author, t)))

    def invert(author: Column, t: Column) -> Column:
        low = F.transform(t, lambda w: F.lower(w))
        organisation = F.exists(low, lambda w: w.isin(*ORGANISATION))
        size = F.size(t)
        # 1-based place of the first word that is no prefix and of the last that is no suffix.
        places = F.sequence(F.lit(1), size)
        first = F.array_min(F.filter(places, lambda i: ~F.element_at(low, i).isin(*PREFIX)))
        last = F.array_max(F.filter(places, lambda i: ~F.element_at(low, i).isin(*SUFFIX)))
        given = F.slice(t, first, F.greatest(last - first, F.lit(0)))
        suffix = F.slice(t, last + 1, F.greatest(size - last, F.lit(0)))
        family = F.concat(F.element_at(t, last), F.when(F.size(given) > 0, F.lit(",")).otherwise(F.lit("")))
        inverted = F.array_join(F.concat(F.array(family), given, suffix), " ")
        usable = first.isNotNull() & last.isNotNull() & (last >= first)
        return F.when(organisation | ~F.coalesce(usable, F.lit(False)), author).otherwise(inverted)

    return let(strip(name), of_author)


def parse_author_list(text: Column) -> Column:
    """Split on ``;`` and on ``&`` between spaces; a doubled ``&`` is a literal one."""
    marked = F.replace(text, F.lit("&&"), F.lit("\x01"))
    parts = F.split(marked, rf";|(?<![^\s\u0085\p{{Z}}])&(?![^\s\u0085\p{{Z}}])")
    names = F.transform(parts, lambda p: strip(F.replace(p, F.lit("\x01"), F.lit("&"))))
    return F.filter(names, lambda n: n != "")


def format_author_list(names: Column) -> Column:
    kept = F.filter(F.transform(names, lambda n: strip(n)), lambda n: n != "")
    return F.array_join(F.transform(kept, lambda n: F.replace(n, F.lit("&"), F.lit("&&"))), "; ")
