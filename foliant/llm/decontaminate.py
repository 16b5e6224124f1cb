"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed hashes the words of a passage at the fixed positions of a mask and ignores
those between, so it survives a substituted word at an ignored position. Training
seeds meet test seeds in an equi-join; the passages around each hit are then
compared word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import empty_if_null, free_names, text_key, written

# A passage of WINDOW words of a test item counts as leaked with at most SUBSTITUTIONS other words.
# The mask's positions are three apart: of the three seeds that start at the first three words of a
# window, two substitutions spoil two at most.
WINDOW = 15
SUBSTITUTIONS = 2
SPACED = "1001001001001"
# Items shorter than a window have to occur whole, found by their first words; below that many words
# they match nothing. With ``every_length`` they may have substitutions in the same proportion
# (short_mask) and the shortest ones match by the hash of all their words.
SOLID = "11111"
# So many test seeds (24 bytes each) may be broadcast; more are joined by a shuffle.
BROADCAST_SEEDS = 500_000

# Scripts that are written without spaces: each letter is a word.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
WORD = rf"[\p{{L}}\p{{N}}&&[^{UNSPACED}]]+|[\p{{L}}\p{{N}}&&[{UNSPACED}]]"


def _hashed_words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def short_mask(n: int, allowed: int, solid: int = len(SOLID)) -> str:
    """The mask for an item of ``n`` words: of its seeds at the first ``allowed + 1`` words, so many substitutions leave one whole.

    Its ones are ``allowed + 1`` apart, so that no two of these seeds share a word.
    Few different masks serve all lengths.
    """
    ones = n // (allowed + 1)
    ones = min(ones, solid) if allowed == 0 else max(1, ones - ones % 2)
    return ("1" + "0" * allowed) * (ones - 1) + "1"


def _seed(h: Column, at: Column, mask: str) -> Column:
    """Hash of the words under the mask's ones; null where the mask passes the end."""
    picked = [F.get(h, at + i) for i, bit in enumerate(mask) if bit == "1"]
    return F.when(at + len(mask) <= F.size(h), F.xxhash64(F.lit(mask), *picked))


def _seeds(words: DataFrame, masks: list[str], keys: list[str]) -> DataFrame:
    """(keys, at, seed) for each place and mask of the rows' word hashes ``h``."""
    shortest = min(len(m) for m in masks)
    places = words.where(F.size("h") >= shortest).select(
        *keys, "h", F.explode(F.sequence(F.lit(0), F.size("h") - shortest)).alias("at"))
    each = [_seed(F.col("h"), F.col("at"), m) for m in masks]
    seed = each[0] if len(each) == 1 else F.explode(F.array(*each))
    return places.select(*keys, "at", seed.alias("seed")).where("seed is not null")


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          window: int = WINDOW, substitutions: int = SUBSTITUTIONS, spaced: str = SPACED, solid: str = SOLID,
          broadcast_seeds: int = BROADCAST_SEEDS, every_length: bool = False) -> DataFrame:
    """A row for each different text and test item that overlap: k1, k2 (see ``text_key``), item, item_words,
    matched_words (of the item, within leaked windows, at the best alignment) and doc_word (where the item's
    first word would stand in the text).

    Words are runs of letters and digits in lower case, and single letters of scripts
    without spaces. With ``every_length`` items shorter than ``window`` words have to
    occur whole, with substitutions in proportion (n * substitutions // window), down to
    a single word; without it 5 words or more have to occur unchanged. Null texts and items have no
    words. Repeated items count once each; a null item id is an item as well. Copies
    of a text are compared once. Empty tables give no rows.
    """
    items = written(benchmark.select(F.col(item_col).alias("item"), _hashed_words(empty_if_null(F.col(item_text))).alias("b"))
                    .select("item", "b", F.xxhash64("item", "b").alias("bench")).dropDuplicates(["bench"]))
    spread = {n: n * substitutions // window if every_length else 0 for n in range(1 if every_length else len(solid), window)}
    masks: dict[tuple[str, int], list[int]] = {}  # the lengths of short items that have a mask and so many seeds
    for n, few in spread.items():
        masks.setdefault((short_mask(n, few, len(solid)), few), []).append(n)
    families = [(items.where(F.size("b") >= window).select("bench", F.col("b").alias("h")), spaced)]
    families += [(items.where(F.size("b").isin(lengths)).select("bench", F.slice("b", 1, len(mask) + few).alias("h")), mask)
                 for (mask, few), lengths in masks.items()]
    tested = written(reduce(DataFrame.union, [_seeds(rows, [mask], ["bench"]).select("bench", F.col("at").alias("j"), "seed", F.lit(mask).alias("mask"))
                                              for rows, mask in families]))
    sizes = {r["mask"]: r["count"] for r in tested.groupBy("mask").count().collect()}  # a row for each mask
    total = sum(sizes.values())

    text = empty_if_null(F.col(text_col))
    words = docs.select(*text_key(text), _hashed_words(text).alias("h"))
    trained = _seeds(words, sorted(sizes) or [spaced], ["k1", "k2"])
    known = tested.select("bench", "j", "seed")
    hits = trained.join(F.broadcast(known) if total <= broadcast_seeds else known, "seed")
    places = written(hits.groupBy("k1", "k2", "bench", (F.col("at") - F.col("j")).alias("shift")).agg(
        F.min("j").alias("low"), F.max("j").alias("high")))

    found = places.select("k1", "k2").distinct()
    texts = docs.select(*text_key(text), text.alias("text")).join(found, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    aligned = places.join(texts.select("k1", "k2", _hashed_words(F.col("text")).alias("h")), ["k1", "k2"]).join(items, "bench")
    size = F.least(F.lit(window), F.size("b"))
    allowed = F.when(F.size("b") >= window, substitutions).otherwise(F.floor(F.size("b") * substitutions / window).cast("int") if every_length else 0)
    # Windows that hold a hit and lie within both the item and the text.
    first = F.greatest(F.lit(0), F.col("low") - size + 1, -F.col("shift"))
    last = F.least(F.col("high"), F.size("b") - size, F.size("h") - F.col("shift") - size)
    aligned = aligned.select("*", size.alias("size"), allowed.alias("allowed"), first.alias("first"), last.alias("last")).where("first <= last")
    same = F.transform(F.sequence("first", F.col("last") + F.col("size") - 1),
                       lambda i: F.when(F.get("b", i) == F.get("h", i + F.col("shift")), 1).otherwise(0))
    aligned = aligned.select("k1", "k2", "item", "shift", "b", "size", "allowed", same.alias("same"))
    good = F.filter(F.sequence(F.lit(0), F.size("same") - F.col("size")),
                    lambda s: F.aggregate(F.slice("same", s + 1, F.col("size")), F.lit(0), lambda acc, x: acc + x) >= F.col("size") - F.col("allowed"))
    covered = F.aggregate("good", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda acc, s: F.struct(
        (s + F.col("size")).alias("end"), (acc["n"] + s + F.col("size") - F.greatest(s, acc["end"])).alias("n")), lambda acc: acc["n"])
    leaked = aligned.select("k1", "k2", "item", "shift", F.size("b").alias("item_words"), "size", good.alias("good")).where(F.size("good") > 0)
    leaked = leaked.select("k1", "k2", "item", "item_words", "shift", covered.alias("matched_words"))
    return leaked.groupBy("k1", "k2", "item").agg(
        F.max("item_words").cast("long").alias("item_words"), F.max("matched_words").cast("long").alias("matched_words"),
        F.max_by("shift", F.struct("matched_words", -F.col("shift"))).cast("long").alias("doc_word"))


def leaked_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_items, item_ids, matched_words) of the rows whose text overlaps a test item."""
    texts = leaks(docs, benchmark, text_col, **options).groupBy("k1", "k2").agg(
        F.countDistinct("item").alias("n_items"), F.array_sort(F.collect_set("item")).alias("item_ids"),
        F.max("matched_words").alias("matched_words"))
    keyed = docs.select(F.col(id_col).alias("id"), *text_key(empty_if_null(F.col(text_col))))
    return keyed.join(texts, ["k1", "k2"]).select("id", "n_items", "item_ids", "matched_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with their columns, whose text overlaps no test item."""
    k1, k2 = text_key(empty_if_null(F.col(text_col)))
    one, two = free_names(docs.columns, "_leak_1", "_leak_2")
    found = leaks(docs, benchmark, text_col, **options).select(F.col("k1").alias(one), F.col("k2").alias(two)).distinct()
    return docs.join(found, (k1 == F.col(one)) & (k2 == F.col(two)), "left_anti")
