"""A stored search index in immutable segments: edits add small ones, merges keep them few."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.search import SearchIndex, build_search_index
from foliant.session import cut_lineage, if_small
from foliant.sources import manifests

RATIO = 4  # a segment is merged with newer ones once they hold a fourth of it
BROADCAST_BOOKS = 200_000  # replaced books that may be sent to every executor


@dataclass(frozen=True)
class Segment:
    """``rows`` postings of the ``books`` books that it covers; ``at`` orders the segments, newer ones replace older."""

    at: int
    name: str
    rows: int
    books: int

    @property
    def size(self) -> int:
        return self.rows + self.books


def build_for(books: DataFrame, cat) -> SearchIndex:
    """The index of some books (book_id) of a catalogue; books that the catalogue lacks have no rows."""
    ids = if_small(books)

    def of(table: DataFrame, column: str) -> DataFrame:
        return table.join(ids.withColumnRenamed("book_id", column), column, "left_semi").select(*table.columns)

    return build_search_index(of(cat.books, "id"), cat.authors, of(cat.book_authors, "book_id"), cat.tags,
                              of(cat.book_tags, "book_id"), of(cat.assets, "book_id"))


class IndexStore:
    """A folder with the segments of one index and its versions, each a list of segments.

    A book belongs to the newest segment that covers it; a deleted book is covered by
    a segment that holds no postings of it. Segments are never changed, so readers of
    an older version go on undisturbed until ``vacuum``. Writers take turns: a writer
    whose version has meanwhile been written by another one is refused and has to
    start from that version.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- versions --------------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(name) for name in manifests.names(self.spark, f"{self.path}/versions")]

    def segments(self, version: int | None = None) -> list[Segment]:
        """The segments of a version, oldest first; of the newest one by default."""
        known = self.versions()
        if not known:
            return []
        text = manifests.get(self.spark, f"{self.path}/versions", f"{version or known[-1]:08d}")
        return sorted((Segment(**s) for s in json.loads(text)), key=lambda s: s.at)

    def commit(self, segments: list[Segment], after: int) -> int:
        """Make ``segments`` the version after ``after``."""
        text = json.dumps([asdict(s) for s in segments])
        if not manifests.put(self.spark, f"{self.path}/versions", f"{after + 1:08d}", text):
            raise FileExistsError(f"version {after + 1} of {self.path} was written by another job")
        return after + 1

    # --- reading ---------------------------------------------------------------------

    def _covers(self, segments: list[Segment]) -> DataFrame:
        return reduce(DataFrame.unionByName, [
            self.spark.read.schema("book_id bigint").parquet(f"{self.path}/segments/{s.name}/covers").withColumn("at", F.lit(s.at))
            for s in segments])

    def view(self, segments: list[Segment]) -> SearchIndex:
        """The index that some segments, oldest first, make together.

        Rows of a book in an older segment than its newest are dropped by one anti-join on
        the replaced books; filters on terms pass below it to the sorted files. The term
        frequencies are sums over the segments: exact after a full merge, before that a
        bound from above, which is what the order of clauses needs.
        """
        read = [SearchIndex.read(self.spark, f"{self.path}/segments/{s.name}") for s in segments]
        if len(read) == 1:
            return read[0]
        newest = self._covers(segments[1:]).groupBy("book_id").agg(F.max("at").alias("newest"))
        if sum(s.books for s in segments[1:]) <= BROADCAST_BOOKS:
            newest = F.broadcast(newest)

        def live(part: str) -> DataFrame:
            rows = reduce(DataFrame.unionByName, [getattr(index, part).withColumn("at", F.lit(s.at)) for s, index in zip(segments, read)])
            dead = newest.withColumnRenamed("book_id", "dead_id")
            return rows.join(dead, (rows.book_id == dead.dead_id) & (rows["at"] < dead.newest), "left_anti").drop("at")

        counts = reduce(DataFrame.unionByName, [index.frequencies for index in read])
        return SearchIndex(live("postings"), live("lengths"),
                           counts.groupBy("field", "term").agg(F.sum("books").alias("books")))

    def current(self) -> SearchIndex:
        return self.view(self.segments())

    # --- writing ---------------------------------------------------------------------

    def stage(self, index: SearchIndex, covers: DataFrame | None, at: int) -> Segment:
        """Write a segment under a name of its own; it counts once a version lists it."""
        name = f"{at:08d}-{uuid.uuid4().hex[:12]}"
        place = f"{self.path}/segments/{name}"
        index.write(place)
        (SearchIndex.read(self.spark, place).lengths if covers is None else covers).select("book_id").distinct().write.parquet(f"{place}/covers")
        count = self.spark.read.parquet
        return Segment(at, name, count(f"{place}/postings").count(), count(f"{place}/covers").count())

    def create(self, build: Callable[[], SearchIndex]) -> SearchIndex:
        """The newest version, or the first one, built now. Of two first writers one is kept."""
        if not self.versions():
            first = self.stage(build(), None, 1)
            try:
                self.commit([first], 0)
            except FileExistsError:
                pass  # the other writer built the same
        return self.current()

    def staged_update(self, changed: DataFrame, build: Callable[[DataFrame], SearchIndex]) -> list[Segment]:
        """The newest version's segments with one more for the changed books, not yet committed.

        ``changed`` (book_id) names added, edited and deleted books, each any number of
        times (nulls are no books); ``build`` makes the index of those that still exist.
        """
        held = self.segments()
        ids = cut_lineage(changed.select("book_id").where("book_id IS NOT NULL").distinct())
        return [*held, self.stage(build(ids), ids, max((s.at for s in held), default=0) + 1)]

    def update(self, changed: DataFrame, build: Callable[[DataFrame], SearchIndex]) -> int:
        """Add a segment for the changed books only and merge what has become too many; returns the version."""
        before = max(self.versions(), default=0)
        version = self.commit(self.staged_update(changed, build), before)
        return self.merge() or version

    def merge(self, ratio: int = RATIO) -> int | None:
        """Merge the newest segments that together reach 1/``ratio`` of the next older one.

        Sizes then fall by that ratio, so an index has a logarithmic number of segments,
        and a posting is rewritten a logarithmic number of times.
        """
        before, held = max(self.versions(), default=0), self.segments()
        first = len(held) - 1
        while first > 0 and held[first - 1].size <= ratio * sum(s.size for s in held[first:]):
            first -= 1
        tail = held[max(first, 0):]
        if len(tail) < 2:
            return None
        # A merged segment above older ones still covers deleted books; the oldest needs only those it holds.
        covers = self._covers(tail).select("book_id") if first > 0 else None
        return self.commit([*held[:first], self.stage(self.view(tail), covers, tail[-1].at)], before)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove all but the newest ``keep`` versions and the segments that none of them lists; returns those segments."""
        known = self.versions()
        listed = {s.name for v in known[-keep:] for s in self.segments(v)}
        for version in known[:-keep]:
            manifests.drop(self.spark, f"{self.path}/versions/{version:08d}")
        gone = [name for name in manifests.names(self.spark, f"{self.path}/segments") if name not in listed] if known else []
        for name in gone:
            manifests.drop(self.spark, f"{self.path}/segments/{name}")
        return gone
