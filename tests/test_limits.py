"""Nothing is cut: many labels, matches, rows and long names; and rows that were judged wrongly before."""

from pyspark.sql import functions as F

from foliant.functions import prose
from foliant.operators import browse, edit, reading
from foliant.sources.files import dedupe_import
from tests.test_catalog import rows


def test_more_labels_than_a_page_shows(spark):
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 150)]
    books = rows(spark, "books", *[{"id": i, "title": t, "sort_title": t, "added_at": 1} for i, t in enumerate(letters)])
    jumps = browse.book_jumps(books, "title").collect()
    assert sorted(r["offset"] for r in jumps) == list(range(150)) and {r["total"] for r in jumps} == {150}


def test_all_matches_with_their_own_places(spark):
    text = "x cat" * 1500
    hits = spark.createDataFrame([("İİ the CaT",), (text,)], "t string").select(prose.search_in_text(F.col("t"), "cat").alias("h")).collect()
    assert [(h["at"], h["match"]) for h in hits[0]["h"]] == [(7, "CaT")]
    assert [h["at"] for h in hits[1]["h"]] == [2 + 5 * i for i in range(1500)]


def test_all_trashed_books(spark):
    books = rows(spark, "books", *[{"id": i, "title": "t", "deleted_at": 5000 - i} for i in range(1300)])
    users = rows(spark, "users", {"id": 1, "username": "u"})
    listed = browse.trash_listing(books, users).orderBy("rn").collect()
    assert [r["id"] for r in listed] == list(range(1300))


def test_long_tag_names_move_whole(spark):
    long = "x" * 12_000
    tags = rows(spark, "tags", {"id": 1, "name": "A", "name_key": "a", "kind": "tag"},
                {"id": 2, "name": f"A.{long}", "name_key": f"a.{long}", "kind": "tag", "parent_id": 1})
    nodes, _ = edit.rename_tag(tags, rows(spark, "book_tags", {"book_id": 1, "tag_id": 2, "position": 0}), 1, "B")
    assert f"B.{long}" in {r["name"] for r in nodes.collect()}


def test_equal_bytes_in_one_batch_are_imported_once(spark):
    candidates = spark.createDataFrame([(3, 10, "h"), (2, 10, "h"), (9, 11, "k"), (4, 7, "old")], "id long, size long, hash string")
    assets = rows(spark, "assets", {"id": 1, "book_id": 1, "original_hash": "old", "current_hash": "old", "original_size": 7, "current_size": 7})
    got = {r["id"]: r["status"] for r in dedupe_import(candidates, assets, rows(spark, "books", {"id": 1, "title": "t"})).collect()}
    assert got == {2: "imported", 3: "duplicate", 9: "imported", 4: "duplicate"}


UPDATE = ("user_id long, asset_id long, seq long, arrived_at long, modified_at long, progress double, address string, status string, status_at long")


def test_device_rows_without_address_progress_or_place(spark):
    told = [(0.1, "", None), (0.6, "", None), (None, None, "finished"), (None, "", None), (0.6, "p1", None), (0.9, "p1", None)]
    updates = spark.createDataFrame([(1, 7, i, 1000 + i, 100 + i, p, a, s, 100 + i) for i, (p, a, s) in enumerate(told)], UPDATE)
    got = [(r["moved"], r["status_changed"], r["revision"], r["state"]) for r in reading.late_updates(updates).orderBy("seq").collect()]
    assert got == [(True, True, 1, "reading"), (True, False, 2, "reading"), (False, True, 2, "finished"), (False, False, 2, "finished"),
                   (True, False, 3, "finished"), (False, False, 3, "finished")]


def test_conflict_rule_of_each_write(spark):
    shape = "user_id long, asset_id long, seq long, arrived_at long, modified_at long, progress double, address string, expected_revision long"
    writes = [(0.5, "a", 5000, None), (0.4, "b", 4000, None), (0.4, "c", 4900, None), (0.7, "d", 1, 2), (0.8, "e", 9000, 1), (0.7, "d", 1, None)]
    frame = spark.createDataFrame([(1, 7, i, 5000 + i, at, p, a, e) for i, (p, a, at, e) in enumerate(writes)], shape)
    got = [(r["outcome"], r["revision"]) for r in reading.position_conflicts(frame).orderBy("seq").collect()]
    assert got == [("accepted", 1), ("conflict", 1), ("accepted", 2), ("accepted", 3), ("conflict", 3), ("same", 3)]


def test_status_follows_accepted_writes(spark):
    writes = spark.createDataFrame([(1, 1, 0.2, "accepted"), (1, 1, 0.999, "conflict"), (1, 2, 1.0, "saved"), (1, 3, 1.0, "accepted")],
                                   "user_id long, book_id long, progress double, outcome string")
    states = spark.createDataFrame([(1, 3, "dropped"), (1, 4, "unread")], "user_id long, book_id long, status string")
    got = {r["book_id"]: r["status"] for r in reading.status_after_writes(writes, states).collect()}
    assert got == {1: "reading", 2: "finished", 3: "dropped", 4: "unread"}
