"""Planted breaches of the model's clauses, on literal tables."""

from foliant.operators.audit import audit_constraints
from foliant.plans import load_all
from foliant.plans.registry import JOBS
from foliant.sources.catalog import SCHEMAS, Catalog


def catalog(spark, **rows):
    def resolve(name):
        schema = SCHEMAS[name]
        return spark.createDataFrame([tuple(row.get(field.name) for field in schema) for row in rows.get(name, [])], schema)

    return Catalog(spark, resolve)


def test_breaches_are_counted_and_nulls_are_none(spark):
    found = {(r.tbl, r.rule): r.violations for r in audit_constraints(catalog(
        spark,
        books=[{"id": 1, "deleted_by": 9}, {"id": 1}, {"id": 2}],
        users=[{"id": 5, "username": "a", "role": "king", "content_scope": "all"}, {"id": 6, "username": "a", "role": None}],
        tags=[{"id": 1, "kind": "tag", "name_key": None, "parent_id": 1}, {"id": 2, "kind": "tag", "name_key": None, "parent_id": 7}],
        book_tags=[{"book_id": 3, "tag_id": 1}, {"book_id": 3, "tag_id": 1}, {"book_id": 3, "tag_id": 1}, {"book_id": None, "tag_id": 2}],
        assets=[{"id": 1, "book_id": 1, "is_primary": True}, {"id": 2, "book_id": 1, "is_primary": True}, {"id": 3, "book_id": 1, "is_primary": False}],
        reading_events=[{"id": 1, "from_status": "reading", "to_status": "reading", "source": "fax"}])).collect()}
    broken = {k: n for k, n in found.items() if n}
    assert broken == {
        ("books", "unique id"): 1, ("books", "deleted_by in users"): 1, ("users", "unique username"): 1, ("users", "role is known"): 1,
        ("tags", "unique kind, name_key"): 1, ("tags", "parent_id in tags"): 1, ("book_tags", "unique book_id, tag_id"): 1,
        ("book_tags", "book_id in books"): 3, ("assets", "one primary per book"): 1, ("assets", "unique original_hash"): 1,
        ("assets", "unique storage_path"): 1, ("reading_events", "source is known"): 1, ("reading_events", "status changes"): 1}


def test_empty_tables_break_nothing(spark):
    rows = audit_constraints(catalog(spark)).collect()
    assert len(rows) == len({(r.tbl, r.rule) for r in rows}) == 60
    assert not any(r.violations for r in rows)


def test_one_key_shuffle(spark):
    """Besides the shuffle of keys there is only the one of the counts."""
    planned = audit_constraints(catalog(spark))._jdf.queryExecution().executedPlan().toString()
    assert planned.count("Exchange hashpartitioning") == 2


def test_whole_numbers_are_keys_of_their_own(spark):
    links = [{"book_id": b, "author_id": a} for b, a in ((1, None), (None, 1), (None, None), (1, 2), (2, 1), (None, None), (None, 1), (0, 0), (-1, 1))]
    made = audit_constraints(catalog(spark, book_authors=links, books=[{"id": i} for i in (-1, 0, 1)], authors=[{"id": 1, "name": "a"}, {"id": None, "name": "b"}]))
    assert "xxhash64(book_id" not in made._jdf.queryExecution().executedPlan().toString()
    found = {r.rule: r.violations for r in made.where("tbl = 'book_authors'").collect()}
    assert found == {"unique book_id, author_id": 2, "book_id in books": 1, "author_id in authors": 2}


def test_the_query_counts_at_once(spark):
    load_all()
    made = JOBS["audit_constraints"](catalog(spark, books=[{"id": 1}, {"id": 1}]))
    assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r.tbl, r.rule) for r in made.collect() if r.violations} == {("books", "unique id")}
