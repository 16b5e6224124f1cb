import random

import numpy as np
import pytest

from foliant.llm.shards import HEAD, Permutation, read_records, shard_name, write_shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 100, 1000, 4097])
def test_permutation_is_a_bijection_both_ways(n):
    for key in (0, 1, 99):
        order = Permutation(n, key)
        slots = order.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n))
        assert order.numbers(slots).tolist() == list(range(n))
    if n > 100:
        assert (Permutation(n, 1).slots(np.arange(n)) != Permutation(n, 2).slots(np.arange(n))).mean() > 0.9


def test_every_sequence_stands_in_its_slot(spark, tmp_path):
    rng = random.Random(12)
    values = [bytes(rng.randrange(256) for _ in range(2 * rng.randint(0, 60))) for _ in range(80)] + [None, b"", b"\0\0" * 31]
    rows = [(i % 70, v, "x") for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "id long, tokens binary, slot string").repartition(3)
    frame.write.parquet(str(tmp_path / "in"))
    frame = spark.read.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "shards")
    options = dict(width=2, sequence=16, per_shard=20)
    got = write_shards(frame, out, key=7, **options).collect()
    sizes = [sum(len(r["tokens"] or b"") for r in part) for part in frame.rdd.glom().collect()]
    want = sum(-(-n // 32) for n in sizes)
    assert {r["slot"] for r in got} == set(range(want)) == {r["number"] for r in got}
    read = list(read_records(out, 0, want, **options))
    assert list(read_records(out, 13, 30, **options)) == read[13:43]
    lines = {}
    for r in sorted(got, key=lambda r: (r["number"], r["start"])):  # parts of a row stand in sequences one after the other
        if r["part"] == 0:
            lines.setdefault(r["id"], []).append(b"")
        lines[r["id"]][-1] += read[r["slot"]][2 * r["start"]: 2 * (r["start"] + r["n_tokens"])]
    whole = {}
    for i, v, _ in rows:
        if v:
            whole.setdefault(i, []).append(v)
    assert {i: sorted(v) for i, v in lines.items()} == {i: sorted(v) for i, v in whole.items()}
    assert sum(map(len, read)) == sum(sizes)
    order = Permutation(want, 7)
    assert all(order.slots([r["number"]])[0] == r["slot"] for r in got)
    sizes = [(tmp_path / "shards" / shard_name(s)).stat().st_size for s in range(-(-want // 20))]
    assert sizes[:-1] == [20 * (HEAD + 32)] * (len(sizes) - 1)
    again = write_shards(frame, str(tmp_path / "again"), key=7, **options).collect()
    assert {(r["shard"], r["sha256"]) for r in again} == {(r["shard"], r["sha256"]) for r in got}


def test_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([], "id long, tokens binary")
    assert write_shards(frame, str(tmp_path)).count() == 0
