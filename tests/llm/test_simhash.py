import random

import numpy as np
import xxhash

from foliant.llm import simhash
from foliant.llm.simhash import fingerprint, link_edges, near_duplicates
from foliant.llm.shared import connected_components


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    out = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    return out - (1 << 64) if out >> 63 else out


def plain_components(ids, prints, bits=4):
    low = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1") <= bits and low[j] < low[i]:
                    low[i], changed = low[j], True
    return low


def test_fingerprint_matches_a_plain_count():
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "a b c", "Ünï ÄB\x0bx\ty É"] + [
        " ".join(rng.choice(["The", "of", "x", "É", "long-word"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    assert [fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_components_match_brute_force_with_ties_nulls_and_repeats(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(80)) for _ in range(4)]
    rows = []
    for i in range(60):
        words = base[i % 4].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(80)] = "new"
        rows.append((100 - i, " ".join(words), "x"))
    rows += [(7, None, "y"), (8, "", None), (9, base[0], "z"), (9, base[0], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r["id"], r["fp"], r["component"]) for r in near_duplicates(docs).collect())
    prints = [plain_fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], prints, plain_components([r[0] for r in rows], prints)))
    assert got == want
    assert near_duplicates(docs.limit(0)).count() == 0


def test_every_bucket_size_connects_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 62, 3)
    prints = set()
    for _ in range(150):
        value = int(centre[rng.integers(3)])
        for bit in rng.choice(20, rng.integers(0, 5), replace=False):
            value ^= 1 << int(bit)
        prints.add(value)
    prints = sorted(prints)
    want = plain_components(prints, prints)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    for small, medium in ((10_000, 10_000), (2, 10_000), (2, 2)):
        monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
        monkeypatch.setattr(simhash, "MEDIUM_BUCKET", medium)
        found = {r["node"]: r["component"] for r in connected_components(link_edges(frame)).collect()}
        assert [found.get(p, p) for p in prints] == want


def test_block_masks_hold_every_close_pair():
    rng = random.Random(4)
    for n in (10, 1 << 22, 1 << 30):
        masks = simhash.block_masks(n)
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for bit in rng.sample(range(64), 4):
                y ^= 1 << bit
            assert any(x & m == y & m for m in masks)
