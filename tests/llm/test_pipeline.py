import hashlib
import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from foliant.llm import bpe, pii
from foliant.llm.near_copies import name_of, shingles
from foliant.llm.quality import score_documents
from tests.llm.test_decontaminate import plain as plain_leaks
from tests.llm.test_near_copies import plain as plain_groups
from tests.llm.test_pii import plain as plain_spans

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng = random.Random(16)
    words = [rng.choice(["ri", "sto", "li", "wi", "fo"]) + rng.choice(["ver", "ne", "ght", "nd", "rest"]) + rng.choice(["", "s", "ed", "ing"]) for _ in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(4)]
    docs, labels = [], []
    for i in range(160):
        text = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        if i % 5 == 1:
            text = [w.upper() + "!!" for w in text[:9]] * 6
        if i % 7 == 3:
            text[4:4] = items[i % 4][1].split()
        if i % 11 == 2:
            text[2:2] = [f"mail me at jo.{i}@mail.example.com"]
        docs.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, int(i % 5 != 1), 0))
    docs += [(200 + i, docs[i][1], "en", "s", 0) for i in range(0, 40, 4)]
    docs += [(300, docs[8][1], "en", "t", 0), (300, docs[12][1] + " x", "en", "t", 0), (300, docs[12][1] + " x", "en", "t", 0), (301, None, None, None, None),
             (302, "", "en", "s", 0), (None, docs[16][1], "en", "s", 0)]
    return [(a, t, b, c, len(t) if t is not None else None) for a, t, b, c, _ in docs], items, labels[:120]


def test_stages_match_plain_versions(spark, tmp_path):
    rows, items, labels = fixture()
    docs = spark.createDataFrame(rows, SHAPE).repartition(3)
    for name, frame in (("documents", docs), ("benchmark", spark.createDataFrame(items, "item_id long, text string")),
                        ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    key = lambda r: str(tuple(r))
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, held = [], docs
    for _, stage in corpus_pipeline.STAGES:
        held = spark.createDataFrame(stage(spark, held, sf).collect(), stage(spark, held, sf).schema)
        out.append(held.collect())

    keep = score_documents(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("keep").select("id").collect()
    assert sorted(str(r["doc_id"]) for r in out[0]) == sorted(str(r["id"]) for r in keep)
    assert not any("!!" in (r["text"] or "") for r in out[0]) and len(out[0]) > 120
    assert set(map(key, out[0])) <= set(map(key, rows))

    ids = [r["doc_id"] if r["doc_id"] is not None else 1 << 62 for r in out[0]]
    groups = plain_groups([r["text"] for r in out[0]])
    first = {g: min((i, name_of(shingles(r["text"]))) for i, r, h in zip(ids, out[0], groups) if h == g) for g in groups}
    assert sorted((r["doc_id"] if r["doc_id"] is not None else 1 << 62, name_of(shingles(r["text"]))) for r in out[1]) == sorted(first.values())

    leaked = plain_leaks(list(enumerate(r["text"] for r in out[1])), items)
    assert leaked and sorted(map(key, out[2])) == sorted(key(r) for i, r in enumerate(out[1]) if i not in leaked)

    masked = {r["doc_id"]: r for r in out[3]}
    assert len(out[3]) == len(out[2])
    for r in out[2]:
        spans = [(a, k, b, True) for a, k, b in plain_spans(r["text"] or "")]
        assert masked[r["doc_id"]]["text"] == pii.masked(r["text"], spans)
        assert masked[r["doc_id"]]["n_chars"] == (len(masked[r["doc_id"]]["text"]) if spans else r["n_chars"])

    raw = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Codec(raw).ranks, special_tokens={})
    want = sorted((str(r["doc_id"]), library.encode_ordinary(r["text"] or ""), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out[3])
    assert sorted((str(r["doc_id"]), list(r["ids"]), r["decoded_sha256"]) for r in out[4]) == want
    assert corpus_pipeline.run(spark, sf).count() == len(out[4])
