"""The registered queries of the operators, one opN_<name> each, over whole tables, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, secrets
from foliant.llm.chat import CONTROLS, TAIL, format_conversations, read_back
from foliant.llm.decontaminate import leaked_documents
from foliant.llm.licenses import scan_licenses
from foliant.llm.pii import BASE_KINDS, find_pii
from foliant.llm.quality import score_documents
from foliant.llm.repair import repair_conversations
from foliant.llm.shards import write_shards
from foliant.llm.shared import empty_if_null, shared_folder, text_key
from foliant.llm.simhash import near_duplicates
from foliant.llm.substrings import repeated_passages
from foliant.llm.vectors import linked_vectors
from foliant.llm.whitening import whitened_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(job: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[job.__name__] = job
    return job


def span_digests(found: DataFrame, base_kinds: tuple[str, ...], end: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s[end])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("id").alias("doc_id"), *map(count, base_kinds),
                        F.sha2(listed(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), every_length=True)
    return found.withColumnRenamed("id", "doc_id")


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query
def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    texts = repeated_passages(docs).select("k1", "k2", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    return docs.select("doc_id", *text_key(empty_if_null(F.col("text")))).join(texts, ["k1", "k2"]).drop("k1", "k2")


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("bytes", 256).alias("decoded_sha256"),
                        F.sha2(F.array_join(F.col("starts").cast("array<string>"), " "), 256).alias("starts_sha256"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(find_pii(table(spark, sf_dir, "documents")), BASE_KINDS, "end")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
                        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


@query
def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens are the bytes of the texts, whose ids are the bytes' values."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("tokens"))
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    return write_shards(docs, folder, width=1, key=20_240_229).withColumnRenamed("id", "doc_id")


@query
def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.union(extra)))


@query
def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond a long is null."""
    found = whitened_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened", "explained",
                        "identity_error")


@query
def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(secrets.find_secrets(table(spark, sf_dir, "documents")), secrets.BASE_KINDS, "stop")


@query
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


# --- SQL twins, where SQL can say the same over whole tables ------------------------------


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


ORACLES["op1_chat"] = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
loss AS (SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learnt FROM turns GROUP BY conv_id),
sized AS (SELECT *, length({_escaped_sql('role')}) + length({_escaped_sql('text')}) + {len('<|' + '|>') + 1 + len(TAIL)} AS size FROM turns),
placed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) - size AS position FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       max(length(learnt)) AS loss_chars, max(sha256(learnt)) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars, sha256(string_agg(CAST(position AS BIGINT) || ',', '' ORDER BY turn, role, text)) AS positions_sha256,
       CAST(sum(position) AS BIGINT) AS attended_chars
FROM placed JOIN loss USING (conv_id) GROUP BY conv_id"""

ORACLES["op9_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reached AS (SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT l.y, r.c FROM reached r JOIN links l ON l.x = r.n),
least AS (SELECT n, min(c) AS component_id FROM reached GROUP BY n), degree AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON n = vec_id LEFT JOIN degree ON x = vec_id"""

ORACLES["op10_substrings"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, pos, md5(array_to_string(words[pos:(pos + 34)], ' ')) AS name FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 34)) AS pos FROM d WHERE len(words) >= 35) x),
again AS (SELECT name FROM w GROUP BY name HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + 34)) AS pos FROM w SEMI JOIN again USING (name)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d) y
         ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secret_matches(rule: dict) -> str:
    """All matches of one rule in all texts, by plain scans."""
    regex, group = _quoted(rule["regex"]), rule["group"]
    return f"""SELECT doc_id, {rule["rank"]} AS rank, {_quoted(rule["kind"])} AS kind, {rule["base"]} AS base, regexp_extract_all(t, {regex}, 0) AS m,
       regexp_extract_all(t, {regex}, {group}) AS g, string_split_regex(t, {regex}) AS p, {rule["least"]} AS least FROM d WHERE regexp_matches(t, {regex})"""


ORACLES["op12_secrets"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(map(_secret_matches, secrets.RULES))}),
s AS (SELECT doc_id, rank, kind, base, least, length(m[i]) AS size, length(g[i]) AS judged,
        CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m) x),
held AS (SELECT *, start + size AS stop, kind || ':' || start || ':' || (start + size) AS name FROM s WHERE judged >= least),
kept AS (SELECT * FROM held a WHERE base OR NOT EXISTS (SELECT 1 FROM held b WHERE b.base AND b.doc_id = a.doc_id AND b.start <= a.start AND a.stop <= b.stop)),
listed AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE_KINDS)},
             coalesce(string_agg(name, ',' ORDER BY start, rank) FILTER (base), '') AS base, string_agg(name, ',' ORDER BY start, rank, stop) AS spans FROM kept GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)"""
