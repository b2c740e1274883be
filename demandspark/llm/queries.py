"""The registered queries of the corpus operators, with their production parameters, and the SQL of those it can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.llm import (
    bpe,
    decontamination,
    exact_dedup,
    html_text,
    jaccard_join,
    language_id,
    merkle,
    pii,
    sharding,
    token_store,
    tokenization,
    url_filters,
    whitening,
)
from demandspark.session import shared_dir

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_counts(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    shards = token_store.write_store(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER), END_ID)
    stored = token_store.ids_crc32(token_store.read_store(shards, folder))
    return stored.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenization.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), digest=True)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return language_id.identify(documents, language_id.fit(documents))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.recode(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"), pii.fit(spark))
    counts = [F.size(F.filter("base", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    emptied = merkle.leaf_digest(text=F.replace("text", F.lit("\n"), F.lit("")))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = merkle.manifest(_table(spark, sf_dir, "documents"), tampered=F.when(chosen, emptied))
    rows = rows.withColumn("folded", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return rows.select(
        "doc_id",
        *[merkle.shown(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(merkle.proof_text(F.col("proof")), 256).alias("proof_sha256"),
        merkle.shown(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages"))


OP4_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM t WINDOW same AS (PARTITION BY text)
"""

OP7_SQL = f"""
WITH t AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT >> 2 AS b FROM documents),
h AS (SELECT doc_id, n_bytes, (b << 30) | b AS h FROM t),
p AS (SELECT doc_id, n_bytes, h, CAST(d AS INTEGER) AS depth, h >> (60 - d) AS prefix
      FROM h, (SELECT unnest(range(0, 61)) AS d)),
s AS (SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM p GROUP BY ALL
      HAVING sum(n_bytes) <= {sharding.LIMIT_BYTES} OR min(h) = max(h)),
f AS (SELECT p.*, s.shard_bytes, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS r
      FROM p JOIN s ON p.depth = s.depth AND p.prefix = s.prefix)
SELECT doc_id, n_bytes,
       CASE WHEN depth = 0 THEN '' ELSE right(bin(h | (1::BIGINT << 60)), 60)[1:depth] END AS shard, depth, shard_bytes
FROM f WHERE r = 1
"""


def _leaf_sql(text: str) -> str:
    fields = [f"CAST({text if c == 'text' else c} AS VARCHAR)" for c in merkle.FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _tree_sql(name: str, leaves: str, starts: str) -> str:
    """Nodes, runs and climbs of a tree over ``leaves`` (g, i, n, h), climbed from ``starts`` (rid, g, i, n, h, proof)."""
    left, right = ("coalesce(array_to_string(hs[" + part + "], ''), '')" for part in ("1:c.i % 3", "c.i % 3 + 2:"))
    return f"""
{name}_nodes(g, level, i, n, h) AS (
  SELECT g, 0::BIGINT, i::BIGINT, n::BIGINT, h FROM {leaves} UNION ALL
  SELECT g, level + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name}_nodes WHERE n > 1 GROUP BY g, level, i // 3),
{name}_runs AS (SELECT g, level, i // 3 AS run, list(h ORDER BY i) AS hs FROM {name}_nodes WHERE n > 1 GROUP BY ALL),
{name}_climb(rid, g, level, i, n, h, proof) AS (
  SELECT rid, g, 0::BIGINT, i::BIGINT, n::BIGINT, h, proof FROM {starts} UNION ALL
  SELECT c.rid, c.g, c.level + 1, c.i // 3, (c.n + 2) // 3, sha256({left} || c.h || {right}), c.proof || {left} || {right}
  FROM {name}_climb c JOIN {name}_runs r ON r.g = c.g AND r.level = c.level AND r.run = c.i // 3 WHERE c.n > 1)"""


# The unsigned CRC-32 of a text of ASCII characters, bit by bit.
CRC_SQL = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
  lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)"""

OP11_SQL = f"""
WITH RECURSIVE
doc AS (SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf_sql("text")} AS leaf,
               CASE WHEN {CRC_SQL} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS tampered FROM documents),
num AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
               count(*) OVER (PARTITION BY g) AS n, leaf AS h, coalesce(tampered, leaf) AS start FROM doc),
begun AS (SELECT rid, g, i, n, start AS h, '' AS proof FROM num),
{_tree_sql("own", "num", "begun")},
subs AS (SELECT g AS source, '' AS g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM own_nodes WHERE n = 1),
risen AS (SELECT c.rid, s.g, s.i, s.n, c.h, c.proof FROM own_climb c JOIN subs s ON s.source = c.g WHERE c.n = 1),
{_tree_sql("top", "subs", "risen")}
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = t.h AS verified
FROM num JOIN subs s ON s.source = num.g JOIN top_climb c ON c.rid = num.rid AND c.n = 1 JOIN top_nodes t ON t.n = 1
"""


def _url_levels_sql() -> str:
    """Per depth: the children of each node, their labels, and the shapes moved one segment further."""
    out = ""
    for k in range(url_filters.DEPTH + 1):
        out += f"""
o{k} AS MATERIALIZED (SELECT *, segments[{k + 1}] AS segment FROM s{k} WHERE len(segments) > {k}),
c{k} AS MATERIALIZED (SELECT host, node, segment, sum(labelled) AS l, sum(blocked) AS b, count(*) OVER (PARTITION BY host, node) AS m
  FROM o{k} GROUP BY host, node, segment),
g{k} AS (SELECT *, lag(l) OVER w AS l0, lag(b) OVER w AS b0 FROM c{k} WHERE m <= {url_filters.MAX_CHILDREN} AND l > 0
  WINDOW w AS (PARTITION BY host, node ORDER BY b / l, segment)),
a{k} AS (SELECT *, CASE WHEN l0 IS NULL THEN 0 WHEN b / l - b0 / l0 > {url_filters.Z_LIMIT}
  * sqrt((b + b0) / (l + l0) * (1 - (b + b0) / (l + l0)) * (1 / l + 1 / l0)) THEN 1 ELSE 0 END AS apart FROM g{k}),
k{k} AS MATERIALIZED (SELECT *, sum(apart) OVER (PARTITION BY host, node ORDER BY b / l, segment) AS cluster FROM a{k}),
m{k} AS (SELECT host, node, cluster, string_agg(segment, '|' ORDER BY segment) AS label FROM k{k} GROUP BY ALL),
b{k} AS (SELECT host, node, segment, CASE WHEN m > {url_filters.MAX_CHILDREN} THEN '*' ELSE segment END AS label FROM c{k}
    WHERE m > {url_filters.MAX_CHILDREN} OR l = 0
  UNION ALL SELECT k.host, k.node, k.segment, m.label FROM k{k} k JOIN m{k} m USING (host, node, cluster)),
s{k + 1} AS MATERIALIZED (SELECT o.host, o.segments, o.labelled, o.blocked, o.node || '/' || b.label AS node
    FROM o{k} o JOIN b{k} b USING (host, node, segment)
  UNION ALL SELECT host, segments, labelled, blocked, node FROM s{k} WHERE len(segments) <= {k}),"""
    return out


def _rules_sql() -> str:
    longest = sorted(url_filters.RULES, key=lambda r: (len(r.name), r.verdict == "block"), reverse=True)
    fits = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.verdict} {r.name}'" for r in longest]
    return "CASE " + " ".join(fits) + " END"


OP13_SQL = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '{url_filters.PARTS}', 1), '{url_filters.UPPER}', '{url_filters.LOWER}') AS host,
             regexp_extract(url, '{url_filters.PARTS}', 2) AS path FROM u),
r AS (SELECT *, {_rules_sql()} AS found,
             list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' ELSE s END) AS parts FROM p),
f AS MATERIALIZED (SELECT *, CASE WHEN path = '' THEN [] WHEN len(parts) > {url_filters.DEPTH} THEN list_concat(parts[1:{url_filters.DEPTH}], ['*']) ELSE parts END AS segments FROM r),
s0 AS MATERIALIZED (SELECT host, segments, count(found) AS labelled, count(*) FILTER (found LIKE 'block%') AS blocked, '' AS node FROM f GROUP BY host, segments),{_url_levels_sql()}
e AS (SELECT host, segments, sum(labelled) OVER w AS l, sum(blocked) OVER w AS b, coalesce(sum(blocked) OVER () / sum(labelled) OVER (), 0) AS base
      FROM s{url_filters.DEPTH + 1} WINDOW w AS (PARTITION BY host, node))
SELECT page_id, host, path, split_part(found, ' ', 2) AS rule,
       coalesce(split_part(found, ' ', 1), CASE WHEN l > 0 AND (b + {url_filters.PRIOR_PAGES} * base) / (l + {url_filters.PRIOR_PAGES}) >= {url_filters.PURITY} THEN 'block' ELSE 'allow' END) AS verdict
FROM f JOIN e USING (host, segments)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_token_store": op2_token_store,
        "op3_token_counts": op3_token_counts,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_language_id": op5_language_id,
        "op6_bpe": op6_bpe,
        "op7_sharding": op7_sharding,
        "op8_decontamination": op8_decontamination,
        "op9_pii": op9_pii,
        "op10_html_text": op10_html_text,
        "op11_merkle": op11_merkle,
        "op12_whitening": op12_whitening,
        "op13_url_filter": op13_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op7_sharding": OP7_SQL, "op11_merkle": OP11_SQL, "op13_url_filter": OP13_SQL}
