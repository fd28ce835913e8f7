"""The registered queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import (
    align,
    decontaminate,
    html,
    jaccard,
    lm,
    mixing,
    packing,
    pii,
    quality,
    repeats,
    sharding,
    tokens,
    trie,
)
from nearfield.llm.common import table
from nearfield.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    """Register a query under its function's name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(ship_package(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


@query
def op1_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op2_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html.extracted(pages, html.train(pages))


@query
def op3_kneser_ney(spark, sf_dir):
    return lm.held_out_scores(table(spark, sf_dir, "documents"))


@query
def op4_pareto_mix(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "rec.doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
    )


@query
def op5_separator_scan(spark, sf_dir):
    return tokens.document_tokens(table(spark, sf_dir, "documents"))


@query
def op6_jaccard_join(spark, sf_dir):
    groups = jaccard.linked_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id")


@query
def op7_personal_data(spark, sf_dir):
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(kind.name).cast("long").alias(f"n_{kind.name}") for kind in pii.BASE],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


@query
def op8_decontamination(spark, sf_dir):
    found = decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select("doc_id", "item_id", "matched", "windows")


@query
def op9_repeated_bytes(spark, sf_dir):
    return repeats.kept_bytes(table(spark, sf_dir, "documents"))


@query
def op10_external_shuffle(spark, sf_dir):
    shards = sharding.shuffle_to_shards(table(spark, sf_dir, "documents"))
    return shards.select(
        "rec.doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


@query
def op11_tokenizer_alignment(spark, sf_dir):
    found = align.aligned(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return found.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        "n_best",
        "count_sum",
        digest.alias("groups_sha256"),
    )


@query
def op12_packing(spark, sf_dir):
    pieces = packing.packed(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query
def op13_conversation_trie(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


SQL["op13_conversation_trie"] = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                            coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY pos) AS turns FROM t GROUP BY 1),
-- CRC-32 of the decimal id, bit by bit
h AS (SELECT conv_id, turns, xor(4294967295, list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen(CAST(conv_id AS VARCHAR)) + 1),
          lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
          lambda v, k: xor(v >> 1, 3988292384 * (v & 1))))) % 4 AS h
      FROM own),
c AS (SELECT h.conv_id, list_concat(coalesce(b.turns, h.turns[1:0])[1:h.h], h.turns[h.h + 1:]) AS seq
      FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(seq) AS n, unnest(range(0, len(seq) + 1)) AS depth, seq FROM c),
n AS (SELECT seq[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                             FILTER (n = depth), '')) AS ends_sha256
      FROM p GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN depth = 0 THEN 0
             ELSE len(regexp_extract_all(node[depth].x, '[^\x20\x09-\x0D]+')) END AS words FROM n),
k AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM w WHERE depth > 0 GROUP BY 1),
f AS (SELECT w.*, coalesce(k.n_children, 0) AS n_children FROM w LEFT JOIN k ON k.node = w.node),
a AS (SELECT f.*, unnest(range(0, depth + 1)) AS up FROM f),
s AS (SELECT node[1:up] AS node, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves,
             CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens
      FROM a GROUP BY 1)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves,
       s.saved_tokens, f.ends_sha256
FROM f JOIN s ON s.node = f.node
LEFT JOIN f u ON f.depth > 0 AND u.node = f.node[1:f.depth - 1]
"""
