"""Queries on the embeddings table: projections, neighbours, lists, codes, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.catalog.base import (
    CENTROIDS_SQL,
    HITS,
    VECTORS,
    asked,
    elements,
    gallery,
    knn_ctes,
    label_centroids,
    probes_sql,
    query,
    ranked_sql,
    rounded,
    score_sql,
    scratch,
    table,
)
from nearfield.functions import vectors as V
from nearfield.functions.ids import row_index
from nearfield.functions.pooling import VISION_END, VISION_START, mean_pool, span_pool
from nearfield.operators.dedup import zip_positional
from nearfield.operators.ivf import (
    CentroidTree,
    InvertedLists,
    build_lists,
    knn_ivf_flat,
    knn_tree_rerank,
    probe_join,
    probes,
    train_centroids,
)
from nearfield.operators.knn import (
    Limits,
    keep_first,
    knn_bruteforce,
    knn_flat,
    merge_hits,
    nearest,
    overfetch,
)
from nearfield.operators.lsh import HashTables, knn_lsh
from nearfield.operators.pq import PqSettings, build_codes, knn_ivf_pq, train_codebooks
from nearfield.operators.rerank import rerank_exact
from nearfield.operators.search import search_by_image
from nearfield.operators.store import VectorStore, store_search
from nearfield.plans.evaluate import Evaluation, evaluate_methods, evaluate_run, report_table
from nearfield.plans.methods import METHOD_PRESETS, distinct_metrics
from nearfield.schema import vector_stats
from nearfield.plans.scoring import (
    detail_rows,
    effective_k,
    join_truth,
    method_label,
    order_detail_columns,
    query_metadata,
    score_hits,
    score_queries,
    truth_pairs,
)

from nearfield.session import materialise
from nearfield.sources.embeddings import (
    CorpusSpec,
    QuerySpec,
    corpus_size,
    project_embeddings,
    read_embeddings,
    spec_summary,
)
from nearfield.sources.sinks import union_all

W = "WITH " + VECTORS
WC = W + "," + CENTROIDS_SQL


def corpus(sf_dir: str) -> CorpusSpec:
    return CorpusSpec(load_from_disk=f"{sf_dir}/embeddings.parquet", id_column="vec_id")


# Reading and projecting ---------------------------------------------------------------------


@query(
    "read_embeddings",
    """SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim,
              round(CAST(embedding[1] AS DOUBLE), 6) AS first_value FROM embeddings""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return read_embeddings(spark, corpus(sf)).select(
        "vec_id",
        "label",
        F.size("embedding").alias("dim"),
        F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"),
    )


EXPLODED = """SELECT id, CAST(pos - 1 AS INTEGER) AS pos, round(x, 6) AS value FROM
  (SELECT id, unnest({vector}) AS x, generate_subscripts({vector}, 1) AS pos FROM {source})"""


@query("project_embeddings", W + EXPLODED.format(vector="v", source="e"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    table_ = read_embeddings(spark, corpus(sf))
    return elements(project_embeddings(table_, "vec_id"))


@query("l2_normalize", W + EXPLODED.format(vector="w", source="u"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = gallery(spark, sf)
    return elements(rows.withColumn("embedding", V.l2_normalize(F.col("embedding"))))


@query(
    "l2_normalize_eps",
    W
    + """, d AS (SELECT id, list_transform(v, lambda x: x * 1e-10) AS v FROM e),
    l AS (SELECT *, sqrt(list_dot_product(v, v)) AS len FROM d),
    z AS (SELECT id, list_transform(v, lambda x: x / greatest(len, 1e-9)) AS w FROM l) """
    + EXPLODED.format(vector="w", source="z"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = gallery(spark, sf)
    tiny = F.transform("embedding", lambda x: x.cast("double") * F.lit(1e-10))
    return elements(rows.withColumn("embedding", V.l2_normalize_eps(tiny)))


# Half precision in SQL: spacing by exponent, ties to even.
HALF_SQL = """WITH x AS (SELECT CAST(vec_id AS VARCHAR) AS id, generate_subscripts(embedding, 1) - 1 AS pos,
    CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
p AS (SELECT *, greatest(-14, CASE WHEN v = 0 THEN -14 ELSE floor(log2(abs(v))) END) AS power FROM x),
h AS (SELECT id, pos, v, power, round_even(abs(v) / pow(2, power - 10), 0) AS size FROM p)"""


@query(
    "cast_half",
    HALF_SQL + " SELECT id, CAST(pos AS INTEGER) AS pos, CASE WHEN v < 0 THEN -1 ELSE 1 END * size"
    " * pow(2, power - 10) AS value FROM h",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    halves = gallery(spark, sf).select("id", F.posexplode(V.cast_half("embedding")).alias("pos", "value"))
    return halves.withColumn("value", F.col("value").cast("double"))


@query(
    "pack_half",
    HALF_SQL + """, b AS (SELECT id, pos, CAST((power + 14) * 1024 + size AS BIGINT)
      + CASE WHEN v < 0 THEN 32768 ELSE 0 END AS bits FROM h)
    SELECT id, string_agg(printf('%02X%02X', bits & 255, bits >> 8), '' ORDER BY pos) AS packed
    FROM b GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Two bytes per element."""
    return gallery(spark, sf).select("id", F.hex(V.pack_half("embedding")).alias("packed"))


@query("unpack_half", HALF_SQL + " SELECT id, CAST(pos AS INTEGER) AS pos, CASE WHEN v < 0 THEN -1"
       " ELSE 1 END * size * pow(2, power - 10) AS value FROM h")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Packed vectors written, read back and unpacked."""
    path = scratch(spark, "halves")
    gallery(spark, sf).select("id", V.pack_half("embedding").alias("packed")).write.parquet(path)
    back = spark.read.parquet(path).select("id", F.posexplode(V.unpack_half("packed")).alias("pos", "value"))
    return back.withColumn("value", F.col("value").cast("double"))


NEXT_SQL = """ SELECT q.id AS qid, g.id AS id, round({score}, 6) AS score
  FROM u q JOIN u g ON CAST(g.id AS BIGINT) = CAST(q.id AS BIGINT) + 1"""


def neighbours_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector with the one that has the next id."""
    rows = table(spark, sf, "embeddings")
    left = rows.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("q"))
    right = rows.select("vec_id", F.col("embedding").alias("g"))
    return left.join(right, "vec_id").select(
        (F.col("vec_id") - 1).cast("string").alias("qid"),
        F.col("vec_id").cast("string").alias("id"),
        "q",
        "g",
    )


def _pair_query(metric: str) -> None:
    @query(f"pair_score_{metric}", W + NEXT_SQL.format(score=score_sql(metric)))
    def _(spark: SparkSession, sf: str) -> DataFrame:
        score = V.pair_score(F.col("q"), F.col("g"), metric)
        return neighbours_by_id(spark, sf).select("qid", "id", F.round(score, 6).alias("score"))


for _metric in ("l2", "ip", "cosine"):
    _pair_query(_metric)


# Pooling ------------------------------------------------------------------------------------

POOL_SQL = """{tokens},
m AS (SELECT id, pos, avg(x) AS x FROM (SELECT id, unnest(v) AS x,
      generate_subscripts(v, 1) AS pos FROM t) GROUP BY 1, 2),
p AS (SELECT id, list(x ORDER BY pos) AS v FROM m GROUP BY 1),
l AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS len FROM p),
z AS (SELECT id, list_transform(v, lambda x: x / CASE WHEN len = 0 THEN 1 ELSE len END) AS w
      FROM l) """ + EXPLODED.format(vector="w", source="z")


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as tokens of their label: position by id, markers from the id's digits."""
    rows = table(spark, sf, "embeddings")
    marker = F.when(F.col("vec_id") % 50 < 10, VISION_START).when(
        F.col("vec_id") % 50 >= 40, VISION_END
    )
    return rows.select(
        F.col("label").cast("string").alias("id"),
        F.col("vec_id").alias("token_pos"),
        F.coalesce(marker, F.lit(0)).alias("token_id"),
        "embedding",
    )


@query(
    "mean_pool",
    W + POOL_SQL.format(tokens=", t AS (SELECT CAST(label AS VARCHAR) AS id, v FROM e)"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return elements(mean_pool(tokens(spark, sf)))


@query(
    "span_pool",
    W
    + POOL_SQL.format(
        tokens=""", a AS (SELECT CAST(label AS VARCHAR) AS id, CAST(id AS BIGINT) AS place, v FROM e),
    k AS (SELECT id, min(CASE WHEN place % 50 < 10 THEN place END) AS lo,
                 min(CASE WHEN place % 50 >= 40 THEN place END) AS hi FROM a GROUP BY 1),
    t AS (SELECT a.id, a.v FROM a JOIN k ON a.id = k.id
          WHERE lo IS NULL OR (place BETWEEN lo AND hi))"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return elements(span_pool(tokens(spark, sf)))


# Exact search -------------------------------------------------------------------------------


def _flat_query(metric: str) -> None:
    name = "knn_flat" if metric == "cosine" else f"knn_flat_{metric}"

    @query(name, W + "," + knn_ctes(metric, 10) + HITS + "h")
    def _(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(knn_flat(gallery(spark, sf), asked(spark, sf), 10, metric))


for _metric in ("l2", "ip", "cosine"):
    _flat_query(_metric)


@query(
    "knn_bruteforce",
    W
    + ","
    + ",".join(knn_ctes(m, 10, f"h_{m}") for m in ("cosine", "ip", "l2"))
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, qid, rank, id, round(score, 6) AS score FROM h_{m}"
        for m in ("cosine", "ip", "l2")
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    metrics = distinct_metrics([{"metric": "L2"}, {"metric": "ip"}, {"metric": "cosine"}, {}])
    runs = knn_bruteforce(gallery(spark, sf), asked(spark, sf), 10, metrics)
    parts = [rounded(hits).withColumn("metric", F.lit(name)) for name, hits in runs.items()]
    return union_all(parts).select("metric", "qid", "rank", "id", "score")


@query("knn_exact", W + "," + knn_ctes("cosine", 10) + HITS + "h")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The form for two large sides: the gallery is scanned in place once per tile of queries."""
    small = Limits(broadcast_bytes=1, query_tile_bytes=2 << 20, gallery_tile_bytes=128 << 10)
    rows = gallery(spark, sf)
    return rounded(nearest(rows, asked(spark, sf), 10, "cosine", limits=small))




@query(
    "topk_per_query",
    W
    + ", p AS (SELECT CAST(o_custkey AS VARCHAR) AS qid, CAST(o_orderkey AS VARCHAR) AS id,"
    + " o_totalprice AS score FROM orders) "
    + HITS
    + f"({ranked_sql('p', 'ip', 5)})",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Merging partial lists: the best five orders of every customer."""
    partial = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("qid"),
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_totalprice").alias("score"),
    )
    return rounded(merge_hits(partial, 5, "ip"))


@query(
    "hit_rank",
    W + "," + knn_ctes("l2", 3) + " SELECT qid, id, rank FROM h",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    hits = nearest(gallery(spark, sf), asked(spark, sf), 3, "l2")
    return hits.select("qid", "id", "rank")


@query("overfetch_k", W + "," + knn_ctes("cosine", 4) + HITS + "h")
def _(spark: SparkSession, sf: str) -> DataFrame:
    wide = nearest(gallery(spark, sf), asked(spark, sf), overfetch(4, 25), "cosine")
    return rounded(keep_first(wide, 4))


@query("effective_k", W + "," + knn_ctes("ip", 12) + HITS + "h")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(nearest(gallery(spark, sf), asked(spark, sf), effective_k(3, [12, 1]), "ip"))


@query(
    "similarity_score",
    W + "," + knn_ctes("l2", 5)
    + " SELECT qid, rank, id, round(score, 6) AS distance, round(0 - score, 6) AS score FROM h",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    hits = nearest(gallery(spark, sf), asked(spark, sf), 5, "l2")
    return hits.select(
        "qid",
        "rank",
        "id",
        F.round("score", 6).alias("distance"),
        F.round(V.similarity_score(F.col("score"), "l2"), 6).alias("score"),
    )


@query(
    "rerank_exact",
    W + "," + knn_ctes("l2", 20)
    + ", r AS (SELECT h.qid, h.id, list_dot_product(q.w, g.w) AS score FROM h"
    + " JOIN u q ON q.id = h.qid JOIN u g ON g.id = h.id) "
    + HITS + f"({ranked_sql('r', 'cosine', 5)})",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows, queries = gallery(spark, sf), asked(spark, sf)
    candidates = nearest(rows, queries, 20, "l2")
    return rounded(rerank_exact(candidates, rows, queries, 5, "cosine"))


# Inverted lists, trees, hash tables, codes --------------------------------------------------


def _lists_sql(metric: str, nprobe: int, k: int) -> str:
    return (
        WC + "," + probes_sql(metric, "home", 1) + "," + probes_sql(metric, "pr", nprobe)
        + f""", p AS (SELECT pr.id AS qid, home.id AS id, {score_sql(metric)} AS score
              FROM pr JOIN home ON pr.list_id = home.list_id
              JOIN u q ON q.id = pr.id JOIN u g ON g.id = home.id)"""
        + HITS + f"({ranked_sql('p', metric, k)})"
    )


def _lists_query(metric: str) -> None:
    @query("knn_ivf_flat" if metric == "cosine" else f"knn_ivf_flat_{metric}", _lists_sql(metric, 3, 10))
    def _(spark: SparkSession, sf: str) -> DataFrame:
        rows = gallery(spark, sf)
        lists = build_lists(rows, label_centroids(rows), metric)
        return rounded(knn_ivf_flat(lists, asked(spark, sf), 10, nprobe=3))


for _metric in ("l2", "ip", "cosine"):
    _lists_query(_metric)


@query("knn_ivf_flat_tiles", _lists_sql("cosine", 3, 10))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Lists and queries both cut into bounded tiles; long lists are split over many tasks."""
    small = Limits(broadcast_bytes=4096, query_tile_bytes=32 << 10, gallery_tile_bytes=16 << 10)
    rows = gallery(spark, sf)
    lists = build_lists(rows, label_centroids(rows), "cosine", limits=small)
    return rounded(knn_ivf_flat(lists, asked(spark, sf), 10, nprobe=3, limits=small))


# Filtered search over lists: probes count matching rows only.
FILTERED_LISTS_SQL = (
    WC + "," + probes_sql("cosine", "home", 1)
    + f""",
m AS (SELECT home.id, list_id FROM home JOIN e ON e.id = home.id WHERE v[1] > 0.29),
mc AS (SELECT list_id, count(*) AS matches FROM m GROUP BY 1),
o AS (SELECT q.id, g.list_id, matches, row_number() OVER (PARTITION BY q.id
        ORDER BY {score_sql("cosine")} DESC, g.list_id) AS r
      FROM u q, c g JOIN mc ON mc.list_id = g.list_id),
b AS (SELECT *, coalesce(sum(matches) OVER (PARTITION BY id ORDER BY r
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
p AS (SELECT b.id AS qid, m.id AS id, {score_sql("cosine")} AS score
      FROM b JOIN m ON m.list_id = b.list_id JOIN u q ON q.id = b.id JOIN u g ON g.id = m.id
      WHERE r <= 1 OR before < 3)"""
    + HITS + f"({ranked_sql('p', 'cosine', 3)})"
)


@query("filtered_search_lists", FILTERED_LISTS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A rare predicate over saved lists: queries open lists until enough rows match."""
    rows = gallery(spark, sf).withColumn("first", F.col("embedding")[0].cast("double"))
    path = scratch(spark, "filtered-lists")
    build_lists(rows, label_centroids(rows), "cosine", attributes=["first"]).save(path)
    lists = InvertedLists.load(spark, path, "cosine")
    return rounded(
        knn_ivf_flat(lists, asked(spark, sf), 3, nprobe=1, where="first > 0.29")
    )


TREE_SQL = (
    WC + f""",
te AS (SELECT label // 4 AS top, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
tm AS (SELECT top, pos, CAST(CAST(round(avg(x), 6) AS FLOAT) AS DOUBLE) AS x FROM te GROUP BY 1, 2),
tv AS (SELECT top, list(x ORDER BY pos) AS v FROM tm GROUP BY 1),
tn AS (SELECT *, sqrt(list_dot_product(v, v)) AS len FROM tv),
t AS (SELECT top, list_transform(v, lambda x: x / CASE WHEN len = 0 THEN 1 ELSE len END) AS w FROM tn),
ts AS (SELECT q.id, g.top, {score_sql("cosine")} AS s FROM u q, t g),
beam AS (SELECT id, top FROM ts QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, top) <= 2),
lp AS (SELECT q.id, g.list_id, {score_sql("cosine")} AS s FROM beam
       JOIN u q ON q.id = beam.id JOIN c g ON g.list_id // 4 = beam.top),
lr AS (SELECT id, list_id, row_number() OVER (PARTITION BY id ORDER BY s DESC, list_id) AS r FROM lp),
p AS (SELECT a.id AS qid, b.id AS id, {score_sql("cosine")} AS score
      FROM lr a JOIN lr b ON b.list_id = a.list_id AND b.r = 1 AND a.r <= 3
      JOIN u q ON q.id = a.id JOIN u g ON g.id = b.id)"""
    + HITS + f"({ranked_sql('p', 'cosine', 10)})"
)


@query("knn_ivf_tree", TREE_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Two levels of centroids: rows and queries meet the lists of their two best tops only."""
    rows = gallery(spark, sf)
    tops = label_centroids(rows.withColumn("label", F.floor(F.col("label") / 4).cast("int")))
    leaves = label_centroids(rows).withColumn("top_id", F.floor(F.col("list_id") / 4).cast("long"))
    lists = build_lists(rows, CentroidTree(tops, leaves, beam=2), "cosine")
    return rounded(knn_ivf_flat(lists, asked(spark, sf), 10, nprobe=3))


@query(
    "probe_join",
    WC + "," + probes_sql("l2", "home", 1) + "," + probes_sql("l2", "pr", 3)
    + """, s AS (SELECT list_id, count(*) AS list_rows FROM home GROUP BY 1)
    SELECT pr.id AS qid, list_id, list_rows FROM pr JOIN s USING (list_id)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = gallery(spark, sf)
    lists = build_lists(rows, label_centroids(rows), "l2")
    return probe_join(probes(asked(spark, sf), lists, 3), lists.rows)


@query("knn_tree_rerank", _lists_sql("cosine", 4, 10))
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = gallery(spark, sf)
    lists = build_lists(rows, label_centroids(rows), "cosine")
    hits = knn_tree_rerank(
        rows,
        asked(spark, sf),
        10,
        "cosine",
        lists=lists,
        num_leaves_to_search=4,
        num_neighbors=15,
        reorder_k=25,
    )
    return rounded(hits)


HASHES = HashTables(tables=4, bits=6, seed=42)

LSH_SQL = W + f""", sg AS (SELECT t, b, d, CASE WHEN substr(md5('{HASHES.seed}:' || t || ':' || b
       || ':' || d), 1, 1) < '8' THEN 1 ELSE -1 END AS s
       FROM range({HASHES.tables}) a(t), range({HASHES.bits}) x(b),
            range((SELECT max(len(v)) FROM e)) y(d)),
x AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS d FROM e),
bt AS (SELECT id, t, b, CASE WHEN sum(x * s) >= 0 THEN 1 ELSE 0 END AS bit
       FROM x JOIN sg USING (d) GROUP BY 1, 2, 3),
bk AS (SELECT id, t, sum(bit << b) AS code FROM bt GROUP BY 1, 2),
cd AS (SELECT DISTINCT a.id AS qid, b.id AS id FROM bk a
       JOIN bk b ON a.t = b.t AND a.code = b.code),
p AS (SELECT cd.qid, cd.id, {score_sql("cosine")} AS score
      FROM cd JOIN u q ON q.id = cd.qid JOIN u g ON g.id = cd.id)""" + HITS + (
    f"({ranked_sql('p', 'cosine', 10)})"
)


@query("knn_lsh", LSH_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = gallery(spark, sf)
    return rounded(knn_lsh(rows, asked(spark, sf), 10, "cosine", config=HASHES))


@query("knn_lsh_tiles", LSH_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets of both sides cut into bounded tiles."""
    small = Limits(broadcast_bytes=1, query_tile_bytes=16 << 10, gallery_tile_bytes=8 << 10)
    rows = gallery(spark, sf)
    return rounded(
        knn_lsh(rows, asked(spark, sf), 10, "cosine", config=HASHES, limits=small)
    )


REPEATED = " UNION ALL ".join(
    f"""SELECT '{form}' AS form, CAST(label AS VARCHAR) AS qid, rank, h.id, round(score, 6) AS score
    FROM h JOIN u ON u.id = h.qid WHERE label < 3"""
    for form in ("queries", "gallery", "tiles")
)


@query("knn_repeated_ids", W + "," + knn_ctes("l2", 4) + REPEATED)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Many queries share an id; every one of them is answered, in each physical form."""
    rows = gallery(spark, sf)
    own = rows.where("label < 3").select(F.col("label").cast("string").alias("qid"), "embedding")
    asked_rows, dim = vector_stats(own)
    # Bounds below what the queries take with their hits: first one that the gallery fits (a
    # query is counted with room for its k hits, a gallery row with its vector), then none.
    room = Limits(broadcast_bytes=4 * dim * rows.count())
    forms = {
        "queries": nearest(rows, own, 4),
        "gallery": nearest(rows, own, 4, limits=room)
        if asked_rows > room.rows(room.broadcast_bytes, dim, 0, 4)
        else nearest(rows, own, 4, limits=Limits(broadcast_bytes=1)),
        "tiles": nearest(
            rows,
            own,
            4,
            limits=Limits(broadcast_bytes=1, query_tile_bytes=8 << 10, gallery_tile_bytes=16 << 10),
        ),
    }
    parts = [rounded(hits).withColumn("form", F.lit(form)) for form, hits in forms.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _starts_sql(n: int) -> str:
    return f"""
c0 AS (SELECT row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS list_id, v FROM e
       QUALIFY row_number() OVER (ORDER BY md5('42:' || id), id) <= {n})"""


def _step_sql(before: str, after: str) -> str:
    """One of Lloyd's steps from one CTE of centroids to the next."""
    gap = "list_transform(list_zip(e.v, c.v), lambda p: p[1] - p[2])"
    return f"""
{after}_a AS (SELECT id, e.v, list_id FROM e CROSS JOIN {before} c
  QUALIFY row_number() OVER (PARTITION BY id
    ORDER BY list_dot_product({gap}, {gap}), list_id) = 1),
{after}_x AS (SELECT list_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {after}_a),
{after}_m AS (SELECT list_id, pos, CAST(CAST(sum(floor(x * 1048576 + 0.5) / 1048576) / count(*)
              AS FLOAT) AS DOUBLE) AS x FROM {after}_x GROUP BY 1, 2),
{after}_l AS (SELECT list_id, list(x ORDER BY pos) AS v FROM {after}_m GROUP BY 1),
{after} AS (SELECT list_id, coalesce(l.v, c.v) AS v FROM {before} c LEFT JOIN {after}_l l
            USING (list_id))"""


@query(
    "train_centroids",
    W + "," + ",".join([_starts_sql(8), _step_sql("c0", "c1"), _step_sql("c1", "c2")])
    + """ SELECT CAST(list_id AS BIGINT) AS list_id, CAST(pos - 1 AS INTEGER) AS pos,
    round(x, 6) AS value FROM (SELECT list_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos
    FROM c2)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Two of Lloyd's steps over all rows, from starting points that the ids choose."""
    return elements(train_centroids(gallery(spark, sf), 8, "l2", max_iter=2), "list_id")


def coded(spark: SparkSession, sf: str, metric: str = "cosine"):
    rows = gallery(spark, sf)
    lists = build_lists(rows, label_centroids(rows), metric)
    settings = PqSettings(m=8, nbits=4)
    return build_codes(lists, materialise(train_codebooks(lists, settings)), settings)


@query("train_codebooks")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = gallery(spark, sf)
    lists = build_lists(rows, label_centroids(rows), "l2")
    books = train_codebooks(lists, PqSettings(m=8, nbits=4))
    return books.withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 6)))


@query("knn_ivf_pq")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(knn_ivf_pq(coded(spark, sf), asked(spark, sf), 10, nprobe=5))


@query("knn_ivf_pq_rerank")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The 100 best by code, rescored with their vectors."""
    return rounded(knn_ivf_pq(coded(spark, sf), asked(spark, sf), 10, nprobe=10, rerank_k=100))


# Search modes -------------------------------------------------------------------------------


@query("search_by_image", W + "," + knn_ctes("cosine", 6) + HITS + "h")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = gallery(spark, sf)
    ids = rows.select(F.col("id").alias("qid"), F.col("id").alias("image_id"))
    return rounded(search_by_image(rows, ids, 6, "cosine"))


@query("search_saved_lists", _lists_sql("cosine", 3, 6))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A search mode answered by lists that were saved and loaded again."""
    rows, path = gallery(spark, sf), scratch(spark, "saved")
    build_lists(rows, label_centroids(rows), "cosine").save(path)
    lists = InvertedLists.load(spark, path, "cosine")
    ids = rows.select(F.col("id").alias("qid"), F.col("id").alias("image_id"))

    def probing(_, queries: DataFrame, k: int, metric: str) -> DataFrame:
        return knn_ivf_flat(lists, queries, k, nprobe=3)

    return rounded(search_by_image(rows, ids, 6, "cosine", search=probing))


@query(
    "vector_store_search",
    W + "," + knn_ctes("ip", 4) + """ SELECT qid, rank, id, round(score, 6) AS distance,
    'given' AS model_name, 'vectors' AS dataset_name FROM h""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The store end to end: named fields, default output fields, metric from its settings."""
    config = {
        "dim": 64,
        "metric_type": "COSINE",
        "search": {"params": {"metric_type": "L2"}},
        "fields": {"id": {"name": "key"}, "vector": {"name": "values"}},
    }
    store = VectorStore(spark, scratch(spark, "store"), config).create()
    rows = gallery(spark, sf).select("id", "embedding")
    store.add(rows, model_name="given", dataset_name="vectors")
    # Parameters of the call win over those of the settings.
    hits = store.search(asked(spark, sf), top_k=4, search_params={"metric_type": "IP"})
    return rounded(hits, "model_name", "dataset_name", score="distance")


FILTERED_SQL = (
    W + ", p AS (SELECT q.id AS qid, g.id AS id, list_dot_product(q.w, g.w) AS score"
    " FROM u q, u g WHERE g.label IN (1, 4, 7)) "
)


@query("filtered_search", FILTERED_SQL + HITS + f"({ranked_sql('p', 'cosine', 5)})")
def _(spark: SparkSession, sf: str) -> DataFrame:
    hits = store_search(
        gallery(spark, sf),
        asked(spark, sf),
        top_k=5,
        metric="cosine",
        filter_expression="label IN (1, 4, 7)",
    )
    return rounded(hits, score="distance").withColumnRenamed("distance", "score")


@query(
    "store_search",
    FILTERED_SQL
    + f"SELECT qid, rank, h.id, round(score, 6) AS distance, u.label FROM"
    f" ({ranked_sql('p', 'cosine', 5)}) h JOIN u ON u.id = h.id",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    hits = store_search(
        gallery(spark, sf),
        asked(spark, sf),
        top_k=5,
        metric="cosine",
        filter_expression="label IN (1, 4, 7)",
        output_fields=["label"],
    )
    return rounded(hits, "label", score="distance")


# Scoring ------------------------------------------------------------------------------------

POINTS = (1, 5, 10)

# Truth of a query: the other rows of its group of five ids, as an image has five captions. The
# labels are written as file names, and all of them are kept.
TRUTH_SQL = """
labels AS (SELECT q.id AS qid, g.id || '.JPG' AS raw, g.id AS lab FROM u q JOIN u g
           ON CAST(q.id AS BIGINT) // 5 = CAST(g.id AS BIGINT) // 5 WHERE q.id <> g.id),
truth AS (SELECT u.id AS qid, count(lab) AS n FROM u LEFT JOIN labels ON labels.qid = u.id
          GROUP BY 1)"""

SCORED_SQL = (
    W + "," + TRUTH_SQL + "," + knn_ctes("cosine", 10)
    + """, f AS (SELECT h.*, lab IS NOT NULL AS is_relevant FROM h
         LEFT JOIN labels l ON l.qid = h.qid AND l.lab = h.id)"""
)

PER_QUERY_SQL = (
    SCORED_SQL
    + ", s AS (SELECT t.qid, t.n, coalesce(bool_or(is_relevant), false) AS any_hit, "
    + ", ".join(
        f"CASE WHEN n > 0 THEN CAST(count(*) FILTER (is_relevant AND rank <= {p}) AS DOUBLE) / n"
        f" END AS r{p}"
        for p in POINTS
    )
    + " FROM truth t LEFT JOIN f ON f.qid = t.qid GROUP BY t.qid, t.n)"
)


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """Queries with ``relevant_ids`` (file names of the group's other rows) and ``query_index``."""
    group = F.floor(F.col("vec_id") / 5)
    rows = table(spark, sf, "embeddings")
    named = rows.groupBy(group.alias("group")).agg(F.collect_list("vec_id").alias("members"))
    others = F.transform(
        F.filter("members", lambda other: other != F.col("vec_id")),
        lambda other: F.concat(other.cast("string"), F.lit(".JPG")),
    )
    return (
        rows.withColumn("group", group)
        .join(named, "group")
        .select(
            F.col("vec_id").cast("string").alias("qid"),
            "embedding",
            "label",
            others.alias("relevant_ids"),
            F.col("vec_id").alias("query_index"),
        )
    )


def cosine_hits(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(gallery(spark, sf), asked(spark, sf), 10, "cosine")


@query("join_truth", SCORED_SQL + " SELECT qid, rank, id, is_relevant FROM f")
def _(spark: SparkSession, sf: str) -> DataFrame:
    flagged = join_truth(cosine_hits(spark, sf), truth_pairs(truth(spark, sf), "relevant_ids"))
    return flagged.select("qid", "rank", "id", "is_relevant")


@query(
    "accuracy_at_k",
    PER_QUERY_SQL
    + " SELECT round(avg(CAST(any_hit AS DOUBLE)), 6) AS accuracy, count(*) AS num_queries FROM s",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    scores = score_hits(cosine_hits(spark, sf), truth(spark, sf), "relevant_ids", [])
    return scores.select(F.round("accuracy", 6).alias("accuracy"), "num_queries")


RECALL_SQL = PER_QUERY_SQL + " SELECT " + ", ".join(
    f"round(avg(r{p}), 6) AS recall_{p}" for p in POINTS
) + " FROM s"


def _recall(spark: SparkSession, sf: str, points) -> DataFrame:
    scores = score_hits(cosine_hits(spark, sf), truth(spark, sf), "relevant_ids", points)
    return scores.select(*[F.round(f"`recall@{p}`", 6).alias(f"recall_{p}") for p in POINTS])


@query("recall_at_p", RECALL_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _recall(spark, sf, POINTS)


@query("recall_points", RECALL_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _recall(spark, sf, [10, 1, 5, 5, 0, -3, 1])


@query(
    "score_queries",
    PER_QUERY_SQL
    + " SELECT qid, n AS n_labels, any_hit, "
    + ", ".join(f"round(r{p}, 6) AS recall_{p}" for p in POINTS)
    + " FROM s",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    queries = truth(spark, sf)
    pairs = truth_pairs(queries, "relevant_ids")
    scores = score_queries(join_truth(cosine_hits(spark, sf), pairs), queries, pairs, POINTS)
    return scores.select(
        "qid",
        "n_labels",
        "any_hit",
        *[F.round(f"`recall@{p}`", 6).alias(f"recall_{p}") for p in POINTS],
    )


DETAIL_SQL = (
    SCORED_SQL
    + """, j AS (SELECT qid, string_agg(raw, '; ' ORDER BY raw) AS joined, count(*) AS n
         FROM labels GROUP BY 1)
    SELECT CAST(u.id AS BIGINT) AS query_index, u.id AS query_embedding_id,
           CAST(u.label AS VARCHAR) AS category, 'faiss' AS backend, 'flat' AS method,
           'faiss/flat (cosine)' AS method_label, 'cosine' AS metric, false AS use_gpu,
           10 AS top_k, f.rank, f.id AS image_id, round(f.score, 6) AS distance,
           coalesce(f.is_relevant, false) AS is_relevant, j.joined AS relevant_ids,
           CAST(coalesce(j.n, 0) AS INTEGER) AS relevant_count
    FROM u LEFT JOIN f ON f.qid = u.id LEFT JOIN j ON j.qid = u.id"""
)


def _details(spark: SparkSession, sf: str) -> DataFrame:
    queries = truth(spark, sf).withColumn("category", F.col("label").cast("string"))
    rows = detail_rows(
        cosine_hits(spark, sf),
        queries,
        backend="faiss",
        method="flat",
        metric="cosine",
        top_k=10,
        relevance="relevant_ids",
    )
    return rows.withColumn("distance", F.round("distance", 6))


@query("detail_rows", DETAIL_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _details(spark, sf)


@query(
    "order_detail_columns",
    DETAIL_SQL.replace("SELECT CAST(u.id AS BIGINT)", "SELECT 'x' AS extra, CAST(u.id AS BIGINT)"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _details(spark, sf).withColumn("extra", F.lit("x"))
    shuffled = rows.select(*sorted(rows.columns, reverse=True))
    return shuffled.select(*order_detail_columns(shuffled.columns))


@query(
    "query_metadata",
    "SELECT CAST(vec_id AS VARCHAR) AS qid, CAST(label AS VARCHAR) AS category,"
    " 'q ' || vec_id AS query_text FROM embeddings",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    queries = asked(spark, sf).withColumns(
        {
            "category": F.col("label").cast("string"),
            "query_text": F.concat(F.lit("q "), "qid"),
            "other": F.lit(1),
        }
    )
    return query_metadata(queries, ["embedding"])


@query(
    "join_query_metadata",
    W + "," + knn_ctes("ip", 3) + " SELECT h.qid, rank, h.id, CAST(u.label AS VARCHAR) AS category"
    " FROM h JOIN u ON u.id = h.qid",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    queries = asked(spark, sf).withColumn("category", F.col("label").cast("string"))
    hits = nearest(gallery(spark, sf), queries.select("qid", "embedding"), 3, "ip")
    joined = hits.join(query_metadata(queries, ["embedding"]), "qid", "left")
    return joined.select("qid", "rank", "id", "category")


@query(
    "method_label",
    W + "," + knn_ctes("ip", 1)
    + " SELECT 'faiss/flat (ip)' AS method_label, count(*) AS hits FROM h",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    hits = nearest(gallery(spark, sf), asked(spark, sf), 1, "ip")
    return hits.groupBy(method_label("faiss", "flat", "ip").alias("method_label")).agg(
        F.count("*").alias("hits")
    )


def _metric_scores(metric: str) -> str:
    return f"""SELECT '{metric}' AS metric, round(avg(CAST(hit AS DOUBLE)), 4) AS acc FROM (
      SELECT u.id, coalesce(bool_or(l.lab IS NOT NULL), false) AS hit FROM u
      JOIN h_{metric} h ON h.qid = u.id LEFT JOIN labels l ON l.qid = h.qid AND l.lab = h.id
      GROUP BY 1)"""


UNION_SQL = (
    W + "," + TRUTH_SQL + "," + ",".join(knn_ctes(m, 5, f"h_{m}") for m in ("cosine", "ip", "l2"))
)


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the exact runs, the last one without the columns that get filled in."""
    rows, held = gallery(spark, sf), truth(spark, sf)
    parts = []
    for metric in ("cosine", "ip", "l2"):
        hits = nearest(rows, held, 5, metric)
        scores = score_hits(hits, held, "relevant_ids", [1]).drop("num_queries")
        parts.append(
            scores.withColumns(
                {
                    "backend": F.lit("bruteforce"),
                    "method": F.lit("bruteforce"),
                    "metric": F.lit(metric),
                    "use_gpu": F.lit(False),
                    "index_time": F.lit(None).cast("double"),
                    **({} if metric == "l2" else {"top_k": F.lit(5)}),
                }
            )
        )
    return union_all(parts).withColumn("top_k", F.coalesce("top_k", F.lit(5)))


@query(
    "union_results",
    UNION_SQL + ", s AS (" + " UNION ALL ".join(map(_metric_scores, ("cosine", "ip", "l2")))
    + ") SELECT metric, acc AS accuracy, 5 AS top_k FROM s",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf).select("metric", F.round("accuracy", 4).alias("accuracy"), "top_k")


@query(
    "report_table",
    UNION_SQL + ", s AS (" + " UNION ALL ".join(map(_metric_scores, ("cosine", "ip", "l2")))
    + """) SELECT 'bruteforce' AS backend, 'bruteforce' AS method, metric, 'false' AS use_gpu,
       '-' AS index_time, printf('%.4f', acc) AS accuracy, '5' AS top_k, '-' AS num_queries
       FROM s""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    report = report_table(_summary(spark, sf), [1])
    return report.drop("search_time", "avg_query_time", "recall@1")


# Whole evaluations (rows-only: they carry wall-clock times) ---------------------------------

SMALL_METHODS = [
    {"backend": "faiss", "method": "flat", "metric": "cosine"},
    {"backend": "faiss", "method": "ivf_flat", "metric": "cosine", "nlist": 16, "nprobe": 8},
    {"backend": "hnswlib", "method": "graph", "metric": "cosine", "ef_search": 64},
    {
        "backend": "scann",
        "method": "tree",
        "metric": "cosine",
        "num_leaves": 16,
        "num_leaves_to_search": 8,
        "num_neighbors": 20,
        "reorder_k": 40,
    },
]


@query("evaluate_trained_methods")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate_methods(
        gallery(spark, sf).select("id", "embedding"),
        truth(spark, sf),
        SMALL_METHODS,
        top_k=10,
        recall_at=POINTS,
        relevance="relevant_ids",
        bruteforce=["cosine"],
    ).summary


EXACT_METHODS = [
    {"backend": "FAISS", "method": "flat", "metric": "cosine"},
    {"backend": "faiss", "method": "flat", "metric": "IP", "use_gpu": True},
    {"backend": "scann", "name": "exact", "metric": "l2", "num_neighbors": 20},
]


def _summary_sql(backend: str, method: str, metric: str) -> str:
    parts = ", ".join(
        f"round(avg(CASE WHEN n > 0 THEN CAST(c{p} AS DOUBLE) / n END), 6) AS recall_{p}"
        for p in POINTS
    )
    counts = ", ".join(f"count(lab) FILTER (rank <= {p}) AS c{p}" for p in POINTS)
    return f"""SELECT '{backend}' AS backend, '{method}' AS method, '{metric}' AS metric,
      (SELECT count(*) FROM e) AS ntotal, round(avg(CASE WHEN c10 > 0 THEN 1.0 ELSE 0 END), 6)
      AS accuracy, {parts}, count(*) AS num_queries, 10 AS top_k FROM (
      SELECT t.qid, t.n, {counts} FROM truth t JOIN h_{metric} h ON h.qid = t.qid
      LEFT JOIN labels l ON l.qid = h.qid AND l.lab = h.id GROUP BY t.qid, t.n)"""


@query(
    "evaluate_methods",
    W + "," + TRUTH_SQL + "," + ",".join(knn_ctes(m, 10, f"h_{m}") for m in ("cosine", "ip", "l2"))
    + " UNION ALL ".join(
        _summary_sql(*entry)
        for entry in (
            ("faiss", "flat", "cosine"),
            ("faiss", "flat", "ip"),
            ("scann", "exact", "l2"),
            ("bruteforce", "bruteforce", "cosine"),
            ("bruteforce", "bruteforce", "ip"),
            ("bruteforce", "bruteforce", "l2"),
        )
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The exact methods, without the columns that hold wall-clock times."""
    summary = evaluate_methods(
        gallery(spark, sf).select("id", "embedding"),
        truth(spark, sf),
        EXACT_METHODS,
        top_k=10,
        recall_at=POINTS,
        relevance="relevant_ids",
        bruteforce=distinct_metrics(EXACT_METHODS),
    ).summary
    return summary.select(
        "backend",
        "method",
        "metric",
        "ntotal",
        F.round("accuracy", 6).alias("accuracy"),
        *[F.round(f"`recall@{p}`", 6).alias(f"recall_{p}") for p in POINTS],
        "num_queries",
        "top_k",
    )


@query(
    "method_timing",
    "SELECT 'faiss' AS backend, 'flat' AS method, count(*) AS ntotal, true AS timed"
    " FROM embeddings",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    queries = asked(spark, sf).withColumn("query_index", F.col("qid").cast("bigint"))
    outcome = evaluate_methods(
        gallery(spark, sf), queries, METHOD_PRESETS["faiss_only"][:1], top_k=10
    )
    spent = F.least("index_time", "search_time", "avg_query_time") >= 0
    mean = F.abs(F.col("avg_query_time") * F.col("num_queries") - F.col("search_time")) < 1e-6
    return outcome.summary.select("backend", "method", "ntotal", (spent & mean).alias("timed"))


RUN_SQL = SCORED_SQL + """, j AS (SELECT qid, string_agg(raw, '; ' ORDER BY raw) AS joined,
  count(*) AS n FROM labels GROUP BY 1),
m AS (SELECT * FROM (VALUES ('faiss', 'flat'), ('bruteforce', 'bruteforce')) v(backend, method)),
o AS (SELECT id, row_number() OVER (ORDER BY CAST(id AS BIGINT)) - 1 AS query_index FROM u)
SELECT o.query_index, o.id AS query_embedding_id, backend, method,
       backend || '/' || method || ' (cosine)' AS method_label, 'cosine' AS metric,
       false AS use_gpu, 10 AS top_k, f.rank, f.id AS image_id, round(f.score, 6) AS distance,
       f.is_relevant, j.joined AS relevant_ids, CAST(coalesce(j.n, 0) AS INTEGER)
       AS relevant_count
FROM m, o JOIN f ON f.qid = o.id LEFT JOIN j ON j.qid = o.id"""


@query("evaluate_run", RUN_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Audit rows of a whole run: both corpora read from disk, one method and its baseline."""
    source = scratch(spark, "queries")
    # Files and rows in the order of the ids, which differs from the order of the names.
    asked_rows = truth(spark, sf).orderBy("query_index")
    asked_rows.select(F.col("qid").alias("id"), "embedding", "relevant_ids").write.parquet(source)
    outcome = evaluate_run(
        spark,
        corpus(sf),
        QuerySpec(load_from_disk=source, relevance_column="relevant_ids"),
        Evaluation(
            methods=SMALL_METHODS[:1],
            top_k=5,
            recall_at=POINTS,
            output_path=scratch(spark, "summary"),
            details_path=scratch(spark, "details"),
        ),
    )
    return outcome.details.withColumn("distance", F.round("distance", 6))


@query(
    "spec_summary",
    "SELECT 'name=embeddings.parquet, split=train, id_column=vec_id, embedding_column=embedding'"
    " AS summary, format('{:,}', count(*)) AS size FROM embeddings",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    spec = CorpusSpec(dataset_name="embeddings.parquet", root=sf, id_column="vec_id")
    size = corpus_size(read_embeddings(spark, spec))
    return spark.createDataFrame([(spec_summary(spec), size)], "summary string, size string")


@query(
    "zip_positional",
    W + """, o AS (SELECT *, row_number() OVER (ORDER BY CAST(id AS BIGINT)) - 1 AS row_pos FROM e)
    SELECT id, row_pos, label, round(v[1], 6) AS first_value FROM o""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    left = row_index(rows.select("vec_id", "label"), ["vec_id"], "row_pos")
    right = row_index(rows.select("vec_id", "embedding"), ["vec_id"], "row_pos")
    return zip_positional(left, right.drop("vec_id"), ["row_pos"]).select(
        F.col("vec_id").cast("string").alias("id"),
        "row_pos",
        "label",
        F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"),
    )
