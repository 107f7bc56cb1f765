"""Queries on similarity joins over all vectors. Every vector comes with three near copies and one equal one."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import similarity as S
from strataloom.operators import vectors as X
from strataloom.plans.registry import registry
from strataloom.session import table

QUERIES: dict = {}
SQL: dict = {}
query = registry(QUERIES, SQL)
#: Recall asked for, so that the rows can be compared with those of all pairs.
SURE = 0.99999

_ROWS = "SELECT vec_id * 5 + j AS id, CASE j WHEN 4 THEN 'Method-' || (vec_id // 40) ELSE 'own ' || (vec_id * 5 + j) END AS text, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN j = 4 THEN x ELSE x + 0.015 * j * ((i * 7 + j * 3 + vec_id) % 5 - 2) END) AS v FROM embeddings, range(0, 5) t(j)"
_EDGES = f"r AS ({_ROWS}), u AS (SELECT id, text, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM r), p AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) AS s FROM u a JOIN u b ON a.id < b.id WHERE list_dot_product(a.v, b.v) >= 0.84)"


def _rows(spark, d):
    j, v = F.col("j"), F.col("vec_id")
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
    moved = F.transform("embedding", lambda x, i: F.when(j == 4, x.cast("double")).otherwise(x.cast("double") + 0.015 * j * (((i + 1) * 7 + j * 3 + v) % 5 - 2)))
    text = F.when(j == 4, F.concat(F.lit("Method-"), F.floor(v / 40).cast("string"))).otherwise(F.concat(F.lit("own "), (v * 5 + j).cast("string")))
    return e.select((v * 5 + j).alias("id"), text.alias("text"), moved.alias("vector"))


@query(
    f"WITH RECURSIVE {_EDGES}, e0 AS (SELECT a, b FROM p UNION SELECT min(id) OVER (PARTITION BY regexp_replace(lower(text), '[^0-9a-z]+', '', 'g')), id FROM u), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), "
    "c(node, c) AS (SELECT a, a FROM e UNION SELECT e.b, c.c FROM c JOIN e ON e.a = c.node AND e.b > c.c) SELECT node AS id, min(c) AS component FROM c GROUP BY node"
)
def method_groups(spark, d):
    """SET-09, SET-11: groups of methods by equal text or near vectors, over all rows."""
    return S.method_groups(_rows(spark, d), recall=SURE)


@query(f"WITH {_EDGES}, q AS (SELECT a, b, s FROM p WHERE a % 5 <> 4 AND b % 5 <> 4), both_ways AS (SELECT a AS x, b AS y, s FROM q UNION ALL SELECT b, a, s FROM q), n AS (SELECT x, y FROM both_ways QUALIFY row_number() OVER (PARTITION BY x ORDER BY round(s, 9) DESC, y) <= 3), l AS (SELECT x, list(y) AS ns FROM n GROUP BY x) SELECT a, b, round(0.82 * s * s + 0.18 * len(list_intersect(la.ns, lb.ns)) / 3, 5) AS weight FROM q JOIN l la ON la.x = a JOIN l lb ON lb.x = b WHERE list_contains(la.ns, b) OR list_contains(lb.ns, a)")
def shared_neighbour_graph(spark, d):
    """CLU-05: shared-neighbour weights of the nearest neighbours among different vectors."""
    rows = _rows(spark, d).where("id % 5 <> 4")  # the equal copies are of the class of their original
    reps, _ = S.classes(rows, "id", "vector")
    return S.shared_neighbours(S.similar_pairs(reps, 0.84, recall=SURE), 3)


@query()
def graph_communities(spark, d):
    """SET-18: communities of the shared-neighbour graph of all rows (label propagation, so without SQL)."""
    reps, _ = S.classes(_rows(spark, d), "id", "vector")
    g = S.shared_neighbours(S.similar_pairs(reps, 0.84, recall=SURE), 3)
    both = g.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(g.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))
    return X.propagate_labels(both.withColumn("weight", F.greatest("weight", F.lit(0.05))))
