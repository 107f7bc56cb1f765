"""Evaluation against gold labels: precision, recall, F1, clustering scores, votes, taxonomy accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusions(rows: DataFrame) -> DataFrame:
    return rows.where("gold <> pred").groupBy("gold", "pred").agg(F.count("*").alias("n"))


def label_prf(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every label that occurs; empty denominators give 0."""
    g = rows.groupBy(F.col("gold").alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col("gold") == F.col("pred")).alias("hit"))
    p = rows.groupBy(F.col("pred").alias("label")).agg(F.count("*").alias("predicted"))
    j = g.join(p, "label", "full_outer").na.fill(0, ["support", "hit", "predicted"])
    prec, rec = F.coalesce(F.try_divide("hit", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return j.select("label", "support", F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"), F.round(f1, 6).alias("f1"))


PRF_SQL = """r AS ({rows}), g AS (SELECT gold AS label, count(*) AS support, count(*) FILTER (gold = pred) AS hit FROM r GROUP BY 1), p AS (SELECT pred AS label, count(*) AS predicted FROM r GROUP BY 1),
j AS (SELECT coalesce(g.label, p.label) AS label, coalesce(support, 0) AS support, coalesce(hit / nullif(predicted, 0)::DOUBLE, 0) AS p, coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS r FROM g FULL JOIN p ON g.label = p.label)
SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM j""".replace("r AS ({rows}), g", "rr AS ({rows}), g").replace("FROM r GROUP", "FROM rr GROUP")


def clustering_scores(rows: DataFrame) -> DataFrame:
    """Purity, adjusted Rand index, homogeneity, completeness, V-measure and NMI of (gold, pred)."""
    c = rows.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    g, p = c.groupBy("gold").agg(F.sum("n").alias("a")), c.groupBy("pred").agg(F.sum("n").alias("b"), F.max("n").alias("m"))
    two = lambda x: F.sum(F.col(x) * (F.col(x) - 1) / 2)
    x = c.agg(two("n").alias("nn"), F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("hn"))
    y = g.agg(two("a").alias("aa"), F.sum(F.col("a") * F.log("a")).alias("ha"))
    z = p.agg(two("b").alias("bb"), F.sum("m").alias("mm"), F.sum(F.col("b") * F.log("b")).alias("hb"))
    j = x.join(F.broadcast(y)).join(F.broadcast(z))  # one row each
    t = F.col("t")
    pairs = t * (t - 1) / 2
    expected = F.col("aa") * F.col("bb") / pairs
    ari = (F.col("nn") - expected) / ((F.col("aa") + F.col("bb")) / 2 - expected)
    hg, hp, hj = F.log(t) - F.col("ha") / t, F.log(t) - F.col("hb") / t, F.log(t) - F.col("hn") / t
    mi = hg + hp - hj
    one = lambda a, b: F.when(b <= 1e-12, 1.0).otherwise(a / b)
    hom, com = one(mi, hg), one(mi, hp)
    out = {"purity": F.col("mm") / t, "ari": ari, "homogeneity": hom, "completeness": com, "v_measure": 2 * hom * com / (hom + com), "nmi": one(2 * mi, hg + hp)}
    return j.select(*(F.round(v, 5).alias(k) for k, v in out.items()))


CONTINGENCY_SQL = "k AS (SELECT gold, pred, count(*)::DOUBLE AS n FROM ({rows}) GROUP BY ALL), ga AS (SELECT gold, sum(n) AS a FROM k GROUP BY gold), pb AS (SELECT pred, sum(n) AS b, max(n) AS m FROM k GROUP BY pred), "
CLUSTERING_SQL = """x AS (SELECT sum(n * (n - 1) / 2) AS nn, sum(n) AS t, sum(n * ln(n)) AS hn FROM k), y AS (SELECT sum(a * (a - 1) / 2) AS aa, sum(a * ln(a)) AS ha FROM ga), z AS (SELECT sum(b * (b - 1) / 2) AS bb, sum(m) AS mm, sum(b * ln(b)) AS hb FROM pb),
v AS (SELECT *, aa * bb / (t * (t - 1) / 2) AS ex, ln(t) - ha / t AS hg, ln(t) - hb / t AS hp, ln(t) - hn / t AS hj FROM x, y, z), h AS (SELECT *, hg + hp - hj AS mi, (hg + hp - hj) / hg AS ho, (hg + hp - hj) / hp AS co FROM v)
SELECT round(mm / t, 5) AS purity, round((nn - ex) / ((aa + bb) / 2 - ex), 5) AS ari, round(ho, 5) AS homogeneity, round(co, 5) AS completeness, round(2 * ho * co / (ho + co), 5) AS v_measure, round(2 * mi / (hg + hp), 5) AS nmi FROM h"""


def vote(rows: DataFrame, key: str) -> DataFrame:
    """AGG-26, AGG-27: most common answer of every key (ties to the least), its share and mean confidence."""
    c = rows.groupBy(key, "answer").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    t = c.groupBy(key).agg(F.min_by(F.struct("answer", "n", "c"), F.struct(-F.col("n"), F.col("answer"))).alias("b"), F.sum("n").alias("t"))
    return t.select(key, F.col("b.answer").alias("answer"), F.round(F.col("b.n") / F.col("t"), 6).alias("share"), F.round(F.col("b.c") * F.col("b.n") / F.col("t"), 6).alias("score"))
