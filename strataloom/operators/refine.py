"""Refinement of results: keyword filter chain, rules over folds, method groups, taxonomy candidates, density clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators import relational as R
from strataloom.operators import similarity as S
from strataloom.operators.keywords import GENERIC, STOP

# Short capitals that stand as keywords, and the marks that a keyword neither begins nor ends with.
ACRONYMS = "AI DNA RNA GPS CNN RNN LSTM GAN SVM NLP OCR API UAV CT MRI PCR".split()
EDGES = r"^[\s、，,。.；;:：()（）\[\]]+|[\s、，,。.；;:：()（）\[\]]+$"
JUNK = r"(?i)^(?:fig(?:ure)?|tab(?:le)?|vol|doi|isbn|issn)\b|https?:|\.(?:png|jpe?g|pdf)$|^[0-9 .,%-]+$"


def trimmed_keyword(keyword: Column) -> Column:
    """A keyword without marks at its ends, and of one with a bracket the longer part."""
    k = F.regexp_replace(keyword, EDGES, "")
    k = F.when(k.contains("（") & ~k.contains("("), F.translate(k, "（）", "()")).otherwise(k)
    before, inside = F.trim(F.regexp_extract(k, r"^([^(]*)", 1)), F.trim(F.regexp_replace(F.regexp_extract(k, r"\((.*)$", 1), r"\)", ""))
    return F.when(~k.contains("("), k).when((F.char_length(before) >= F.char_length(inside)) & (before != ""), before).when(inside != "", inside).otherwise(before)


def filtered_keywords(rows: DataFrame) -> DataFrame:
    """FLT-05, FLT-06, SET-02, SET-06: every keyword in its trimmed form with the reason that drops it, null
    where it stays; the first reason holds: empty, junk, length, function word, fragment (two letters not
    in capitals, or up to three capitals that are no known acronym), a short word that the text does not
    hold by itself, a generic word beside a longer term that has it, a repetition, a term that holds a
    shorter one that stays. ``rows``: (doc_id, pos, keyword, text); a document's keywords are one array."""
    k = trimmed_keyword(F.col("keyword"))
    r = rows.select("doc_id", "pos", "keyword", k.alias("k"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    low, n, english = F.lower("k"), F.char_length("k"), F.col("k").rlike(r"^[\x00-\x7f]*$")
    words = F.size(F.split("k", r"\s+"))
    capitals = F.col("k").rlike("^[A-Z0-9]*[A-Z][A-Z0-9]*$")
    own_word = F.expr("regexp_like(text, concat('(^|[^a-z])', regexp_replace(lower(k), '[^a-z0-9]', '.'), '([^a-z]|$)'))")
    reason = (
        F.when(n == 0, "empty").when(F.col("k").rlike(JUNK), "junk")
        .when(english & ~(words.between(1, 8) & n.between(2, 60)), "length").when(~english & ~n.between(2, 24), "length")
        .when(low.isin(*STOP), "function_word")
        .when(english & (n <= 2) & ~capitals, "fragment").when(english & capitals & (n <= 3) & ~F.col("k").isin(*ACRONYMS), "fragment")
        .when(english & (words == 1) & (n <= 5) & (F.col("text") != "") & ~own_word, "not_a_word")
    )
    item = F.struct("pos", "keyword", "k", low.alias("low"), reason.alias("reason"))
    a = r.select("doc_id", item.alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    generic = lambda x, y: x["low"].isin(*GENERIC) & (y["low"] != x["low"]) & F.array_contains(F.split(y["low"], r"\s+"), x["low"])

    def second(x: Column) -> Column:
        return F.coalesce(
            x["reason"],
            F.when(F.exists("xs", lambda y: generic(x, y)), "generic"),
            F.when(F.exists("xs", lambda y: y["reason"].isNull() & (y["low"] == x["low"]) & (y["pos"] < x["pos"])), "repeated"),
        )

    a = a.withColumn("ys", F.transform("xs", lambda x: F.struct(x["pos"].alias("pos"), x["keyword"].alias("keyword"), x["k"].alias("k"), second(x).alias("reason"))))
    holds = lambda x: F.exists("ys", lambda y: y["reason"].isNull() & (y["k"] != x["k"]) & F.contains(x["k"], y["k"]))
    out = F.transform("ys", lambda x: F.struct(x["pos"].alias("pos"), x["keyword"].alias("keyword"), x["k"].alias("term"), F.coalesce(x["reason"], F.when(holds(x), "holds_base")).alias("reason")))
    return a.select("doc_id", F.inline(out))


def rules_over_folds(rows: DataFrame) -> DataFrame:
    """AGG-24: rules of several folds as one library: statistics summed, folds counted, reliability, level
    (strong from three folds and a net gain of two where it was soft, soft from two folds and a gain of
    one, else advisory); of rules with the same conditions the one of most folds stays, ties by id.
    ``rows``: (fold, rule, signature, level, matched, correct, incorrect)."""
    g = rows.groupBy("rule", "signature").agg(F.countDistinct("fold").alias("folds"), F.max_by("level", "fold").alias("level"), *(F.sum(c).alias(c) for c in ("matched", "correct", "incorrect")))
    gain = F.col("correct") - F.col("incorrect")
    level = F.when((F.col("folds") >= 3) & (gain >= 2) & F.col("level").isin("soft", "strong"), "strong").when((F.col("folds") >= 2) & (gain >= 1), "soft").otherwise("advisory")
    g = g.withColumns({"net_gain": gain, "level": level, "reliability": F.round((F.col("correct") + 1) / (F.col("correct") + F.col("incorrect") + 2), 6)})
    best = g.groupBy("signature").agg(F.min(F.struct((-F.col("folds")).alias("f"), "rule")).alias("b"))
    return g.join(best.select("signature", F.col("b.rule").alias("rule")), ["signature", "rule"])


def method_seats(rows: DataFrame) -> DataFrame:
    """REV-03, RES-22: groups of methods that share a document are one; its text is the longest method's.
    ``rows``: (doc_id, group, method). Documents link their groups to the first of them, so a document with
    many groups costs one link each."""
    member = rows.select("doc_id", "group").distinct()
    first = member.groupBy("doc_id").agg(F.min("group").alias("first"))
    links = member.join(first, "doc_id").where(F.col("group") != F.col("first")).select(F.col("group").alias("a"), F.col("first").alias("b")).distinct()
    found = R.components(links, "a", "b").select(F.col("n").alias("group"), F.col("component").alias("seat"))
    seated = rows.join(found, "group", "left").withColumn("seat", F.coalesce("seat", "group"))
    pairs = seated.groupBy("seat", "doc_id").agg(F.max(F.struct(F.char_length("method").alias("n"), "method")).alias("m"))
    return pairs.groupBy("seat").agg(F.count("*").alias("docs"), F.max("m")["method"].alias("method"))


def refinement_candidates(t: DataFrame, asked: DataFrame) -> DataFrame:
    """RET-03: siblings and children of codes: (code, candidate, kind). ``t``: (code, parent); ``asked``: (code)."""
    a = asked.select("code").distinct()
    children = a.join(t.select(F.col("parent").alias("code"), F.col("code").alias("candidate")), "code").withColumn("kind", F.lit("child"))
    parents = a.join(t.select("code", "parent"), "code").where("parent IS NOT NULL")
    siblings = parents.join(t.select(F.col("code").alias("candidate"), "parent"), "parent").where("candidate <> code").select("code", "candidate", F.lit("sibling").alias("kind"))
    return siblings.unionByName(children)


def density_clusters(rows: DataFrame, least: float, points: int, recall: float = S.RECALL) -> DataFrame:
    """CLU-03: density clusters: (id, cluster, noise). A vector with ``points`` others at a cosine of
    ``least`` or more is dense; dense ones that are near each other are one cluster, others go to their
    nearest dense neighbour, and the rest is noise (cluster null). Equal vectors count as many times as they
    occur. ``rows``: (id, vector)."""
    reps, member = S.classes(rows, "id", "vector")
    size = member.groupBy("rep").agg(F.count("*").alias("n"))
    pairs = S.similar_pairs(reps, least, recall=recall).checkpoint()
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "similarity").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "similarity"))
    near = both.join(size.select(F.col("rep").alias("y"), "n"), "y").groupBy("x").agg(F.sum("n").alias("others"))
    dense = size.join(near, size["rep"] == near["x"], "left").where(F.col("n") - 1 + F.coalesce("others", F.lit(0)) >= points).select("rep").checkpoint()
    d = lambda c: dense.select(F.col("rep").alias(c))
    links = pairs.join(d("a"), "a", "left_semi").join(d("b"), "b", "left_semi")
    found = R.components(links.select("a", "b"), "a", "b")
    cluster = d("n").join(found, "n", "left").select(F.col("n").alias("rep"), F.coalesce("component", "n").alias("cluster"))
    border = both.join(d("x"), "x", "left_anti").join(cluster.withColumnRenamed("rep", "y"), "y").groupBy("x").agg(F.max_by("cluster", F.struct(F.round("similarity", 9), -F.col("y"))).alias("cluster")).withColumnRenamed("x", "rep")
    return member.join(cluster.unionByName(border.select("rep", "cluster")), "rep", "left").select("id", "cluster", F.col("cluster").isNull().alias("noise"))
