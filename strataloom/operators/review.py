"""Structured review, citation rules, spans and sentences, supervised and spectral clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.functions import vectors as V


def unique_documents(docs: DataFrame, key: str = "document_id") -> DataFrame:
    """REV-01: the documents; fails where an id comes twice."""
    n = F.count("*").over(Window.partitionBy(key))
    return docs.withColumn("_n", n).withColumn(key, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated id: "), F.col(key).cast("string")))).otherwise(F.col(key))).drop("_n")


def progress_sentences(sentences: DataFrame, best: int = 4) -> DataFrame:
    """REV-04: the best sentences of a document by progress cues times numbers."""
    cue = T.count(F.lower("sentence"), "improves|raises|reached|reduces|halves|verbessert|erhöht|提高|改善|降低")
    score = cue * (1 + F.least(T.count(F.col("sentence"), r"\d+(?:[.,]\d+)?"), F.lit(3)))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "idx")
    return sentences.withColumn("score", score).where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best).select("doc_id", "idx", "score", "rank")


def evidence_tree(rows: DataFrame) -> DataFrame:
    """REV-05: nested output: every document with its methods and their sorted evidence."""
    m = rows.groupBy("doc_id", "method").agg(F.sort_array(F.collect_set("idx")).alias("evidence"))
    return m.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("method", "evidence"))).alias("methods"))


def cross_document_groups(rows: DataFrame) -> DataFrame:
    """REV-03, RES-22: methods with one normal key over documents: documents, longest wording."""
    g = rows.groupBy(T.key(F.col("method")).alias("key"))
    return g.agg(F.countDistinct("doc_id").alias("docs"), F.max_by("method", F.struct(F.char_length("method"), "method")).alias("method"))


def nearest_or_richest(sentences: DataFrame, questions: DataFrame) -> DataFrame:
    """RES-23: for every question the nearest strong sentence and the longest one (up to 420 characters)."""
    j = questions.select("doc_id", F.col("idx").alias("q")).join(sentences.select("doc_id", "idx", "sentence"), "doc_id").where("idx <> q")
    return j.groupBy("doc_id", "q").agg(F.min_by("idx", F.struct(F.abs(F.col("idx") - F.col("q")), "idx")).alias("nearest"), F.max_by("idx", F.struct(F.least(F.char_length("sentence"), F.lit(420)), -F.col("idx"))).alias("richest"))


def spans_to_sentences(spans: DataFrame, sentences: DataFrame) -> DataFrame:
    """JOIN-16: every sentence with the longest span of its document that holds it or that it holds."""
    j = sentences.join(spans, "doc_id").where(F.contains("span", F.col("sentence")) | F.contains("sentence", F.col("span")))
    return j.groupBy("doc_id", "idx").agg(F.max_by("label", F.struct(F.char_length("span"), "label")).alias("label"))


def citation_scores(rows: DataFrame, rules: list[tuple[str, str, float]], base: float = 0.70) -> DataFrame:
    """RUL-08: label scores of citation sentences: 0.70 times the model's confidence for its label, plus
    or minus the weights of rules (pattern, label, weight) that match. ``rows``: (id, sentence, label, confidence)."""
    labels = sorted({label for _, label, _ in rules})
    s = {x: F.round(sum((F.col("sentence").rlike(p).cast("int") * w for p, label, w in rules if label == x), F.when(F.col("label") == x, base * F.col("confidence")).otherwise(F.lit(0.0))), 6) for x in labels}
    best = F.array_max(F.array(*(F.struct(c.alias("s"), F.lit(-i).alias("o"), F.lit(x).alias("x")) for i, (x, c) in enumerate(s.items()))))
    return rows.select("id", "label", *(c.alias(f"s_{x}") for x, c in s.items()), best["x"].alias("suggestion"))


def moved_fragments(clauses: DataFrame) -> DataFrame:
    """WIN-05: clauses of fewer than twelve characters take the label of the clause before them in their
    sentence, else of the one after."""
    w = Window.partitionBy("doc_id", "idx").orderBy("place")
    short = F.char_length("clause") < 12
    return clauses.withColumn("label", F.when(short, F.coalesce(F.lag("label").over(w), F.lead("label").over(w), F.col("label"))).otherwise(F.col("label")))


def entity_context(entities: DataFrame, sentences: DataFrame) -> DataFrame:
    """EXT-14: numbered distinct contexts of the entities of a document."""
    j = entities.join(sentences, "doc_id").where(F.contains("sentence", F.col("entity")))
    g = j.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("idx", "sentence"))).alias("c"))
    return g.select("doc_id", F.transform("c", lambda x, i: F.concat(F.lit("S"), i + 1, F.lit(": "), x["sentence"])).alias("contexts"))


def keyword_shape(rows: DataFrame) -> DataFrame:
    """RES-20: keyword results of a document: language, counts, dictionary hits."""
    g = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("in_dictionary").alias("dictionary_hits"), F.concat_ws("", F.sort_array(F.collect_list("keyword"))).alias("t"))
    return g.select("doc_id", "n", "dictionary_hits", T.detect_by_share(F.col("t")).alias("language"))


def covers_members(labels: DataFrame, titles: DataFrame, least: float = 0.42) -> DataFrame:
    """RES-39: a label passes where its least similarity to the informative titles of its cluster is
    enough; titles like file names are left out, and none passes. Vectors come with both sides."""
    t = titles.where(~F.col("title").rlike(r"^\S+\.(?:pdf|docx?|txt)$"))
    j = labels.join(t, "cluster_id", "left").groupBy("cluster_id").agg(F.min(V.cosine(F.col("label_vec"), F.col("title_vec"))).alias("low"))
    return j.select("cluster_id", F.coalesce(F.col("low") >= least, F.lit(True)).alias("passes"))


def anchor_gate(scores: DataFrame, least: float = 0.55) -> DataFrame:
    """RES-42, CLU-12: mean over a document's sentences of the best similarity to an anchor's sentences;
    the best anchor where it is enough, else none. ``scores``: (doc_id, sentence, anchor, similarity)."""
    m = scores.groupBy("doc_id", "anchor", "sentence").agg(F.max("similarity").alias("s")).groupBy("doc_id", "anchor").agg(F.avg("s").alias("s"))
    b = m.groupBy("doc_id").agg(F.max_by("anchor", F.struct("s", "anchor")).alias("anchor"), F.max("s").alias("s"))
    return b.select("doc_id", F.when(F.col("s") >= least, F.col("anchor")).alias("anchor"), F.round("s", 6).alias("similarity"))


def rule_mask(rows: DataFrame, policy: str = "unverified") -> DataFrame:
    """RES-45: rows in which rules are active: with rule terms, and all or those no model verified; the
    evidence of both, distinct, at most five."""
    active = (F.size("rule_terms") > 0) & (F.lit(policy == "all") | ~F.col("verified"))
    return rows.withColumns({"active": active, "evidence": F.when(active, F.slice(F.array_distinct(F.concat("evidence", "rule_terms")), 1, 5)).otherwise(F.col("evidence"))})


def spectral(edges: DataFrame, k: int, rounds: int = 20) -> DataFrame:
    """CLU-04: spectral clusters of a similarity graph (src, dst, weight) by power iteration."""
    from pyspark.ml.clustering import PowerIterationClustering

    return PowerIterationClustering(k=k, maxIter=rounds, weightCol="weight").assignClusters(edges.where("weight > 0 AND src < dst"))


def text_classifier(rows: DataFrame, text: str, label: str, buckets: int = 1 << 16):
    """CLU-15: hashed character n-grams with IDF and a logistic classifier; returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, StringIndexer

    stages = [StringIndexer(inputCol=label, outputCol="y", handleInvalid="keep"), HashingTF(inputCol="grams", outputCol="tf", numFeatures=buckets), IDF(inputCol="tf", outputCol="features"), LogisticRegression(labelCol="y", maxIter=20)]
    return Pipeline(stages=stages).fit(rows.withColumn("grams", chars(F.col(text))))


def compact(rows: DataFrame, column: str, size: int) -> DataFrame:
    """CLU-09: vectors projected to fewer dimensions."""
    from pyspark.ml.feature import PCA

    return PCA(k=size, inputCol=column, outputCol="compact").fit(rows).transform(rows)


def chars(c: Column, n: int = 3) -> Column:
    """Character n-grams of a text."""
    t = F.coalesce(F.lower(c), F.lit(""))
    return F.when(F.char_length(t) >= n, F.transform(F.sequence(F.lit(1), F.char_length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
