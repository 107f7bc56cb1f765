"""Shaping of extraction and clustering results: merging, checks, overrides, scores, selection."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.functions import vectors as V


# --- parsing and projection -------------------------------------------------------------------


def labelled_structure(text: Column) -> Column:
    """PRJ-03: title, abstract and keywords of a text with labels; null parts where a label is missing."""
    part = lambda label, stop: F.nullif(F.trim(F.regexp_extract(text, rf"(?is)(?:^|\n)\s*(?:{label})[ \t]*[:：][ \t]*(.*?)(?=\n\s*(?:{stop})\s*[:：]|$)", 1)), F.lit(""))
    names = "title|abstract|keywords|题目|摘要|关键词"
    return F.struct(part("title|题目", names).alias("title"), part("abstract|摘要", names).alias("abstract"), part("keywords|关键词", names).alias("keywords"))


def unwrapped(raw: Column, schema: str, keys: tuple[str, ...] = ("items", "rows", "data", "records")) -> Column:
    """PRJ-10: rows of a JSON document: a list as it is, else the first non-empty list under a known
    key, else the object itself as the only row."""
    as_list = F.from_json(raw, f"array<{schema}>")
    under = [F.from_json(F.get_json_object(raw, f"$.{k}"), f"array<{schema}>") for k in keys]
    single = F.array(F.from_json(raw, schema))
    some = [F.when(F.size(c) > 0, c) for c in under]
    return F.when(F.startswith(F.ltrim(raw), F.lit("[")), as_list).otherwise(F.coalesce(*some, single))


def public(df: DataFrame, allowed: list[str]) -> DataFrame:
    """PRJ-12: only the columns that may be shown, in their order."""
    return df.select(*(c for c in allowed if c in df.columns))


def application_domain(path: Column) -> Column:
    """PRJ-15: second name of a path, else the first."""
    return F.coalesce(F.try_element_at(path, F.lit(2)), F.try_element_at(path, F.lit(1)))


def cluster_count_problem(k: Column, n: Column) -> Column:
    """FLT-15: why k clusters of n items cannot be made; null where they can."""
    return F.when(~((k >= 1) & (k < n)), F.concat(k.cast("string"), F.lit(" clusters cannot be made of "), n.cast("string"), F.lit(" items")))


def capped_path(df: DataFrame, path: str = "path", levels: int = 3) -> DataFrame:
    """PRJ-14: paths cut to their first levels, and the code of the last level kept."""
    return df.withColumn(path, F.slice(path, 1, levels)).withColumn("code", F.try_element_at(path, F.lit(-1)))


def legal_labels(rows: DataFrame, legal: tuple[str, ...]) -> DataFrame:
    """RES-12: the rows; a label that is not legal is an error, not a row left out."""
    wrong = F.concat(F.lit("illegal label: "), F.coalesce("label", F.lit("none")))
    return rows.withColumn("label", F.when(F.col("label").isin(*legal), F.col("label")).otherwise(F.raise_error(wrong)))


def label_counts(rows: DataFrame) -> DataFrame:
    """RES-14: rows and documents of every label. Documents are counted over distinct pairs, so that a
    frequent label costs no distinct count of its own."""
    pairs = rows.groupBy("label", "doc_id").agg(F.count("*").alias("n"))
    return pairs.groupBy("label").agg(F.sum("n").alias("sentences"), F.count("*").alias("docs"))


def contains_term(text: Column, term: str) -> Column:
    """FLT-16: whole word for Latin terms, anywhere for others."""
    if re.fullmatch(r"[A-Za-z0-9 -]+", term):
        return F.lower(text).rlike(rf"(?<![a-z0-9]){re.escape(term.lower())}(?![a-z0-9])")
    return F.contains(text, F.lit(term))


def ascii_markers(text: Column) -> Column:
    """STR-18: full-width brackets, digits and commas of markers in their half-width form."""
    return F.translate(text, "［］（）０１２３４５６７８９，－", "[]()0123456789,-")


def allowed_types(entities: DataFrame, types: DataFrame) -> DataFrame:
    """FLT-11: entities of the allowed types."""
    return entities.join(types.select("type").distinct(), "type", "left_semi")


# --- joins and merging -------------------------------------------------------------------------


def restored(base: DataFrame, parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """JOIN-08: inner joins with several parts on the key; the order column of the base is kept."""
    out = base
    for p in parts:
        out = out.join(p, key)
    return out.orderBy(order)


def calibration_rows(rows: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """JOIN-09: rows that the gold table has."""
    return rows.join(gold.select(key).distinct(), key, "left_semi")


def same_branch_hits(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """JOIN-21, AGG-22: exact, same-branch and top-level hits of taxonomy codes, as shares."""
    j = gold.join(pred, "doc_id")
    branch = F.startswith("gold", F.col("pred")) | F.startswith("pred", F.col("gold"))
    m = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    return j.agg(F.count("*").alias("n"), m(F.col("gold") == F.col("pred"), "exact"), m(branch, "branch"), m(F.left("gold", F.lit(1)) == F.left("pred", F.lit(1)), "top"))


def pruned_topics(docs: DataFrame, parents: DataFrame, topics: DataFrame, best: int = 2) -> DataFrame:
    """JOIN-22: scores of a document for the topics of its best parents only, so that most topics are never
    scored. ``docs``: (doc_id, vector); ``parents``: (parent, vector), packed into one row, since a
    taxonomy's parents are few; ``topics``: (topic, parent, vector)."""
    packed = parents.agg(F.collect_list(F.struct("parent", F.col("vector").alias("v"))).alias("all"))
    scored = F.transform("all", lambda p: F.struct((-F.round(V.cosine(F.col("vector"), p["v"]), 6)).alias("s"), p["parent"].alias("parent")))
    top = docs.join(F.broadcast(packed)).select("doc_id", "vector", F.explode(F.slice(F.array_sort(scored), 1, best)).alias("b"))  # one row
    j = top.select("doc_id", F.col("vector").alias("d"), F.col("b.parent").alias("parent")).join(topics, "parent")
    return j.select("doc_id", "parent", "topic", F.round(V.cosine(F.col("d"), F.col("vector")), 6).alias("score"))


def first_mapping(docs: DataFrame, mapping: list[tuple[str, str]], columns: list[str]) -> DataFrame:
    """JOIN-24: terms of a mapping table found in a document; the first term wins for each name."""
    low = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns)))
    rows = F.filter(F.array(*(F.when(F.contains(low, F.lit(t.lower())), F.struct(F.lit(name).alias("name"), F.lit(t).alias("term"), F.lit(i).alias("ord"))) for i, (t, name) in enumerate(mapping))), lambda x: x.isNotNull())
    return docs.select("doc_id", F.inline(rows)).groupBy("doc_id", "name").agg(F.min_by("term", "ord").alias("term"))


def term_clusters(terms: DataFrame) -> DataFrame:
    """AGG-29: frequency, sources and canonical name (author keyword, then frequency, then length) of
    every term cluster. ``terms``: (cluster, term, source, freq, author)."""
    pick = F.struct(F.col("author").cast("int"), F.col("freq"), -F.char_length("term"), F.col("term"))
    return terms.groupBy("cluster").agg(F.sum("freq").alias("freq"), F.countDistinct("source").alias("sources"), F.max_by("term", pick).alias("canonical"))


def merged_candidates(rows: DataFrame) -> DataFrame:
    """SET-05: candidates with one normal key: best score, evidence of all."""
    g = rows.groupBy("doc_id", T.key(F.col("candidate")).alias("key"))
    return g.agg(F.max_by("candidate", F.struct("score", "candidate")).alias("candidate"), F.max("score").alias("score"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))


def merged_chunks(rows: DataFrame) -> DataFrame:
    """EXT-11: entities of text chunks: offsets moved, equal ones (case ignored, by type) kept once."""
    r = rows.withColumns({"start_pos": F.col("start_pos") + F.col("chunk_offset"), "form": F.lower("entity")})
    return r.groupBy("doc_id", "type", "form").agg(F.min_by("entity", "start_pos").alias("entity"), F.min("start_pos").alias("start_pos"))


# --- checks and overrides ------------------------------------------------------------------------


def label_checks(rows: DataFrame, legal: tuple[str, ...]) -> DataFrame:
    """RUL-06, RES-12: illegal labels, quotations that do not stand in the text, repetitions, and labels
    out of order, counted for every document. ``rows``: (doc_id, idx, label, quote, text)."""
    order = F.create_map(*(F.lit(x) for i, m in enumerate(legal) for x in (m, i)))
    place = F.try_element_at(order, F.col("label"))
    w = Window.partitionBy("doc_id").orderBy("idx")
    r = rows.withColumns({"place": place, "n": F.count("*").over(Window.partitionBy("doc_id", "quote"))}).withColumn("back", F.col("place") < F.max("place").over(w))
    verbatim = F.contains(F.regexp_replace("text", r"\s+", ""), F.regexp_replace("quote", r"\s+", ""))
    return r.groupBy("doc_id").agg(F.count_if(F.col("place").isNull()).alias("illegal"), F.count_if(~verbatim).alias("not_verbatim"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("back")).alias("out_of_order"))


def user_override(rows: DataFrame) -> DataFrame:
    """RES-13: the user's label where the built-in one is not sure and the similarity is high."""
    take = (F.col("confidence") < 0.95) & (F.col("similarity") > 0.70)
    return rows.withColumns({"label": F.when(take, F.col("user_label")).otherwise(F.col("label")), "confidence": F.when(take, F.col("similarity")).otherwise(F.col("confidence"))})


def least_confidence(rows: DataFrame, least: float) -> DataFrame:
    """RES-09, RES-10: counts and explicit share of all rows beside the number that stay above a floor."""
    n = F.greatest(F.count("*"), F.lit(1))
    return rows.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if("explicit").alias("explicit"), F.round(F.count_if("explicit") / n, 3).alias("explicit_ratio"), F.count_if(F.col("confidence") >= least).alias("kept"))


def composite_free(rows: DataFrame) -> DataFrame:
    """RES-02: entities of six or more characters that hold two other entities of their document are
    dropped. The entities of a document are compared within one array."""
    a = rows.groupBy("doc_id").agg(F.collect_set("entity").alias("all"))
    parts = lambda x: F.size(F.filter("all", lambda y: (y != x) & (F.char_length(y) >= 3) & F.contains(x, y)))
    return a.select("doc_id", F.explode(F.filter("all", lambda x: ~((F.char_length(x) >= 6) & (parts(x) >= 2)))).alias("entity"))


def method_checks(rows: DataFrame) -> DataFrame:
    """RES-38, REV-02: methods without located evidence are blanked, questions without are dropped,
    equal questions (by normal key) kept once. ``rows``: (doc_id, idx, question, method, q_at, m_at)."""
    ok = rows.where(F.col("q_at") >= 0).withColumn("method", F.when(F.col("m_at") >= 0, F.col("method")).otherwise(""))
    w = Window.partitionBy("doc_id", T.key(F.col("question"))).orderBy("idx")
    return ok.withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id", "idx", "question", "method")


def axes_valid(terms: Column, quotes: Column, source: Column) -> Column:
    """RES-28: an axis counts only with a verified term and a verified quotation."""
    found = lambda xs: F.exists(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.contains(source, x))
    return found(terms) & found(quotes)


def cache_key(*columns: str) -> Column:
    """RES-26: key of a request: hash of its fields in sorted order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


# --- scores and selection --------------------------------------------------------------------------


def scope_top(classes: DataFrame, docs: DataFrame, terms: str, k: int = 5) -> DataFrame:
    """TOP-03: best classes of a document by term hits, two more for a name in the title; ties by code.

    ``classes``: (code, name, term); joined on the document's terms, so only hits are formed."""
    t = docs.select("doc_id", F.lower(F.coalesce("title", F.lit(""))).alias("title"), F.explode(F.array_distinct(F.transform(terms, F.lower))).alias("term"))
    hit = t.join(classes, "term").groupBy("doc_id", "code", "name", "title").agg(F.count("*").alias("hits"))
    s = hit.withColumn("score", F.col("hits") + F.when(F.contains("title", F.lower("name")), 2).otherwise(0))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "code"))).where(F.col("rank") <= k).select("doc_id", "code", "score", "rank")


def above(rows: DataFrame, score: str, least: float) -> DataFrame:
    """TOP-08, RET-05, RES-44: rows at or above a threshold, best first."""
    return rows.where(F.col(score) >= least).orderBy(F.desc(score))


def distinctiveness(labels: DataFrame) -> DataFrame:
    """ARR-02, LAB-06: largest word overlap (over the smaller label) of every label with another; joined
    on shared words. ``labels``: (cluster_id, label)."""
    w = labels.select("cluster_id", F.explode(T.words(F.col("label"), "[a-z0-9]+|[\\x{4e00}-\\x{9fff}]")).alias("w")).distinct()
    n = w.groupBy("cluster_id").agg(F.count("*").alias("n"))
    a, b = w.alias("a"), w.alias("b")
    shared = a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.cluster_id") != F.col("b.cluster_id"))).groupBy(F.col("a.cluster_id").alias("cluster_id"), F.col("b.cluster_id").alias("other")).agg(F.count("*").alias("s"))
    j = shared.join(n, "cluster_id").join(n.select(F.col("cluster_id").alias("other"), F.col("n").alias("m")), "other")
    top = j.groupBy("cluster_id").agg(F.round(F.max(F.col("s") / F.least("n", "m")), 6).alias("overlap"))
    return labels.join(top, "cluster_id", "left").select("cluster_id", "label", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def soft_choice(rows: DataFrame, cap: float = 0.05, lead: float = 0.002) -> DataFrame:
    """RES-32: the base candidate unless a fallback, with its bonus held to a cap, beats it by a lead.
    ``rows``: (cluster_id, candidate, score, bonus, fallback)."""
    s = rows.withColumn("final", F.round(F.col("score") + F.when(F.col("fallback"), F.least("bonus", F.lit(cap))).otherwise(0.0), 6))
    best = lambda f: F.max_by(F.struct("candidate", "final"), F.when(F.col("fallback") == f, F.struct("final", "candidate")))
    g = s.groupBy("cluster_id").agg(best(False).alias("base"), best(True).alias("soft"), F.count_if("fallback").alias("n_soft"), F.count_if(~F.col("fallback")).alias("n_base"))
    use = (F.col("n_soft") > 0) & ((F.col("n_base") == 0) | (F.col("soft.final") > F.col("base.final") + lead))
    return g.select("cluster_id", F.when(use, F.col("soft.candidate")).otherwise(F.col("base.candidate")).alias("label"), use.alias("from_fallback"))


def best_k(candidates: DataFrame) -> DataFrame:
    """CLU-06: number of clusters by silhouette, stability, balance and the share of undersized ones;
    ties to fewer clusters. ``candidates``: (task, k, silhouette, stability, balance, undersized)."""
    s = F.round(0.45 * F.col("silhouette") + 0.30 * F.col("stability") + 0.15 * F.col("balance") - 0.10 * F.col("undersized"), 6)
    return candidates.withColumn("score", s).groupBy("task").agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k"), F.max("score").alias("score"))


def weighted_facets(vectors: list[Column], weights: list[float]) -> Column:
    """CLU-10: facet vectors side by side, each weighted by the root of its share."""
    total = sum(weights)
    return F.concat(*(_scaled(v, (w / total) ** 0.5) for v, w in zip(vectors, weights)))


def _scaled(v: Column, by: float) -> Column:
    return F.transform(v, lambda x: x.cast("double") * by)


def richness_weight(chars: Column, fields: Column) -> Column:
    """RUL-11: weight of semantic evidence by how rich the input is."""
    return F.when((fields >= 3) & (chars >= 800), 0.75).when((fields >= 2) & (chars >= 200), 0.6).otherwise(0.45)


def fused_keywords(rows: DataFrame, least: float = 0.5, most: int = 8) -> DataFrame:
    """EXT-10: keyword weights: dictionary boost up to .5 (floor .75, cap 1), others capped at .95;
    threshold and greatest number. ``rows``: (doc_id, keyword, fitness, in_dictionary, boost)."""
    w = F.when(F.col("in_dictionary"), F.least(F.lit(1.0), F.greatest(F.lit(0.75), F.col("fitness") + F.least("boost", F.lit(0.5))))).otherwise(F.least("fitness", F.lit(0.95)))
    r = rows.withColumn("weight", F.round(w, 6)).where(F.col("weight") >= least)
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "keyword"))).where(F.col("rank") <= most).select("doc_id", "keyword", "weight", "rank")


def grid_choice(scores: DataFrame) -> DataFrame:
    """EVL-02: the weight of a grid with the best mean recall; ties to the smaller weight."""
    g = scores.groupBy("weight").agg(F.avg("recall").alias("m"))
    return g.agg(F.max_by("weight", F.struct(F.round("m", 9), -F.col("weight"))).alias("weight"), F.round(F.max("m"), 6).alias("recall"))


def proposed_topics(rows: DataFrame, least: int = 3) -> DataFrame:
    """CLU-16: unmatched documents by language and parent, proposed where enough support them."""
    return rows.groupBy("language", "parent").agg(F.count("*").alias("support"), F.min("doc_id").alias("example")).where(F.col("support") >= least)


def near_concepts(a: Column, b: Column) -> Column:
    """RES-35: whether two concepts share at least half of the smaller one's content words."""
    words = lambda c: F.array_distinct(F.filter(T.words(c), lambda w: F.char_length(w) > 2))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words(a), words(b))), F.least(F.size(words(a)), F.size(words(b)))), F.lit(0.0)) >= 0.5


def merged_questions(df: DataFrame, limit: int = 5000) -> DataFrame:
    """RES-06, RES-07: questions of a document that contain each other or share most characters are
    merged; the surer one stays, ties to the earlier. ``df``: (doc_id, idx, question, confidence)."""
    from strataloom.operators.grouping import checked

    def alike(a: str, b: str) -> bool:
        a, b = re.sub(r"\W+", "", a).lower(), re.sub(r"\W+", "", b).lower()
        if a in b or b in a:
            return min(len(a), len(b)) >= 0.5 * max(len(a), len(b), 1)
        return min(len(a), len(b)) >= 6 and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.6

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for row in pdf.sort_values(["confidence", "idx"], ascending=[False, True]).itertuples(index=False):
            if not any(alike(row.question, k.question) for k in kept):
                kept.append(row)
        return pd.DataFrame([(k.doc_id, k.idx, k.question, k.confidence) for k in kept], columns=["doc_id", "idx", "question", "confidence"])

    return checked(df, "doc_id", limit).select("doc_id", "idx", "question", "confidence").groupBy("doc_id").applyInPandas(run, "doc_id long, idx int, question string, confidence double")
