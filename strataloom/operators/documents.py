"""Document-level shaping: normal form, input choice, entity matching, evidence, classification, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as T

# Cue words of axes, facets and evidence rules.
AXES = {"technology": ("model", "filter", "network", "method", "算法", "模型"), "application": ("region", "survey", "station", "monitoring", "地区", "监测")}
FACETS = {"object": ("ice", "river", "forest", "crop"), "task": ("predicting", "detecting", "mapping", "ranking"), "data": ("records", "entries", "volunteers", "sites")}
# Alias, canonical name, context that the alias needs ('' for none), weight.
EVIDENCE = (("net", "neural network", "trained", 0.8), ("residual network", "neural network", "", 1.0), ("kernel estimator", "kernel method", "", 0.9), ("graph sampler", "graph method", "", 0.9), ("基于", "trained model", "训练", 0.7))
NEGATION = r"(?:no|not|without|nicht|keine|没有|未) [a-z ]{0,20}$"


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words[1:]), F.contains(text, F.lit(words[0])).cast("int"))


def normalised(docs: DataFrame) -> DataFrame:
    """PRJ-01: id, title, text, year and language of every document with any text; aliases coalesced."""
    body = F.coalesce(F.nullif(F.trim("abstract_text"), F.lit("")), F.nullif(F.trim("content_text"), F.lit("")))
    year = F.coalesce(T.year(F.col("metadata_json")), F.year("created_at"))
    out = docs.select(F.format_string("D%02d", "doc_id").alias("document_id"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.substring(body, 1, 40)).alias("title"), body.alias("body"), year.alias("year"), T.detect_by_share(body).alias("language"))
    return out.where("body IS NOT NULL")


def representation(docs: DataFrame, title: int = 5, abstract: int = 80, keywords: int = 2) -> DataFrame:
    """PRJ-02: structured where title, abstract and keywords reach their least sizes, else plain."""
    k = F.coalesce(F.size(F.from_json("metadata_json", "struct<keywords:array<string>>").getField("keywords")), F.lit(0))
    n = lambda c: F.char_length(F.coalesce(c, F.lit("")))
    ok = (n("title") >= title) & (n("abstract_text") >= abstract) & (k >= keywords)
    used = F.filter(F.array(F.when(n("title") > 0, "title"), F.when(n("abstract_text") > 0, "abstract"), F.when(k > 0, "keywords")), lambda x: x.isNotNull())
    return docs.select("doc_id", F.when(ok, "structured").otherwise("plain").alias("mode"), used.alias("fields_used"), (n("title") + n("abstract_text")).alias("size"))


def axis_sentences(sentences: DataFrame, axis: str, best: int = 4) -> DataFrame:
    """PRJ-05, PRJ-06: the best sentences of an axis by 1 + 2 * cues, in text order, with their share."""
    score = 1 + 2 * _has(F.lower("sentence"), AXES[axis])
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "idx")
    top = sentences.withColumn("score", score).withColumn("r", F.row_number().over(w)).where(F.col("r") <= best)
    return top.select("doc_id", "idx", "score", F.round(F.col("score") / F.sum("score").over(Window.partitionBy("doc_id")), 6).alias("weight"))


def facets(docs: DataFrame, col: str) -> DataFrame:
    """RUL-13: facets with a cue, filled only where at least two differ."""
    low = F.lower(F.coalesce(col, F.lit("")))
    found = F.filter(F.array(*(F.when(_has(low, words) > 0, F.lit(name)) for name, words in FACETS.items())), lambda x: x.isNotNull())
    return docs.select("doc_id", found.alias("facets"), F.when(F.size(found) >= 2, F.array_join(found, "+")).alias("filled"))


def evidence(docs: DataFrame, fields: dict[str, float]) -> DataFrame:
    """RUL-10: evidence rules: an alias in a field, with the context it needs and without a negation
    before it; confidence from the alias and field weights, the best field for each canonical name."""
    rows = []
    for alias, name, context, weight in EVIDENCE:
        for field, fw in fields.items():
            low = F.lower(F.coalesce(field, F.lit("")))
            at = F.locate(alias, low)
            ok = (at > 0) & (F.contains(low, F.lit(context)) if context else F.lit(True)) & ~F.substring(low, F.greatest(at - 30, F.lit(1)), F.least(at - 1, F.lit(29))).rlike(NEGATION)
            rows.append(F.when(ok, F.struct(F.lit(name).alias("name"), F.lit(field).alias("field"), F.lit(round(weight * fw, 4)).alias("confidence"))))
    hits = docs.select("doc_id", F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull())))
    return hits.groupBy("doc_id", "name").agg(F.max("confidence").alias("confidence"), F.max_by("field", F.struct("confidence", "field")).alias("field"))


def matched_entities(entities: DataFrame, vocabulary: DataFrame, longest: int = 64) -> DataFrame:
    """JOIN-11, JOIN-12: entities matched with a vocabulary of their type: equal surface forms, else a form
    of two or more characters that holds the other; the first vocabulary entry counts.

    ``entities``: (entity, type); ``vocabulary``: (term, type, ord). Containment is an equi-join with the
    parts of the longer form, so unrelated terms never meet; forms of more than ``longest`` characters, of
    which there are few, are compared with the vocabulary of their type directly.
    """
    v = vocabulary.select(T.surface(F.col("term")).alias("form"), "term", "type", "ord")
    v = v.groupBy("form", "type").agg(F.min_by("term", "ord").alias("term"), F.min("ord").alias("ord")).where(F.char_length("form") >= 2)
    e = entities.select("entity", "type").distinct().withColumn("form", T.surface(F.col("entity"))).where(F.char_length("form") >= 2)
    exact = e.join(v, ["form", "type"]).select("entity", "type", "term", F.lit("exact").alias("how"))
    rest = e.join(v.select("form", "type"), ["form", "type"], "left_anti")

    def parts(rows: DataFrame) -> DataFrame:
        n = F.char_length("form")
        subs = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(F.lit(2), n - i + 1), lambda k: F.substring("form", i, k))))
        return rows.where(n <= longest).withColumn("part", F.explode(F.array_distinct(subs)))

    held = parts(rest).select("entity", "type", F.col("part").alias("form")).join(v, ["form", "type"])
    holding = parts(v).select("term", "type", "ord", F.col("part").alias("form")).join(rest, ["form", "type"])
    a, b = rest.alias("a"), v.alias("b")
    long = (F.char_length("a.form") > longest) | (F.char_length("b.form") > longest)
    inside = F.contains("a.form", F.col("b.form")) | F.contains("b.form", F.col("a.form"))
    very_long = a.join(b, (F.col("a.type") == F.col("b.type")) & long & inside).select("a.entity", "a.type", "b.term", "b.ord")
    found = held.select("entity", "type", "term", "ord").unionByName(holding.select("entity", "type", "term", "ord")).unionByName(very_long)
    part = found.groupBy("entity", "type").agg(F.min_by("term", "ord").alias("term")).withColumn("how", F.lit("part"))
    return exact.unionByName(part)


def gold_matches(gold: DataFrame, pred: DataFrame, least: float = 0.6) -> DataFrame:
    """JOIN-19: predictions that match a gold phrase of their document: equal, contained, or alike by
    word overlap. Both sides are joined on the document."""
    j = gold.join(pred, "doc_id")
    a, b = F.split(F.lower("gold"), " "), F.split(F.lower("pred"), " ")
    overlap = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    how = F.when(F.lower("gold") == F.lower("pred"), "equal").when(F.contains(F.lower("gold"), F.lower("pred")) | F.contains(F.lower("pred"), F.lower("gold")), "contained").when(overlap >= least, "overlap")
    return j.withColumn("how", how).where("how IS NOT NULL").groupBy("doc_id", "gold").agg(F.count("*").alias("matches"), F.min("how").alias("best"))


def postvalidated(rows: DataFrame) -> DataFrame:
    """RET-04, RES-21, RES-33, RES-34: confidence capped at .95; main and auxiliary code swapped where
    the main one is a technical class with an auxiliary of another discipline; others dropped."""
    cross = T.discipline(F.col("main")) != T.discipline(F.col("aux"))
    swap = F.col("main").rlike("^(TP18|TP391|TP751)") & cross
    return rows.select("doc_id", F.when(swap, F.col("aux")).otherwise(F.col("main")).alias("main"), F.when(swap, F.col("main")).when(cross, F.col("aux")).alias("aux"), F.round(F.least("confidence", F.lit(0.95)), 6).alias("confidence"), F.coalesce(cross, F.lit(False)).alias("interdisciplinary"))


def topic_map(rows: DataFrame, match: float = 0.55, review: float = 0.4) -> DataFrame:
    """CLU-14: topic decision from centroid, prototype, lexical and parent similarity."""
    s = F.round(0.50 * F.col("centroid") + 0.23 * F.col("proto") + 0.17 * F.col("lexical") + 0.10 * F.col("parent"), 6)
    return rows.withColumn("score", s).withColumn("decision", F.when(F.col("score") >= match, "matched").when(F.col("score") >= review, "review").otherwise("new"))


def coassignment(runs: DataFrame) -> DataFrame:
    """CLU-07: share of runs in which two items of a block are in one cluster; pairs within a block
    of bounded size only. ``runs``: (block, item, run, label)."""
    a, b = runs.alias("a"), runs.alias("b")
    j = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.run") == F.col("b.run")) & (F.col("a.item") < F.col("b.item")))
    return j.groupBy(F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b")).agg(F.round(F.avg((F.col("a.label") == F.col("b.label")).cast("int")), 6).alias("share"))


def latest_map(rows: DataFrame, record: str, key: str, order: list[str], value: str) -> DataFrame:
    """AGG-04: last value of every key of a record, as a map sorted by key."""
    last = rows.groupBy(record, key).agg(F.max_by(value, F.struct(*order)).alias("v"))
    return last.groupBy(record).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "v")))).alias("latest"))


def without_nested(spans: DataFrame) -> DataFrame:
    """RES-01: spans that lie strictly within a longer one of their document are dropped; spans of a
    document are compared in one array."""
    a = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start_pos", "end_pos", "entity")).alias("all"))
    inside = lambda x, y: (y["start_pos"] <= x["start_pos"]) & (y["end_pos"] >= x["end_pos"]) & (y["end_pos"] - y["start_pos"] > x["end_pos"] - x["start_pos"])
    return a.select("doc_id", F.inline(F.filter("all", lambda x: ~F.exists("all", lambda y: inside(x, y)))))


def hierarchy(questions: DataFrame) -> DataFrame:
    """RES-08: the first question is the main one; ids by place; others hang on it."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    r = questions.withColumn("place", F.row_number().over(w) - 1)
    return r.select("doc_id", "idx", F.when(F.col("place") == 0, "RQP0").otherwise(F.concat(F.lit("RQS"), F.col("place"))).alias("question_id"), F.when(F.col("place") > 0, "RQP0").alias("parent_id"))


def latex_plain(text: Column) -> Column:
    """STR-19: formulas to plain text: commands dropped, sub- and superscripts flattened."""
    t = F.regexp_replace(text, r"\\(?:text|mathrm|mathbf)\{([^}]*)\}", "$1")
    t = F.regexp_replace(t, r"[_^]\{?([A-Za-z0-9+-]+)\}?", "$1")
    return T.collapse(F.regexp_replace(F.regexp_replace(t, r"\\[A-Za-z]+", " "), r"[$\{\}]", ""))


def rejoined(text: Column) -> Column:
    """STR-20: words parted by a hyphen and a line end."""
    return F.regexp_replace(text, r"([A-Za-z]{2,})-\n([a-z]{2,})", "$1$2")


def sanitised_arcs(arcs: DataFrame) -> DataFrame:
    """FLT-14: dependency arcs without symbols, loops and repetitions."""
    return arcs.where(F.col("head").rlike(r"[\p{L}\p{N}]") & F.col("dep").rlike(r"[\p{L}\p{N}]") & (F.col("head") != F.col("dep"))).dropDuplicates(["doc_id", "head", "dep"])
