"""Queries on the shaping operators: parsing, checks, joins, scores and selection of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.functions import vectors as V
from strataloom.operators import documents as D
from strataloom.operators import extract, keywords, rules
from strataloom.operators import relational as L
from strataloom.operators import results as R
from strataloom.operators import review as W
from strataloom.operators import vectors as X
from strataloom.plans.q_text import sentence_rows, sents
from strataloom.plans.q_vectors import _CENT
from strataloom.plans.registry import registry
from strataloom.session import table

QUERIES: dict = {}
SQL: dict = {}
query = registry(QUERIES, SQL)

_SENTS = sents("abstract_text")
_KW = keywords._META_SQL


def _sentences(spark, d):
    return sentence_rows(table(spark, d, "documents"), "abstract_text")


def _keywords(spark, d):
    return keywords.of_metadata(table(spark, d, "documents")).where("keyword IS NOT NULL")


@query("SELECT doc_id, nullif(trim(title), '') AS title, nullif(trim(source), '') AS abstract, nullif(trim(lang), '') AS keywords FROM documents WHERE title IS NOT NULL AND lang IS NOT NULL AND title NOT LIKE '%' || chr(10) || '%'")
def labelled_parts(spark, d):
    """PRJ-03: parts of texts with labels."""
    docs = table(spark, d, "documents").where("title IS NOT NULL AND lang IS NOT NULL AND NOT contains(title, '\n')")
    text = F.concat(F.lit("Title: "), "title", F.lit("\nAbstract: "), "source", F.lit("\nKeywords: "), "lang")
    return docs.select("doc_id", R.labelled_structure(text).alias("p")).select("doc_id", "p.*")


@query("SELECT doc_id, CASE WHEN j = 1 THEN doc_id ELSE doc_id + 1 END AS a FROM documents, unnest(range(1, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END)) AS r(j)")
def unwrapped_rows(spark, d):
    """PRJ-10: rows of a list, of a list under a key, and of a single object."""
    raw = F.when(F.col("doc_id") % 3 == 0, F.format_string('[{"a": %d}, {"a": %d}]', "doc_id", F.col("doc_id") + 1)).when(F.col("doc_id") % 3 == 1, F.format_string('{"items": [{"a": %d}]}', "doc_id")).otherwise(F.format_string('{"a": %d}', "doc_id"))
    return table(spark, d, "documents").select("doc_id", F.inline(R.unwrapped(raw, "struct<a:bigint>")))


@query("SELECT doc_id, title, lang FROM documents")
def public_fields(spark, d):
    """PRJ-12: only fields that may be shown; unknown names are passed over."""
    return R.public(table(spark, d, "documents"), ["doc_id", "title", "no_such_field", "lang"])


@query("SELECT p_partkey, coalesce(string_split(p_type, ' ')[2], string_split(p_type, ' ')[1]) AS domain FROM part")
def application_domains(spark, d):
    """PRJ-15: second name of a path, else the first."""
    return table(spark, d, "part").select("p_partkey", R.application_domain(F.split("p_type", " ")).alias("domain"))


@query("SELECT p_partkey, list_slice(p, 1, 3) AS path, p[least(len(p), 3)] AS code FROM (SELECT p_partkey, list_append(string_split(p_type, ' '), p_brand) AS p FROM part)")
def capped_paths(spark, d):
    """PRJ-14: paths cut to three levels, with the code of the last one kept."""
    return R.capped_path(table(spark, d, "part").select("p_partkey", F.array_append(F.split("p_type", " "), F.col("p_brand")).alias("path")))


@query(f"{extract._SPANS} SELECT doc_id, start_pos, end_pos, entity, type FROM spans WHERE type = 'method'")
def typed_entities(spark, d):
    """FLT-11: entities of the allowed types."""
    spans = extract.scan_lexicon(table(spark, d, "documents"), "abstract_text", extract.LEXICON)
    return R.allowed_types(spans, spark.createDataFrame([("method",), ("method",)], "type string"))


@query("SELECT doc_id, contains(regexp_replace(content_text, '\\s+', '', 'g'), regexp_replace(title, '\\s+', '', 'g')) AND length(title) > 0 AS verbatim FROM documents WHERE title IS NOT NULL AND content_text IS NOT NULL")
def verbatim_quotes(spark, d):
    """FLT-13: titles that stand in the content word for word."""
    docs = table(spark, d, "documents").where("title IS NOT NULL AND content_text IS NOT NULL")
    return docs.select("doc_id", extract.quote_is_verbatim(F.col("title"), F.col("content_text")).alias("verbatim"))


@query(f"WITH k AS ({_KW}) SELECT DISTINCT a.doc_id, a.keyword AS head, b.keyword AS dep FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.keyword <> b.keyword AND regexp_matches(a.keyword, '[\\p{{L}}\\p{{N}}]') AND regexp_matches(b.keyword, '[\\p{{L}}\\p{{N}}]')")
def clean_arcs(spark, d):
    """FLT-14: arcs between neighbouring keywords without symbols, loops and repetitions."""
    k = _keywords(spark, d)
    after = k.select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("keyword").alias("dep"))
    arcs = k.select("doc_id", "pos", F.col("keyword").alias("head")).join(after, ["doc_id", "pos"]).select("doc_id", "head", "dep")
    return D.sanitised_arcs(arcs.unionByName(arcs.select("doc_id", "head", F.lit("->").alias("dep"))))


@query("SELECT id, CASE WHEN NOT (k >= 1 AND k < total) THEN k || ' clusters cannot be made of ' || total || ' items' END AS problem FROM (SELECT id, total, json_extract_string(parameters_json, '$.top_k')::BIGINT AS k FROM analysis_tasks) WHERE k IS NOT NULL AND total IS NOT NULL")
def cluster_prechecks(spark, d):
    """FLT-15: tasks that ask for more clusters than they have items."""
    t = table(spark, d, "analysis_tasks").select("id", "total", F.get_json_object("parameters_json", "$.top_k").cast("long").alias("k")).where("k IS NOT NULL AND total IS NOT NULL")
    return t.select("id", R.cluster_count_problem(F.col("k"), F.col("total")).alias("problem"))


@query("SELECT doc_id, regexp_matches(lower(abstract_text), '(^|[^a-z0-9])ice([^a-z0-9]|$)') AS has_ice, contains(abstract_text, '准确率') AS has_accuracy FROM documents WHERE abstract_text IS NOT NULL")
def contained_terms(spark, d):
    """FLT-16: a Latin term as a whole word, a Chinese one anywhere."""
    t = F.col("abstract_text")
    return table(spark, d, "documents").where("abstract_text IS NOT NULL").select("doc_id", R.contains_term(t, "ice").alias("has_ice"), R.contains_term(t, "准确率").alias("has_accuracy"))


@query("SELECT o_custkey AS key, count(*) AS gold, max(o_orderkey) AS pred FROM orders GROUP BY 1")
def paired_keys(spark, d):
    """JOIN-06: two results joined on a key that both must have."""
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "key")
    return L.pairs_checked(o.groupBy("key").agg(F.count("*").alias("gold")), o.groupBy("key").agg(F.max("o_orderkey").alias("pred")), "key")


@query("SELECT id, lang, source FROM documents WHERE lang IS NOT NULL AND doc_id % 2 = 0")
def restored_order(spark, d):
    """JOIN-08: parts of a result joined again on the document."""
    docs = table(spark, d, "documents")
    parts = [docs.where("lang IS NOT NULL").select("id", "lang"), docs.where("doc_id % 2 = 0").select("id", "source")]
    return R.restored(docs.select("id", "doc_id"), parts, "id", "doc_id").drop("doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM segment_sample)")
def calibration_subset(spark, d):
    """JOIN-09: rows that the calibration table names, however often."""
    return R.calibration_rows(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "segment_sample"), "doc_id")


@query("SELECT doc_id, trim(regexp_replace(abstract_text, '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM documents WHERE abstract_text IS NOT NULL")
def collapsed_texts(spark, d):
    """STR-01: runs of blanks to one."""
    return table(spark, d, "documents").where("abstract_text IS NOT NULL").select("doc_id", T.collapse(F.col("abstract_text")).alias("text"))


@query(f"WITH s AS ({_SENTS}) SELECT doc_id, idx, trim(regexp_replace(regexp_extract(regexp_extract(sentence, '(?s)^(.*)\\[\\d+(?:\\s*[-–,，]\\s*\\d+)*\\]', 1), '([^,;，；]*)$', 1), '\\[\\d+(?:\\s*[-–,，]\\s*\\d+)*\\]', '', 'g')) AS clause FROM s WHERE regexp_matches(sentence, '\\[\\d+(?:\\s*[-–,，]\\s*\\d+)*\\]')")
def citation_clauses(spark, d):
    """STR-17: the clause that the last marker of a sentence belongs to, without markers."""
    s = _sentences(spark, d)
    return s.where(F.col("sentence").rlike(extract.SPAN_MARKER)).select("doc_id", "idx", extract.citation_clause(F.col("sentence")).alias("clause"))


@query("SELECT doc_id, translate(abstract_text, '［］（）０１２３４５６７８９，－', '[]()0123456789,-') AS text FROM documents WHERE abstract_text IS NOT NULL")
def half_width_markers(spark, d):
    """STR-18: markers in half-width form."""
    return table(spark, d, "documents").where("abstract_text IS NOT NULL").select("doc_id", R.ascii_markers(F.col("abstract_text")).alias("text"))


@query("SELECT p_partkey, p_brand || p_size || ' mm2 of ' || p_partkey AS text FROM part")
def plain_formulas(spark, d):
    """STR-19: formulas as plain text."""
    f = F.concat(F.lit(r"$\text{"), "p_brand", F.lit("}_{"), F.col("p_size").cast("string"), F.lit(r"}$ \mathrm{mm}^{2}  of \quad {"), F.col("p_partkey").cast("string"), F.lit("}"))
    return table(spark, d, "part").select("p_partkey", D.latex_plain(f).alias("text"))


@query("SELECT p_partkey, CASE WHEN left(c, 1) = 'T' THEN left(c, 2) ELSE left(c, 1) END AS discipline FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'TP' ELSE 'R' END || p_size AS c FROM part)")
def discipline_codes(spark, d):
    """STR-24: discipline of a code: two letters for technical classes, one for others."""
    code = F.concat(F.when(F.col("p_partkey") % 2 == 0, "TP").otherwise("R"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", T.discipline(code).alias("discipline"))


@query("SELECT p_partkey, list_filter(k, lambda x, i: list_position(list_transform(k, lambda y: lower(y)), lower(x)) = i) AS keywords FROM (SELECT p_partkey, list_filter(list_transform(string_split(replace(p_type, ' ', ';') || ';' || replace(lower(p_name), ' ', ';') || '; ;', ';'), lambda x: trim(x)), lambda x: x <> '') AS k FROM part)")
def keyword_splits(spark, d):
    """STR-25, ARR-01: keywords split at their separators; the first of equal ones stays."""
    text = F.concat(F.regexp_replace("p_type", " ", "；"), F.lit(";"), F.regexp_replace(F.lower("p_name"), " ", "，"), F.lit("; ;"))
    return table(spark, d, "part").select("p_partkey", T.split_keywords(text).alias("keywords"))


_CLASSES = (("C1", "ice", "sea ice thickness"), ("C1", "ice", "glacier melt"), ("C2", "crops", "crop yield"), ("C2", "crops", "soil erosion"), ("C3", "flow", "membrane fouling"), ("C3", "flow", "traffic queues"), ("C4", "wind", "wind gusts"))


@query(
    f"WITH c(code, name, term) AS (VALUES {', '.join(map(str, _CLASSES))}), k AS (SELECT DISTINCT doc_id, lower(coalesce(title, '')) AS title, lower(keyword) AS term FROM ({_KW}) WHERE keyword IS NOT NULL), "
    "h AS (SELECT doc_id, code, name, title, count(*) + max(CASE WHEN contains(title, lower(name)) THEN 2 ELSE 0 END) AS score FROM k JOIN c USING (term) GROUP BY doc_id, code, name, title) SELECT doc_id, code, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) AS rank FROM h QUALIFY rank <= 5"
)
def scope_matches(spark, d):
    """TOP-03: classes of a document by its terms, with two more points for a name in the title."""
    k = table(spark, d, "documents").join(_keywords(spark, d).groupBy("doc_id").agg(F.collect_set("keyword").alias("terms")), "doc_id")
    return R.scope_top(spark.createDataFrame(_CLASSES, "code string, name string, term string"), k, "terms")


@query(f"WITH c AS ({_CENT}) SELECT vec_id, similarity FROM (SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], c.centroid), 6) AS similarity FROM embeddings e JOIN c USING (label)) WHERE similarity >= 0.3")
def above_threshold(spark, d):
    """TOP-08, RET-05, RES-44, MATH-03: vectors near the centre of their class."""
    e = table(spark, d, "embeddings")
    j = e.join(X.centroids(e, "label").select("label", "centroid"), "label")
    return R.above(j.select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("centroid")), 6).alias("similarity")), "similarity", 0.3)


@query(f"WITH k AS ({_KW}), r AS (SELECT doc_id, keyword AS candidate, 0.95 - 0.1 * pos AS score, pos, regexp_replace(lower(keyword), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g') AS key FROM k WHERE keyword IS NOT NULL) SELECT doc_id, key, arg_max(candidate, {{'a': score, 'b': candidate}}) AS candidate, round(max(score), 6) AS score, list_sort(list_distinct(list(pos))) AS evidence FROM r GROUP BY doc_id, key")
def merged_keys(spark, d):
    """SET-05: candidates of one normal key merged: best score, evidence of all."""
    k = _keywords(spark, d).select("doc_id", F.col("keyword").alias("candidate"), (0.95 - 0.1 * F.col("pos")).alias("score"), F.array("pos").alias("evidence"))
    return R.merged_candidates(k).withColumn("score", F.round("score", 6))


_WORDS = "list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+|[\\x{4e00}-\\x{9fff}]'))"


@query(
    f"WITH w AS (SELECT id, unnest({_WORDS}) AS w FROM document_collections), n AS (SELECT id, count(*) AS n FROM w GROUP BY id), s AS (SELECT a.id, b.id AS other, count(*) AS s FROM w a JOIN w b ON a.w = b.w AND a.id <> b.id GROUP BY ALL), "
    "t AS (SELECT s.id, round(max(s / least(n.n, m.n)), 6) AS overlap FROM s JOIN n USING (id) JOIN n m ON s.other = m.id GROUP BY s.id) SELECT c.id AS cluster_id, c.name AS label, coalesce(overlap, 0.0) AS overlap FROM document_collections c LEFT JOIN t USING (id)"
)
def label_overlaps(spark, d):
    """ARR-02, LAB-06: largest word overlap of a label with another."""
    return R.distinctiveness(table(spark, d, "document_collections").select(F.col("id").alias("cluster_id"), F.col("name").alias("label")))


@query(
    f"WITH s AS ({_SENTS}), r AS (SELECT doc_id, idx, CASE idx % 4 WHEN 0 THEN 'background' WHEN 1 THEN 'method' WHEN 2 THEN 'result' ELSE 'other' END AS label, CASE WHEN idx % 5 = 4 THEN 'not there' ELSE sentence END AS quote, sentence FROM s), "
    "p AS (SELECT *, nullif(list_position(['background', 'purpose', 'method', 'result', 'conclusion'], label), 0) AS place, count(*) OVER (PARTITION BY doc_id, quote) AS n FROM r), b AS (SELECT *, place < max(place) OVER (PARTITION BY doc_id ORDER BY idx) AS back FROM p) "
    "SELECT doc_id, count(*) FILTER (place IS NULL) AS illegal, count(*) FILTER (NOT contains(regexp_replace(sentence, '\\s+', '', 'g'), regexp_replace(quote, '\\s+', '', 'g'))) AS not_verbatim, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (back) AS out_of_order FROM b GROUP BY doc_id"
)
def label_check_counts(spark, d):
    """RUL-06: illegal labels, quotations that do not stand in the text, repetitions, labels out of order."""
    label = F.element_at(F.array(F.lit("background"), F.lit("method"), F.lit("result"), F.lit("other")), (F.col("idx") % 4 + 1).cast("int"))
    r = _sentences(spark, d).select("doc_id", "idx", label.alias("label"), F.when(F.col("idx") % 5 == 4, "not there").otherwise(F.col("sentence")).alias("quote"), F.col("sentence").alias("text"))
    return R.label_checks(r, rules.MOVES)


@query("SELECT l_suppkey, round(least(0.5, 0.2) * (right_n + 1) / (n + 2) * least(1.0, 0.5 + right_n / n) * 0.9, 6) AS weight FROM (SELECT l_suppkey, count(*)::DOUBLE AS n, count(*) FILTER (l_returnflag = 'N')::DOUBLE AS right_n FROM lineitem GROUP BY 1)")
def dynamic_weights(spark, d):
    """RUL-07: weights by reliability and coverage (here of suppliers' lines)."""
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("ok"))
    return g.select("l_suppkey", rules.effective_weight(F.lit(0.5), F.col("n"), F.col("ok"), F.col("ok") / F.col("n"), F.lit(0.9)).alias("weight"))


@query("SELECT doc_id, CASE WHEN f >= 3 AND c >= 800 THEN 0.75 WHEN f >= 2 AND c >= 200 THEN 0.6 ELSE 0.45 END::DOUBLE AS weight FROM (SELECT doc_id, length(coalesce(abstract_text, '')) + length(coalesce(content_text, '')) AS c, (title IS NOT NULL)::INT + (abstract_text IS NOT NULL)::INT + (content_text IS NOT NULL)::INT AS f FROM documents)")
def richness_weights(spark, d):
    """RUL-11: weight of the semantic evidence by the input's richness."""
    n = lambda c: F.char_length(F.coalesce(c, F.lit("")))
    there = lambda c: F.col(c).isNotNull().cast("int")
    return table(spark, d, "documents").select("doc_id", R.richness_weight(n("abstract_text") + n("content_text"), there("title") + there("abstract_text") + there("content_text")).alias("weight"))


@query(f"WITH c AS ({_CENT}), j AS (SELECT e.vec_id, e.embedding::DOUBLE[] AS a, c.centroid AS b FROM embeddings e JOIN c USING (label)), u AS (SELECT vec_id, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a)) * sqrt(0.64)) || list_transform(b, lambda x: x / sqrt(list_dot_product(b, b)) * sqrt(0.36)) AS v FROM j) SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 5)) AS blended FROM u")
def blended_vectors(spark, d):
    """RUL-12, CLU-10: base and augmenting vectors side by side, by the roots of their weights."""
    e = table(spark, d, "embeddings")
    j = e.join(X.centroids(e, "label").select("label", "centroid"), "label")
    return j.select("vec_id", F.transform(V.blend(F.col("embedding"), F.col("centroid"), 0.36), lambda x: F.round(x, 5)).alias("blended"))


@query(f"{extract._SPANS}, r AS (SELECT doc_id, type, lower(entity) AS form, entity, start_pos + 100 * c AS start_pos FROM spans, (VALUES (0), (1)) t(c)) SELECT doc_id, type, form, arg_min(entity, start_pos) AS entity, min(start_pos) AS start_pos FROM r GROUP BY ALL")
def merged_entities(spark, d):
    """EXT-11: entities of chunks moved to their place and kept once."""
    spans = extract.scan_lexicon(table(spark, d, "documents"), "abstract_text", extract.LEXICON)
    return R.merged_chunks(spans.select("doc_id", "type", "entity", "start_pos", F.explode(F.array(F.lit(0), F.lit(100))).alias("chunk_offset")))


@query(f"{extract._SPANS}, s AS ({_SENTS}), c AS (SELECT DISTINCT e.doc_id, idx, sentence FROM spans e JOIN s ON e.doc_id = s.doc_id AND contains(s.sentence, e.entity)), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx, sentence) AS i FROM c) SELECT doc_id, list('S' || i || ': ' || sentence ORDER BY i) AS contexts FROM n GROUP BY doc_id")
def entity_contexts(spark, d):
    """EXT-14: numbered contexts of a document's entities."""
    spans = extract.scan_lexicon(table(spark, d, "documents"), "abstract_text", extract.LEXICON).select("doc_id", "entity")
    return W.entity_context(spans, _sentences(spark, d).select("doc_id", "idx", "sentence"))


@query("SELECT arg_max(weight, {'m': round(m, 9), 'w': -weight}) AS weight, round(max(m), 6) AS recall FROM (SELECT p_size AS weight, avg(CASE WHEN p_retailprice > 1200 THEN 1 ELSE 0 END) AS m FROM part GROUP BY 1)")
def grid_choices(spark, d):
    """EVL-02: the weight of a grid with the best mean recall."""
    return R.grid_choice(table(spark, d, "part").select(F.col("p_size").alias("weight"), (F.col("p_retailprice") > 1200).cast("int").alias("recall")))


@query(f"WITH l(entity, type, latin) AS (VALUES {extract._lexicon_values()}), x AS (SELECT doc_id, entity, instr(lower(abstract_text), entity) - 1 AS start_pos, instr(lower(abstract_text), entity) - 1 + length(entity) AS end_pos FROM documents, l WHERE instr(lower(abstract_text), entity) > 0) SELECT a.doc_id, a.start_pos, a.end_pos, a.entity FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.doc_id = a.doc_id AND b.start_pos <= a.start_pos AND b.end_pos >= a.end_pos AND b.end_pos - b.start_pos > a.end_pos - a.start_pos)")
def longest_entities(spark, d):
    """RES-01: entities that lie within a longer one are dropped."""
    low = F.lower("abstract_text")
    found = F.filter(F.array(*(F.when(F.locate(t, low) > 0, F.struct((F.locate(t, low) - 1).alias("start_pos"), (F.locate(t, low) - 1 + len(t)).alias("end_pos"), F.lit(t).alias("entity"))) for t, _ in extract.LEXICON)), lambda x: x.isNotNull())
    return D.without_nested(table(spark, d, "documents").select("doc_id", F.inline(found)))


@query(f"WITH k AS ({_KW}) SELECT doc_id, count(*) AS n, count(*) FILTER (pos < 2) AS dictionary_hits, CASE WHEN length(regexp_replace(string_agg(keyword, ''), '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) / greatest(length(string_agg(keyword, '')), 1) > 0.08 THEN 'zh' ELSE 'en' END AS language FROM k WHERE keyword IS NOT NULL GROUP BY doc_id")
def keyword_shapes(spark, d):
    """RES-20: keyword results of a document: counts, dictionary hits, language."""
    return W.keyword_shape(_keywords(spark, d).select("doc_id", "keyword", (F.col("pos") < 2).alias("in_dictionary")))


@query(f"WITH s AS ({_SENTS}), q AS (SELECT doc_id, idx AS q FROM s WHERE contains(sentence, '?') OR contains(sentence, '？')) SELECT s.doc_id, q, arg_min(idx, {{'a': abs(idx - q), 'b': idx}}) AS nearest, arg_max(idx, {{'a': least(length(sentence), 420), 'b': -idx}}) AS richest FROM q JOIN s ON q.doc_id = s.doc_id AND idx <> q GROUP BY ALL")
def recovered_methods(spark, d):
    """RES-23: for every question the nearest and the richest other sentence."""
    s = _sentences(spark, d)
    return W.nearest_or_richest(s, s.where("contains(sentence, '?') OR contains(sentence, '？')"))


@query("SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":' || coalesce('\"' || lang || '\"', 'null') || ',\"source\":\"' || source || '\"}') AS key FROM documents")
def cache_keys(spark, d):
    """RES-26: key of a request from its fields in sorted order."""
    return table(spark, d, "documents").select("doc_id", R.cache_key("source", "lang", "doc_id").alias("key"))


@query("SELECT doc_id, coalesce(contains(content_text, split_part(title, ' ', 1)), false) AND coalesce(contains(content_text, left(abstract_text, 20)), false) AS valid FROM documents WHERE content_text IS NOT NULL AND title IS NOT NULL AND abstract_text IS NOT NULL")
def valid_axes(spark, d):
    """RES-28: an axis counts with a verified term and a verified quotation."""
    docs = table(spark, d, "documents").where("content_text IS NOT NULL AND title IS NOT NULL AND abstract_text IS NOT NULL")
    return docs.select("doc_id", R.axes_valid(F.array(F.split_part("title", F.lit(" "), F.lit(1))), F.array(F.substring("abstract_text", 1, 20)), F.col("content_text")).alias("valid"))


@query(
    "WITH r AS (SELECT p_size AS cluster_id, p_name || p_partkey AS candidate, p_partkey % 97 / 100.0 AS score, p_partkey % 7 / 100.0 AS bonus, p_partkey % 3 = 0 AS fallback FROM part), s AS (SELECT *, round((score + CASE WHEN fallback THEN least(bonus, 0.05) ELSE 0 END)::DOUBLE, 6) AS f FROM r), "
    "b AS (SELECT cluster_id, max(f) FILTER (fallback) AS sf, max(f) FILTER (NOT fallback) AS bf, arg_max(candidate, {'f': f, 'c': candidate}) FILTER (fallback) AS sc, arg_max(candidate, {'f': f, 'c': candidate}) FILTER (NOT fallback) AS bc FROM s GROUP BY 1) "
    "SELECT cluster_id, CASE WHEN u THEN sc ELSE bc END AS label, u AS from_fallback FROM (SELECT *, sf IS NOT NULL AND (bf IS NULL OR sf > bf + 0.002::DOUBLE) AS u FROM b)"
)
def soft_labels(spark, d):
    """RES-32: a fallback candidate wins only by a lead, with its bonus held to a cap."""
    p = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.col("p_size").alias("cluster_id"), F.concat("p_name", p.cast("string")).alias("candidate"), (p % 97 / 100.0).alias("score"), (p % 7 / 100.0).alias("bonus"), (p % 3 == 0).alias("fallback"))
    return R.soft_choice(rows)


@query(
    f"WITH k AS ({_KW}), p AS (SELECT a.doc_id, a.pos, list_distinct(list_filter(regexp_extract_all(lower(a.keyword), '[a-z]+'), lambda w: length(w) > 2)) AS x, list_distinct(list_filter(regexp_extract_all(lower(b.keyword), '[a-z]+'), lambda w: length(w) > 2)) AS y FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.keyword IS NOT NULL AND b.keyword IS NOT NULL) "
    "SELECT doc_id, pos, CASE WHEN least(len(x), len(y)) = 0 THEN false ELSE len(list_intersect(x, y)) / least(len(x), len(y)) >= 0.5 END AS near FROM p"
)
def near_concepts(spark, d):
    """RES-35: neighbouring keywords that share half of their content words."""
    k = _keywords(spark, d)
    after = k.select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("keyword").alias("next"))
    return k.join(after, ["doc_id", "pos"]).select("doc_id", "pos", R.near_concepts(F.col("keyword"), F.col("next")).alias("near"))


@query(
    f"WITH s AS ({_SENTS}), r AS (SELECT s.doc_id, idx, sentence AS question, sentence || '!' AS method, instr(x.abstract_text, sentence) - 1 AS q_at, instr(x.content_text, sentence) - 1 AS m_at, regexp_replace(lower(sentence), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g') AS key FROM s JOIN documents x USING (doc_id) WHERE x.content_text IS NOT NULL) "
    "SELECT doc_id, idx, question, CASE WHEN m_at >= 0 THEN method ELSE '' END AS method FROM r WHERE q_at >= 0 QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY idx) = 1"
)
def located_methods(spark, d):
    """RES-38, REV-02: methods without located evidence are blanked, questions without are dropped."""
    docs = table(spark, d, "documents").where("content_text IS NOT NULL")
    s = sentence_rows(docs, "abstract_text", "content_text", "abstract_text")
    at = lambda c: F.call_function("locate", F.col("sentence"), F.col(c)) - 1
    return R.method_checks(s.select("doc_id", "idx", F.col("sentence").alias("question"), F.concat("sentence", F.lit("!")).alias("method"), at("abstract_text").alias("q_at"), at("content_text").alias("m_at")))


@query(f"WITH c AS ({_CENT}) SELECT label AS cluster_id, min(list_cosine_similarity(e.embedding::DOUBLE[], c.centroid)) FILTER (vec_id % 7 <> 0) >= 0.05 AS passes FROM embeddings e JOIN c USING (label) GROUP BY 1")
def covered_labels(spark, d):
    """RES-39: a label passes where every informative title of its cluster is near it."""
    e = table(spark, d, "embeddings")
    labels = X.centroids(e, "label").select(F.col("label").alias("cluster_id"), F.col("centroid").alias("label_vec"))
    titles = e.select(F.col("label").alias("cluster_id"), F.col("embedding").alias("title_vec"), F.when(F.col("vec_id") % 7 == 0, "scan.pdf").otherwise("A title").alias("title"))
    return W.covers_members(labels, titles, 0.05)


@query(
    "WITH s AS (SELECT user_id AS doc_id, event_id // 7 AS sentence, event_type AS anchor, least(value / 20.0123::DOUBLE, 1) AS similarity FROM events), m AS (SELECT doc_id, anchor, sentence, max(similarity) AS s FROM s GROUP BY ALL), a AS (SELECT doc_id, anchor, avg(s) AS s FROM m GROUP BY ALL), "
    "b AS (SELECT doc_id, arg_max(anchor, {'s': s, 'a': anchor}) AS anchor, max(s) AS s FROM a GROUP BY 1) SELECT doc_id, CASE WHEN s >= 0.55 THEN anchor END AS anchor, round(s, 6) AS similarity FROM b"
)
def anchor_choices(spark, d):
    """RES-42: the anchor with the best mean similarity over sentences, where it is enough."""
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.floor(F.col("event_id") / 7).alias("sentence"), F.col("event_type").alias("anchor"), F.least(F.col("value") / 20.0123, F.lit(1.0)).alias("similarity"))
    return W.anchor_gate(e)


@query("SELECT doc_id, len(t) > 0 AND NOT v AS active, CASE WHEN len(t) > 0 AND NOT v THEN list_slice(list_filter(e || t, lambda x, i: list_position(e || t, x) = i), 1, 5) ELSE e END AS evidence FROM (SELECT doc_id, string_split(source, '-') AS t, [source, coalesce(lang, 'none')] AS e, doc_id % 2 = 0 AS v FROM documents)")
def rule_masks(spark, d):
    """RES-45: rows in which rules are active, with the evidence of both."""
    rows = table(spark, d, "documents").select("doc_id", F.split("source", "-").alias("rule_terms"), F.array("source", F.coalesce("lang", F.lit("none"))).alias("evidence"), (F.col("doc_id") % 2 == 0).alias("verified"))
    return W.rule_mask(rows).select("doc_id", "active", "evidence")


@query("SELECT id AS document_id, source FROM documents")
def unique_reviews(spark, d):
    """REV-01: documents whose ids are unique (an error otherwise)."""
    return W.unique_documents(table(spark, d, "documents").select(F.col("id").alias("document_id"), "source"))


@query(f"WITH s AS ({_SENTS}), r AS (SELECT doc_id, idx, CASE WHEN regexp_matches(sentence, '{extract.MARKER}') THEN 'numbered' WHEN regexp_matches(sentence, '{extract.AUTHOR_YEAR.replace(chr(39), chr(39) * 2)}') THEN 'author_year' END AS label FROM s) SELECT label, count(*) AS sentences, count(DISTINCT doc_id) AS docs FROM r WHERE label IS NOT NULL GROUP BY label")
def citation_label_counts(spark, d):
    """RES-14: citation sentences by label; documents are counted over distinct pairs."""
    label = F.when(F.col("sentence").rlike(extract.MARKER), "numbered").when(F.col("sentence").rlike(extract.AUTHOR_YEAR), "author_year")
    return R.label_counts(_sentences(spark, d).withColumn("label", label).where("label IS NOT NULL"))


@query(f"WITH s AS ({_SENTS}), r AS (SELECT doc_id, idx, sentence, 0.9 AS c, CASE WHEN idx % 2 = 0 THEN 'use' ELSE 'compare' END AS label FROM s), x AS (SELECT doc_id, idx, label, round((CASE WHEN label = 'compare' THEN 0.63 ELSE 0 END + CASE WHEN contains(sentence, 'than') THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS s_compare, round((CASE WHEN label = 'use' THEN 0.63 ELSE 0 END + CASE WHEN contains(sentence, 'with') THEN 0.15 ELSE 0 END - CASE WHEN contains(sentence, 'than') THEN 0.3 ELSE 0 END)::DOUBLE, 6) AS s_use FROM r) SELECT *, CASE WHEN s_compare >= s_use THEN 'compare' ELSE 'use' END AS suggestion FROM x")
def citation_rule_scores(spark, d):
    """RUL-08: label scores of sentences: the model's label at 0.70 times its confidence, plus rules."""
    r = _sentences(spark, d).select(F.struct("doc_id", "idx").alias("id"), "sentence", F.when(F.col("idx") % 2 == 0, "use").otherwise("compare").alias("label"), F.lit(0.9).alias("confidence"))
    return W.citation_scores(r, [("than", "compare", 0.2), ("with", "use", 0.15), ("than", "use", -0.3)]).select("id.*", "label", "s_compare", "s_use", "suggestion")


@query(f"WITH c AS (SELECT doc_id, idx, i AS place, parts[i] AS clause, CASE i % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS label FROM (SELECT doc_id, idx, string_split(sentence, ', ') AS parts FROM ({_SENTS})), unnest(range(1, len(parts) + 1)) AS r(i)) SELECT doc_id, idx, place, clause, CASE WHEN length(clause) < 12 THEN coalesce(lag(label) OVER w, lead(label) OVER w, label) ELSE label END AS label FROM c WINDOW w AS (PARTITION BY doc_id, idx ORDER BY place)")
def clause_fragments(spark, d):
    """WIN-05: short clauses take the label of a neighbour in their sentence."""
    c = _sentences(spark, d).select("doc_id", "idx", F.posexplode(F.split("sentence", ", ")).alias("place", "clause")).withColumn("place", (F.col("place") + 1).cast("long"))
    label = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("place") % 3 + 1).cast("int"))
    return W.moved_fragments(c.withColumn("label", label))


@query(f"WITH s AS ({_SENTS}), p AS (SELECT doc_id, left(abstract_text, length(abstract_text) // 2) AS span, 'first' AS label FROM documents WHERE abstract_text IS NOT NULL UNION ALL SELECT doc_id, abstract_text, 'whole' FROM documents WHERE abstract_text IS NOT NULL) SELECT s.doc_id, s.idx, arg_max(label, {{'n': length(span), 'l': label}}) AS label FROM s JOIN p USING (doc_id) WHERE contains(span, sentence) OR contains(sentence, span) GROUP BY ALL")
def sentence_spans(spark, d):
    """JOIN-16: every sentence with the longest span that holds it or that it holds."""
    docs = table(spark, d, "documents").where("abstract_text IS NOT NULL")
    half = F.substring(F.col("abstract_text"), F.lit(1), F.floor(F.char_length("abstract_text") / 2).cast("int"))
    spans = docs.select("doc_id", half.alias("span"), F.lit("first").alias("label")).unionByName(docs.select("doc_id", F.col("abstract_text").alias("span"), F.lit("whole").alias("label")))
    return W.spans_to_sentences(spans, sentence_rows(docs, "abstract_text"))


@query()
def spectral_clusters(spark, d):
    """CLU-04: spectral clusters of the mutual neighbours of the queries (seeded, so without SQL)."""
    e = table(spark, d, "embeddings")
    edges = X.top_k(e.where("vec_id % 50 = 0"), e, 5).where("similarity > 0").select(F.least("query_id", "neighbour").alias("src"), F.greatest("query_id", "neighbour").alias("dst"), F.col("similarity").alias("weight")).distinct()
    return W.spectral(edges, 3)


@query()
def compact_vectors(spark, d):
    """CLU-09: vectors projected to eight dimensions (signs are arbitrary, so without SQL)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("v"))
    return W.compact(e, "v", 8).select("vec_id", vector_to_array("compact").alias("compact"))
