"""Extraction from sentences and texts: citations, definitions, questions, lexicon entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as T

# Cues and markers.
MARKER = r"\[\d+(?:\s*[-,，–]\s*\d+)*\]"
AUTHOR_YEAR = r"\([A-Z][A-Za-z'-]+(?: et al\.?)?,? (?:19|20)\d{2}\)"
DEFINES = "is defined as|refers to|is called|wird definiert als|se define como|定义为|是指|とは"
MAY_DEFINE = "we describe|describe a|we propose|beschreiben|presentamos|讨论了|提案"
QUESTION = "why|whether|how|warum|pourquoi|por qué|为什么|如何|究竟|なぜ|왜|почему"
GOAL = "aim|to this end|propose|examine|untersuchen|本文"
# Terms with their types; a term may be part of another.
LEXICON = (
    ("sea ice thickness", "topic"), ("sea ice", "topic"), ("citation intent", "topic"), ("crop yield", "topic"), ("urban noise", "topic"), ("drift filter", "method"), ("kernel estimator", "method"), ("residual network", "method"), ("graph sampler", "method"), ("query planner", "method"),
    ("膜污染", "topic"), ("城市噪声", "topic"), ("土壤侵蚀", "topic"), ("图采样方法", "method"), ("残差网络", "method"), ("accuracy", "metric"), ("median error", "metric"), ("error", "metric"), ("coverage", "metric"), ("准确率", "metric"),
)


def citations(sentences: DataFrame) -> DataFrame:
    """Sentences with a citation: certain by a numbered marker or author and year, else none.

    ``numbers`` holds the distinct numbers of all markers in order of first mention.
    """
    marks = F.regexp_extract_all("sentence", F.lit(MARKER), 0)
    numbers = F.array_distinct(F.flatten(F.transform(marks, T.expand_markers)))
    author = F.regexp_count("sentence", F.lit(AUTHOR_YEAR))
    return sentences.select("doc_id", "idx", F.size(marks).alias("markers"), author.alias("author_years"), numbers.alias("numbers")).where("markers > 0 OR author_years > 0")


_NUM = "list_transform(regexp_extract_all({m}, '\\d+(?:\\s*-\\s*\\d+)?'), lambda p: CASE WHEN regexp_extract(p, '(\\d+)$', 1)::INT >= regexp_extract(p, '^(\\d+)', 1)::INT THEN range(regexp_extract(p, '^(\\d+)', 1)::INT, regexp_extract(p, '(\\d+)$', 1)::INT + 1) ELSE [regexp_extract(p, '^(\\d+)', 1)::INT, regexp_extract(p, '(\\d+)$', 1)::INT] END)"
MARKERS_SQL = (
    "WITH s AS ({sents}), m AS (SELECT doc_id, idx, regexp_extract_all(sentence, '" + MARKER.replace("{", "{{").replace("}", "}}") + "') AS marks, len(regexp_extract_all(sentence, '" + AUTHOR_YEAR.replace("{", "{{").replace("}", "}}").replace("'", "''") + "')) AS author_years FROM s), "
    "n AS (SELECT *, flatten(list_transform(marks, lambda x: flatten(" + _NUM.replace("{m}", "translate(x, '，－–—、', ',---,')") + "))) AS all_numbers FROM m) "
    "SELECT doc_id, idx, len(marks) AS markers, author_years, list_filter(all_numbers, lambda x, i: list_position(all_numbers, x) = i) AS numbers FROM n WHERE len(marks) > 0 OR author_years > 0"
)


def definitions(docs: DataFrame) -> DataFrame:
    """Definition sentences of (doc_id, s), an array of sentences: certain by a marker phrase, uncertain by
    a cue; with their neighbours, which are taken within the array."""
    rows = docs.select("doc_id", F.posexplode(T.with_neighbours("s")).alias("idx", "c"))
    low = F.lower("c.item")
    kind = F.when(low.rlike(DEFINES), "certain").when(low.rlike(MAY_DEFINE), "uncertain")
    return rows.select("doc_id", "idx", F.col("c.item").alias("sentence"), kind.alias("certainty"), F.col("c.before").alias("prev"), F.col("c.after").alias("next")).where("certainty IS NOT NULL")


_DEF = f"SELECT * FROM (SELECT doc_id, idx, sentence, CASE WHEN regexp_matches(lower(sentence), '{DEFINES}') THEN 'certain' WHEN regexp_matches(lower(sentence), '{MAY_DEFINE}') THEN 'uncertain' END AS certainty, coalesce(lag(sentence) OVER w, '') AS prev, coalesce(lead(sentence) OVER w, '') AS next FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) WHERE certainty IS NOT NULL"
DEFINITIONS_SQL = "WITH s AS ({sents}) " + _DEF


def questions(sentences: DataFrame) -> DataFrame:
    """Up to two sentences of a document with the best cue score above 0; ties by place."""
    low = F.lower("sentence")
    score = 2 * F.regexp_count(low, F.lit(QUESTION)) + F.regexp_count(low, F.lit(GOAL)) + F.col("sentence").rlike("[?？]$").cast("int")
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "idx")
    return sentences.withColumn("score", score).where("score > 0").withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("doc_id", "idx", "score", "rank")


QUESTIONS_SQL = (
    "WITH s AS ({sents}), t AS (SELECT doc_id, idx, 2 * len(regexp_extract_all(lower(sentence), '" + QUESTION + "')) + len(regexp_extract_all(lower(sentence), '" + GOAL + "')) + CASE WHEN regexp_matches(sentence, '[?？]$') THEN 1 ELSE 0 END AS score FROM s) "
    "SELECT doc_id, idx, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rank FROM t WHERE score > 0 QUALIFY rank <= 2"
)


def lexicon_spans(docs: DataFrame, col: str, lexicon: tuple[tuple[str, str], ...]) -> DataFrame:
    """Rows (doc_id, text, spans): first occurrence of every lexicon term in a text that no longer found term covers.

    Latin terms match whole words, others anywhere; case is ignored. The lexicon is part of the
    expression, so the scan needs no join.
    """
    low = F.lower(col)
    found = []
    for term, kind in lexicon:
        pattern = rf"(?<![a-z0-9]){term}(?![a-z0-9])" if term.isascii() else term
        at = F.regexp_instr(low, F.lit(pattern)) - 1
        found.append(F.when(at >= 0, F.struct(at.alias("start_pos"), (at + len(term)).alias("end_pos"), F.lit(term).alias("entity"), F.lit(kind).alias("type"))))
    rows = docs.select("doc_id", col, F.filter(F.array(*found), lambda x: x.isNotNull()).alias("spans")).where(F.size("spans") > 0)
    longer = lambda x, y: (y["start_pos"] <= x["start_pos"]) & (y["end_pos"] >= x["end_pos"]) & (y["end_pos"] - y["start_pos"] > x["end_pos"] - x["start_pos"])
    return rows.withColumn("spans", F.filter("spans", lambda x: ~F.exists("spans", lambda y: longer(x, y))))


def scan_lexicon(docs: DataFrame, col: str, lexicon: tuple[tuple[str, str], ...]) -> DataFrame:
    """The spans of ``lexicon_spans``, one row each."""
    return lexicon_spans(docs, col, lexicon).select("doc_id", F.inline("spans"))


def _lexicon_values() -> str:
    return ", ".join(f"('{t}', '{k}', {'true' if t.isascii() else 'false'})" for t, k in LEXICON)


_SPANS = (
    f"WITH l(entity, type, latin) AS (VALUES {_lexicon_values()}), h AS (SELECT doc_id, lower(abstract_text) AS t, entity, type, latin FROM documents, l), "
    "p AS (SELECT doc_id, entity, type, CASE WHEN latin THEN CASE WHEN regexp_matches(t, '(?s)^' || entity || '(?:[^a-z0-9]|$)') THEN 0 WHEN regexp_matches(t, '[^a-z0-9]' || entity || '(?:[^a-z0-9]|$)') THEN length(regexp_extract(t, '(?s)^(.*?[^a-z0-9])' || entity || '(?:[^a-z0-9]|$)', 1)) END "
    "ELSE nullif(instr(t, entity), 0) - 1 END AS start_pos FROM h), x AS (SELECT doc_id, entity, type, start_pos, start_pos + length(entity) AS end_pos FROM p WHERE start_pos IS NOT NULL), "
    "spans AS (SELECT * FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.doc_id = a.doc_id AND b.start_pos <= a.start_pos AND b.end_pos >= a.end_pos AND b.end_pos - b.start_pos > a.end_pos - a.start_pos))"
)
LEXICON_SQL = _SPANS + " SELECT doc_id, start_pos, end_pos, entity, type FROM spans"


def entity_summary(spans: DataFrame) -> DataFrame:
    """Entities of a document by type, and its dominant type (most entities; ties by first place)."""
    by_type = spans.groupBy("doc_id", "type").agg(F.countDistinct("entity").alias("n"), F.min("start_pos").alias("first"))
    return by_type.groupBy("doc_id").agg(F.sum("n").alias("entities"), F.count("*").alias("types"), F.max_by("type", F.struct(F.col("n"), -F.col("first"), F.col("type"))).alias("dominant"))


ENTITIES_SQL = _SPANS + ", b AS (SELECT doc_id, type, count(DISTINCT entity) AS n, min(start_pos) AS first FROM spans GROUP BY ALL) SELECT doc_id, sum(n)::BIGINT AS entities, count(*) AS types, arg_max(type, {'a': n, 'b': -first, 'c': type}) AS dominant FROM b GROUP BY doc_id"


CONCEPT = rf"((?:[a-z0-9-]+ ){{0,2}}[a-z0-9-]+|[\x{{4e00}}-\x{{9fff}}]{{2,12}}) ?(?:{DEFINES}|{MAY_DEFINE})"
# Words that introduce a term but are no part of it.
LEADING = r"^(?:(?:the|a|an|this|our|here|we|that|and|in|of|to|then|for) )+"


def group_concepts(defs: DataFrame) -> DataFrame:
    """RES-16, RES-17: definitions by concept, the term to the left of the marker (up to three words, or
    Chinese characters), in one case; a concept's first document, its definitions, mean confidence."""
    concept = F.regexp_replace(F.regexp_extract(F.lower("sentence"), CONCEPT, 1), LEADING, "")
    conf = F.when(F.col("certainty") == "certain", 0.9).otherwise(0.6)
    g = defs.withColumns({"concept": concept, "c": conf}).where("concept <> ''").groupBy("concept")
    return g.agg(F.count("*").alias("definition_count"), F.min("doc_id").alias("first_doc"), F.min_by("sentence", F.struct("doc_id", "idx")).alias("first_definition"), F.round(F.avg("c"), 6).alias("confidence"))


_CONCEPT_SQL = CONCEPT.replace("{", "{{").replace("}", "}}")
CONCEPT_SQL = "WITH s AS ({sents}), d AS (" + _DEF + "), c AS (SELECT *, regexp_replace(regexp_extract(lower(sentence), '" + _CONCEPT_SQL + "', 1), '" + LEADING + "', '') AS concept FROM d) SELECT concept, count(*) AS definition_count, min(doc_id) AS first_doc, arg_min(sentence, {{'a': doc_id, 'b': idx}}) AS first_definition, round(avg(CASE WHEN certainty = 'certain' THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END), 6) AS confidence FROM c WHERE concept <> '' GROUP BY concept"


def quote_is_verbatim(quote: Column, source: Column) -> Column:
    """FLT-13: evidence counts only where it stands in the source word for word, blanks aside."""
    return F.contains(F.regexp_replace(source, r"\s+", ""), F.regexp_replace(quote, r"\s+", "")) & (F.char_length(quote) > 0)


SPAN_MARKER = r"\[\d+(?:\s*[-–,，]\s*\d+)*\]"


def citation_clause(sentence: Column) -> Column:
    """STR-17: the clause of a sentence that its last marker belongs to, without markers; empty without one."""
    before = F.regexp_extract(sentence, rf"(?s)^(.*){SPAN_MARKER}", 1)
    return F.trim(F.regexp_replace(F.regexp_extract(before, "([^,;，；]*)$", 1), SPAN_MARKER, ""))
