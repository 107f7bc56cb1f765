"""Queries on document text and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.operators import extract, keywords, rules
from strataloom.session import spread, table

HAN = r"[\x{4e00}-\x{9fff}]"
_in = lambda terms: ", ".join(f"'{t}'" for t in terms)


def _count(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce({col}, ''), '{pattern}'))"


_WORDS = r"regexp_extract_all(lower(coalesce({c}, '')), '[a-z\x{{df}}-\x{{24f}}]+')"


def _english(c: str) -> str:
    acc = _count(c, r"[\x{c0}-\x{24f}]")
    w = _WORDS.format(c=c)
    return (
        f"NOT ({acc} > 0.005 * ({_count(c, '[A-Za-z]')} + {acc}) OR (len(list_filter({w}, lambda x: x IN ({_in(T.ENGLISH)}))) = 0"
        f" AND len(list_filter({w}, lambda x: x IN ({_in(T.OTHER_LATIN)}))) >= 2))"
    )


def _gate(c: str) -> str:
    return (
        f"CASE WHEN {_count(c, r'[A-Za-z\x{c0}-\x{24f}\x{4e00}-\x{9fff}]')} < 30 THEN 'pass' WHEN {_count(c, HAN)} > 20 THEN 'zh'"
        f" WHEN {_english(c)} THEN 'en' ELSE 'non_english' END"
    )


_COLLAPSE = r"trim(regexp_replace({x}, '[ \t\r\n]+', ' ', 'g'), ' ')"
_SENTENCES = "list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '[^.!?。！？]+[.!?。！？]*'), lambda x: " + _COLLAPSE.format(x="x") + "), lambda x: length(x) > 0)"


def sents(c: str, extra: str = "") -> str:
    """SQL of one row for each sentence: doc_id, idx (from 0), n, sentence."""
    return (
        f"SELECT doc_id, i - 1 AS idx, len(s) AS n, s[i] AS sentence{extra} FROM (SELECT *, {_SENTENCES.format(c=c)} AS s FROM documents) d, "
        "unnest(range(1, len(s) + 1)) AS r(i)"
    )


QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def sentence_rows(docs: DataFrame, col: str, *keep: str) -> DataFrame:
    s = spread(docs.select("doc_id", *keep, F.col(col).alias("t"))).select("doc_id", *keep, T.sentences(F.col("t")).alias("s")).withColumn("n", F.size("s"))
    return s.select("doc_id", *keep, "n", F.posexplode("s").alias("idx", "sentence"))


def sentence_arrays(docs: DataFrame, col: str) -> DataFrame:
    """The sentences of every document as one array."""
    return spread(docs.select("doc_id", F.col(col).alias("t"))).select("doc_id", T.sentences(F.col("t")).alias("s"))


def labelled_rows(docs: DataFrame, col: str) -> DataFrame:
    """The sentences of ``sentence_rows`` with what the rules need to know of those before them."""
    return rules.seen_before(sentence_arrays(docs, col))


@query(
    f"""SELECT doc_id, {_count('abstract_text', HAN)} AS han, {_count('abstract_text', '[A-Za-z]')} AS latin, {_gate('abstract_text')} AS gate,
    CASE WHEN {_count('abstract_text', HAN)} > 0.2 * {_count('abstract_text', '[A-Za-z]')} THEN 'zh' ELSE 'en' END AS by_ratio,
    CASE WHEN {_count('abstract_text', HAN)} / greatest(length(coalesce(abstract_text, '')), 1) > 0.08 THEN 'zh' ELSE 'en' END AS by_share,
    CASE WHEN {_count('abstract_text', HAN)} >= greatest(2, {_count('abstract_text', '[A-Za-z]')}) THEN 'zh' ELSE 'en' END AS by_count FROM documents"""
)
def language_gate(spark, d):
    """FLT-01..04: language gates and three detectors on every abstract."""
    c = F.col("abstract_text")
    return table(spark, d, "documents").select("doc_id", T.cjk_count(c).alias("han"), T.latin_count(c).alias("latin"), T.language_gate(c).alias("gate"), T.detect_by_ratio(c).alias("by_ratio"), T.detect_by_share(c).alias("by_share"), T.detect_by_count(c).alias("by_count"))


_METHOD, _RESULT = "propose|method|trained|present|erweitern|proponemos|提出|基于|方法", "result|improves|show|found|reached|结果|提高|改善|表明"


@query(
    f"""WITH s AS ({sents('abstract_text', ', source, ' + _gate('abstract_text') + ' AS gate')})
    SELECT gate, source, count(DISTINCT doc_id) AS docs, count(*) AS sentences, sum(CASE WHEN regexp_matches(lower(sentence), '{_METHOD}') THEN 1 ELSE 0 END)::BIGINT AS method_hits,
    sum(CASE WHEN regexp_matches(lower(sentence), '{_RESULT}') THEN 1 ELSE 0 END)::BIGINT AS result_hits FROM s WHERE gate <> 'pass' GROUP BY gate, source"""
)
def document_cue_profile(spark, d):
    """Minimum slice: documents admitted by the gate, their sentences and cue hits, by language and source."""
    docs = spread(table(spark, d, "documents").select("source", "abstract_text", T.language_gate(F.col("abstract_text")).alias("gate"))).where("gate <> 'pass'")
    low = docs.select("gate", "source", F.transform(T.sentences(F.col("abstract_text")), lambda x: F.lower(x)).alias("s")).where(F.size("s") > 0)
    hits = lambda p: F.sum(F.size(F.filter("s", lambda x: x.rlike(p)))).cast("long")
    return low.groupBy("gate", "source").agg(F.count("*").alias("docs"), F.sum(F.size("s")).cast("long").alias("sentences"), hits(_METHOD).alias("method_hits"), hits(_RESULT).alias("result_hits"))


@query(f"WITH s AS ({sents('abstract_text')}) SELECT doc_id, idx, n, sentence, round(idx / n::DOUBLE, 6) AS rel_pos, CASE WHEN idx / n::DOUBLE < 0.25 THEN 'beginning' WHEN idx / n::DOUBLE < 0.75 THEN 'middle' ELSE 'ending' END AS bucket FROM s")
def sentence_explode(spark, d):
    """STR-06, WIN-03: sentences with their relative position and its bucket."""
    rel = F.col("idx") / F.col("n")
    return sentence_rows(table(spark, d, "documents"), "abstract_text").select("doc_id", "idx", "n", "sentence", F.round(rel, 6).alias("rel_pos"), F.when(rel < 0.25, "beginning").when(rel < 0.75, "middle").otherwise("ending").alias("bucket"))


_HEADING = r"^(#{1,6} .*|[0-9]+([.][0-9]+)*[.]?|(图|表|Fig[.]?|Figure|Table|Tab[.]?) ?[0-9]+.*)$"


@query(
    f"""WITH s AS ({sents('content_text')}), t AS (SELECT *, regexp_matches(sentence, '{_HEADING}') AS heading FROM s)
    SELECT doc_id, idx, CASE WHEN lag(heading) OVER w THEN '' ELSE coalesce(lag(sentence) OVER w, '') END AS prev_sentence, CASE WHEN lead(heading) OVER w THEN '' ELSE coalesce(lead(sentence) OVER w, '') END AS next_sentence
    FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY idx)"""
)
def sentence_context(spark, d):
    """WIN-01: the sentences before and after, blank where one is a heading or caption."""
    docs = sentence_arrays(table(spark, d, "documents"), "content_text")
    return docs.select("doc_id", F.posexplode(T.with_neighbours("s", lambda x: x.rlike(_HEADING))).alias("idx", "c")).select("doc_id", "idx", F.col("c.before").alias("prev_sentence"), F.col("c.after").alias("next_sentence"))


@query(f"WITH s AS ({sents('abstract_text')}) SELECT doc_id, idx, {', '.join(f'{sql} AS {name}' for name, sql in rules.FEATURE_SQL.items())} FROM s")
def rule_features(spark, d):
    """RUL-02: six-dimension features of every sentence."""
    return rules.features(sentence_rows(table(spark, d, "documents"), "abstract_text")).select("doc_id", "idx", *rules.FEATURE_SQL)


@query(rules.scoring_sql(sents("abstract_text")))
def rule_scoring(spark, d):
    """RUL-03..05, WIN-02: scores of every sentence for each move, suggestion, consensus and conflict."""
    return rules.score(labelled_rows(table(spark, d, "documents"), "abstract_text"), rules.RULES)


@query(rules.confidence_sql(rules.scoring_sql(sents("abstract_text"))))
def move_confidence(spark, d):
    """AGG-10: mean clamped confidence of every suggested move of a document."""
    return rules.move_confidence(rules.score(labelled_rows(table(spark, d, "documents"), "abstract_text"), rules.RULES))


@query(rules.tail_sql(rules.scoring_sql(sents("abstract_text"))))
def tail_relabel(spark, d):
    """WIN-04: the last run of result sentences that sum up becomes the conclusion."""
    s = labelled_rows(table(spark, d, "documents"), "abstract_text")
    return rules.relabel_tail(rules.score(s, rules.RULES, "sentence"))


@query(rules.stats_sql(rules.scoring_sql(sents("abstract_text")), sents("abstract_text")))
def rule_statistics(spark, d):
    """AGG-23: matched, correct and incorrect firings of every rule, net gain and Laplace reliability."""
    return rules.statistics(rules.score(labelled_rows(table(spark, d, "documents"), "abstract_text"), rules.RULES, "fired"))


@query(
    f"""SELECT doc_id, {_count('title', HAN)} + {_count('title', '[A-Za-z0-9]+')} AS label_length, regexp_extract_all(lower(coalesce(title, '')), '[a-z]+') AS words,
    len(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z][a-z0-9-]{{2,}}'))) AS n_terms,
    regexp_replace(lower(coalesce(title, '')), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g') AS title_key FROM documents"""
)
def label_tokens(spark, d):
    """STR-03, STR-13..15: label length, tokens, terms and key of every title."""
    c = F.col("title")
    return table(spark, d, "documents").select("doc_id", T.label_length(c).alias("label_length"), T.words(c).alias("words"), F.size(T.latin_terms(c)).alias("n_terms"), T.key(F.coalesce(c, F.lit(""))).alias("title_key"))


@query(
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(title, '')), '[a-z]+')) AS word FROM documents)
    SELECT word, CASE WHEN regexp_matches(word, '^.{2,}ies$') THEN regexp_replace(word, 'ies$', 'y') WHEN regexp_matches(word, '^.+(ss|x|ch|sh)es$') THEN regexp_replace(word, 'es$', '')
    WHEN regexp_matches(word, '^.{2,}[^s]s$') THEN regexp_replace(word, 's$', '') ELSE word END AS singular FROM w"""
)
def singular_words(spark, d):
    """STR-12: English singular of every word of the titles."""
    w = table(spark, d, "documents").select(F.explode(T.words(F.col("title"))).alias("word")).distinct()
    return w.select("word", T.singular(F.col("word")).alias("singular"))


@query(
    f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(title, ''), '{HAN}{{2,}}')) AS run FROM documents)
    SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, substring(run, i, 2) AS gram FROM r, unnest(range(1, length(run))) AS t(i)) GROUP BY gram"""
)
def han_bigrams(spark, d):
    """STR-13/14: Chinese bigrams of the titles with counts."""
    g = table(spark, d, "documents").select("doc_id", F.explode(T.han_ngrams(F.col("title"), 2)).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(keywords.CANDIDATES_SQL)
def keyword_candidates_regex(spark, d):
    """EXT-09: English keyword candidates: n-grams of content words, with frequency and score."""
    return keywords.candidates(table(spark, d, "documents"), "abstract_text")


@query(keywords.CLEAN_SQL)
def keyword_clean(spark, d):
    """FLT-05, FLT-06, SET-02: keywords of the metadata with the reason why one is dropped."""
    return keywords.clean(keywords.of_metadata(table(spark, d, "documents")))


@query(keywords.ORDER_SQL)
def keyword_order(spark, d):
    """TOP-05: keywords ordered by confidence bucket, then first appearance."""
    return keywords.ordered(keywords.of_metadata(table(spark, d, "documents")))


@query(keywords.DEFLATE_SQL)
def substring_deflation(spark, d):
    """SET-07: a keyword contained in a longer one of nearly its frequency is dropped."""
    return keywords.deflate(keywords.frequencies(keywords.of_metadata(table(spark, d, "documents"))))


@query(keywords.IDF_SQL)
def idf_terms(spark, d):
    """AGG-11, MATH-06: document frequency and four IDF variants of title terms."""
    return keywords.idf(table(spark, d, "documents"), "title")


@query(keywords.CLUSTER_SQL)
def cluster_terms(spark, d):
    """AGG-12/13: best six terms of every cluster (here: workspace) by frequency times IDF."""
    return keywords.cluster_terms(table(spark, d, "documents").withColumnRenamed("workspace_id", "cluster_id"), "title")


@query(extract.MARKERS_SQL.format(sents=sents("text")))
def citation_markers(spark, d):
    """EXT-01, STR-16: sentences with citation markers and the numbers they stand for."""
    return extract.citations(sentence_rows(table(spark, d, "documents"), "text"))


@query(extract.DEFINITIONS_SQL.format(sents=sents("abstract_text")))
def definition_sentences(spark, d):
    """EXT-05: sentences that define something, certain or not, with their neighbours."""
    return extract.definitions(sentence_arrays(table(spark, d, "documents"), "abstract_text"))


@query(extract.QUESTIONS_SQL.format(sents=sents("abstract_text")))
def question_candidates(spark, d):
    """EXT-06, RES-37: the two sentences of an abstract with the best question cues."""
    return extract.questions(sentence_rows(table(spark, d, "documents"), "abstract_text"))


@query(extract.LEXICON_SQL)
def entity_lexicon_scan(spark, d):
    """JOIN-13: first occurrences of lexicon terms that no longer term covers."""
    return extract.scan_lexicon(table(spark, d, "documents"), "abstract_text", extract.LEXICON)


@query(extract.ENTITIES_SQL)
def entity_counts(spark, d):
    """RES-03..05: entities of a document deduplicated by name, counts by type and the dominant type."""
    return extract.entity_summary(extract.scan_lexicon(table(spark, d, "documents"), "abstract_text", extract.LEXICON))


@query(extract.CONCEPT_SQL.format(sents=sents("abstract_text")))
def concept_grouping(spark, d):
    """RES-16/17: definitions grouped by concept, with the mean confidence."""
    return extract.group_concepts(extract.definitions(sentence_arrays(table(spark, d, "documents"), "abstract_text")))


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', '', 'g') AS plain,
    regexp_replace(regexp_replace(text, 'https?://[A-Za-z0-9./_%?=&#-]+', '', 'g'), '[A-Za-z0-9._%-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '', 'g') AS without_links FROM documents WHERE text IS NOT NULL"""
)
def markup_strip(spark, d):
    """SRC-15, FLT-10: texts without markup, and without addresses."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.strip_markup(F.col("text")).alias("plain"), T.strip_artifacts(F.col("text")).alias("without_links"))


@query(
    r"""SELECT doc_id, length(text) AS n, length(regexp_split_to_array(text, '(?im)^\s*(?:references|bibliography|参考文献|literatur|références|referencias|referências)\s*[:：]?\s*$')[1]) AS n_body FROM documents WHERE text IS NOT NULL"""
)
def reference_truncation(spark, d):
    """FLT-09: length of every text and of its part before the references."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.char_length("text").alias("n"), F.char_length(T.before_references(F.col("text"))).alias("n_body"))


@query(r"SELECT doc_id, TRY_CAST(nullif(regexp_extract(metadata_json, '((?:19|20)\d{2})', 1), '') AS INTEGER) AS year, coalesce(TRY_CAST(nullif(regexp_extract(metadata_json, '\x{22}published_at\x{22}: \x{22}(\d{4})', 1), '') AS INTEGER), -1) AS published FROM documents")
def publication_year(spark, d):
    """DATE-01/02: years found in the metadata, also where its JSON is cut off."""
    m = F.col("metadata_json")
    return table(spark, d, "documents").select("doc_id", T.year(m).alias("year"), F.coalesce(F.regexp_extract(m, r'"published_at": "(\d{4})', 1).try_cast("int"), F.lit(-1)).alias("published"))


@query("SELECT doc_id, substring(text, greatest(instr(text, 'sea ice') - 40, 1), instr(text, 'sea ice') - greatest(instr(text, 'sea ice') - 40, 1) + 7 + 40) AS snippet FROM documents WHERE instr(text, 'sea ice') > 0")
def cue_snippet(spark, d):
    """PRJ-07, STR-23: window around the first occurrence of a term."""
    return table(spark, d, "documents").select("doc_id", T.context(F.col("text"), F.lit("sea ice"), 40).alias("snippet")).where("snippet IS NOT NULL")


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(content_text, chr(10))) AS line FROM documents WHERE content_text IS NOT NULL)
    SELECT doc_id, count(*) AS lines, sum(CASE WHEN """
    + f"{_count('line', '[0-9]')} / greatest(length(line), 1) > 0.4 OR {_count('line', '[|' + chr(92) + 't]')} >= 2 OR {_count('line', '[=+*/^<>]')} >= 3"
    + " THEN 1 ELSE 0 END)::BIGINT AS table_lines FROM l GROUP BY doc_id"
)
def table_lines(spark, d):
    """FLT-07/08: lines of every content that are table rows or formulas."""
    lines = table(spark, d, "documents").where("content_text IS NOT NULL").select("doc_id", F.explode(F.split("content_text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(T.table_line(F.col("line")).cast("long")).alias("table_lines"))
