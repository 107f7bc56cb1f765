"""Queries whose operators scan text or groups in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions import sequential as S
from strataloom.functions import text as T
from strataloom.operators import grouping as G
from strataloom.operators import keywords as K
from strataloom.plans.registry import registry
from strataloom.session import spread, table

QUERIES: dict = {}
SQL: dict = {}
query = registry(QUERIES, SQL)


@query()
def split_by_language(spark, d):
    """STR-04, STR-05, SET-01: Chinese and English splitters on the abstracts of their language."""
    docs = spread(table(spark, d, "documents").where("abstract_text IS NOT NULL").select("doc_id", "abstract_text", T.detect_by_share(F.col("abstract_text")).alias("language")))
    zh = docs.where("language = 'zh'").select("doc_id", "language", F.posexplode(S.udf(S.split_chinese, "array<string>", F.col("abstract_text"))).alias("idx", "sentence"))
    en = docs.where("language = 'en'").select("doc_id", "language", F.posexplode(S.udf(S.split_english, "array<string>", F.col("abstract_text"))).alias("idx", "sentence"))
    return zh.unionByName(en)


_CUT = "regexp_replace(regexp_replace(abstract_text, '([,;，；])\\s*', '\\1' || chr(1), 'g'), '\\s+(by (?:employing|using|means of)\\b)', chr(1) || '\\1', 'g')"


@query(f"WITH c AS (SELECT doc_id, list_filter(list_transform(string_split({_CUT}, chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS c FROM documents WHERE abstract_text IS NOT NULL) SELECT doc_id, i - 1 AS idx, c[i] AS clause FROM c, unnest(range(1, len(c) + 1)) AS r(i)")
def clause_split(spark, d):
    """STR-07: clauses of the abstracts."""
    docs = spread(table(spark, d, "documents").where("abstract_text IS NOT NULL").select("doc_id", "abstract_text"))
    return docs.select("doc_id", F.posexplode(T.clauses(F.col("abstract_text"))).alias("idx", "clause"))


@query()
def paper_sections(spark, d):
    """SRC-09: sections of the contents."""
    docs = spread(table(spark, d, "documents").where("content_text IS NOT NULL").select("doc_id", "content_text"))
    s = S.udf(S.sections, "array<struct<heading:string,level:int,body:string>>", F.col("content_text"))
    return docs.select("doc_id", F.posexplode(s).alias("idx", "s")).select("doc_id", "idx", "s.heading", "s.level", "s.body")


_PARAGRAPHS = "p AS (SELECT doc_id, i, ps[i] AS p FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(content_text, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^[\\s\\x{a0}\\x{3000}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x0b\\x{85}]+|[\\s\\x{a0}\\x{3000}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x0b\\x{85}]+$', '', 'g')), lambda x: x <> '') AS ps FROM documents WHERE content_text IS NOT NULL), unnest(range(1, len(ps) + 1)) AS r(i))"


@query(
    f"WITH RECURSIVE {_PARAGRAPHS}, r(doc_id, i, c, n) AS (SELECT doc_id, i, 0, length(p) FROM p WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, CASE WHEN r.n + 2 + length(p.p) <= 1200 THEN r.c ELSE r.c + 1 END, CASE WHEN r.n + 2 + length(p.p) <= 1200 THEN r.n + 2 + length(p.p) ELSE length(p.p) END FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1) "
    "SELECT r.doc_id, c AS idx, string_agg(p.p, chr(10) || chr(10) ORDER BY r.i) AS chunk FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i GROUP BY r.doc_id, c"
)
def paragraph_chunks(spark, d):
    """PRJ-04: paragraphs packed to 1200 characters."""
    docs = spread(table(spark, d, "documents").where("content_text IS NOT NULL").select("doc_id", "content_text"))
    return docs.select("doc_id", F.posexplode(S.udf(lambda t: S.chunk_paragraphs(t, 1200), "array<string>", F.col("content_text"))).alias("idx", "chunk"))


@query()
def metadata_repair(spark, d):
    """JSON-02/03: metadata records with cut-off ones repaired."""
    docs = table(spark, d, "documents").where("metadata_json IS NOT NULL").select("doc_id", "metadata_json")
    return docs.select("doc_id", S.udf(S.repair_json, "string", F.col("metadata_json")).alias("repaired"))


@query()
def title_in_text(spark, d):
    """STR-10/11, FLT-12: place of the title in the text: exact, blanks ignored, or similar."""
    docs = spread(table(spark, d, "documents").where("title IS NOT NULL AND text IS NOT NULL").select("doc_id", "title", "text"))
    return docs.select("doc_id", S.udf(S.find_fuzzy, "int", F.col("title"), F.col("text")).alias("at"))


@query()
def clipped_titles(spark, d):
    """STR-22: titles clipped at a word end; short ones stay whole."""
    docs = table(spark, d, "documents").where("title IS NOT NULL").select("doc_id", "title")
    return docs.select("doc_id", S.udf(lambda t: S.clip(t, 60), "string", F.col("title")).alias("clipped"))


@query()
def keyword_groups(spark, d):
    """SET-06, SET-10, SET-13: keywords of a document grouped by complete linkage."""
    return G.term_groups(K.of_metadata(table(spark, d, "documents")).where("keyword IS NOT NULL"), "doc_id", "pos", "keyword")


@query()
def greedy_groups(spark, d):
    """SET-12: vectors of a label and id bucket merged greedily."""
    e = table(spark, d, "embeddings").withColumn("g", (F.col("label") * 1000 + F.floor(F.col("vec_id") / 500)).cast("int"))
    return G.greedy_merge(e, "g", "vec_id", "embedding", 0.3)


_PHRASES = "SELECT workspace_id AS cluster_id, lower(kw) AS term, count(*) AS freq FROM (SELECT workspace_id, unnest(from_json(CASE WHEN json_valid(metadata_json) THEN metadata_json END, '{\"keywords\": [\"VARCHAR\"]}').keywords) AS kw FROM documents) GROUP BY ALL"


def _phrases(spark, d):
    k = F.from_json("metadata_json", "struct<keywords:array<string>>").getField("keywords")
    return table(spark, d, "documents").select(F.col("workspace_id").alias("cluster_id"), F.explode(k).alias("kw")).groupBy("cluster_id", F.lower("kw").alias("term")).agg(F.count("*").alias("freq"))


@query(
    f"""WITH p AS ({_PHRASES}), f AS (SELECT term, count(DISTINCT cluster_id) AS df FROM p GROUP BY term), n AS (SELECT count(DISTINCT cluster_id) AS k FROM p),
    s AS (SELECT cluster_id, term, freq, round(ln(1 + freq) * (ln((k + 1) / (df + 0.5::DOUBLE)) + 1) * CASE WHEN contains(term, ' ') THEN 1.0::DOUBLE ELSE 0.88::DOUBLE END, 6) AS score FROM p JOIN f USING (term), n)
    SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, term) AS rank FROM s QUALIFY rank <= 12"""
)
def label_candidates(spark, d):
    """LAB-01, RES-30: extractive label candidates of every cluster (workspace)."""
    return G.extractive_candidates(_phrases(spark, d))


@query()
def cluster_labels(spark, d):
    """LAB-04, RES-40: distinct labels chosen over all clusters."""
    return G.choose_labels(G.extractive_candidates(_phrases(spark, d)))
