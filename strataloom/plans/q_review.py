"""Queries on papers and structured review."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions import papers as P
from strataloom.functions import sequential as S
from strataloom.operators import extract
from strataloom.operators import review as R
from strataloom.plans.q_text import _count, sentence_arrays, sentence_rows, sents
from strataloom.plans.registry import registry
from strataloom.session import spread, table

QUERIES: dict = {}
SQL: dict = {}
query = registry(QUERIES, SQL)

_CUE = "improves|raises|reached|reduces|halves|verbessert|erhöht|提高|改善|降低"


@query(
    f"WITH s AS ({sents('abstract_text')}), t AS (SELECT doc_id, idx, {_count('lower(sentence)', _CUE)} * (1 + least({_count('sentence', chr(92) + 'd+(?:[.,]' + chr(92) + 'd+)?')}, 3)) AS score FROM s) SELECT doc_id, idx, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rank FROM t WHERE score > 0 QUALIFY rank <= 4"
)
def progress_sentences(spark, d):
    """REV-04: sentences that report progress."""
    return R.progress_sentences(sentence_rows(table(spark, d, "documents"), "abstract_text"))


@query(extract._SPANS + ", p1 AS (SELECT doc_id, entity AS method, start_pos AS idx FROM spans WHERE type = 'method') SELECT regexp_replace(lower(method), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', '', 'g') AS key, count(DISTINCT doc_id) AS docs, arg_max(method, {'a': length(method), 'b': method}) AS method FROM p1 GROUP BY 1")
def review_methods(spark, d):
    """REV-03, RES-22: methods over documents."""
    m = extract.scan_lexicon(table(spark, d, "documents"), "abstract_text", extract.LEXICON).where("type = 'method'")
    return R.cross_document_groups(m.select("doc_id", F.col("entity").alias("method"), F.col("start_pos").alias("idx")))


@query(extract._SPANS + ", e AS (SELECT doc_id, entity, string_agg(DISTINCT start_pos, ',' ORDER BY start_pos) AS ev FROM spans WHERE type = 'method' GROUP BY ALL) SELECT doc_id, list(entity || ':' || ev ORDER BY entity) AS methods FROM e GROUP BY doc_id")
def review_tree(spark, d):
    """REV-05: documents with their methods and the places of their evidence."""
    m = extract.scan_lexicon(table(spark, d, "documents"), "abstract_text", extract.LEXICON).where("type = 'method'")
    tree = R.evidence_tree(m.select("doc_id", F.col("entity").alias("method"), F.col("start_pos").alias("idx")))
    return tree.select("doc_id", F.transform("methods", lambda x: F.concat(x["method"], F.lit(":"), F.array_join(x["evidence"].cast("array<string>"), ","))).alias("methods"))


def _texts(spark, d):
    return spread(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text"))


@query()
def reference_lists(spark, d):
    """EXT-03: entries of the lists of references."""
    return _texts(spark, d).select("doc_id", F.posexplode(S.udf(P.reference_entries, "array<string>", F.col("text"))).alias("place", "entry"))


_CITED = "\\[\\d+(?:\\s*[-–,，]\\s*\\d+)*\\]"


@query(
    f"WITH m AS (SELECT doc_id, doc_id % 40 + 1 AS n, flatten(list_transform(regexp_extract_all(content_text, '{_CITED}'), lambda x: regexp_extract_all(x, '\\d+(?:\\s*[-–]\\s*\\d+)?'))) AS ps FROM documents WHERE content_text IS NOT NULL), "
    "x AS (SELECT doc_id, flatten(list_transform(ps, lambda p: range(greatest(1, regexp_extract(p, '^(\\d+)', 1)::BIGINT), least(n, regexp_extract(p, '(\\d+)$', 1)::BIGINT) + 1))) AS all_numbers FROM m) SELECT doc_id, list_filter(all_numbers, lambda v, i: list_position(all_numbers, v) = i) AS numbers FROM x WHERE len(all_numbers) > 0"
)
def validated_markers(spark, d):
    """EXT-02: cited numbers that the list of references (here one of 1 to 40 entries) holds."""
    entries = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 40 + 1).cast("int")), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("] An entry."))), "\n")
    docs = spread(table(spark, d, "documents").where("content_text IS NOT NULL")).select("doc_id", F.concat("content_text", F.lit("\n\nReferences\n"), entries).alias("text"))
    return docs.select("doc_id", S.udf(P.valid_markers, "array<int>", F.col("text")).alias("numbers")).where(F.size("numbers") > 0)


@query()
def located_abstracts(spark, d):
    """EXT-04: the abstract of every text."""
    return _texts(spark, d).select("doc_id", S.udf(P.find_abstract, "string", F.col("text")).alias("abstract"))


@query()
def joined_lines(spark, d):
    """STR-08, RES-18: texts with wrapped lines joined."""
    return _texts(spark, d).select("doc_id", S.udf(P.join_wrapped, "string", F.col("text")).alias("joined"))


@query("SELECT doc_id, t.fullkey AS path, coalesce(json_extract_string(t.atom, '$'), '') AS value FROM documents, json_tree(CASE WHEN json_valid(metadata_json) THEN metadata_json END) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')")
def metadata_paths(spark, d):
    """JSON-04: paths and values of the metadata."""
    m = table(spark, d, "documents").where("metadata_json IS NOT NULL").select("doc_id", "metadata_json")
    rows = S.udf(P.flatten_json, "array<struct<path:string,value:string>>", F.col("metadata_json"))
    return m.select("doc_id", F.inline(rows))


@query()
def heading_chunks(spark, d):
    """EXT-13: chunks of the contents that begin at headings."""
    docs = spread(table(spark, d, "documents").where("content_text IS NOT NULL").select("doc_id", "content_text"))
    return docs.select("doc_id", F.posexplode(S.udf(lambda t: P.heading_chunks(t, 1500), "array<string>", F.col("content_text"))).alias("place", "chunk"))


@query(
    extract.DEFINITIONS_SQL.format(sents=sents("abstract_text")).replace("WITH s AS", "WITH s AS", 1).replace("SELECT * FROM (SELECT doc_id, idx, sentence,", "SELECT d.doc_id, d.idx, instr(x.abstract_text, d.sentence)::INT - 1 AS at FROM (SELECT * FROM (SELECT doc_id, idx, sentence,", 1)
    + ") d JOIN documents x ON x.doc_id = d.doc_id WHERE contains(x.abstract_text, d.sentence)"
)
def located_definitions(spark, d):
    """RES-15: offsets of definitions that stand in the text as they are."""
    docs = table(spark, d, "documents").select("doc_id", "abstract_text")
    found = extract.definitions(sentence_arrays(docs, "abstract_text")).select("doc_id", "idx", "sentence").join(docs, "doc_id").where(F.contains("abstract_text", F.col("sentence")))
    return found.select("doc_id", "idx", S.udf(P.locate_definition, "int", F.col("sentence"), F.col("abstract_text")).alias("at"))


@query()
def excerpt_windows(spark, d):
    """RES-25: the beginning of every text and windows around cues, within a total size."""
    cut = S.udf(lambda t: P.excerpts(t, ["propose", "result", "提出", "结果"], 300, 60, 120, 900), "array<struct<start_pos:int,end_pos:int>>", F.col("text"))
    return _texts(spark, d).select("doc_id", F.inline(cut))


@query()
def disjoint_spans(spark, d):
    """SET-17: of the entities of a text those without overlap, by start and then the longest."""
    spans = extract.lexicon_spans(table(spark, d, "documents"), "abstract_text", extract.LEXICON)
    pairs = F.transform("spans", lambda x: F.struct(x["start_pos"].alias("a"), (x["end_pos"] + 12).alias("b")))
    kept = S.udf(lambda xs: S.longest_spans([(int(x["a"]), int(x["b"])) for x in xs]), "array<struct<start_pos:int,end_pos:int>>", pairs)
    return spans.select("doc_id", F.inline(kept))


@query()
def fund_parts(spark, d):
    """SRC-10: sections of proposals (contents under the headings of one) and the kinds that are missing."""
    t = F.concat(F.lit("1. Background\n"), F.coalesce("abstract_text", F.lit("")), F.lit("\n二、研究内容\n"), F.coalesce("title", F.lit("")), F.lit("\nBudget\n"), F.col("source"))
    found = S.udf(lambda x: [[k for k, _ in P.fund_sections(x)[0]], P.fund_sections(x)[1]], "array<array<string>>", t)
    return table(spark, d, "documents").select("doc_id", found.alias("f")).select("doc_id", F.get("f", F.lit(0)).alias("kinds"), F.get("f", F.lit(1)).alias("missing"))
