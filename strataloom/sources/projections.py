"""Result documents of the tools as typed rows: one declarative table instead of a writer for each tool.

A result is a JSON object. Each section names the tools it belongs to, the lists it is read from (the
first that is there counts) and its columns, each with the fields it may come from. Everything is a
built-in JSON function; results that are null, cut off or no object give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest depth of a review's tree: questions, methods, progress.
REVIEW_LEVELS = 3
MOVES, CLASSES, KEYWORDS = ("zh-abstract-move", "en-abstract-move", "fund-move"), ("zh-classify", "en-classify", "domain-classify"), ("zh-keyword", "en-keyword")
CITATIONS, ENTITIES = ("citation-sentiment", "citation-intent"), ("general-ner", "research-ner", "domain-ner")
# Sections by table: (tools, lists, columns: fields in order of preference). A star marks numbers.
SECTIONS: dict[str, tuple[tuple[str, ...], tuple[str, ...], dict[str, str]]] = {
    "move_segments": (MOVES, ("moves",), {"move_code": "move_code", "move_name": "move_name label", "label": "label", "sentence_index": "sentence_index", "start_offset": "*start", "end_offset": "*end", "text_value": "text content", "confidence": "*confidence"}),
    "classification_candidates": (CLASSES, ("classifications", "candidates"), {"role_name": "role", "class_code": "clc_code code", "class_name": "name label category_name", "path_json": "path classification_path", "confidence": "*confidence score", "rank_no": "*rank"}),
    "keyword_items": (KEYWORDS, ("keywords",), {"term": "term keyword", "normalized_term": "normalized_term", "score": "*score confidence weight", "rank_no": "*rank", "source_name": "source terminology_source", "mapping_json": "clc_mappings"}),
    "question_sentences": (("rq-detect",), ("research_question_sentences",), {"text_value": "text sentence", "confidence": "*confidence"}),
    "question_phrases": (("rq-detect",), ("research_question_phrases",), {"text_value": "text phrase", "confidence": "*confidence"}),
    "structured_questions": (("rq-detect",), ("structured_research_questions",), {"text_value": "question normalized_question", "confidence": "*confidence"}),
    "citation_items": (CITATIONS, ("citations",), {"citation_id": "citation_id", "sentence": "citation_sentence sentence", "label_name": "sentiment intent", "marker_json": "citation_markers citation_marker", "context_json": "context", "confidence": "*confidence"}),
    "definition_items": (("definition-detect",), ("definitions",), {"concept": "concept", "normalized_concept": "normalized_concept", "definition_text": "definition", "sentence": "sentence", "domain_name": "domain", "confidence": "*confidence"}),
    "entity_mentions": (ENTITIES, ("entities",), {"entity_id": "entity_id", "text_value": "text entity", "normalized_text": "normalized_text standard_term", "entity_type": "type entity_type", "start_offset": "*start", "end_offset": "*end", "context_text": "context", "confidence": "*confidence"}),
    "relation_triples": (("relation-extract",), ("triples",), {"subject_text": "subject", "relation_name": "relation predicate", "relation_type": "relation_type", "object_text": "object", "evidence_json": "evidence", "confidence": "*confidence"}),
    "clusters": (("deep-cluster",), ("clusters",), {"cluster_id": "cluster_id", "size_count": "*size", "representative_terms": "representative_terms", "centroid_document_id": "centroid_document_id"}),
    "cluster_labels": (("cluster-label",), ("labels",), {"cluster_id": "cluster_id", "label_text": "label", "confidence": "*confidence", "distinctiveness": "*distinctiveness", "alternatives": "alternatives candidate_labels"}),
    "review_sections": (("structured-review",), ("structured_report.sections", "sections"), {"section_id": "section_id", "title": "title", "content": "content"}),
    "review_evidence": (("structured-review",), ("evidence_index", "evidence"), {"evidence_id": "evidence_id", "document_id": "document_id", "title": "title", "page_no": "*page", "quote_text": "quote evidence_excerpt"}),
}


def _field(item: Column, names: str) -> Column:
    number = names.startswith("*")
    values = [F.nullif(F.get_json_object(item, f"$.{n}"), F.lit("")) for n in names.lstrip("*").split()]
    value = F.coalesce(*values) if len(values) > 1 else values[0]
    return value.try_cast("double") if number else value


def _items(raw: Column, path: str) -> Column:
    return F.from_json(F.get_json_object(raw, f"$.{path}"), "array<string>")


def section(results: DataFrame, name: str) -> DataFrame:
    """SNK-06: rows of one section: (record_id, place, the section's columns). ``results``: (record_id,
    tool_id, result). Classifications come before other candidates; other lists stand for each other."""
    tools, lists, columns = SECTIONS[name]
    own = results.where(F.col("tool_id").isin(*tools))
    empty = F.array().cast("array<string>")
    found = [F.coalesce(_items(F.col("result"), p), empty) for p in lists]
    items = F.concat(*found) if name == "classification_candidates" else found[0]
    if name != "classification_candidates":
        for f in found[1:]:
            items = F.when(F.size(items) > 0, items).otherwise(f)
    rows = own.select("record_id", F.posexplode(items).alias("place", "item")).where(F.startswith("item", F.lit("{")))
    return rows.select("record_id", "place", *(_field(F.col("item"), names).alias(c) for c, names in columns.items()))


def memberships(results: DataFrame) -> DataFrame:
    """SNK-06: members of clusters: (record_id, cluster_id, place, document_id, title, similarity)."""
    own = results.where("tool_id = 'deep-cluster'").select("record_id", F.explode(_items(F.col("result"), "clusters")).alias("c"))
    rows = own.select("record_id", F.get_json_object("c", "$.cluster_id").alias("cluster_id"), F.posexplode(_items(F.col("c"), "members")).alias("place", "item"))
    return rows.select("record_id", "cluster_id", "place", *(_field(F.col("item"), n).alias(c) for c, n in {"document_id": "document_id", "title": "title", "similarity": "*similarity"}.items()))


def review_nodes(results: DataFrame) -> DataFrame:
    """SNK-06: nodes of review trees with their parent and level, level by level."""
    level = results.where("tool_id = 'structured-review'").select("record_id", F.lit(None).cast("string").alias("parent"), F.posexplode(_items(F.col("result"), "tree")).alias("place", "item"))
    out = None
    for n, kind in enumerate(("research_question", "method", "progress"), 1):
        node = F.coalesce(_field(F.col("item"), "node_id question_id rq_id method_id"), F.concat(F.lit(f"node_{n}_"), F.col("place") + 1))
        content = _field(F.col("item"), "progress content summary question_summary")
        rows = level.where(F.startswith("item", F.lit("{"))).withColumn("node_id", node)
        part = rows.select("record_id", "node_id", F.col("parent").alias("parent_node_id"), F.lit(n).alias("level_no"), F.lit(kind).alias("node_type"), _field(F.col("item"), "research_question method title").alias("title"), content.alias("content"))
        out = part if out is None else out.unionByName(part)
        if n < REVIEW_LEVELS:
            lists = [F.coalesce(_items(F.col("item"), p), F.array().cast("array<string>")) for p in ("children", "methods", "progress")]
            children = F.when(F.size(lists[0]) > 0, lists[0]).when(F.size(lists[1]) > 0, lists[1]).otherwise(lists[2])
            level = rows.select("record_id", F.col("node_id").alias("parent"), F.posexplode(children).alias("place", "item"))
    return out


def write_all(results: DataFrame, folder: str) -> None:
    """All sections, each into its folder, appended. The results are read once for each section, with only
    the tools that have it."""
    for name in SECTIONS:
        section(results, name).write.mode("append").parquet(f"{folder}/{name}")
    memberships(results).write.mode("append").parquet(f"{folder}/cluster_memberships")
    review_nodes(results).write.mode("append").parquet(f"{folder}/review_nodes")
