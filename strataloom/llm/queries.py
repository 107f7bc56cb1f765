"""Queries pN_... of the training-data operators. Each runs over the whole of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import confusables, languages, leaks, scans, sentences, split, stuffing, tokenize
from strataloom.session import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 1: sentence units of the fields in segment_sample."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "abstract_text", "content_text")
    model = sentences.fit_on(docs, "abstract_text", "content_text")
    asked = table(spark, sf_dir, "segment_sample").distinct()
    flags = asked.groupBy("doc_id").agg(*(F.max((F.col("field_name") == f).cast("int")).alias(f"has_{f}") for f in ("abstract_text", "content_text")))
    chosen = docs.join(flags, "doc_id").select("doc_id", *(F.when(F.col(f"has_{f}") == 1, F.col(f)).alias(f) for f in ("abstract_text", "content_text")))
    return sentences.sentence_units(chosen, ["abstract_text", "content_text"], model)


def p1_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 1: sentence units of every abstract and content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "abstract_text", "content_text")
    model = sentences.fit_on(docs, "abstract_text", "content_text")
    return sentences.sentence_units(spread(docs), ["abstract_text", "content_text"], model)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 2: languages of the abstracts whose label is missing or wrong or that are mixed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "language", "abstract_text")
    return languages.mislabelled(spread(docs)).select("doc_id", "seg_no", "language")


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 2: every segment of every abstract with its language and confidence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "language", "abstract_text")
    return languages.identify(spread(docs)).select("doc_id", F.inline("segments"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 3: traces of scanning in abstracts and contents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "title", "abstract_text", "content_text")
    return scans.scan_traces(spread(docs)).select("doc_id", "field_name", "damage", "reading")


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 3: every abstract and content in continuous paragraphs of correctly read words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "title", "abstract_text", "content_text")
    return scans.paragraphs(spread(docs), "abstract_text", "content_text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 4: pairs of documents whose titles or contents differ as strings but look the same."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "title", "content_text")
    return confusables.look_alike_pairs(spread(docs), ["title", "content_text"])


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 4: the class of equal-looking values of every title and content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "title", "content_text")
    return confusables.classes(spread(docs), ["title", "content_text"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 5: contents above each profile's limit, and whether one must be cut inside a run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "content_text")
    cut = split.split_items(spread(docs), table(spark, sf_dir, "chunk_profiles").collect())
    return cut.where(F.size("pieces") > 1).select("doc_id", "profile_id", split.forced_cut().cast("int").alias("forced"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 5: the pieces of every content above a profile's limit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "content_text")
    return split.pieces(spread(docs), table(spark, sf_dir, "chunk_profiles").collect())


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: ids of every document's text by byte_bpe_50k."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenize.encode_documents(spread(docs))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 7: documents that hold an unchanged passage of a benchmark item (the statement's rule,
    the last filter of ``p7_passages``)."""
    return p7_passages(spark, sf_dir).where("exact").select("doc_id", "item_id")


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 7: documents that hold a passage of a benchmark item, unchanged or edited."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks.find_leaks(spread(docs), table(spark, sf_dir, "benchmark"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 8: pages of keywords, links, tags or products."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return stuffing.stuffed_pages(spread(docs)).select("doc_id")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_units, p2_found, p2_languages, p3_found, p3_paragraphs, p4_found, p4_classes, p5_found, p5_pieces, p6_ids, p7_found, p7_passages, p8_found)}


def oracle_sql() -> dict:
    return {}
