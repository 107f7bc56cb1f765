"""Queries on stored records: collections, tasks, files, lineage, exports, taxonomy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.operators import relational as R
from strataloom.operators import taxonomy
from strataloom.plans.registry import registry
from strataloom.session import table
from strataloom.sources import sinks

QUERIES: dict = {}
SQL: dict = {}
query = registry(QUERIES, SQL)


@query("SELECT c.id, c.name, c.version, coalesce(m.n, 0) AS members FROM document_collections c LEFT JOIN (SELECT collection_id, count(*) AS n FROM (SELECT DISTINCT * FROM collection_documents) GROUP BY 1) m ON c.id = m.collection_id")
def collections_count(spark, d):
    """JOIN-02, AGG-01: collections with the numbers of their members."""
    return R.member_counts(table(spark, d, "document_collections"), table(spark, d, "collection_documents"), "id", "collection_id").select("id", "name", "version", "members")


@query("SELECT collection_id, document_id, doc_id, title, row_number() OVER (PARTITION BY collection_id ORDER BY order_no, document_id) AS place FROM (SELECT DISTINCT * FROM collection_documents) m JOIN (SELECT id, doc_id, title FROM documents) x ON m.document_id = x.id")
def collection_members(spark, d):
    """JOIN-04: existing documents of every collection, in order."""
    return R.ordered_members(table(spark, d, "collection_documents"), table(spark, d, "documents"))


@query("SELECT c.workspace_id, c.id, c.version, count(x.doc_id) AS documents, sum(x.n_chars)::BIGINT AS chars FROM document_collections c LEFT JOIN (SELECT DISTINCT * FROM collection_documents) m ON m.collection_id = c.id LEFT JOIN documents x ON x.id = m.document_id AND x.workspace_id = c.workspace_id GROUP BY ALL")
def collection_scope(spark, d):
    """JOIN-03: collection joined to members, and to documents on id and workspace."""
    c, m = table(spark, d, "document_collections").select("workspace_id", "id", "version"), table(spark, d, "collection_documents").distinct()
    x = table(spark, d, "documents").select(F.col("id").alias("document_id"), F.col("workspace_id").alias("ws"), "doc_id", "n_chars")
    j = c.join(m, c.id == m.collection_id, "left").join(x, (m.document_id == x.document_id) & (c.workspace_id == x.ws), "left")
    return j.groupBy("workspace_id", "id", "version").agg(F.count("doc_id").alias("documents"), F.sum("n_chars").alias("chars"))


_LAST = "SELECT * FROM task_items QUALIFY row_number() OVER (PARTITION BY task_id, input_index ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, id DESC) = 1"


@query(f"SELECT task_id, input_index, id, status, updated_at FROM ({_LAST})")
def latest_per_key(spark, d):
    """AGG-03, STM-02: the last state of every task item."""
    return R.latest_per_key(table(spark, d, "task_items"), ["task_id", "input_index"], ["updated_at", "created_at", "id"]).select("task_id", "input_index", "id", "status", "updated_at")


@query(
    f"""WITH l AS (SELECT *, upper(trim(status)) AS s FROM ({_LAST})), g AS (SELECT task_id, count(*) AS total, count(*) FILTER (s = 'SUCCEEDED') AS success, count(*) FILTER (s = 'FAILED') AS failed,
    arg_min(error_message, input_index) FILTER (error_message IS NOT NULL) AS first_error FROM l GROUP BY task_id)
    SELECT *, CASE WHEN failed = 0 THEN 'SUCCEEDED' WHEN success = 0 THEN 'FAILED' ELSE 'PARTIAL_FAILED' END AS status FROM g"""
)
def task_rollup(spark, d):
    """AGG-02: totals, first error and status of every task."""
    return R.task_rollup(table(spark, d, "task_items"))


@query("SELECT tool_id, upper(trim(status)) AS state, count(*) AS tasks, round(avg(progress), 6) AS progress, sum(total)::BIGINT AS total FROM analysis_tasks GROUP BY ALL")
def task_status_counts(spark, d):
    """AGG-30: tasks by tool and canonical status."""
    t = table(spark, d, "analysis_tasks").withColumn("state", R.canonical_status(F.col("status")))
    return t.groupBy("tool_id", "state").agg(F.count("*").alias("tasks"), F.round(F.avg("progress"), 6).alias("progress"), F.sum("total").alias("total"))


@query("SELECT id, tool_id, upper(trim(status)) AS state, created_at FROM analysis_tasks WHERE archived_at IS NULL ORDER BY created_at DESC, id LIMIT 50")
def task_page(spark, d):
    """SRC-11, TOP-04: a page of the newest tasks that are not archived."""
    t = table(spark, d, "analysis_tasks").where("archived_at IS NULL")
    return R.page(t, 50, [F.desc("created_at"), F.asc("id")]).select("id", "tool_id", R.canonical_status(F.col("status")).alias("state"), "created_at")


@query("SELECT id, CASE WHEN upper(trim(status)) IN ('RUNNING', 'QUEUED', 'DRAFT') AND archived_at IS NULL THEN 'CANCELLED' ELSE upper(trim(status)) END AS new_status, upper(trim(status)) IN ('RUNNING', 'QUEUED', 'DRAFT') AND archived_at IS NULL AS changed FROM analysis_tasks")
def guarded_transition(spark, d):
    """SNK-09: cancellation where the state allows it."""
    return R.guarded(table(spark, d, "analysis_tasks"), "CANCELLED", ["RUNNING", "QUEUED", "DRAFT"]).select("id", "new_status", "changed")


@query("SELECT workspace_id, id, tool_id, created_at FROM analysis_tasks QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, id DESC) <= 5")
def newest_per_workspace(spark, d):
    """TOP-06: the newest five tasks of every workspace."""
    return R.newest(table(spark, d, "analysis_tasks"), "workspace_id", [F.desc("created_at"), F.desc("id")], 5).select("workspace_id", "id", "tool_id", "created_at")


@query("SELECT id, task_id, created_at FROM task_items WHERE updated_at IS NOT NULL AND updated_at < created_at + INTERVAL 15 SECOND")
def ttl_filter(spark, d):
    """DATE-04: entries that were updated within a time to live."""
    return table(spark, d, "task_items").where("updated_at < created_at + INTERVAL 15 SECONDS").select("id", "task_id", "created_at")


@query("SELECT sha256(concat(coalesce(title, ''), chr(10), coalesce(abstract_text, ''), chr(10), coalesce(content_text, ''))) AS key, min(doc_id) AS kept_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedupe(spark, d):
    """SET-04, JOIN-23: documents by the hash of their content."""
    return R.dedupe_by_content(table(spark, d, "documents"))


@query("SELECT doc_id, length(coalesce(title, '')) AS title_length, count(*) OVER (PARTITION BY title) AS same_title FROM documents WHERE title IS NOT NULL")
def identical_inputs(spark, d):
    """SET-03: values computed once for every distinct title."""
    docs = table(spark, d, "documents").where("title IS NOT NULL").select("doc_id", "title")
    n = docs.groupBy("title").agg(F.count("*").alias("same_title")).withColumn("title_length", F.char_length("title"))
    return docs.join(n, "title").select("doc_id", "title_length", "same_title")


@query("WITH e AS (SELECT DISTINCT collection_id, document_id FROM collection_documents) SELECT collection_id AS node, 'downstream' AS direction, document_id AS neighbour FROM e UNION ALL SELECT document_id, 'upstream', collection_id FROM e")
def lineage_one_hop(spark, d):
    """JOIN-01, SET-19: neighbours one hop up and down."""
    return R.lineage(table(spark, d, "collection_documents"), "collection_id", "document_id")


@query("SELECT f.id, f.original_name, f.size_bytes FROM files f WHERE f.sha256 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents x WHERE x.file_id = f.id AND x.updated_at IS NOT NULL)")
def files_without_document(spark, d):
    """JOIN-23: anti-join of files and the documents that were made from them and completed."""
    docs = table(spark, d, "documents").where("updated_at IS NOT NULL").select(F.col("file_id").alias("id"))
    return R.new_rows(table(spark, d, "files").where("sha256 IS NOT NULL"), docs, "id").select("id", "original_name", "size_bytes")


@query("SELECT sha256, count(DISTINCT id) AS ids, min(id) AS first_id, max(greatest(size_bytes, 0)) AS size FROM files WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(DISTINCT id) > 1")
def files_same_hash(spark, d):
    """SET-04: files stored under several ids."""
    f = table(spark, d, "files").where("sha256 IS NOT NULL")
    return f.groupBy("sha256").agg(F.countDistinct("id").alias("ids"), F.min("id").alias("first_id"), F.max(F.greatest("size_bytes", F.lit(0))).alias("size")).where("ids > 1")


@query("SELECT f.id, CASE lower(regexp_extract(original_name, '[.]([A-Za-z]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' WHEN 'csv' THEN 'csv' WHEN 'json' THEN 'json' WHEN 'xlsx' THEN 'xlsx' ELSE 'unknown' END AS reader, size_bytes > 0 AS readable FROM files f")
def reader_dispatch(spark, d):
    """SRC-01, SRC-07: reader of every file by its suffix, and whether it can hold anything."""
    return table(spark, d, "files").select("id", sinks.reader_of(F.col("original_name")).alias("reader"), (F.col("size_bytes") > 0).alias("readable"))


@query("SELECT x.id, coalesce(f.media_type, x.source) AS source, coalesce(f.created_at, x.created_at) AS created_at FROM documents x LEFT JOIN (SELECT id, min(media_type) AS media_type, min(created_at) AS created_at FROM files GROUP BY id) f ON x.file_id = f.id")
def metadata_override(spark, d):
    """JOIN-07: values of the file win over those of the document where they are there."""
    f = table(spark, d, "files").groupBy("id").agg(F.min("media_type").alias("source"), F.min("created_at").alias("created_at")).withColumnRenamed("id", "file_id")
    x = table(spark, d, "documents").select("id", "file_id", "source", "created_at")
    o = x.select("id", "file_id").join(f, "file_id").drop("file_id")
    return R.overridden(x, o, "id", ["source", "created_at"])


@query("SELECT id, CASE WHEN tool_id LIKE 'zh-%' THEN 'v3.0' ELSE model_version END AS model_version FROM analysis_tasks")
def replace_confirmed(spark, d):
    """SNK-10: confirmed rows replace the stored ones."""
    t = table(spark, d, "analysis_tasks").select("id", "tool_id", "model_version")
    return R.replaced(t, t.where("tool_id LIKE 'zh-%'").withColumn("model_version", F.lit("v3.0")), "id").select("id", "model_version")


@query("SELECT workspace_id, id AS task_id, json_extract_string(parameters_json, '$.top_k')::BIGINT AS top_k, json_extract_string(request_payload, '$.n')::BIGINT AS n FROM analysis_tasks")
def payload_fields(spark, d):
    """JSON-01, PRJ-09: fields of stored JSON."""
    return table(spark, d, "analysis_tasks").select("workspace_id", F.col("id").alias("task_id"), F.get_json_object("parameters_json", "$.top_k").cast("long").alias("top_k"), F.get_json_object("request_payload", "$.n").cast("long").alias("n"))


@query("SELECT id, list_filter(['source_document_id', 'keywords', 'published_at', 'year'], lambda k: NOT list_contains(json_keys(metadata_json), k)) AS missing FROM documents WHERE json_valid(metadata_json)")
def required_fields(spark, d):
    """PRJ-11: required fields that a metadata record lacks."""
    docs = table(spark, d, "documents").where(F.from_json("metadata_json", "struct<keywords:array<string>>").getField("keywords").isNotNull())
    keys = F.json_object_keys("metadata_json")
    return docs.select("id", F.array_except(F.array(*map(F.lit, ("source_document_id", "keywords", "published_at", "year"))), keys).alias("missing"))


_KW = "SELECT id, i, k[i] AS keyword FROM (SELECT id, from_json(CASE WHEN json_valid(metadata_json) THEN metadata_json END, '{\"keywords\": [\"VARCHAR\"]}').keywords AS k FROM documents) m, unnest(range(1, len(k) + 1)) AS r(i)"


@query(f"SELECT id AS record_id, 'keywords' AS section, i - 1 AS place, keyword AS value FROM ({_KW}) UNION ALL SELECT id, 'source', 0, source FROM documents")
def projection_rows(spark, d):
    """SNK-02, SNK-06: list-valued sections of a record as rows, with the union of their columns."""
    docs = table(spark, d, "documents").select(F.col("id").alias("record_id"), "source", F.from_json("metadata_json", "struct<keywords:array<string>>").getField("keywords").alias("keywords"))
    return sinks.section_rows(docs, "record_id", {"keywords": F.col("keywords"), "source": F.array("source")})


@query("SELECT line FROM (SELECT unnest(['<urn:nation:' || n_nationkey || '> <urn:name> \"' || replace(n_name, '\"', '\\\"') || '\" .', '<urn:nation:' || n_nationkey || '> <urn:region> <urn:region:' || n_regionkey || '> .', '<urn:nation:' || n_nationkey || '> <urn:type> <urn:Nation> .']) AS line FROM nation)")
def ntriples_export(spark, d):
    """SNK-04: three N-Triples for every record."""
    n = table(spark, d, "nation")
    s = F.concat(F.lit("urn:nation:"), F.col("n_nationkey"))
    return sinks.ntriples(n, [(s, "urn:name", F.col("n_name"), False), (s, "urn:region", F.concat(F.lit("urn:region:"), F.col("n_regionkey")), True), (s, "urn:type", F.lit("urn:Nation"), True)])


@query("SELECT id, '## ' || name || chr(10) || chr(10) || coalesce(nullif(description, ''), '-') || chr(10) || 'version ' || version AS report FROM document_collections")
def markdown_report(spark, d):
    """SNK-05: a Markdown section for every collection."""
    return table(spark, d, "document_collections").select("id", F.format_string("## %s\n\n%s\nversion %d", "name", F.coalesce(F.nullif("description", F.lit("")), F.lit("-")), "version").alias("report"))


_TREE = "SELECT 'R' || r_regionkey AS code, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'R' || n_regionkey || 'N' || n_nationkey, 'R' || n_regionkey, n_name FROM nation UNION ALL SELECT 'R' || n_regionkey || 'N' || n_nationkey || 'S' || s_suppkey, 'R' || n_regionkey || 'N' || n_nationkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"


@query(f"WITH RECURSIVE t AS ({_TREE}), p AS (SELECT code, [code] AS path, name AS full_path FROM t WHERE parent IS NULL UNION ALL SELECT t.code, list_append(p.path, t.code), p.full_path || ' / ' || t.name FROM t JOIN p ON t.parent = p.code) SELECT code, path, full_path, len(path) AS level FROM p")
def taxonomy_paths(spark, d):
    """SET-15, SRC-12: the path of every taxonomy entry from its root."""
    return taxonomy.paths(taxonomy.tree(table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "supplier")))


@query(f"WITH t AS ({_TREE}), q AS (SELECT code || 'x' || length(code) AS asked FROM t) SELECT asked, arg_max(code, length(code)) AS resolved FROM q LEFT JOIN t ON starts_with(asked, code) GROUP BY asked")
def resolve_prefix(spark, d):
    """SET-14, RET-02: the longest existing prefix of a code."""
    t = taxonomy.tree(table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "supplier"))
    asked = t.select(F.concat("code", F.lit("x"), F.char_length("code")).alias("asked"))
    return taxonomy.resolve(asked, t, "asked")


@query(f"WITH t AS ({_TREE}), k AS (SELECT parent, count(*) AS children FROM t WHERE parent IS NOT NULL GROUP BY parent) SELECT t.code, coalesce(children, 0) AS children, (SELECT count(*) FROM t b WHERE b.parent = t.parent AND b.code <> t.code) AS siblings FROM t LEFT JOIN k ON k.parent = t.code")
def taxonomy_neighbours(spark, d):
    """RET-02/03: children and siblings of every entry."""
    return taxonomy.neighbours(taxonomy.tree(table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "supplier")))


@query("SELECT CASE WHEN avg(CASE WHEN p.code IS NULL THEN 0 ELSE 1 END) >= 0.6 THEN 'complete' ELSE 'scattered' END AS kind, count(*) AS entries FROM (" + _TREE + ") t LEFT JOIN (SELECT DISTINCT code FROM (" + _TREE + ")) p ON t.parent = p.code")
def taxonomy_kind(spark, d):
    """AGG-25: whether the entries' parents are mostly there."""
    return taxonomy.kind(taxonomy.tree(table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "supplier")))


@query("SELECT c.c_custkey, count(o.o_orderkey) AS orders, round(coalesce(sum(o.o_totalprice), 0), 2) AS total, max(o.o_orderdate) AS last_order FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey")
def customer_rollup(spark, d):
    """Left join and rollup with counts of the joined side."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("t"), F.max("o_orderdate").alias("last_order"))
    return table(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"), "last_order")


@query("SELECT l_partkey AS node, list_sort(list_distinct(list(l_orderkey))) AS supporting FROM lineitem GROUP BY l_partkey")
def supporting_nodes(spark, d):
    """RES-24: sorted distinct supporting records of every node."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.sort_array(F.collect_set("l_orderkey")).alias("supporting"))


@query("SELECT user_id, ts, event_type, value, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried, event_id FROM events")
def carry_forward(spark, d):
    """The last value before is carried forward (a building block of JOIN-15)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "events").select("user_id", "ts", "event_type", "value", F.last(F.when(F.col("event_type") == "signup", F.col("value")), ignorenulls=True).over(w).alias("carried"), "event_id")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_events(spark, d):
    """STM-03 (extension): tumbling windows over events, as a batch."""
    e = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("day"), "event_type", "n", "total")
