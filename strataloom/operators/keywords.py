"""Keyword candidates, cleaning, ordering, deflation, IDF and cluster terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as T

# Words that no keyword begins or ends with, and generic words.
STOP = "the of and in to is are was were for with that this by on we our from as at be an a no it its".split()
GENERIC = "study research method result analysis paper data".split()
_STOP, _GENERIC = (", ".join(f"'{w}'" for w in x) for x in (STOP, GENERIC))
_SCHEMA = "struct<keywords:array<string>>"


def candidates(docs: DataFrame, col: str, least: int = 2, longest: int = 3) -> DataFrame:
    """N-grams (1 to ``longest`` words) that begin and end with content words, found at least ``least``
    times in all documents; score grows with frequency and length."""
    w = docs.select("doc_id", T.words(F.col(col), "[a-z][a-z-]+").alias("w")).where(F.size("w") > 0)
    of_size = lambda n: F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.when(i + n - 1 <= F.size("w"), F.slice("w", i, F.lit(n))))
    grams = F.flatten(F.array(*map(of_size, range(1, longest + 1))))
    good = lambda g: g.isNotNull() & ~F.try_element_at(g, F.lit(1)).isin(*STOP) & ~F.try_element_at(g, F.lit(-1)).isin(*STOP)
    rows = w.select("doc_id", F.explode(F.filter(grams, good)).alias("g")).select("doc_id", F.array_join("g", " ").alias("phrase"), F.size("g").alias("words"))
    out = rows.groupBy("phrase", "words").agg(F.count("*").alias("freq"), F.countDistinct("doc_id").alias("docs")).where(F.col("freq") >= least)
    return out.select("phrase", "freq", "docs", F.round(F.log1p("freq") * (1 + 0.25 * (F.col("words") - 1)), 6).alias("score"))


CANDIDATES_SQL = f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(abstract_text, '')), '[a-z][a-z-]+') AS w FROM documents),
g AS (SELECT doc_id, n, w[i:i + n - 1] AS g FROM w, unnest(range(1, 4)) AS a(n), unnest(range(1, len(w) + 1)) AS b(i) WHERE i + n - 1 <= len(w)),
p AS (SELECT array_to_string(g, ' ') AS phrase, n, count(*) AS freq, count(DISTINCT doc_id) AS docs FROM g WHERE g[1] NOT IN ({_STOP}) AND g[-1] NOT IN ({_STOP}) GROUP BY ALL)
SELECT phrase, freq, docs, round(ln(1 + freq) * (1 + 0.25 * (n - 1)), 6) AS score FROM p WHERE freq >= 2"""


def of_metadata(docs: DataFrame) -> DataFrame:
    """Keywords of the metadata, one row each with its place; metadata that is cut off gives none."""
    k = docs.select("doc_id", "title", "abstract_text", F.from_json("metadata_json", _SCHEMA).getField("keywords").alias("k"))
    return k.select("doc_id", "title", "abstract_text", F.posexplode("k").alias("pos", "keyword"))


_META_SQL = "SELECT doc_id, title, abstract_text, i - 1 AS pos, k[i] AS keyword FROM (SELECT *, from_json(CASE WHEN json_valid(metadata_json) THEN metadata_json END, '{\"keywords\": [\"VARCHAR\"]}').keywords AS k FROM documents) m, unnest(range(1, len(k) + 1)) AS r(i)"


def clean(kw: DataFrame) -> DataFrame:
    """Reason why a keyword is dropped, null where it is kept; the first reason that applies holds."""
    k = F.lower(F.trim("keyword"))
    source = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract_text", F.lit(""))))
    first = F.row_number().over(Window.partitionBy("doc_id", k).orderBy("pos"))
    reason = (
        F.when(F.char_length(k) < 2, "too_short")
        .when(F.char_length(k) > 60, "too_long")
        .when(k.isin(*STOP), "function_word")
        .when(k.isin(*GENERIC), "generic")
        .when(k.rlike(r"^[0-9 .,%-]+$"), "junk")
        .when(first > 1, "duplicate")
        .when(~F.contains(source, k), "not_in_text")
    )
    return kw.select("doc_id", "pos", "keyword", reason.alias("drop_reason"))


CLEAN_SQL = f"""WITH m AS ({_META_SQL}), t AS (SELECT *, lower(trim(keyword)) AS k, lower(coalesce(title, '') || ' ' || coalesce(abstract_text, '')) AS src FROM m)
SELECT doc_id, pos, keyword, CASE WHEN length(k) < 2 THEN 'too_short' WHEN length(k) > 60 THEN 'too_long' WHEN k IN ({_STOP}) THEN 'function_word' WHEN k IN ({_GENERIC}) THEN 'generic'
WHEN regexp_matches(k, '^[0-9 .,%-]+$') THEN 'junk' WHEN row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) > 1 THEN 'duplicate' WHEN NOT contains(src, k) THEN 'not_in_text' END AS drop_reason FROM t"""


def ordered(kw: DataFrame) -> DataFrame:
    """Rank by confidence bucket (0.05 wide, here from the place), then by first appearance, then by place."""
    weight = 0.95 - 0.03 * F.col("pos")
    at = F.expr("locate(lower(keyword), lower(coalesce(abstract_text, '')))")
    w = Window.partitionBy("doc_id").orderBy(F.floor(F.round(weight * 20, 6)).desc(), F.when(at == 0, 1_000_000).otherwise(at), "pos")
    return kw.select("doc_id", "pos", "keyword", F.row_number().over(w).alias("rank"))


ORDER_SQL = f"""WITH m AS ({_META_SQL}) SELECT doc_id, pos, keyword, row_number() OVER (PARTITION BY doc_id ORDER BY floor(round((0.95 - 0.03 * pos) * 20, 6)) DESC,
CASE WHEN instr(lower(coalesce(abstract_text, '')), lower(keyword)) = 0 THEN 1000000 ELSE instr(lower(coalesce(abstract_text, '')), lower(keyword)) END, pos) AS rank FROM m"""


def frequencies(kw: DataFrame) -> DataFrame:
    return kw.groupBy(F.lower("keyword").alias("term")).agg(F.count("*").alias("freq"))


def deflate(terms: DataFrame, ratio: float = 1.5) -> DataFrame:
    """Terms without those contained in a longer one while being at most ``ratio`` times as frequent.

    Containment is turned into an equi-join: every longer term gives its word sub-sequences, so no
    pair of unrelated terms is ever formed. Terms without blanks give their character substrings.
    """
    w = F.split("term", " ")
    subs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(F.lit(1), F.size(w) - i + 1), lambda n: F.array_join(F.slice(w, i, n), " "))))
    n = F.char_length("term")
    chars = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring("term", i, k))))
    parts = terms.select(F.col("term").alias("longer"), F.col("freq").alias("lfreq"), F.explode(F.array_distinct(F.when(F.size(w) > 1, subs).otherwise(chars))).alias("term")).where("term <> longer")
    covered = terms.join(parts, "term").where(F.col("freq") <= ratio * F.col("lfreq")).select("term").distinct()
    return terms.join(covered, "term", "left_anti")


DEFLATE_SQL = f"""WITH m AS ({_META_SQL}), t AS (SELECT lower(keyword) AS term, count(*) AS freq FROM m GROUP BY 1)
SELECT term, freq FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.term <> a.term AND a.freq <= 1.5 * b.freq AND
(CASE WHEN contains(b.term, ' ') THEN contains(' ' || b.term || ' ', ' ' || a.term || ' ') ELSE contains(b.term, a.term) END))"""


def idf(docs: DataFrame, col: str) -> DataFrame:
    """Document frequency of terms and four variants of IDF."""
    total = docs.agg(F.count("*").alias("docs"))
    rows = docs.select("doc_id", F.explode(T.latin_terms(F.col(col))).alias("term"))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    d = F.col("df")
    return df.join(F.broadcast(total)).select("term", "df", F.round(F.log((1 + F.col("docs")) / (1 + d)) + 1, 6).alias("idf_smooth"), F.round(F.log((F.col("docs") + 1) / (d + 0.5)) + 1, 6).alias("idf_phrase"), F.round(F.log(F.col("docs") / d), 6).alias("idf_plain"), F.round(F.log(1 + F.col("docs") / d), 6).alias("idf_token"))


IDF_SQL = """WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z][a-z0-9-]{2,}'))) AS term FROM documents), d AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(*)::DOUBLE AS n FROM documents)
SELECT term, df, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf_smooth, round(ln((n + 1) / (df + 0.5)) + 1, 6) AS idf_phrase, round(ln(n / df), 6) AS idf_plain, round(ln(1 + n / df), 6) AS idf_token FROM d, n"""


def cluster_terms(docs: DataFrame, col: str, cluster: str = "cluster_id", limit: int = 6) -> DataFrame:
    """Best terms of every cluster by count times IDF over clusters; ties by rarer, longer, then alphabetical."""
    rows = docs.select(cluster, F.explode(T.latin_terms(F.col(col))).alias("term")).where(~F.col("term").isin(*STOP))
    counts = rows.groupBy(cluster, "term").agg(F.count("*").alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    total = counts.select(F.countDistinct(cluster).alias("k"))
    scored = counts.join(df, "term").join(F.broadcast(total)).withColumn("score", F.round(F.col("n") * (F.log((F.col("k") + 1) / (F.col("df") + 1)) + 1), 6))  # total is one row
    w = Window.partitionBy(cluster).orderBy(F.desc("score"), "df", F.desc(F.char_length("term")), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(F.col(cluster).alias("cluster_id"), "rank", "term", "score")


CLUSTER_SQL = f"""WITH t AS (SELECT workspace_id AS cluster_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z][a-z0-9-]{{2,}}'))) AS term FROM documents), c AS (SELECT cluster_id, term, count(*) AS n FROM t WHERE term NOT IN ({_STOP}) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM c GROUP BY term), k AS (SELECT count(DISTINCT cluster_id) AS k FROM c), s AS (SELECT cluster_id, term, df, round(n * (ln((k + 1) / (df + 1)::DOUBLE) + 1), 6) AS score FROM c JOIN d USING (term), k)
SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, df, length(term) DESC, term) AS rank, term, score FROM s QUALIFY rank <= 6"""
