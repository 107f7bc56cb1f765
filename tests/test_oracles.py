"""Every core query against its SQL in DuckDB on the smallest tables, or against what must hold of its rows."""

import glob
import json
import os
import re
from collections import defaultdict

import duckdb
import pytest

from strataloom.operators import grouping
from strataloom.plans import catalog
from strataloom.session import table

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def flat(text):
    return re.sub(r"\s+", "", text)


def by_doc(rows, order, value):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r[order])):
        out[r.doc_id].append(r[value])
    return out


def pieces_rebuild(column, order, value):
    """The pieces of a text, blanks aside, are the text."""

    def check(rows, docs, vectors):
        got = by_doc(rows, order, value)
        want = {i: flat(x[column]) for i, x in docs.items() if x[column] and flat(x[column])}
        assert {i: flat("".join(v)) for i, v in got.items()} == want

    return check


def stands_in(column, value):
    """The value, blanks aside, stands in the text."""

    def check(rows, docs, vectors):
        assert rows and all(flat(r[value]) in flat(docs[r.doc_id][column]) for r in rows)

    return check


def one_a_vector(most):
    def check(rows, docs, vectors):
        assert sorted(r.vec_id for r in rows) == vectors
        label = next(c for c in ("cluster", "merged", "label") if c in rows[0])
        assert len({r[label] for r in rows}) <= most

    return check


def clipped(rows, docs, vectors):
    assert len(rows) == sum(x.title is not None for x in docs.values())
    assert all(docs[r.doc_id].title.startswith(r.clipped) and len(r.clipped) <= 60 for r in rows)


def repaired(rows, docs, vectors):
    for r in rows:
        try:
            assert json.loads(r.repaired) == json.loads(docs[r.doc_id].metadata_json)
        except ValueError:
            assert r.repaired is None or json.loads(r.repaired) is not None


def same_terms(rows, docs, vectors):
    groups = defaultdict(list)
    for r in rows:
        groups[r.doc_id, r.same].append(r.keyword)
    assert all(grouping.same_term(a, b) for g in groups.values() for i, a in enumerate(g) for b in g[:i])


def titles_found(rows, docs, vectors):
    assert all(r.at == docs[r.doc_id].text.find(docs[r.doc_id].title) for r in rows if docs[r.doc_id].title in docs[r.doc_id].text)


def labels_differ(rows, docs, vectors):
    assert len({r.label for r in rows}) == len(rows) == len({x.workspace_id for x in docs.values()})


def questions_kept(rows, docs, vectors):
    assert len({(r.doc_id, r.idx) for r in rows}) == len(rows) and all(flat(r.question) in flat(docs[r.doc_id].abstract_text) for r in rows)


def lines_joined(rows, docs, vectors):
    assert all(len(flat(r.joined)) <= len(flat(docs[r.doc_id].text)) and len(r.joined.splitlines()) <= len(docs[r.doc_id].text.splitlines()) for r in rows)


def chunks_bounded(rows, docs, vectors):
    assert all(len(r.chunk) <= 1500 or "\n\n" not in r.chunk.strip() for r in rows)
    assert {r.doc_id for r in rows} == {i for i, x in docs.items() if x.content_text and x.content_text.strip()}


def projected(rows, docs, vectors):
    assert sorted(r.vec_id for r in rows) == vectors and all(0 <= v <= 100 for r in rows for k, v in r.asDict().items() if k != "vec_id")


def compacted(rows, docs, vectors):
    assert sorted(r.vec_id for r in rows) == vectors and all(len(r.compact) == 8 for r in rows)


def communities(rows, docs, vectors):
    nodes = {r.node for r in rows}
    assert len(nodes) == len(rows) and {r.label for r in rows} <= nodes


def spectral(rows, docs, vectors):
    assert len({r.id for r in rows}) == len(rows) and {r.cluster for r in rows} <= {0, 1, 2}


def windows_bounded(rows, docs, vectors):
    of = defaultdict(list)
    for r in rows:
        assert 0 <= r.start_pos <= r.end_pos <= len(docs[r.doc_id].text)
        of[r.doc_id].append(r.end_pos - r.start_pos)
    assert set(of) == {i for i, x in docs.items() if x.text is not None} and max(map(sum, of.values())) <= 900


def no_overlap(rows, docs, vectors):
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append((r.start_pos, r.end_pos))
    assert rows and all(x[1] <= y[0] for v in of.values() for x, y in zip(sorted(v), sorted(v)[1:]))


def parts_and_missing(rows, docs, vectors):
    assert len(rows) == len(docs)
    for r in rows:
        assert {"basis", "aims", "budget"} <= set(r.kinds) and not set(r.kinds) & set(r.missing) and len(set(r.kinds) | set(r.missing)) == 6


PROPERTIES = {
    "excerpt_windows": windows_bounded, "disjoint_spans": no_overlap, "fund_parts": parts_and_missing,
    "agglomerative_groups": one_a_vector(10**6), "bucketed_clusters": one_a_vector(20), "kmeans_clusters": one_a_vector(10), "greedy_groups": one_a_vector(10**6),
    "clipped_titles": clipped, "metadata_repair": repaired, "keyword_groups": same_terms, "title_in_text": titles_found, "cluster_labels": labels_differ, "question_merge": questions_kept,
    "joined_lines": lines_joined, "heading_chunks": chunks_bounded, "pca_projection": projected, "compact_vectors": compacted, "graph_communities": communities, "spectral_clusters": spectral,
    "split_by_language": pieces_rebuild("abstract_text", "idx", "sentence"), "paper_sections": stands_in("content_text", "body"), "reference_lists": stands_in("text", "entry"), "located_abstracts": stands_in("text", "abstract"),
}


@pytest.fixture(scope="module")
def known(spark, data):
    docs = {r.doc_id: r for r in table(spark, data, "documents").collect()}
    return docs, sorted(r.vec_id for r in table(spark, data, "embeddings").collect())


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, known, name):
    df = QUERIES[name](spark, data)
    if name not in SQL:
        PROPERTIES[name](df.collect(), *known)
        return
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute(SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["gate", "source", "docs", "sentences", "method_hits", "result_hits"]
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["evidence_centres", "phrase_centres"])
def test_centres_to_the_sign_of_zero(spark, tmp_path, name):
    """Numbers that round to zero from below, and a first sentence without a vector."""
    rows = [(i, i % 5 % 3 + 2, None if i == 3 else [(-1e-7, 1e-7, 0.0)[k % 3] if k < 6 else ((i * 31 + k * 17) % 23 - 11) / 7 for k in range(64)]) for i in range(37)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(SQL[name]).fetchall())
    got = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert list(map(repr, got)) == list(map(repr, want))
    assert any(repr(x) == "-0.0" for r in want for x in r[1])
