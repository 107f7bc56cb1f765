"""Result shaping on small fixtures."""

import pytest
from pyspark.sql import functions as F

from strataloom.operators import documents as D
from strataloom.operators import results as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_labelled_structure(spark):
    r = one(spark, R.labelled_structure(F.lit("Title: A b\nAbstract: c\nd\nKeywords: e; f")))
    assert (r.title, r.abstract, r.keywords) == ("A b", "c\nd", "e; f")
    assert one(spark, R.labelled_structure(F.lit("no labels"))).title is None


def test_unwrapped(spark):
    s = "struct<a:int>"
    for raw, want in (('[{"a": 1}, {"a": 2}]', [1, 2]), ('{"rows": [{"a": 3}]}', [3]), ('{"a": 4}', [4])):
        assert [x.a for x in one(spark, R.unwrapped(F.lit(raw), s))] == want


def test_small_functions(spark):
    assert one(spark, R.contains_term(F.lit("A GAN, net"), "gan")) and not one(spark, R.contains_term(F.lit("organ"), "gan"))
    assert one(spark, R.ascii_markers(F.lit("［３，４］"))) == "[3,4]"
    assert one(spark, R.application_domain(F.array(F.lit("x")))) == "x" and one(spark, R.application_domain(F.array(F.lit("x"), F.lit("y")))) == "y"
    assert one(spark, R.near_concepts(F.lit("deep neural net"), F.lit("neural network"))) and not one(spark, R.near_concepts(F.lit("abc"), F.lit("xyz")))
    assert one(spark, R.weighted_facets([F.array(F.lit(1.0)), F.array(F.lit(1.0))], [1, 3])) == [0.5, 0.75**0.5]
    assert one(spark, R.richness_weight(F.lit(900), F.lit(3))) == 0.75
    assert one(spark, D.latex_plain(F.lit(r"$\mathrm{CO}_{2}$ and $x^2$"))) == "CO2 and x2"
    assert one(spark, R.axes_valid(F.array(F.lit("ice")), F.array(F.lit("sea ice")), F.lit("the sea ice"))) and not one(spark, R.axes_valid(F.array(F.lit("ice")), F.lit(None).cast("array<string>"), F.lit("ice")))


def test_cache_key_ignores_order(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert df.select(R.cache_key("a", "b") == R.cache_key("b", "a")).first()[0]


def test_merging(spark):
    c = spark.createDataFrame([(1, "Ice-flow", 0.5, ["a"]), (1, "ice flow", 0.9, ["b", "a"])], "doc_id int, candidate string, score double, evidence array<string>")
    r = R.merged_candidates(c).collect()
    assert len(r) == 1 and r[0].candidate == "ice flow" and r[0].evidence == ["a", "b"]
    e = spark.createDataFrame([(1, "T", "Ice", 3, 0), (1, "T", "ice", 1, 100)], "doc_id int, type string, entity string, start_pos int, chunk_offset int")
    assert rows(R.merged_chunks(e).select("entity", "start_pos")) == {("Ice", 3)}
    m = spark.createDataFrame([(1, "ice flow rate"), (1, "ice"), (1, "flow"), (1, "rate x")], "doc_id int, entity string")
    assert {r.entity for r in R.composite_free(m).collect()} == {"ice", "flow", "rate x"}


def test_checks(spark):
    r = spark.createDataFrame([(1, 0, "b", "abc", "a bc d"), (1, 1, "a", "zz", "a bc d"), (1, 2, "?", "zz", "a bc d")], "doc_id int, idx int, label string, quote string, text string")
    assert rows(R.label_checks(r, ("a", "b"))) == {(1, 1, 2, 2, 1)}
    m = spark.createDataFrame([(1, 0, "Q one?", "m", 5, -1), (1, 1, "q ONE", "m", 5, 5), (1, 2, "Q two", "m", -1, 5)], "doc_id int, idx int, question string, method string, q_at int, m_at int")
    assert rows(R.method_checks(m)) == {(1, 0, "Q one?", "")}


def test_selection(spark):
    c = spark.createDataFrame([(1, "base", 0.5, 0.0, False), (1, "soft", 0.48, 0.9, True), (2, "only", 0.1, 0.0, False)], "cluster_id int, candidate string, score double, bonus double, fallback boolean")
    assert rows(R.soft_choice(c)) == {(1, "soft", True), (2, "only", False)}
    g = spark.createDataFrame([(0.1, 0.5), (0.2, 0.7), (0.3, 0.7)], "weight double, recall double")
    assert rows(R.grid_choice(g)) == {(0.2, 0.7)}
    lab = spark.createDataFrame([(1, "ice flow"), (2, "ice core"), (3, "grain")], "cluster_id int, label string")
    assert rows(R.distinctiveness(lab).select("cluster_id", "overlap")) == {(1, 0.5), (2, 0.5), (3, 0.0)}
    docs = spark.createDataFrame([(1, "Ice physics", ["ice", "snow"])], "doc_id int, title string, terms array<string>")
    cl = spark.createDataFrame([("B", "physics", "ice"), ("A", "x", "ice"), ("A", "x", "snow")], "code string, name string, term string")
    assert [(r.code, r.score) for r in R.scope_top(cl, docs, "terms").orderBy("rank").collect()] == [("B", 3), ("A", 2)]


def test_arcs_and_nested(spark):
    a = spark.createDataFrame([(1, "x", "y"), (1, "x", "y"), (1, "x", "x"), (1, "-", "y")], "doc_id int, head string, dep string")
    assert D.sanitised_arcs(a).count() == 1
    s = spark.createDataFrame([(1, 0, 9, "long"), (1, 2, 4, "in"), (1, 8, 12, "over")], "doc_id int, start_pos int, end_pos int, entity string")
    assert {r.entity for r in D.without_nested(s).collect()} == {"long", "over"}


def test_similarity_join_recall_and_hot_buckets(spark):
    import numpy as np

    from strataloom.operators import similarity

    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 24))
    rows = [(i * 10 + j, (base[i] + 0.28 * j * rng.standard_normal(24)).tolist()) for i in range(60) for j in range(4)]
    rows += [(10_000 + i, base[0].tolist()) for i in range(500)]  # copies of one vector
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    reps, member = similarity.classes(df, "id", "vector")
    assert reps.count() == 240 and member.where("rep = 0").count() == 501
    m = np.array([v for _, v in rows[:240]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = [i for i, _ in rows[:240]]
    true = {(ids[x], ids[y]) for x in range(240) for y in range(x + 1, 240) if m[x] @ m[y] >= 0.84}
    for most in (2000, 5):
        got = {(r.a, r.b) for r in similarity.similar_pairs(reps, 0.84, most=most).collect()}
        assert got <= true and len(got) >= (0.9 if most == 2000 else 0.3) * len(true) and len(true) > 50


def test_vector_index(spark, tmp_path):
    from strataloom.sources import vector_index

    folder = str(tmp_path / "index")
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "vec_id long, embedding array<double>")
    vector_index.build(df, folder)
    assert [(r.vec_id, r.embedding) for r in vector_index.scan(spark, folder).collect()] == [(1, [0.6, 0.8])]
    with pytest.raises(ValueError):
        vector_index.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], df.schema), folder)
    assert vector_index.scan(spark, folder).count() == 1  # the old index stays in force
    vector_index.build(df.limit(0), folder)
    assert vector_index.scan(spark, folder).count() == 0


def test_move_rules_of_a_file():
    from strataloom.operators import rules

    names = {"any_of": lambda a: {"any_of": list(a)}, "all_of": lambda a: {"all_of": list(a)}, "pattern": lambda a: {"pattern": a}, "feature": lambda a: {"dim": a[2:]}, "after": lambda a: {"after_move": a}, "before": lambda a: {"before_move": a}, "rel": lambda a: {"rel_min": a[0], "rel_max": a[1]}}
    data = {"rules": [{"id": r.id, "target_move": r.move, "action": r.action, "weight": r.weight, "necessary_conditions": [names[k](a) for k, a in r.needs], "exclusion_conditions": [names[k](a) for k, a in r.excludes]} for r in rules.RULES] + [{"id": "R9"}]}
    assert rules.rules_of(data) == rules.RULES and rules.rules_of({}) == ()
    for bad in ({"id": "x", "target_move": "other", "action": "+score"}, {"id": "x", "target_move": "method", "action": "+score", "necessary_conditions": [{"dim": "none"}]}):
        with pytest.raises(ValueError):
            rules.rules_of({"rules": [bad]})


def test_evidence_rules_of_a_file(spark, tmp_path):
    from strataloom.operators import citations

    path = tmp_path / "r.json"
    path.write_text('{"rules": [{"id": "T", "axis": "technical", "aliases": ["graph net"], "exclude_any": ["survey"], "conditional_aliases": [{"term": "net", "requires_any": ["graph"]}]}]}')
    found = citations.load_rules(str(path))
    rows = [(1, "A graph net", None), (2, None, "We use a graph net."), (3, None, "A graph net was known; we use it."), (4, None, "We did not use the graph net."), (5, None, "We use a survey of the graph net."), (6, None, "We train a net on the graph."), (7, None, "Related work: we use a graph net; we train magnets."), (8, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, title string, abstract_text string")
    got = {(r.doc_id, r.field, r.derivation) for r in citations.evidence_hits(df, found, {"title": 0.9, "abstract_text": 0.7}).collect()}
    assert got == {(1, "title", "explicit"), (2, "abstract_text", "explicit"), (6, "abstract_text", "contextual")}
    with pytest.raises(ValueError):
        citations.rules_of({"rules": [{"id": "x"}]})
