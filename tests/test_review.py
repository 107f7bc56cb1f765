"""Paper functions and review operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from strataloom.functions import papers as P
from strataloom.operators import batches
from strataloom.operators import review as R

PAPER = "Title\n\nAbstract: We test ice.\n\nIntroduction\nIce melts [1, 3]. It flows [2-9].\n\nReferences\n[1] Ada. One.\n[2] Bob.\nTwo.\n[3] Cy. Three."


def test_papers():
    assert P.reference_entries(PAPER) == ["Ada. One.", "Bob. Two.", "Cy. Three."] and P.reference_entries("none") == []
    assert P.valid_markers(PAPER) == [1, 3, 2]
    assert P.find_abstract(PAPER) == "We test ice."
    assert P.join_wrapped("The ice-\nberg is\nbig.\nDOI 10.1\n膜污\n染") == "The iceberg is big.\n膜污染"
    assert P.locate_definition("a b, c", "x\na b,\n c") == 2 and P.locate_definition("zzzzzz", "abc") == -1
    assert P.excerpts("x" * 3000 + "cue" + "y" * 2000, ["CUE"]) == [(0, 2600), (2580, 3980)]
    assert P.flatten_json('{"a": [1, {"b": null}]}') == [("$.a[0]", "1"), ("$.a[1].b", "")] and P.flatten_json("{") == []
    assert P.fused_label("sea ice", "ice flow") == "sea ice flow" and P.fused_label("network", "networks") == "networks" and P.fused_label("clusters", "clustering") is None
    assert all(len(c) <= 60 for c in P.heading_chunks("1. Ice\nshort\n\n2. Flow\n" + "word " * 8, 60))


def test_fund_sections():
    got, missing = P.fund_sections("（一）立项依据\nWhy.\n2. 研究内容\nWhat.\n\n经费预算\n10")
    assert got == [("basis", "Why."), ("aims", "What."), ("budget", "10")] and missing == ["plan", "novelty", "foundation"]


def test_batches_keep_every_row(spark):
    def call(texts):
        if len(texts) > 1 and "bad" in texts or texts == ["bad"]:
            raise ValueError("no")
        return {t: t.upper() for t in texts if t != "mute"}

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c"), (4, "mute"), (5, None), (6, "a")], "n long, t string").coalesce(1)
    got = {r.id: (r.answer, r.failure) for r in batches.answered(df, call, "n", "t", 4).collect()}
    assert got == {1: ("A", None), 2: (None, "no"), 3: ("C", None), 4: (None, "omitted"), 5: (None, None), 6: ("A", None)}

def test_review(spark):
    d = spark.createDataFrame([("a",), ("a",)], "document_id string")
    with pytest.raises(Exception, match="repeated id"):
        R.unique_documents(d).collect()
    s = spark.createDataFrame([(1, 0, "It improves by 3.5 and 4."), (1, 1, "Nothing."), (1, 2, "It raises it.")], "doc_id int, idx int, sentence string")
    assert [(r.idx, r.score) for r in R.progress_sentences(s).orderBy("rank").collect()] == [(0, 3), (2, 1)]
    q = spark.createDataFrame([(1, 1)], "doc_id int, idx int")
    assert tuple(R.nearest_or_richest(s, q).first()) == (1, 1, 0, 0)
    m = spark.createDataFrame([(1, "Ice net", 2), (1, "Ice net", 1), (2, "ice-net", 5)], "doc_id int, method string, idx int")
    assert R.evidence_tree(m).where("doc_id = 1").first().methods[0].evidence == [1, 2]
    assert [(r.key, r.docs) for r in R.cross_document_groups(m).collect()] == [("icenet", 2)]
    sp = spark.createDataFrame([(1, "It improves by 3.5 and 4. Nothing.", "result"), (1, "Nothing.", "other")], "doc_id int, span string, label string")
    assert {(r.idx, r.label) for r in R.spans_to_sentences(sp, s).collect()} == {(0, "result"), (1, "result")}
    e = spark.createDataFrame([(1, "improves"), (1, "It")], "doc_id int, entity string")
    assert R.entity_context(e, s).first().contexts[0].startswith("S1: It improves")


def test_scores(spark):
    r = spark.createDataFrame([(1, "this fails badly", "neutral", 1.0)], "id int, sentence string, label string, confidence double")
    got = R.citation_scores(r, [("fails", "negative", 0.8), ("works", "positive", 0.5), ("x", "neutral", 0.1)]).first()
    assert got.suggestion == "negative" and got.s_neutral == 0.7
    c = spark.createDataFrame([(1, 0, 0, "a long clause here", "m"), (1, 0, 1, "short", "r")], "doc_id int, idx int, place int, clause string, label string")
    assert [x.label for x in R.moved_fragments(c).orderBy("place").collect()] == ["m", "m"]
    a = spark.createDataFrame([(1, 0, "A", 0.9), (1, 1, "A", 0.5), (2, 0, "A", 0.1)], "doc_id int, sentence int, anchor string, similarity double")
    assert {(x.doc_id, x.anchor) for x in R.anchor_gate(a).collect()} == {(1, "A"), (2, None)}
    lab = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "cluster_id int, label_vec array<double>")
    t = spark.createDataFrame([(1, "x.pdf", [0.0, 1.0]), (2, "Ice", [0.0, 1.0])], "cluster_id int, title string, title_vec array<double>")
    assert {(x.cluster_id, x.passes) for x in R.covers_members(lab, t).collect()} == {(1, True), (2, False)}
    k = spark.createDataFrame([(["a"], ["b"], False), (["a"], ["b"], True)], "evidence array<string>, rule_terms array<string>, verified boolean")
    assert [x.evidence for x in R.rule_mask(k).collect()] == [["a", "b"], ["a"]]
    kw = spark.createDataFrame([(1, "膜污染", True), (1, "冰", False)], "doc_id int, keyword string, in_dictionary boolean")
    assert tuple(R.keyword_shape(kw).first()) == (1, 2, 1, "zh")


def test_models(spark):
    e = spark.createDataFrame([(a, b, 1.0) for g in (0, 10) for a in range(g, g + 4) for b in range(a + 1, g + 4)] + [(0, 10, 0.01)], "src long, dst long, weight double")
    got = {r.id: r.cluster for r in R.spectral(e, 2).collect()}
    assert len({got[i] for i in range(4)}) == 1 and got[0] != got[11]
    t = spark.createDataFrame([("sea ice melts", "ice"), ("ice flows", "ice"), ("crop yield", "farm"), ("crop rows", "farm")], "text string, label string")
    m = R.text_classifier(t, "text", "label", 1 << 10)
    p = m.transform(t.withColumn("grams", R.chars(F.col("text"))))
    assert all(r.y == r.prediction for r in p.collect())


def test_labels_chosen_in_rounds_are_those_chosen_in_order(spark):
    import random

    from strataloom.operators import grouping

    rng = random.Random(9)
    for _ in range(4):
        rows = list({(c, f"t{rng.randrange(12)}"): (c, f"t{rng.randrange(12)}", float(rng.randrange(6))) for c in range(15) for _ in range(5)}.values())
        rows = list({(c, t): (c, t, s) for c, t, s in rows}.values())
        want, taken = {}, set()
        for c, t, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
            if c not in want and t not in taken:
                want[c] = t
                taken.add(t)
        got = {r.cluster_id: r.label for r in grouping.choose_labels(spark.createDataFrame(rows, "cluster_id int, term string, score double")).collect()}
        assert got == want
    assert grouping.choose_labels(spark.createDataFrame([], "cluster_id int, term string, score double")).collect() == []


def test_vocabulary_by_containment_and_type(spark):
    from strataloom.operators import documents

    e = spark.createDataFrame([("ＳＥＡ ice", "t"), ("thick sea ice", "t"), ("ice", "t"), ("sea ice", "u"), ("Straße", "t"), ("x" * 70 + " sea ice", "t"), ("z", "t"), (None, "t")], "entity string, type string")
    v = spark.createDataFrame([("Sea-Ice", "t", 2), ("old sea ice", "t", 1), ("STRASSE", "t", 3), ("z", "t", 4)], "term string, type string, ord int")
    got = {(r.entity, r.term, r.how) for r in documents.matched_entities(e, v).collect()}
    assert got == {("ＳＥＡ ice", "Sea-Ice", "exact"), ("thick sea ice", "Sea-Ice", "part"), ("ice", "old sea ice", "part"), ("Straße", "STRASSE", "exact"), ("x" * 70 + " sea ice", "Sea-Ice", "part")}
