"""Training-data operators: edge cases, brute force, exact round trips, held-out accuracy."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import confusables, corpus, languages, leaks, queries, scans, sentences, split, stuffing, tokenize
from strataloom.session import table

DIRTY = "doc_id long, id string, source string, lang string, language string, title string, abstract_text string, content_text string, text string, value string, doc string, item string, host string, u string"
LONG = "The drift filter was tested. " * 4000


def dirty(spark, empty=False):
    """Nulls, empty and blank values, a very long text, repeated rows, and columns with clashing names."""
    none = (None,) * 4
    rows = [
        (1, "a", None, None, None, None, None, None, None, *none, "u"),
        (2, "b", "s", "en", "en", "", "", "", "", *none, "u"),
        (3, "c", "s", "en", "en", "  ", " \n ", "\n", " \t", *none, "u"),
        (4, "d", "s", "xx", "auto", "T", LONG, LONG, LONG, *none, "u"),
        (5, "e", "s", "xx", "auto", "T", "One sentence. Another one follows.", "x" * 50_000, "y" * 50_000, *none, "u"),
        (5, "e", "s", "xx", "auto", "T", "One sentence. Another one follows.", "x" * 50_000, "y" * 50_000, *none, "u"),
    ]
    return spark.createDataFrame([] if empty else rows, DIRTY)


def profiles(spark):
    return spark.createDataFrame([(1, "p", "chars", 100, 10), (2, "q", "bytes", 64, 0)], "profile_id long, profile_name string, size_unit string, max_size long, overlap_size long").collect()


def run_all(spark, df):
    items = spark.createDataFrame([(7, "en", LONG[:300]), (8, None, None), (9, "zh", "")], "item_id long, lang string, text string")
    model = sentences.fit_on(df, "abstract_text", "content_text")
    return {
        "units": sentences.sentence_units(df, ["abstract_text", "content_text"], model).collect(),
        "languages": languages.identify(df).collect(),
        "wrong": languages.mislabelled(df).collect(),
        "scans": scans.scan_traces(df).collect(),
        "paragraphs": scans.paragraphs(df, "content_text").collect(),
        "pairs": confusables.look_alike_pairs(df, ["title", "content_text"]).collect(),
        "classes": confusables.classes(df, ["title", "content_text"]).collect(),
        "pieces": split.pieces(df, profiles(spark)).collect(),
        "ids": tokenize.encode_documents(df).collect(),
        "leaks": leaks.find_leaks(df, items).collect(),
        "stuffed": stuffing.stuffed_pages(df).collect(),
    }


def test_dirty_rows(spark):
    got = run_all(spark, dirty(spark))
    assert {r.doc_id for r in got["units"]} == {4, 5}
    assert {r.doc_id for r in got["languages"]} == {4, 5}
    assert [tuple(r) for r in got["leaks"]] == [(4, 7, True)]
    assert got["pairs"] == [] and all(r.forms == 1 for r in got["classes"])
    ids = {r.doc_id: r.ids for r in got["ids"]}
    assert ids[1] == [] and ids[2] == [] and len(ids[3]) > 0 and len(ids[4]) > 10_000
    assert {r.doc_id for r in got["pieces"]} == {4, 5}
    assert len(got["paragraphs"]) == 6


def test_empty_tables(spark):
    assert all(v == [] for v in run_all(spark, dirty(spark, empty=True)).values())


# Problem 1


@pytest.fixture(scope="module")
def cutter():
    starts = ["The value rose.", "Dr. Ada measured it.", "We used Fig. 3 of Sec. 2.", "Nothing changed near 3.5.", "It ended at 4 p.m. near Rome.", "They agreed."]
    rng = random.Random(0)
    return sentences.fit(["\n\n".join(" ".join(rng.choices(starts, k=3)) for _ in range(4)) for _ in range(200)])


def cut(text, cutter):
    return [text[a:b] for a, b in sentences.units(text, cutter)]


def test_sentence_boundaries(cutter):
    assert cut("Dr. Ada measured it. The value rose near 3.5. They agreed.[6] We left", cutter) == ["Dr. Ada measured it.", "The value rose near 3.5.", "They agreed.[6]", "We left"]
    assert cut('Ada asked, "Is it so? Is it?" and left. (It was.) Yes.', cutter) == ['Ada asked, "Is it so? Is it?" and left.', "(It was.)", "Yes."]
    assert cut("It fell ... and rose; then: done! No", cutter) == ["It fell ... and rose; then: done!", "No"]
    assert cut("她问：“好吗？行吗？”随后走了。真的！他说：“好。”然后呢？", cutter) == ["她问：“好吗？行吗？”随后走了。", "真的！", "他说：“好。”", "然后呢？"]
    assert cut("「安定か。」と尋ねた。信号は弱まり……その後回復した。", cutter) == ["「安定か。」と尋ねた。", "信号は弱まり……その後回復した。"]
    assert cut("มีการเก็บตัวอย่าง 475 ชุดเพื่อศึกษา นอกจากนี้ไม่พบความสัมพันธ์", cutter) == ["มีการเก็บตัวอย่าง 475 ชุดเพื่อศึกษา", "นอกจากนี้ไม่พบความสัมพันธ์"]
    assert cut("1.2. Introduction\nThe value\nrose. They agreed.\n\nEnd", cutter) == ["1.2. Introduction", "The value\nrose.", "They agreed.", "End"]


def test_long_quotations_are_whole(cutter):
    for quoted in ("Nothing rose. Was it so? Yes! " * n for n in (20, 45, 200)):
        text = f"Ada wrote “{quoted.strip()}” and left. They agreed."
        assert cut(text, cutter) == [text[: -len(" They agreed.")], "They agreed."]
    assert cut("An “open quotation. It never closes. “So it is. Or not.” They agreed.", cutter)[1:] == ["It never closes.", "“So it is. Or not.”", "They agreed."]
    assert cut("See www." + "x" * 60 + ".example. They agreed.", cutter)[-1] == "They agreed."


def test_recurring_lines(spark):
    rows = [(i, "Findings\n\nThe value rose.") for i in range(50)] + [(i, f"Own words\n\nThe value {i} rose.") for i in range(50, 60)]
    df = spark.createDataFrame(rows, "doc_id long, abstract_text string")
    assert corpus.recurring(df, ["abstract_text"], sentences.heading_lines(F.col("text")), 3) == {"own words"}
    assert len(corpus.sampled(df, 20, "doc_id")) <= 20 and len(corpus.sampled(df, 100, "doc_id")) == 60


def test_units_cover_all_text(cutter):
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("aB。.!? \n\"(“”)1、ก") for _ in range(rng.randrange(60)))
        u = sentences.units(t, cutter)
        assert all(a < b and not t[a].isspace() and not t[b - 1].isspace() for a, b in u)
        assert all(x[1] <= y[0] for x, y in zip(u, u[1:]))
        covered = set().union(*(range(a, b) for a, b in u)) if u else set()
        assert all(t[i].isspace() for i in range(len(t)) if i not in covered)


# Problem 2


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("en_GB", "ENG", "中文", "pt-BR", "es-419", "und", "n/a", "", None, "German", "xx")], "l string")
    assert [r[0] for r in df.select(languages.canonical(F.col("l"))).collect()] == ["en", "en", "zh", "pt", "es", None, None, None, None, "de", None]


def test_held_out_languages(spark, data):
    """Segments of the smallest tables against the scripts they are written in."""
    rows = languages.identify(table(spark, data, "documents").select("doc_id", "source", "lang", "language", "abstract_text")).select("doc_id", F.inline("segments")).collect()
    text = {r.doc_id: r.abstract_text for r in table(spark, data, "documents").collect()}
    script = {"ko": "[가-힣]", "th": "[฀-๿]", "ru": "[а-я]", "ja": "[ぁ-ん]", "zh": "[一-鿿]"}
    wrong = [r for r in rows if r.language in script and not re.search(script[r.language], text[r.doc_id][r.start_pos : r.end_pos])]
    assert len(rows) > 50 and not wrong
    assert all(0 <= r.confidence <= 1 for r in rows)


def test_priors_lean_on_site_and_suffix(spark):
    rows = [("reef-papers", "de")] * 300 + [("reef-portal", "en")] * 2 + [("quarry-papers", "ko")] * 300 + [("www.a.example.de", "de")] * 40 + [("www.b.other.de", "fr")] * 1
    priors = {r.host: dict(zip(languages.LANGUAGES, r.prior)) for r in languages.host_priors(spark.createDataFrame(rows, "host string, best string")).collect()}
    assert all(abs(sum(p.values()) - 1) < 1e-9 for p in priors.values())
    assert priors["reef-portal"]["de"] > priors["reef-portal"]["en"] > priors["reef-portal"]["th"]  # of its site
    assert priors["www.b.other.de"]["de"] > 2 * priors["www.b.other.de"]["ko"]  # of its suffix
    parts = spark.createDataFrame([("http://www.a.example.de:80/x",), ("reef-portal",), ("one",), ("",)], "h string").select(*languages.host_parts(F.col("h"))).collect()
    assert [tuple(r) for r in parts] == [("example.de", "de"), ("reef", "portal"), ("one", "one"), ("", "")]


def test_markup_language(spark):
    pages = ['<!doctype html><html class="x" lang="pt-BR"><p>', "<html xml:lang=de>", "<html>lang=fr", None, "<body data-lang='fr'>"]
    assert [r[0] for r in spark.createDataFrame([(p,) for p in pages], "m string").select(languages.markup_language(F.col("m"))).collect()] == ["pt", "de", None, None, None]
    df = spark.createDataFrame([(1, "s", None, None, "12,5", pages[0])], "doc_id long, source string, lang string, language string, abstract_text string, text string")
    got = languages.identify(df, markup_col="text").select(F.inline("segments")).collect()
    assert [r.language for r in got] == ["pt"]


def test_runs():
    n = len(languages.LANGUAGES)
    e = [0.0] * n
    en, zh = list(e), list(e)
    en[0], zh[1] = 40.0, 40.0
    got = languages.segment([0, 10, 20, 30], [9, 19, 29, 39], en + zh + zh + en, "en", None, [1 / n] * n)
    assert [(s[0], s[1], s[2], s[3]) for s in got] == [(1, 0, 9, "en"), (2, 10, 29, "zh"), (3, 30, 39, "en")]


# Problem 3


def test_scanned_page(spark):
    body = "The hybrid flow solver lowers the error in all of the\nregions of the first set and can be rep-\neated with care. The multi-\nscale model was ready for the second\n— 12 —\nAnnals of Things  Vol. 3\nset of regions which vvere used here and there with\nthe sarne result as before."
    clean = "The sets were used here and there with the same result, repeated with a multi-scale model. "
    rows = [(1, "t", None, body)] + [(i, "t", None, clean * 3) for i in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, title string, abstract_text string, content_text string")
    got = {(r.damage, r.reading) for r in scans.scan_traces(df).collect()}
    assert {("page", "— 12 —"), ("header", "Annals of Things  Vol. 3"), ("break", "repeated"), ("break", "multi-scale"), ("glyph", "were"), ("glyph", "same")} <= got
    text = scans.paragraphs(df, "content_text").where("doc_id = 1").first().content_text
    assert "ready for the second set of regions" in text and "Annals" not in text


def test_long_header_lines_and_words(spark):
    name = "Transactions of the Society for the Long Names of Journals That Fill More Than a Line"
    word = "electroencephalographically" * 2
    rows = [(i, "t", None, f"The drift {i} of the flow was small in all of the\n{name}  Vol. {i}\nregions of the set and of the other sets that we") for i in range(5)]
    rows += [(9, "t", None, f"The drift 9 of the flow was small in all of the\n{name}\nregions of the set and of the " + word.replace("e", "c", 1) + "\nsets that we saw.")]
    rows += [(i, "t", None, f"{i} The {word} rose.") for i in range(20, 50)]
    df = spark.createDataFrame(rows, "doc_id long, title string, abstract_text string, content_text string")
    got = {(r.doc_id, r.damage, r.reading) for r in scans.scan_traces(df).collect()}
    assert {(9, "header", name), (9, "glyph", word)} <= got and all((i, "header", f"{name}  Vol. {i}") in got for i in range(5))


def test_readings_are_written_into_both_fields(spark):
    page = "The hybrid flow solver lowers the error in all of the\nregions of the first set. The multi-\nscale model was ready for the second\nset of regions which vvere used here with\nthe sarne result as before.\n\n本次实验的时问很短，\n结果仍然可靠。"
    clean = "The sets were used with the same result by a multi-scale model. 本次实验的时间很短。"
    rows = [(1, "t", page, page)] + [(i, "t", f"{i} {clean}", f"{i} {clean}" * 3) for i in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, title string, abstract_text string, content_text string")
    got = scans.paragraphs(df, "abstract_text", "content_text").where("doc_id = 1").first()
    for text in (got.abstract_text, got.content_text):
        assert "The multi-scale model was ready for the second set of regions which were used here with the same result" in text
        assert "时间很短，结果" in text


def test_copies_of_a_misread_page(spark):
    page = "The hybrid flow solver lowers the error in all of the\nregions of the first set and of the other\nset of regions which vvere used here and there with\nthe sarne result as before."
    clean = "The sets were used here with the same result. "
    rows = [(i, "t", None, page) for i in range(60)] + [(i, "t", None, f"{i} {clean}") for i in range(60, 90)]
    df = spark.createDataFrame(rows, "doc_id long, title string, abstract_text string, content_text string")
    got = {tuple(r) for r in scans.scan_traces(df).collect()}
    assert {(i, "content_text", "glyph", w) for i in range(60) for w in ("were", "same")} <= got
    assert {r.option: r.n for r in scans.lexicon(df, ["abstract_text", "content_text"]).collect()}["vvere"] == 1


def test_models_of_scans_are_fitted_on_all_rows(spark):
    """A table repeated has the same lines and words in the same shares, so the same models. From a sample it has not."""
    letter = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(i, f"Title {i}", f"{letter(i)}ser {letter(7 * i)[::-1].title()}ost went on" + "\n" * (i % 3) + f"\n{i if i % 5 else 'and stopped.'}" * (i % 4 + 1)) for i in range(3000)]
    kind = "doc_id long, title string, content_text string"
    one = spark.createDataFrame(rows, kind).repartition(4)
    two = spark.createDataFrame(rows + [(i + 3000, t, c) for i, t, c in rows], kind).repartition(4)
    a, b = (scans.fitted(df, ["content_text"], "title") for df in (one, two))
    assert a[0].emit == b[0].emit and (a[0].move == b[0].move).all()
    assert a[1].names == b[1].names and a[1].words == b[1].words
    assert a[1].words[0]["ser"] == 3000 and a[1].names[0]["ost"] == 3000


def test_states_of_lines_against_brute_force():
    draw = random.Random(5)
    n = len(scans.STATES)
    emit = [[{v: -draw.random() * 5 for v in (scans.KINDS if j == 0 else (True, False))} for j in range(len(scans.FEATURES))] for _ in range(n)]
    move = [[-draw.random() * 5 for _ in range(n)] for _ in range(n)]
    model = scans.LineModel(emit, np.array(move), frozenset())
    texts = [[(draw.choice(scans.KINDS), *(draw.random() < 0.5 for _ in scans.FEATURES[1:])) for _ in range(k)] for k in (2, 0, 4, 1, 4, 3)]

    def score(obs, path):
        return sum(f[v] for o, s in zip(obs, path) for f, v in zip(emit[s], o)) + sum(move[x][y] for x, y in zip(path, path[1:]))

    for obs, got in zip(texts, model.labels([scans.encoded(o) for o in texts])):
        assert tuple(got) == max(itertools.product(range(n), repeat=len(obs)), key=lambda p: score(obs, p))


def test_authors_line_has_no_end_mark(spark):
    """The dot of et al. ends no sentence, so the line is a header and the word around it is joined."""
    lines = ["The drift filter of the upper river was used for all sam-", "Kelnor et al.", "ples of the long series, while the result of the lower", "river stayed the same in all of the years that we saw."]
    df = spark.createDataFrame([(1, "T", None, "\n".join(lines))], "doc_id long, title string, abstract_text string, content_text string")
    got = {(r.damage, r.reading) for r in scans.scan_traces(df).collect()}
    assert got == {("header", "Kelnor et al."), ("break", "samples")}


def test_short_and_unlikely_misreadings(spark):
    rows = [(1, "t", "See the long data page of the new set for the qiiery\nplanner protocol.", None), (2, "t", "The vvhole kemel was tested.", None), (3, "t", "The regions of the first set and all the\nother sets use the kemel of the baselme and\nthe values of the tables.", None)]
    rows += [(i, "t", f"{i} The whole query of the kernel at the baseline was tested.", None) for i in range(4, 60)]
    df = spark.createDataFrame(rows, "doc_id long, title string, abstract_text string, content_text string")
    got = {(r.doc_id, r.damage, r.reading) for r in scans.scan_traces(df).collect()}
    assert got == {(1, "glyph", "query"), (2, "glyph", "whole"), (2, "glyph", "kernel"), (3, "glyph", "kernel"), (3, "glyph", "baseline")}


# Problem 4


def test_skeletons():
    s = confusables.skeleton
    same = [("ＡＢ１２", "AB12"), ("é", "é"), ("ﬁne", "fine"), ("a​b", "ab"), ("a b　c", "a b c"), ("pаtent", "patent"), ("⽔", "水"), ("ﾄ", "ト"), ("한", "한")]
    differ = [("A", "a"), ("é", "e"), ("²", "2"), ("x₂", "x2"), ("l", "1"), ("O", "0"), ("a-b", "a–b"), ("…", "...")]
    assert all(s(a) == s(b) for a, b in same)
    assert all(s(a) != s(b) for a, b in differ)
    assert all(s(s(a)) == s(a) for pair in same + differ for a in pair)


def test_pairs_against_brute_force(spark, data):
    docs = table(spark, data, "documents").select("doc_id", "title", "content_text")
    rows = docs.collect()
    want = {(f, a.doc_id, b.doc_id) for f in ("title", "content_text") for a in rows for b in rows if a.doc_id < b.doc_id and a[f] and b[f] and a[f] != b[f] and confusables.skeleton(a[f]) == confusables.skeleton(b[f])}
    assert {tuple(r) for r in confusables.look_alike_pairs(docs, ["title", "content_text"]).collect()} == want


def test_copies_do_not_join(spark):
    rows = [(i, "same") for i in range(2000)] + [(5000, "ｓame"), (5001, "other")]
    got = confusables.look_alike_pairs(spark.createDataFrame(rows, "doc_id long, title string"), ["title"])
    assert got.count() == 2000


# Problem 5


@pytest.mark.parametrize("unit", ["chars", "bytes"])
def test_pieces(unit):
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("abc 。.\n\né漢👍") for _ in range(rng.randrange(400)))
        size, over = rng.choice([(20, 0), (20, 7), (50, 12)])
        sizes = split.Sizes(t, unit)
        got = split.split_text(t, size, over, unit)
        assert "".join(t[a + shared : b] for _, a, b, shared, *_ in got) == t
        assert all(sizes.of(a, b) <= size for _, a, b, *_ in got)
        if unit == "chars":
            assert all(p[3] == over for p in got[1:])
        else:
            assert all(over - 3 <= sizes.of(p[1], p[1] + p[3]) <= over for p in got[1:])


def test_natural_boundaries():
    t = "One two three. Four five six. Seven eight nine."
    assert [t[a:b] for _, a, b, *_ in split.split_text(t, 20, 0)] == ["One two three. ", "Four five six. ", "Seven eight nine."]
    with pytest.raises(ValueError):
        split.split_text(t, 5, 5)


def test_forced(spark):
    df = spark.createDataFrame([(1, "x" * 101), (2, "x" * 60 + " " + "y" * 60), (3, "x" * 100), (4, None)], "doc_id long, content_text string")
    cut = split.split_items(df, profiles(spark))
    got = {(r.doc_id, r.profile_id): r.forced for r in cut.select("doc_id", "profile_id", split.forced_cut().alias("forced")).collect()}
    assert got == {(1, 1): True, (1, 2): True, (2, 1): False, (2, 2): False, (3, 2): True}


def test_forced_cuts_against_the_longest_run():
    rng = random.Random(8)
    for _ in range(400):
        t = "".join(rng.choice("abcdefgh\"’é漢 .\n") for _ in range(rng.randrange(200)))
        size, over, unit = rng.choice([(20, 0, "chars"), (20, 7, "chars"), (30, 12, "bytes")])
        longest = max((len(x.encode()) if unit == "bytes" else len(x) for x in split.RUN.findall(t)), default=0)
        assert any(p[5] > size for p in split.split_text(t, size, over, unit)) == (longest > size)


def test_many_profiles_are_cut_in_passes(spark, monkeypatch):
    monkeypatch.setattr(split, "PROFILES_AT_ONCE", 1)
    df = spark.createDataFrame([(1, "x" * 101)], "doc_id long, content_text string")
    assert {r.profile_id for r in split.split_items(df, profiles(spark)).collect()} == {1, 2}


# Problem 6


def test_tokens_match_the_public_encoder(spark, data):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=tokenize.ranks(), special_tokens={})
    rng = random.Random(2)
    made = ["".join(rng.choice(["a", "é", "の", "漢", "👍", " ", "\n", "'s", "12", "!?", "и", "ก", "́"]) for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    made += ["ab" * 3000, "<|endoftext|>", "\\\"'", "\u0085\u001c x"]
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(made)], "doc_id long, text string")
    docs = table(spark, data, "documents").select("doc_id", "text").unionByName(extra)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = docs.select("doc_id", tokenize.encode(F.col("text")).alias("ids")).withColumn("back", tokenize.decode(F.col("ids"))).collect()
    assert all(r.ids == enc.encode_ordinary(text[r.doc_id]) for r in rows)
    assert all(r.back == text[r.doc_id] for r in rows)


# Problem 7


def test_leaks_against_brute_force(spark, data):
    docs, items = table(spark, data, "documents"), table(spark, data, "benchmark")
    reduced = {r.item_id: (r.lang, leaks.reduce_text(r.text)) for r in items.collect()}
    want = set()
    for r in docs.where("text IS NOT NULL").collect():
        t = leaks.reduce_text(r.text)
        for item, (lang, x) in reduced.items():
            n = 30 if lang in ("zh", "ja") else 60
            if any(x[i : i + n] in t for i in range(len(x) - n + 1)):
                want.add((r.doc_id, item))
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, items).where("exact").collect()} == want and want


def test_planted_leaks():
    rng = random.Random(4)
    item = "".join(rng.choice("abcdefghij") for _ in range(300))
    index = leaks.Index([(1, "en", item)])
    for _ in range(50):
        a = rng.randrange(240)
        noise = lambda n: "".join(rng.choice("klmnopqrst") for _ in range(n))
        assert list(index.search([noise(200) + item[a : a + 60] + noise(200)])) == [(0, 1, True)]
        assert list(index.search([noise(200) + item[a : a + 59] + noise(200)])) in ([], [(0, 1, False)])
        assert list(index.search([noise(200) + item[a : a + 40] + noise(200)])) == []


def edited(text, every, rng):
    out, at = list(text), rng.randrange(every)
    while at < len(out):
        kind = rng.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 2 else [rng.choice("klmnop")]
        at += every
    return "".join(out)


def distance_to_window(item, length, text):
    """Least edit distance of any window of the item from any part of the text, by brute force."""
    best = length
    for j in range(len(item) - length + 1):
        row = [0] * (len(text) + 1)
        for x in range(1, length + 1):
            last, row = row, [x]
            for y in range(1, len(text) + 1):
                row.append(min(last[y - 1] + (item[j + x - 1] != text[y - 1]), last[y] + 1, row[y - 1] + 1))
        best = min(best, *row)
    return best


@pytest.mark.parametrize("every", [55, 40, 30])
def test_recall_of_edited_passages(every):
    rng = random.Random(every)
    items = [(k, "en", "".join(rng.choice("etaoinshrdlucm") for _ in range(360))) for k in range(30)]
    index = leaks.Index(items)
    noise = "".join(rng.choice("klmnopqrst") for _ in range(300))
    found = sum(k in {i for _, i, _ in index.search([noise + edited(text[a : a + 130], every, rng) + noise])} for k, _, text in items for a in (0, 100, 220))
    assert found >= 0.9 * 90


def test_edited_passages_against_brute_force():
    rng = random.Random(11)
    item = "".join(rng.choice("etaoinshr") for _ in range(64))
    index = leaks.Index([(1, "en", item)])
    found = true = 0
    for n in range(40):
        text = edited(item, rng.choice([9, 14, 22, 40]), rng)
        near = distance_to_window(item, 60, text) <= index.parts[0][0].max_edits
        got = bool(list(index.search([text])))
        assert near or not got
        found, true = found + got, true + near
    assert true >= 5 and found >= 0.9 * true


def test_long_texts_are_searched_in_parts(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(leaks, "STRIDE", 150)
    rng = random.Random(6)
    item = "".join(rng.choice("abcdefghij") for _ in range(200))
    texts = ["".join(rng.choice("klmnop") for _ in range(rng.randrange(900))) for _ in range(60)]
    texts = [t[: len(t) // 2] + (item[i : i + 60] if i % 2 else item[i : i + 59]) + t[len(t) // 2 :] for i, t in enumerate(texts)]
    search = leaks._searcher(leaks.Index([(1, "en", item)]))
    got = pd.concat(search(iter([pd.DataFrame({"doc": range(60), "text": texts})])))
    assert got[got["exact"]]["doc_id"].tolist() == [i for i in range(60) if i % 2]


# Problem 8


def test_stuffed_pages(spark):
    prose = " ".join(f"We measured the drift of filter {i} in all regions of set {i + 3}. The error fell by {i} percent, although sample {i} was small." for i in range(12)) + " "
    rows = [
        (1, "a", ", ".join(["cheap lab coat", "best lab coat online", "buy soil test kit", "free data logger"] * 12)),
        (2, "b", "\n".join(f"https://shop{i}.example/p/{i}" for i in range(30))),
        (3, "c", "论文润色，论文润色，论文润色。购买论文润色。" * 15),
        (4, "d", prose + "\n\nKeywords: drift; filter; region; error; sample; run"),
        (5, "e", prose + "\n\nReferences\n" + "\n".join(f"[{i}] Ada, B. (20{i}). On drift. Annals, 3(1), {i}-{i + 9}. https://doi.example/{i}" for i in range(10, 18))),
        (6, "f", None), (7, "g", " "),
    ]
    got = stuffing.stuffed_pages(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert {r.doc_id for r in got.collect()} == {1, 2, 3}


def test_replication_decides(spark):
    names = ["amber", "basalt", "cedar", "dune", "ember", "fjord", "grove", "heath", "islet", "jetty", "knoll", "lagoon", "mesa", "nadir", "ocean", "plain", "quay", "ridge", "shoal", "tarn"]
    alone = ", ".join(f"{a} {b}" for a, b in zip(names, names[7:] + names[:7]))
    shared = ", ".join(f"cheap {a} kit" for a in names)
    prose = "We measured the drift of the filter in all regions of the set. The error fell by a third, although the sample of the station was small and the wind was not."
    rows = [(1, "a", alone), (2, "a", shared), (3, "b", shared + ", more"), (4, "c", "other, " + shared), (5, "a", prose), (6, "b", prose), (7, "c", prose)]
    assert {r.doc_id for r in stuffing.stuffed_pages(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()} == {2, 3, 4}


def test_lists_in_thai_and_keyword_lines(spark):
    thai = ", ".join(["รับแปลเอกสาร", "ชุดทดสอบดิน", "พิมพ์วิทยานิพนธ์", "เครื่องบันทึกข้อมูล", "รับแปลเอกสารด่วน"] * 4)
    line = "Keywords: " + "; ".join(["cheap lab coat", "best soil test kit", "buy data logger", "lab coat online"] * 5)
    rows = [(1, "a", thai), (2, "b", line), (3, "c", "การศึกษานี้พบว่าอุณหภูมิสูงขึ้น นอกจากนี้ยังไม่พบความสัมพันธ์กับลม และความชื้นก็ลดลงในทุกพื้นที่")]
    assert {r.doc_id for r in stuffing.stuffed_pages(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()} == {1, 2}


def test_queries_have_the_stated_columns(spark, data):
    want = {
        "p1_found": ["doc_id", "field_name", "start_pos", "end_pos"], "p2_found": ["doc_id", "seg_no", "language"], "p3_found": ["doc_id", "field_name", "damage", "reading"], "p4_found": ["field_name", "doc_a", "doc_b"],
        "p5_found": ["doc_id", "profile_id", "forced"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
    }
    for name, columns in want.items():
        df = queries.queries()[name](spark, data)
        rows = [tuple(map(str, r)) for r in df.collect()]
        assert df.columns == columns and len(rows) == len(set(rows)) and rows
