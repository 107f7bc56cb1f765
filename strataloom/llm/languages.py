"""Problem 2: the language of every document and of every part of a mixed one, with a confidence.

Bayesian fusion of evidence. Text likelihoods come from a unigram model over Latin-script words and
script classes, fitted on a bounded sample with the stored labels and refitted on its own sentence
labels, which removes wrong ones. They are combined with the declared label, the collector's tag and
the language declared in markup (as noisy observations), with evidence of the address suffix, and with a
prior of the host (``source``). Priors are counted by grouped aggregates over all documents and smoothed
hierarchically: all hosts, the hosts of one site, the host. Sentences are labelled together by
a Viterbi pass that makes a change of language cost something, so that foreign words or names within
a sentence make no run.

Results: documents with a null, empty or blank text get no row; text without any letters of a known
script gets the language its label, tag and host suggest, with a low confidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm import corpus, sentences
from strataloom.llm.confusables import skeleton
from strataloom.session import checkpoint_dir

LANGUAGES = ("en", "zh", "de", "fr", "es", "pt", "ja", "ru", "ko", "th")
# How labels name the languages (after the region is cut off, in lower case).
NAMES = {
    "en": "en eng english", "zh": "zh zho chi cmn chinese mandarin 中文 汉语 漢語 中国語", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano", "pt": "pt por portuguese português portugues", "ja": "ja jpn jp japanese 日本語 日语", "ru": "ru rus russian русский",
    "ko": "ko kor korean 한국어 韩语", "th": "th tha thai ไทย ภาษาไทย",
}
LABELS = {name: code for code, names in NAMES.items() for name in names.split()}
#: Largest number of rows the text model is fitted on; strength of the prior of the level above (in
#: documents); cost of a change of language between sentences; chance that a label or tag is right.
SAMPLE, STRENGTH, CHANGE, RIGHT = 4000, 50.0, 4.0, 0.85
#: Rows of one host are spread over so many keys when the priors are joined.
SALTS = 16
SEGMENTS = "array<struct<seg_no:int,start_pos:int,end_pos:int,language:string,confidence:double>>"
_TOKEN = re.compile(r"[a-zß-ɏ]+(?:['’][a-zß-ɏ]+)?|[Ѐ-ԯ]+|[가-힯]|[฀-๿]+|[぀-ヿㇰ-ㇿ]|[㐀-鿿]")
_THAI_SWITCH = re.compile(r"(?<=[฀-๿])\s+(?=[^฀-๿]{24})|(?<=[^฀-๿]{24})\s+(?=[฀-๿])")


def canonical(label: Column) -> Column:
    """Code of the language a label names, null if it names none: codes with or without region, or names, in any case."""
    base = F.lower(F.trim(F.regexp_extract(label, r"^\s*([^\s_\-(]+)", 1)))
    table = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.try_element_at(table, base)


def markup_language(markup: Column) -> Column:
    """Language code that the first ``lang`` attribute of a page's root or body declares, null without one."""
    return canonical(F.regexp_extract(markup, r"(?is)<(?:html|body|article)\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?([\w-]+)", 1))


def host_parts(host: Column) -> tuple[Column, Column]:
    """Site and address suffix of a host: ``a.b.example.de`` gives ``example.de`` and ``de``, a name
    without dots (``site-portal``) its first and its last part."""
    plain = F.regexp_replace(host, r"^\w+://|[/:].*$", "")
    site = F.when(plain.contains("."), F.regexp_extract(plain, r"([^.]+\.[^.]+)$", 1)).otherwise(F.regexp_extract(plain, r"^([^-]*)", 1))
    return site, F.regexp_extract(plain, r"([^-.]*)$", 1)


def _tokens(text: str) -> list[str]:
    """Words of Latin script, script classes of all other characters."""
    if not text.isascii():
        text = text.translate(_CYRILLIC_SAFE)
    out = []
    for t in _TOKEN.findall(text.lower()):
        c = t[0]
        if c < "ɐ":
            out.append(t)
        elif c < "Ԁ":
            out.extend(["<cyrillic>"] * ((len(t) + 2) // 3))
        elif "가" <= c <= "힯":
            out.append("<hangul>")
        elif "฀" <= c <= "๿":
            out.extend(["<thai>"] * ((len(t) + 2) // 3))
        elif c >= "㐀":
            out.append("<han>")
        else:
            out.append("<kana>")
    return out


class _Wide(dict):
    def __missing__(self, code: int) -> str:
        ch = chr(code)
        self[code] = out = skeleton(ch) if 0xFF00 <= code <= 0xFFEF or 0x2000 <= code <= 0x206F or code == 0xAD or 0xFB00 <= code <= 0xFB06 else ch
        return out


_CYRILLIC_SAFE = _Wide()


class TextModel:
    """Log likelihoods of tokens for each language."""

    def __init__(self, index: dict[str, int], table: np.ndarray) -> None:
        self.index, self.table = index, table

    def score(self, text: str) -> np.ndarray:
        ids = [i for t in _tokens(text) if (i := self.index.get(t)) is not None]
        return self.table[ids].sum(0) if len(ids) >= 3 else np.zeros(len(LANGUAGES), np.float32)


# What is known of scripts before any text is seen; keeps rare languages from being defined by wrong labels.
_SCRIPTS = {"zh": {"<han>": 400}, "ja": {"<kana>": 240, "<han>": 160}, "ru": {"<cyrillic>": 400}, "ko": {"<hangul>": 400}, "th": {"<thai>": 400}}


def _fits(tokens: list[str], language: int) -> bool:
    """Whether a text's script can be that of a language."""
    own = _SCRIPTS.get(LANGUAGES[language])
    n = sum((t in own) if own else t[0] != "<" for t in tokens)
    return n > 0.5 * len(tokens) and (LANGUAGES[language] != "ja" or "<kana>" in tokens)


def _estimate(rows: list[tuple[list[str], int]], least: int) -> TextModel:
    counts = [Counter(_SCRIPTS.get(x, {})) for x in LANGUAGES]
    for tokens, language in rows:
        counts[language].update(tokens)
    total = Counter()
    for c in counts:
        total.update(c)
    words = [t for t, n in total.items() if n >= least or t[0] == "<"]
    size = len(words) + 1
    table = np.array([[math.log((c[t] + 0.05) / (sum(c.values()) + 0.05 * size)) for c in counts] for t in words] or [[0.0] * len(LANGUAGES)], np.float32)
    return TextModel({t: i for i, t in enumerate(words)}, table)


def fit(rows: list[tuple[str, str]], cutter: sentences.Model, least: int = 3) -> TextModel:
    """The model of rows (text, language code), refitted twice on the labels it gives to their sentences."""
    known = [(text, LANGUAGES.index(code)) for text, code in rows if text and code in LANGUAGES]
    model = _estimate([(tokens, k) for t, k in known if _fits(tokens := _tokens(t), k)], least)
    parts = [_tokens(p) for t, _ in known for p in _parts(t, cutter)[1]]
    for _ in range(2):
        labelled = []
        for tokens in parts:
            ids = [i for t in tokens if (i := model.index.get(t)) is not None]
            if len(ids) >= 4:
                labelled.append((tokens, int(model.table[ids].sum(0).argmax())))
        model = _estimate(labelled, least) if labelled else model
    return model


def _parts(text: str, cutter: sentences.Model) -> tuple[list[tuple[int, int]], list[str]]:
    """Sentences of a text, cut further where Thai, which has no end mark, meets a long stretch of another script."""
    spans: list[tuple[int, int]] = []
    for a, b in sentences.units(text, cutter):
        if _THAI_SWITCH.search(text, a, b):
            at = a
            for m in _THAI_SWITCH.finditer(text, a, b):
                spans.append((at, m.start()))
                at = m.end()
            spans.append((at, b))
        else:
            spans.append((a, b))
    return spans, [text[a:b] for a, b in spans]


def evidence(text: Column, model: TextModel, cutter: sentences.Model) -> Column:
    """Positions and log likelihoods of a text's sentences: struct<starts, ends, scores, best>."""

    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            spans, parts = _parts(v, cutter) if v else ([], [])
            scores = [model.score(p) for p in parts]
            whole = np.sum(scores, 0) if scores else np.zeros(len(LANGUAGES))
            best = LANGUAGES[int(whole.argmax())] if whole.any() else None
            rows.append(([a for a, _ in spans], [b for _, b in spans], [x for s in scores for x in s.tolist()], best))
        return pd.DataFrame(rows, columns=["starts", "ends", "scores", "best"])

    return F.pandas_udf(run, "starts array<int>, ends array<int>, scores array<float>, best string")(text)


def _observed(code: str | None) -> np.ndarray:
    """Log chance of a declared code given each language."""
    if code not in LANGUAGES:
        return np.zeros(len(LANGUAGES))
    out = np.full(len(LANGUAGES), math.log((1 - RIGHT) / (len(LANGUAGES) - 1)))
    out[LANGUAGES.index(code)] = math.log(RIGHT)
    return out


def segment(starts, ends, scores, declared, tag, prior, markup=None) -> list[tuple[int, int, int, str, float]]:
    """Maximal runs of sentences of one language with their mean posterior."""
    n, k = len(starts), len(LANGUAGES)
    if not n:
        return []
    emit = np.asarray(scores, float).reshape(n, k)
    base = _observed(declared) + _observed(tag) + _observed(markup) + np.log(np.asarray(prior, float))
    empty = ~emit.any(1)
    best = emit[0] + base
    back = np.zeros((n, k), int)
    stay = np.arange(k)
    for i in range(1, n):
        top = int(best.argmax())
        change = best[top] - CHANGE
        back[i] = np.where(best >= change, stay, top)
        best = np.maximum(best, change) + emit[i]
    path = [int(best.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    path.reverse()
    post = emit + base
    post = np.exp(post - post.max(1, keepdims=True))
    post /= post.sum(1, keepdims=True)
    out: list[tuple[int, int, int, str, float]] = []
    i = 0
    while i < n:
        j = i
        while j + 1 < n and path[j + 1] == path[i]:
            j += 1
        sure = [post[x][path[i]] for x in range(i, j + 1) if not empty[x]] or [post[i][path[i]]]
        out.append((len(out) + 1, int(starts[i]), int(ends[j]), LANGUAGES[path[i]], round(float(np.mean(sure)), 4)))
        i = j + 1
    return out


def host_priors(found: DataFrame, host_col: str = "host") -> DataFrame:
    """Smoothed shares of the languages for each host, as an array in the order of LANGUAGES.

    Counts by host, by site and by address suffix are grouped aggregates (the last two of the first). The
    shares of all hosts smooth a site's, and a site's smooth a host's, with a fixed strength, so that a
    small host leans on its site. The suffix counts as evidence beside the host: its smoothed shares
    relative to those of all hosts.
    """
    n = len(LANGUAGES)
    by_host = found.groupBy(host_col).agg(F.array(*(F.count_if(F.col("best") == x) for x in LANGUAGES)).alias("own"))
    site, suffix = host_parts(F.col(host_col))
    by_host = by_host.select(host_col, "own", site.alias("site"), suffix.alias("suffix"))
    added = F.array(*(F.sum(F.col("own")[i]) for i in range(n)))
    everywhere = by_host.agg(added.alias("counts"))
    by_site = by_host.groupBy("site").agg(added.alias("of_site"))
    by_suffix = by_host.groupBy("suffix").agg(added.alias("of_suffix"))

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    def smoothed(counts: str, above: str) -> Column:
        return F.transform(counts, lambda x, i: (x + STRENGTH * F.get(above, i)) / (total(F.col(counts)) + STRENGTH))

    all_shares = everywhere.select(F.transform("counts", lambda x: (x + 1) / (total(F.col("counts")) + n)).alias("p_all"))
    rows = by_host.join(by_site, "site").join(by_suffix, "suffix").join(F.broadcast(all_shares))  # one row
    rows = rows.withColumn("p_site", smoothed("of_site", "p_all")).withColumn("p_suffix", smoothed("of_suffix", "p_all"))
    rows = rows.withColumn("p_host", smoothed("own", "p_site"))
    fused = F.transform("p_host", lambda p, i: p * F.get("p_suffix", i) / F.get("p_all", i))
    return rows.withColumn("fused", fused).select(host_col, F.transform("fused", lambda x: x / total(F.col("fused"))).alias("prior"))


def fitted(df: DataFrame, text_col: str, label_col: str) -> tuple[TextModel, sentences.Model]:
    """The text model and the sentence model, both fitted on the same bounded sample."""
    rows = corpus.sampled(df, SAMPLE, text_col, canonical(F.col(label_col)).alias("code"), where=F.length(text_col) > 0)
    headings = corpus.recurring(df, [text_col], sentences.heading_lines(F.col("text")), sentences.HEADINGS)
    cutter = sentences.fit([r[0] for r in rows], frozenset(map(skeleton, headings)))
    return fit([(r[0], r[1]) for r in rows if r[1]], cutter), cutter


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "abstract_text", label_col: str = "language", tag_col: str = "lang", host_col: str = "source", markup_col: str | None = None) -> DataFrame:
    """One row for each document with a text: its declared code and its segments, in order.
    ``markup_col`` names a column with the page's markup, where there is one."""
    model, cutter = fitted(df, text_col, label_col)
    checkpoint_dir(df.sparkSession)
    rows = df.where(F.length(F.trim(text_col)) > 0)
    found = rows.select(
        F.col(id_col).alias("doc"),
        F.coalesce(F.col(host_col), F.lit("")).alias("host"),
        canonical(F.col(label_col)).alias("declared"),
        canonical(F.col(tag_col)).alias("tag"),
        (markup_language(F.col(markup_col)) if markup_col else F.lit(None).cast("string")).alias("markup"),
        evidence(F.col(text_col), model, cutter).alias("e"),
    ).select("doc", "host", "declared", "tag", "markup", "e.*")
    found = found.where(F.size("starts") > 0).checkpoint()  # read by the priors and by the labelling

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([segment(*row) for row in zip(*columns)])

    # A host of a third of all documents is one key of the join, so its rows are spread over SALTS keys.
    priors = host_priors(found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    with_prior = found.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(priors, ["host", "salt"])
    segments = F.pandas_udf(run, SEGMENTS)("starts", "ends", "scores", "declared", "tag", "prior", "markup")
    return with_prior.select(F.col("doc").alias(id_col), "declared", segments.alias("segments"))


def mislabelled(df: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """Segments of documents whose label is missing or wrong or whose text is mixed."""
    found = identify(df, id_col, **columns)
    wrong = F.col("declared").isNull() | (F.size("segments") > 1) | (F.col("declared") != F.element_at("segments", 1)["language"])
    return found.where(wrong).select(id_col, F.inline("segments"))


