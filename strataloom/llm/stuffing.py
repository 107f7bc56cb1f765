"""Problem 8: pages made of repeated keywords, link lists, tag lists or product lists.

Phrase shingles of the whole of every page (two words, four characters of a wide script, eight of Thai)
are exploded and the distinct hosts (``source``) of every phrase are counted by a two-step aggregate.
A page is flagged when more than half of its shingles are replicated, on several hosts or over and over
on the page itself, and list segments hold more than half of its characters: replication decides, list
density joins it. Reference entries, tables of contents, data links and keyword lines that are shorter
than a page's prose count as ordinary text.

Results: null, empty and blank texts are never flagged; a null host counts as one host of its own;
repeated rows of one id give one result row; whole texts are read. A page of bare links has no phrases
but those of its addresses and is judged by them.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.session import checkpoint_dir

#: Share of characters in list segments and of replicated phrases that a page must exceed; the number of
#: hosts, or of occurrences on the page, that makes a phrase replicated.
SHARE, STITCHED, HOSTS, AGAIN = 0.5, 0.5, 3, 3
#: Rows of one phrase are spread over so many keys when pages are joined with the phrases' hosts.
SALTS = 16
FEATURES = "n_chars int, list_chars int"
# Words that sentences need and keyword lists lack.
FUNCTION_WORDS = frozenset(
    "the a an of and for with in on to by from at was were is are be we our that this which not no as while although because de la le les des du et en un une pour dans avec sur que qui est sont pas der die das und ein eine für mit von im in zu ist sind wir den dem nicht el los las y por para con una que se no su lo o os as e do da em um uma com não é и в на с по для не что мы из от к был была".split()
)
_END = re.compile(r"[.!?…。！？]+[\"'”’»」』)\]）】]*(?:\[\d+(?:[-,–]\d+)*\])*(?=\s|$|[^\x00-\x7f])|[。！？]+[”’」』）]*")
_LINK = re.compile(r"!?\[[^\]\n]*\]\([^)\s]*\)|<a\s[^>]*>[^<]*</a>")
_URL = re.compile(r"(?:https?://|www\.)[^\s,，、|<>]+")
# How lines of keywords of an article begin.
KEYWORD_LINES = "index terms|key ?words|schlüsselwörter|schlagwörter|mots[- ]clés|palabras clave|palavras[- ]chave|ключевые слова|关键词|關鍵詞|キーワード|키워드|주제어|คำสำคัญ"
_ORDINARY = re.compile(
    rf"^\s*\[?\d+[\].)]\s.*\b\d{{4}}\b.*\d\s*[-–]\s*\d|[.…·]{{3,}}\s*\d+\s*$|^\s*(?!https?:)[\w.-]+:\s?https?://\S+\s*$|^\s*(?i:{KEYWORD_LINES})\s*(?:[:：]|[-–—])(?!.*https?://).*$"
)
_MARKS = re.compile(r"\s*[|、,，;；/\t]\s*|\s*[»:]\s+|\s{2,}|\s-\s|\s*#")
_SEPARATORS = re.compile(r"[|、,，;；/\t»#]")
_KEYWORDS = re.compile(rf"^\s*(?i:{KEYWORD_LINES})\s*(?:[:：]|[-–—])")
_THAI = re.compile(r"[฀-๿]")
_WORD = re.compile(r"[^\W_]+")
# The tokens of phrases, and how many characters of the scripts without spaces make a phrase.
TOKEN = r"[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]|#?[\p{L}\p{M}\p{N}&&[^\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]]+"
WIDE, THAI = 4, 8
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")


def _is_thai(s: str) -> bool:
    return len(_THAI.findall(s)) > len(s) / 3


def _repeats(s: str) -> bool:
    """Whether a text in Thai, whose words and sentences no mark ends, says the same over and over."""
    grams = Counter(s[i : i + 8] for i in range(len(s) - 7))
    return grams.total() > 40 and sum(n for n in grams.values() if n >= AGAIN) > 0.3 * grams.total()


def _is_stream(s: str) -> bool:
    """A long stretch without any sentence mark that does not read like a sentence."""
    if _WIDE.search(s) and len(_WIDE.findall(s)) > len(s) / 2:
        if len(s) < 24:
            return False
        grams = [s[i : i + 3] for i in range(len(s) - 2)]
        return len(s) > 90 or len(set(grams)) < 0.75 * len(grams)
    if _is_thai(s):
        return _repeats(s)
    words = _WORD.findall(s.lower())
    if len(words) < 8:
        return False
    return sum(w in FUNCTION_WORDS for w in words) < 0.06 * len(words)


def _items(s: str) -> list[str]:
    return [x for x in (_URL.sub("", i).strip(" -*•·\"'«»()[]") for i in _MARKS.split(s)) if x]


def _is_list(s: str) -> bool:
    """Separated items that are short, many and not clauses."""
    urls = _URL.findall(s)
    if len(urls) >= 2 and sum(map(len, urls)) > 0.5 * len(s):
        return True
    if s.count("#") >= 3 and len(re.findall(r"(?:^|\s)#\w", s)) >= 3:
        return True
    items = _items(s)
    if len(items) < 5:
        return False
    wide = len(_WIDE.findall(s)) > len(s) / 3
    if _is_thai(s):  # separated by marks, not by the spaces between clauses
        return sum(map(len, items)) < 24 * len(items) and len(_SEPARATORS.findall(s)) >= 4
    size = sum(map(len, items)) / len(items) if wide else sum(len(_WORD.findall(i)) for i in items) / len(items)
    if size > (12 if wide else 4.5):
        return False
    words = _WORD.findall(s.lower())
    return wide or sum(w in FUNCTION_WORDS for w in words) < 0.12 * len(words)


def segments(text: str) -> tuple[int, list[str]]:
    """Characters of the text that are not blank at line ends, and its list segments."""
    total = 0
    lists: list[str] = []
    keywords: list[str] = []
    sentences: Counter = Counter()
    pending: list[str] = []  # lines without an end mark: a list if there are several in a row

    def settle() -> None:
        own = [p for p in pending if not (_is_thai(p) and len(p) > 30)]  # no Thai sentence has an end mark
        lists.extend(p for p in pending if p not in own and (_is_list(p) or _is_stream(p)))
        if (len(own) >= 4 and not _is_prose(own)) or sum(bool(_URL.search(p)) for p in own) >= 2:
            lists.extend(own)
        else:
            lists.extend(p for p in own if _is_list(p) or _is_stream(p))
        pending.clear()

    for line in re.split(r"[\r\n]+", text):
        line = line.strip()
        if not line:
            continue
        total += len(line)
        if len(_LINK.findall(line)) >= 2:
            lists.extend(_LINK.findall(line))
            line = re.sub(r"^[\s|,;·•-]+|[\s|,;·•-]+$", "", _LINK.sub("", line))
            if not _WORD.search(line):
                continue
        if _ORDINARY.search(line) and not _LINK.search(line):
            settle()
            if _KEYWORDS.match(line):
                keywords.append(line)
            continue
        at = 0
        for m in _END.finditer(line):
            s = line[at : m.end()].strip()
            at = m.end()
            settle()
            if len(_items(s)) >= 12 and _is_list(s):
                lists.append(s)
            else:
                sentences[s.lower()] += 1
        rest = line[at:].strip()
        if not rest or (at and len(_WORD.findall(rest)) < 6 and len(_WIDE.findall(rest)) < 24):
            settle()  # nothing, or the short end of a sentence
        elif _is_list(rest):
            settle()
            lists.append(rest)
        else:
            pending.append(rest)
    settle()
    lists.extend(s for s, n in sentences.items() if n >= AGAIN for _ in range(n))  # the same sentence over and over
    if 2 * sum(map(len, keywords)) > total - sum(map(len, lists)):  # keyword lines that end no ordinary text
        lists.extend(keywords)
    return total, lists


def _is_prose(lines: list[str]) -> bool:
    """Whether lines without an end mark read on as sentences do: wrapped prose."""
    words = _WORD.findall(" ".join(lines).lower())
    return len(words) > 8 * len(lines) and sum(w in FUNCTION_WORDS for w in words) >= 0.12 * len(words)


def _features(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        total, lists = segments(text or "")
        rows.append((total, sum(map(len, lists))))
    return pd.DataFrame(rows, columns=["n_chars", "list_chars"])


def list_density(text: Column) -> Column:
    """Characters of a page and of its list segments: struct<n_chars, list_chars>."""
    return F.pandas_udf(_features, FEATURES)(text)


def shingles(text: Column) -> Column:
    """Keys (array<bigint>) of a text's phrase shingles, in order and with repetitions. Numbers all
    count as one word, and so do the hosts of addresses, so that prices, item numbers and made-up hosts make
    no phrase unlike another. A hash tag is a phrase of its own, since its words may stand together."""
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = F.regexp_replace(F.when(low.contains("://"), F.regexp_replace(low, r"://[^/\s)]+", "://host")).otherwise(low), r"\p{N}+", "0")
    words = F.regexp_extract_all(plain, F.lit(TOKEN), 0)

    def keys(ws: Column) -> Column:
        def key(w: Column, i: Column) -> Column:
            n = F.when(w.startswith("#"), 1).when(F.char_length(w) > 1, 2).when(w.between("ก", "๿"), THAI).when(w >= "\u3040", WIDE).otherwise(2)
            return F.xxhash64(F.slice(ws, i + 1, n))

        return F.transform(ws, key)

    return F.element_at(F.transform(F.array(words), keys), 1)  # cuts the text once


def phrase_hosts(pages: DataFrame, host_col: str = "host") -> DataFrame:
    """Distinct hosts of every phrase of (shingles, host); pairs are made distinct before they are
    counted, so that a phrase on a hot host costs one row a task."""
    pairs = pages.select(F.explode("shingles").alias("phrase"), F.col(host_col).alias("host")).distinct()
    return pairs.groupBy("phrase").agg(F.count("*").alias("hosts"))


def stitched_shares(pages: DataFrame, hosts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For each page of (id, shingles): the share of its shingles that are replicated.

    A phrase of a third of all pages is one key of the join, so its rows are spread over ``SALTS`` keys.
    """
    own = pages.select(id_col, F.explode("shingles").alias("phrase")).groupBy(id_col, "phrase").agg(F.count("*").alias("times"))
    own = own.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
    known = hosts.where(F.col("hosts") >= HOSTS).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    replicated = F.when(F.col("hosts").isNotNull() | (F.col("times") >= AGAIN), F.col("times")).otherwise(0)
    return own.join(known, ["phrase", "salt"], "left").groupBy(id_col).agg((F.sum(replicated) / F.sum("times")).alias("stitched"))


def stuffed_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Ids of the pages made of keywords, links, tags or products, with the evidence."""
    checkpoint_dir(df.sparkSession)
    rows = df.select(F.col(id_col).alias("page"), F.coalesce(F.col(host_col), F.lit("")).alias("host"), F.col(text_col).alias("body"))
    dense = rows.select("page", "host", "body", list_density(F.col("body")).alias("f")).where(F.col("f.list_chars") > SHARE * F.col("f.n_chars"))
    share = (F.col("f.list_chars") / F.col("f.n_chars")).alias("list_share")
    dense = dense.select("page", share, shingles(F.col("body")).alias("shingles")).dropDuplicates(["page"]).checkpoint()
    asked = dense.select(F.explode("shingles").alias("phrase")).distinct()
    hosts = phrase_hosts(rows.select("host", shingles(F.col("body")).alias("shingles"))).join(asked, "phrase", "left_semi")
    out = dense.join(stitched_shares(dense, hosts, "page"), "page").where(F.col("stitched") > STITCHED)
    return out.select(F.col("page").alias(id_col), "list_share", "stitched")
