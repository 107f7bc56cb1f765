"""Checks and evaluation: file contents, cached parses, folds, relation matches, taxonomy and keyword accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.functions.text import discipline
from strataloom.operators.relational import placed

# Suffixes that are read, how their files begin, and how binary files begin.
SUFFIXES = ("pdf", "docx", "txt", "md", "json", "csv", "xlsx")
PDF, ZIP = "25504446", "504B0304"
BINARY = (PDF, ZIP, "89504E47", "FFD8FF", "47494638", "7F454C46", "D0CF11E0", "1F8B08")
COMMON = "that this from based using used model method data result study research system paper propose analysis approach learning with the and for are not can has have was our all new".split()


def content_problem(name: Column, content: Column) -> Column:
    """SRC-01, SRC-07: why the bytes of an uploaded file are refused; null where they are accepted.

    Empty files; suffixes that nothing reads; a PDF without its mark in the first 1024 bytes; office files
    that are no archives; text files that begin like binary ones, hold more than 5 % of control or
    replacement characters, fewer than ten characters, or (200 and more Latin letters without a mark or
    digit) no common word. The whole text is looked at.
    """
    suffix = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^.]+)$", 1))
    head = F.hex(F.substring(content, 1, 8))
    text = F.make_valid_utf8(F.coalesce(content.cast("string"), F.lit("")))
    n = F.greatest(F.char_length(text), F.lit(1))
    bad = F.regexp_count(text, F.lit(r"[\x{fffd}\x00-\x07\x0b\x0e-\x1f]"))
    effective = F.char_length(F.regexp_replace(text, r"\s+", ""))
    words = F.array_distinct(T.words(text, "[a-z]{2,}"))
    hits = F.filter(words, lambda w: w.isin(*COMMON))
    known = (F.size(hits) >= 3) | F.exists(hits, lambda w: F.char_length(w) >= 4)
    noise = (T.cjk_count(text) == 0) & (effective >= 200) & ~text.rlike("[.,;:!?，。；：0-9]") & ~known
    plain = F.coalesce(F.when(head.rlike(f"^(?:{'|'.join(BINARY)})"), "binary content"), F.when((n >= 20) & (bad / n > 0.05), "unreadable"), F.when(effective < 10, "too short"), F.when(noise, "no words"))
    return (
        F.when(~F.coalesce(suffix.isin(*SUFFIXES), F.lit(False)), "unknown suffix")
        .when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty")
        .when(suffix == "pdf", F.when(~F.contains(F.hex(F.substring(content, 1, 1024)), F.lit(PDF)), "not a pdf"))
        .when(suffix.isin("docx", "xlsx"), F.when(~F.startswith(head, F.lit(ZIP)), "not an office file"))
        .otherwise(plain)
    )


def taken(requests: DataFrame, cache: DataFrame, seconds: int) -> DataFrame:
    """SRC-16, DATE-04: cached parses in the order of the requests; each is a hit, expired (older than
    ``seconds`` at the time of the request) or missing. ``requests``: (batch, place, key, asked_at);
    ``cache``: (key, stored_at), of which the newest counts."""
    newest = cache.groupBy("key").agg(F.max("stored_at").alias("stored_at"))
    age = F.col("asked_at").cast("timestamp").cast("double") - F.col("stored_at").cast("timestamp").cast("double")
    state = F.when(F.col("stored_at").isNull(), "missing").when(age > seconds, "expired").otherwise("hit")
    return requests.join(newest, "key", "left").select("batch", "place", "key", state.alias("state"))


def ranked(rows: DataFrame, group: str, key: str, digits: int = 2) -> DataFrame:
    """Place of every row (from 1) within its group by a hexadecimal key, in parts by its first digits."""
    return placed(rows, group, F.substring(key, 1, digits), [key])


def folds(rows: DataFrame, id_col: str, profile: str, n_folds: int = 5, holdout: int = 60, seed: int = 42) -> DataFrame:
    """EVL-01: a seeded hold-out of at most ``holdout`` rows (a fifth of small tables), and folds for the
    rest in which every profile is spread in turn. Fold is null for rows held out."""
    key = lambda s: F.md5(F.concat(F.lit(f"{s}-"), F.col(id_col).cast("string")))
    size = rows.count()
    held = rows.select(id_col).orderBy(key(seed), id_col).limit(min(holdout, max(size // 5, 1))).withColumn("held", F.lit(True))
    rest = rows.select(id_col, profile).join(held, id_col, "left_anti").withColumn("key", key(seed + 1))
    spread = ranked(rest, profile, "key").select(id_col, profile, ((F.col("place") - 1) % n_folds).cast("int").alias("fold"))
    return spread.unionByName(rows.select(id_col, profile).join(held, id_col, "left_semi").withColumn("fold", F.lit(None).cast("int")))


def matched_relations(gold: DataFrame, pred: DataFrame, variants: DataFrame) -> DataFrame:
    """JOIN-20: gold relations that a prediction of their document matches: the relation equal or
    contained either way, head and tail by any variant of theirs. ``gold``, ``pred``: (doc_id, head,
    relation, tail); ``variants``: (doc_id, canonical, variant)."""
    norm = lambda c: T.key(F.col(c))
    g = gold.select("doc_id", "head", "relation", "tail", norm("relation").alias("gr"))
    p = pred.select("doc_id", norm("relation").alias("pr"), norm("head").alias("ph"), norm("tail").alias("pt"))
    v = variants.groupBy("doc_id", F.col("canonical").alias("c")).agg(F.collect_set(norm("variant")).alias("vs"))
    for side in ("head", "tail"):
        g = g.join(v.select("doc_id", F.col("c").alias(side), F.col("vs").alias(f"{side}_variants")), ["doc_id", side])
    either = lambda a, b: (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    side = lambda t, vs: (F.char_length(t) >= 2) & F.exists(vs, lambda x: either(t, x))
    hit = either(F.col("gr"), F.col("pr")) & side(F.col("ph"), F.col("head_variants")) & side(F.col("pt"), F.col("tail_variants"))
    return g.join(p, "doc_id").where(hit).select("doc_id", "head", "relation", "tail").distinct()


def domain_confidence(chosen: Column, candidates: Column) -> Column:
    """RES-21: .85, raised by the place of the chosen code among the retrieved candidates (.10 for the
    first, .02 less for each next) and by a similarity above one half, up to .95; .85 for one that was not
    retrieved. ``candidates``: array<struct<code, score>>, best first."""
    at = F.array_position(F.transform(candidates, lambda c: c["code"]), chosen)
    score = F.get(candidates, (at - 1).cast("int"))["score"]
    raised = 0.85 + F.greatest(F.lit(0.0), 0.10 - (at - 1) * 0.02) + F.greatest(F.lit(0.0), score - 0.5)
    return F.round(F.when(at > 0, F.least(F.lit(0.95), raised)).otherwise(0.85), 3)


def taxonomy_scores(rows: DataFrame) -> DataFrame:
    """AGG-22: exact, same-branch, discipline and top-level hits of the main code, hits of the auxiliary
    one, precision, recall and F1 of being interdisciplinary, and the share of codes that exist.
    ``rows``: (gold, pred, gold_aux, pred_aux, known)."""
    share = lambda c, n: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6).alias(n)
    cross = lambda main, aux: F.coalesce(discipline(F.col(main)) != discipline(F.col(aux)), F.lit(False))
    g, p = cross("gold", "gold_aux"), cross("pred", "pred_aux")
    tp, fp, fn = F.count_if(g & p), F.count_if(~g & p), F.count_if(g & ~p)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    branch = F.startswith("gold", F.col("pred")) | F.startswith("pred", F.col("gold"))
    return rows.agg(
        F.count("*").alias("n"),
        share(F.col("gold") == F.col("pred"), "exact"),
        share(branch, "branch"),
        share(discipline(F.col("gold")) == discipline(F.col("pred")), "discipline"),
        share(F.left("gold", F.lit(1)) == F.left("pred", F.lit(1)), "top"),
        share(F.col("gold_aux") == F.col("pred_aux"), "aux"),
        F.round(ratio(tp, tp + fp), 6).alias("inter_precision"),
        F.round(ratio(tp, tp + fn), 6).alias("inter_recall"),
        F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("inter_f1"),
        share(F.col("known"), "existing"),
    )


def keyword_scores(rows: DataFrame, k: int = 5) -> DataFrame:
    """AGG-19: exact and partial (contained either way) precision, recall and F1 of keywords, and recall
    of the first k, each averaged over documents. ``rows``: (doc_id, gold, pred), arrays; ``pred`` in order."""
    within = lambda x, ys: F.exists(ys, lambda y: F.contains(x, y) | F.contains(y, x))
    hit = F.size(F.array_intersect("gold", "pred"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, F.size(b)), F.lit(0.0))
    part_p, part_g = F.size(F.filter("pred", lambda x: within(x, F.col("gold")))), F.size(F.filter("gold", lambda x: within(x, F.col("pred"))))
    r = rows.select(ratio(hit, "pred").alias("p"), ratio(hit, "gold").alias("r"), ratio(part_p, "pred").alias("pp"), ratio(part_g, "gold").alias("pr"), ratio(F.size(F.array_intersect("gold", F.slice("pred", 1, k))), "gold").alias("rk"))
    f1 = lambda a, b: F.coalesce(F.try_divide(2 * F.col(a) * F.col(b), F.col(a) + F.col(b)), F.lit(0.0))
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return r.agg(F.count("*").alias("docs"), mean("p", "precision"), mean("r", "recall"), mean(f1("p", "r"), "f1"), mean("pp", "partial_precision"), mean("pr", "partial_recall"), mean(f1("pp", "pr"), "partial_f1"), mean("rk", "recall_at_k"))


def label_evaluation(rows: DataFrame) -> DataFrame:
    """AGG-20: evaluation of cluster labels overall and by split: share right at once and among five,
    concept precision, recall and F1 from summed counts, share within the length, share of repeated labels.
    ``rows``: (split, label, top1, top5, tp, fp, fn, fits)."""
    labels = rows.groupBy("split", "label").agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("long")).alias(c) for c in ("top1", "top5", "tp", "fp", "fn", "fits")))
    both = labels.unionByName(labels.withColumn("split", F.lit("all")).groupBy("split", "label").agg(*(F.sum(c).alias(c) for c in ("n", "top1", "top5", "tp", "fp", "fn", "fits"))))
    g = both.groupBy("split").agg(F.count("*").alias("labels"), *(F.sum(c).alias(c) for c in ("n", "top1", "top5", "tp", "fp", "fn", "fits")))
    over = lambda a, b: F.round(F.col(a) / F.greatest(b, F.lit(1)), 6)
    n = F.col("n")
    return g.select("split", n.alias("clusters"), over("top1", n).alias("top1"), over("top5", n).alias("recall_at_5"), over("tp", F.col("tp") + F.col("fp")).alias("precision"), over("tp", F.col("tp") + F.col("fn")).alias("recall"), F.round(2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)), 6).alias("f1"), over("fits", n).alias("length"), F.round((n - F.col("labels")) / n, 6).alias("repeated"))


def macro_scores(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """AGG-18: accuracy and the mean F1 over a fixed list of labels; one that never occurs counts 0."""
    each = [F.coalesce(F.try_divide(2 * F.count_if((F.col("gold") == x) & (F.col("pred") == x)), F.count_if(F.col("gold") == x) + F.count_if(F.col("pred") == x)), F.lit(0.0)) for x in labels]
    return rows.agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("pred")).cast("int")), 6).alias("accuracy"), F.round(sum(each[1:], each[0]) / len(labels), 6).alias("macro_f1"))


def one_or_two(rows: DataFrame, group: list[str], least: float = 0.40, near: float = 0.15) -> DataFrame:
    """WIN-06: of every group the best row and a second one near it, both above a floor; rows from the
    user's dictionary, and those without a type (the last group column), always stay. ``rows``: (..., id, fitness, in_dictionary)."""
    free = F.col("in_dictionary") | F.col(group[-1]).isNull()
    rest = rows.where(~free & (F.col("fitness") >= least))
    w = Window.partitionBy(*group)
    r = rest.withColumns({"place": F.row_number().over(w.orderBy(F.desc("fitness"), "id")), "top": F.max("fitness").over(w)})
    kept = r.where((F.col("place") == 1) | ((F.col("place") == 2) & (F.col("fitness") >= F.col("top") - near))).drop("place", "top")
    return kept.unionByName(rows.where(free))


def residue_line(s: Column) -> Column:
    """FLT-07: whether a citation sentence is what is left of a table or formula: decimals run together,
    numbers right behind markers, TeX commands, dashes of empty cells beside a marker, five or more
    markers in a long line, or column heads run together."""
    flat = F.regexp_replace(s, r"\s+", "")
    return (
        (F.regexp_count(flat, F.lit(r"\d{1,3}\.\d{2,}(?=\d)")) >= 2)
        | (F.regexp_count(flat, F.lit(r"[\]］]\d")) >= 2)
        | s.rlike(r"\\mathrm|\\left\s*\[|\\right\s*\]|\$\{")
        | (F.contains(flat, F.lit("一一")) & flat.rlike(r"[\[［]\d"))
        | ((F.regexp_count(s, F.lit(r"[\[［]\s*\d+(?:\s*[-–,，]\s*\d+)*\s*[\]］]")) >= 5) & (F.char_length(s) >= 250))
        | flat.rlike("(?:Model|Method|Dataset|Approach|Framework)(?:Description|Features|Data|Used)")
    )


def joined_rollup(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """JOIN-05: training samples with their label: by document id, and those that carry one themselves.
    ``samples``: (document_id, text, label or null); ``labels``: (document_id, category)."""
    by_id = samples.where("label IS NULL").join(labels.dropDuplicates(["document_id"]), "document_id").select("document_id", F.col("category").alias("label"), F.lit("joined").alias("how"))
    return by_id.unionByName(samples.where("label IS NOT NULL").select("document_id", "label", F.lit("own").alias("how")))
