"""Retrieval units: fixed token windows, atomic paragraphs and packages; links, leakage and evidence mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_windows(n: Column, size: int = 512, overlap: int = 64) -> Column:
    """Starts of sliding windows over ``n`` tokens: a window starts unless the one before already reached the end."""
    step = size - overlap
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.filter(starts, lambda s: (s == 0) | (s + overlap < n))


def paragraph_spans(paras: DataFrame, tokens: Column) -> DataFrame:
    """Token offsets [t0, t1) of each paragraph in its document's stream."""
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    out = paras.withColumn("tokens", tokens)
    end = F.sum("tokens").over(w)
    return out.withColumn("t1", end).withColumn("t0", F.col("t1") - F.col("tokens"))


def fixed_units(spans: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Fixed windows with the paragraphs they overlap, and how many lie wholly inside.

    Windows that a paragraph can meet are computed from its own offsets, so the interval join is an expansion of the
    paragraph by its few windows and one aggregation.
    """
    step = size - overlap
    total = F.max("t1").over(Window.partitionBy("doc_id"))
    rows = spans.withColumn("total", total).filter("tokens > 0")
    first = F.greatest(F.lit(0), F.ceil((F.col("t0") - size + 1) / step)).cast("long")
    last = F.floor((F.col("t1") - 1) / step).cast("long")
    each = rows.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    each = each.withColumn("start", F.col("k") * step).filter((F.col("start") == 0) | (F.col("start") + overlap < F.col("total")))
    each = each.withColumn("end", F.least(F.col("start") + size, F.col("total"))).filter((F.col("t0") < F.col("end")) & (F.col("start") < F.col("t1")))
    whole = (F.col("t0") >= F.col("start")) & (F.col("t1") <= F.col("end"))
    g = each.groupBy("doc_id", "k").agg(F.max(F.col("end") - F.col("start")).alias("token_count"), F.count("*").alias("n_overlapping"), F.count_if(whole).alias("n_whole"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))
    uid = F.concat(F.col("doc_id").cast("string"), F.lit("::B1::"), F.lpad(F.col("k").cast("string"), 5, "0"))
    return g.withColumn("unit_id", uid)


def atomic_units(paras: DataFrame, section: Column) -> DataFrame:
    """A unit per paragraph, its text led by its section."""
    text = F.concat(F.lit("[Section] "), section, F.lit("\n[Paragraph] "), F.col("clean_text"))
    return paras.select("doc_id", "position", F.concat(F.col("paragraph_id"), F.lit("::B2")).alias("unit_id"), text.alias("text"))


def package_units(paras: DataFrame, section: Column) -> DataFrame:
    """A unit per anchor paragraph with the paragraphs before and after it in its section as supports.

    A paragraph without a section is a group of its own.
    """
    rows = paras.withColumn("section", section)
    own = F.coalesce(F.col("section"), F.concat(F.lit("alone:"), F.col("position").cast("string")))
    w = Window.partitionBy("doc_id", own).orderBy("position")
    rows = rows.withColumn("before", F.lag("clean_text").over(w)).withColumn("after", F.lead("clean_text").over(w))
    text = F.concat_ws("\n", F.concat(F.lit("[Section] "), F.col("section")), F.concat(F.lit("[Support] "), F.col("before")), F.concat(F.lit("[Anchor] "), F.col("clean_text")), F.concat(F.lit("[Support] "), F.col("after")))
    n = F.col("before").isNotNull().cast("long") + F.col("after").isNotNull().cast("long")
    return rows.select("doc_id", "position", F.concat(F.col("paragraph_id"), F.lit("::B3")).alias("unit_id"), text.alias("text"), n.alias("n_supports"))


def object_labels(c: Column) -> Column:
    """Labels such as ``figure 3`` or ``table 2`` that a text mentions, distinct and sorted."""
    kinds = {"figure": r"\bfig(?:ure|s)?\.?\s*([0-9]+)", "table": r"\btab(?:le)?\.?\s*([0-9]+)", "formula": r"\b(?:eq(?:uation)?|formula)\.?\s*([0-9]+)"}

    def found(kind: str) -> Column:
        return F.transform(F.regexp_extract_all(F.lower(c), F.lit(kinds[kind]), 1), lambda x: F.concat(F.lit(kind + " "), x))

    return F.array_sort(F.array_distinct(F.concat(*map(found, kinds))))


def linked_objects(anchors: DataFrame, objects: DataFrame, gap: float = 120.0) -> DataFrame:
    """Anchor-object links by equal label, or for formulas by nearness on a page: two equi-joins and a union.

    anchors: doc_id, anchor_id, labels, page, y0, y1, cue (mentions a formula); objects: doc_id, object_id, label,
    kind, page, y0, y1.
    """
    by_label = anchors.select("doc_id", "anchor_id", F.explode("labels").alias("label")).join(objects.select("doc_id", "object_id", "label"), ["doc_id", "label"]).select("doc_id", "anchor_id", "object_id")
    a, o = anchors.filter("cue").alias("a"), objects.filter("kind = 'formula'").alias("o")
    near = a.join(o, (F.col("a.doc_id") == F.col("o.doc_id")) & (F.col("a.page") == F.col("o.page")))
    distance = F.greatest(F.lit(0.0), F.col("o.y0") - F.col("a.y1"), F.col("a.y0") - F.col("o.y1"))
    by_place = near.filter(distance <= gap).select(F.col("a.doc_id").alias("doc_id"), "a.anchor_id", "o.object_id")
    return by_label.unionByName(by_place).dropDuplicates()


def similar_texts(left: DataFrame, right: DataFrame, threshold: float = 0.9, min_tokens: int = 5) -> DataFrame:
    """Best Jaccard match of each left row (id, tokens: distinct array) among right rows, at or above a threshold.

    Prefix filter on the left, smaller, side: of any ``n - ceil(t n) + 1`` tokens of a left set at least one is in every set
    that is ``t`` alike.  Its rarest tokens are taken, by their frequency on the right, which is counted for tokens of the
    left alone; so of the right side's tokens only those rows are shuffled that meet such a token, and frequent ones never
    become keys.  Sizes must agree too.
    """
    l, r = left.filter(F.size("tokens") >= min_tokens), right.filter(F.size("tokens") >= min_tokens)
    words = l.select(F.explode("tokens").alias("token"))
    frequent = r.select(F.explode("tokens").alias("token")).join(words.distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    each = l.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(frequent, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ordered = each.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("o"))
    keep = F.slice("o", F.lit(1), F.col("n") - F.ceil(F.lit(threshold) * F.col("n")).cast("int") + 1)
    rare = ordered.select(F.col("id").alias("l_id"), F.col("n").alias("ln"), F.explode(keep).alias("x")).select("l_id", "ln", "x.token")
    near = (F.col("rn") >= threshold * F.col("ln") - 1e-9) & (F.col("ln") >= threshold * F.col("rn") - 1e-9)
    pairs = r.select(F.col("id").alias("r_id"), F.size("tokens").alias("rn"), F.explode("tokens").alias("token")).join(rare, "token").filter(near).select("l_id", "r_id").distinct()
    full = pairs.join(l.select(F.col("id").alias("l_id"), F.col("tokens").alias("lt")), "l_id").join(r.select(F.col("id").alias("r_id"), F.col("tokens").alias("rt")), "r_id")
    both = F.size(F.array_intersect("lt", "rt"))
    jaccard = both / (F.size("lt") + F.size("rt") - both)
    scored = full.select("l_id", "r_id", jaccard.alias("jaccard")).filter(F.col("jaccard") >= threshold)
    best = scored.groupBy("l_id").agg(F.max_by(F.struct("r_id", "jaccard"), F.struct("jaccard", -F.col("r_id"))).alias("b"))
    return best.select("l_id", "b.r_id", "b.jaccard")


def passages(docs: DataFrame, items: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, evidence_id, e0, e1): where documents (doc_id, text) first hold the passages (item_id, passage) of at least ``words + 1`` words.

    The words after the first of a passage are looked up among the word runs of each document, of which only those that some
    passage has are kept; pairs found so are verified on the text.
    """
    split = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    w = split(F.col("passage"))
    wanted = items.filter(F.size(w) > words).select("item_id", "passage", F.xxhash64(F.array_join(F.slice(w, 2, words), " ")).alias("h"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - (words - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " ")))
    each = docs.select("doc_id", split(F.col("text")).alias("w")).filter(F.size("w") >= words).select("doc_id", F.explode(F.array_distinct(runs)).alias("h"))
    pairs = each.join(wanted.select("h", "item_id"), "h").select("doc_id", "item_id").distinct()
    held = docs.join(pairs, "doc_id").join(wanted.select("item_id", "passage"), "item_id").withColumn("e0", F.instr("text", F.col("passage")) - 1).filter("e0 >= 0")
    return held.select("doc_id", F.col("item_id").alias("evidence_id"), "e0", (F.col("e0") + F.char_length("passage")).alias("e1"))


def evidence_class(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each evidence span [e0, e1) of a document as ``fully`` in one chunk, over ``multi`` chunks, or ``unmapped``."""
    j = evidence.join(chunks, "doc_id", "left")
    inside = (F.col("c0") <= F.col("e0")) & (F.col("e1") <= F.col("c1"))
    meets = (F.col("c0") < F.col("e1")) & (F.col("e0") < F.col("c1"))
    g = j.groupBy("doc_id", "evidence_id").agg(F.count_if(inside).alias("n_inside"), F.count_if(meets).alias("n_meets"))
    return g.withColumn("class", F.when(F.col("n_inside") > 0, "fully").when(F.col("n_meets") > 0, "multi").otherwise("unmapped"))


def section_of(position: Column, per: int = 4) -> Column:
    """The stand-in section of a line: every ``per`` lines."""
    return F.concat(F.lit("s"), F.floor(position / per).cast("string"))

