"""Instances from verified candidates: uniqueness, context crops, integrity and evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.corpus import first_failing
from lodestone.operators.scaling import crop
from lodestone.operators.selection import hash_order, keep_first


def materialize(candidates: DataFrame, counts_as: Column, seed: str, context_tokens: int = 64) -> DataFrame:
    """Instances with exclusion reasons.

    candidates: doc_id, position, start, end, text, answer, ready.  A paragraph whose candidates that ``counts_as``
    are several is ambiguous; a context is the words around the answer, cropped to ``context_tokens``; of equal
    (context, answer) the first in hash order stays.
    """
    n = F.sum(F.coalesce(counts_as, F.lit(False)).cast("long")).over(Window.partitionBy("doc_id", "position"))
    words = F.split("text", " ")
    rows = candidates.withColumn("n_same", n).withColumn("_w", words)
    lo = F.size(F.split(F.substring(F.col("text"), F.lit(1), F.col("start")), " ")) - 1
    hi = lo + F.size(F.split("answer", " "))
    rows = rows.withColumn("_at", crop(F.col("_w"), lo, hi, context_tokens))
    context = F.array_join(F.slice("_w", F.col("_at.start") + 1, F.col("_at.end") - F.col("_at.start")), " ")
    rows = rows.withColumn("context", F.when(F.col("_at").isNotNull(), context))
    rules = {
        "not_ready": ~F.col("ready"),
        "span_not_traceable": ~T.valid_span(F.col("text"), F.col("start"), F.col("end"), F.col("answer")),
        "ambiguous_in_paragraph": F.col("n_same") > 1,
        "answer_longer_than_context": F.col("_at").isNull(),
        "answer_lost_in_crop": ~F.contains(F.col("context"), F.col("answer")),
    }
    out = rows.withColumn("exclusion", first_failing(rules)).withColumn("instance_id", T.stable_id("inst", F.col("doc_id"), F.col("position"), F.col("start"), F.col("answer")))
    order = Window.partitionBy("context", "answer", F.col("exclusion").isNull()).orderBy(hash_order(seed, F.col("instance_id")), "instance_id")
    again = F.col("exclusion").isNull() & (F.row_number().over(order) > 1)
    return out.withColumn("exclusion", F.when(again, "duplicate_context").otherwise(F.col("exclusion"))).drop("_w", "_at")


def evaluation_set(instances: DataFrame, seed: str, size: int) -> DataFrame:
    """One instance per document in hash order, the first ``size`` documents in hash order."""
    one = keep_first(instances.filter("exclusion is null"), ["doc_id"], [hash_order(seed, F.col("instance_id")), F.asc("instance_id")])
    return one.orderBy(hash_order(seed, F.col("doc_id")), "doc_id").limit(size)


def unique_anchor(text: Column, start: Column, words: int = 8) -> Column:
    """The ``words`` words before a span if they occur once in the text, else NULL."""
    head = F.split(F.rtrim(F.substring(text, F.lit(1), start)), " ")
    anchor = F.array_join(F.slice(head, F.greatest(F.lit(1), F.size(head) - words + 1), words), " ")
    once = (F.char_length(text) - F.char_length(F.replace(text, anchor, F.lit("")))) == F.char_length(anchor)
    return F.when((anchor != "") & once, anchor)
