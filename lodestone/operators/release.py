"""Checks of tables before release: drift, pairing, prefixes, provenance, schemas, metadata and document metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

# Fields that every document must have, its lists, and the id of the elements of each.
DOCUMENT_FIELDS = ("doc_id", "source_id", "title")
LISTS = {"sections": "section_id", "paragraphs": "paragraph_id", "objects": "object_id"}


def drift(actual: DataFrame, expected: DataFrame, keys: list[str], values: list[str], tolerance: float = 5e-7) -> DataFrame:
    """(keys .., field, actual, expected, within) of every value; a row that one side lacks is not within."""
    a = actual.select(*keys, *[F.col(v).cast("double").alias(f"a_{v}") for v in values], F.lit(True).alias("has_a"))
    e = expected.select(*keys, *[F.col(v).cast("double").alias(f"e_{v}") for v in values], F.lit(True).alias("has_e"))
    j = a.join(e, keys, "full")
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("field"), F.col(f"a_{v}").alias("actual"), F.col(f"e_{v}").alias("expected")) for v in values])).alias("x")
    both = F.col("has_a") & F.col("has_e")
    rows = j.select(*keys, F.coalesce(both, F.lit(False)).alias("both"), each).select(*keys, "both", "x.*")
    near = F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= tolerance, F.col("actual").isNull() & F.col("expected").isNull())
    return rows.select(*keys, "field", "actual", "expected", (F.col("both") & near).alias("within"))


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: whether two sides hold the same ids, each once, so that they can be compared item by item."""
    side = lambda d, n: d.groupBy(F.col(key).alias("key")).agg(F.count("*").alias(n))
    j = side(a, "na").join(side(b, "nb"), "key", "full")
    n = j.agg(
        F.coalesce(F.sum("na"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("nb"), F.lit(0)).alias("n_b"), F.count_if(F.col("na").isNotNull() & F.col("nb").isNotNull()).alias("n_both"),
        F.count_if(F.col("nb").isNull()).alias("only_a"), F.count_if(F.col("na").isNull()).alias("only_b"), F.count_if((F.col("na") > 1) | (F.col("nb") > 1)).alias("n_repeated"),
    )
    return n.withColumn("aligned", (F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.col("n_repeated") == 0))


def prefixes(pools: DataFrame, scale: str, ordinal: str, item: str) -> DataFrame:
    """(scale, larger, n, n_equal, is_prefix): whether each pool is the head of the next larger one."""
    scales = pools.groupBy(scale).agg(F.count("*").alias("n")).withColumn("larger", F.lead(scale).over(Window.orderBy(scale)))
    scales = scales.filter("larger is not null")
    small = pools.join(F.broadcast(scales), scale).select(scale, "larger", "n", ordinal, item)
    big = pools.select(F.col(scale).alias("larger"), ordinal, item, F.lit(1).alias("hit"))
    j = small.join(big, ["larger", ordinal, item], "left").groupBy(scale, "larger", "n").agg(F.count("hit").alias("n_equal"))
    return j.withColumn("is_prefix", F.col("n") == F.col("n_equal"))


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row that a many-to-one join must satisfy: rows, rows without a match, and right keys that are not unique."""
    r = right.groupBy(*keys).agg(F.count("*").alias("_k"))
    j = left.select(*keys).join(r, keys, "left").agg(F.count("*").alias("n_left"), F.count_if(F.col("_k").isNull()).alias("n_unmatched"))
    dup = r.agg(F.count_if(F.col("_k") > 1).alias("n_duplicate_keys"))
    return j.crossJoin(F.broadcast(dup)).withColumn("passed", F.col("n_duplicate_keys") == 0)


def complete_provenance(p: str = "") -> Column:
    """Eight conditions on paragraph_id, page, bbox, source_file, source_page, source_bbox, parser_source, source_index."""
    c = lambda n: F.col(p + n)
    filled = lambda n: F.coalesce(c(n).cast("string") != "", F.lit(False))
    box = lambda n: F.coalesce(F.size(c(n)) == 4, F.lit(False))
    return filled("paragraph_id") & c("page").isNotNull() & box("bbox") & filled("source_file") & c("source_page").isNotNull() & box("source_bbox") & filled("parser_source") & c("source_index").isNotNull()


def has_source(p: str = "") -> Column:
    """The weaker definition: a source file is named."""
    return F.coalesce(F.col(p + "source_file") != "", F.lit(False))


def metadata(json: Column) -> list[Column]:
    """title, authors (names that are not empty) and version_id of a semantic record."""
    get = lambda path: F.get_json_object(json, path)
    people = F.from_json(get("$.record.content.contributor"), "array<struct<name:string>>")
    names = F.filter(F.transform(F.coalesce(people, F.array().cast("array<struct<name:string>>")), lambda x: F.trim(x["name"])), lambda x: x.isNotNull() & (x != ""))
    return [get("$.record.content.title").alias("title"), names.alias("authors"), F.nullif(F.trim(get("$.record.identifier")), F.lit("")).alias("version_id")]


def _list_errors(name: str, key: str) -> list[Column]:
    """Arrays of the errors of one list of elements."""
    bare = F.transform(name, lambda x, i: F.when(x["provenance"].isNull(), F.concat(F.lit(name + "["), i.cast("string"), F.lit("] missing provenance"))))
    ids = F.filter(F.transform(name, lambda x: x[key]), lambda x: x.isNotNull())
    twice = F.when(F.size(ids) != F.size(F.array_distinct(ids)), f"duplicate {key}")
    return [F.array(F.when(F.col(name).isNull(), f"{name} must be a list")), F.coalesce(bare, F.array().cast("array<string>")), F.array(twice)]


def document_errors(docs: DataFrame) -> DataFrame:
    """(doc_id, errors, n_errors) of nested documents: missing fields, lists that are absent, elements without provenance, repeated ids."""
    found: list[Column] = [F.array(F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", f"missing {f}")) for f in DOCUMENT_FIELDS]
    for name, key in LISTS.items():
        found += _list_errors(name, key)
    errors = F.array_compact(F.concat(*found))
    return docs.select("doc_id", F.array_join(errors, "; ").alias("errors"), F.size(errors).cast("long").alias("n_errors"))


def document_metrics(docs: DataFrame) -> DataFrame:
    """The 28 metrics of nested documents (sections, paragraphs, objects, uncertain_elements, title, abstract, ..), one row each, without a shuffle.

    paragraphs: section_id, raw_text, clean_text, page, bbox, source_file; objects: kind, caption, table_html, formula_latex,
    page, bbox, source_file.
    """
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    count = lambda c, f: n(F.filter(c, lambda x: F.coalesce(f(x), F.lit(False))))
    total = lambda c, f: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.char_length(f(x))), F.lit(0))
    kind = lambda k: (lambda x: x["kind"] == k)
    filled = lambda f: (lambda x: x[f] != "")
    here = lambda f: (lambda x: x[f].isNotNull())
    both = lambda f, g: (lambda x: f(x) & g(x))
    sourced = lambda x: (x["source_file"] != "") & x["page"].isNotNull() & x["bbox"].isNotNull()
    p, o = "paragraphs", "objects"
    some = lambda c: F.coalesce(F.col(c) != "", F.lit(False)).cast("int")
    known = ("figure", "table", "formula")
    return docs.select(
        "doc_id", "source_id", "parser_source", some("title").alias("title_available"), some("abstract").alias("abstract_available"), n("sections").alias("section_count"),
        n(p).alias("body_paragraph_count"), total(p, lambda x: x["raw_text"]).alias("body_raw_character_count"), total(p, lambda x: x["clean_text"]).alias("body_clean_character_count"),
        count(p, here("section_id")).alias("paragraphs_with_section"), T.round6(F.try_divide(count(p, here("section_id")).cast("double"), F.nullif(n(p), F.lit(0)))).alias("paragraph_section_coverage"),
        count(p, lambda x: T.word_split_suspected(x["clean_text"])).alias("suspected_word_split_paragraphs"), *[count(o, kind(k)).alias(f"{k}_count") for k in known],
        count(o, lambda x: ~x["kind"].isin(*known)).alias("other_object_count"), *[count(o, both(kind(k), filled("caption"))).alias(f"{k}_caption_count") for k in ("figure", "table")],
        count(o, both(kind("table"), filled("table_html"))).alias("table_html_count"), count(o, both(kind("formula"), filled("formula_latex"))).alias("formula_latex_count"),
        *[count(c, here(f)).alias(f"{c[:-1]}_{f}_count") for c in (p, o) for f in ("page", "bbox")], (count(p, sourced) + count(o, sourced)).alias("provenance_count"),
        (n(p) + n(o)).alias("canonical_element_count"), n("uncertain_elements").alias("uncertain_element_count"), "excluded_counts_json",
    )


def extension_scales(capacity: Column, steps: tuple[int, ...] = (3000, 4000), floor: int = 2000) -> Column:
    """The scales above ``floor`` at which a task of a capacity is extended: the steps that fit, or the capacity itself."""
    first, second = steps
    out = F.when(capacity >= second, F.array(F.lit(first), F.lit(second))).when(capacity > first, F.array(F.lit(first), capacity.cast("int"))).otherwise(F.array(capacity.cast("int")))
    return F.filter(out, lambda x: x > floor)


def json_bytes(*columns: str) -> Column:
    """Bytes of a row as one line of JSON, its line feed included."""
    return (F.octet_length(F.to_json(F.struct(*columns))) + 1).cast("long")


def occurrences(text: Column, term: Column) -> Column:
    """Offsets of a term in a text, left to right, none overlapping."""
    parts = F.split(text, F.concat(F.lit("\\Q"), term, F.lit("\\E")))
    heads = F.slice(parts, 1, F.size(parts) - 1)
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(heads, start, lambda s, p: F.struct((s["next"] + F.char_length(p) + F.char_length(term)).alias("next"), F.concat(s["out"], F.array(s["next"] + F.char_length(p))).alias("out")), lambda s: s["out"])


def nearest(text: Column, term: Column, at: Column) -> Column:
    """Offset of the occurrence of a term nearest to a place, the earlier of two; NULL where there is none."""
    best = F.array_min(F.transform(occurrences(text, term), lambda x: F.struct(F.abs(x - at).alias("gap"), x.alias("at"))))
    return best["at"]
