"""Checks before release, document metrics, and small exact cases with their expected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import extras as X
from lodestone.operators import materialize as M
from lodestone.operators import release as R
from lodestone.operators import scaling as G
from lodestone.operators import selection as S
from lodestone.operators import units as U
from lodestone.plans.registry import Registry, table
from lodestone.plans.selection_queries import POOLS, TASKS, YIELDS, yields
from lodestone.plans.verification_queries import _values
from lodestone.shipping import ship

query = Registry()
R6 = "floor(({0})::DOUBLE * 1e6 + 0.5) / 1e6"


@query("tolerance_check", """WITH a AS (SELECT o_orderstatus AS status, avg(o_totalprice) / 1e5 AS price, count(*)::DOUBLE AS n FROM orders GROUP BY 1)
  SELECT status, 'price' AS field, status <> 'O' AS within FROM a UNION ALL SELECT status, 'n', status <> 'P' FROM a UNION ALL SELECT 'X', unnest(['price', 'n']), false""")
def tolerance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputed figures against recorded ones, of which some have drifted and one row is extra."""
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg((F.avg("o_totalprice") / 1e5).alias("price"), F.count("*").cast("double").alias("n"))
    price = F.col("price") + F.when(F.col("status") == "O", 1e-5).otherwise(1e-9)
    e = a.select("status", price.alias("price"), (F.col("n") + F.when(F.col("status") == "P", 1).otherwise(0)).alias("n"))
    e = e.unionByName(spark.createDataFrame([("X", 1.0, 1.0)], "status string, price double, n double"))
    return R.drift(a, e, ["status"], ["price", "n"]).select("status", "field", "within")


@query("paired_alignment", """WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT c_custkey AS k FROM customer), x AS (SELECT k, count(*) AS na FROM a GROUP BY k), y AS (SELECT k, count(*) AS nb FROM b GROUP BY k), j AS (SELECT na, nb FROM x FULL JOIN y USING (k))
  SELECT sum(na)::BIGINT AS n_a, sum(nb)::BIGINT AS n_b, count(*) FILTER (na IS NOT NULL AND nb IS NOT NULL) AS n_both, count(*) FILTER (nb IS NULL) AS only_a, count(*) FILTER (na IS NULL) AS only_b, count(*) FILTER (na > 1 OR nb > 1) AS n_repeated,
  count(*) FILTER (na IS NULL OR nb IS NULL OR na > 1 OR nb > 1) = 0 AS aligned FROM j""")
def paired_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a third of the orders against all customers: ids that pair, and those that do not."""
    a = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("k"))
    return R.paired(a, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("prefix_equality", f"WITH {POOLS}, s AS (SELECT scale, lead(scale) OVER (ORDER BY scale) AS larger, count(*) AS n FROM pools GROUP BY scale), j AS (SELECT s.scale, s.larger, s.n, count(q.doc_id) AS n_equal FROM s JOIN pools p ON p.scale = s.scale LEFT JOIN pools q ON q.scale = s.larger AND q.ordinal = p.ordinal AND q.doc_id = p.doc_id WHERE s.larger IS NOT NULL GROUP BY ALL) SELECT scale::BIGINT AS scale, larger::BIGINT AS larger, n, n_equal, n = n_equal AS is_prefix FROM j")
def prefix_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each nested pool is the head of the next."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    return R.prefixes(S.nested_pools(S.round_robin(docs, "source", "doc_id", "pool", 30), [100, 250, 500]), "scale", "ordinal", "doc_id")


@query("many_to_one_check", "SELECT count(*) AS n_left, count(*) FILTER (c_custkey IS NULL) AS n_unmatched, 0::BIGINT AS n_duplicate_keys, true AS passed FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def many_to_one_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to customers as a many-to-one join."""
    return R.many_to_one(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), ["k"])


@query("prefix_sample", "SELECT doc_id FROM documents ORDER BY sha256('sample|' || doc_id), doc_id LIMIT 150")
def prefix_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample that is a prefix of every larger one."""
    return S.prefix_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "sample", 150)


@query("provenance_complete", """SELECT lang, count(*) AS n, count(*) FILTER (doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND coalesce(source, '') <> '' AND doc_id % 13 <> 0) AS n_complete, count(*) FILTER (coalesce(source, '') <> '') AS n_sourced FROM documents GROUP BY lang""")
def provenance_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with complete provenance, and with a source at all (pages, boxes and indices stand in)."""
    i = F.col("doc_id")
    box = F.when(i % 7 != 0, F.array(*[F.lit(0.0)] * 4)).otherwise(F.array(F.lit(0.0)))
    d = table(spark, sf_dir, "documents").select("lang", i.cast("string").alias("paragraph_id"), F.when(i % 11 != 0, i).alias("page"), box.alias("bbox"), F.col("source").alias("source_file"), i.alias("source_page"), box.alias("source_bbox"), F.lit("flat").alias("parser_source"), F.when(i % 13 != 0, i).alias("source_index"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(R.complete_provenance()).alias("n_complete"), F.count_if(R.has_source()).alias("n_sourced"))


@query("extract_metadata", "SELECT doc_id, lang || ' ' || doc_id AS title, CASE WHEN source IS NULL OR source = '' THEN 'Second Name' ELSE source || '|Second Name' END AS authors, CASE WHEN doc_id % 5 = 0 THEN 'none' ELSE 'v' || doc_id END AS version_id FROM documents")
def extract_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, authors and version of semantic records in JSON."""
    name = lambda c: F.struct(c.alias("name"))
    people = F.array(name(F.col("source")), name(F.lit(" Second Name ")), name(F.lit(None).cast("string")), name(F.lit(" ")))
    content = F.struct(F.concat_ws(" ", "lang", "doc_id").alias("title"), people.alias("contributor"))
    version = F.when(F.col("doc_id") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("v"), F.col("doc_id")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.struct(content.alias("content"), version.alias("identifier")).alias("record"))).alias("j"))
    return d.select("doc_id", *R.metadata(F.col("j"))).withColumn("authors", F.array_join("authors", "|")).withColumn("version_id", F.coalesce("version_id", F.lit("none")))


_ITEM = "array<struct<{0}:string,provenance:string>>"
NESTED = [
    ("a", "s", "t", [("s1", "x")], [("p1", "x"), ("p2", "x")], [], "", 0),
    ("b", "", None, [("s1", None)], [("p1", "x"), ("p1", "x")], [("o1", "x"), (None, None)], "missing source_id; missing title; sections[0] missing provenance; duplicate paragraph_id; objects[1] missing provenance", 5),
    ("c", "s", "t", None, [], None, "sections must be a list; objects must be a list", 2),
]


@query("document_schema", f"SELECT * FROM ({_values([(r[0], r[6], r[7]) for r in NESTED])}) AS t(doc_id, errors, n_errors)")
def document_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error lists of hand-made nested documents."""
    kinds = ", ".join(f"{k} {_ITEM.format(v)}" for k, v in R.LISTS.items())
    return R.document_errors(spark.createDataFrame([r[:6] for r in NESTED], f"doc_id string, source_id string, title string, {kinds}"))


_PARA, _OBJ = "section_id string, raw_text string, clean_text string, page int, bbox array<double>, source_file string", "kind string, caption string, table_html string, formula_latex string, page int, bbox array<double>, source_file string"
_BOX = [0.0, 0.0, 1.0, 1.0]
METRICS = [
    ("a", "s", "flat", "T", None, ["s1", "s2"], [("s1", "raw  one", "raw one", 1, _BOX, "f"), (None, "two", "two", None, None, "f"), ("s2", "meas- ured value", "meas- ured value", 2, None, None)],
     [("figure", "c", None, None, 1, _BOX, "f"), ("table", "", "<t>", None, None, _BOX, "f"), ("formula", None, None, "x^2", 1, None, "f"), ("chart", None, None, None, 3, _BOX, "")], ["u"], '{"nav":2}'),
    ("b", "s", "paged", "", "abs", [], [], [], [], "{}"),
]
WANTED = [
    ("a", "s", "flat", 1, 0, 2, 3, 27, 26, 2, 0.666667, 1, 1, 1, 1, 1, 1, 0, 1, 1, 2, 1, 3, 3, 2, 7, 1, '{"nav":2}'),
    ("b", "s", "paged", 0, 1, 0, 0, 0, 0, 0, None, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, "{}"),
]
_FIELDS = "doc_id source_id parser_source title_available abstract_available section_count body_paragraph_count body_raw_character_count body_clean_character_count paragraphs_with_section paragraph_section_coverage suspected_word_split_paragraphs figure_count table_count formula_count other_object_count figure_caption_count table_caption_count table_html_count formula_latex_count paragraph_page_count paragraph_bbox_count object_page_count object_bbox_count provenance_count canonical_element_count uncertain_element_count excluded_counts_json".split()


@query("document_metrics", f"SELECT * FROM ({_values(WANTED)}) AS t({', '.join(_FIELDS)})")
def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 28 metrics of hand-made nested documents."""
    as_struct = lambda s: "array<struct<" + ",".join(":".join(x.split()) for x in s.split(", ")) + ">>"
    schema = f"doc_id string, source_id string, parser_source string, title string, abstract string, sections array<string>, paragraphs {as_struct(_PARA)}, objects {as_struct(_OBJ)}, uncertain_elements array<string>, excluded_counts_json string"
    return R.document_metrics(spark.createDataFrame(METRICS, schema))


@query("extension_scales", "WITH n AS (SELECT lang, count(*) * 10 AS n FROM documents GROUP BY lang) SELECT lang, CASE WHEN n >= 4000 THEN '3000,4000' WHEN n > 3000 THEN '3000,' || n WHEN n > 2000 THEN n::VARCHAR ELSE '' END AS scales FROM n")
def extension_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales at which each language could be extended."""
    n = table(spark, sf_dir, "documents").groupBy("lang").agg((F.count("*") * 10).alias("n"))
    return n.select("lang", F.array_join(R.extension_scales(F.col("n")), ",").alias("scales"))


@query("json_bytes", """SELECT coalesce(lang, 'none') AS lang, sum(strlen(to_json({'doc_id': doc_id, 'n_chars': n_chars})) + 1)::BIGINT AS bytes FROM documents WHERE n_chars IS NOT NULL GROUP BY 1""")
def json_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical JSON lines size by language."""
    d = table(spark, sf_dir, "documents").filter("n_chars is not null")
    return d.groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.sum(R.json_bytes("doc_id", "n_chars")).alias("bytes"))


ANCHORS = [(1, 1, "See figure 2 and Eq. 4 here.", 1, 100.0, 120.0), (1, 2, "The formula below holds.", 1, 300.0, 320.0), (2, 3, "Table 7 lists them.", 2, 0.0, 9.0), (1, 4, "Nothing.", 1, 100.0, 120.0)]
OBJECTS = [(1, 10, "Figure 2: shown", "figure", 1, 500.0, 600.0), (1, 11, "x = y", "formula", 1, 430.0, 440.0), (1, 12, "z = w", "formula", 1, 441.0, 450.0), (2, 13, "Tab. 7", "table", 9, 0.0, 1.0), (1, 14, "Equation 4", "formula", 2, 0.0, 1.0)]
LINKS = [(1, 1, 10), (1, 1, 14), (1, 2, 11), (2, 3, 13)]


@query("linked_objects", f"SELECT * FROM ({_values(LINKS)}) AS t(doc_id, anchor_id, object_id)")
def linked_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-made anchors linked to objects by label, or to formulas by nearness where they mention one."""
    a = spark.createDataFrame(ANCHORS, "doc_id int, anchor_id int, text string, page int, y0 double, y1 double")
    o = spark.createDataFrame(OBJECTS, "doc_id int, object_id int, text string, kind string, page int, y0 double, y1 double")
    a = a.select("*", U.object_labels(F.col("text")).alias("labels"), F.col("text").rlike(r"(?i)\bformula\b").alias("cue"))
    o = o.select("*", F.get(U.object_labels(F.col("text")), F.lit(0)).alias("label"))
    return U.linked_objects(a, o)


NORMAL = [("ﬁne  Text\n", "fine Text", "ﬁne Text", "fine text", "fine text"), (" STRASSE Straße ", "STRASSE Straße", "STRASSE Straße", "strasse strasse", "strasse strasse"), ("", "", "", "", "")]


@query("text_normalizers", f"SELECT * FROM ({_values([(i, *r[1:]) for i, r in enumerate(NORMAL)])}) AS t(id, compat, plain, compat_folded, plain_folded)")
def text_normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four normal forms of hand-made texts, which are not the same."""
    ship(spark)
    d = spark.createDataFrame([(i, r[0]) for i, r in enumerate(NORMAL)], "id int, x string")
    n = lambda compat, fold: T.normal_form(F.col("x"), compat, fold)
    return d.select("id", n(True, False).alias("compat"), n(False, False).alias("plain"), n(True, True).alias("compat_folded"), n(False, True).alias("plain_folded"))


SPANS = [("TOC rose. The TOC fell and TOC (x) rose.", "TOC", 20, 14), ("a.b a.b", "a.b", 2, 0), ("none here", "zzz", 3, None)]


@query("nearest_terms", f"SELECT * FROM ({_values([(i, r[3]) for i, r in enumerate(SPANS)])}) AS t(id, found_at)")
def nearest_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The occurrence of a term nearest to a place."""
    d = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(SPANS)], "id int, x string, term string, place int")
    return d.select("id", R.nearest(F.col("x"), F.col("term"), F.col("place")).alias("found_at"))


PREFIX = [("one two three four five six seven eight nine 12", 45, "two three four five six seven eight nine"), ("a b a b a b a b x 1 a b a b a b a b x 1", 18, None), ("9 first", 0, None)]


@query("prefix_anchors", f"SELECT id, coalesce(anchor, 'none') AS anchor FROM ({_values([(i, r[2]) for i, r in enumerate(PREFIX)])}) AS t(id, anchor)")
def prefix_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight words before a span where they occur once."""
    d = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(PREFIX)], "id int, x string, place int")
    return d.select("id", F.coalesce(M.unique_anchor(F.col("x"), F.col("place")), F.lit("none")).alias("anchor"))


@query("template_variable", r"""SELECT conv_id, turn, regexp_extract(coalesce(text, ''), '\b(?:de|of|the|la|der|die|el)\s+([A-Za-z]{3,})', 1) AS variable,
  CASE WHEN regexp_extract(coalesce(text, ''), '\b(?:de|of|the|la|der|die|el)\s+([A-Za-z]{3,})', 1) <> '' AND role IN ('user', 'assistant', 'system') THEN CASE role WHEN 'user' THEN 'Answer: ' WHEN 'assistant' THEN 'Check: ' ELSE 'Follow: ' END || regexp_extract(coalesce(text, ''), '\b(?:de|of|the|la|der|die|el)\s+([A-Za-z]{3,})', 1) ELSE 'none' END AS instruction FROM conversations""")
def template_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variable that a pattern extracts from each turn, and the template filled with it; ``none`` where there is none."""
    v = F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), r"\b(?:de|of|the|la|der|die|el)\s+([A-Za-z]{3,})", 1), F.lit(""))
    return table(spark, sf_dir, "conversations").withColumn("variable", v).select("conv_id", "turn", F.coalesce("variable", F.lit("")).alias("variable"), F.coalesce(F.when(F.col("variable").isNotNull(), G.rendered(F.col("role"), F.col("variable"), 0)), F.lit("none")).alias("instruction"))


@query("poisson_null_fit", f"""WITH {YIELDS}, m AS (SELECT task, n, tokens, sum(n) OVER (PARTITION BY task) / sum(tokens) OVER (PARTITION BY task) * tokens AS mu, sum(n) OVER (PARTITION BY task) / sum(tokens) OVER (PARTITION BY task) AS r FROM yields WHERE tokens > 0)
  SELECT task, count(*) AS n, {R6.format('ln(max(r))')} AS intercept, {R6.format('sum((n - mu) * (n - mu) / mu) / (count(*) - 1)')} AS dispersion FROM m GROUP BY task""")
def poisson_null_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poisson regression of yields on nothing but exposure, against its closed form."""
    y = yields(spark, sf_dir).filter("tokens > 0").select("task", F.col("n").cast("double").alias("n"), F.col("tokens").cast("double").alias("tokens"))
    return X.fit_poisson(y, "task", [], "n", "tokens").select("task", "n_rows", T.round6(F.col("estimate")).alias("intercept"), T.round6(F.col("dispersion")).alias("dispersion")).withColumnRenamed("n_rows", "n")


_TWO = "t AS (SELECT task, n > 10 AS hit, p_size > 25 AS big FROM yields JOIN part ON p_partkey = source WHERE tokens > 0), c AS (SELECT task, count(*) AS n, count(*) FILTER (hit AND big)::DOUBLE + 0.0 AS a, count(*) FILTER (NOT hit AND big)::DOUBLE AS b, count(*) FILTER (hit AND NOT big)::DOUBLE AS c, count(*) FILTER (NOT hit AND NOT big)::DOUBLE AS d FROM t GROUP BY task)"


@query("glm_two_by_two", f"WITH {YIELDS}, {_TWO} SELECT task, n, floor(a * d / (b * c) * 1e4 + 0.5) / 1e4 AS odds_ratio, floor(sqrt(1 / a + 1 / b + 1 / c + 1 / d) * 1e4 + 0.5) / 1e4 AS se FROM c WHERE a > 0 AND b > 0 AND c > 0 AND d > 0")
def glm_two_by_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression on one flag: its odds ratio and standard error are those of the two-by-two table."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), (F.col("p_size") > 25).cast("double").alias("big"))
    y = yields(spark, sf_dir).filter("tokens > 0").join(p, "source").select("task", "big", (F.col("n") > 10).cast("double").alias("hit"))
    cells = Window.partitionBy("task")
    both = F.count_if((F.col("hit") == 1) & (F.col("big") == 1)).over(cells), F.count_if((F.col("hit") == 0) & (F.col("big") == 1)).over(cells), F.count_if((F.col("hit") == 1) & (F.col("big") == 0)).over(cells), F.count_if((F.col("hit") == 0) & (F.col("big") == 0)).over(cells)
    y = y.withColumn("least", F.least(*both)).filter("least > 0").drop("least")
    r4 = lambda c: F.floor(c * 1e4 + 0.5) / 1e4
    fit = G.fit_groups(y, "task", ["big"], "hit", None, standardize=False).filter("term = 'big'")
    return fit.select("task", "n", r4(F.col("ratio")).alias("odds_ratio"), r4(F.col("se")).alias("se"))


@query("oracle_and_cross_selection", f"""WITH {YIELDS}, w AS (SELECT a.task, b.task AS ranking_task, a.source, a.n, b.n AS score, sum(a.n) OVER (PARTITION BY a.task, b.task) AS total, row_number() OVER (PARTITION BY a.task, b.task ORDER BY b.n::DOUBLE / b.tokens DESC, a.source) AS k, row_number() OVER (PARTITION BY a.task, b.task ORDER BY b.n DESC, a.source) AS o, count(*) OVER (PARTITION BY a.task, b.task) AS m FROM yields a JOIN yields b USING (source))
  SELECT task, ranking_task, CASE WHEN task = ranking_task THEN 'task_specific' ELSE 'cross_task' END AS strategy, {R6.format('sum(n) FILTER (k <= ceil(0.2 * m)) / max(total)')} AS capture FROM w GROUP BY task, ranking_task
  UNION ALL SELECT task, task, 'oracle_upper_bound', {R6.format('sum(n) FILTER (o <= ceil(0.2 * m)) / max(total)')} FROM w WHERE task = ranking_task GROUP BY task""")
def oracle_and_cross_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture of the best fifth ranked by the task's own rate, by other tasks' rates, and by the yields themselves."""
    y = yields(spark, sf_dir)
    wide = y.groupBy("source").agg(F.first("tokens").alias("tokens"), *[F.max(F.when(F.col("task") == t, F.col("n"))).alias(t) for t in TASKS])
    rate = lambda t: (F.col(t).cast("double") / F.col("tokens")).alias("score")
    kind = lambda a, b: F.lit("task_specific" if a == b else "cross_task").alias("strategy")
    rows = [F.struct(F.lit(a).alias("task"), F.lit(b).alias("ranking_task"), kind(a, b), F.col(a).alias("n"), rate(b)) for a in TASKS for b in TASKS]
    rows += [F.struct(F.lit(a).alias("task"), F.lit(a).alias("ranking_task"), F.lit("oracle_upper_bound").alias("strategy"), F.col(a).alias("n"), F.col(a).cast("double").alias("score")) for a in TASKS]
    each = wide.select("source", F.explode(F.array(*rows)).alias("x")).select("source", "x.*")
    by = ["task", "ranking_task", "strategy"]
    each = each.withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    chosen = S.within_fraction(S.ranked(each, by, [F.desc("score"), F.asc("source")]), by, 0.2)
    return chosen.groupBy(*by).agg(T.round6(F.sum("n").cast("double") / F.max("total")).alias("capture"))


@query("source_rates", f"WITH {YIELDS} SELECT source, task, {R6.format('1e4 * n / nullif(tokens, 0)')} AS per_10k, {R6.format('1e6 * n / nullif(tokens, 0)')} AS per_1m, {R6.format('ln(nullif(tokens, 0))')} AS log_offset, tokens > 0 AND n IS NOT NULL AS eligible FROM yields")
def source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per 10,000 and per million tokens, the log offset, and eligibility of sources."""
    t = F.nullif(F.col("tokens"), F.lit(0))
    return yields(spark, sf_dir).select("source", "task", T.round6(F.try_divide(1e4 * F.col("n"), t)).alias("per_10k"), T.round6(F.try_divide(1e6 * F.col("n"), t)).alias("per_1m"), T.round6(F.log(t)).alias("log_offset"), ((F.col("tokens") > 0) & F.col("n").isNotNull()).alias("eligible"))


@query("incremental_diagnostic", f"WITH {POOLS} SELECT CASE WHEN ordinal <= 250 THEN 'head' ELSE 'rest' END AS part, count(*) AS n, {R6.format('avg(n_chars)')} AS mean_chars, count(DISTINCT pools.source) AS n_sources FROM pools JOIN documents USING (doc_id) WHERE scale = 500 GROUP BY 1")
def incremental_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of the largest pool against what a larger scale adds."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    pool = S.nested_pools(S.round_robin(docs, "source", "doc_id", "pool", 30), [500])
    return pool.groupBy(F.when(F.col("ordinal") <= 250, "head").otherwise("rest").alias("part")).agg(F.count("*").alias("n"), T.round6(F.avg("n_chars")).alias("mean_chars"), F.countDistinct("source").alias("n_sources"))


@query("version_groups", "SELECT regexp_replace(url, '[0-9]+', '#', 'g') AS key, count(*) AS n, min(page_id) AS first_id, max(page_id) AS latest_id FROM pages WHERE url IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def version_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose addresses differ in numbers only, with the first and the latest of each group."""
    p = table(spark, sf_dir, "pages").filter("url is not null").groupBy(F.regexp_replace("url", "[0-9]+", "#").alias("key"))
    return p.agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"), F.max("page_id").alias("latest_id")).filter("n > 1")
