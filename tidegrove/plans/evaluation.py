"""Tables of an evaluation: results joined, means by kind, length and model, what was trained on, how models trade classes.

Labelled documents are the evaluated rows: quality is whether an answer was right, toxic the verdict that it should have had;
the language stands for the model, the source for the kind of question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.algebra import numbered
from ..registry import query, rnd, table
from .reports import BUCKETS, ROWS, evaluated

MODELS = ["en", "de", "fr", "es"]


@query("SELECT i AS place, doc_id, label FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM labels) d JOIN (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings) e USING (i)")
def join_positional_rows(spark, sf_dir):
    """Row k of one table with row k of the other, both by their own order; what one has more is left out."""
    a = numbered(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    b = numbered(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return a.join(b, "_i").select(F.col("_i").alias("place"), "doc_id", "label")


@query("SELECT conv_id, any_value(text) FILTER (turn = 0 AND role = 'user') AS asked, count(*) FILTER (role = 'user') AS questions, count(*) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY conv_id")
def join_group_results(spark, sf_dir):
    """The rows of one id side by side: one pass, no join."""
    role = lambda r: F.count_if(F.col("role") == r)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.when((F.col("turn") == 0) & (F.col("role") == "user"), F.col("text"))).alias("asked"), role("user").alias("questions"), role("assistant").alias("answers"))


@query("WITH g AS (SELECT l_orderkey AS k, l_linenumber AS label, max(l_quantity) AS v FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL), p AS (SELECT l_orderkey AS k, l_linenumber AS label, max(l_quantity) AS v FROM lineitem WHERE l_linenumber <= 3 AND l_discount > 0.02 GROUP BY ALL) SELECT k, round(avg(CASE WHEN p.v IS NULL THEN 0 ELSE exp(-abs(g.v - p.v) / 10) END), 4) AS score, count(*) AS n FROM g LEFT JOIN p USING (k, label) GROUP BY k")
def join_by_label(spark, sf_dir):
    """Told points to true ones by their label, within an id; a missing one scores 0."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("label"))
    both = li.agg(F.max("l_quantity").alias("g"), F.max(F.when(F.col("l_discount") > 0.02, F.col("l_quantity"))).alias("p"))
    return both.groupBy("k").agg(rnd(F.avg(F.coalesce(F.exp(-F.abs(F.col("g") - F.col("p")) / 10), F.lit(0.0))), 4).alias("score"), F.count(F.lit(1)).alias("n"))


#: A small fixed table of settings: the largest is as long as there are kinds.
SETTINGS = {"click": ("count", 1.0), "view": ("count", 0.5), "error": ("fault", 2.0)}


@query("WITH s(event_type, unit, weight) AS (VALUES ('click', 'count', 1.0), ('view', 'count', 0.5), ('error', 'fault', 2.0)) SELECT event_id, coalesce(unit, 'none') AS unit, round(value * coalesce(weight, 0)::DOUBLE, 4) AS weighted FROM events LEFT JOIN s USING (event_type)")
def broadcast_config_lookup(spark, sf_dir):
    s = spark.createDataFrame([(k, *v) for k, v in SETTINGS.items()], "event_type string, unit string, weight double")
    e = table(spark, sf_dir, "events").join(F.broadcast(s), "event_type", "left")
    return e.select("event_id", F.coalesce("unit", F.lit("none")).alias("unit"), rnd(F.col("value") * F.coalesce("weight", F.lit(0.0)), 4).alias("weighted"))


def _prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    ratio = lambda a, b: rnd(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


@query(ROWS + "SELECT n_chars // 400 AS gt_len, count(*) AS n, round(coalesce(sum(quality * toxic) / nullif(sum(quality), 0)::DOUBLE, 0), 4) AS precision, round(coalesce(sum(quality * toxic) / nullif(sum(toxic), 0)::DOUBLE, 0), 4) AS recall, round(coalesce(2 * sum(quality * toxic) / nullif(sum(quality) + sum(toxic), 0)::DOUBLE, 0), 4) AS f1 FROM d GROUP BY ALL")
def agg_by_gt_len(spark, sf_dir):
    q, t = F.col("quality"), F.col("toxic")
    d = evaluated(spark, sf_dir).groupBy(F.floor(F.col("n_chars") / 400).alias("gt_len"))
    return d.agg(F.count(F.lit(1)).alias("n"), *_prf(F.sum(q * t), F.sum(q * (1 - t)), F.sum((1 - q) * t)))


@query(ROWS + "SELECT what, count(v) AS n, round(avg(v), 4) AS mean FROM (SELECT unnest([{'what': 'right', 'v': quality::DOUBLE}, {'what': 'toxic', 'v': CASE WHEN lang = 'en' THEN toxic END::DOUBLE}, {'what': 'long', 'v': CASE WHEN n_chars > 500 THEN quality END::DOUBLE}], recursive := true) FROM d) GROUP BY what")
def agg_perspectives(spark, sf_dir):
    """Means of several parts of a result, over the rows that have the part."""
    q, t = F.col("quality").cast("double"), F.col("toxic").cast("double")
    d = evaluated(spark, sf_dir).select(q.alias("right"), F.when(F.col("lang") == "en", t).alias("toxic"), F.when(F.col("n_chars") > 500, q).alias("long"))
    return d.unpivot([], ["right", "toxic", "long"], "what", "v").groupBy("what").agg(F.count("v").alias("n"), rnd(F.avg("v"), 4).alias("mean"))


@query(ROWS + "SELECT count(*) AS n, round(avg(quality), 4) AS right_share, round(avg(toxic) FILTER (quality = 1), 4) AS toxic_of_right, count(*) FILTER (quality = 1 AND toxic = 1) AS both_, count(DISTINCT source) AS kinds FROM d")
def agg_trend_detail(spark, sf_dir):
    q = F.col("quality")
    return evaluated(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(q), 4).alias("right_share"), rnd(F.avg(F.when(q == 1, F.col("toxic"))), 4).alias("toxic_of_right"), F.count_if((q == 1) & (F.col("toxic") == 1)).alias("both_"), F.countDistinct("source").alias("kinds"))


@query(ROWS + "SELECT doc_id % 3 AS strategy, round(avg(quality), 4) AS mean, count(*) AS n FROM d GROUP BY ALL")
def agg_strategy(spark, sf_dir):
    return evaluated(spark, sf_dir).groupBy((F.col("doc_id") % 3).alias("strategy")).agg(rnd(F.avg("quality"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey % 5 AS source, round(avg(m), 6) AS mean, count(*) AS prompts FROM (SELECT l_orderkey, any_value(s) AS l_suppkey, avg(l_discount) AS m FROM (SELECT *, min(l_suppkey) OVER (PARTITION BY l_orderkey) AS s FROM lineitem) GROUP BY l_orderkey) GROUP BY ALL")
def agg_source_mean(spark, sf_dir):
    """Means over the answers to each prompt, then over the prompts of each source."""
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"), F.avg("l_discount").alias("m"))
    return p.groupBy((F.col("s") % 5).alias("source")).agg(rnd(F.avg("m"), 6).alias("mean"), F.count(F.lit(1)).alias("prompts"))


def by_model(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Accuracy of two models by kind and class (toxic 0 and 1), from one pass."""
    of = lambda m, c: F.avg(F.when((F.col("lang") == m) & (F.col("toxic") == c), F.col("quality")))
    whole = lambda m: F.avg(F.when(F.col("lang") == m, F.col("quality")))
    return rows.groupBy("source").agg(*(of(m, c).alias(f"{n}{c}") for n, m in (("a", first), ("b", second)) for c in (0, 1)), whole(first).alias("a"), whole(second).alias("b"))


MODEL_SQL = ROWS + ", m AS (SELECT source, " + ", ".join(f"avg(quality) FILTER (lang = '{m}' AND toxic = {c}) AS {n}{c}" for n, m in (("a", "en"), ("b", "de")) for c in (0, 1)) + ", avg(quality) FILTER (lang = 'en') AS a, avg(quality) FILTER (lang = 'de') AS b FROM d GROUP BY source) "


@query(MODEL_SQL + "SELECT source, round(b0 - a0, 4) AS gain0, round(b1 - a1, 4) AS gain1, coalesce((b0 - a0) * (b1 - a1) < 0 AND abs((b0 - a0) - (b1 - a1)) > 0.1, false) AS trades, coalesce(abs(b - a) < 0.02 AND abs((b0 - a0) - (b1 - a1)) > 0.1, false) AS hidden FROM m")
def agg_tradeoff(spark, sf_dir):
    """Kinds where a model gained in one class what it lost in the other; hidden: its whole accuracy hardly moved."""
    m = by_model(evaluated(spark, sf_dir), "en", "de").withColumn("g0", F.col("b0") - F.col("a0")).withColumn("g1", F.col("b1") - F.col("a1"))
    apart = F.abs(F.col("g0") - F.col("g1")) > 0.1
    flag = lambda c: F.coalesce(c, F.lit(False))
    return m.select("source", rnd("g0", 4).alias("gain0"), rnd("g1", 4).alias("gain1"), flag((F.col("g0") * F.col("g1") < 0) & apart).alias("trades"), flag((F.abs(F.col("b") - F.col("a")) < 0.02) & apart).alias("hidden"))


@query(MODEL_SQL + "SELECT source, round(a, 4) AS first, round(b, 4) AS second FROM m WHERE a < 0.9 AND b < 0.9")
def agg_zero_acc(spark, sf_dir, under: float = 0.9):
    """Kinds that neither model can do."""
    return by_model(evaluated(spark, sf_dir), "en", "de").where((F.col("a") < under) & (F.col("b") < under)).select("source", rnd("a", 4).alias("first"), rnd("b", 4).alias("second"))


@query("WITH w AS (SELECT lang, n_chars / 4.0 AS t, len(string_split(text, ' ')) AS w FROM documents) SELECT lang, count(*) AS n, round(sum(t), 2)::DOUBLE AS tokens, round(quantile_cont(w, 0.5), 4) AS p50, round(quantile_cont(w, 0.95), 4) AS p95, max(w) AS most FROM w GROUP BY lang")
def data_stats(spark, sf_dir):
    """Tokens estimated at four characters each, and percentiles of words."""
    w = table(spark, sf_dir, "documents").select("lang", (F.col("n_chars") / 4).alias("t"), F.size(F.split("text", " ")).cast("bigint").alias("w"))
    p = lambda x: rnd(F.expr(f"percentile(w, {x})"), 4)
    return w.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("t"), 2).alias("tokens"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.max("w").alias("most"))


@query(ROWS + "SELECT source, CASE WHEN count(*) FILTER (toxic = 1) >= 0.2 * count(*) THEN 'f1' WHEN count(*) FILTER (n_chars > 800) > 0.5 * count(*) THEN 'reasoning' ELSE 'accuracy' END AS metric FROM d GROUP BY source")
def metric_for_task(spark, sf_dir):
    """The measure that a kind of question is reported by, from what its rows have."""
    n = F.count(F.lit(1))
    return evaluated(spark, sf_dir).groupBy("source").agg(F.when(F.count_if(F.col("toxic") == 1) >= 0.2 * n, "f1").when(F.count_if(F.col("n_chars") > 800) > 0.5 * n, "reasoning").otherwise("accuracy").alias("metric"))


@query("WITH t AS (SELECT source, count(l.doc_id) AS labelled, count(*) FILTER (toxic = 1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source) SELECT source, CASE WHEN labelled = 0 THEN 'held out' WHEN toxic = 0 THEN 'by example' WHEN toxic < 0.15 * labelled THEN 'mixed' ELSE 'by reward' END AS bucket FROM t")
def taxonomy_bucket(spark, sf_dir):
    """How a kind was trained on: from what of it is found in the training data."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    t = d.groupBy("source").agg(F.count("quality").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return t.select("source", F.when(F.col("n") == 0, "held out").when(F.col("toxic") == 0, "by example").when(F.col("toxic") < 0.15 * F.col("n"), "mixed").otherwise("by reward").alias("bucket"))


def tier(kind: Column, bridge: Column) -> Column:
    """The tier of a kind by its name's front; worked steps make a tier of their own."""
    return F.when(bridge, "bridge").when(kind.startswith("atomic_"), "atomic").when(kind.startswith("rl_"), "composed").when(kind.startswith("ood_"), "held out").otherwise("family")


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'bridge' WHEN event_type = 'click' THEN 'atomic' WHEN event_type = 'view' THEN 'composed' WHEN event_type = 'error' THEN 'held out' ELSE 'family' END AS tier FROM events")
def tier_classify(spark, sf_dir):
    name = F.when(F.col("event_type") == "click", "atomic_mean").when(F.col("event_type") == "view", "rl_range").when(F.col("event_type") == "error", "ood_x").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", tier(name, F.col("user_id") % 5 == 0).alias("tier"))


@query(ROWS + "SELECT source, round(avg(quality), 4) AS accuracy FROM d GROUP BY source")
def accuracy_of_type(spark, sf_dir):
    """Accuracy by kind; a kind without any verdict fails the job instead of being left out."""
    a = evaluated(spark, sf_dir).groupBy("source").agg(F.avg("quality").alias("a"))
    return a.select("source", rnd(F.when(F.col("a").isNull(), F.raise_error(F.concat(F.lit("no verdict in "), "source")).cast("double")).otherwise(F.col("a")), 4).alias("accuracy"))


@query("SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id)) AND source <> 'src0'")
def coverage_check(spark, sf_dir, left_out: tuple = ("src0",)):
    """Kinds that are neither evaluated nor left out on purpose; none should be."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    seen = d.join(table(spark, sf_dir, "labels"), "doc_id").select("source").distinct()
    return d.select("source").distinct().join(seen, "source", "left_anti").where(~F.col("source").isin(*left_out))


@query(ROWS + "SELECT source, " + ", ".join(f"round(avg(quality) FILTER (lang = '{m}'), 4) AS {m}" for m in MODELS) + ", round(greatest(" + ", ".join(f"avg(quality) FILTER (lang = '{m}')" for m in MODELS) + "), 4) AS best, round(100 * (avg(quality) FILTER (lang = 'es') - avg(quality) FILTER (lang = 'en')), 2) AS delta FROM d GROUP BY source")
def best_of_models(spark, sf_dir):
    """Each model's accuracy by kind, the best, and the last less the first in points."""
    d = evaluated(spark, sf_dir).groupBy("source").pivot("lang", MODELS).agg(F.avg("quality"))
    return d.select("source", *(rnd(m, 4).alias(m) for m in MODELS), rnd(F.greatest(*MODELS), 4).alias("best"), rnd(100 * (F.col("es") - F.col("en")), 2).alias("delta"))


@query(ROWS + "SELECT lang, " + ", ".join(f"round(avg(quality) FILTER (bucket = '{b}' AND toxic = 0), 4) AS {b}_clean, count(*) FILTER (bucket = '{b}' AND toxic = 0) AS {b}_n" for b in BUCKETS) + " FROM d GROUP BY lang")
def summary_by_length_models(spark, sf_dir):
    """Accuracy and rows by model and length, side by side."""
    at = lambda b: (F.col("bucket") == b) & (F.col("toxic") == 0)
    return evaluated(spark, sf_dir).groupBy("lang").agg(*(c for b in BUCKETS for c in (rnd(F.avg(F.when(at(b), F.col("quality"))), 4).alias(f"{b}_clean"), F.count_if(at(b)).alias(f"{b}_n"))))


def summary_lines(text: Column) -> Column:
    """Lines "name   accuracy=0.5 (n=12)" of a report as an array of (name, accuracy, n)."""
    part = lambda k: F.regexp_extract_all(text, F.lit(r"(?m)^(\S+)\s+accuracy=([0-9.]+) \(n=([0-9]+)\)$"), k)
    return F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")), lambda x: F.struct(x["a"].alias("name"), x["b"].cast("double").alias("accuracy"), x["c"].cast("bigint").alias("n")))


@query(ROWS + "SELECT lang, source AS name, round(round(avg(quality), 3), 3) AS accuracy, count(*) AS n FROM d GROUP BY lang, source")
def parse_summary(spark, sf_dir):
    """A report in words, written for each model, read as a table again."""
    d = evaluated(spark, sf_dir).groupBy("lang", "source").agg(rnd(F.avg("quality"), 3).alias("a"), F.count(F.lit(1)).alias("n"))
    line = F.format_string("%s   accuracy=%.3f (n=%d)", "source", "a", "n")
    report = d.groupBy("lang").agg(F.concat(F.lit("Summary\n=======\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\nend")).alias("t"))  # a line a kind
    return report.select("lang", F.explode(summary_lines(F.col("t"))).alias("x")).select("lang", "x.name", "x.accuracy", "x.n")


@query("SELECT conv_id, turn, regexp_replace(text, '[0-9]+', '#', 'g') AS shown, length(text) AS score FROM conversations WHERE role = 'assistant' AND text LIKE '%the%' ORDER BY length(text) DESC, conv_id, turn LIMIT 25")
def rollout_browse(spark, sf_dir, search: str = "the", most: int = 25):
    """Answers that hold a word, numbers masked, the best first."""
    c = table(spark, sf_dir, "conversations").where((F.col("role") == "assistant") & F.col("text").contains(search))
    return c.select("conv_id", "turn", F.regexp_replace("text", "[0-9]+", "#").alias("shown"), F.length("text").cast("bigint").alias("score")).orderBy(F.desc("score"), "conv_id", "turn").limit(most)
