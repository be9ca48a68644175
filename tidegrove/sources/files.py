"""Reading and writing the data sets' files. Schemas are given; what does not fit them is kept apart or dropped.

Files are copied and looked up by Hadoop's own file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from ..streaming.growth import shared_dir

QA_SCHEMA = "input string, output string, timeseries array<array<double>>, eval_type string, eval_metadata map<string,string>"


def read_jsonl(spark: SparkSession, paths: list[str], schema: str = QA_SCHEMA, lenient: bool = False) -> DataFrame:
    """JSON lines. lenient: bad lines are dropped; else they are rows with _corrupt_record."""
    if lenient:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(paths)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """An aggregate as CSV; as many files as partitions."""
    df.write.option("header", True).csv(path)


def write_splits(df: DataFrame, path: str, example: bool = False) -> None:
    """One folder for each value of ``split``. example: beside them the first row as JSON, to look at."""
    df.write.partitionBy("split").parquet(path)
    if example:
        df.limit(1).select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(f"{path}_example")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, files = _hadoop(spark, path)
    return files.exists(p)


def make_dir(spark: SparkSession, path: str) -> None:
    p, files = _hadoop(spark, path)
    files.mkdirs(p)


def copy(spark: SparkSession, source: str, target: str) -> str:
    """Copies a file or folder, also between stores; a target that is there already is taken as it is."""
    (a, from_files), (b, to_files) = _hadoop(spark, source), _hadoop(spark, target)
    if not to_files.exists(b):
        scratch = spark._jvm.org.apache.hadoop.fs.Path(f"{target}.{uuid.uuid4().hex}.part")
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(from_files, a, to_files, scratch, False, spark._jsc.hadoopConfiguration())
        to_files.rename(scratch, b)
    return target


def staged(spark: SparkSession, source: str) -> str:
    """A copy in the shared folder, made once for each state of its source: named by place, time of change, size and number of
    files, so a source that was written anew is copied anew."""
    base = f"{shared_dir(spark)}/staged"
    make_dir(spark, base)
    at, files = _hadoop(spark, source)
    inside = files.getContentSummary(at)
    state = f"{source}|{files.getFileStatus(at).getModificationTime()}|{inside.getLength()}|{inside.getFileCount()}"
    return copy(spark, source, f"{base}/{uuid.uuid5(uuid.NAMESPACE_URL, state).hex}")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def trimmed(prompt: Column) -> Column:
    """A prompt without blanks and full stops at its end."""
    return F.regexp_replace(prompt, r"[\s.]+$", "")


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, sum(n_chars)::BIGINT AS chars FROM documents")
def scan_parquet(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.sum("n_chars").alias("chars"))


@query("SELECT conv_id, turn, role FROM conversations WHERE role <> 'system'")
def scan_jsonl(spark, sf_dir):
    """Written as JSON lines and read again by a schema; lines that don't fit are apart."""
    path = fresh(spark, "jsonl")
    write_jsonl(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), path)
    return read_jsonl(spark, [path], "conv_id bigint, turn bigint, role string").where("_corrupt_record is null and role <> 'system'").drop("_corrupt_record")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey % 3 > 0")
def scan_jsonl_lenient(spark, sf_dir):
    """A file a third of whose lines are broken; these are dropped."""
    path = fresh(spark, "lenient")
    line = F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))
    table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 3 > 0, line).otherwise(F.concat(F.lit("{"), line)).alias("value")).write.text(path)
    return read_jsonl(spark, [path], "k int, name string", lenient=True)


@query("SELECT r_regionkey AS k, r_name AS name FROM region")
def scan_json_array(spark, sf_dir):
    """One array in one file."""
    path = fresh(spark, "array")
    r = table(spark, sf_dir, "region").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))))).alias("value"))  # five rows
    r.coalesce(1).write.text(path)
    return read_json_array(spark, path, "k int, name string")


@query("SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean FROM documents GROUP BY lang")
def sink_csv(spark, sf_dir):
    """An aggregate as CSV, with a head line, and back."""
    path = fresh(spark, "csv")
    write_csv(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars") + 1e-9, 4).alias("mean")), path)
    return read_csv(spark, path, "lang string, n bigint, mean double")


@query("SELECT c_custkey AS k, c_name AS name, round(c_acctbal, 2) AS balance FROM customer")
def scan_csv(spark, sf_dir):
    path = fresh(spark, "customers")
    write_csv(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.round(F.col("c_acctbal") + 1e-9, 2).alias("balance")), path)
    return read_csv(spark, path, "k bigint, name string, balance double")


@query("SELECT doc_id, lang AS split FROM documents WHERE lang IN ('en', 'de')")
def sink_parquet(spark, sf_dir):
    """A folder a split with an example beside them; two of the folders are read back, by partition."""
    path = fresh(spark, "splits")
    write_splits(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("split")), path, example=True)
    return spark.read.schema("doc_id bigint, split string").parquet(path).where(F.col("split").isin("en", "de"))


@query("SELECT conv_id, turn, rtrim(regexp_replace(text, '[\\s.]+$', '')) AS input, length(text) AS length FROM conversations")
def sink_jsonl(spark, sf_dir):
    """Split lines with their length and trimmed prompts, written and read."""
    path = fresh(spark, "lines")
    t = table(spark, sf_dir, "conversations")
    write_jsonl(t.select("conv_id", "turn", trimmed(F.col("text")).alias("input"), F.length("text").cast("bigint").alias("length")), path)
    return spark.read.schema("conv_id bigint, turn bigint, input string, length bigint").json(path)


@query("SELECT conv_id, turn, text AS input, 'rule' AS style FROM conversations WHERE role = 'user'")
def parquet_to_jsonl(spark, sf_dir):
    """Prepared rows back to question lines: the first message and a field of the JSON column."""
    path = fresh(spark, "questions")
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.array(F.struct(F.col("role"), F.col("text").alias("content"))).alias("prompt"), F.to_json(F.struct(F.lit("rule").alias("style"))).alias("reward_model"))
    write_jsonl(rows.select("conv_id", "turn", F.col("prompt")[0]["content"].alias("input"), F.get_json_object("reward_model", "$.style").alias("style")), path)
    return spark.read.schema("conv_id bigint, turn bigint, input string, style string").json(path)


@query("SELECT l_orderkey % 3 AS step, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY ALL")
def sink_generations(spark, sf_dir):
    """Rollouts appended as JSON lines step by step, then read as a whole."""
    path = fresh(spark, "rollouts")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 3).alias("step"), F.col("l_quantity").alias("score"))
    for step in range(3):
        write_jsonl(rows.where(F.col("step") == step), path, "append")
    return spark.read.schema("step bigint, score double").json(path).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score") + 1e-9, 2).alias("total"))


@query("SELECT vec_id, label, embedding[1]::DOUBLE AS first FROM embeddings")
def save_load_batch(spark, sf_dir):
    """A batch with arrays, stored and loaded."""
    path = fresh(spark, "batch")
    table(spark, sf_dir, "embeddings").write.parquet(path)
    return spark.read.parquet(path).select("vec_id", "label", F.col("embedding")[0].cast("double").alias("first"))


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier")
def stage_remote(spark, sf_dir):
    """A file copied once into the shared folder and read from there."""
    return spark.read.parquet(staged(spark, f"{sf_dir}/supplier.parquet")).select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))


@query("SELECT 'made' AS what, true AS there UNION ALL SELECT 'copied', true UNION ALL SELECT 'other', false")
def storage_helpers(spark, sf_dir):
    """A folder made, a file copied into it, and a name that isn't there."""
    base = fresh(spark, "store")
    make_dir(spark, base)
    copy(spark, f"{sf_dir}/region.parquet", f"{base}/region.parquet")
    found = [("made", exists(spark, base)), ("copied", exists(spark, f"{base}/region.parquet")), ("other", exists(spark, f"{base}/none"))]
    return spark.createDataFrame(found, "what string, there boolean")


@query("SELECT 'n' AS metric, k AS step, n::DOUBLE AS value FROM (SELECT l_linenumber AS k, count(*) AS n, avg(l_tax) AS t FROM lineitem GROUP BY ALL) UNION ALL SELECT 'tax', k, round(t, 6) FROM (SELECT l_linenumber AS k, avg(l_tax) AS t FROM lineitem GROUP BY ALL)")
def sink_tracking(spark, sf_dir):
    """Metrics of steps as a table of (metric, step, value), appended and read."""
    path = fresh(spark, "metrics")
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("step")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg("l_tax") + 1e-9, 6).alias("tax"))
    m.unpivot("step", ["n", "tax"], "metric", "value").write.mode("append").parquet(path)
    return spark.read.parquet(path).select("metric", "step", "value")
