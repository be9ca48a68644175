"""The algebra of batches: selecting, renaming, repeating, chunking, padding and joining by row number.

Rows are numbered by a key that the data hold, never by where they happen to lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, rnd, table


STRETCHES = 1024


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Every column's name with the prefix, unless it has it."""
    return df.toDF(*(c if c.startswith(prefix) else prefix + c for c in df.columns))


def union_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two batches side by side by ``key``. A column of both must agree, else the job fails."""
    both = [c for c in a.columns if c in b.columns and c != key]
    right = b.withColumnsRenamed({c: f"_b_{c}" for c in both})
    out = a.join(right, key)
    for c in both:
        out = out.where(F.coalesce(F.assert_true(F.col(c).eqNullSafe(F.col(f"_b_{c}")), F.lit(f"{c} differs")), F.lit(True)))
    return out.drop(*(f"_b_{c}" for c in both))


def numbered(df: DataFrame, key: str) -> DataFrame:
    """``df`` with its row number _i from 0 in the order of a unique integer key. ``STRETCHES`` equal stretches of the
    key's range are numbered on their own and moved up by the sizes of those before, so that no task sees all rows."""
    own = Window.partitionBy("_b").orderBy(key)
    n = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    b = F.floor((F.col(key) - F.col("lo")) * STRETCHES / (F.col("hi") - F.col("lo") + 1))
    split = df.join(F.broadcast(n)).withColumn("_b", b).drop("lo", "hi")  # one row
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = split.groupBy("_b").count().select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))  # STRETCHES rows at most
    return split.join(F.broadcast(sizes), "_b").withColumn("_i", F.row_number().over(own) - 1 + F.col("_before")).drop("_b", "_before")


@query("SELECT doc_id, lang FROM documents")
def select_columns(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang")


@query("SELECT n_nationkey AS nation, n_name AS name FROM nation")
def rename_columns(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").withColumnsRenamed({"n_nationkey": "nation", "n_name": "name"})


@query("SELECT r_regionkey AS x_r_regionkey, r_name AS x_r_name FROM region")
def add_prefix(spark, sf_dir):
    return with_prefix(table(spark, sf_dir, "region"), "x_")


@query("SELECT d.doc_id, lang, quality FROM documents d JOIN labels USING (doc_id)")
def join_positional_columns(spark, sf_dir):
    return union_columns(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def concat_frames(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return n.unionByName(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))


@query("SELECT doc_id, i // 100 AS chunk, i % 100 AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)")
def chunk_rows(spark, sf_dir, size: int = 100):
    d = numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return d.select("doc_id", F.floor(F.col("_i") / size).alias("chunk"), (F.col("_i") % size).alias("place"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i BETWEEN 10 AND 200 AND (i - 10) % 3 = 0")
def slice_rows(spark, sf_dir, start: int = 10, stop: int = 201, step: int = 3):
    d = numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return d.where(F.col("_i").between(start, stop - 1) & ((F.col("_i") - start) % step == 0)).select("doc_id")


@query("SELECT r_regionkey AS k, i.i AS copy FROM region, range(3) i(i)")
def repeat_rows(spark, sf_dir, n: int = 3):
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("copy"))


@query("SELECT n_nationkey AS k, i.i AS copy FROM nation, range(3) i(i) WHERE i.i < n_nationkey % 3")
def sample_level_repeat(spark, sf_dir):
    """A row as often as it says; none for 0."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).where("k % 3 > 0")
    return n.select("k", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("k") % 3 - 1).cast("bigint"))).alias("copy"))


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey < (8 - (SELECT count(*) FROM nation) % 8) % 8")
def pad_to_divisor(spark, sf_dir, by: int = 8):
    """Leading rows again until the number of rows divides."""
    n = numbered(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), "k")
    missing = -n.count() % by
    return n.unionByName(n.where(F.col("_i") < missing)).select("k")


@query("SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS messages, count(*) AS turns FROM conversations GROUP BY conv_id")
def prompt_messages(spark, sf_dir):
    m = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", F.length("text").cast("string")).alias("m"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(m, lambda x: x["m"]), "|").alias("messages"), F.count(F.lit(1)).alias("turns"))


@query("SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS trained, sum(length(text))::BIGINT AS total FROM conversations GROUP BY conv_id")
def multi_turn_mask(spark, sf_dir):
    """How many characters of a conversation are trained on: the assistant's."""
    n = F.length("text").cast("bigint")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("trained"), F.sum(n).alias("total"))


@query("SELECT vec_id, c.c AS chunk, round(list_sum(list_transform(embedding[c.c * 16 + 1 : c.c * 16 + 16], lambda x: x::DOUBLE)), 4) AS total FROM embeddings, range(4) c(c)")
def unfold_column_chunks(spark, sf_dir, width: int = 16):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("chunk"))
    part = F.slice("embedding", (F.col("chunk") * width + 1).cast("int"), F.lit(width))
    return e.select("vec_id", "chunk", rnd(F.aggregate(part, F.lit(0.0), lambda a, v: a + v.cast("double")), 4).alias("total"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT >= 50")
def json_field(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k >= 50")


@query("SELECT n_nationkey AS k, round(24576 * n_nationkey + pow(n_nationkey, 2), 0)::BIGINT AS workload, ((n_nationkey + 6) // 7)::BIGINT AS ceildiv, ((n_nationkey + 6) // 7 * 7)::BIGINT AS roundup FROM nation")
def workload(spark, sf_dir):
    k = F.col("n_nationkey").cast("bigint")
    return table(spark, sf_dir, "nation").select("n_nationkey", (24576 * k + k * k).alias("workload"), F.ceil(k / 7).alias("ceildiv"), (F.ceil(k / 7) * 7).alias("roundup")).withColumnRenamed("n_nationkey", "k")
