"""The held-out questions of a split: every kind, asked of every series and sample that it fits.

A kind is a row of ``KINDS``: whose table it reads, what tells its questions apart, and which columns answer. Each kind's own
query leaves out what it doesn't fit (too few segments, types, events, points). All kinds are rows of (kind, key, sub, part,
answer); a new kind is a new row of the table.

A split takes equal shares of the kinds in a seeded order, then fills up with whatever comes next in that order. So of a kind
nothing is needed beyond as many as the split takes: kinds are worked out one after the other, each as a job of its own whose
first questions are kept, and the split is drawn from these. One job of all kinds has a plan too large for a small driver.

Defined cases: an answer that is null is no question; numbers are told with six digits, yes and no for truth values. Kinds
with fewer questions than their share give all they have; fewer questions than the split may have are all taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import registry
from ..operators import comparisons, composed, cross, enumerations, held_out, segments, series  # noqa: F401
from ..streaming.growth import fixed

#: kind: (query, what tells questions apart besides the series or sample, columns that answer)
KINDS: dict[str, tuple[str, list[str], list[str]]] = {
    "ood_conditional_stat": ("conditional_stat", ["type"], ["mean", "std", "range"]), "ood_nested_extrema": ("nested_extrema", [], ["max_in_longest", "min_in_shortest"]),
    "ood_event_density": ("event_density_extremes", [], ["highest", "lowest"]), "ood_conditional_count": ("conditional_count", ["type"], ["above", "below"]),
    "ood_trend_reversal": ("trend_reversal", [], ["reversed"]), "ood_range_normalized_amplitude": ("range_normalized_amplitude", [], ["yes"]),
    "ood_segment_stat_compare": ("segment_stat_compare", [], ["first_higher"]), "ood_max_in_highest_mean_quarter": ("max_in_highest_mean_quarter", [], ["yes"]),
    "ood_max_before_min": ("max_before_min", [], ["yes"]), "ood_std_exceeds_half_range": ("std_exceeds_half_range", [], ["yes"]),
    "ood_conditional_mean_by_type": ("conditional_mean_by_type", ["type"], ["mean"]), "ood_trend_follows_mean": ("trend_follows_mean", [], ["follows"]),
    "ood_longest_type_fraction": ("longest_type_fraction", ["type"], ["share"]), "ood_symmetric_trend_sequence": ("symmetric_trend_sequence", [], ["palindrome"]),
    "ood_event_density_by_trend": ("event_density_by_trend", ["type"], ["density"]), "ood_max_amp_in_longest_segment": ("max_amp_in_longest_segment", [], ["yes"]),
    "ood_event_amplitude_vs_std": ("event_amplitude_vs_std", [], ["over_std", "over_half_range"]), "ood_symmetric_recovery": ("symmetric_recovery", [], ["recovered"]),
    "ood_max_mean_chunk_pos": ("max_mean_chunk_pos", [], ["chunk"]), "ood_chunk_above_proportion": ("chunk_above_proportion", [], ["share"]),
    "ood_quarter_mean_ordering": ("quarter_ordering", [], ["ordering", "strict"]), "ood_cycle_mean_trend": ("cycle_mean_trend", [], ["over"]),
    "ood_amplitude_vs_segment_std": ("amplitude_vs_segment_std", [], ["over1", "over2", "over3"]), "ood_peak_in_longest_segment": ("peak_in_longest_segment", [], ["yes"]),
    "ood_duration_weighted_mean": ("duration_weighted_mean", [], ["mean"]), "ood_dominant_trend_in_cluster": ("dominant_trend_in_cluster", [], ["type"]),
    "ood_cross_event_causality": ("follow_within_window", ["a", "b"], ["followed"]), "ood_cross_corr_count": ("cross_trend_pairs", [], ["concordant"]),
    "ood_cross_trend_convergence": ("cross_trend_convergence", [], ["converge", "diverge"]), "ood_cross_extrema_alignment": ("cross_extrema_alignment", ["a", "b"], ["aligned"]),
    "ood_cross_range_overlap": ("cross_range_overlap", ["a", "b"], ["overlap"]), "ood_cross_concordant_shift": ("cross_concordant_shift", [], ["same", "opposite"]),
    "ood_cluster_singleton": ("cluster_singleton", [], ["type"]), "ood_corr_transitivity": ("corr_transitivity", ["a", "b", "c"], ["ac"]),
    "ood_mixed_corr_anti": ("mixed_corr_anti", [], ["mixed"]),
}


#: Kinds that need more than their query does.
ONLY = {"ood_cross_corr_count": "pairs >= 3"}


def _key(columns: list[str]) -> str:
    return "sid" if "sid" in columns else "sample"


def _told(name: str, kind: str) -> Column:
    """An answer as text."""
    c = F.col(name)
    return F.when(c, "yes").when(~c, "no") if kind == "boolean" else F.when(c.isNotNull(), F.format_string("%.6f", c)) if kind == "double" else c.cast("string")


def questions(spark: SparkSession, sf_dir: str, kinds: dict | None = None) -> DataFrame:
    """(kind, key, sub, part, answer) of every question that any series or sample gives."""
    out = None
    for kind, (name, sub, parts) in (kinds or KINDS).items():
        t = registry.QUERIES[name](spark, sf_dir).where(ONLY.get(kind, "true"))
        types = dict(t.dtypes)
        answers = F.array(*(F.struct(F.lit(p).alias("part"), _told(p, types[p]).alias("answer")) for p in parts))
        below = F.concat_ws("/", *(F.col(c).cast("string") for c in sub)) if sub else F.lit("")
        q = t.select(F.lit(kind).alias("kind"), F.col(_key(t.columns)).cast("bigint").alias("key"), below.alias("sub"), F.explode(answers).alias("x"))
        q = q.select("kind", "key", "sub", "x.part", "x.answer").where("answer is not null")
        out = q if out is None else out.unionByName(q)
    return out


def order_of(*columns: str) -> Column:
    """The seeded place of a question, from what tells it apart."""
    return F.md5(F.concat_ws("|", F.lit("42"), *(F.col(c).cast("string") for c in columns)).cast("binary"))


#: Fixed value: up to this rank a limit by kind is kept by each task before anything is shuffled (Spark's own bound).
RANKED = 1000


def split(asked: DataFrame, most: int, n_kinds: int) -> DataFrame:
    """``most`` of the questions: of each kind the first ``most // n_kinds`` in the seeded order, then the next of all. What comes
    next is among the first ``most`` of its kind, so one ranking gives both, and all kinds are worked out once."""
    share = most // n_kinds
    held = most if most <= RANKED else share
    h = asked.withColumn("h", order_of("kind", "key", "sub", "part"))
    some = h.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("h"))).where(F.col("r") <= held).withColumn("first", F.col("r") <= share).drop("r")
    if held < most:
        some = some.unionByName(h.orderBy("h").limit(most).withColumn("first", F.lit(False))).groupBy(*asked.columns, "h").agg(F.max("first").alias("first"))
    return some.orderBy(F.desc("first"), "h").limit(most).select(*asked.columns)


def _sql(kind: str) -> str:
    """The questions of a kind in SQL, from its query's own."""
    name, sub, parts = KINDS[kind]
    below = " || '/' || ".join(f"{c}::VARCHAR" for c in sub) or "''"
    told = lambda p: f"CASE typeof({p}) WHEN 'BOOLEAN' THEN CASE {p}::VARCHAR WHEN 'true' THEN 'yes' WHEN 'false' THEN 'no' END WHEN 'DOUBLE' THEN printf('%.6f', try_cast({p}::VARCHAR AS DOUBLE)) ELSE {p}::VARCHAR END"
    each = " UNION ALL ".join(f"SELECT '{kind}' AS kind, k, sub, '{p}' AS part, {told(p)} AS answer FROM t" for p in parts)
    key = "sid" if name not in CROSS else "sample"
    return f"SELECT kind, k::BIGINT AS key, sub, part, answer FROM (WITH t AS (SELECT {key} AS k, {below} AS sub, {', '.join(parts)} FROM ({registry.ORACLE[name]}) WHERE {ONLY.get(kind, "true")}) {each}) WHERE answer IS NOT NULL"


#: Queries whose rows are of samples of series.
CROSS = {"dominant_trend_in_cluster", "follow_within_window", "cross_trend_pairs", "cross_trend_convergence", "cross_extrema_alignment", "cross_range_overlap", "cross_concordant_shift", "cluster_singleton", "corr_transitivity", "mixed_corr_anti"}
MOST = 210


def leading(asked: DataFrame, most: int) -> DataFrame:
    """The first ``most`` questions in the seeded order."""
    return asked.orderBy(order_of("kind", "key", "sub", "part")).limit(most)


def generate_ood_for_split(spark: SparkSession, sf_dir: str, most: int = MOST) -> DataFrame:
    """The split's questions out of all kinds. Points, segments and channels, which nearly all kinds read, are worked out once and
    kept, on disk if need be, until the last kind is done; of each kind no more than ``most`` questions are kept."""
    shared = [t for t in (f(spark, sf_dir) for f in (series.series, segments.segments, cross.channels)) if t.storageLevel == StorageLevel.NONE]
    try:
        for t in shared:
            t.persist()
        led = [fixed(leading(questions(spark, sf_dir, {kind: KINDS[kind]}), most)) for kind in KINDS]
    finally:
        for t in reversed(shared):
            t.unpersist()
    return split(reduce(DataFrame.unionByName, led), most, len(KINDS))


# registered by hand: the SQL is made of the queries' own, whose rounding is already taken care of
_ALL = " UNION ALL ".join(map(_sql, KINDS))
registry.QUERIES["generate_ood_for_split"] = generate_ood_for_split
registry.ORACLE["generate_ood_for_split"] = f"""WITH q AS ({_ALL}), h AS (SELECT *, md5('42|' || kind || '|' || key || '|' || sub || '|' || part) AS h FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY h) <= {MOST // len(KINDS)} AS first FROM h) SELECT kind, key, sub, part, answer FROM r ORDER BY first DESC, h LIMIT {MOST}"""
