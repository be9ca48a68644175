"""What a user brings: scorers, estimators, sources and ways of dealing work, by name or by path; and rounds of generation that
go on until enough rows are good."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.parsing import EVENT_TEXT_SQL, _events, _said, _two
from ..operators.groupstats import SCORE_SQL, scores
from ..registry import query, rnd, table
from ..streaming.growth import fixed
from .inference import infer


class Registry:
    """Names to functions. A name that is taken is an error, an unknown one says what there is."""

    def __init__(self, what: str):
        self.what, self.known = what, {}

    def __call__(self, name: str) -> Callable:
        def add(f: Callable) -> Callable:
            if self.known.get(name, f) is not f:
                raise ValueError(f"{self.what} {name} is there already")
            self.known[name] = f
            return f

        return add

    def __getitem__(self, name: str) -> Callable:
        if name not in self.known:
            raise KeyError(f"no {self.what} {name!r}; there are {', '.join(sorted(self.known))}")
        return self.known[name]


#: Rewards: columns (prediction, truth) to a column. Estimators: a score column and its group's window to a column.
rewards, estimators = Registry("reward"), Registry("estimator")


@rewards("exact")
def _exact(prediction: Column, truth: Column) -> Column:
    return (prediction == truth).cast("double")


@rewards("prefix")
def _prefix(prediction: Column, truth: Column) -> Column:
    return F.startswith(prediction, F.substring(truth, 1, 2)).cast("double")


@estimators("centred")
def _centred(score: Column, group) -> Column:
    return score - F.avg(score).over(group)


@estimators("ranked")
def _ranked(score: Column, group) -> Column:
    return F.percent_rank().over(group.orderBy(score))


@query(EVENT_TEXT_SQL + "SELECT event_id, (event_type = 'click')::INT::DOUBLE AS exact, (event_type LIKE 'cl%')::INT::DOUBLE AS prefix FROM e")
def register_reward(spark, sf_dir):
    """Each registered reward of every row."""
    return _events(spark, sf_dir).select("event_id", *(f(F.col("event_type"), F.lit("click")).alias(name) for name, f in rewards.known.items()))


@query(SCORE_SQL + "SELECT g, i, p, q, round(s - mu, 4) AS centred, round(percent_rank() OVER (PARTITION BY g ORDER BY s), 4) AS ranked FROM w")
def register_adv_est(spark, sf_dir):
    """Each registered estimator of every score within its group; one shuffle for all."""
    w = Window.partitionBy("g")
    return scores(spark, sf_dir).select("g", "i", "p", "q", *(rnd(estimators[n](F.col("s"), w), 4).alias(n) for n in ("centred", "ranked")))


def load(path: str, name: str):
    """A function or class out of a Python file, and the file's text, which tasks run by themselves."""
    spec = importlib.util.spec_from_file_location("custom", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    return getattr(module, name)


def custom_reward(source: str, name: str) -> Callable[[Column, Column], Column]:
    """A column function from the text of a Python file: its function takes two series. Tasks get the text, not the path, so
    they need not see the driver's folders."""

    def run(predictions: pd.Series, truths: pd.Series) -> pd.Series:
        space: dict = {}
        exec(compile(source, "custom", "exec"), space)  # the user's own code, by their own choice
        return space[name](predictions, truths).astype("float64")

    return F.pandas_udf(run, "double")


@query(EVENT_TEXT_SQL + "SELECT event_id, (length(event_type) - 5)::DOUBLE AS score FROM e")
def custom_reward_fn(spark, sf_dir):
    f = custom_reward("def by_length(p, t):\n    return p.str.len() - t.str.len()\n", "by_length")
    return _events(spark, sf_dir).select("event_id", f(F.col("event_type"), F.lit("click")).alias("score"))


class Numbers(DataSource):
    """A source of a user's own: squares of the numbers below ``n``, in some partitions."""

    @classmethod
    def name(cls) -> str:
        return "tidegrove_numbers"

    def schema(self) -> str:
        return "k bigint, square bigint"

    def reader(self, schema) -> DataSourceReader:
        n, parts = int(self.options.get("n", "100")), int(self.options.get("parts", "4"))

        class Reader(DataSourceReader):
            def partitions(self):
                return [InputPartition(p) for p in range(parts)]

            def read(self, partition) -> Iterator[tuple]:
                for k in range(partition.value, n, parts):
                    yield k, k * k

        return Reader()


@query("SELECT range AS k, range * range AS square FROM range(100)")
def custom_dataset(spark, sf_dir):
    spark.dataSource.register(Numbers)
    return spark.read.format("tidegrove_numbers").option("n", "100").load()


@query("SELECT l_returnflag AS k, count(*) AS n, round(sum(l_tax), 4) AS total, round(max(l_tax), 4) AS most FROM lineitem GROUP BY ALL")
def dispatch_mode(spark, sf_dir):
    """Work dealt to tasks by a split function and put together by a collect function: partial results of each task's rows, then
    their merge, as an aggregate of a user's own."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.groupby("k", as_index=False).agg(n=("x", "size"), total=("x", "sum"), most=("x", "max"))

    def collect(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.groupby("k", as_index=False).agg(n=("n", "sum"), total=("total", "sum"), most=("most", "max"))

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_tax").alias("x"))
    schema = "k string, n bigint, total double, most double"
    done = rows.mapInPandas(split, schema).groupBy("k").applyInPandas(collect, schema)
    return done.select("k", "n", rnd("total", 4).alias("total"), rnd("most", 4).alias("most"))


def rounds(seeds: DataFrame, prompt: Column, good: Column, make_client, most: int, tries: int = 3) -> DataFrame:
    """Seeds asked of a client round by round: replies that are good are kept, other seeds are asked again with the number of
    the round, until ``most`` are there or ``tries`` rounds are over. Each round's replies are checkpointed, so no seed is asked
    twice for one number and the next round reads what was left."""
    left, kept, n = seeds, None, 0
    for k in range(tries):
        asked = infer(left.withColumn("_prompt", F.concat(prompt, F.lit(f" #{k}"))), "_prompt", "reply", make_client).withColumn("round", F.lit(k)).withColumn("_good", F.coalesce(good, F.lit(False)))
        asked = fixed(asked)
        now = asked.where("_good").drop("_good", "_prompt")
        kept = now if kept is None else kept.unionByName(now)
        left = asked.where("NOT _good").drop("_good", "_prompt", "reply", "round")
        n += now.count()
        if n >= most or left.isEmpty():
            break
    return kept


@query("SELECT n_nationkey AS k, CASE WHEN length(n_name) % 3 = 0 THEN 0 WHEN length(n_name) % 3 = 2 THEN 1 ELSE 2 END AS round, length(n_name)::BIGINT AS said FROM nation")
def evol_rounds(spark, sf_dir):
    """A client whose replies are good when name and round fit: every nation is done after three rounds."""

    def client():
        return lambda texts: [f"{len(t.rsplit(' #', 1)[0])} {(len(t.rsplit(' #', 1)[0]) + int(t.rsplit('#', 1)[1])) % 3}" for t in texts]

    seeds = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    done = rounds(seeds, F.col("name"), F.split("reply", " ")[1] == "0", client, most=1000)
    return done.select("k", "round", F.split("reply", " ")[0].cast("bigint").alias("said"))


@query(EVENT_TEXT_SQL + "SELECT event_id, 'channel ' || user_id || ': ' || event_type || ' of ' || printf('%.2f', v) || CASE WHEN even THEN ', periodic' ELSE '' END || '.' AS line FROM e")
def render_metric_attrs(spark, sf_dir):
    """Attributes of a measure as a line to show; absent ones are left out."""
    c = F.col
    return _events(spark, sf_dir).select("event_id", _said("channel ", c("user_id"), ": ", F.concat_ws(", ", F.concat(c("event_type"), F.lit(" of "), _two(c("v"))), F.when(c("even"), "periodic")), ".").alias("line"))
