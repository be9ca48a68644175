"""Rows of training data from questions and answers: prompts, targets, masks, series in text, and what must hold of them.

The functions take and return columns or DataFrames; the queries apply them to conversations (a turn is a question, the
next one its answer), embeddings (series) and orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, rnd, table
from .algebra import numbered

SOURCE, ABILITY = "tidegrove", "time-series-reasoning"
TURN_SQL = "WITH q AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) "


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, text, answer): a message and the one after it."""
    c = table(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.select("conv_id", "turn", "role", "text").join(nxt, ["conv_id", "turn"], "left")


def base_fields(rows: DataFrame, split: str, index: str = "index", question: str = "input", kind: str = "eval_type") -> DataFrame:
    """``rows`` with the fields that all prepared rows have: data_source, prompt, ability, extra_info."""
    info = F.to_json(F.struct(F.lit(split).alias("split"), F.col(index).alias("index"), F.coalesce(F.col(kind), F.lit("")).alias("eval_type")))
    prompt = F.array(F.struct(F.lit("user").alias("role"), F.col(question).alias("content")))
    return rows.withColumns({"data_source": F.lit(SOURCE), "prompt": prompt, "ability": F.lit(ABILITY), "extra_info": info})


def reward_model(answer: str = "output", kind: str = "eval_type") -> Column:
    return F.to_json(F.struct(F.lit("rule").alias("style"), F.col(answer).alias("ground_truth"), F.coalesce(F.col(kind), F.lit("")).alias("eval_type")))


def _questions(spark, sf_dir) -> DataFrame:
    q = turns(spark, sf_dir).where("role = 'user' and answer is not null")
    return q.select("conv_id", "turn", F.col("text").alias("input"), F.col("answer").alias("output"), F.when(F.col("turn") % 3 > 0, F.concat(F.lit("t"), F.col("turn") % 3)).alias("eval_type"), (F.col("conv_id") * 1000 + F.col("turn")).alias("index"))


QUESTION_SQL = TURN_SQL + ", p AS (SELECT conv_id, turn, text AS input, answer AS output, coalesce(CASE WHEN turn % 3 > 0 THEN 't' || (turn % 3) END, '') AS kind, conv_id * 1000 + turn AS idx FROM q WHERE role = 'user' AND answer IS NOT NULL) "


@query(QUESTION_SQL + f"SELECT conv_id, turn, '{SOURCE}' AS data_source, 'user' AS role, input AS content, '{ABILITY}' AS ability, 'train' AS split, idx AS index, kind FROM p")
def to_base_fields(spark, sf_dir):
    b = base_fields(_questions(spark, sf_dir), "train")
    info = lambda k: F.get_json_object("extra_info", f"$.{k}")
    return b.select("conv_id", "turn", "data_source", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "ability", info("split").alias("split"), info("index").cast("bigint").alias("index"), info("eval_type").alias("kind"))


def to_sft_rows(rows: DataFrame) -> DataFrame:
    """A prompt and its response."""
    return base_fields(rows, "train").withColumn("response", F.col("output"))


def to_rl_rows(rows: DataFrame) -> DataFrame:
    """A prompt and what its answers are judged by."""
    return base_fields(rows, "train").withColumn("reward_model", reward_model())


def to_val_rows(rows: DataFrame) -> DataFrame:
    return base_fields(rows, "val").withColumn("response", F.col("output")).withColumn("reward_model", reward_model())


@query(QUESTION_SQL + "SELECT conv_id, turn, input AS content, output AS response FROM p")
def to_sft(spark, sf_dir):
    return to_sft_rows(_questions(spark, sf_dir)).select("conv_id", "turn", F.col("prompt")[0]["content"].alias("content"), "response")


@query(QUESTION_SQL + "SELECT conv_id, turn, 'rule' AS style, output AS ground_truth, kind FROM p")
def to_rl(spark, sf_dir):
    r = to_rl_rows(_questions(spark, sf_dir))
    field = lambda k: F.get_json_object("reward_model", f"$.{k}")
    return r.select("conv_id", "turn", field("style").alias("style"), field("ground_truth").alias("ground_truth"), field("eval_type").alias("kind"))


@query(QUESTION_SQL + "SELECT conv_id, turn, 'val' AS split, output AS response, output AS ground_truth FROM p")
def to_val(spark, sf_dir):
    v = to_val_rows(_questions(spark, sf_dir))
    return v.select("conv_id", "turn", F.get_json_object("extra_info", "$.split").alias("split"), "response", F.get_json_object("reward_model", "$.ground_truth").alias("ground_truth"))


def popped(df: DataFrame, columns: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """The columns taken out, with the key, and what is left."""
    return df.select(key, *columns), df.drop(*columns)


@query("SELECT doc_id, source, n_chars FROM documents")
def pop_columns(spark, sf_dir):
    return popped(table(spark, sf_dir, "documents"), ["lang", "text"], "doc_id")[1]


def aligned(df: DataFrame, other: DataFrame) -> DataFrame:
    """The columns of ``df`` in the order of ``other``'s."""
    return df.select(*other.columns)


@query("SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_regionkey, n_name FROM nation")
def align_schema(spark, sf_dir):
    a = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return a.union(aligned(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("k")), a))


def flattened(df: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """A row for each place of some parallel lists; shorter ones give nulls."""
    return df.select(key, F.posexplode(F.arrays_zip(*lists)).alias("place", "_x")).select(key, "place", *(F.col(f"_x.{c}").alias(c) for c in lists))


@query("SELECT conv_id, place::INT AS place, roles[place + 1] AS roles, turns[place + 1] AS turns FROM (SELECT conv_id, unnest(range(len(roles))) AS place, roles, turns FROM (SELECT conv_id, list(role ORDER BY turn) AS roles, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY conv_id))")
def flatten_pairs(spark, sf_dir):
    m = F.array_sort(F.collect_list(F.struct("turn", "role")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(m.alias("m"))
    return flattened(c.select("conv_id", F.col("m.role").alias("roles"), F.col("m.turn").alias("turns")), "conv_id", ["roles", "turns"])


@query("SELECT i // 4 AS batch, string_agg(k::VARCHAR, ',' ORDER BY k) AS members, count(*) AS n FROM (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) GROUP BY ALL")
def fold_batch(spark, sf_dir, size: int = 4):
    """[b, ...] to [b/k, k, ...]: k rows are one, in order."""
    s = numbered(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k")
    return s.groupBy(F.floor(F.col("_i") / size).alias("batch")).agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("members"), F.count(F.lit(1)).alias("n"))


@query("SELECT i // 8 AS batch, string_agg(n::VARCHAR, ' ' ORDER BY k) AS sizes, count(*) AS n, string_agg(k::VARCHAR, ' ' ORDER BY k) AS keys FROM (SELECT p_partkey AS k, p_size AS n, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) GROUP BY ALL")
def collate(spark, sf_dir, size: int = 8):
    """Rows of dictionaries to a dictionary of columns: a batch has one list for each field, in the order of the key."""
    p = numbered(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n")), "k")
    b = p.groupBy(F.floor(F.col("_i") / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("rows"))
    return b.select("batch", F.array_join("rows.n", " ").alias("sizes"), F.size("rows").cast("bigint").alias("n"), F.array_join("rows.k", " ").alias("keys"))


def response_loss_mask(prompt: Column, response: Column, most: Column | int) -> Column:
    """0 on the prompt, 1 on the response, 0 on its last token; cut or filled up with 0 to ``most`` places."""
    most = F.lit(most) if isinstance(most, int) else most
    last = F.least(prompt + response, most) - 1
    return F.transform(F.sequence(F.lit(0), most - 1), lambda i: ((i >= prompt) & (i < last)).cast("int"))


@query(QUESTION_SQL + "SELECT conv_id, turn, greatest(0, least(a + b, 64) - 1 - a)::BIGINT AS trained, 64 AS size FROM (SELECT conv_id, turn, len(string_split(input, ' ')) AS a, len(string_split(output, ' ')) AS b FROM p)")
def loss_mask(spark, sf_dir, most: int = 64):
    q = _questions(spark, sf_dir).select("conv_id", "turn", F.size(F.split("input", " ")).alias("a"), F.size(F.split("output", " ")).alias("b"))
    m = response_loss_mask(F.col("a"), F.col("b"), most)
    return q.select("conv_id", "turn", m.alias("m")).select("conv_id", "turn", F.aggregate("m", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("trained"), F.size("m").alias("size"))


def padded(values: Column, size: int, fill: Column, left: bool = False, cut: str = "right") -> Column:
    """An array of exactly ``size``: filled at its end (left: at its front), or cut at its right, left or middle."""
    n = F.size(values)
    rest = F.array_repeat(fill, F.greatest(F.lit(0), F.lit(size) - n))
    whole = F.concat(rest, values) if left else F.concat(values, rest)
    return F.when(n <= size, whole).otherwise(truncated(values, size, cut))


def truncated(values: Column, size: int, how: str = "right") -> Column:
    """The first ``size`` (right), the last (left), or both ends (middle); error: the job fails if there are more."""
    head = size // 2
    cut = {
        "right": lambda: F.slice(values, 1, size),
        "left": lambda: F.slice(values, F.greatest(F.lit(1), F.size(values) - size + 1), F.lit(size)),
        "middle": lambda: F.concat(F.slice(values, 1, head), F.slice(values, F.greatest(F.lit(1), F.size(values) - (size - head) + 1), F.lit(size - head))),
        "error": lambda: F.raise_error("a sequence is too long").cast("array<string>"),
    }[how]()
    return F.when(F.size(values) <= size, values).otherwise(cut)


WORDS_SQL = "WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) "


def _word_lists(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))


@query(WORDS_SQL + "SELECT doc_id, array_to_string(w[1:6], ' ') AS right_cut, array_to_string(w[greatest(1, len(w) - 5):], ' ') AS left_cut, CASE WHEN len(w) <= 6 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:3], ' ') || ' ' || array_to_string(w[len(w) - 2:], ' ') END AS middle_cut FROM w")
def truncate_sequence(spark, sf_dir, size: int = 6):
    text = lambda how: F.array_join(truncated(F.col("w"), size, how), " ")
    return _word_lists(spark, sf_dir).select("doc_id", text("right").alias("right_cut"), text("left").alias("left_cut"), text("middle").alias("middle_cut"))


@query(WORDS_SQL + "SELECT doc_id, array_to_string(CASE WHEN len(w) >= 5 THEN w[1:5] ELSE list_concat(w, list_transform(range(5 - len(w)), lambda i: '<pad>')) END, ' ') AS filled_right, array_to_string(CASE WHEN len(w) >= 5 THEN w[len(w) - 4:] ELSE list_concat(list_transform(range(5 - len(w)), lambda i: '<pad>'), w) END, ' ') AS filled_left FROM w")
def pad_sequence(spark, sf_dir, size: int = 5):
    """To one length, at either end; what is too long is cut at the same end."""
    pad = F.lit("<pad>")
    return _word_lists(spark, sf_dir).select("doc_id", F.array_join(padded(F.col("w"), size, pad), " ").alias("filled_right"), F.array_join(padded(F.col("w"), size, pad, left=True, cut="left"), " ").alias("filled_left"))


@query("SELECT l_orderkey AS g, kind, l_partkey AS p FROM (SELECT l_orderkey, arg_max(l_partkey, struct_pack(v := l_quantity, p := -l_partkey)) AS chosen, arg_min(l_partkey, struct_pack(v := l_quantity, p := l_partkey)) AS rejected FROM lineitem GROUP BY l_orderkey HAVING max(l_quantity) > min(l_quantity)) UNPIVOT (l_partkey FOR kind IN (chosen, rejected))")
def preference_pairs(spark, sf_dir):
    """Of each group with unequal scores the best and the worst answer, a row each."""
    q, p = F.col("l_quantity"), F.col("l_partkey")
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g")).agg(F.max_by("l_partkey", F.struct(q, -p)).alias("chosen"), F.min_by("l_partkey", F.struct(q, p)).alias("rejected"), (F.max(q) > F.min(q)).alias("apart"))
    return g.where("apart").unpivot("g", ["chosen", "rejected"], "kind", "p")


#: Which prompts a judge is given, by the kind of a question.
JUDGED = {"t1": ["answer"], "t2": ["answer", "reasoning"]}


@query(QUESTION_SQL + "SELECT conv_id, turn, task, input || chr(10) || 'Answer: ' || output AS prompt FROM p, (VALUES ('t1', 'answer'), ('t2', 'answer'), ('t2', 'reasoning'), ('', 'answer'), ('', 'reasoning'), ('', 'format')) j(k, task) WHERE j.k = p.kind")
def judge_tasks(spark, sf_dir):
    """One to three prompts for a judge for each answer; what has no kind of its own is judged in all ways."""
    def tasks(names):
        return F.array(*map(F.lit, names))

    kinds = F.when(F.col("eval_type") == "t1", tasks(JUDGED["t1"])).when(F.col("eval_type") == "t2", tasks(JUDGED["t2"])).otherwise(tasks(["answer", "reasoning", "format"]))
    q = _questions(spark, sf_dir).select("conv_id", "turn", F.explode(kinds).alias("task"), F.concat("input", F.lit("\nAnswer: "), "output").alias("prompt"))
    return q


def filled(text: Column, answers: Column) -> Column:
    """``text`` with <|prompt0|>, <|prompt1|>, ... replaced by an array's members; a missing one is empty."""
    places = F.transform(F.split(text, r"<\|prompt"), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.coalesce(F.try_element_at(answers, F.regexp_extract(x, r"^(\d+)\|>", 1).cast("int") + 1), F.lit("")), F.regexp_replace(x, r"^\d+\|>", ""))))
    return F.array_join(places, "")


@query("SELECT n_nationkey AS k, 'In ' || r_name || ': ' || n_name || ' of ' || r_name || '.' AS said FROM nation JOIN region ON n_regionkey = r_regionkey")
def fill_placeholders(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_nationkey").alias("k"), filled(F.lit("In <|prompt1|>: <|prompt0|> of <|prompt1|>.<|prompt7|>"), F.array("n_name", "r_name")).alias("said"))


def without_context(text: Column) -> Column:
    """What stands behind the last <ts>."""
    return F.ltrim(F.substring_index(text, "<ts>", -1))


def with_series(text: Column, series: Column, digits: int = 2) -> Column:
    """``text`` with each <ts> replaced by a series in brackets; the job fails if there are not as many."""
    parts = F.split(text, "<ts>")
    shown = F.transform(series, lambda s: F.concat(F.lit("["), F.array_join(F.transform(s, lambda v: F.format_string(f"%.{digits}f", v)), ", "), F.lit("]")))
    inlined = F.concat(parts[0], F.array_join(F.zip_with(shown, F.slice(parts, 2, 1 << 30), lambda a, b: F.concat(a, b)), ""))
    return F.when(F.size(parts) - 1 == F.size(series), inlined).otherwise(F.raise_error("a text has not as many places as series").cast("string"))


VECTOR_SQL = "WITH v AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: printf('%.2f', x::DOUBLE)) AS a, list_transform(embedding[4:5], lambda x: printf('%.2f', x::DOUBLE)) AS b FROM embeddings) "


@query(VECTOR_SQL + "SELECT vec_id, 'x [' || array_to_string(a, ', ') || '] y [' || array_to_string(b, ', ') || '] what?' AS prompt, 'what?' AS question FROM v")
def inline_series(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    text = F.lit("x <ts> y <ts> what?")
    return e.select("vec_id", with_series(text, F.array(F.slice("e", 1, 3), F.slice("e", 4, 2))).alias("prompt"), without_context(text).alias("question"))


@query("SELECT event_id, ltrim(split_part(event_type || ' <ts> then <ts> ' || user_id, '<ts>', 3)) AS rest FROM events")
def strip_context(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", without_context(F.concat("event_type", F.lit(" <ts> then <ts> "), F.col("user_id").cast("string"))).alias("rest"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: round(x::DOUBLE, 6))), 4) AS total, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def round_series(spark, sf_dir, digits: int = 6):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: rnd(x.cast("double"), digits)).alias("e"))
    return e.select("vec_id", rnd(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.col("e")[0].alias("first"))


def parameters(text: Column) -> Column:
    """k=v pairs of a text as a map; the last of equal names counts."""
    part = lambda k: F.regexp_extract_all(text, F.lit(r"(\w+)=([^,;\s]+)"), k)
    return F.map_from_entries(F.aggregate(F.arrays_zip(part(1).alias("key"), part(2).alias("value")), F.array().cast("array<struct<key:string,value:string>>"), lambda a, x: F.array_append(F.filter(a, lambda y: y["key"] != x["key"]), x)))


def key_points(text: Column) -> Column:
    """label@(i, v) as an array of (label, index, value)."""
    part = lambda k: F.regexp_extract_all(text, F.lit(r"(\w+)@\((-?[0-9]+),\s*(-?[0-9.]+)\)"), k)
    return F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")), lambda x: F.struct(x["a"].alias("label"), x["b"].cast("int").alias("index"), x["c"].cast("double").alias("value")))


@query("SELECT event_id, event_type AS type, user_id::VARCHAR AS place, 'peak' AS label, (user_id % 7)::INT AS index, round(value, 2) AS value, 2 AS n FROM events")
def extract_params(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("type="), "event_type", F.lit(", pos="), F.col("user_id").cast("string"), F.lit("; peak@("), (F.col("user_id") % 7).cast("string"), F.lit(", "), F.format_string("%.2f", rnd("value", 2)), F.lit(") end@(9, 0.5)"))
    return e.select("event_id", parameters(text).alias("p"), key_points(text).alias("k")).select("event_id", F.col("p")["type"].alias("type"), F.col("p")["pos"].alias("place"), F.col("k")[0]["label"].alias("label"), F.col("k")[0]["index"].alias("index"), F.col("k")[0]["value"].alias("value"), F.size("k").alias("n"))


@query("SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents WHERE len(string_split(text, ' ')) <= 200")
def filter_overlong_prompt(spark, sf_dir, most: int = 200):
    return _word_lists(spark, sf_dir).select("doc_id", F.size("w").cast("bigint").alias("n")).where(F.col("n") <= most)


#: Kinds that are always trained on by example: free texts.
FREE_TEXT = ("description", "report")


def forced(kind: Column, bridge: Column) -> Column:
    """Rows with worked steps, or of a free-text kind."""
    return F.coalesce(bridge, F.lit(False)) | F.coalesce(kind.isin(*FREE_TEXT), F.lit(False))


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 OR lang = 'fr'")
def filter_force_sft(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.where(forced(F.when(F.col("lang") == "fr", "description"), F.col("toxic") == 1)).select("doc_id")


GROUPS = {"latin": ["fr", "es"], "germanic": ["en", "de"]}


def in_group(df: DataFrame, column: str, group: str) -> DataFrame:
    """The rows whose kind is in a named group; an unknown name is an error."""
    if group not in GROUPS:
        raise ValueError(f"unknown group {group!r}; there are {', '.join(GROUPS)}")
    return df.where(F.col(column).isin(*GROUPS[group]))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'es')")
def filter_group(spark, sf_dir):
    return in_group(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "latin")


def must_hold(df: DataFrame, **checks: Column) -> DataFrame:
    """``df``; the job fails at the first row that breaks a check. Nothing but the rows' own pass is needed."""
    out = df
    for name, check in checks.items():
        out = out.where(F.coalesce(F.assert_true(F.coalesce(check, F.lit(False)), F.lit(f"{name} does not hold")), F.lit(True)))
    return out


@query("SELECT conv_id, turn FROM conversations")
def filter_assertions(spark, sf_dir):
    """No tag of reasoning is left over, and no role is empty."""
    c = table(spark, sf_dir, "conversations")
    return must_hold(c, tags=~F.coalesce("text", F.lit("")).contains("</think>"), role=F.length("role") > 0).select("conv_id", "turn")


@query("WITH n AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(text) AS texts, count(*) FILTER (length(trim(coalesce(text, ''))) = 0) AS empty, count(*) FILTER (n_chars <> length(text)) AS lengths, count(*) FILTER (lang NOT IN ('en', 'de', 'fr', 'es')) AS langs, count(*) FILTER (source IS NULL) AS sources, count(*) FILTER (n_chars < 0) AS negative FROM documents) SELECT x.c AS check_name, x.b AS broken, x.b = 0 AS holds FROM (SELECT unnest([{'c': 'ids', 'b': n - ids}, {'c': 'texts', 'b': n - texts}, {'c': 'empty', 'b': empty}, {'c': 'lengths', 'b': lengths}, {'c': 'langs', 'b': langs}, {'c': 'sources', 'b': sources}, {'c': 'negative', 'b': negative}, {'c': 'none', 'b': (n = 0)::BIGINT}]) AS x FROM n)")
def data_validity(spark, sf_dir):
    """Eight checks of a data set in one pass: a row for each, with how many rows break it."""
    d = table(spark, sf_dir, "documents")
    n = F.count(F.lit(1))
    found = d.agg((n - F.countDistinct("doc_id")).alias("ids"), (n - F.count("text")).alias("texts"), F.count_if(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0).alias("empty"), F.count_if(F.col("n_chars") != F.length("text")).alias("lengths"), F.count_if(~F.col("lang").isin("en", "de", "fr", "es")).alias("langs"), F.count_if(F.col("source").isNull()).alias("sources"), F.count_if(F.col("n_chars") < 0).alias("negative"), (n == 0).cast("bigint").alias("none"))
    return found.unpivot([], found.columns, "check_name", "broken").withColumn("holds", F.col("broken") == 0)


@query("SELECT count(*) AS n, round(avg((quality IS NULL)::INT), 4) AS missing, count(*) >= 50 AND avg((quality IS NULL)::INT) < 0.9 AS valid FROM documents LEFT JOIN labels USING (doc_id)")
def eval_dir_valid(spark, sf_dir, least: int = 50, missing: float = 0.9):
    """Whether a result is complete enough to be read: rows enough, and not too many without a verdict."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    gone = F.avg(F.col("quality").isNull().cast("int"))
    return d.agg(F.count(F.lit(1)).alias("n"), rnd(gone, 4).alias("missing"), ((F.count(F.lit(1)) >= least) & (gone < missing)).alias("valid"))
