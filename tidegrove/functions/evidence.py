"""How near listed segments and events are to the true ones.

Segments are compared place by place with array functions. Events have no order: each predicted one is given to at most
one true one so that the sum of their scores is largest, in Arrow batches, as no built-in assigns; lists of equal lengths are
assigned together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.cross import CHANNEL_SQL, WIDTH, pairs
from ..operators.segments import segment
from ..operators.series import series
from ..registry import query, rnd, table

# How sharply scores fall with distance, floors, bonus and penalties.
K_POSITION, K_AMPLITUDE = 0.05, 0.10
EVENT_FLOOR, SEGMENT_FLOOR, COUNT_BONUS, INVENTED = 0.08, 0.05, 0.05, 0.20
# Types that are partly right for each other, either way round.
ALIKE = [
    ("upward spike", "downward spike", 0.10), ("sudden increase", "sudden decrease", 0.10), ("upward spike", "sudden increase", 0.6), ("downward spike", "sudden decrease", 0.6),
    ("upward spike", "continuous upward spike", 0.8), ("downward spike", "continuous downward spike", 0.8), ("upward convex", "wide upward spike", 0.75), ("downward convex", "wide downward spike", 0.75),
    ("upward spike", "rapid rise followed by slow decline", 0.6), ("upward spike", "slow rise followed by rapid decline", 0.6), ("downward spike", "rapid decline followed by slow rise", 0.6), ("downward spike", "slow decline followed by rapid rise", 0.6),
    ("upward spike", "decrease after upward spike", 0.5), ("upward spike", "increase after upward spike", 0.5), ("downward spike", "increase after downward spike", 0.5), ("downward spike", "decrease after downward spike", 0.5),
    ("linear increase", "increase", 0.9), ("linear decrease", "decrease", 0.9), ("no trend", "steady", 0.9), ("no trend", "flat", 0.9), ("none", "no periodic fluctuation", 0.9),
    ("downward spike", "downward convex", 0.5), ("upward spike", "upward convex", 0.5), ("shake", "downward spike", 0.3), ("shake", "upward spike", 0.3), ("shake", "sudden decrease", 0.3), ("shake", "sudden increase", 0.3),
    ("steady", "keep steady", 0.95), ("no trend", "keep steady", 0.9), ("steady", "flat", 0.9), ("keep steady", "flat", 0.9), ("steady", "no change", 0.9),
    ("periodic fluctuation", "sin periodic fluctuation", 0.85), ("periodic fluctuation", "square periodic fluctuation", 0.85),
]
KINDS = {"spike", "convex", "sudden", "shake"}
_ALIKE = {frozenset((a, b)): s for a, b, s in ALIKE}


def similarity(a: str | None, b: str | None) -> float:
    """1 for the same type, else what is listed, 0.4 if one holds the other, 0.15 for a shared kind, 0."""
    a, b = (str(x or "").lower().strip().replace("_", " ") for x in (a, b))
    if a == b or frozenset((a, b)) in _ALIKE:
        return 1.0 if a == b else _ALIKE[frozenset((a, b))]
    if min(len(a), len(b)) >= 4 and (a in b or b in a):
        return 0.4
    return 0.15 if set(a.split()) & set(b.split()) & KINDS else 0.0


def type_similarity(a: Column, b: Column) -> Column:
    """The same as a column function."""
    a, b = (F.regexp_replace(F.trim(F.lower(F.coalesce(x, F.lit("")))), "_", " ") for x in (a, b))
    listed = F.try_element_at(F.create_map(*(F.lit(x) for p, q, s in ALIKE for pair in ((p, q), (q, p)) for x in ("|".join(pair), s))), F.concat_ws("|", a, b))
    within = (F.least(F.length(a), F.length(b)) >= 4) & (F.contains(a, b) | F.contains(b, a))
    shared = F.size(F.array_intersect(F.array_intersect(F.split(a, r"\s+"), F.split(b, r"\s+")), F.array(*map(F.lit, sorted(KINDS))))) > 0
    return F.when(a == b, 1.0).when(listed.isNotNull(), listed).when(within, 0.4).when(shared, 0.15).otherwise(0.0)


def segments_score(predicted: Column, truth: Column, length: Column) -> Column:
    """Of arrays of (type, start, stop): half for types, a quarter for each end, less for a wrong number of segments."""
    n, m = F.size(predicted), F.size(truth)
    near = lambda p, g: F.exp(-F.abs(p - g) / (K_POSITION * F.greatest(length, F.lit(1e-6))))

    def one(pair: Column) -> Column:
        t = type_similarity(pair["p"]["type"], pair["g"]["type"])
        return 0.5 * t + 0.25 * (0.5 + 0.5 * t) * (near(pair["p"]["start"], pair["g"]["start"]) + near(pair["p"]["stop"], pair["g"]["stop"]))

    both = F.slice(F.arrays_zip(predicted.alias("p"), truth.alias("g")), F.lit(1), F.least(n, m))
    raw = F.aggregate(both, F.lit(0.0), lambda a, x: a + one(x)) / m * F.greatest(F.lit(0.5), 1 - 0.2 * F.abs(n - m))
    return F.when((n <= 0) & (m <= 0), 1.0).when((n <= 0) | (m <= 0), 0.0).otherwise(F.greatest(raw, SEGMENT_FLOOR + F.when(n == m, COUNT_BONUS).otherwise(0.0)))


def assign_all(gain: np.ndarray) -> np.ndarray:
    """Of many matrices of one shape, with no more rows than columns, the columns of the rows so that the sum of their gains is
    largest, each column once: shortest augmenting paths, a step of all matrices at a time."""
    many, rows, cols = gain.shape
    u, v, owner = np.zeros((many, rows)), np.zeros((many, cols)), np.full((many, cols), -1)
    for start in range(rows):
        best, back, done = np.full((many, cols), np.inf), np.full((many, cols), -1), np.zeros((many, cols), bool)
        row, col, seen = np.full(many, start), np.full(many, -1), np.zeros((many, rows), bool)
        live = np.arange(many)
        while live.size:
            r, near, way, shut = row[live], best[live], back[live], done[live]
            seen[live, r] = True
            slack = -gain[live, r] - u[live, r][:, None] - v[live]
            closer = ~shut & (slack < near)
            near, way = np.where(closer, slack, near), np.where(closer, col[live][:, None], way)
            nxt = np.where(shut, np.inf, near).argmin(axis=1)
            at = np.arange(live.size), nxt
            d = near[at][:, None]
            u[live] += d * seen[live]
            v[live] -= d * shut
            best[live], back[live] = near - d * ~shut, way
            shut[at] = True
            done[live], col[live] = shut, nxt
            taken = owner[live, nxt]
            live = live[taken >= 0]
            row[live] = taken[taken >= 0]
        live = np.arange(many)
        while live.size:
            c = col[live]
            prev = back[live, c]
            owner[live, c] = np.where(prev >= 0, owner[live, prev], start)
            col[live] = prev
            live = live[prev >= 0]
    out = np.empty((many, rows), int)
    k, c = np.nonzero(owner >= 0)
    out[k, owner[k, c]] = c
    return out


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs with the largest sum of gains, each row and column once."""
    if gain.shape[0] > gain.shape[1]:
        return sorted((r, c) for c, r in assign(gain.T))
    return list(enumerate(assign_all(gain[None])[0].tolist()))


def pair_score(p: dict, g: dict, length: float) -> float:
    """The mean of type, place and amplitude; the last two count half if the type is all wrong, and 0 if not given."""
    t = similarity(p["type"], g["type"])
    part = lambda k, scale: 0.0 if p[k] is None else float(np.exp(-abs(p[k] - g[k]) / scale))
    rest = [part(k, s) for k, s in (("pos", K_POSITION * max(length, 1e-6)), ("amplitude", K_AMPLITUDE * max(abs(g["amplitude"] or 0.0), 1e-6))) if g[k] is not None]
    return (t + (0.5 + 0.5 * t) * sum(rest)) / (1 + len(rest))


def gains(p: dict, g: dict, length: np.ndarray, words: list[str]) -> np.ndarray:
    """``pair_score`` of each true event (second axis) with each told one (third), for many lists of one length. Types are places
    in ``words``, of which each pair is looked up once; what is not given is NaN."""
    both, at = np.unique(g["type"][:, :, None] * len(words) + p["type"][:, None, :], return_inverse=True)
    t = np.array([similarity(*(words[w] for w in divmod(x, len(words)))) for x in both.tolist()])[at].reshape(len(length), g["type"].shape[1], p["type"].shape[1])
    scales = {"pos": K_POSITION * np.maximum(length, 1e-6)[:, None, None], "amplitude": K_AMPLITUDE * np.maximum(np.abs(g["amplitude"]), 1e-6)[:, :, None]}
    rest, n = np.zeros(t.shape), 1
    for k, scale in scales.items():
        rest += np.nan_to_num(np.exp(-np.abs(p[k][:, None, :] - g[k][:, :, None]) / scale))
        n = n + ~np.isnan(g[k])[:, :, None]
    return (t + (0.5 + 0.5 * t) * rest) / n


EVENT = pa.struct([("type", pa.string()), ("pos", pa.float64()), ("amplitude", pa.float64())])
#: Pairs of events that are scored at once; lists with more are taken one by one.
CELLS = 1 << 20


def events_scores(predicted: pa.Array, truth: pa.Array, length: np.ndarray) -> np.ndarray:
    """Of arrays of lists of (type, pos, amplitude). Null is an empty list; inventing events where there are none costs a fifth
    each. Lists of equal lengths are scored together."""
    flat = [{f.name: pc.struct_field(x, f.name).cast(f.type) for f in EVENT} for x in (predicted.flatten(), truth.flatten())]
    m, n = (x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int) for x in (predicted, truth))
    types = pa.concat_arrays([x["type"] for x in flat]).fill_null("").dictionary_encode()
    codes, words = np.split(types.indices.to_numpy(zero_copy_only=False).astype(int), [m.sum()]), types.dictionary.to_pylist()
    told, true = ({"type": c} | {k: x[k].to_numpy(zero_copy_only=False).astype(float) for k in ("pos", "amplitude")} for c, x in zip(codes, flat, strict=True))
    cut = lambda side, sizes, rows, k: {name: x[(sizes.cumsum() - sizes)[rows, None] + np.arange(k)] for name, x in side.items()}

    out = np.where(n == 0, np.maximum(0.0, 1 - INVENTED * m), 0.0)
    rows = np.flatnonzero((n > 0) & (m > 0))
    rows = rows[np.lexsort((m[rows], n[rows]))]
    for alike in np.split(rows, 1 + np.flatnonzero(np.diff(n[rows]) | np.diff(m[rows]))) if len(rows) else []:
        a, b = int(n[alike[0]]), int(m[alike[0]])
        step = max(1, CELLS // (a * b))
        for some in (alike[k : k + step] for k in range(0, len(alike), step)):
            gain = gains(cut(told, m, some, b), cut(true, n, some, a), length[some], words)
            gain = gain if a <= b else gain.transpose(0, 2, 1)
            total = np.take_along_axis(gain, assign_all(gain)[:, :, None], 2).sum(axis=(1, 2))
            out[some] = np.maximum(total / max(a, b), EVENT_FLOOR + (COUNT_BONUS if a == b else 0.0))
    return out


def events_score(predicted, truth, length: float) -> float:
    """Of two lists."""
    return float(events_scores(pa.array([predicted], pa.list_(EVENT)), pa.array([truth], pa.list_(EVENT)), np.array([float(length)]))[0])


def events_score_column(predicted: Column, truth: Column, length: Column) -> Column:
    @F.arrow_udf("double")
    def score(p: pa.Array, g: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array(events_scores(p, g, n.to_numpy(zero_copy_only=False)))

    return score(predicted, truth, length.cast("double"))


@query(CHANNEL_SQL + f""", c AS (SELECT sid, count(*) AS k FROM g GROUP BY sid), nn AS (SELECT DISTINCT sid, n FROM s),
z AS (SELECT gx.sid AS a, gy.sid AS b, n, CASE WHEN gx.type = gy.type THEN 1.0 ELSE 0.0 END::DOUBLE AS t, exp(-abs(gx.start - gy.start) / (0.05::DOUBLE * n)) + exp(-abs(gx.stop - gy.stop) / (0.05::DOUBLE * n)) AS e FROM g gx JOIN g gy ON gx.sid // {WIDTH} = gy.sid // {WIDTH} AND gx.sid < gy.sid AND gx.seg = gy.seg JOIN nn ON nn.sid = gx.sid),
y AS (SELECT a, b, sum(0.5 * t + 0.25 * (0.5 + 0.5 * t) * e) AS s FROM z GROUP BY a, b)
SELECT a, b, round(greatest(s / x.k * greatest(0.5, 1 - 0.2 * abs(x.k - w.k)), CASE WHEN x.k = w.k THEN 0.1 ELSE 0.05 END), 4) AS score FROM y JOIN c x ON x.sid = a JOIN c w ON w.sid = b""")
def score_trend_segments(spark, sf_dir):
    """Of two channels the first one's segments are the truth, the other's the prediction."""
    p = series(spark, sf_dir)
    n = p.groupBy("sid").agg(F.max("n").alias("n"))
    g = segment(p).groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "type", "start", "stop"))), lambda x: F.struct(x["type"].alias("type"), x["start"].alias("start"), x["stop"].alias("stop"))).alias("g"))
    ch = g.join(n, "sid").withColumn("sample", F.floor(F.col("sid") / WIDTH))
    return pairs(ch).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), rnd(segments_score(F.col("y.g"), F.col("x.g"), F.col("x.n")), 4).alias("score"))


@query()
def score_local_events(spark, sf_dir):
    """An order's lines are events: those of odd part numbers are told, at the place that the discount moves them to."""
    li = table(spark, sf_dir, "lineitem")
    event = lambda shift: F.struct(F.col("l_returnflag").alias("type"), (F.col("l_linenumber") + shift).cast("double").alias("pos"), F.col("l_quantity").alias("amplitude"))
    o = li.groupBy(F.col("l_orderkey").alias("g")).agg(F.array_sort(F.collect_list(event(F.lit(0.0)))).alias("truth"), F.array_sort(F.collect_list(F.when(F.col("l_partkey") % 2 == 1, event(10 * F.col("l_discount"))))).alias("told"))  # an order has a few lines
    return o.select("g", F.size("truth").alias("n"), F.size("told").alias("told"), rnd(events_score_column(F.col("told"), F.col("truth"), F.lit(20)), 6).alias("score"))
