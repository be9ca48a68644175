"""Policy losses by name, as one aggregation over the steps of answers.

A loss is a function of step columns: the logarithms of probabilities now (``lp``) and when sampled (``old``), the advantage
(``adv``), and for losses of whole answers the mean log ratio of the answer (``seq``). It gives the step's loss and whether it was
clipped from above and from below. Steps outside of the mask count nowhere. All losses and all ways to sum them come from one
grouping by answer, whose sums Spark combines before its shuffle, and one row over the answers.

Defined cases: an answer without steps under the mask counts as an answer of loss 0; without any such step the token mean is
null; an unknown name or way fails at once. Ratios are taken from log ratios clamped to +-20, of whole answers to 10 at most.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query, rnd
from .rollouts import LOG_CLAMP, STEP_SQL, steps

SEQ_CLAMP = 10.0
MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


class Clip(NamedTuple):
    """Bounds of the ratio around 1, and the bound of the loss of negative advantages."""

    low: float = 0.2
    high: float = 0.2
    dual: float = 3.0


class Loss(NamedTuple):
    value: Column
    clipped: Column
    lower: Column


_losses: dict[str, Callable[[Column, Column, Column, Column, Clip], Loss]] = {}


def register_policy_loss(name: str):
    """Makes a function of (lp, old, adv, seq, clip) known by a name."""

    def add(f):
        _losses[name] = f
        return f

    return add


def policy_loss(name: str) -> Callable[[Column, Column, Column, Column, Clip], Loss]:
    if name not in _losses:
        raise ValueError(f"no policy loss {name!r}; there are {sorted(_losses)}")
    return _losses[name]


def _clipped(ratio: Column, adv: Column, clip: Clip) -> tuple[Column, Column]:
    return -adv * ratio, -adv * F.greatest(F.lit(1 - clip.low), F.least(F.lit(1 + clip.high), ratio))


@register_policy_loss("vanilla")
def vanilla(lp: Column, old: Column, adv: Column, seq: Column, clip: Clip) -> Loss:
    """The worse of the ratio and the clipped ratio; for negative advantages ``dual`` times the advantage at worst."""
    ratio = F.exp(F.greatest(F.lit(-LOG_CLAMP), F.least(F.lit(LOG_CLAMP), lp - old)))
    plain, bound = _clipped(ratio, adv, clip)
    worse, dual = F.greatest(plain, bound), -adv * clip.dual
    return Loss(F.when(adv < 0, F.least(dual, worse)).otherwise(worse), bound > plain, (worse > dual) & (adv < 0))


@register_policy_loss("gspo")
def of_answers(lp: Column, old: Column, adv: Column, seq: Column, clip: Clip) -> Loss:
    """One ratio for a whole answer: the geometric mean of its steps'."""
    plain, bound = _clipped(F.exp(F.least(F.lit(SEQ_CLAMP), seq)), adv, clip)
    return Loss(F.greatest(plain, bound), bound > plain, F.lit(False))


@register_policy_loss("gpg")
def gradient(lp: Column, old: Column, adv: Column, seq: Column, clip: Clip) -> Loss:
    """The plain policy gradient, without a ratio."""
    return Loss(-lp * adv, F.lit(False), F.lit(False))


def losses(rows: DataFrame, names: list[str] | None = None, clip: Clip = Clip(), scale: float | None = None) -> DataFrame:
    """``rows`` has (g, t, lp, old, adv, mask). Returns (loss, mode, value, clipped, lower, kl), a row for each loss and mode. The
    norm of the last mode is ``scale``, else the longest answer's number of steps."""
    found = {n: policy_loss(n) for n in (names or sorted(_losses))}
    on = F.col("mask").cast("int")
    mean = rows.groupBy("g").agg((F.sum(on * (F.col("lp") - F.col("old"))) / F.greatest(F.sum(on), F.lit(1))).alias("seq"))
    d = rows.join(mean, "g")
    made = {n: f(*(F.col(c) for c in ("lp", "old", "adv", "seq")), clip) for n, f in found.items()}
    sums = [x.alias(f"{k}{i}") for i, loss in enumerate(made.values()) for k, x in (("v", F.sum(on * loss.value)), ("c", F.sum(on * loss.clipped.cast("int"))), ("l", F.sum(on * loss.lower.cast("int"))))]
    each = d.groupBy("g").agg(F.sum(on).alias("n"), F.max("t").alias("width"), F.sum(on * (F.col("old") - F.col("lp"))).alias("kl"), *sums)
    total = lambda c: F.sum(F.col(c) if isinstance(c, str) else c)
    tokens, answers = F.nullif(total("n"), F.lit(0)), F.count(F.lit(1))
    norm = F.lit(scale) if scale else F.max("width")
    out = []
    for i, name in enumerate(found):
        v = F.col(f"v{i}")
        ways = (total(v) / tokens, total(v) / answers, total(v / (F.col("n") + 1e-8)) / answers, total(v) / norm / answers)
        out += [F.struct(F.lit(name).alias("loss"), F.lit(mode).alias("mode"), way.alias("value"), (total(f"c{i}") / tokens).alias("clipped"), (total(f"l{i}") / tokens).alias("lower"), (total("kl") / tokens).alias("kl")) for mode, way in zip(MODES, ways, strict=True)]
    return each.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")


_SQL = STEP_SQL + """, d AS (SELECT g, t, r - 1 AS lp, r - 1 - 8 * lr AS old, s - 0.5 AS adv, token > 2 AS mask FROM st), q AS (SELECT *, avg(lp - old) FILTER (mask) OVER (PARTITION BY g) AS seq, exp(lp - old) AS ratio FROM d),
e AS (SELECT *, exp(least(10, coalesce(seq, 0))) AS sr FROM q), f AS (SELECT *, -adv * ratio AS a, -adv * greatest(0.8, least(1.2, ratio)) AS b, -adv * sr AS sa, -adv * greatest(0.8, least(1.2, sr)) AS sb FROM e),
w AS (SELECT g, t, lp - old AS lr, mask, unnest(['vanilla', 'gspo', 'gpg']) AS loss, unnest([CASE WHEN adv < 0 THEN least(-adv * 3, greatest(a, b)) ELSE greatest(a, b) END, greatest(sa, sb), -lp * adv]) AS v, unnest([b > a, sb > sa, false]) AS c, unnest([adv < 0 AND greatest(a, b) > -adv * 3, false, false]) AS l FROM f),
p AS (SELECT loss, g, max(t) AS width, count(*) FILTER (mask) AS n, coalesce(sum(v) FILTER (mask), 0) AS v, count(*) FILTER (mask AND c) AS c, count(*) FILTER (mask AND l) AS l, coalesce(sum(-lr) FILTER (mask), 0) AS kl FROM w GROUP BY loss, g),
z AS (SELECT loss, unnest(['token-mean', 'seq-mean-token-sum', 'seq-mean-token-mean', 'seq-mean-token-sum-norm']) AS mode, unnest([sum(v) / sum(n), sum(v) / count(*), sum(v / (n + 1e-8)) / count(*), sum(v) / max(width) / count(*)]) AS value, sum(c) / sum(n) AS clipped, sum(l) / sum(n) AS lower, sum(kl) / sum(n) AS kl FROM p GROUP BY loss)
SELECT loss, mode, round(value, 6) AS value, round(clipped, 6) AS clipped, round(lower, 6) AS lower, round(kl, 6) AS kl FROM z"""


@query(_SQL)
def policy_losses(spark, sf_dir):
    """Every registered loss in every way to sum it, over all steps; orders are answers."""
    s = steps(spark, sf_dir)
    lp = F.col("r") - 1
    rows = s.select("g", "t", lp.alias("lp"), (lp - 8 * F.col("lr")).alias("old"), (F.col("s") - 0.5).alias("adv"), (F.col("token") > 2).alias("mask"))
    return losses(rows).select("loss", "mode", *(rnd(c, 6).alias(c) for c in ("value", "clipped", "lower", "kl")))
