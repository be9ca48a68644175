"""Policy losses against a plain computation, and odd answers."""

import numpy as np
import pytest

from tidegrove.operators import policy as P


def brute(rows, name, mode, clip=P.Clip(), scale=None):
    by = {}
    for g, t, lp, old, adv, mask in rows:
        by.setdefault(g, []).append((t, lp, old, adv, mask))
    token, clipped, lower, kl, n, per = 0.0, 0, 0, 0.0, 0, []
    for own in by.values():
        on = [x for x in own if x[4]]
        seq = sum(lp - old for _, lp, old, _, _ in on) / max(1, len(on))
        mine = 0.0
        for _, lp, old, adv, _ in on:
            ratio = np.exp(min(seq, 10)) if name == "gspo" else np.exp(np.clip(lp - old, -20, 20))
            a, b = -adv * ratio, -adv * np.clip(ratio, 1 - clip.low, 1 + clip.high)
            x = max(a, b)
            if name == "gpg":
                x = -lp * adv
            else:
                clipped += b > a
                if name == "vanilla" and adv < 0:
                    lower += x > -adv * clip.dual
                    x = min(x, -adv * clip.dual)
            mine += x
            kl += old - lp
        n += len(on)
        token += mine
        per.append((mine, len(on)))
    width = scale or max(x[0] for own in by.values() for x in own)
    value = {"token-mean": token / n, "seq-mean-token-sum": token / len(per), "seq-mean-token-mean": sum(m / (c + 1e-8) for m, c in per) / len(per), "seq-mean-token-sum-norm": token / width / len(per)}[mode]
    return value, clipped / n, lower / n, kl / n


@pytest.mark.parametrize("clip", [P.Clip(), P.Clip(0.1, 0.3, 1.5)])
def test_losses_equal_a_plain_computation(spark, clip):
    r = np.random.default_rng(8)
    rows = [(g, t, float(-r.exponential()), float(-r.exponential() * (30 if g == 3 else 1)), float(r.normal()), bool(r.random() < 0.7) and g != 5) for g in range(12) for t in range(1, 2 + g)]
    d = spark.createDataFrame(rows, "g int, t int, lp double, old double, adv double, mask boolean").repartition(3)
    got = {(x["loss"], x["mode"]): (x["value"], x["clipped"], x["lower"], x["kl"]) for x in P.losses(d, clip=clip).collect()}
    assert set(got) == {(n, m) for n in ("vanilla", "gspo", "gpg") for m in P.MODES}
    for (name, mode), found in got.items():
        assert found == pytest.approx(brute(rows, name, mode, clip)), (name, mode)
    scaled = {x["mode"]: x["value"] for x in P.losses(d, ["vanilla"], clip, 7.0).collect()}
    assert scaled["seq-mean-token-sum-norm"] == pytest.approx(brute(rows, "vanilla", "seq-mean-token-sum-norm", clip, 7.0)[0])


def test_losses_of_nothing_and_by_new_names(spark):
    schema = "g int, t int, lp double, old double, adv double, mask boolean"
    off = spark.createDataFrame([(1, 1, -1.0, -1.0, 1.0, False)], schema)
    assert {x["mode"]: x["value"] for x in P.losses(off, ["gpg"]).collect()} == {"token-mean": None, "seq-mean-token-sum": 0.0, "seq-mean-token-mean": 0.0, "seq-mean-token-sum-norm": 0.0}
    with pytest.raises(ValueError):
        P.losses(off, ["none"])

    @P.register_policy_loss("test only")
    def mine(lp, old, adv, seq, clip):
        return P.Loss(adv, adv > 0, adv < 0)

    try:
        on = spark.createDataFrame([(1, 1, -1.0, -1.0, 3.0, True), (1, 2, -1.0, -1.0, 1.0, True)], schema)
        assert [(x["value"], x["clipped"]) for x in P.losses(on, ["test only"]).where("mode = 'token-mean'").collect()] == [(2.0, 1.0)]
    finally:
        del P._losses["test only"]
