r"""Nested brackets in text, read by a running depth.

A text is cut into tokens (brackets, quotes, escapes, and what lies between), and one ``aggregate`` goes over them with a state
of a few integers: where it is, how deep, whether in a string, and what it has found. Depth and length have no bound: no
pattern here repeats a group, which Java would do by recursion. All stays in the JVM and may stand in other functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OBJECTS = r'(?s)\\.|[{}"\\]|[^{}"\\]+'
_BRACES = r"[{}]|[^{}]+"


def _let(value: Column, f) -> Column:
    return F.transform(F.array(value), lambda x: f(x))[0]


def _state(at: Column, depth: Column, quoted: Column, start: Column, first: Column, after: Column) -> Column:
    """Place, depth, whether in a string, where the open object began, and first and after of what was found; from 0."""
    parts = {"at": at, "depth": depth, "start": start, "first": first, "after": after}
    return F.struct(*(x.cast("int").alias(n) for n, x in parts.items()), quoted.alias("quoted"))


def _found(text: Column, pattern: str, depth: int, turn) -> Column:
    """What the last state of the tokens of a text points at, or null."""
    first = _state(F.lit(0), F.lit(depth), F.lit(False), F.lit(-1), F.lit(0), F.lit(-1))
    end = lambda x: F.aggregate(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), first, turn)
    return _let(text, lambda x: _let(end(x), lambda s: F.when(s["after"] >= 0, F.substring(x, s["first"] + 1, s["after"] - s["first"]))))


def last_object(text: Column) -> Column:
    r"""The last {...} of a text that is closed and in no other. Braces in "strings" don't count, nor quotes behind a \ there."""

    def turn(a: Column, t: Column) -> Column:
        width = F.char_length(t)
        # a backslash says nothing outside of strings: what is behind it counts as it stands
        said = F.when(width > 2, "").when(a["quoted"], F.when(t == '"', t).otherwise("")).otherwise(F.substring(t, -1, 1))
        seen = _let(F.struct(said.alias("said"), (a["at"] + width).alias("at")), lambda x: F.struct(x["at"].alias("at"), (x["said"] == "{").alias("opens"), (x["said"] == "}").alias("closes"), (x["said"] == '"').alias("quote"), ((x["said"] == "}") & (a["depth"] == 1) & (a["start"] >= 0)).alias("done")))
        return _let(seen, lambda x: after(a, x))

    def after(a: Column, x: Column) -> Column:
        start = F.when(x["opens"] & (a["depth"] == 0), x["at"] - 1).when(x["done"], -1).otherwise(a["start"])
        depth = F.when(x["opens"], a["depth"] + 1).when(x["closes"], a["depth"] - 1).otherwise(a["depth"])
        return _state(x["at"], depth, a["quoted"] != x["quote"], start, F.when(x["done"], a["start"]).otherwise(a["first"]), F.when(x["done"], x["at"]).otherwise(a["after"]))

    return _found(text, _OBJECTS, 0, turn)


def until_closed(text: Column) -> Column:
    """What stands before the brace that closes one opened before the text; null if none does."""

    def turn(a: Column, t: Column) -> Column:
        open_ = a["after"] < 0
        depth = F.when(open_ & (t == "{"), a["depth"] + 1).when(open_ & (t == "}"), a["depth"] - 1).otherwise(a["depth"])
        after = F.when(open_ & (t == "}") & (a["depth"] == 1), a["at"]).otherwise(a["after"])
        return _state(a["at"] + F.char_length(t), depth, a["quoted"], a["start"], a["first"], after)

    return _found(text, _BRACES, 1, turn)
