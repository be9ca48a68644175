"""A Merkle manifest of a dataset: a tree of digests for each source, and one over the sources.

A row's leaf is the digest of its fields. Leaves of a source stand by doc_id; ``FANOUT`` neighbours give their parent, level
by level, until one is left, the source's subroot; subroots by source give the root in the same way. All is DataFrame
levels: rows are numbered (``ordinals.py``), the number divided by the fanout names the parent, and groups of at most
``FANOUT`` sorted children are hashed, so no task ever holds a tree. A level's runs are written before the next level is
made; a lost executor costs one level at most.

Paths go down: a run gets its parent's path once for all its children, so the joins shrink by the fanout from level to level
and a document gets its whole path in the last of them. A path is a list of levels from the leaf up, each with the digests to
the left and to the right. Digests travel as 32 bytes and are hashed as 64 characters of hex.

Defined cases: a null field is ``-``, so null and empty differ; a null source is a source, before all others; rows of one
doc_id stand by their leaves, null ids first, equal rows any way (their results differ in their places alone). A run of one
child has a parent. A lone leaf is its subroot, a lone subroot the root; its proof is the digest of nothing. A null doc_id is
never tampered with. An empty table gives an empty one. Columns besides the five fields are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinals import numbered
from .shared import cut, free

FANOUT = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Where this divides the CRC-32 of the id, the row is tampered with.
TAMPERED = 5
_PATH = "array<struct<l:binary,r:binary>>"


def leaf(columns: list[Column]) -> Column:
    """The digest of fields, 32 bytes: each as its length in bytes and its text."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, own, changed): the source's key, the leaf, and what the leaf is after tampering, null for most rows."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    fields = {n: F.col(n) for n in FIELDS}
    hit = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % TAMPERED == 0
    changed = F.when(hit, leaf(list((fields | {"text": lowered(F.col("text").cast("string"))}).values())))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf(list(fields.values())).alias("own"), changed.alias("changed"))


def _hex(binary: str) -> str:
    return f"lower(hex({binary}))"


def _runs(nodes: DataFrame, keep: list[str], fanout: int) -> DataFrame:
    """(tree, run, kids): each run's children in order."""
    kid = F.struct("idx", "own", *keep)
    return nodes.groupBy("tree", F.expr(f"idx div {fanout}").alias("run")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))  # fanout rows at most


def _parents(runs: DataFrame) -> DataFrame:
    joined = "array_join(transform(kids, k -> lower(hex(k.own))), '')"
    return runs.select("tree", F.col("run").alias("idx"), F.expr(f"unhex(sha2({joined}, 256))").alias("own"))


def grow(nodes: DataFrame, keep: list[str], name: str, fanout: int = FANOUT) -> tuple[list[DataFrame], list[DataFrame]]:
    """``nodes`` has (tree, idx, own, *keep). For each level from the leaves up: its runs, and its runs that are a tree's one
    last node. The latter is told from the run alone: run 0 with one child has no neighbours, as indices are gapless."""
    levels: list[DataFrame] = []
    tops: list[DataFrame] = []
    while True:
        runs = cut(_runs(nodes, [] if levels else keep, fanout), f"{name}-runs")
        tops.append(runs.where("run = 0 and size(kids) = 1"))
        rest = runs.where("not (run = 0 and size(kids) = 1)")
        if rest.isEmpty():
            return levels, tops
        levels.append(rest)
        nodes = _parents(rest)


def last_nodes(tops: list[DataFrame]) -> DataFrame:
    """(tree, own, depth) of each tree's last node."""
    out = [top.select("tree", F.expr("kids[0].own").alias("own"), F.lit(depth).alias("depth")) for depth, top in enumerate(tops)]
    return reduce(DataFrame.unionByName, out)


def _spread(runs: DataFrame, paths: DataFrame, keep: list[str], carry: list[str]) -> DataFrame:
    """Each child of ``runs`` with its path: its neighbours, then the path of its parent."""
    side = lambda part: f"unhex(array_join(transform({part}, k -> hex(k.own)), ''))"
    held = runs.join(paths.select("tree", F.col("idx").alias("run"), "path", *carry), ["tree", "run"])
    kids = held.select("tree", "path", *carry, "kids", F.posexplode("kids").alias("at", "kid"))
    step = F.expr(f"array(named_struct('l', {side('slice(kids, 1, at)')}, 'r', {side('slice(kids, at + 2, size(kids))')}))")
    return kids.select("tree", *(F.col(f"kid.{c}").alias(c) for c in ("idx", "own", *keep)), F.concat(step, F.col("path")).alias("path"), *carry)


def descend(levels: list[DataFrame], tops: list[DataFrame], ends: DataFrame, keep: list[str], carry: list[str]) -> DataFrame:
    """(tree, idx, own, *keep, path, *carry) of every leaf. ``ends`` has (tree, depth, path, *carry) of each last node; what
    is carried comes down with the path."""
    paths = None
    for depth in range(len(tops) - 1, -1, -1):
        held = [] if depth else keep
        here = tops[depth].join(ends.where(F.col("depth") == depth), "tree").select("tree", *(F.expr(f"kids[0].{c}").alias(c) for c in ("idx", "own", *held)), "path", *carry)
        paths = here if paths is None else here.unionByName(_spread(levels[depth], paths, held, carry))
    return paths


def fold(start: str, path: str = "path") -> Column:
    """The root, in hex, to which a leaf's digest leads along a path."""
    return F.expr(f"aggregate({path}, {_hex(start)}, (h, s) -> sha2(concat(lower(hex(s.l)), h, lower(hex(s.r))), 256))")


def proof(path: str = "path") -> Column:
    """The digest of all siblings along a path."""
    return F.expr(f"sha2(array_join(transform({path}, s -> concat(lower(hex(s.l)), lower(hex(s.r)))), ''), 256)")


def build(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, own, changed, subroot, root, path) of every row, digests as 32 bytes."""
    keep, carry = ["doc_id", "changed"], ["subroot", "root"]
    rows = numbered(leaves(docs), ["tree"], ["doc_id", "own"], "merkle")
    levels, tops = grow(rows, keep, "merkle", fanout)
    free(rows)
    last = cut(last_nodes(tops), "merkle-subroots")
    nodes = numbered(last.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("own"), "depth"), ["tree"], ["source"], "merkle-sources", fixed=True)
    upper, end = grow(nodes, ["source", "depth"], "merkle-upper", fanout)
    ends = last_nodes(end).select("tree", "depth", F.array().cast(_PATH).alias("path"), F.col("own").alias("root"))
    ends = descend(upper, end, ends, ["source", "depth"], ["root"])
    ends = cut(ends.select(F.col("source").alias("tree"), "depth", "path", F.col("own").alias("subroot"), "root"), "merkle-ends")
    free(last, nodes)
    return descend(levels, tops, ends, keep, carry).select("doc_id", "own", "changed", "subroot", "root", "path")


def manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The digests of ``build`` in hex, each row's proof, and the root that the row leads to after tampering."""
    rows = build(docs, fanout).withColumn("folded_root", fold("coalesce(changed, own)"))
    hexes = {"leaf": "own", "subroot": "subroot", "root": "root"}
    return rows.select("doc_id", *(F.expr(_hex(c)).alias(n) for n, c in hexes.items()), proof().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.expr(_hex("root"))).alias("verified"))
