"""Merkle manifest of a table: every level is an equijoin of nodes with the indices of their siblings.

Rows are leaves, numbered within their source by ranges, so no source is gathered in one task. A level joins each node
with itself at computed sibling indices (XOR in a binary tree, slot offsets otherwise); the rows of slot zero then emit
the parents. What remains of each source, its subroot, is a leaf of one more tree of the same kind. On the way down each
node puts its siblings before those of its parent, so that a leaf ends up with its whole proof, at the cost of one join a
level and without a join by source, which a third of all rows may share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.operators.positions import numbered
from demandspark.session import materialize

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:binary,right:binary>>"


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def shown(digest: Column) -> Column:
    """A digest as lowercase hex text; of several digests in a row, their texts in a row."""
    return F.lower(F.hex(digest))


def leaf_digest(**replaced: Column) -> Column:
    """Digest of a row's fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    fields = [replaced.get(name, F.col(name)).cast("string") for name in FIELDS]
    framed = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]
    return _hash(F.concat(*framed))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, start, lambda h, step: _hash(shown(F.concat(step["left"], h, step["right"]))))


def proof_text(proof: Column) -> Column:
    """The siblings of a proof as hex text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: shown(F.concat(step["left"], step["right"]))), "")


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (g, i, n, h, …) with the digests of the run's other nodes before and after them, as left and right."""
    slot, run = F.pmod("i", F.lit(arity)), F.expr(f"i div {arity}")
    joined = nodes
    for offset in range(1, arity):
        at = F.col("i").bitwiseXOR(F.lit(1)) if arity == 2 else run * arity + F.pmod(slot + offset, F.lit(arity))
        other = nodes.select("g", F.col("i").alias("at"), F.col("h").alias(f"sibling_{offset}"))
        joined = joined.withColumn("at", at).join(other, ["g", "at"], "left")
    none = F.lit(bytearray())
    found = {o: F.coalesce(f"sibling_{o}", none) for o in range(1, arity)}
    left = F.concat(none, *[F.when(F.lit(o) >= arity - slot, h).otherwise(none) for o, h in found.items()])
    right = F.concat(none, *[F.when(F.lit(o) < arity - slot, h).otherwise(none) for o, h in found.items()])
    return joined.select(*nodes.columns, left.alias("left"), right.alias("right"))


def _tree(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame | None]:
    """The written levels of the trees of all groups, and the roots (g, h, level). None where there are no nodes.

    A group is worked on while it has several nodes; the number of levels follows from the size of the largest.
    """
    most = nodes.agg(F.max("n")).first()[0]
    if most is None:
        return [], None
    single = lambda df, level: df.filter("n = 1").select("g", "h", F.lit(level).alias("level"))
    roots, levels = single(nodes, 0), []
    while most > 1:
        level = materialize(_with_siblings(nodes.filter("n > 1"), arity), "merkle-level")
        levels.append(level)
        joined = shown(F.concat("left", "h", "right"))
        nodes = level.filter(F.pmod("i", F.lit(arity)) == 0).select(
            "g", F.expr(f"i div {arity}").alias("i"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), _hash(joined).alias("h")
        )
        roots = roots.unionByName(single(nodes, len(levels)))
        most = -(-most // arity)
    return levels, materialize(roots, "merkle-roots")


def _proofs(levels: list[DataFrame], roots: DataFrame, arity: int) -> DataFrame:
    """For the nodes of the lowest level that have siblings: their columns, ``proof``, and what ``roots`` (g, level, proof, …) carry."""
    carried = [c for c in roots.columns if c not in ("g", "level", "h")]
    above = None
    for k in range(len(levels) - 1, -1, -1):
        ends = roots.filter(F.col("level") == k + 1).select("g", F.lit(0).cast("long").alias("run"), *carried)
        above = ends if above is None else above.select("g", F.col("i").alias("run"), *carried).unionByName(ends)
        own = levels[k].withColumn("run", F.expr(f"i div {arity}")).join(above.withColumnRenamed("proof", "beyond"), ["g", "run"])
        own = own.withColumn("proof", F.concat(F.array(F.struct("left", "right")), "beyond"))
        above = own.drop("run", "left", "right", "beyond")
    return above


def manifest(documents: DataFrame, arity: int = ARITY, **kept: Column) -> DataFrame:
    """One row per row of ``documents``: doc_id, leaf, subroot, root (digests), proof, and the ``kept`` expressions.

    ``proof`` holds per level the digests of the siblings to the left and to the right, from the leaf over the subroot to
    the root. Per source, leaves ascend by doc_id, a null doc_id first; rows that share a doc_id are ordered by their
    digest, and equal rows are leaves of their own. A null source is a source, the first one. Only doc_id, source, lang,
    n_chars and text enter a leaf, whole and however long; further columns don't count. A single row is leaf, subroot and
    root at once, with an empty proof. An empty table gives an empty result.
    """
    if arity < 2:
        raise ValueError("arity must be 2 at least")
    group = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    leaves = documents.select(group.alias("g"), "doc_id", leaf_digest().alias("h"), *[e.alias(f"kept_{c}") for c, e in kept.items()])
    extra = ["doc_id", *(f"kept_{c}" for c in kept)]
    placed = numbered(leaves, ["g"], [F.col("doc_id"), F.col("h")])
    nodes = materialize(placed.select("g", (F.col("position") - 1).alias("i"), F.col("n_rows").alias("n"), "h", *extra), "merkle-leaves")
    levels, roots = _tree(nodes, arity)
    digests = {"leaf": "h", "subroot": "subroot", "root": "root"}
    columns = [F.col(c).alias(name) for name, c in digests.items()]
    columns = ["doc_id", *columns, "proof", *[F.col(f"kept_{c}").alias(c) for c in kept]]
    empty = F.array().cast(STEPS)
    if roots is None:
        return nodes.withColumns({"subroot": F.col("h"), "root": F.col("h"), "proof": empty}).select(*columns)
    tops = numbered(roots.select(F.lit("").alias("g"), F.col("g").alias("source"), "h"), ["g"], [F.col("source")])
    tops = materialize(tops.select("g", (F.col("position") - 1).alias("i"), F.col("n_rows").alias("n"), "h", "source"), "merkle-subroots")
    top_levels, top = _tree(tops, arity)
    root = F.lit(bytearray(top.first()["h"]))
    top = top.withColumn("proof", empty)
    up = tops.withColumn("proof", empty) if not top_levels else _proofs(top_levels, top, arity)
    up = up.select(F.col("source").alias("g"), F.col("h").alias("subroot"), "proof")
    ends = materialize(roots.select("g", "level").join(up, "g"), "merkle-ends")
    lone = nodes.filter("n = 1").join(ends.select("g", "subroot", "proof"), "g")
    found = lone if not levels else _proofs(levels, ends, arity).unionByName(lone)
    return found.withColumn("root", root).select(*columns)
