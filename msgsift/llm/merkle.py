"""Merkle dataset manifest by butterfly exchange.

Every row is a leaf. Per group (language) the leaves, in id order, are the
lowest level of a tree in which every ``fanout`` consecutive nodes become
their hash; the group roots, in group order, are the leaves of the top tree.

1. Leaves are hashed in the row; from then on only (id, group, digests) move.
2. A range sort gives every leaf its place, so that it can be dealt to an
   aligned partition of ``fanout ** k`` places of its group (at most
   ``PARTITION_LEAVES``), which folds its own subtree.
3. Butterfly: in round r the partitions whose numbers differ in digit r only,
   ``fanout`` of them, swap the roots they hold and each of them hashes the
   parent. After the last round every partition holds the group root and the
   siblings on its way up; nothing is sent down again. A group's last,
   incomplete ring of partitions is filled up with empty ones, which hold what
   their neighbours bring, so every swap has its aligned partner.
4. The group roots run the same rounds among themselves.
5. Each partition joins its upper proof to the proofs inside its subtree.

A digest is lower-case hex, and a parent is the sha256 of its children's hex
text. A field is written as ``-`` when null, else as byte count, ``:`` and value.

Defined cases
    null id: sorts first in its group. null group: a group of its own, the first.
    ids that repeat: ordered by leaf digest; equal rows are separate leaves with proofs of their own places.
    null or empty text: ``-`` and ``0:``. very long texts: hashed whole, in the row.
    a lone leaf is its group's root, a lone group root the dataset's. empty table: no rows.
    further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import join_by_key

FANOUT = 2
PARTITION_LEAVES = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROUNDS_PER_WRITE = 8

_PATH = "array<struct<at:int,others:array<string>>>"
_PATH_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))


def leaf_digest(values: list[Column]) -> Column:
    """sha256 of the values, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def levels(n: int, fanout: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    up = 0
    while n > 1:
        n, up = -(-n // fanout), up + 1
    return up


def _levels(n: Column, fanout: int) -> Column:
    """:func:`levels` of a column, by comparing with the powers of the fanout."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(p)
        p *= fanout
    return F.size(F.filter(F.array(*[F.lit(x).cast("bigint") for x in powers]), lambda x: x < n))


def with_place(rows: DataFrame, keys: list, name: str) -> DataFrame:
    """``rows`` written in the order of ``keys``, with ``at``: the place of each row, from 0.

    A range sort; the rows of each range are numbered as they are written, and
    the running sum over the ranges (one row per partition) is broadcast.
    """
    done = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                       .withColumn("_m", F.monotonically_increasing_id()), name)
    part = F.shiftright("_m", 33)
    sizes = done.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")
    base = sizes.select("_p", (before - F.col("_first")).alias("_base"))
    return (done.withColumn("_p", part).join(F.broadcast(base), "_p")
            .withColumn("at", F.col("_m") + F.col("_base")).drop("_m", "_p", "_base"))


def fold(digests: list[str], up: int, fanout: int) -> list[list[str]]:
    """Levels 0 to ``up`` above the digests of one subtree."""
    out = [digests]
    for _ in range(up):
        row = out[-1]
        out.append([hashlib.sha256("".join(row[i:i + fanout]).encode()).hexdigest() for i in range(0, len(row), fanout)])
    return out


def butterfly(state: DataFrame, sizes: DataFrame, fanout: int) -> DataFrame:
    """(g, b, root, path) for the partitions ``state`` (g, b, node); ``sizes`` (g, m): partitions of each group."""
    sized = sizes.withColumn("rounds", _levels(F.col("m"), fanout))
    rounds = sized.agg(F.max("rounds")).first()[0] or 0
    full = F.expr(f"cast(power({fanout}, rounds) as bigint)")
    empty = (sized.withColumn("full", full).where("full > m")
             .select("g", F.explode(F.expr("sequence(m, full - 1)")).alias("b"), F.lit(None).cast("string").alias("node")))
    ring = (state.select("g", "b", "node").unionByName(empty).join(sized.select("g", "rounds", "m"), "g")
            .withColumn("path", F.array().cast(_PATH)))
    for r in range(rounds):
        step = fanout ** r
        digit = F.expr(f"cast(b div {step} % {fanout} as int)")
        swap = Window.partitionBy("g", F.expr(f"b div {step * fanout}"), F.expr(f"b % {step}"))
        turn = ring.withColumn("at", digit).withColumn(
            "met", F.sort_array(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("at", "node"))).over(swap)))
        here = F.col("rounds") > r
        others = F.transform(F.filter("met", lambda x: x["at"] != F.col("at")), lambda x: x["node"])
        parent = F.sha2(F.array_join(F.transform("met", lambda x: x["node"]), "").cast("binary"), 256)
        ring = turn.select(
            "g", "b", "rounds", "m", F.when(here & (F.size("met") > 0), parent).when(~here, F.col("node")).alias("node"),
            F.when(here & (F.col("b") < F.col("m")), F.concat("path", F.array(F.struct("at", others.alias("others")))))
            .otherwise(F.col("path")).alias("path"))
        if (r + 1) % ROUNDS_PER_WRITE == 0:
            ring = materialize(ring, "merkle-ring")
    return ring.where("b < m").select("g", "b", F.col("node").alias("root"), "path")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", leaves: dict[str, Column] | None = None,
             fanout: int = FANOUT, partition_leaves: int = PARTITION_LEAVES) -> DataFrame:
    """doc_id, the columns of ``leaves``, path, subroot, root: one row per row of ``docs``.

    ``leaves`` holds the columns of digests that each row carries along; the
    first is the leaf (by default the digest of FIELDS). path: per level
    from the leaf to the root, the node's place among its run and the run's
    other digests.
    """
    if fanout < 2:
        raise ValueError("a tree needs a fanout of at least 2")
    leaves = leaves or {"leaf": leaf_digest([docs[c] for c in FIELDS])}
    names = list(leaves)
    inner = 0
    while fanout ** (inner + 1) <= partition_leaves:
        inner += 1
    size = fanout ** inner

    # the group travels as a non-null text: a null group is '', every other one starts with '='
    entries = materialize(docs.select(
        docs[id_col].alias("doc_id"), F.coalesce(F.concat(F.lit("="), docs[group_col].cast("string")), F.lit("")).alias("lk"),
        *[c.alias(f"leaf{k}") for k, c in enumerate(leaves.values())], F.monotonically_increasing_id().alias("t")), "merkle-leaves")
    id_type = entries.schema["doc_id"].dataType.simpleString()
    placed = with_place(entries, [F.asc("lk"), F.asc_nulls_first("doc_id"), F.asc("leaf0"), F.asc("t")], "merkle-sorted").drop("t")
    groups = materialize(placed.groupBy("lk").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n")), "merkle-groups")
    groups = materialize(with_place(groups, [F.asc("lk")], "merkle-group-order").withColumnRenamed("at", "g"), "merkle-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0

    # aligned partitions: one row each
    cells = [f"leaf{k}" for k in range(len(names))]
    dealt = (join_by_key(placed, groups, ["lk"], "n", total).withColumn("place", F.col("at") - F.col("start"))
             .withColumn("b", F.expr(f"place div {size}")))
    parts = materialize(dealt.groupBy("g", "b").agg(F.first("n").alias("n"), F.sort_array(
        F.collect_list(F.struct("place", "doc_id", *cells))).alias("rows")), "merkle-partitions")

    def subtree(batches):
        for batch in batches:
            got = {"g": [], "b": [], "node": []}
            for row in batch.to_pylist():
                up = min(inner, levels(row["n"], fanout))
                got["g"].append(row["g"])
                got["b"].append(row["b"])
                got["node"].append(fold(row["leaf"], up, fanout)[-1][0])
            yield pa.RecordBatch.from_pydict(got, schema=pa.schema([("g", pa.int64()), ("b", pa.int64()), ("node", pa.string())]))

    own = materialize(parts.select("g", "b", "n", F.col("rows.leaf0").alias("leaf"))
                      .mapInArrow(subtree, "g bigint, b bigint, node string"), "merkle-subtrees")
    counts = groups.select("g", F.expr(f"(n + {size - 1}) div {size}").alias("m"))
    upper = materialize(butterfly(own, counts, fanout), "merkle-upper")

    # the group roots, held by every partition, swap likewise
    heads = upper.where("b = 0").select(F.lit(0).cast("bigint").alias("g"), F.col("g").alias("b"), F.col("root").alias("node"))
    top = butterfly(heads, heads.groupBy("g").agg(F.count(F.lit(1)).alias("m")), fanout)
    top = materialize(top.select(F.col("b").alias("g"), F.col("root"), F.col("path").alias("top")).join(counts, "g"), "merkle-top")
    proofs = join_by_key(upper.withColumnRenamed("root", "subroot").withColumnRenamed("path", "mid"), top, ["g"], "m",
                         -(-total // size)).select("g", "b", "subroot", "root", F.concat("mid", "top").alias("upper"))

    def inside(batches):
        for batch in batches:
            for i, row in enumerate(batch.select(["n", "leaf"]).to_pylist()):     # one partition: its leaves' lower proofs
                up = min(inner, levels(row["n"], fanout))
                tree = fold(row["leaf"], up, fanout)[:up]
                low = [[_step(level, k // fanout ** lv, fanout) for lv, level in enumerate(tree)]
                       for k in range(len(row["leaf"]))]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, 1).drop_columns(["leaf", "n"]).columns, pa.array([low], pa.list_(_PATH_ARROW))],
                    names=["rows", "subroot", "root", "upper", "low"])

    held = parts.join(proofs, ["g", "b"]).select("n", "rows", F.col("rows.leaf0").alias("leaf"), "subroot", "root", "upper")
    rows_type = held.schema["rows"].dataType.simpleString()
    out = (held.mapInArrow(inside, f"rows {rows_type}, subroot string, root string, upper {_PATH}, low array<{_PATH}>")
           .select("subroot", "root", "upper", F.explode(F.arrays_zip("rows", "low")).alias("x")))
    return out.select("x.rows.doc_id", *[F.col(f"x.rows.{c}").alias(n) for c, n in zip(cells, names)],
                      F.concat("x.low", "upper").alias("path"), "subroot", "root")


def _step(level: list[str], k: int, fanout: int) -> dict:
    at = k % fanout
    return {"at": at, "others": level[k - at:k] + level[k + 1:k - at + fanout]}


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: s["others"])), "").cast("binary"), 256)


def root_from(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    def up(node, s):
        run = F.concat(F.slice(s["others"], 1, s["at"]), F.array(node), F.slice(s["others"], s["at"] + 1, F.size(s["others"])))
        return F.sha2(F.array_join(run, "").cast("binary"), 256)
    return F.aggregate(path, leaf, up)
