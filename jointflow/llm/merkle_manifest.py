"""A Merkle manifest of a dataset: a witness for every row that ties it to one root hash.

Rows of a group (a source) are the leaves of a tree of ``ARITY`` children to a node, in the order of their ids; the last run of a
level may be shorter, down to a single node, which is hashed like any other. The groups' roots, in the order of the groups, are
the leaves of a tree of their own.

Witnesses are kept incrementally (:class:`Appender`): leaves are appended one after the other; a leaf joins the open run of
its level, and all leaves below an open node hold the partial witness of that node. When a later sibling completes the run, the
run's node is made, every leaf below it gets the siblings of its own child as one more step of its witness, and the
node is appended to the level above. A tree is cut into aligned blocks of ``ARITY ** BLOCK_HEIGHT`` leaves that are built side by side
whatever group they belong to, so a group with a third of all rows is many blocks. The roots of a group's blocks are
appended to the level above in the same way, by blocks again, until one node is left; then the upper steps are handed down to the blocks' leaves.
Whole trees never meet in one task: what is gathered are blocks, and ranks are found by range partitions with counts.

A step of a witness is ``(before, after)``: the hashes to the left and to the right in the run, as text without separator. A null
group is a group and comes first. Rows without an id come first in their group; rows with equal ids stand in the order of their
leaves, equal leaves in any order (they are alike). The only row of a group is its root, with an empty witness. A null column of a leaf is ``-``, so null and empty text differ.
An empty table gives an empty table. Columns of the caller are carried along under names of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jointflow.session import written

ARITY = 3
BLOCK_HEIGHT = 8

_STEP = T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])
_WITNESS = T.ArrayType(_STEP)


def node_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_hash(columns: Sequence[Column]) -> Column:
    """The hash of a row: every column as text after its number of bytes and a colon, ``-`` for null."""
    shown = [c.cast("string") for c in columns]
    return node_hash(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown]))


def fold(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness give."""
    return F.aggregate(witness, leaf, lambda node, step: node_hash(F.concat(step["before"], node, step["after"])))


def proof_hash(witness: Column) -> Column:
    """The hash of all siblings of a witness, level by level, left to right."""
    return node_hash(F.array_join(F.transform(witness, lambda step: F.concat(step["before"], step["after"])), ""))


class Appender:
    """A tree that grows leaf by leaf and keeps the witness of every leaf as far as it is known.

    ``open[level]`` holds the run of nodes that waits for siblings there, each as (hash, first leaf, end of its leaves).
    """

    def __init__(self) -> None:
        self.witness: list[list[tuple[str, str]]] = []
        self.open: list[list[tuple[str, int, int]]] = []

    def append(self, leaf: str) -> None:
        n = len(self.witness)
        self.witness.append([])
        self._add(0, (leaf, n, n + 1))

    def _add(self, level: int, node: tuple[str, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        hashes = [h for h, _, _ in run]
        for k, (_, start, end) in enumerate(run):
            step = ("".join(hashes[:k]), "".join(hashes[k + 1 :]))
            for leaf in range(start, end):
                self.witness[leaf].append(step)
        self._add(level + 1, (hashlib.sha256("".join(hashes).encode()).hexdigest(), run[0][1], run[-1][2]))

    def finish(self, height: int) -> str:
        """Close the runs that are still open, up to ``height``, and give the node there."""
        for level in range(height):
            if level < len(self.open) and self.open[level]:
                self._close(level)
        return self.open[height][0][0]


def height_of(leaves: int) -> int:
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // ARITY), height + 1
    return height


def numbered(df: DataFrame, group: str, order: Sequence[str], purpose: str) -> DataFrame:
    """``df`` with its place ``_i`` (from 0) in its group and the group's size ``_n``, both counted without gathering a group.

    Rows are sorted into ranges, which split any group; a place in a range plus the counts of the ranges before it is the place.
    """
    given = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "_tie")]
    ranged = given.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    # Partition and place in it, in one number that is fixed by writing it down.
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()), purpose).withColumn("_part", F.shiftright("_at", 33))
    counts = ranged.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    of_group = Window.partitionBy(group)
    before = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.withColumns(
        {"_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "_n": F.sum("_rows").over(of_group)}
    ).select(F.col(group).alias("_group2"), F.col("_part").alias("_part2"), "_first", "_before", "_n")
    same = F.col(group).eqNullSafe(F.col("_group2")) & (F.col("_part") == F.col("_part2"))
    placed = ranged.join(places, same).withColumn("_i", F.col("_before") + F.col("_at") - F.col("_first"))
    return placed.drop("_at", "_part", "_group2", "_part2", "_first", "_before")


def _block(height: int) -> Column:
    return F.floor(F.col("_i") / F.lit(ARITY**height)).cast("long")


def _height(leaves: int, block_height: int) -> int:
    return block_height if leaves > ARITY**block_height else height_of(leaves)


def _roots(leaves: DataFrame, group: str, leaf: str, block_height: int) -> DataFrame:
    """``(group, _i, _n, leaf)`` of the level above: the root of every block, and how many blocks its group has."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        tree = Appender()
        for h in table.column("leaf").to_pylist():
            tree.append(h)
        n = table.column("_n")[0].as_py()
        root = tree.finish(_height(n, block_height))
        return pa.table({"_g": table.column("_g").slice(0, 1), "_i": [key[1].as_py()], "_n": [-(-n // ARITY**block_height)], "leaf": [root]})

    kind = leaves.schema[group].dataType.simpleString()
    narrow = leaves.select(F.col(group).alias("_g"), "_i", "_n", F.col(leaf).alias("leaf"), _block(block_height).alias("_b"))
    made = narrow.groupBy("_g", "_b").applyInArrow(build, f"_g {kind}, _i long, _n long, leaf string")
    return made.withColumnsRenamed({"_g": group, "leaf": leaf})


def _witnessed(leaves: DataFrame, above: DataFrame | None, group: str, leaf: str, block_height: int) -> DataFrame:
    """``leaves`` with ``_witness`` up to the group's root; ``above`` has the steps of every block from its root on and the group's root."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        tree = Appender()
        for h in table.column(leaf).to_pylist():
            tree.append(h)
        root = tree.finish(_height(table.column("_n")[0].as_py(), block_height))
        steps = [[{"before": b, "after": a} for b, a in w] for w in tree.witness]
        kept = table.drop_columns(["_b", "_n"])
        arrays = [*kept.columns, pa.array(steps, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))), pa.array([root] * len(steps), pa.string())]
        return pa.table(arrays, names=[*kept.column_names, "_witness", "_root"])

    blocks = leaves.withColumn("_b", _block(block_height))
    kept = [f for f in leaves.schema.fields if f.name != "_n"]
    schema = T.StructType([*kept, T.StructField("_witness", _WITNESS), T.StructField("_root", T.StringType())])
    built = blocks.groupBy(group, "_b").applyInArrow(build, schema)
    if above is None:
        return built
    upper = above.select(F.col(group).alias("_g2"), F.col("_i").alias("_b2"), F.col("_witness").alias("_more"), F.col("_root").alias("_top"))
    same = F.col(group).eqNullSafe(F.col("_g2")) & (_block(block_height) == F.col("_b2"))
    joined = built.join(upper, same, "left")
    return joined.select(
        *[f.name for f in kept],
        F.concat("_witness", F.coalesce("_more", F.array().cast(_WITNESS))).alias("_witness"),
        F.coalesce("_top", "_root").alias("_root"),
    )


def tree_witnesses(leaves: DataFrame, group: str, leaf: str, block_height: int = BLOCK_HEIGHT) -> DataFrame:
    """``leaves`` (with ``_i`` and ``_n`` of :func:`numbered`) with ``_witness`` and ``_root`` of their group's tree."""
    size = ARITY**block_height
    most = leaves.where(F.col("_n") > size).agg(F.max("_n")).first()[0]
    above = None
    if most:
        # Groups of one block need no level above; of the others there is one row to a block.
        roots = written(_roots(leaves.where(F.col("_n") > size), group, leaf, block_height), "block-roots")
        above = written(tree_witnesses(roots, group, leaf, block_height), "block-witnesses")
    return _witnessed(leaves, above, group, leaf, block_height)


def manifest(rows: DataFrame, group: str, order: Sequence[str], leaf: str, block_height: int = BLOCK_HEIGHT) -> DataFrame:
    """``rows`` with ``subroot`` (of the row's group), ``root`` (of all) and ``witness`` (the steps from leaf to root).

    ``leaf`` names the column with the row's hash; a null one counts as the hash of ``-``. Columns named like the new ones are replaced.
    """
    rows = rows.drop("subroot", "root", "witness")
    own = [c for c in rows.columns]
    plain = rows.select(
        F.col(group).alias("_group"),
        *[F.col(c).alias(f"_order{k}") for k, c in enumerate(order)],
        F.coalesce(leaf, node_hash(F.lit("-"))).alias("_leaf"),
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_own"),
    )
    placed = numbered(plain, "_group", [f"_order{k}" for k in range(len(order))] + ["_leaf"], "leaves")
    lower = written(tree_witnesses(placed.select("_group", "_i", "_n", "_leaf", "_own"), "_group", "_leaf", block_height), "witnesses")
    tops = lower.where("_i = 0").select(F.lit(0).alias("_all"), "_group", F.col("_root").alias("_leaf"))
    roots = numbered(tops, "_all", ["_group"], "subroots")
    upper = tree_witnesses(roots.select("_all", "_i", "_n", "_leaf", "_group"), "_all", "_leaf", block_height)
    upper = upper.select(F.col("_group").alias("_group2"), F.col("_witness").alias("_more"), F.col("_root").alias("_top"))
    whole = lower.join(upper, F.col("_group").eqNullSafe(F.col("_group2")))
    return whole.select(
        "_own.*",
        F.col("_root").alias("subroot"),
        F.col("_top").alias("root"),
        F.concat("_witness", "_more").alias("witness"),
    )


def document_leaf(text: Column) -> Column:
    return leaf_hash([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and each document's root as recomputed after line breaks were lost where
    the crc32 of its id is even."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    lost = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", document_leaf(F.col("text")).alias("leaf"), document_leaf(lost).alias("found"))
    done = manifest(leaves, "source", ["doc_id"], "leaf")
    folded = done.withColumn("folded_root", fold(F.col("found"), F.col("witness")))
    return folded.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_hash(F.col("witness")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _level_sql(name: str, base: str) -> str:
    """Nodes of all levels of the trees in ``base`` (g, i, n, h)."""
    return f"""{name} AS (
    SELECT g, 0 AS level, i, n, h FROM {base}
    UNION ALL
    SELECT g, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i))
    FROM {name} WHERE n > 1 GROUP BY g, level, i // 3, n)"""


def oracle() -> str:
    shown = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR"]
    field = lambda c: f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, shown), field(text)]) + ")"
    side = lambda sign: (
        f"coalesce((SELECT string_agg(s.h, '' ORDER BY s.i) FROM %s s WHERE s.g IS NOT DISTINCT FROM t.g AND s.level = t.level"
        f" AND s.i // 3 = t.i // 3 AND s.i {sign} t.i), '')"
    )
    steps = lambda nodes: (
        f"SELECT g, level, i, {side('<') % nodes} AS b, {side('>') % nodes} AS a FROM {nodes} t WHERE n > 1"
    )
    return f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source AS g, {leaf('text')} AS h,
        {leaf("CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS found
    FROM (SELECT *, {_crc_sql()} AS crc FROM documents)),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM docs),
{_level_sql('nodes', 'leaves')},
tops AS (
    SELECT 0 AS g, g AS source, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM nodes WHERE n = 1),
{_level_sql('top_nodes', 'tops')},
low AS MATERIALIZED ({steps('nodes')}),
high AS MATERIALIZED ({steps('top_nodes')}),
way AS MATERIALIZED (
    SELECT l.doc_id, l.g, l.i AS leaf, s.level AS k, s.b, s.a FROM leaves l JOIN low s
        ON s.g IS NOT DISTINCT FROM l.g AND s.i = l.i // (3 ** s.level)::BIGINT
    UNION ALL
    SELECT l.doc_id, l.g, l.i, 1000 + s.level, s.b, s.a FROM leaves l JOIN tops t ON t.source IS NOT DISTINCT FROM l.g
        JOIN high s ON s.i = t.i // (3 ** s.level)::BIGINT),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g, leaf ORDER BY k) AS step FROM way),
folded AS (
    SELECT g, i AS leaf, 1 AS step, found AS h FROM leaves
    UNION ALL
    SELECT f.g, f.leaf, f.step + 1, sha256(o.b || f.h || o.a) FROM folded f JOIN ordered o
        ON o.g IS NOT DISTINCT FROM f.g AND o.leaf = f.leaf AND o.step = f.step),
ends AS (SELECT g, leaf, max_by(h, step) AS h FROM folded GROUP BY g, leaf),
proofs AS (SELECT g, leaf, string_agg(b || a, '' ORDER BY step) AS p FROM ordered GROUP BY g, leaf),
root AS (SELECT h FROM top_nodes WHERE n = 1)
SELECT l.doc_id, l.h AS leaf, t.h AS subroot, r.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256,
    e.h AS folded_root, e.h = r.h AS verified
FROM leaves l JOIN tops t ON t.source IS NOT DISTINCT FROM l.g JOIN ends e ON e.g IS NOT DISTINCT FROM l.g AND e.leaf = l.i
    LEFT JOIN proofs p ON p.g IS NOT DISTINCT FROM l.g AND p.leaf = l.i, root r
"""


def _crc_sql() -> str:
    """The unsigned CRC-32 of the decimal doc_id, bit by bit."""
    byte = "coalesce(ascii(substr(doc_id::VARCHAR, k, 1)), 0)"
    bits = "list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, %s)"
    return (
        "xor(list_reduce(range(1, length(doc_id::VARCHAR) + 1), lambda c, k: "
        + bits % f"xor(c, {byte}::BIGINT)"
        + ", 4294967295::BIGINT), 4294967295)"
    )
