"""A Merkle manifest of a table: each row a leaf, a tree for each source, one root over all; proofs, and their check."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .shared import discard, scaled_partitions, stored, table

#: Nodes that become one node of the next level.
RUN = 3
#: Levels of a superblock, which so has RUN ** LEVELS nodes at most. Trees that end a third of this far up share groups.
LEVELS = 7
#: Where ranges begin is broadcast up to so many rows, after they have been counted.
BROADCAST_ROWS = 200_000


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of the columns one after another: ``-`` for null, else byte count, ``:`` and the value."""
    said = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*said), 256)


def numbered(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """``nodes`` with pos, a row's place in its tree from 0, and n, the rows of the tree.

    ``order`` begins with the tree. Rows are range-partitioned and sorted by it, so a tree of any size is numbered by many tasks: a row's
    place is its place in the range and the rows of its tree in the ranges before, of which there is a row a range and tree.
    """
    count = nodes.count()
    ranges = scaled_partitions(count, 100_000, min(nodes.sparkSession.sparkContext.defaultParallelism, 1 + count // 1000))
    sorted_rows = nodes.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    laid = stored(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("at", 33).alias("part")
    cells = laid.groupBy("tree", part).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    own = W.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = stored(cells.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n")), "merkle-ranges")
    few = F.broadcast(cells) if cells.count() <= BROADCAST_ROWS else cells
    return laid.withColumn("part", part).join(few, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _with_super(nodes: DataFrame, levels: int) -> DataFrame:
    """Adds block, the superblock of a node, and super, the group that it is dealt to: its own, or one that small trees share."""
    is_small = F.col("n") <= RUN ** (levels - levels // 3)
    bundles = max(1, nodes.where(is_small).count() // RUN**levels)
    block = F.floor(F.col("pos") / RUN**levels)
    shared = F.pmod(F.xxhash64("tree"), F.lit(bundles))
    return nodes.withColumn("block", block).withColumn("super", F.when(is_small, shared).otherwise(F.xxhash64("tree", "block")))


def reduced(digests: list[str], steps: int | None = None) -> list[list[str]]:
    """Levels of a superblock, its nodes first. Where the tree goes on above there are ``steps``; else they end with the tree."""
    levels = [digests]
    while len(levels) <= steps if steps else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[k : k + RUN])) for k in range(0, len(below), RUN)])
    return levels


def path_of(levels: list[list[str]], k: int) -> Iterator[str]:
    """For each level up to the superblock's top: the siblings to the left, a dot, and those to the right of the node above ``k``."""
    for level in levels[:-1]:
        first = k - k % RUN
        yield "".join(level[first:k]) + "." + "".join(level[k + 1 : first + RUN])
        k //= RUN


def folded(digest: str, path: str) -> str:
    """The root that ``digest`` and a proof's path give."""
    for level in path.split("/") if path else ():
        left, right = level.split(".")
        digest = sha(left + digest + right)
    return digest


def _superblocks(frame: pd.DataFrame, levels: int) -> Iterator[tuple[tuple, pd.DataFrame, list[list[str]]]]:
    """(tree, block), rows in order, levels: of each superblock in a group."""
    for key, rows in frame.sort_values("pos").groupby(["tree", "block"], sort=False):
        yield key, rows, reduced(rows["digest"].tolist(), levels if rows["n"].iloc[0] > RUN**levels else None)


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """One node for each superblock: tree, pos, n, digest, below (the group of its superblock)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        made = [(tree, block, -(-int(rows["n"].iloc[0]) // RUN**levels), nodes[-1][0], rows["super"].iloc[0]) for (tree, block), rows, nodes in _superblocks(frame, levels)]
        return pd.DataFrame(made, columns=["tree", "pos", "n", "digest", "below"])

    return nodes.select("tree", "pos", "n", "digest", "block", "super").groupBy("super").applyInPandas(run, "tree string, pos long, n long, digest string, below long")


def _layers(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Written tables: the leaves, the tops of their superblocks, the tops of those, up to one node a tree."""
    layers = [stored(_with_super(leaves, levels), "merkle-layer")]
    most = layers[0].agg(F.max("n")).first()[0] or 1
    while most > 1 or len(layers) == 1:
        layers.append(stored(_with_super(_tops(layers[-1], levels), levels), "merkle-layer"))
        most = -(-most // RUN**levels)
    return layers


def _descended(nodes: DataFrame, outer: DataFrame, columns: list[str], levels: int) -> DataFrame:
    """Paths of ``nodes`` from those of their superblocks' tops: ``columns`` of the nodes, and path and subroot.

    Nodes and the outer node of their superblock meet in one group, which finishes the reduction and joins the paths.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        above = {(t, b): (p, s) for t, b, p, s in zip(right["tree"], right["pos"], right["path"], right["subroot"], strict=True)}
        out = []
        for key, rows, own in _superblocks(left, levels):
            path, subroot = above[key]
            paths = ["/".join([*path_of(own, k), *[path] * bool(path)]) for k in range(len(rows))]
            out.append(rows[columns].assign(path=paths, subroot=subroot))
        return pd.concat(out) if out else left[columns].assign(path="", subroot="")

    kinds = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in columns)
    return nodes.groupBy("super").cogroup(outer.groupBy("below")).applyInPandas(run, f"{kinds}, path string, subroot string")


def merkle_manifest(docs: DataFrame, presented: Column | None = None, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", tree_col: str = "source", text_col: str = "text", with_path: bool = True, levels: int = LEVELS) -> DataFrame:
    """Every row as a leaf of the manifest, with a proof, and whether the row as ``presented`` still folds to the root.

    A leaf is the SHA-256 of ``columns``. Leaves of one ``tree_col`` (null is one too) in the order of ``id_col``, then of the leaf, are reduced three by
    three to a subroot, the subroots in the order of their names to the root. ``presented`` is a text that takes the place of ``text_col`` when a row is checked.
    Returns doc_id, leaf, subroot, root, proof_sha256 (of all siblings, lowest level first), folded_root, verified and, if asked for, path: a
    level of siblings after another, ``left.right`` with a slash between, empty for a table of one row.

    Null ids come first; rows repeated in full are leaves of their own; null columns and empty texts are told apart; an empty table has no rows and
    no root. Other columns are not read. No group has more nodes than a superblock (or some thousands of small trees), however large a source is;
    how many layers of superblocks there are goes with the logarithm of the rows.
    """
    spark, given = docs.sparkSession, {c: F.col(c) for c in columns}
    leaf = leaf_digest(list(given.values()))
    changed = F.lit(None).cast("string") if presented is None else F.when(~presented.eqNullSafe(F.col(text_col)), leaf_digest(list((given | {text_col: presented}).values())))
    tree = F.when(F.col(tree_col).isNull(), "").otherwise(F.concat(F.lit("s"), F.col(tree_col).cast("string")))
    leaves = stored(docs.select(F.col(id_col).alias("doc_id"), tree.alias("tree"), leaf.alias("digest"), changed.alias("changed")), "merkle-leaves")
    id_kind = leaves.schema["doc_id"].dataType
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", path string" * with_path
    if leaves.isEmpty():
        return spark.createDataFrame([], schema).withColumn("doc_id", F.col("doc_id").cast(id_kind))
    first = numbered(leaves, [F.col("tree"), F.col("doc_id").asc_nulls_first(), F.col("digest")]).withColumn("doc_id", F.col("doc_id").cast("string"))
    own = _layers(first, levels)
    discard(leaves)
    roots = own[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", "below")
    over = _layers(numbered(roots, [F.col("tree"), F.col("name")]), levels)
    root = over[-1].first()["digest"]  # one row

    outer = over[-1].select("tree", "pos", "below", F.lit("").alias("path"), F.col("digest").alias("subroot"))
    for layer in over[-2:0:-1]:
        outer = _descended(layer, outer, ["tree", "pos", "below"], levels)
    outer = _descended(over[0], outer, ["name", "below", "digest"], levels).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "below", "path", F.col("digest").alias("subroot"))
    for layer in own[-2:0:-1]:
        outer = _descended(layer, outer, ["tree", "pos", "below"], levels)

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        above = {(t, b): (p, s) for t, b, p, s in zip(right["tree"], right["pos"], right["path"], right["subroot"], strict=True)}
        out = []
        for key, rows, nodes in _superblocks(left, levels):
            outside, subroot = above[key]
            for k, (doc_id, digest, shown) in enumerate(zip(rows["doc_id"], rows["digest"], rows["changed"], strict=True)):
                path = "/".join([*path_of(nodes, k), *[outside] * bool(outside)])
                fold = folded(shown or digest, path)
                out.append((doc_id, digest, subroot, root, sha(path.replace("/", "").replace(".", "")), fold, fold == root, *[path] * with_path))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    done = own[0].groupBy("super").cogroup(outer.groupBy("below")).applyInPandas(finish, schema)
    return done.withColumn("doc_id", F.col("doc_id").cast(id_kind))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    presented = F.when(odd == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle_manifest(table(spark, sf_dir, "documents"), presented, with_path=False)


_LEAF_SQL = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
_UP_SQL = """SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM {up} WHERE n > 1 GROUP BY tree, level, pos // 3, n"""
_WALK_SQL = """
 SELECT w.row, w.tree, w.level + 1, w.pos // 3, (w.n + 2) // 3, w.beside || coalesce(a.digest, '') || coalesce(b.digest, '') || coalesce(c.digest, ''),
        sha256(coalesce(CASE WHEN w.pos % 3 > 0 THEN a.digest ELSE w.fold END, '') || coalesce(CASE WHEN w.pos % 3 = 1 THEN w.fold ELSE b.digest END, '') || coalesce(CASE WHEN w.pos % 3 = 2 THEN w.fold ELSE c.digest END, ''))
 FROM {walk} w
 LEFT JOIN {up} a ON a.tree = w.tree AND a.level = w.level AND a.pos = w.pos - w.pos % 3 AND a.pos <> w.pos
 LEFT JOIN {up} b ON b.tree = w.tree AND b.level = w.level AND b.pos = w.pos - w.pos % 3 + 1 AND b.pos <> w.pos
 LEFT JOIN {up} c ON c.tree = w.tree AND c.level = w.level AND c.pos = w.pos - w.pos % 3 + 2 AND c.pos <> w.pos
 WHERE w.n > 1"""
_CRC_SQL = """xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda crc, byte:
 list_reduce(range(8), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, xor(crc, byte)), 4294967295::BIGINT))"""
OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT *, coalesce('s' || source, '') AS tree, {_LEAF_SQL.format(text="text")} AS whole, {_LEAF_SQL.format(text="shown")} AS altered
 FROM (SELECT *, CASE WHEN {_CRC_SQL} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS shown FROM documents)),
l AS (SELECT row_number() OVER () AS row, doc_id, tree, sha256(whole) AS leaf, sha256(altered) AS shown FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
up(tree, level, pos, digest, n) AS (SELECT tree, 0, pos, leaf, n FROM p UNION ALL {_UP_SQL.format(up="up")}),
s AS (SELECT tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(tree, level, pos, digest, n) AS (SELECT '', 0, pos, digest, n FROM s UNION ALL {_UP_SQL.format(up="top")}),
walk(row, tree, level, pos, n, beside, fold) AS (SELECT row, tree, 0, pos, n, '', shown FROM p UNION ALL {_WALK_SQL.format(walk="walk", up="up")}),
far(row, tree, level, pos, n, beside, fold) AS (SELECT w.row, '', 0, s.pos, s.n, w.beside, w.fold FROM walk w JOIN s ON w.tree = s.name WHERE w.n = 1 UNION ALL {_WALK_SQL.format(walk="far", up="top")})
SELECT p.doc_id, p.leaf, s.digest AS subroot, top.digest AS root, sha256(far.beside) AS proof_sha256, far.fold AS folded_root, far.fold = top.digest AS verified
FROM p JOIN s ON p.tree = s.name JOIN far ON far.row = p.row AND far.n = 1 JOIN top ON top.n = 1
"""
