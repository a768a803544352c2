"""Merkle dataset manifest: Spark places the leaves in aligned buckets, DuckDB hashes a bucket's levels on the executors, Spark joins the buckets' roots and outer proofs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import held, sent, shared_dir, small_batches, tidy, written

#: Children of a node, and levels below a bucket's root: a bucket holds FANOUT ** LEVELS leaves at most.
FANOUT, LEVELS = 8, 4
#: Buckets that DuckDB hashes at once, and the memory that it may take for them.
BUCKETS, MEMORY = 4, "512MB"
#: Characters of a digest.
HEX = 64
#: Of this many runs of rows of one tree in one task, the places are broadcast.
MOST_RUNS = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_OUTER = "array<struct<own:int,run:string>>"


def leaf(*values: Column) -> Column:
    """The digest of a row: of each value `-` if null, else its UTF-8 bytes, a colon and the value as text."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def _tree(c: Column) -> Column:
    """A key that is never null: null comes first, the others by their bytes."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def _levels(n: Column) -> Column:
    """Levels of a tree of n nodes: the octal digits of n - 1, none of one node."""
    return F.when(n > 1, F.length(F.conv((n - 1).cast("string"), 10, FANOUT))).otherwise(0)


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows, a written table, with their place (at, from 0) among the rows of their tree, and the rows of that (n).

    The rows are dealt by ranges, so that a tree spreads over as many tasks as it needs; a task counts its own rows, and
    the sums of the tasks before, one row a tree and task, give the places. order must tell all rows of a tree apart.
    """
    run = F.shiftright("__at", 33)
    dealt = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("__at", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("__run", run), "sorted")
    runs = dealt.groupBy(tree, "__run").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    own = Window.partitionBy(tree)
    before = F.coalesce(F.sum("__rows").over(own.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = written(runs.select(tree, "__run", (before - F.col("__first")).alias("__shift"), F.sum("__rows").over(own).alias("n")), "runs")
    return dealt.join(sent(runs, MOST_RUNS), [tree, "__run"]).select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("at"), "n")


def _buckets(leaves: DataFrame, levels: int) -> DataFrame:
    """One row for each bucket of FANOUT ** levels leaves: its leaves in order and the levels that it has."""
    size = FANOUT**levels
    row = F.struct((F.col("at") % size).cast("int").alias("place"), "doc_id", "leaf", "now")
    grouped = leaves.groupBy("tree", F.expr(f"at div {size}").alias("bucket"), F.least(_levels(F.col("n")), F.lit(levels)).cast("int").alias("depth"))
    return grouped.agg(F.sort_array(F.collect_list(row)).alias("rows"))


def _duck():
    own = held("manifest")
    if "duck" not in own:
        import duckdb

        own["duck"] = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    return own["duck"]


def _hashed(part: pa.RecordBatch, levels: int):
    """A connection with the tables level0, level1, ... of some buckets: level0 has the leaves, each other the nodes above, with the digests below one after another (run)."""
    duck = _duck()
    duck.register("part", pa.Table.from_batches([part]))
    duck.execute("CREATE OR REPLACE TEMP TABLE level0 AS SELECT tree, bucket, depth, r.place AS place, r.doc_id AS doc_id, r.leaf AS node, r.now AS now FROM (SELECT tree, bucket, depth, unnest(rows) AS r FROM part)")
    for k in range(levels):  # a tree of fewer levels has one node left, which goes up as it is
        duck.execute(f"""
            CREATE OR REPLACE TEMP TABLE level{k + 1} AS
            SELECT tree, bucket, depth, place, CASE WHEN depth > {k} THEN run ELSE '' END AS run, CASE WHEN depth > {k} THEN sha256(run) ELSE run END AS node
            FROM (SELECT tree, bucket, depth, place // {FANOUT} AS place, string_agg(node, '' ORDER BY place) AS run FROM level{k} GROUP BY tree, bucket, depth, place // {FANOUT})""")
    return duck


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, BUCKETS):
            yield batch.slice(k, BUCKETS)


def _roots(levels: int):
    @tidy
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            yield from _hashed(part, levels).sql(f"SELECT tree, bucket, node FROM level{levels}").to_arrow_table().to_batches()

    return kernel


def _proofs(levels: int):
    sides = f"substr(run, 1, {HEX} * own) AS l, substr(run, {HEX} * (own + 1) + 1) AS r"

    @tidy
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            duck = _hashed(part, levels)
            duck.execute("CREATE OR REPLACE TEMP TABLE fold AS SELECT tree, bucket, depth, place, doc_id, node AS leaf, coalesce(now, node) AS folded, '' AS proof FROM level0")
            for k in range(levels):
                duck.execute(f"""
                    CREATE OR REPLACE TEMP TABLE fold AS
                    SELECT tree, bucket, depth, place // {FANOUT} AS place, doc_id, leaf, CASE WHEN depth > {k} THEN sha256(l || folded || r) ELSE folded END AS folded, proof || l || r AS proof
                    FROM (SELECT f.*, {sides} FROM (SELECT *, place % {FANOUT} AS own FROM fold) f JOIN level{k + 1} p ON f.tree = p.tree AND f.bucket = p.bucket AND f.place // {FANOUT} = p.place)""")
            duck.execute('CREATE OR REPLACE TEMP TABLE fold AS SELECT f.*, "outer", subroot, root FROM fold f JOIN part USING (tree, bucket)')
            for k in range(1, 1 + duck.execute('SELECT coalesce(max(len("outer")), 0) FROM part').fetchall()[0][0]):
                duck.execute(f"""
                    CREATE OR REPLACE TEMP TABLE fold AS
                    SELECT doc_id, leaf, "outer", subroot, root, CASE WHEN step THEN sha256(l || folded || r) ELSE folded END AS folded, CASE WHEN step THEN proof || l || r ELSE proof END AS proof
                    FROM (SELECT *, {sides} FROM (SELECT *, len("outer") >= {k} AS step, "outer"[{k}].run AS run, "outer"[{k}].own AS own FROM fold))""")
            yield from duck.sql("SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root FROM fold").to_arrow_table().to_batches()

    return kernel


def _climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, paths) of nodes (tree, at, node, left: levels up to the tree's root), a written table: (tree, root), and (tree, at, outer) with a node's place among its siblings and all their digests, level by level.

    A level is one grouping by the parent, whose group has FANOUT rows; from the root down, each parent hands its path to its children.
    """
    top = nodes.agg(F.max("left")).first()[0] or 0
    levels = [nodes]
    for _ in range(top):
        up = levels[-1].groupBy("tree", F.expr(f"at div {FANOUT}").alias("at"), "left").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("place"), "node"))).alias("below"))
        run = F.array_join(F.transform("below", lambda x: x["node"]), "")
        more = F.col("left") > 0
        up = up.select("tree", "at", F.when(more, F.sha2(run, 256)).otherwise(run).alias("node"), F.greatest(F.col("left") - 1, F.lit(0)).alias("left"), F.when(more, run).otherwise("").alias("run"))
        levels.append(written(up, "level"))
    paths = levels[-1].select("tree", "at", F.lit(None).cast(_OUTER).alias("outer"))
    paths = paths.withColumn("outer", F.coalesce("outer", F.array().cast(_OUTER)))
    for low, high in zip(levels[-2::-1], levels[:0:-1], strict=True):
        above = high.select("tree", "at", "run").join(paths, ["tree", "at"]).select("tree", F.col("at").alias("parent"), "run", "outer")
        step = F.when(F.col("run") == "", F.col("outer")).otherwise(F.concat(F.array(F.struct((F.col("at") % FANOUT).cast("int").alias("own"), "run")), "outer"))
        paths = low.select("tree", "at", F.expr(f"at div {FANOUT}").alias("parent")).join(above, ["tree", "parent"]).select("tree", "at", step.cast(_OUTER).alias("outer"))
    return levels[-1].select("tree", F.col("node").alias("root")), paths


@dataclass
class Manifest:
    """A dataset's Merkle trees: leaves in buckets, the subroot of each group, the root over all, and each bucket's outer proof (up to the root)."""

    buckets: DataFrame
    subroots: DataFrame
    outer: DataFrame
    levels: int = LEVELS

    @property
    def root(self) -> str | None:
        """The digest of the whole dataset; None of an empty one."""
        first = self.outer.select("root").head(1)
        return first[0]["root"] if first else None

    def proofs(self) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row a leaf: the digest of its siblings up to the root, and the root that its present digest folds to with them."""
        rows = self.buckets.join(self.outer, ["tree", "bucket"])
        out = rows.mapInArrow(_proofs(self.levels), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
        return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", id_col: str = "doc_id", now: Column | None = None, levels: int = LEVELS) -> Manifest:
    """The manifest of docs: a tree for each value of group_col, its leaves in ascending order of ids (null first, ties by digest), and one over the subroots in ascending order of groups (null first, bytewise).

    A leaf is the digest of the row's fields, of which null and empty values are told apart. FANOUT consecutive nodes, the
    last ones fewer or even one, have the digest of theirs one after another as parent, until one remains; a lone leaf is
    its tree's root. now: the digest of the row as it is found later (null: unchanged), by which proofs() verifies it.
    Rows that repeat are leaves each. Other columns are not read; an empty table has no trees. Texts are read once and
    not moved: leaves of digests are dealt by ranges, so a group of any size spreads over tasks, and DuckDB hashes
    buckets of FANOUT ** levels leaves.
    """
    small_batches(docs.sparkSession)
    made = docs.select(_tree(F.col(group_col)).alias("tree"), F.col(id_col).cast("long").alias("doc_id"), leaf(*(F.col(c) for c in fields)).alias("leaf"), (F.lit(None) if now is None else now).cast("string").alias("now"))
    made = written(made.withColumn("row", F.monotonically_increasing_id()), "leaves")
    at = placed(made, "tree", ["doc_id", "leaf", "row"])
    buckets = written(_buckets(at, levels), "buckets")
    heights = buckets.groupBy("tree").agg(_levels(F.count("*")).cast("int").alias("left"))
    tops = buckets.mapInArrow(_roots(levels), "tree string, bucket long, node string").join(sent(written(heights, "heights"), MOST_RUNS), "tree").select("tree", F.col("bucket").alias("at"), "node", "left")
    subroots, paths = _climb(written(tops, "roots"))
    subroots = written(subroots.withColumnRenamed("root", "subroot").withColumn("all", F.lit("")), "subroots")
    ranked = placed(subroots, "all", ["tree"]).select(F.col("all").alias("tree"), "at", F.col("subroot").alias("node"), _levels(F.col("n")).cast("int").alias("left"), F.col("tree").alias("name"), "subroot")
    ranked = written(ranked, "ranked")
    root, above = _climb(ranked.select("tree", "at", "node", "left"))
    names = ranked.join(above, ["tree", "at"]).join(F.broadcast(root), "tree").select(F.col("name").alias("tree"), "subroot", "root", F.col("outer").alias("above"))
    names = written(names, "names")
    outer = paths.withColumnRenamed("at", "bucket").join(sent(names, MOST_RUNS), "tree").select("tree", "bucket", "subroot", "root", F.concat("outer", "above").alias("outer"))
    return Manifest(buckets, names.select("tree", "subroot", "root"), written(outer, "outer"), levels)
