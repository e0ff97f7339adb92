"""Merkle manifest of a dataset by nested-interval labels.

Every node is labelled with the half-open interval ``[lo, hi)`` of leaf ranks that it covers. A node lies under
another exactly if its interval lies inside the other's, and all nodes of a level that can hold a rank have the
same bucket, ``lo`` divided by the width of that level. So ancestors are attached by an equality join on tree and
bucket with a check of containment, and a node's siblings are what remains of its parent's interval: the nodes
in ``[parent.lo, lo)`` and in ``[hi, parent.hi)``.

Nodes are kept in blocks: a block is a node with all nodes of the LEVELS levels below it, at most
ARITY ** LEVELS at the lowest. Each pass groups nodes by block, which leaves one row in ARITY ** LEVELS for the
next pass, so all passes together move little more than the leaves. Paths to the root are handed down the same
way, from the topmost blocks to the leaves, and no group is larger than a block however large its tree is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.scratch import durable
from loomspark.llm.sqlblocks import let

#: Children of a node, and levels of a block.
ARITY, LEVELS = 3, 3
#: Leaves under a node that is one block above the leaves.
WIDTH = ARITY**LEVELS


def record_digest(values: list[Column]) -> Column:
    """sha256 of the values, each as its number of UTF-8 bytes, a colon and itself; a null is a hyphen."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` of ``(tree, digest, ...)`` with their rank ``lo`` in the tree by ``order`` and the tree's size ``n``.

    Rows are dealt by ranges, so one tree may spread over all tasks; a tree's rows in a range are numbered there
    and the counts of the ranges before are added.
    """
    ranges = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(leaves.repartitionByRange(ranges, "tree", *order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("own"))
    offsets = counted.select("tree", "range", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("first"), F.sum("own").over(Window.partitionBy("tree")).alias("n"))
    place = F.row_number().over(Window.partitionBy("tree", "range").orderBy(*order)).cast("long") - 1
    return dealt.withColumn("place", place).join(offsets, ["tree", "range"]).withColumn("lo", F.col("first") + F.col("place")).drop("range", "first", "place")


def _over(nodes: Column, arity: int) -> Column:
    """The next level: a node over each run of ``arity`` nodes."""

    def parent(j: Column) -> Column:
        digest = lambda run: F.sha2(F.concat_ws("", run["digest"]), 256)
        node = lambda run: F.struct(F.get(run, F.lit(0))["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), digest(run).alias("digest"))
        return let(F.slice(nodes, j * arity + 1, arity), node)

    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(nodes) / arity).cast("int") - 1), parent)


def _blocks(nodes: DataFrame, width: int, arity: int, levels: int) -> DataFrame:
    """Blocks over ``nodes`` of ``(tree, n, lo, hi, digest)``, each with its ``levels`` from the lowest to its own.

    Levels end early where one node covers the whole tree: that is the tree's root.
    """
    kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))
    grouped = nodes.groupBy("tree", "n", F.floor(F.col("lo") / width).alias("bucket")).agg(kids.alias("kids"))

    def climb(below: Column, _: Column) -> Column:
        whole = lambda last: (F.size(last) == 1) & (F.get(last, F.lit(0))["lo"] == 0) & (F.get(last, F.lit(0))["hi"] == F.col("n"))
        return let(F.element_at(below, -1), lambda last: F.when(whole(last), below).otherwise(F.concat(below, F.array(_over(last, arity)))))

    stacked = grouped.select("tree", "n", "bucket", F.reduce(F.sequence(F.lit(1), F.lit(levels)), F.array("kids"), climb).alias("levels"))
    top = F.get(F.element_at("levels", -1), F.lit(0))
    return stacked.withColumn("top", top).select("tree", "n", "bucket", "levels", "top.lo", "top.hi", "top.digest")


def _siblings(levels: Column, lo: Column) -> Column:
    """Left and right sibling digests of the nodes on the way from rank ``lo`` up through a block, level by level."""
    holds = lambda x: (x["lo"] <= lo) & (lo < x["hi"])
    inside = lambda nodes, low, high: F.concat_ws("", F.filter(nodes, lambda x: (x["lo"] >= low) & (x["hi"] <= high))["digest"])

    def step(i: Column) -> Column:
        def parts(both: Column) -> Column:
            own, parent = both["own"], both["parent"]
            return F.struct(inside(F.get(levels, i), parent["lo"], own["lo"]).alias("left"), inside(F.get(levels, i), own["hi"], parent["hi"]).alias("right"))

        found = lambda at: F.get(F.filter(F.get(levels, at), holds), F.lit(0))
        return let(F.struct(found(i).alias("own"), found(i + 1).alias("parent")), parts)

    steps = F.transform(F.sequence(F.lit(0), F.size(levels) - 2), step)
    return F.when(F.size(levels) > 1, steps).otherwise(F.array().cast("array<struct<left:string,right:string>>"))


@dataclass
class Forest:
    """Trees over ranked leaves: a row a leaf ``(tree, n, lo, digest, ...)`` and the blocks of each pass."""

    leaves: DataFrame
    passes: list[DataFrame]
    arity: int
    levels: int

    @property
    def roots(self) -> DataFrame:
        """``(tree, digest)``, a row a tree."""
        whole = [blocks.where("lo = 0 and hi = n").select("tree", "digest") for blocks in self.passes]
        return reduce(DataFrame.union, whole)

    def nodes(self) -> DataFrame:
        """The manifest: ``(tree, level, lo, hi, digest)`` of every node, leaves (level 0) included."""
        found = []
        for number, blocks in enumerate(self.passes):
            level = blocks.select("tree", "n", "levels", F.posexplode("levels").alias("up", "nodes"))
            last = (F.col("up") < self.levels) | ((F.size("nodes") == 1) & (F.get("nodes", F.lit(0))["lo"] == 0) & (F.get("nodes", F.lit(0))["hi"] == F.col("n")))
            found.append(level.where(last).select("tree", (F.col("up") + number * self.levels).alias("level"), F.inline("nodes")))
        return reduce(DataFrame.union, found)

    def paths(self, tails: DataFrame) -> DataFrame:
        """Leaves with the ``path`` of sibling digests to the end of their tree's tail.

        ``tails`` has a row a tree: ``tree``, the ``path`` that follows its root, and columns that are handed down.
        """
        kept = [c for c in tails.columns if c not in ("tree", "path")]
        above = None
        for number in reversed(range(len(self.passes))):
            blocks = self.passes[number]
            whole = (F.col("lo") == 0) & (F.col("hi") == F.col("n"))
            placed = blocks.where(whole).join(tails, "tree")
            if above is not None:
                placed = placed.unionByName(self._under(blocks.where(~whole), above, kept, number + 1))
            above = durable(placed, "paths") if number else placed
        return self._under(self.leaves.withColumn("hi", F.col("lo") + 1), above, kept, 0).drop("hi")

    def _under(self, nodes: DataFrame, blocks: DataFrame, kept: list[str], number: int) -> DataFrame:
        """Containment join of nodes with the blocks of pass ``number``, bucketed by the width of their level."""
        width = self.arity ** (self.levels * (number + 1))
        over = blocks.select("tree", F.col("bucket").alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("levels").alias("_levels"), F.col("path").alias("_path"), *kept)
        labelled = nodes.withColumn("_bucket", F.floor(F.col("lo") / width))
        within = labelled.join(over, ["tree", "_bucket"]).where("_lo <= lo and hi <= _hi")
        return within.select(*nodes.columns, F.concat(_siblings(F.col("_levels"), F.col("lo")), "_path").alias("path"), *kept)


def build(leaves: DataFrame, order: list[str], arity: int = ARITY, levels: int = LEVELS) -> Forest:
    """Trees over ``leaves`` of ``(tree, digest, ...)``, a tree for each non-null ``tree``, its leaves by ``order``."""
    placed = durable(ranked(leaves, order), "leaves")
    largest = placed.agg(F.max("n")).first()[0] or 1
    nodes = placed.select("tree", "n", "lo", (F.col("lo") + 1).alias("hi"), "digest")
    passes: list[DataFrame] = []
    covered = 1
    while covered < largest or not passes:
        covered *= arity**levels
        passes.append(durable(_blocks(nodes, covered, arity, levels), "blocks"))
        nodes = passes[-1].where("lo > 0 or hi < n").select("tree", "n", "lo", "hi", "digest")
    return Forest(placed, passes, arity, levels)


def fold(path: Column, digest: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.reduce(path, digest, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))


def path_digest(path: Column) -> Column:
    """sha256 of all sibling digests of a path, level by level and left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda step: F.concat(step["left"], step["right"]))), 256)


@dataclass
class Manifest:
    """A forest over the groups of a table and a tree over the groups' roots."""

    groups: Forest
    top: Forest

    def proofs(self) -> DataFrame:
        """Every leaf with its group's ``subroot``, the ``root`` and the ``path`` of siblings between."""
        root = self.top.roots.select("tree", F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
        tails = self.top.paths(root).select(F.col("grp").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
        return self.groups.paths(durable(tails, "tails"))


def manifest(records: DataFrame, group: str, order: list[str], columns: list[str], altered: Callable[[str, Column], Column] | None = None, arity: int = ARITY, levels: int = LEVELS) -> Manifest:
    """The Merkle manifest of ``records``: a tree for each value of ``group``, and a tree over their roots.

    A record's leaf is ``record_digest`` of ``columns``. In a group leaves ascend by ``order``, nulls first and ties
    by digest; groups ascend by their UTF-8 bytes, a null first. While there are several nodes, each run of
    ``arity`` consecutive ones (the last may be shorter, even one) becomes their parent. A group of one record is
    that record's digest. ``altered`` may give another value of a column; the leaves then have a column
    ``altered`` as well, the digest of the altered record, null where nothing is altered.

    Nulls in any column, empty and very long values are hashed as they are. Equal rows are leaves of their own,
    next to each other. An empty table gives no leaves and no root. Other columns are left alone.
    """
    own = [F.col(c) for c in columns]
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree")
    names = [f"key{i}" for i in range(len(order))]
    keys = [F.col(c).alias(name) for c, name in zip(order, names, strict=True)]
    digests = [record_digest(own).alias("digest")]
    if altered is not None:
        other = [altered(c, F.col(c)) for c in columns]
        same = reduce(lambda a, b: a & b, [a.eqNullSafe(b) for a, b in zip(other, own, strict=True)])
        digests.append(F.when(~same, record_digest(other)).alias("altered"))
    leaves = durable(records.select(tree, *keys, *digests), "records")
    groups = build(leaves, [*names, "digest"], arity, levels)
    subroots = groups.roots.select(F.lit("").alias("tree"), F.col("tree").alias("grp"), "digest")
    return Manifest(groups, build(subroots, ["grp"], arity, levels))


#: The columns of documents that a leaf covers, in this order.
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered(column: str, value: Column) -> Column:
    """What the check alters: where 2 divides crc32 of doc_id as text, the text loses its newlines."""
    if column != "text":
        return value
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(hit, F.replace(value, F.lit("\n"), F.lit(""))).otherwise(value)


def verified_documents(docs: DataFrame) -> DataFrame:
    """One row a document: ``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``.

    Leaves cover COLUMNS, a tree a source. ``folded_root`` is folded from the altered record where ``tampered``
    alters it, with the path of the record as it was; ``verified`` says whether that is still the root. A row
    without a doc_id is never altered; other cases as in ``manifest``.
    """
    proofs = manifest(docs, "source", ["doc_id"], COLUMNS, tampered).proofs()
    folded = fold(F.col("path"), F.coalesce("altered", "digest"))
    rows = proofs.select(F.col("key0").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
