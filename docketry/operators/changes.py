"""What changed in a folder between two listings, by a tree of digests.

A listing's tree has a row for each folder: the sum of its files' hashes (its own and those of all folders below), their number and
their bytes. Sums don't depend on order, so a tree is one aggregate that combines before it shuffles, and the root's digest is the
listing's key. Two trees are compared from the root down: only folders under one that differs are looked at, and only
files of folders that differ themselves are compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.sources.shared import spill

ADDED, CHANGED, REMOVED = "added", "changed", "removed"


def folder_of(path: Column) -> Column:
    """The folder that holds a path; `` is the root, and what is in it has no slash."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _above(folder: Column) -> Column:
    """A folder and all folders above it, down from the root."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder")))


def tree(listing: DataFrame) -> DataFrame:
    """(folder, depth, digest, own, files, bytes) of a listing (path, size, fingerprint): digest over all below, own over the folder's own files."""
    each = F.xxhash64("path", "fingerprint").cast("decimal(38,0)")
    folder = folder_of(F.col("path"))
    # one row a folder first, so that what travels up the tree is folders, not files
    own = listing.groupBy(folder.alias("at")).agg(F.sum(each).alias("own"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    up = own.select("at", "own", "n", "size", F.explode(_above(F.col("at"))).alias("x")).select("x.folder", "x.depth", "own", "n", "size", (F.col("x.folder") == F.array_join(F.filter(F.split("at", "/"), lambda x: x != ""), "/")).alias("here"))
    return up.groupBy("folder", "depth").agg(F.sum("own").alias("digest"), F.sum(F.when(F.col("here"), F.col("own"))).alias("own"), F.sum("n").alias("files"), F.sum("size").alias("bytes"))


def levels(old: DataFrame, new: DataFrame) -> DataFrame:
    """(folder, depth, differs, own_differs) of the folders that a comparison of two trees looks at: the root, and what lies in a folder that differs."""
    x = old.select("folder", "depth", F.col("digest").alias("d1"), F.col("own").alias("o1"), F.col("files").alias("f1"))
    y = new.select("folder", "depth", F.col("digest").alias("d2"), F.col("own").alias("o2"), F.col("files").alias("f2"))
    both = x.join(y, ["folder", "depth"], "full_outer")
    differs, own = ~(F.col("d1").eqNullSafe(F.col("d2")) & F.col("f1").eqNullSafe(F.col("f2"))), ~F.col("o1").eqNullSafe(F.col("o2"))
    both = spill(both.select("folder", "depth", F.when(F.col("depth") > 0, folder_of(F.col("folder"))).alias("parent"), differs.alias("differs"), own.alias("own_differs")), "folders")
    seen, at = [], both.filter("depth = 0")
    while not at.isEmpty():
        at = spill(at, "folders-seen")
        seen.append(at)
        at = both.filter(F.col("depth") == len(seen)).join(at.filter("differs").select(F.col("folder").alias("parent")), "parent", "left_semi").select(both.columns)
    every = reduce(DataFrame.unionByName, seen) if seen else both
    return every.select("folder", "depth", "differs", "own_differs")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two listings (path, size, fingerprint): added, changed (another fingerprint), removed."""
    folders = levels(tree(old), tree(new)).filter("own_differs").select("folder")

    def files(listing: DataFrame, name: str) -> DataFrame:
        own = listing.select("path", F.struct("fingerprint").alias(name), F.array_join(F.filter(F.split(folder_of(F.col("path")), "/"), lambda x: x != ""), "/").alias("folder"))
        return own.join(folders, "folder", "left_semi").drop("folder")

    both = files(old, "before").join(files(new, "after"), "path", "full_outer")
    change = F.when(F.col("before").isNull(), ADDED).when(F.col("after").isNull(), REMOVED).when(~F.col("before").eqNullSafe(F.col("after")), CHANGED)
    return both.select("path", change.alias("change")).filter("change is not null")
