"""Components of links between members that share cells, without looking at all pairs of a cell.

In each round some members of a cell, its heads, are compared with all that is left of it, and
leave: all their pairs are known then. The components of the links so far are named, and a pair
of one component need not be looked at any more, so a cell all of whose members belong to one
component is done. A cell of copies thus takes one comparison for each member, and every pair of
a cell is compared or proved to belong together: no link is lost, whatever the size of the cell.

The first head is the member with the smallest ``at``, how many of its own marks come before the
cell's: of texts around a common one that is the one closest to it, to which the others are linked
most likely. Later heads are drawn, the same in all cells, so that pairs recur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.components import components
from textwarden.llm.skew import spread_join
from textwarden.runtime import materialise

#: Heads drawn from a cell in the second round, and by how much they grow with each round.
HEADS, GROWTH = 4, 8
_PLACES = 2**36


def place(id_: Column) -> Column:
    """The same random order of members in all cells."""
    return F.xxhash64(id_).bitwiseAND(F.lit(_PLACES - 1))


def rank(at: Column, id_: Column) -> Column:
    """The order of first heads."""
    return at.cast("long") * F.lit(_PLACES) + place(id_)


def shared(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members (``key``, ``id``, ``first``, ``at``) of cells with several, one of which at least is ``first``, with ``size`` and ``least``, the rank of the first head; and the sizes."""
    sizes = cells.groupBy("key").agg(F.count("*").alias("size"), F.min(F.when(F.col("first"), rank(F.col("at"), F.col("id")))).alias("least"))
    sizes = materialise(sizes.filter("size > 1 and least is not null"), "cell-sizes")
    return spread_join(cells, sizes, "key", sizes), sizes


def linked(members: DataFrame, sizes: DataFrame, alike: Callable[[Column, Column], Column], verify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``node``, ``root`` of all that is linked.

    ``members``: ``key``, ``size``, ``least``, and ``m``, a struct with ``id``, ``first``, ``at``
    and whatever ``alike`` compares. Of each pair of a cell, one of which is ``first``, ``alike``
    tells whether they may be linked and ``verify`` (given ``x``, ``y``; default: all) which are.
    """
    left, width, roots = materialise(members, "cell-members").withColumn("comp", F.col("m.id")), 0, None
    while True:
        own = rank(F.col("m.at"), F.col("m.id"))
        head = F.col("m.first") & ((own == F.col("least")) | (place(F.col("m.id")) / F.lit(float(_PLACES)) * F.col("size") < width))
        heads = left.filter(head).select("key", F.col("m").alias("h"), F.col("comp").alias("head_comp"))
        met = spread_join(left, heads, "key", sizes).filter((F.col("comp") != F.col("head_comp")) & alike(F.col("m"), F.col("h")))
        pairs = met.select(F.least("m.id", "h.id").alias("x"), F.greatest("m.id", "h.id").alias("y")).distinct()
        found = materialise(verify(materialise(pairs, "cell-pairs")) if verify else pairs, "cell-links")
        if roots is None or not found.isEmpty():
            known = found.toDF("a", "b") if roots is None else found.toDF("a", "b").union(roots)
            roots = materialise(components(known), "cell-roots")
        rest = left.filter(~head).drop("comp").join(roots, F.col("m.id") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "m.id")).drop("node", "root")
        rest = rest.select("key", "m", "comp")
        sizes = rest.groupBy("key").agg(F.count("*").alias("size"), F.min(F.when(F.col("m.first"), rank(F.col("m.at"), F.col("m.id")))).alias("least"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        sizes = materialise(sizes.filter("low < high and least is not null").select("key", "size", "least"), "cell-sizes")
        if sizes.isEmpty():
            return roots
        left = materialise(spread_join(rest, sizes, "key", sizes), "cell-rest")
        width = width * GROWTH or HEADS
