"""Structures of many atoms, one row for each: bonds by a grid of cells, ligands as connected parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chelate.checkpoints import written
from chelate.constants import METALS

#: A key with more than one of so many parts of all rows is hot.
HOT = 1_024
#: Width of a grid's cubes in cutoffs; at 2, an atom reaches half of the cubes beside its own.
WIDTH = 2.0


def grid_edges(atoms: DataFrame, cutoff: float = 1.8) -> DataFrame:
    """mol, i, j, distance of all pairs i < j of a structure's atoms that are nearer than the cutoff.

    atoms: mol, idx, x, y, z. Space is cut into cubes of WIDTH cutoffs; an atom meets those of its own
    cube and, from the other side, of the 26 about it, of which 13 are asked, so each pair meets once.
    It goes only to those cubes that the cutoff reaches, some three and a half of the 13. No task holds a whole structure. Atoms whose coordinates aren't finite, or beyond 2 ** 52
    cutoffs, have no edges.
    """
    if cutoff <= 0:
        raise ValueError("the cutoff has to be above 0")
    finite = " AND ".join(f"abs({k}) < {cutoff * 2.0**52!r}D" for k in "xyz")
    rows = atoms.select("mol", "idx", *[F.col(k).cast("double").alias(k) for k in "xyz"]).where(finite)
    cell = [F.floor(F.col(k) / (WIDTH * cutoff)).alias(f"c{k}") for k in "xyz"]
    here = rows.select("mol", *cell, F.col("idx").alias("a"), *[F.col(k).alias(f"{k}a") for k in "xyz"])
    half = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) >= (0, 0, 0)]
    steps = F.array(*[F.struct(*[F.lit(s).cast("long").alias(f"s{k}") for s, k in zip(step, "xyz", strict=True)]) for step in half])
    # how far the next cube of either side is, in cubes; a margin for rounding grows with the coordinate
    q = {k: F.col(k) / (WIDTH * cutoff) for k in "xyz"}
    reach = {k: 1 / WIDTH + 1e-9 + F.abs(q[k]) * 2.0**-48 for k in "xyz"}
    up, down = {k: F.floor(q[k]) + 1 - q[k] <= reach[k] for k in "xyz"}, {k: q[k] - F.floor(q[k]) <= reach[k] for k in "xyz"}
    rows = rows.withColumns({f"{n}{k}": side[k] for n, side in (("up", up), ("down", down)) for k in "xyz"})

    def reached(s: Column) -> Column:
        each = [(s[f"s{k}"] == 0) | ((s[f"s{k}"] == 1) & F.col(f"up{k}")) | ((s[f"s{k}"] == -1) & F.col(f"down{k}")) for k in "xyz"]
        return each[0] & each[1] & each[2]

    there = rows.select("mol", *cell, F.col("idx").alias("b"), *[F.col(k).alias(f"{k}b") for k in "xyz"], F.explode_outer(F.filter(steps, reached)).alias("s"))
    there = there.select("mol", *[(F.col(f"c{k}") + F.col(f"s.s{k}")).alias(f"c{k}") for k in "xyz"], "b", "xb", "yb", "zb", F.expr("s.sx = 0 AND s.sy = 0 AND s.sz = 0").alias("own"))
    d = F.sqrt(sum(((F.col(f"{k}a") - F.col(f"{k}b")) ** 2 for k in "xyz"), F.lit(0.0)))
    near = here.join(there, ["mol", "cx", "cy", "cz"]).where((~F.col("own") | (F.col("a") < F.col("b"))) & (d < cutoff))
    return near.select("mol", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), d.alias("distance"))


def connected(edges: DataFrame) -> DataFrame:
    """mol, idx, part: of each atom on an edge the least atom that edges (mol, i, j) lead to.

    Stars about least atoms, by turns of the larger and the smaller neighbours, each round written.
    An atom on more than one of HOT parts of all edges, as the centre of a large part comes to be,
    gets its least neighbour by a broadcast of at most HOT rows.
    """
    cur = written(edges.where("i <> j").select("mol", F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v")).distinct())
    measure, node = (F.count("*"), F.sum(F.xxhash64("mol", "u", "v").cast("decimal(38,0)"))), ["mol", "u"]
    last, now = None, tuple(cur.agg(*measure).first())
    while now != last:
        both = cur.unionByName(cur.select("mol", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*node).agg(F.min("v").alias("m"), F.count("*").alias("d")).withColumn("m", F.least("u", "m"))
        hot = F.broadcast(low.where(F.col("d") * HOT > 2 * now[0]).select(*node, "m"))
        up = both.where("v > u")
        rest = up.join(hot.select(*node), node, "left_anti").join(low.where(F.col("d") * HOT <= 2 * now[0]).select(*node, "m"), node)
        large = up.join(hot, node).unionByName(rest).select("mol", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(*node).agg(F.min("v").alias("m"))
        pair = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        cur = written(large.join(low, node).select("mol", F.explode(pair).alias("e")).select("mol", "e.*").where("u <> v").distinct())
        last, now = now, tuple(cur.agg(*measure).first())
    part = cur.groupBy(*node).agg(F.min("v").alias("part")).withColumnRenamed("u", "idx")
    return part.unionByName(part.select("mol", F.col("part").alias("idx"), "part").distinct())


def parts(atoms: DataFrame, cutoff: float = 1.8) -> DataFrame:
    """mol, part, n_atoms, formula of what is left connected when a structure's transition metals are taken out.

    atoms: mol, idx, element, x, y, z; a part is named by its least atom. An atom without neighbours is a part of its own.
    """
    light = atoms.where(~F.col("element").isin(list(METALS)) | F.col("element").isNull())
    of = connected(grid_edges(light, cutoff))
    rows = light.join(of, ["mol", "idx"], "left").select("mol", F.coalesce("part", "idx").alias("part"), "element")
    counts = rows.groupBy("mol", "part", "element").agg(F.count("*").alias("n"))
    name = F.concat("element", F.when(F.col("n") > 1, F.col("n").cast("string")).otherwise(F.lit("")))
    named = F.array_sort(F.collect_list(F.struct("element", name.alias("name"))))
    return counts.groupBy("mol", "part").agg(F.sum("n").alias("n_atoms"), F.array_join(F.transform(named, lambda s: s["name"]), "").alias("formula"))
