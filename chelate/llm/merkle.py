"""Merkle manifest of a table: a digest of every row, of every source and of all, with a proof for each row.

Rows stand in blocks of width ** height neighbours of one source. A task walks its block in
postorder: a subtree hands its digest up, and while the walk unwinds, the digests of its siblings are
appended to the proof of each leaf below. The blocks' roots are the nodes of the next walk, until one
node of each source is left; these are the leaves of one more tree. Digests go up first; then each level
is walked again with the proofs of its blocks beside it, so proofs never move through a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chelate.llm.common import LOWER, UPPER, id_text, materialise, positions, table

#: Children of a node; levels that one task walks, so 256 rows of a block.
WIDTH, HEIGHT = 16, 2
#: What a leaf's digest covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<at:int,others:string>>"
PATH_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.string())]))


def encoded(value: Column) -> Column:
    """``-`` of null, else the value's length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    """The lowercase hex SHA-256 of these values, one after the other."""
    return F.sha2(F.concat(*map(encoded, values)), 256)


def digest_of(children: Sequence[bytes]) -> bytes:
    return sha256(b"".join(children)).hexdigest().encode()


def levels(n: int, width: int) -> int:
    """Levels above n nodes until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // width), out + 1
    return out


def traverse(nodes: Sequence[bytes], height: int, width: int, paths: list[list] | None = None, lo: int = 0, hi: int | None = None) -> bytes:
    """The digest of the nodes from lo to hi, height levels up; each one's siblings go to its path while unwinding.

    A step of a path is a node's place among its run and the digests of the others, left to right.
    """
    hi = len(nodes) if hi is None else hi
    if height == 0:
        return nodes[lo]
    size = width ** (height - 1)
    starts = range(lo, hi, size)
    children = [traverse(nodes, height - 1, width, paths, a, min(a + size, hi)) for a in starts]
    if paths is not None:
        for i, a in enumerate(starts):
            others = b"".join(children[:i] + children[i + 1 :]).decode()
            for leaf in range(a, min(a + size, hi)):
                paths[leaf].append({"at": i, "others": others})
    return digest_of(children)


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of each block; a partition holds whole blocks, sorted."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["tree"], row["block"]) != (rows[0]["tree"], rows[0]["block"]):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def in_blocks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {size}"))


def dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def block_roots(nodes: DataFrame, width: int, height: int) -> DataFrame:
    """(tree, pos, n, digest) of blocks: the nodes of the next level, n of them in a tree."""
    size = width**height

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches):
            n = rows[0]["n"]
            root = traverse([r["digest"].encode() for r in rows], min(height, levels(n, width)), width)
            yield pa.RecordBatch.from_pylist(
                [{"tree": rows[0]["tree"], "pos": rows[0]["block"], "n": -(-n // size), "digest": root.decode()}],
                pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]),
            )

    blocks = dealt(in_blocks(nodes.select("tree", "pos", "n", "digest"), size))
    return blocks.mapInArrow(work, "tree string, pos long, n long, digest string")


def with_paths(nodes: DataFrame, above: DataFrame, width: int, height: int, upper: Sequence[str]) -> DataFrame:
    """nodes with path and the columns ``upper``, which ``above`` holds for each block as (tree, pos)."""
    size = width**height
    names = [c for c in nodes.columns if c not in ("tree", "pos", "n")]
    own = in_blocks(nodes, size).select("tree", "block", "pos", "n", F.struct(*names).alias("own"))
    own = own.withColumn("above", F.lit(None).cast(above.select(F.struct("path", *upper).alias("s")).schema["s"].dataType))
    # a block's part of the proof comes first in its block
    over = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"), F.lit(None).cast(own.schema["own"].dataType).alias("own"), F.struct("path", *upper).alias("above"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, *rows in runs_of(batches):
            paths: list[list] = [[] for _ in rows]
            traverse([r["own"]["digest"].encode() for r in rows], min(height, levels(rows[0]["n"], width)), width, paths)
            over = first["above"]
            yield pa.RecordBatch.from_pylist(
                [{"tree": r["tree"], "pos": r["pos"], **r["own"], "path": p + over["path"], **{u: over[u] for u in upper}} for r, p in zip(rows, paths, strict=True)],
                out_schema,
            )

    kept = nodes.select("tree", "pos", *names).schema
    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", path {PATH}, " + ", ".join(f"{u} string" for u in upper)
    simple = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    out_schema = pa.schema([(f.name, simple[f.dataType.simpleString()]) for f in kept] + [("path", PATH_TYPE)] + [(u, pa.string()) for u in upper])
    return dealt(own.unionByName(over)).mapInArrow(work, text)


def walk(nodes: DataFrame, width: int, height: int) -> list[DataFrame]:
    """The nodes of all levels of blocks, from the given to those where one node of each tree is left."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(materialise(block_roots(out[-1], width, height)))
    return out


def manifest(docs: DataFrame, width: int = WIDTH, height: int = HEIGHT, keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row: doc_id, source, position, leaf, path, subroot, root and the columns of ``keep``.

    leaf: the digest of FIELDS, as leaf_of() has it. position: the row's place in its source, from 0,
    by doc_id; null ids come first, rows of one id follow by their digests. path: the siblings from the
    leaf over its source's root to the whole root, as fold() takes them. The subroots stand by source,
    null first, then bytewise. Nulls and empty texts have digests of their own; rows repeated take a
    place each. An empty table gives an empty result. Of other columns, those in ``keep`` (strings and
    whole numbers) are handed on under their own names; a name that the result has already is refused.
    Only the number of levels, of sources and of rows in each sorted part reach the driver.
    """
    taken = {"tree", "pos", "n", "block", "own", "above", "digest", "id", *("doc_id", "source", "position", "leaf", "path", "subroot", "root")}
    if bad := [k for k in keep if k.lower() in taken]:
        raise ValueError(f"{bad} would stand twice: rename")
    leaf = leaf_of(*map(F.col, FIELDS))
    # written once: texts are read here only
    rows = materialise(docs.select(F.col("source").cast("string").alias("tree"), F.col("doc_id").alias("id"), leaf.alias("digest"), *keep, F.monotonically_increasing_id().alias("row")))
    placed = positions(rows, F.asc_nulls_first("tree"), F.asc_nulls_first("id"), F.col("digest"), F.col("row")).drop("row")
    trees = materialise(placed.groupBy("tree").agg((F.min("pos") - 1).alias("before"), F.count("*").alias("n")))
    trees = trees.withColumnRenamed("tree", "of")
    trees = F.broadcast(trees) if trees.count() <= 500_000 else trees
    placed = placed.join(trees, F.col("tree").eqNullSafe(F.col("of"))).withColumn("pos", F.col("pos") - 1 - F.col("before"))
    nodes = materialise(placed.select("tree", "pos", "n", "id", "digest", *keep))
    up = walk(nodes, width, height)
    # the sources' roots are the leaves of the last tree
    tops = positions(up[-1].select(F.col("tree").alias("source"), "digest"), F.asc_nulls_first("source"))
    n = tops.count()
    tops = materialise(tops.select(F.lit("").alias("tree"), (F.col("pos") - 1).alias("pos"), F.lit(n).cast("long").alias("n"), "source", "digest"))
    over = walk(tops, width, height)
    above = over[-1].select("tree", "pos", F.expr(f"cast(array() AS {PATH})").alias("path"), F.col("digest").alias("root"))
    for level in reversed(over[:-1]):
        above = materialise(with_paths(level, above, width, height, ["root"]))
    if len(over) == 1:  # one source: its root is the whole one
        above = tops.join(above.select("path", "root"), F.lit(True))
    above = above.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    for level in reversed(up[:-1]):
        above = with_paths(level, above, width, height, ["subroot", "root"])
        above = above if level is nodes else materialise(above)
    if len(up) == 1:  # a lone leaf in each source
        above = nodes.join(above.withColumnRenamed("tree", "of").drop("pos"), F.col("tree").eqNullSafe(F.col("of")))
    return above.select(F.col("id").alias("doc_id"), F.col("tree").alias("source"), F.col("pos").alias("position"), F.col("digest").alias("leaf"), "path", "subroot", "root", *keep)


def fold(leaf: str, path: str = "path") -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.expr(f"aggregate({path}, {leaf}, (d, s) -> sha2(concat(left(s.others, 64 * s.at), d, substring(s.others, 64 * s.at + 1)), 256))")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(id_text(F.col("doc_id")).cast("binary")) % 5 == 0
    fields = [F.translate(F.col("text"), UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS]
    rows = manifest(docs.withColumn("changed", F.when(tampered, leaf_of(*fields))), keep=["changed"])
    rows = rows.withColumn("held", F.coalesce("changed", "leaf")).withColumn("folded_root", fold("held"))
    proof = F.expr("sha2(array_join(transform(path, s -> s.others), ''), 256)")
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def sql_leaf(text: str) -> str:
    return " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END" for c, v in [(f, f"CAST({text if f == 'text' else f} AS VARCHAR)") for f in FIELDS])


#: of decimal digits, the crc32 by its polynomial, bit by bit
CRC = "xor(list_reduce(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce(range(8), lambda v, i: xor(v >> 1, (v & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295)"
SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
    SELECT doc_id, source, sha256({sql_leaf('text')}) AS leaf, sha256({sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")}) AS lowered, {CRC} % 5 = 0 AS tampered FROM documents),
p AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
t(level, source, pos, n, digest) AS (
    SELECT 0, source, pos, n, leaf FROM p
    UNION ALL SELECT level + 1, source, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY level, source, pos // 16, n),
top AS MATERIALIZED (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(level, pos, n, digest) AS (
    SELECT 0, pos, n, digest FROM top
    UNION ALL SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 16, n),
ts AS (SELECT level, source, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' || coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS step
       FROM t WHERE n > 1 WINDOW w AS (PARTITION BY level, source, pos // 16 ORDER BY pos)),
us AS (SELECT level, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' || coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS step
       FROM u WHERE n > 1 WINDOW w AS (PARTITION BY level, pos // 16 ORDER BY pos)),
steps AS (
    SELECT p.source, p.pos, ts.level AS k, step FROM p JOIN ts ON ts.source IS NOT DISTINCT FROM p.source AND ts.pos = p.pos // (16 ** ts.level)::BIGINT
    UNION ALL SELECT p.source, p.pos, 100 + us.level, step FROM p JOIN top ON top.source IS NOT DISTINCT FROM p.source JOIN us ON us.pos = top.pos // (16 ** us.level)::BIGINT),
paths AS (SELECT source, pos, list(step ORDER BY k) AS path FROM steps GROUP BY source, pos),
all_of AS (
    SELECT p.doc_id, p.leaf, top.digest AS subroot, (SELECT digest FROM u WHERE n = 1) AS root, coalesce(path, []) AS path, CASE WHEN tampered THEN lowered ELSE leaf END AS held
    FROM p JOIN top ON top.source IS NOT DISTINCT FROM p.source LEFT JOIN paths ON paths.source IS NOT DISTINCT FROM p.source AND paths.pos = p.pos),
folded AS (
    SELECT *, list_reduce(path, lambda x, s: sha256(split_part(s, '|', 1) || x || split_part(s, '|', 2)), held) AS folded_root FROM all_of)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

QUERIES = {"op12_merkle": op12_merkle}
ORACLES = {"op12_merkle": SQL}
