"""XYZ files with any number of molecules each, read by splits; compressed files are one split each."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chelate.schema import ATOM
from chelate.sources.splits import Part, begins, effects, lines, parts

#: How a comment names its molecule.
IDS = (r"(?U)CSD_code\s*=\s*(\w+)", r"(?U)CSD-(\w+)")
#: A line that holds a count, and the lines that its molecule takes: the count, a comment, the atoms.
COUNT = re.compile(r"\s*\+?[0-9]+\s*", re.ASCII)
SIZE = rf"IF(value RLIKE r'^{COUNT.pattern}\z', try_cast(value AS int), null) + 2L"
RAW = "array<struct<line:int,element:string,x:double,y:double,z:double>>"
#: Molecules of a batch that a task hands on.
BATCH = 1_000


def number(text: str, kind: type):
    try:
        return kind(text)
    except ValueError:
        return None


def size_of(text: str) -> int | None:
    return n + 2 if COUNT.fullmatch(text) and (n := int(text)) < 2**31 else None


def batch_of(rows: list[Part]) -> pa.RecordBatch:
    """path, seq, comment (null where it stands in another split) and atoms with their line in the molecule; unreadable rows are left out."""
    line, element, xyz, ends = [], [], ([], [], []), [0]
    for part in rows:
        for j, text in enumerate(part.lines, part.first):
            fields = text.split() if j > 1 else ()
            place = [number(f, float) for f in fields[1:4]]
            if len(place) == 3 and None not in place:
                line.append(j)
                element.append(fields[0])
                for to, value in zip(xyz, place, strict=True):
                    to.append(value)
        ends.append(len(line))
    atoms = pa.StructArray.from_arrays([pa.array(line, pa.int32()), pa.array(element, pa.string()), *[pa.array(v, pa.float64()) for v in xyz]], ["line", "element", "x", "y", "z"])
    comment = [p.lines[1 - p.first] if 0 <= 1 - p.first < len(p.lines) else None for p in rows]
    return pa.RecordBatch.from_arrays(
        [pa.array([p.path for p in rows]), pa.array([p.head for p in rows], pa.int64()), pa.array(comment, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), atoms)],
        ["path", "seq", "comment", "raw"],
    )


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """path, mol_id, seq, atoms: a count line, a comment with the id, then the atoms; other lines between molecules are skipped.

    A large file is read by its splits, wherever these cut a molecule. seq is the count line's
    number in its file; without an id a molecule is named by it. Rows that are short or whose
    coordinates aren't numbers are dropped, and so are molecules without atoms; the index of an atom
    is its place among the kept ones. A file that ends early gives the atoms that it has.
    """
    text = lines(spark, path)
    known, open_ = begins(effects(text, SIZE))
    at = spark.sparkContext.broadcast(known)  # a row of some 100 bytes for each split

    def read(whole: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[Part] = []
            for part in parts(batches, at.value, size_of):
                if part.whole == whole:
                    rows.append(part)
                if len(rows) == BATCH:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

        return text.mapInArrow(work, f"path string, seq long, comment string, raw {RAW}")

    rows = read(True)
    if open_:  # the ends of splits alone leave molecules open, so few are put together
        rows = rows.unionByName(read(False).groupBy("path", "seq").agg(F.max("comment").alias("comment"), F.array_sort(F.flatten(F.collect_list("raw"))).alias("raw")))
    rows = rows.where(F.size("raw") > 0)
    name = F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce("comment", F.lit("")), p, 1), F.lit("")) for p in IDS], F.concat(F.lit("MOL_"), F.col("seq").cast("string")))
    atoms = F.expr("transform(raw, (a, i) -> named_struct('idx', i, 'element', a.element, 'x', a.x, 'y', a.y, 'z', a.z))").cast(f"array<{ATOM}>")
    return rows.select("path", name.alias("mol_id"), "seq", atoms.alias("atoms"))


def last_of_each(df: DataFrame) -> DataFrame:
    """One row for each mol_id: the last by file and place; path and seq are those of the id's first row."""
    same = Window.partitionBy("mol_id")
    first = F.min(F.struct("path", "seq")).over(same)
    rank = F.row_number().over(same.orderBy(F.desc("path"), F.desc("seq")))
    return df.withColumns({"_r": rank, "_first": first}).where("_r = 1").withColumns({"path": F.col("_first.path"), "seq": F.col("_first.seq")}).drop("_r", "_first")
