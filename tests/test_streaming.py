from pyspark.sql import functions as F

from chelate import schema
from chelate.functions.tokens import SPECIAL
from chelate.operators.tokens import grow_vocabulary
from chelate.plans.encode import canonical_strings
from chelate.streaming.conversion import convert_stream, molecule_stream, success_by_window
from chelate.streaming.vocabulary import grow_stream


def test_stream_equals_table(spark, tmp_path):
    atoms = [(0, "Fe", 0.0, 0.0, 0.0), (1, "N", 0.0, 0.0, 2.0), (2, "O", 0.0, 0.1, -2.0)]
    rows = [(f"m{i}", i, atoms[: 3 - i % 2 * 2], None, None) for i in range(6)]
    df = spark.createDataFrame(rows, schema.MOLECULE)
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    df.where("seq < 4").write.json(source)
    convert_stream(molecule_stream(spark, source), out, at).awaitTermination()
    df.where("seq >= 4").write.mode("append").json(source)
    convert_stream(molecule_stream(spark, source), out, at).awaitTermination()
    want = {(r.source_id, r.canonical, r.valid) for r in canonical_strings(df).collect()}
    got = spark.read.json(out).collect()
    assert len(got) == 6 and {(r.source_id, r.canonical, r.valid) for r in got} == want


def test_windows(spark):
    df = spark.range(10).select(F.timestamp_seconds(F.col("id") * 600).alias("t"), (F.col("id") % 2 == 0).alias("valid"))
    assert sorted((r.total, r.n_valid) for r in success_by_window(df, "t").collect()) == [(4, 2), (6, 3)]


def test_vocabulary_over_restarts(spark, tmp_path):
    """Three restarts: the stream's ids are those of the whole table."""
    words = [["a", "b", "a"], ["c", "[MASK]", "b"], ["d"], [], ["b", "e", None, "a"], ["f", "g"], ["a", "h", "c", "i"], ["i", "j"]]
    df = spark.createDataFrame(list(enumerate(words)), "seq long, tokens array<string>")
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for low, high in ((0, 3), (3, 5), (5, 7), (7, 9)):
        df.where(f"seq >= {low} AND seq < {high}").write.mode("append").json(source)
        stream = spark.readStream.schema(df.schema).json(source)
        assert grow_stream(stream, "seq", out, at).awaitTermination(100)
    got = {r.token: r.id for r in spark.read.schema("token string, id int").json(out).collect()}
    whole = grow_vocabulary(df.withColumn("tokens", F.expr("filter(tokens, t -> t IS NOT NULL)")), "seq").collect()
    assert got == {r.token: r.id for r in whole if r.token not in SPECIAL} and len(got) == 10


def test_vocabulary_is_bounded(spark, tmp_path):
    df = spark.createDataFrame([(0, ["a", "b"]), (1, ["c", "a", "d"])], "seq long, tokens array<string>")
    df.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    assert grow_stream(stream, "seq", str(tmp_path / "out"), str(tmp_path / "at"), len(SPECIAL) + 3).awaitTermination(100)
    got = {r.token: r.id for r in spark.read.schema("token string, id int").json(str(tmp_path / "out")).collect()}
    assert got == {t: len(SPECIAL) + i for i, t in enumerate("abc")}
