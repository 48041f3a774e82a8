"""Gathered gazetteers of personal data: no entry is dropped, however few are looked up in place."""

from pyspark.sql import functions as F

from chelate.llm import pii


def documents(spark):
    """Forty domains and forty first names, each in three documents; every other one stands beside a name or address of its own."""
    name = lambda k: "".join(chr(ord("a") + int(d)) for d in f"{k:03d}")
    rows = [f"Dr {name(k).capitalize()} Weber, write to x{k}@{name(k)}.zz or to y{k} at {name(k)} dot zz{' / Dr ' + 'qr'[j % 2].upper() + name(k)[1:] + ' said' if j else ''}" for k in range(40) for j in range(3)]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5, "doc_id")


def test_entries_beyond_the_list_are_joined(spark, monkeypatch):
    docs, out = documents(spark), []
    for first in (1_000, 3, 0):
        monkeypatch.setattr(pii, "GATHERED", first)
        rows = pii.materialise(pii.candidates(docs))
        lists, rest = pii.gathered(rows)
        assert all(len(x) == min(first, len(x)) for x in lists.values())
        words = {("email", w) for w in lists["email"]} | {("name", w) for w in lists["name"]} | {tuple(r) for r in rest.collect()}
        votes = pii.with_listed(rows, rest).select("id", F.expr(f"transform(wider, s -> {pii.votes('s', lists['email'], lists['name'])})").alias("v"))
        spans = pii.personal_data(docs).select("doc_id", F.expr("transform(added, s -> struct(s.kind, s.start, s.end))").alias("s"))
        out.append((words, sorted(map(str, votes.collect())), sorted(map(str, spans.collect()))))
    assert out[0] == out[1] == out[2] and len(out[0][0]) >= 80
    assert any("[0, 1, " in v for v in out[0][1])  # a gathered name speaks for its span


def test_copies_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(pii, "GATHERED", 0)
    docs = documents(spark)
    twice = pii.personal_data(docs.unionByName(docs).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string"))))
    assert twice.count() == 2 * docs.count() + 1 and pii.personal_data(docs.limit(0)).count() == 0
