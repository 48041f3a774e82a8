"""Baselines, stratified evaluation and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chelate.operators import baselines, reports
from chelate.queries.registry import registry
from chelate.queries.samples import PREDICTIONS, SAMPLES, predictions, samples, table

KEYS = ["metal", "cn"]
QUERIES, ORACLES, query = registry()


LIFT = f"""WITH {PREDICTIONS}, g AS (SELECT metal, cn, count(*) AS n, CAST(sum(top1::INT) AS BIGINT) AS m, CAST(sum(base1::INT) AS BIGINT) AS b, CAST(sum(top5::INT) AS BIGINT) AS mk, CAST(sum(base5::INT) AS BIGINT) AS bk
  FROM p GROUP BY metal, cn HAVING count(*) >= 10),
lift AS (SELECT metal, cn, n AS n_samples, m AS model_top1_correct, round_even(m / n * 1e6, 0) / 1e6 AS model_top1_acc, b AS base_top1_correct, round_even(b / n * 1e6, 0) / 1e6 AS base_top1_acc,
  round_even((m / n - b / n) * 1e6, 0) / 1e6 AS delta_top1, round_even((m / n - b / n) * 100 * 1e2, 0) / 1e2 AS delta_top1_pp,
  round_even(mk / n * 1e6, 0) / 1e6 AS model_top5_acc, round_even(bk / n * 1e6, 0) / 1e6 AS base_top5_acc, round_even((mk / n - bk / n) * 1e6, 0) / 1e6 AS delta_top5 FROM g)
"""


@query(f"""WITH {SAMPLES}, g AS (SELECT metal, cn, donor, count(*) AS n, min(id) AS f FROM s GROUP BY metal, cn, donor)
SELECT metal, cn, donor, n, n / sum(n) OVER (PARTITION BY metal, cn) AS share, CAST(row_number() OVER (PARTITION BY metal, cn ORDER BY n DESC, f, donor) AS INTEGER) AS rank FROM g""")
def cond_freq_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.ranked_labels(samples(spark, sf_dir), KEYS, "donor", "id")


@query(f"""WITH {SAMPLES}, g AS (SELECT donor, count(*) AS n, min(id) AS f FROM s GROUP BY donor)
SELECT donor, n, n / sum(n) OVER () AS share, CAST(row_number() OVER (ORDER BY n DESC, f, donor) AS INTEGER) AS rank FROM g""")
def global_freq_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.ranked_labels(samples(spark, sf_dir), [], "donor", "id")


@query(f"""WITH {SAMPLES}, t AS (SELECT * FROM s WHERE id % 3 = 0),
own AS (SELECT metal, cn, list(donor ORDER BY r) AS l FROM (SELECT metal, cn, donor, row_number() OVER (PARTITION BY metal, cn ORDER BY count(*) DESC, min(id), donor) AS r FROM t GROUP BY metal, cn, donor) WHERE r <= 5 GROUP BY metal, cn),
whole AS (SELECT list(donor ORDER BY r) AS l FROM (SELECT donor, row_number() OVER (ORDER BY count(*) DESC, min(id), donor) AS r FROM t GROUP BY donor) WHERE r <= 5)
SELECT s.metal, s.cn, array_to_string(coalesce(own.l, whole.l), ',') AS topk, count(*) AS n, CAST(sum((coalesce(own.l, whole.l)[1] = donor)::INT) AS BIGINT) AS hits
FROM s LEFT JOIN own USING (metal, cn), whole WHERE s.id % 3 <> 0 GROUP BY ALL""")
def cond_freq_fallback_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    p = baselines.conditional_frequency(s.where("id % 3 = 0"), s.where("id % 3 <> 0"), KEYS, "donor", "id")
    return p.groupBy("metal", "cn", F.array_join("topk", ",").alias("topk")).agg(F.count("*").alias("n"), F.count_if(baselines.hit("topk", "donor", 1)).alias("hits"))


@query(f"""WITH {PREDICTIONS} SELECT CASE WHEN grouping(donor) = 0 THEN 'donor' WHEN grouping(cn) = 0 THEN 'cn' WHEN grouping(metal) = 0 THEN 'metal' ELSE 'overall' END AS stratum,
  CASE WHEN grouping(donor) = 0 THEN donor WHEN grouping(cn) = 0 THEN CAST(cn AS VARCHAR) WHEN grouping(metal) = 0 THEN metal ELSE 'all' END AS value,
  count(*) AS n, avg(top1::INT) AS top1_acc, avg(top5::INT) AS top5_acc FROM p GROUP BY GROUPING SETS ((), (donor), (cn), (metal))""")
def stratified_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumns({"top1": F.col("top1").cast("int"), "top5": F.col("top5").cast("int")})
    return reports.stratified_accuracy(p, ["donor", "cn", "metal"])


@query(f"""WITH {SAMPLES}, top AS (SELECT donor FROM s GROUP BY donor ORDER BY count(*) DESC, min(id), donor LIMIT 5), l AS (SELECT list(donor) AS all5 FROM top),
one AS (SELECT donor FROM s GROUP BY donor ORDER BY count(*) DESC, min(id), donor LIMIT 1),
m AS (SELECT metal, cn, first(donor ORDER BY r) AS mode, list(donor) AS l FROM (SELECT metal, cn, donor, row_number() OVER (PARTITION BY metal, cn ORDER BY count(*) DESC, min(id), donor) AS r FROM s GROUP BY metal, cn, donor) WHERE r <= 5 GROUP BY metal, cn)
SELECT 'global' AS method, count(*) AS n, avg((donor = one.donor_)::INT) AS top1_acc, avg(list_contains(all5, donor)::INT) AS top5_acc FROM s, (SELECT donor AS donor_ FROM one) one, l
UNION ALL SELECT 'conditional', count(*), avg((donor = mode)::INT), avg(list_contains(l, donor)::INT) FROM s JOIN m USING (metal, cn)""")
def leaderboard_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    whole = s.join(F.broadcast(baselines.global_frequency(s, "donor", "id")), how="left")
    return baselines.leaderboard({"global": whole, "conditional": baselines.conditional_frequency(s, s, KEYS, "donor", "id")}, "donor")


@query(LIFT + "SELECT * FROM lift")
def lift_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.lift_by_group(predictions(spark, sf_dir), KEYS, "top1", "base1", "top5", "base5")


@query(LIFT + "SELECT count(*) AS total_groups, count_if(delta_top1_pp > 0)::BIGINT AS model_wins, count_if(delta_top1_pp < 0)::BIGINT AS base_wins, count_if(delta_top1_pp = 0)::BIGINT AS ties, round(avg(delta_top1_pp), 6) AS mean_delta_pp, median(delta_top1_pp) AS median_delta_pp, round(stddev_samp(delta_top1_pp), 6) AS std_delta_pp FROM lift")
def lift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.lift_summary(lift_by_group(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_delta_pp", "std_delta_pp")})


@query(LIFT + """, bins AS (SELECT CAST(unnest(range(40)) AS INTEGER) AS bin), h AS (SELECT CAST(CASE WHEN delta_top1_pp = 100 THEN 39 ELSE floor((delta_top1_pp + 100) / 5) END AS INTEGER) AS bin, count(*) AS n FROM lift GROUP BY 1)
SELECT bin * 5.0::DOUBLE - 100 AS bin_left, bin * 5.0::DOUBLE - 100 + 5 AS bin_right, bin * 5.0::DOUBLE - 100 + 2.5::DOUBLE AS bin_center, coalesce(n, 0) AS count, bin * 5.0 - 97.5 > 0 AS is_positive FROM bins LEFT JOIN h USING (bin)""")
def lift_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(lift_by_group(spark, sf_dir), "delta_top1_pp", -100.0, 100.0, 40)


@query(LIFT + "SELECT * FROM lift ORDER BY delta_top1 DESC, metal, cn LIMIT 20")
def lift_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_gains(lift_by_group(spark, sf_dir), KEYS)


@query(f"WITH {PREDICTIONS} SELECT id, line, part, supp, metal, cn, donor, mode, conf FROM p WHERE top1 AND NOT base1 ORDER BY conf DESC, id, line, part, supp, qty, price LIMIT 30")
def correction_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.corrections(predictions(spark, sf_dir), "top1", "base1", "conf", ["id", "line", "part", "supp", "qty", "price"])
    return rows.select("id", "line", "part", "supp", "metal", "cn", "donor", "mode", "conf")


@query(f"""WITH {PREDICTIONS}, x AS (SELECT * EXCLUDE (status), CASE WHEN top1 THEN 'success' WHEN top5 THEN 'partial' ELSE 'failure' END AS status FROM p),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY status ORDER BY CASE WHEN status = 'success' THEN -conf ELSE 0 END, id, line, part, supp, qty, price) AS INTEGER) AS card FROM x)
SELECT status, card, id, line, part, metal, cn, donor, conf FROM y WHERE card <= 10""")
def case_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.case_cards(predictions(spark, sf_dir), 30, "top1", "top5", "conf", ["id", "line", "part", "supp", "qty", "price"])
    return rows.select("status", "card", "id", "line", "part", "metal", "cn", "donor", "conf")


THRESHOLDS = sorted({round(0.05 * k, 2) for k in range(1, 20)} | {0.85, 0.9, 0.95, 0.99})


@query(f"""WITH e AS (SELECT value / 100 AS conf, user_id % 3 <> 0 AS ok FROM events WHERE value IS NOT NULL), t AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in THRESHOLDS)}]) AS threshold), n AS (SELECT count(*) AS n FROM e)
SELECT threshold, count(conf) AS n_samples, CAST(coalesce(sum(ok::INT), 0) AS BIGINT) AS n_correct, count(conf) / any_value(n.n) AS coverage, sum(ok::INT) / nullif(count(conf), 0) AS accuracy
FROM t LEFT JOIN e ON conf >= threshold, n GROUP BY threshold""")
def coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("value") / 100).alias("conf"), (F.col("user_id") % 3 != 0).alias("ok"))
    return reports.coverage_curve(e, "conf", "ok", THRESHOLDS)


@query("SELECT event_id, value FROM events ORDER BY abs(value - 50.0), value, event_id LIMIT 1")
def nearest_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.nearest(table(spark, sf_dir, "events").select("event_id", "value"), "value", 50.0, ["event_id"])


@query(f"WITH {PREDICTIONS} SELECT donor, count(*) AS n_samples, avg(top1::INT) AS model_top1_acc, avg(base1::INT) AS base_top1_acc, avg(top1::INT) - avg(base1::INT) AS delta_top1, avg(top1::INT) * 15 AS x_random FROM p GROUP BY donor HAVING count(*) >= 10")
def label_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.label_lift(predictions(spark, sf_dir).withColumns({c: F.col(c).cast("int") for c in ("top1", "base1")}), "donor", "top1", "base1", 15)


@query(f"WITH {PREDICTIONS} SELECT coalesce(CAST(cn AS VARCHAR), 'overall') AS cn, count(*) AS n_samples, CAST(sum(top1::INT) AS BIGINT) AS top1_correct, avg(top1::INT) AS top1_acc, CAST(sum(top5::INT) AS BIGINT) AS top5_correct, avg(top5::INT) AS top5_acc FROM p GROUP BY ROLLUP (cn) HAVING count(*) >= 10 OR grouping(cn) = 1")
def rollup_cn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_size_and_overall(predictions(spark, sf_dir), "cn", "top1", "top5")


@query(f"WITH {SAMPLES} SELECT metal, " + ", ".join(f"avg(price) FILTER (cn = {k}) AS cn_{k}" for k in range(2, 9)) + " FROM s GROUP BY metal")
def pivot_metal_cn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pivot_mean(samples(spark, sf_dir), "metal", "cn", list(range(2, 9)), "price")


@query("SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY event_type")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.shares(table(spark, sf_dir, "events"), "event_type")


FUNNEL = {"long enough": "n_chars >= 200", "english": "lang = 'en'", "not too long": "n_chars <= 5000", "capital first": "text RLIKE '^[A-Z]'"}


@query("""WITH x AS (SELECT n_chars >= 200 AS a, lang = 'en' AS b, n_chars <= 5000 AS c, regexp_matches(text, '^[A-Z]') AS d FROM documents),
n AS (SELECT count(*) AS n0, count_if(a) AS n1, count_if(a AND b) AS n2, count_if(a AND b AND c) AS n3, count_if(a AND b AND c AND d) AS n4 FROM x)
SELECT t.step::INTEGER AS step, t.name, t.remaining::BIGINT AS remaining, t.remaining * 100.0::DOUBLE / nullif(n0, 0) AS pct FROM n,
LATERAL (VALUES (0, 'start', n0), (1, 'long enough', n1), (2, 'english', n2), (3, 'not too long', n3), (4, 'capital first', n4)) AS t(step, name, remaining)""")
def filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.funnel(table(spark, sf_dir, "documents"), {k: F.expr(v) for k, v in FUNNEL.items()})


@query("""WITH x AS (SELECT doc_id, lang, percent_rank() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS p FROM documents)
SELECT doc_id, lang, CASE WHEN p < 0.8::DOUBLE THEN 'train' WHEN p < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split FROM x""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return reports.stratified_split(docs, ["lang"], "doc_id", {"train": 0.8, "val": 0.1, "test": 0.1})


@query("SELECT count(*) AS total, count_if(n_chars >= 200)::BIGINT AS n_valid, count_if(n_chars >= 200) / nullif(count(*), 0) AS ratio FROM documents")
def success_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.success_summary(table(spark, sf_dir, "documents"), F.col("n_chars") >= 200)


@query(f"""WITH {SAMPLES}, x AS (SELECT id, line, part, supp, qty, price, donor, list_transform(list_sort(list_transform(['A', 'N', 'R', 'O', 'F'], lambda c: md5('42:' || part || ':' || c) || c)), lambda h: h[33:]) AS topk FROM s)
SELECT count(*) AS n, avg((topk[1] = donor)::INT) AS top1_acc, avg(list_contains(topk, donor)::INT) AS top5_acc FROM x""")
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.accuracy(baselines.random_ranking(samples(spark, sf_dir), "part", ["A", "N", "R", "O", "F"]), "donor")


KNN = """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 10 = 0), t AS (SELECT * FROM embeddings WHERE vec_id % 10 <> 0),
d AS (SELECT q.vec_id AS vec_id, t.label AS label, t.vec_id AS tid, (""" + " + ".join(f"pow(q.embedding[{i}]::DOUBLE - t.embedding[{i}]::DOUBLE, 2)" for i in range(1, 65)) + """) AS d FROM q, t),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, tid) AS r FROM d), v AS (SELECT vec_id, label, count(*) AS votes FROM n WHERE r <= 10 GROUP BY vec_id, label)
SELECT vec_id, label, votes, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, label) AS INTEGER) AS rank FROM v"""


@query(KNN)
def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of the ten nearest on all components, given as columns."""
    e = table(spark, sf_dir, "embeddings")
    return baselines.knn_votes(e.where("vec_id % 10 <> 0"), e.where("vec_id % 10 = 0"), [F.col("embedding")[i].cast("double") for i in range(64)], "vec_id", "label")


@query(KNN)
def knn_vote_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the components as one array."""
    e = table(spark, sf_dir, "embeddings")
    return baselines.knn_votes(e.where("vec_id % 10 <> 0"), e.where("vec_id % 10 = 0"), F.col("embedding"), "vec_id", "label")
