"""Scorers, evaluation sets, data sets and donor checks over the driver's tables, each with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chelate.functions.strings import token_checks
from chelate.operators import datasets, reports, scoring, tool_reports
from chelate.plans import donors
from chelate.queries.registry import registry
from chelate.queries.samples import PREDICTIONS, SAMPLES, predictions, samples, table
from chelate.sources.tables import json_records

KEYS = ["metal", "cn"]
QUERIES, ORACLES, query = registry()

#: Each key's donors by share, best first.
RANKED = f"""{SAMPLES}, g AS (SELECT metal, cn, donor, count(*) AS n, min(id) AS f FROM s GROUP BY metal, cn, donor),
r AS (SELECT metal, cn, donor, n / sum(n) OVER (PARTITION BY metal, cn) AS prob, row_number() OVER (PARTITION BY metal, cn ORDER BY n DESC, f, donor) AS rank FROM g)"""


def scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.frequency_scorer(samples(spark, sf_dir), KEYS, "donor", "id")


@query(f"""WITH {RANKED}, m AS (SELECT DISTINCT id, metal, cn FROM s), p AS (SELECT id, metal, cn, unnest([0, 2, 99]) AS position FROM m)
SELECT id, CAST(position AS INTEGER) AS position, CAST(rank AS INTEGER) AS rank, donor AS token, prob FROM p JOIN r USING (metal, cn) WHERE rank <= 3 AND position < cn""")
def mask_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best tokens at each masked place; places outside a sample have none."""
    df = samples(spark, sf_dir).select("id", *KEYS).distinct().withColumns({"mask_positions": F.array(*map(F.lit, (0, 2, 99))), "n_tokens": F.col("cn")})
    df = scoring.topk_at_masks(df, scorer(spark, sf_dir), KEYS, 3)
    rows = df.select("id", F.explode(F.arrays_zip("mask_positions", "topk")).alias("p")).select("id", F.col("p.mask_positions").alias("position"), F.posexplode("p.topk").alias("at", "e"))
    return rows.select("id", "position", (F.col("at") + 1).alias("rank"), "e.token", "e.prob")


@query(f"""WITH {RANKED}, k AS (SELECT DISTINCT metal, cn FROM r), c AS (SELECT unnest(['A', 'R', 'X']) AS token)
SELECT k.metal, k.cn, c.token, coalesce(r.prob, 0) AS prob FROM k CROSS JOIN c LEFT JOIN r ON r.metal = k.metal AND r.cn = k.cn AND r.donor = c.token""")
def candidate_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorer(spark, sf_dir).select(*KEYS, F.explode(scoring.candidate_probs("topk", ["A", "R", "X"])).alias("token", "prob"))


@query(f"""WITH {RANKED} SELECT metal, cn, donor AS token, round(prob / sum(prob) OVER (PARTITION BY metal, cn), 9) AS prob FROM r WHERE donor IN ('A', 'R')""")
def allowed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = scorer(spark, sf_dir).select(*KEYS, F.explode(scoring.allowed_only(F.col("topk"), ["A", "R"])).alias("e"))
    return kept.select(*KEYS, "e.token", F.round("e.prob", 9).alias("prob"))


@query(f"""WITH {RANKED}, h AS (SELECT s.cn, coalesce(a.donor = s.donor, false) AS top1, b.donor IS NOT NULL AS top5 FROM s
  LEFT JOIN r a ON a.metal = s.metal AND a.cn = s.cn AND a.rank = 1 LEFT JOIN r b ON b.metal = s.metal AND b.cn = s.cn AND b.donor = s.donor AND b.rank <= 5)
SELECT CASE WHEN grouping(cn) = 1 THEN 'overall' ELSE CAST(cn AS VARCHAR) END AS cn, count(*) AS total_samples, count_if(top1)::BIGINT AS top1_correct, count_if(top1) / count(*) AS top1_acc,
  count_if(top5)::BIGINT AS top5_correct, count_if(top5) / count(*) AS top5_acc, round_even(count_if(top1) / count(*) * 100 * 1e2, 0) / 1e2 AS top1_acc_pct, round_even(count_if(top5) / count(*) * 100 * 1e2, 0) / 1e2 AS top5_acc_pct
FROM h GROUP BY GROUPING SETS ((), (cn))""")
def recovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of an order is a masked place; overall and by cn."""
    targets = samples(spark, sf_dir).groupBy("id", *KEYS).agg(F.collect_list("donor").alias("target_tokens"))  # an order has seven lines at most
    targets = targets.withColumns({"mask_positions": F.sequence(F.lit(0), F.col("cn") - 1), "n_tokens": F.col("cn")})
    return scoring.recovery(scoring.topk_at_masks(targets, scorer(spark, sf_dir), KEYS, 5))


@query(f"""WITH {SAMPLES}, t AS (SELECT CASE donor WHEN 'A' THEN 'V_001' WHEN 'N' THEN '{{trans:' ELSE CASE status WHEN 'F' THEN ';ox=+2' ELSE ':N:1' END END AS label, CAST(qty AS INTEGER) % 3 <> 0 AS ok FROM s)
SELECT CASE label WHEN 'V_001' THEN 'Shape' WHEN '{{trans:' THEN 'Constraint' WHEN ';ox=+2' THEN 'Metal' ELSE 'Ligand' END AS field, count(*) AS total, count_if(ok)::BIGINT AS correct, count_if(ok) / count(*) AS accuracy FROM t GROUP BY 1""")
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("donor") == "A", "V_001").when(F.col("donor") == "N", "{trans:").when(F.col("status") == "F", ";ox=+2").otherwise(":N:1")
    df = samples(spark, sf_dir).select(label.alias("label"), "qty").withColumn("predicted", F.when(F.col("qty").cast("int") % 3 != 0, F.col("label")).otherwise("other"))
    return scoring.field_accuracy(df)


@query(f"""WITH {SAMPLES}, g AS (SELECT cn, count(*) AS n_samples FROM s GROUP BY cn) SELECT cn, n_samples FROM g WHERE cn BETWEEN 4 AND 8 AND n_samples >= 100""")
def report_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.in_report(samples(spark, sf_dir).groupBy("cn").agg(F.count("*").alias("n_samples")))


@query(f"""WITH {PREDICTIONS} SELECT cn, count(*) AS total, avg(top1::INT) AS accuracy, round_even(avg(top1::INT) * 100 * 1e2, 0) / 1e2 AS accuracy_pct FROM p GROUP BY cn""")
def percent_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predictions(spark, sf_dir).groupBy("cn").agg(F.count("*").alias("n"), F.avg(F.col("top1").cast("int")).alias("accuracy"))
    return scoring.with_percent(df, ["accuracy", "missing"], {"n": "total"})


@query(f"""WITH {SAMPLES}, m AS (SELECT CASE WHEN id % 5 = 0 THEN '' WHEN id % 7 = 0 THEN NULL ELSE metal END AS metal, donor FROM s)
SELECT metal, donor, count(*) AS n FROM m WHERE metal IS NOT NULL AND metal <> '' GROUP BY metal, donor""")
def present_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    metal = F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 7 != 0, F.col("metal"))
    return samples(spark, sf_dir).withColumn("metal", metal).where(reports.present("metal") & reports.present("donor")).groupBy("metal", "donor").agg(F.count("*").alias("n"))


EVAL = """t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'mask_donor' ELSE 'mask_structure' END AS task, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS id, o_orderpriority AS token, o_custkey % 5 AS place FROM orders)"""


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "mask_donor").otherwise("mask_structure").alias("task"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey").cast("string")).alias("id"),
        F.array(F.lit("<"), "o_orderpriority", F.lit(">")).alias("masked_tokens"),
        F.when(F.col("o_custkey") % 5 > 0, (F.col("o_custkey") % 5).cast("int")).alias("mask_pos"),
        F.col("o_orderpriority").alias("target"),
    )


def eval_sql(task: str, name: str) -> str:
    return f"""WITH {EVAL}, n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM t WHERE task = '{task}')
SELECT coalesce(id, '{name}_' || i) AS id, '<' || token || '>' AS masked_text, CAST(place AS INTEGER) AS position, token AS target FROM n WHERE i < 500"""


@query(eval_sql("mask_donor", "donor"))
def donor_eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 samples of the task, as the sets are built."""
    return datasets.evaluation_set(eval_rows(spark, sf_dir), "mask_donor", "target", "o_orderkey", 500).select("id", "masked_text", F.col("mask_positions")[0].alias("position"), "target")


@query(eval_sql("mask_structure", "struct"))
def structure_eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.evaluation_set(eval_rows(spark, sf_dir), "mask_structure", "target", "o_orderkey", 500).select("id", "masked_text", F.col("mask_positions")[0].alias("position"), "target")


@query(f"WITH {EVAL} SELECT task, count(*) AS n FROM t WHERE task = 'mask_donor' GROUP BY task")
def task_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.only_task(eval_rows(spark, sf_dir), "mask_donor").groupBy("task").agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(text) AS length FROM documents WHERE length(text) < 1024")
def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.short_texts(table(spark, sf_dir, "documents"), "text", 512).select("doc_id", F.length("text").cast("long").alias("length"))


@query("SELECT o_orderkey AS mol_id, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100")
def first_after_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit counts what passed the filter before it."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("mol_id"), F.col("o_orderpriority").alias("priority"))
    return datasets.first_rows(rows, "mol_id", 100)


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS n_keys FROM lineitem")
def key_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.key_summary(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("""WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders WHERE o_orderstatus = 'O'),
b AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders WHERE o_orderstatus = 'F')
SELECT id, 0 AS origin FROM a WHERE r <= least(10000, floor(0.8 * n)) UNION ALL SELECT id, 1 FROM b WHERE r <= least(5000, floor(0.2 * n))""")
def dataset_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias("id")) for s in "OF")
    return datasets.mixed(one, two, "id")


@query("SELECT o_orderkey AS id, (row_number() OVER (ORDER BY md5('0:' || o_orderkey), o_orderkey) - 1) // 64 AS batch FROM orders")
def shuffled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.batches(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", 64)


@query("""WITH u AS (SELECT doc_id, CAST(('0x' || substr(md5('3:' || doc_id || ':block'), 1, 8)) AS BIGINT) / 4294967296 AS block, CAST(('0x' || substr(md5('3:' || doc_id || ':span'), 1, 8)) AS BIGINT) / 4294967296 AS span FROM documents)
SELECT doc_id, CASE WHEN block < 0.3 THEN 'block' WHEN span < 0.2 THEN 'span' ELSE 'token' END AS kind FROM u""")
def mask_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", datasets.mask_kind("doc_id", 3).alias("kind"))


@query("""WITH e AS (SELECT vec_id, [embedding[1:16], embedding[17:32], embedding[33:48], embedding[49:64]] AS v FROM embeddings),
x AS (SELECT vec_id, list_filter([CASE WHEN (vec_id + 0) % 3 > 0 THEN v[1] END, CASE WHEN (vec_id + 1) % 3 > 0 THEN v[2] END, CASE WHEN (vec_id + 2) % 3 > 0 THEN v[3] END, CASE WHEN (vec_id + 3) % 3 > 0 THEN v[4] END], lambda t: t IS NOT NULL) AS k FROM e)
SELECT vec_id, round(list_sum(list_transform(k, lambda t: t[1]::DOUBLE)) / len(k), 6) AS first, round(list_sum(list_transform(k, lambda t: t[16]::DOUBLE)) / len(k), 6) AS last FROM x""")
def pooled_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector's quarters as four tokens, of which the mask leaves two or three."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.array(*[F.slice("embedding", 1 + 16 * i, 16) for i in range(4)]).alias("v"), F.array(*[((F.col("vec_id") + i) % 3 > 0).cast("int") for i in range(4)]).alias("m"))
    df = df.withColumn("p", datasets.pooled_mean(F.col("v"), F.col("m")))
    return df.select("vec_id", F.round(F.element_at("p", 1), 6).alias("first"), F.round(F.element_at("p", 16), 6).alias("last"))


@query("""SELECT CAST(to_json({'id': o_orderkey, 'status': o_orderstatus, 'priority': o_orderpriority}) AS VARCHAR) AS json FROM orders""")
def records_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_records(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")))


@query("""WITH b AS (SELECT l_orderkey AS mol_id, round_even(l_discount * 100, 0) / 20 AS bo FROM lineitem)
SELECT mol_id, round(CASE WHEN count(*) FILTER (bo > 0.01) = 0 THEN 0.3 ELSE greatest(0.1, least(0.5, quantile_cont(bo, 0.25) FILTER (bo > 0.01))) END, 6) AS threshold FROM b GROUP BY mol_id""")
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mol_id")).agg(F.collect_list(F.rint(F.col("l_discount") * 100) / 20).alias("bo"))
    return df.select("mol_id", F.round(F.expr(donors.adaptive_threshold("bo")), 6).alias("threshold"))


@query("""WITH b AS (SELECT l_orderkey AS mol_id, l_orderkey % 4 > 0 AS known, round_even(l_discount * 100, 0) / 20 AS bo, l_quantity / 10 AS distance FROM lineitem),
t AS (SELECT mol_id, CASE WHEN NOT first(known) OR count(*) FILTER (bo > 0.01) = 0 THEN 0.3 ELSE greatest(0.1, least(0.5, quantile_cont(bo, 0.25) FILTER (bo > 0.01))) END AS threshold FROM b GROUP BY mol_id),
d AS (SELECT mol_id, known, CASE WHEN known AND bo > threshold THEN bo WHEN NOT known AND distance < 2.8 THEN 1 / distance END AS o FROM b JOIN t USING (mol_id))
SELECT mol_id, count(o) AS n_donors, round(coalesce(sum(o), 0), 6) AS total, count(*) FILTER (known AND o < 0.5) AS n_low, count(o) = 0 AS without FROM d GROUP BY mol_id""")
def threshold_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    bo = F.when(F.col("l_orderkey") % 4 > 0, F.rint(F.col("l_discount") * 100) / 20)
    near = F.struct(F.col("l_linenumber").alias("idx"), (F.col("l_quantity") / 10).cast("double").alias("distance"), bo.alias("bo"))
    df = donors.with_donors(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mol_id")).agg(F.collect_list(near).alias("near")))
    return df.select(
        "mol_id",
        F.size("donors").cast("long").alias("n_donors"),
        F.round(F.aggregate("donors", F.lit(0.0), lambda s, d: s + d.bond_order), 6).alias("total"),
        F.size(F.filter("issues", lambda i: i.code == "LOW_BOND_ORDER")).cast("long").alias("n_low"),
        F.exists("issues", lambda i: i.code == "NO_DONORS").alias("without"),
    )


@query("""WITH e AS (SELECT l_orderkey AS mol_id, l_linenumber AS idx, CASE l_returnflag WHEN 'A' THEN 'N' WHEN 'N' THEN 'H' ELSE 'Fe' END AS element FROM lineitem),
m AS (SELECT mol_id, 'H atom at index ' || idx || ' should not be a donor!' AS message FROM e WHERE element = 'H' UNION ALL SELECT mol_id, 'Unusual donor element: ' || element || ' at index ' || idx FROM e WHERE element IN ('H', 'Fe')
  UNION ALL SELECT mol_id, 'Element mismatch: L' || idx || ' has element ' || element FROM e WHERE element <> 'N' UNION ALL SELECT mol_id, 'H cannot be a donor: L' || idx FROM e WHERE element = 'H')
SELECT mol_id, message, count(*) AS n FROM m GROUP BY ALL""")
def donor_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    element = F.when(F.col("l_returnflag") == "A", "N").when(F.col("l_returnflag") == "N", "H").otherwise("Fe")
    site = F.struct(F.col("l_linenumber").alias("idx"), element.alias("element"))
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mol_id")).agg(F.collect_list(site).alias("d"))
    sites = "transform(d, x -> named_struct('name', concat('L', x.idx), 'element', 'N', 'actual', x.element))"
    both = F.concat(F.expr(donors.donor_issues("d")), F.expr(donors.site_issues(f"{sites}")))
    # counted within the order's row: a second grouping would hold every message of a task
    counted = F.expr("transform(array_distinct(m), x -> named_struct('message', x, 'n', bigint(size(filter(m, y -> y = x)))))")
    return df.select("mol_id", both.alias("m")).select("mol_id", F.explode_outer(counted).alias("e")).where("e IS NOT NULL").select("mol_id", "e.message", "e.n")


@query("""SELECT * FROM (SELECT l_orderkey AS mol_id, l_extendedprice AS price, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey) AS INTEGER) AS rank FROM lineitem) WHERE rank <= 3""")
def nearest_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mol_id")).agg(F.array_sort(F.collect_list(F.struct("l_extendedprice", "l_linenumber", "l_partkey"))).alias("near"))
    return df.select("mol_id", F.posexplode(F.expr(donors.nearest_k("near", 3))).alias("at", "e")).select("mol_id", F.col("e.l_extendedprice").alias("price"), (F.col("at") + 1).alias("rank"))


@query("""WITH v AS (SELECT l_orderkey AS mol_id, l_quantity / 5 AS v, l_linenumber AS i, 'S' || l_linenumber AS n FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY v, i, n) AS k FROM v)
SELECT mol_id, '<ShapeBest:' || max(n) FILTER (k = 1) || '|Delta:' || CASE WHEN count(*) < 2 OR min(v) FILTER (k = 2) - min(v) FILTER (k = 1) < 0.5 THEN 0 WHEN min(v) FILTER (k = 2) - min(v) FILTER (k = 1) < 2 THEN 1
  WHEN min(v) FILTER (k = 2) - min(v) FILTER (k = 1) < 5 THEN 2 ELSE 3 END || '>' AS shape FROM r GROUP BY mol_id""")
def shape_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mol_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity") / 5).cast("double").alias("v")))).alias("a"))
    df = df.withColumns({"names": F.transform("a", lambda x: F.concat(F.lit("S"), x.l_linenumber.cast("string"))), "vals": F.transform("a", lambda x: x.v)})
    return df.select("mol_id", F.expr(donors.shape_summary("names", "vals")).alias("shape"))


@query("""WITH p AS (SELECT l_orderkey AS mol_id, round_even(l_discount * 100, 0) AS a, round_even(l_tax * 100, 0) AS b FROM lineitem)
SELECT mol_id, bool_and(abs(a - b) <= 3 + 1e-5 * abs(b)) AS stable FROM p GROUP BY mol_id""")
def noise_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two vectors of a complex agree within a tolerance, here 3 hundredths."""
    pair = F.struct(F.rint(F.col("l_discount") * 100).alias("a"), F.rint(F.col("l_tax") * 100).alias("b"))
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mol_id")).agg(F.collect_list(pair).alias("p"))
    return df.select("mol_id", donors.near_equal(F.transform("p", lambda x: x.a), F.transform("p", lambda x: x.b), 3.0).alias("stable"))


@query("SELECT doc_id, true AS metal_ok, true AS shape_ok, true AS stereo_ok FROM documents")
def token_level_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[F.expr(c).alias(f"{k}_ok") for k, c in token_checks("text").items()])


@query(f"""WITH {SAMPLES}, t AS (SELECT id, line, CASE donor WHEN 'A' THEN '(' WHEN 'N' THEN '[UNK]' ELSE 'N' END AS token FROM s) SELECT token, count(*) AS n FROM t WHERE token <> 'N' GROUP BY token""")
def repair_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of token stands at a place that repair may change."""
    token = F.when(F.col("donor") == "A", "(").when(F.col("donor") == "N", "[UNK]").otherwise("N")
    df = samples(spark, sf_dir).groupBy("id").agg(F.collect_list(token).alias("tokens"))
    return df.select(F.explode(F.expr(f"transform({scoring.repair_places('tokens')}, i -> tokens[i])")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a tool's records: what a model said of the donor, of which some metals are missing."""
    df = predictions(spark, sf_dir).withColumn("seq", F.col("id") * 10 + F.col("line"))
    return df.select("seq", F.when(F.col("id") % 11 != 0, F.col("metal")).alias("metal"), "cn", F.col("donor").alias("label"), "top1", "top5", "status")


RECORDS = f"""{PREDICTIONS}, q AS (SELECT id * 10 + line AS seq, CASE WHEN id % 11 <> 0 THEN metal END AS metal, cn, donor AS label, top1, top5, status FROM p)"""
ROUND4 = "round_even({} * 1e4, 0) / 1e4"


@query(f"""WITH {RECORDS}, g AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, min(seq), label) AS r FROM q GROUP BY label),
c AS (SELECT metal, label, row_number() OVER (PARTITION BY metal ORDER BY count(*) DESC, min(seq), label) AS r FROM q WHERE metal IS NOT NULL GROUP BY metal, label),
h AS (SELECT top1, top5, g.r AS gr, c.r AS cr FROM q LEFT JOIN g USING (label) LEFT JOIN c ON c.metal = q.metal AND c.label = q.label),
a AS (SELECT count(*) AS n, [avg(top1::INT), 1 / 15, avg((gr = 1)::INT), avg(coalesce(cr = 1, false)::INT)] AS one, [avg(top5::INT), 5 / 15, avg((gr <= 5)::INT), avg(coalesce(cr <= 5, false)::INT)] AS five FROM h),
w AS (SELECT unnest(['model', 'random', 'global_frequency', 'conditional_frequency']) AS method, unnest([1, 2, 3, 4]) AS k)
SELECT method, {ROUND4.format('one[k]')} AS top1_acc, {ROUND4.format('five[k]')} AS top5_acc, n FROM a, w""")
def four_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaderboard of the donor report."""
    return tool_reports.leaderboard(records(spark, sf_dir), "seq", len(tool_reports.CANDIDATES))


WRONG = """CASE WHEN status = 'F' AND cn = 1 THEN NULL WHEN status = 'F' THEN 'L9' ELSE ')' END"""


@query(f"""WITH {RECORDS}, t AS (SELECT top1, {WRONG} AS first, CASE label WHEN 'A' THEN 'L' WHEN 'N' THEN '(' ELSE '|' END AS label FROM q),
e AS (SELECT CASE WHEN first IS NULL THEN 'empty_prediction' WHEN label = 'L' AND first LIKE 'L%' THEN 'ligand_index_confusion' WHEN label = '(' AND first = ')' THEN 'bracket_confusion' WHEN label = '|' THEN 'delimiter_confusion' ELSE 'other' END AS error_type FROM t WHERE NOT top1)
SELECT error_type, count(*) AS count, {ROUND4.format('count(*) / (SELECT count(*) FROM t)')} AS rate, {ROUND4.format('count(*) / sum(count(*)) OVER ()')} AS pct_of_errors FROM e GROUP BY error_type""")
def structure_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of errors of the structure report."""
    token = F.when(F.col("label") == "A", "L").when(F.col("label") == "N", "(").otherwise("|")
    return tool_reports.error_types(records(spark, sf_dir).withColumns({"first": F.expr(WRONG), "label": token}))


@query(f"""WITH {RECORDS} SELECT metal, count(*) AS n_samples, {ROUND4.format('avg(top1::INT)')} AS top1_acc, {ROUND4.format('avg(top5::INT)')} AS top5_acc FROM q WHERE metal IS NOT NULL GROUP BY metal HAVING count(*) >= 50""")
def structure_by_metal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_reports.stratum(records(spark, sf_dir), "metal", tool_reports.LEAST)
