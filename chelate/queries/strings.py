"""Validators, tokens, vocabulary, masking and corruption over text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chelate.functions import strings
from chelate.functions import tokens as token_functions
from chelate.operators import tokens
from chelate.queries.registry import registry
from chelate.queries.samples import table

QUERIES, ORACLES, query = registry()

#: A fold over a text's brackets: the open ones, or ! after a mismatch.
FOLD = """list_reduce(list_prepend('', list_filter(string_split({s}, ''), lambda c: length(c) = 1 AND contains('()[]{{}}<>', c))), lambda a, c:
  CASE WHEN a = '!' THEN a WHEN contains('([{{<', c) THEN a || c WHEN a <> '' AND translate(right(a, 1), '([{{<', ')]}}>') = c THEN left(a, length(a) - 1) ELSE '!' END)"""


def coordination_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A canonical-looking string for each order: its id and text."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.concat(F.lit("[Metal:Fe|ox:+"), (k % 4).cast("string"), F.lit("|d:d6|CN:"), (k % 7 + 2).cast("string"), F.lit("]<Shape:Oh="), (k % 2000 / 100).cast("string"), F.lit(">{trans:L1:N:1--L2:"), F.substring("o_orderstatus", 1, 1), F.lit(":1}|L1=N(C)"), F.substring("o_orderpriority", 1, 1), F.lit("|L2=C"), F.col("o_orderstatus"), F.lit("|"))
    return o.select(k.alias("id"), text.alias("text"))


STRINGS = """c AS (SELECT o_orderkey AS id, '[Metal:Fe|ox:+' || (o_orderkey % 4) || '|d:d6|CN:' || (o_orderkey % 7 + 2) || ']<Shape:Oh=' || CAST((o_orderkey % 2000) / 100 AS VARCHAR) || '>{trans:L1:N:1--L2:' || left(o_orderstatus, 1)
  || ':1}|L1=N(C)' || left(o_orderpriority, 1) || '|L2=C' || o_orderstatus || '|' AS text FROM orders)"""


@query(f"SELECT page_id, {FOLD.format(s='html')} = '' AS ok FROM pages")
def bracket_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(f"NOT coalesce({strings.faulty('html')}, false)").alias("ok"))


STRIPPED = r"regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"
VALID = f"(length({STRIPPED}) >= 10 AND (contains({STRIPPED}, '[Metal:') OR regexp_matches({STRIPPED}, '\\[[A-Z][a-z]?\\]') OR contains({STRIPPED}, '|L')) AND {FOLD.format(s=STRIPPED)} = '')"


ERROR_CLASS = f"CASE WHEN {VALID} THEN NULL WHEN {FOLD.format(s='text')} <> '' THEN 'bracket' WHEN regexp_matches(text, '[|:=]$') THEN 'truncation' WHEN contains(text, '||') OR contains(text, ';;') OR contains(text, ',,') THEN 'delimiter' WHEN regexp_matches(text, '[+-][0-9]{{3,}}') THEN 'charge' ELSE 'other' END"


@query(f"SELECT doc_id, {ERROR_CLASS} AS error_class FROM documents")
def error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(strings.error_class("text")).alias("error_class"))


NUMBERS = "list_sort(list_transform(regexp_extract_all(text, '[|]L([0-9]+)=', 1), lambda x: CAST(x AS BIGINT)))"


@query(f"WITH {STRINGS} SELECT id, {VALID} AND NOT regexp_matches(text, '[+-][0-9]{{3,}}') AND (len({NUMBERS}) = 0 OR {NUMBERS} = range({NUMBERS}[1], {NUMBERS}[-1] + 1)) AS ok FROM c")
def strict_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordination_strings(spark, sf_dir).select("id", F.expr(strings.is_valid("text", strict=True)).alias("ok"))


@query(f"WITH {STRINGS} SELECT id, len(list_filter(list_distinct(regexp_extract_all(split_part(text, '|', 1), 'L([0-9]+)[:@)]', 1)), lambda r: NOT list_contains(regexp_extract_all(text, '[|]L([0-9]+)=', 1), r))) = 0 AS ok FROM c")
def ref_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordination_strings(spark, sf_dir).select("id", F.expr(strings.refs_defined("text")).alias("ok"))


@query(f"""WITH {STRINGS}, t AS (SELECT id, list_distinct(regexp_extract_all(text, '\\{{trans:([^}}]+)\\}}', 1)) AS t FROM c)
SELECT a.id, CASE WHEN len(b.t) = 0 THEN 1.0 ELSE len(list_intersect(a.t, b.t)) / len(b.t) END::DOUBLE AS recall FROM t a JOIN t b ON b.id = a.id + 1""")
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = coordination_strings(spark, sf_dir)
    n = c.select((F.col("id") - 1).alias("id"), F.col("text").alias("target"))
    return c.join(n, "id").select("id", F.expr(strings.constraint_recall("text", "target")).alias("recall"))


@query("SELECT event_id, 'V_' || lpad(CAST(least(CAST(trunc(abs(value) / 20.0::DOUBLE * 100) AS INTEGER), 99) AS VARCHAR), 3, '0') AS token, least(CAST(trunc(abs(value) / 20.0::DOUBLE * 100) AS INTEGER), 99) * 0.2::DOUBLE AS low FROM events WHERE value IS NOT NULL")
def quantize_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", F.expr(token_functions.quantized("abs(value)")).alias("token"))
    return e.withColumn("low", F.expr(token_functions.dequantized("token")))


BLOCKS = r"regexp_extract_all({s}, '(?s)\[[^\]]*\]|<[^>]*>|\{{[^}}]*\}}|[|][^|]*[|]|.')"


@query(f"SELECT item_id, array_to_string({BLOCKS.format(s='text')}, '~') AS blocks, len({BLOCKS.format(s='text')})::INTEGER AS n FROM benchmark")
def block_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.expr(token_functions.blocks("text")).alias("b"))
    return b.select("item_id", F.array_join("b", "~").alias("blocks"), F.size("b").alias("n"))


#: Marks of blocks and decimal numbers, and the plain ones that stand for them where tokens are to be characters.
BLOCK_MARKS, PLAIN_MARKS = "[]<>{}|.", "()()()/,"
FIRST = f""", t AS (SELECT item_id, unnest(string_split(translate(text, '{BLOCK_MARKS}', '{PLAIN_MARKS}'), '')) AS token, generate_subscripts(string_split(text, ''), 1) AS pos FROM benchmark),
f AS (SELECT token, min((item_id, pos)) AS first FROM t GROUP BY token), fixed AS (SELECT unnest(__FIXED__) AS token)
""".replace("__FIXED__", "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in token_functions.SPECIAL) + "]")


def plain_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark texts with plain marks, so that their tokens are their characters."""
    return tokens.tokenize(table(spark, sf_dir, "benchmark").withColumn("text", F.translate("text", BLOCK_MARKS, PLAIN_MARKS)), "text")


@query("WITH x AS (SELECT 1)" + FIRST + f"SELECT token, CAST({len(token_functions.SPECIAL)} - 1 + row_number() OVER (ORDER BY first) AS INTEGER) AS id FROM f WHERE token NOT IN (SELECT token FROM fixed)")
def vocab_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.grow_vocabulary(plain_benchmark(spark, sf_dir), "item_id").where(F.col("id") >= len(token_functions.SPECIAL))


@query(f"SELECT item_id, translate(text, '{BLOCK_MARKS}', '{PLAIN_MARKS}') AS decoded, length(text)::INTEGER + 2 AS n_ids FROM benchmark")
def encode_decode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = plain_benchmark(spark, sf_dir)
    v = tokens.grow_vocabulary(t, "item_id")
    return tokens.decode_ids(tokens.encode_ids(t, v), v).select("item_id", "decoded", F.size("ids").alias("n_ids"))


@query("""SELECT o_orderkey AS id, concat_ws('~', '[Fe]', ';ox=+' || (o_orderkey % 4), ';d=6', ';CN=' || (o_orderkey % 7 + 2), '<Shape:~Oh~=', 'V_' || lpad(CAST(least(CAST(trunc((o_orderkey % 2000) / 100 / 20.0::DOUBLE * 100) AS INTEGER), 99) AS VARCHAR), 3, '0'), '>~{trans:',
  'L1:N:1~--~L2:' || left(o_orderstatus, 1) || ':1', '}~|~L1~=~N~(~C~)', left(o_orderpriority, 1), '|~L~2~=~C', o_orderstatus, '|') AS tokens FROM orders""")
def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenize(coordination_strings(spark, sf_dir), "text").select("id", F.array_join("tokens", "~").alias("tokens"))


U = "(CAST('0x' || substr(md5({p}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query(f"""WITH t AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, list_sum(list_transform(ids, lambda x, i: CASE WHEN x > 4 AND {U.format(p="'1:' || (conv_id * 100 + turn) || ':' || (i - 1) || ':pick'")} < 0.15::DOUBLE THEN x ELSE -100 END))::BIGINT AS label_sum FROM t""")
def mask_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", (F.col("conv_id") * 100 + F.col("turn")).alias("key"), F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))
    m = tokens.mask_random(c, "key", 1)
    return m.select("conv_id", "turn", F.aggregate("labels", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("label_sum"))


@query(f"""WITH t AS (SELECT conv_id, turn, conv_id * 100 + turn AS k, list_transform(string_split(text, ' '), lambda w: length(w) > 4) AS w FROM conversations WHERE text IS NOT NULL),
p AS (SELECT conv_id, turn, k, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM t), q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, k ORDER BY {U.format(p="'10000:' || k || ':' || i")}, i) AS r, count(*) OVER (PARTITION BY conv_id, turn, k) AS n FROM p WHERE w)
SELECT conv_id, turn, string_agg(i, ',' ORDER BY i) AS positions FROM q WHERE r <= greatest(1, floor(n * 0.15::DOUBLE)) GROUP BY conv_id, turn, k""")
def mask_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", (F.col("conv_id") * 100 + F.col("turn")).alias("key"), F.split("text", " ").alias("words"))
    m = tokens.mask_some(c, "key", 1, F.transform("words", lambda w: F.length(w) > 4))
    return m.where(F.size("mask_positions") > 0).select("conv_id", "turn", F.array_join("mask_positions", ",").alias("positions"))


@query("SELECT conv_id, turn, list_sum(ids[:8])::BIGINT + 2 * greatest(8 - len(ids), 0)::BIGINT AS total, least(len(ids), 8)::BIGINT AS attended FROM (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM conversations WHERE text IS NOT NULL)")
def pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return tokens.pad(c, 8).select("conv_id", "turn", total("ids").alias("total"), total("attention").alias("attended"))


@query(f"""WITH {STRINGS}, k AS (SELECT *, {U.format(p="'0:' || id || ':' || copy || ':L1'")} AS u1, {U.format(p="'0:' || id || ':' || copy || ':L2'")} AS u2 FROM (SELECT id, text, unnest(range(3))::INTEGER AS copy FROM c))
SELECT id, copy, CASE WHEN copy > 0 AND u2 < u1 THEN replace(replace(replace(text, 'L1', '~'), 'L2', 'L1'), '~', 'L2') ELSE text END AS text FROM k""")
def augment_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.augment(coordination_strings(spark, sf_dir), "id", "text")


CORRUPTED = f"""{STRINGS}, u AS (SELECT *, {U.format(p="'0:' || id || ':kind'")} AS u, {U.format(p="'0:' || id || ':place'")} AS v FROM c),
k AS (SELECT *, CASE WHEN u < 0.25 THEN 'missing_bracket' WHEN u < 0.45 THEN 'missing_charge' WHEN u < 0.7 THEN 'delimiter_swap' WHEN u < 0.8999999999999999::DOUBLE THEN 'truncation' ELSE 'bracket_swap' END AS corruption_type,
  list_filter(list_transform(string_split(text, ''), lambda ch, i: CASE WHEN contains('()[]{{}}<>', ch) THEN i ELSE 0 END), lambda i: i > 0) AS marks FROM u),
z AS (SELECT *, marks[CAST(trunc(v * len(marks)) AS INTEGER) + 1] AS spot FROM k),
cr AS (SELECT id, text, corruption_type, CASE corruption_type WHEN 'missing_bracket' THEN left(text, spot - 1) || substr(text, spot + 1) WHEN 'missing_charge' THEN regexp_replace(text, '[|]ox:[+-]?[0-9]+', '', 'g')
  WHEN 'delimiter_swap' THEN translate(text, '|:', ';,') WHEN 'truncation' THEN left(text, CAST(trunc(length(text) * (0.5::DOUBLE + 0.4::DOUBLE * v)) AS INTEGER))
  ELSE left(text, spot - 1) || translate(substr(text, spot, 1), '()[]{{}}<>', ')(][}}{{><') || substr(text, spot + 1) END AS corrupted FROM z)"""


@query(f"WITH {CORRUPTED} SELECT id, corruption_type, corrupted FROM cr")
def corrupt_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.corrupt(coordination_strings(spark, sf_dir), "id", "text").select("id", "corruption_type", "corrupted")


MARKS = "list_filter(list_transform(string_split({s}, ''), lambda c, i: c || i), lambda c: contains('()[]{{}}<>', left(c, 1)))"
#: The open brackets, those that close nothing left out.
STACK = """list_reduce(list_prepend('', list_filter(string_split({s}, ''), lambda c: length(c) = 1 AND contains('()[]{{}}<>', c))), lambda a, c:
  CASE WHEN contains('([{{<', c) THEN a || c WHEN a <> '' AND translate(right(a, 1), '([{{<', ')]}}>') = c THEN left(a, length(a) - 1) ELSE a END)"""
#: ! with the bracket expected at the first mismatch and its place; !u where a bracket closes nothing.
MISMATCH = """list_reduce(list_prepend('', {marks}), lambda a, c: CASE WHEN a LIKE '!%' THEN a WHEN contains('([{{<', left(c, 1)) THEN a || left(c, 1) WHEN a = '' THEN '!u'
  WHEN translate(right(a, 1), '([{{<', ')]}}>') = left(c, 1) THEN left(a, length(a) - 1) ELSE '!' || translate(right(a, 1), '([{{<', ')]}}>') || substr(c, 2) END)"""
CLOSED = "({s} || reverse(translate(" + STACK + ", '([{{<', ')]}}>')))"


def valid(t: str) -> str:
    return VALID.replace("text", t)


@query(f"""WITH {CORRUPTED}, r0 AS (SELECT *, {MISMATCH.format(marks=MARKS.format(s="corrupted"))} AS e, translate(corrupted, ';,', '|:') AS back FROM cr),
r1 AS (SELECT *, CASE WHEN e LIKE '!%' AND e <> '!u' THEN left(corrupted, CAST(substr(e, 3) AS INTEGER) - 1) || substr(e, 2, 1) || substr(corrupted, CAST(substr(e, 3) AS INTEGER) + 1) ELSE corrupted END AS swapped, {CLOSED.format(s="corrupted")} AS closed, {CLOSED.format(s="back")} AS back_closed FROM r0),
r2 AS (SELECT corruption_type, {valid("text")} AS v0, {valid("corrupted")} AS v1, {valid("corrupted")} OR {valid("closed")} OR {valid("swapped")} OR {valid("back")} OR {valid("back_closed")} AS v2 FROM r1)
SELECT coalesce(corruption_type, 'overall') AS corruption_type, count(*) AS n_samples, avg(v0::INTEGER) AS valid_before_corruption, avg(v1::INTEGER) AS valid_after_corruption, avg(v2::INTEGER) AS valid_after_repair, avg(v2::INTEGER) - avg(v1::INTEGER) AS uplift
FROM r2 GROUP BY ROLLUP (corruption_type)""")
def repair_uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.repair_report(tokens.repair(tokens.corrupt(coordination_strings(spark, sf_dir), "id", "text"), "corrupted"))


@query(f"WITH {CORRUPTED}, b AS (SELECT {ERROR_CLASS} AS error_class FROM (SELECT corrupted AS text FROM cr)) SELECT error_class, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM b WHERE error_class IS NOT NULL GROUP BY error_class")
def error_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.classify_errors(tokens.corrupt(coordination_strings(spark, sf_dir), "id", "text"), "corrupted")
