"""Repair of strings, place by place, with scores of what stands between a place's neighbours.

The scorer is a table (before, after, topk): any model whose scores are written by context takes its
place. A text's edits follow each other, and an edit changes what its neighbour's scores depend on.
So rows are repaired in rounds: one join gives every open place its scores, and each row goes on
until a place whose neighbour has just changed; that place waits for the next round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chelate.checkpoints import written
from chelate.functions.strings import is_valid
from chelate.operators.scoring import repair_places

EDIT = "struct<pos:int,`from`:string,`to`:string,prob:double>"
SCORED = "struct<pos:int,topk:array<struct<token:string,prob:double>>>"
#: Why a text could not be repaired.
LEFT_INVALID, NO_TOKENS = "max_iterations_reached", "tokenization_error: no tokens"
#: Rows up to which a scorer is sent to every task.
SMALL = 500_000


def context_scorer(train: DataFrame, tokens: str, k: int = 5) -> DataFrame:
    """before, after, topk: the k most frequent tokens between two tokens with their shares; ties by the token.

    Beyond the ends of a text stands the empty token. Counts are combined before they are shuffled.
    """
    places = f"transform({tokens}, (t, i) -> named_struct('before', coalesce(get({tokens}, i - 1), ''), 'after', coalesce(get({tokens}, i + 1), ''), 'token', t))"
    counts = train.select(F.explode(F.expr(places)).alias("p")).select("p.*").groupBy("before", "after", "token").agg(F.count("*").alias("n"))
    within = Window.partitionBy("before", "after")
    counts = counts.withColumns({"prob": F.col("n") / F.sum("n").over(within), "rank": F.row_number().over(within.orderBy(F.desc("n"), "token"))}).where(F.col("rank") <= k)
    lists = counts.groupBy("before", "after").agg(F.array_sort(F.collect_list(F.struct("rank", "token", "prob"))).alias("l"))
    return lists.select("before", "after", F.transform("l", lambda e: F.struct(e.token.alias("token"), e.prob.alias("prob"))).alias("topk"))


def step(k: int) -> str:
    """One place of a row: s is the row so far, e the place with its scores."""
    whole = is_valid("array_join(x.t, '')")
    tried = f"transform(filter(slice(e.topk, 1, {k}), c -> c.token <> s.t[e.pos]), c -> named_struct('c', c, 't', concat(slice(s.t, 1, e.pos), array(c.token), slice(s.t, e.pos + 2, size(s.t)))))"
    edit = f"cast(named_struct('pos', e.pos, 'from', s.t[e.pos], 'to', f.c.token, 'prob', f.c.prob) AS {EDIT})"
    changed = f"named_struct('t', f.t, 'edits', concat(s.edits, array({edit})), 'last', e.pos, 'stop', s.stop)"
    # the first token that makes the text valid is bound once, as the one element of an array
    put = f"transform(array(get(filter({tried}, x -> {whole}), 0)), f -> IF(f IS NULL, s, {changed}))[0]"
    stop = "named_struct('t', s.t, 'edits', s.edits, 'last', s.last, 'stop', e.pos)"
    return f"(s, e) -> CASE WHEN s.stop >= 0 THEN s WHEN s.last = e.pos - 1 THEN {stop} ELSE {put} END"


def repair_by_context(df: DataFrame, tokens: str, scorer: DataFrame, k: int = 5) -> DataFrame:
    """df with repaired, was_valid_before, is_valid_after, edits (pos, from, to, prob) and failure_reason.

    A valid text stays. Else its structure and unknown tokens, or all where it has none of these,
    are visited in order; the first of the k best tokens between the place's neighbours that is
    another and makes the whole valid takes the place. Rounds go on while a row has a place whose
    left neighbour changed, so each place is scored with the tokens that then stand beside it. Null or
    no tokens can't be repaired. Rows repeated are repaired each; an empty table gives an empty result.
    """
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()))
    valid = is_valid("array_join(t, '')")
    state = rows.select("_row", F.col(tokens).alias("t")).withColumn("_ok", F.expr(f"coalesce({valid}, false)"))
    named = repair_places("t")
    places = f"CASE WHEN size(t) > 0 THEN IF(size({named}) > 0, {named}, sequence(0, size(t) - 1)) END"
    state = state.withColumns({"places": F.expr(places), "edits": F.expr(f"cast(array() AS array<{EDIT}>)")})
    open_ = written(state.where("NOT _ok AND size(t) > 0").drop("_ok"))
    done = state.where("_ok OR coalesce(size(t), 0) <= 0").select("_row", "t", "edits")
    scorer = written(scorer)
    scorer = F.broadcast(scorer) if scorer.count() <= SMALL else scorer
    while not open_.isEmpty():
        asked = open_.select("_row", F.explode("places").alias("pos"), "t").select("_row", "pos", *[F.coalesce(F.get("t", F.col("pos") + d), F.lit("")).alias(n) for d, n in ((-1, "before"), (1, "after"))])
        lists = asked.join(scorer, ["before", "after"]).groupBy("_row").agg(F.collect_list(F.struct("pos", "topk")).alias("scored"))
        joined = open_.join(lists, "_row", "left").withColumn("scored", F.expr(f"coalesce(scored, cast(array() AS array<{SCORED}>))"))
        # a place without scores stays, but its neighbour may get some from the next round
        unscored = f"transform(array_except(places, transform(scored, x -> x.pos)), p -> cast(named_struct('pos', p, 'topk', array()) AS {SCORED}))"
        start = "named_struct('t', t, 'edits', edits, 'last', -2, 'stop', -1)"
        after = written(joined.withColumn("s", F.expr(f"aggregate(array_sort(concat(scored, {unscored})), {start}, {step(k)})")).select("_row", "places", "s.*"))
        done = done.unionByName(after.where("stop < 0").select("_row", "t", "edits"))
        open_ = after.where("stop >= 0").select("_row", "t", F.expr("filter(places, p -> p >= stop)").alias("places"), "edits")
    end = rows.join(done.withColumnRenamed("t", "_t").withColumnRenamed("edits", "_edits"), "_row")
    before, now = (F.expr(f"coalesce({is_valid(f'array_join({t}, {empty})')}, false)") for t, empty in ((tokens, "''"), ("_t", "''")))
    reason = F.when(F.coalesce(F.size("_t"), F.lit(0)) <= 0, NO_TOKENS).when(~now, LEFT_INVALID)
    return end.withColumns({"repaired": F.array_join("_t", ""), "was_valid_before": before, "is_valid_after": now, "failure_reason": reason}).withColumnRenamed("_edits", "edits").drop("_t", "_row")


def repair_evaluation(repaired: DataFrame, clean: str, kind: str) -> DataFrame:
    """kind (or overall), total, valid and exact counts and rates, uplift and edits of repaired texts whose clean form is known."""
    rate = lambda c: F.col(c) / F.col("total")
    rows = repaired.rollup(kind).agg(
        F.grouping(kind).alias("_all"),
        F.count("*").alias("total"),
        F.count_if("was_valid_before").alias("valid_before"),
        F.count_if("is_valid_after").alias("valid_after"),
        F.count_if(F.col("repaired").eqNullSafe(F.col(clean))).alias("exact_match"),
        F.sum(F.size("edits").cast("long")).alias("edits"),
    )
    rows = rows.withColumn(kind, F.when(F.col("_all") == 1, "overall").otherwise(F.col(kind))).drop("_all")
    return rows.withColumns({"valid_rate_before": rate("valid_before"), "valid_rate_after": rate("valid_after"), "exact_match_rate": rate("exact_match"), "uplift": rate("valid_after") - rate("valid_before")})


def failure_counts(repaired: DataFrame) -> DataFrame:
    """failure_reason, n of the texts that stayed invalid."""
    return repaired.where("failure_reason IS NOT NULL").groupBy("failure_reason").agg(F.count("*").alias("n"))
