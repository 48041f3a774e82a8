"""Vocabulary growth, ids, masking, augmentation and corruption of tokenized strings.

Every random choice is a digest of the seed, the row's id and the position, so that a rerun or a
lost executor changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chelate.functions.strings import bracket_error, brackets, error_class, is_valid
from chelate.functions.tokens import SPECIAL, VOCABULARY, tokens
from chelate.operators.curves import prefix_sums

IGNORED = -100


def tokenize(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("tokens", F.expr(tokens(text)))


def grow_vocabulary(df: DataFrame, order: str, size: int = VOCABULARY) -> DataFrame:
    """token, id: the special tokens, then others by where they are seen first, up to ``size``.

    First places are combined map-side; only as many tokens as the vocabulary has room for are ranked.
    """
    spark = df.sparkSession
    fixed = spark.createDataFrame(list(enumerate(SPECIAL)), "id int, token string").select("token", "id")
    seen = df.select(order, F.posexplode("tokens").alias("pos", "token")).groupBy("token").agg(F.min(F.struct(order, "pos")).alias("first"))
    new = seen.join(F.broadcast(fixed.select("token")), "token", "left_anti").orderBy("first").limit(size - len(SPECIAL))
    return fixed.unionByName(new.select("token", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first")) + len(SPECIAL) - 1).cast("int").alias("id")))


def encode_ids(df: DataFrame, vocabulary: DataFrame, special: bool = True) -> DataFrame:
    """Add ids; unknown tokens become [UNK]. The vocabulary, at most 10,000 rows, goes along as one map."""
    table = vocabulary.agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("_ids"))
    unk = SPECIAL.index("[UNK]")
    all_tokens = F.concat(F.array(F.lit("[CLS]")), "tokens", F.array(F.lit("[SEP]"))) if special else F.col("tokens")
    return df.join(F.broadcast(table), how="cross").withColumn("ids", F.transform(all_tokens, lambda t: F.coalesce(F.element_at("_ids", t), F.lit(unk)))).drop("_ids")


def decode_ids(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add decoded: the ids' tokens in a row, without [CLS], [SEP] and [PAD]."""
    table = vocabulary.agg(F.map_from_entries(F.collect_list(F.struct("id", "token"))).alias("_tokens"))
    drop = [SPECIAL.index(t) for t in ("[CLS]", "[SEP]", "[PAD]")]
    kept = F.filter("ids", lambda i: ~i.isin(drop))
    return df.join(F.broadcast(table), how="cross").withColumn("decoded", F.array_join(F.transform(kept, lambda i: F.coalesce(F.element_at("_tokens", i), F.lit("[UNK]"))), "")).drop("_tokens")


def chance(*parts: Column) -> Column:
    """A number in [0, 1) that the parts fix."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def pad(df: DataFrame, length: int) -> DataFrame:
    """ids cut or padded to ``length``, with attention 1 on what isn't padding."""
    kept = F.slice("ids", 1, length)
    return df.withColumns({"attention": F.concat(F.array_repeat(F.lit(1), F.size(kept)), F.array_repeat(F.lit(0), length - F.size(kept))), "ids": F.concat(kept, F.array_repeat(F.lit(SPECIAL.index("[PAD]")), length - F.size(kept)))})


def mask_random(df: DataFrame, id_col: str, epoch: int, rate: float = 0.15, ids: str = "ids") -> DataFrame:
    """masked and labels: chosen positions become [MASK] (8 of 10), another id from 5 to 100 (1) or stay (1)."""
    mask = SPECIAL.index("[MASK]")

    def masked(x: Column, i: Column) -> Column:
        u = lambda tag: chance(F.lit(epoch), F.col(id_col), i, F.lit(tag))
        new = F.when(u("kind") < 0.8, F.lit(mask)).when(u("kind") < 0.9, (F.floor(u("id") * 96) + 5).cast("int")).otherwise(x)
        return F.when((x > 4) & (u("pick") < rate), new).otherwise(x)

    label = lambda x, i: F.when((x > 4) & (chance(F.lit(epoch), F.col(id_col), i, F.lit("pick")) < rate), x).otherwise(F.lit(IGNORED))
    return df.withColumns({"masked": F.transform(ids, masked), "labels": F.transform(ids, label)})


def mask_blocks(df: DataFrame, protected: list[str] | None = None) -> DataFrame:
    """masked and labels: the first shape block and every constraint become [MASK]; needs tokens and ids of the same length."""
    keep = F.array(*[F.lit(t) for t in protected or ["[CLS]", "[SEP]", "[PAD]"]])
    # where a block starts and where the first end after it is
    n = "size(tokens)"
    starts = f"filter(sequence(0, {n} - 1), i -> tokens[i] IN ('{{trans:', '{{cis:'))"
    shape = "int(array_position(tokens, '<Shape:')) - 1"
    ends = lambda mark, start: f"coalesce(array_min(filter(sequence(0, {n} - 1), j -> j > {start} AND tokens[j] = '{mark}')), -1)"
    spans = f"filter(concat(IF({shape} >= 0, array(named_struct('a', {shape}, 'z', {ends('>', shape)})), array()), transform({starts}, i -> named_struct('a', i, 'z', {ends('}', 'i')}))), b -> b.z > b.a)"
    df = df.withColumn("_spans", F.expr(f"CASE WHEN {n} > 0 THEN {spans} END"))
    hit = lambda i: F.exists("_spans", lambda b: (b.a <= i) & (i <= b.z)) & ~F.array_contains(keep, F.element_at("tokens", i + 1))
    out = {"masked": F.transform("ids", lambda x, i: F.when(hit(i), F.lit(SPECIAL.index("[MASK]"))).otherwise(x)), "labels": F.transform("ids", lambda x, i: F.when(hit(i), x).otherwise(F.lit(IGNORED)))}
    return df.withColumns(out).drop("_spans")


def mask_spans(df: DataFrame, id_col: str, epoch: int, rate: float = 0.15, longest: int = 5) -> DataFrame:
    """masked and labels: spans of 1 to ``longest`` positions, in the order of their digests, until the rate is reached."""
    want = F.greatest(F.lit(1), F.floor(F.size(F.filter("ids", lambda x: x > 4)) * rate).cast("int"))
    n = F.size("ids")
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(chance(F.lit(epoch), F.col(id_col), i, F.lit("span")).alias("u"), i.alias("i"), (F.floor(chance(F.lit(epoch), F.col(id_col), i, F.lit("len")) * longest) + 1).cast("int").alias("n")))
    df = df.withColumns({"_starts": F.when(n > 0, F.array_sort(starts)), "_want": want})
    cover = "aggregate(_starts, cast(array() AS array<int>), (s, c) -> IF(size(s) >= _want, s, slice(array_union(s, filter(sequence(c.i, least(c.i + c.n, size(ids)) - 1), j -> ids[j] > 4)), 1, greatest(_want, size(s)))))"
    df = df.withColumn("_cover", F.expr(cover))
    hit = lambda i: F.array_contains("_cover", i)
    return df.withColumns({"masked": F.transform("ids", lambda x, i: F.when(hit(i), F.lit(SPECIAL.index("[MASK]"))).otherwise(x)), "labels": F.transform("ids", lambda x, i: F.when(hit(i), x).otherwise(F.lit(IGNORED)))}).drop("_starts", "_want", "_cover")


def mask_some(df: DataFrame, id_col: str, epoch: int, wanted: Column, rate: float = 0.15, salt: int = 10_000) -> DataFrame:
    """mask_positions of the tokens that ``wanted`` (an array of booleans) marks: the first max(1, rate) by digest."""
    places = F.filter(F.transform(wanted, lambda w, i: F.when(w, F.struct(chance(F.lit(epoch * salt), F.col(id_col), i).alias("u"), i.alias("i")))), lambda p: p.isNotNull())
    kept = F.greatest(F.lit(1), F.floor(F.size(places) * rate).cast("int"))
    return df.withColumn("mask_positions", F.array_sort(F.transform(F.slice(F.array_sort(places), F.lit(1), kept), lambda p: p.i)))


def augment(df: DataFrame, id_col: str, text: str, copies: int = 2, seed: int = 0) -> DataFrame:
    """Each row and ``copies`` more, whose ligand ids are dealt anew in definition and reference alike.

    A name is replaced as a whole, so L1 never touches L10. Fewer than two ligands leave the text as it is.
    """
    rows = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    rows = rows.withColumn("_old", F.array_distinct(F.regexp_extract_all(text, F.lit(r"\|(L[0-9]+)="), F.lit(1))))
    keyed = F.array_sort(F.transform("_old", lambda o: F.struct(chance(F.lit(seed), F.col(id_col), F.col("copy"), o).alias("u"), o.alias("o"))))
    rows = rows.withColumn("_new", F.map_from_arrays("_old", F.transform(keyed, lambda k: k.o)))
    name = r"L[0-9]+(?=[=:])"
    swap = f"concat(split({text}, '{name}', -1)[0], array_join(transform(regexp_extract_all({text}, '{name}', 0), (h, i) -> concat(coalesce(element_at(_new, h), h), split({text}, '{name}', -1)[i + 1])), ''))"
    return rows.withColumn(text, F.when((F.col("copy") > 0) & (F.size("_old") > 1), F.expr(swap)).otherwise(F.col(text))).drop("_old", "_new")


def virtual_items(df: DataFrame, id_col: str, text: str, order: list[Column], copies: int = 2, seed: int = 0) -> DataFrame:
    """augment()'s rows with index: item i is row i modulo the number of rows, as it is below that number, with its ligands dealt anew above.

    Rows are numbered by ``order``, a total order, without one task that holds them all.
    """
    numbered = prefix_sums(df.withColumn("_one", F.lit(1).cast("long")), order, ["_one"])
    total = F.broadcast(df.agg(F.count("*").alias("_n")))
    rows = augment(numbered.drop("_one"), id_col, text, copies, seed).join(total)
    return rows.withColumn("index", F.col("copy") * F.col("_n") + F.col("_one_sum") - 1).drop("_n", "_one_sum")


#: Kinds of corruption and their shares.
CORRUPTIONS = {"missing_bracket": 0.25, "missing_charge": 0.20, "delimiter_swap": 0.25, "truncation": 0.20, "bracket_swap": 0.10}


def corrupt(df: DataFrame, id_col: str, text: str, seed: int = 0) -> DataFrame:
    """corruption_type, corrupted and whether the text was and is valid: one kind for each row, by digest."""
    u, at = chance(F.lit(seed), F.col(id_col), F.lit("kind")), chance(F.lit(seed), F.col(id_col), F.lit("place"))
    kind, bound = None, 0.0
    for name, share in list(CORRUPTIONS.items())[:-1]:
        bound += share
        kind = F.when(u < bound, name) if kind is None else kind.when(u < bound, name)
    df = df.withColumns({"corruption_type": kind.otherwise("bracket_swap"), "_u": at})
    marks = f"filter(transform(split({text}, ''), (c, i) -> IF(length(c) = 1 AND instr('()[]{{}}<>', c) > 0, i + 1, 0)), i -> i > 0)"
    # the place is worked out once, as the one element of an array; null without a bracket
    place = f"transform(array({marks}), m -> get(m, int(_u * size(m))))[0]"
    drop = f"transform(array({place}), p -> IF(p IS NULL, {text}, overlay({text} PLACING '' FROM p FOR 1)))[0]"
    swap = f"transform(array({place}), p -> IF(p IS NULL, {text}, overlay({text} PLACING translate(substr({text}, p, 1), '()[]{{}}<>', ')(][}}{{><') FROM p FOR 1)))[0]"
    cases = f"""CASE corruption_type
        WHEN 'missing_bracket' THEN {drop}
        WHEN 'missing_charge' THEN regexp_replace({text}, '\\\\|ox:[+-]?[0-9]+', '')
        WHEN 'delimiter_swap' THEN translate({text}, '|:', ';,')
        WHEN 'truncation' THEN left({text}, int(length({text}) * (0.5 + 0.4 * _u)))
        ELSE {swap} END"""
    df = df.withColumn("corrupted", F.expr(cases)).drop("_u")
    return df.withColumns({"was_valid_before_corruption": F.expr(is_valid(text)), "is_valid_after_corruption": F.expr(is_valid("corrupted"))})


def repair(df: DataFrame, text: str) -> DataFrame:
    """repaired, and the validity before and after.

    A valid text stays. Else the first of these that is valid is taken, and without one the text
    stays: open brackets closed in order; the mismatched bracket replaced by the one expected
    there; the delimiters ; and , turned back to | and :; that, with open brackets closed.
    """
    stack = "aggregate(split({0}, ''), '', (s, c) -> CASE WHEN c = '' THEN s WHEN instr('([{{<', c) > 0 THEN concat(s, c) WHEN right(s, 1) <> '' AND translate(right(s, 1), '([{{<', ')]}}>') = c THEN left(s, length(s) - 1) ELSE s END)"
    closed = lambda t: f"concat({t}, reverse(translate({stack.format(brackets(t))}, '([{{<', ')]}}>')))"
    wrong = "regexp_extract(_error, \"expected '(.)', got '.' at position\", 1)"
    place = "try_cast(regexp_extract(_error, 'at position ([0-9]+)$', 1) AS int) + 1"
    swapped = f"CASE WHEN _error LIKE 'Mismatched%' THEN overlay({text} PLACING {wrong} FROM {place} FOR 1) ELSE {text} END"
    back = f"translate({text}, ';,', '|:')"
    df = df.withColumns({"was_valid": F.expr(is_valid(text)), "_error": F.expr(bracket_error(f"coalesce({text}, '')"))})
    # tried in turn: what follows the first valid one isn't worked out
    tries = ", ".join(f"transform(array({t}), t -> IF({is_valid('t')}, t, NULL))[0]" for t in (closed(text), swapped, back, closed(back)))
    df = df.withColumn("_repaired", F.expr(f"CASE WHEN was_valid THEN {text} ELSE coalesce({tries}) END"))
    return df.withColumns({"repaired": F.expr(f"coalesce(_repaired, {text})"), "is_valid": F.expr("_repaired IS NOT NULL")}).drop("_repaired", "_error")


def repair_report(df: DataFrame) -> DataFrame:
    """corruption_type, n_samples, valid shares before and after, and uplift: by type and overall."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    rows = df.rollup("corruption_type").agg(F.count("*").alias("n_samples"), share("was_valid_before_corruption").alias("valid_before_corruption"), share("was_valid").alias("valid_after_corruption"), share("is_valid").alias("valid_after_repair"))
    return rows.select(F.coalesce("corruption_type", F.lit("overall")).alias("corruption_type"), "n_samples", "valid_before_corruption", "valid_after_corruption", "valid_after_repair", (F.col("valid_after_repair") - F.col("valid_after_corruption")).alias("uplift"))


def classify_errors(df: DataFrame, text: str) -> DataFrame:
    """error_class, n and share of the invalid texts."""
    # counted without the null class and not filtered before: a filter would be pushed down and work the classes out twice
    bad = df.select(F.expr(error_class(text)).alias("error_class")).groupBy("error_class").agg(F.count("error_class").alias("n")).where("n > 0")
    return bad.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
