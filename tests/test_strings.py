from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chelate.functions import strings, tokens as token_functions
from chelate.operators import tokens


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, s string")


def test_validators(spark):
    texts = ["[Metal:Fe|CN:6]|L1=N|L2=C|", "[Metal:Fe|CN:6|L1=(N|", "a)", "((]", "[Metal:Fe|ox:+200]|L1=C|", "|L1=N|L3=C|xxxxxx", "", None, "plain words here|"]
    out = rows(spark, texts).select(*[F.expr(f(*a)).alias(n) for n, f, a in (("bracket", strings.bracket_error, ["s"]), ("ok", strings.is_valid, ["s"]), ("strict", strings.is_valid, ["s", True]), ("kind", strings.error_class, ["s"]), ("errors", strings.errors, ["s"]))]).collect()
    assert [r.ok for r in out] == [True, False, False, False, True, True, False, False, False]
    assert [r.strict for r in out] == [True, False, False, False, False, False, False, False, False]
    assert [r.kind for r in out] == [None, "bracket", "bracket", "bracket", None, None, "other", "other", "truncation"]
    assert out[3].bracket == "Mismatched brackets: expected ')', got ']' at position 2" and out[6].errors == ["Empty or invalid input"]


def stacked(s):
    stack = []
    for c in s:
        if c in "([{<":
            stack.append(c)
        elif c in ")]}>":
            if not stack or {"(": ")", "[": "]", "{": "}", "<": ">"}[stack.pop()] != c:
                return False
    return not stack


@settings(max_examples=5, deadline=None)
@given(texts=st.lists(st.text("([{<)]}>ab", max_size=12), min_size=20, max_size=40))
def test_brackets_by_stack(spark, texts):
    got = [r.ok for r in rows(spark, texts).select("id", F.expr(f"{strings.bracket_error('s')} IS NULL").alias("ok")).orderBy("id").collect()]
    assert got == [stacked(t) for t in texts]


def test_tokens_and_ids(spark):
    texts = ["[Metal:Fe|ox:+2|d:d6|CN:6]<ShapeBest:Oh|V:0.25>{trans:L1:N:1--L2:N:1}{fm:fac}|L1=NC|", "|L1=A|L2=B|L3=C|", "[MASK]|", "", "1.5"]
    t = tokens.tokenize(rows(spark, texts), "s")
    got = [r.tokens for r in t.orderBy("id").collect()]
    assert got[0][:4] == ["[Fe]", ";ox=+2", ";d=6", ";CN=6"] and got[0][4:6] == ["<Shape:", ">"] and got[0][6:11] == ["{trans:", "L1:N:1", "--", "L2:N:1", "}"]
    assert got[1] == ["|", "L1", "=", "A", "|", "L", "2", "=", "B", "|", "L3", "=", "C", "|"] and got[2:4] == [["[MASK]", "|"], []]
    assert "".join(got[4]) == "V_007"
    v = tokens.grow_vocabulary(t, "id")
    assert v.count() == v.select("token").distinct().count() and len(token_functions.SPECIAL) == 246
    e = tokens.encode_ids(t, v)
    assert [r.decoded for r in tokens.decode_ids(e, v).orderBy("id").collect()] == ["".join(x) for x in got]
    m = tokens.mask_blocks(tokens.encode_ids(t, v, special=False)).orderBy("id").first()
    assert m.masked[4:11] == [3] * 7 and m.labels[:4] == [-100] * 4
    s = tokens.mask_spans(e, "id", 1).orderBy("id").first()
    assert 1 <= sum(x != -100 for x in s.labels) and tokens.mask_random(e, "id", 1).count() == 5


def test_repair(spark):
    text = "[Metal:Fe|ox:+2|CN:6]<Shape:Oh=0.5>{trans:L1:N:1--L2:N:1}|L1=N(C)|L2=Cl|"
    c = tokens.corrupt(rows(spark, [text] * 200), "id", "s", seed=3)
    assert set(r.corruption_type for r in c.select("corruption_type").distinct().collect()) == set(tokens.CORRUPTIONS)
    report = {r.corruption_type: r for r in tokens.repair_report(tokens.repair(c, "corrupted")).collect()}
    assert report["overall"].valid_before_corruption == 1 and report["overall"].uplift > 0 and report["truncation"].valid_after_repair == 1


def test_augment(spark):
    a = tokens.augment(rows(spark, ["{trans:L1:N:1--L10:N:1}|L1=A|L10=B|", "|L1=A|"]), "id", "s", copies=4).collect()
    assert {r.s for r in a if r.id == 0} == {"{trans:L1:N:1--L10:N:1}|L1=A|L10=B|", "{trans:L10:N:1--L1:N:1}|L10=A|L1=B|"} and {r.s for r in a if r.id == 1} == {"|L1=A|"}
