"""Plans of the costly queries: nothing is worked out twice, and texts aren't folded character by character."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chelate import queries
from chelate.functions import alignment, strings
from conftest import DATA


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["shape_measure", "metal_table", "bond_order_ligands", "error_shares"])
def test_no_condition_repeats_the_work(spark, name):
    """A filter pushed below the encoding, or asked before a generator, would hold all of it."""
    filters = [line for line in plan(queries.queries()[name](spark, DATA)).split("\n") if re.match(r"[\s:+-]*Filter", line)]
    assert all(len(line) < 300 and "lambda" not in line for line in filters)


@pytest.mark.parametrize("name", ["canonical_string", "feature_vectors", "validate_summary"])
def test_an_angle_is_worked_out_once(spark, name):
    text = plan(queries.queries()[name](spark, DATA))
    assert len(re.findall(r"ACOS\(", text, re.I)) <= 1


@pytest.mark.parametrize("name", ["error_class", "error_shares", "repair_uplift"])
def test_brackets_alone_are_folded(spark, name):
    """Only taking a character out looks at all of them, and does so once."""
    text = plan(queries.queries()[name](spark, DATA))
    assert len(re.findall(r"lambdafunction\(named_struct\(c, lambda c#\d+, i, ", text)) == 0 and "array_contains" not in text


def brute(text):
    stack = []
    for i, c in enumerate(text):
        if c in "([{<":
            stack.append((c, i))
        elif c in ")]}>":
            if not stack:
                return f"Unmatched closing bracket '{c}' at position {i}"
            want = ")]}>"["([{<".index(stack.pop()[0])]
            if want != c:
                return f"Mismatched brackets: expected '{want}', got '{c}' at position {i}"
    return f"Unmatched opening bracket '{stack[0][0]}' at position {stack[0][1]}" if stack else None


def test_brackets_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ["", "x", "ä(€)😀]", "((((((((a))))))))", "((((a]))))", "<" * 200 + ">" * 200, "\n(\n)\t", None]
    texts += ["".join(rng.choice("()[]{}<>ab😀") for _ in range(rng.randint(1, 14))) for _ in range(2_000)]
    texts += ["".join(rng.choice(["()", "[a]", "{<>}", "(", "]"][: rng.choice([3, 5])]) for _ in range(6)) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", F.expr(strings.bracket_error("t")).alias("e"), F.expr(strings.faulty("t")).alias("f"), F.expr(strings.error_class("t")).alias("k"), F.expr(strings.is_valid("concat('[Metal:Fe] \f', t)")).alias("v")).collect()
    for r in rows:
        want = None if r.t is None else brute(r.t)
        assert r.e == want and bool(r.f) == (want is not None) and (r.k == "bracket") == (want is not None), r
        assert r.v == (r.t is not None and want is None and len(("[Metal:Fe] \f" + r.t).strip()) >= 10), r


@pytest.mark.parametrize(("name", "work", "times"), [("ligand_classes", "of_parts(", 0), ("least_assignment", "measures(", 1), ("donor_messages", "Aggregate [", 1)])
def test_work_is_done_once(spark, name, work, times):
    """SMILES are written before the join; measures aren't asked for rows before; messages are counted within an order's row."""
    assert plan(queries.queries()[name](spark, DATA)).count(work) == times


def test_stacked_assignment_equals_paths():
    """All points of a batch at once, against one set after the other."""
    rng = np.random.default_rng(7)
    for n in range(1, 7):
        points, vertices = rng.normal(size=(40, n, 3)), rng.normal(size=(n, 3))
        way, least = alignment.assigned(points, vertices)
        for p, w, c in zip(points, way.tolist(), least.tolist(), strict=True):
            cost = np.sqrt(((p[:, None] - vertices[None]) ** 2).sum(2)).tolist()
            assert w == alignment.least_assignment(cost) and c == pytest.approx(sum(cost[i][j] for i, j in enumerate(w)))
