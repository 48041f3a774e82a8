"""Bonds by a grid whose atoms go only to the cubes that the cutoff reaches, against all pairs."""

import random

from chelate.plans.large import grid_edges


def test_equals_all_pairs_at_borders_and_far_out(spark):
    rng, rows = random.Random(5), []
    for mol, far in enumerate((0.0, -7.2, 1e9, 2.0**40 * 1.8, -(2.0**51) * 1.8)):
        for i in range(90):
            step = [rng.choice([k * 0.9, k * 1.8, rng.uniform(0, 8), k * 3.6 - 1e-12]) for k in (rng.randint(-3, 3) for _ in range(3))]
            rows.append((mol, i, far + step[0], step[1], far + step[2]))
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and sum((p - q) ** 2 for p, q in zip(a[2:], b[2:], strict=True)) ** 0.5 < 1.8:
                want.add((a[0], a[1], b[1]))
    df = spark.createDataFrame(rows, "mol long, idx int, x double, y double, z double")
    out = grid_edges(df)
    got = [tuple(r) for r in out.select("mol", "i", "j").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({m for m, _, _ in want}) >= 4
    generate = next(line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate" in line)
    assert "filter(" in generate  # not to all cubes on one side
