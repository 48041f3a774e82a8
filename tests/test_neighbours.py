from collections import Counter

import numpy as np

from chelate import queries
from chelate.operators import baselines
from conftest import DATA


def brute(rows, k=10):
    out = set()
    train = [r for r in rows if r.vec_id % 10]
    for q in (r for r in rows if r.vec_id % 10 == 0):
        far = lambda t: (sum((np.float64(a) - np.float64(b)) ** 2 for a, b in zip(q.embedding, t.embedding, strict=True)), t.vec_id)
        votes = Counter(t.label for t in sorted(train, key=far)[:k])
        out |= {(q.vec_id, c, n, r) for r, (c, n) in enumerate(sorted(votes.items(), key=lambda x: (-x[1], x[0])), 1)}
    return out


def test_whole_vectors_in_blocks(spark, monkeypatch):
    want = brute(spark.read.parquet(f"{DATA}/embeddings.parquet").collect())
    for block in (baselines.BLOCK, 40):
        monkeypatch.setattr(baselines, "BLOCK", block)
        got = queries.queries()["knn_vote_whole"](spark, DATA)
        assert {(r.vec_id, r.label, r.votes, r.rank) for r in got.collect()} == want
