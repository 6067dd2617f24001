"""Hard negatives against all scores, and what the two trees prune."""

import numpy as np
import pytest

from oracle import compare, connect
from stareflow.llm import hard_negatives as mining

ROWS = "vec_id long, label long, v array<long>"


def brute(rows, every, positives=5, negatives=10, low=30, high=90):
    out = []
    rows = [r for r in rows if all(x is not None for x in r[:3])]
    for i, (anchor, label, v) in enumerate(rows):
        if anchor % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), vec, lab != label) for j, (vec, lab, w) in enumerate(rows) if i != j and len(v) == len(w))
        for s, pos, _ in [x for x in scores if not x[2]][:positives]:
            fit = [x for x in scores if x[2] and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(anchor, pos, n + 1, neg, -s, -t) for n, (t, neg, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, every, **more):
    df = spark.createDataFrame([(*r[:3], "s", 1) for r in rows], f"{ROWS}, score string, row int")
    return sorted(tuple(r) for r in mining.hard_negatives(df, df.vec_id % every == 0, **more).collect())


def test_query_equals_its_sql(spark, sf):
    for folder in (sf, sf.replace("0.001", "0.1")):
        ok, n, why = compare(spark, connect(folder), mining.op12_hard_negatives, mining.OP12_SQL, folder)
        assert ok and n > 50, why


@pytest.mark.parametrize("room", [64, 1 << 22])
def test_equals_all_scores_with_ties_repeats_and_small_shards(spark, monkeypatch, room):
    monkeypatch.setattr(mining, "SHARD_VALUES", room)
    monkeypatch.setattr(mining, "SHARD_ROWS", 8)
    monkeypatch.setattr(mining, "FAN_IN", 3)
    rng = np.random.default_rng(3)
    rows = [(int(i % 150), int(min(rng.integers(0, 9), 4)), rng.integers(-3, 6, 4).tolist()) for i in range(170)]
    rows += [(200 + i, 4, [2, 2, 2, 2]) for i in range(60)] + [(300 + i, 7, [1, 1, 2, 2]) for i in range(40)]
    rows += [(500, 4, [1, 2]), (501, 4, [3, 1]), (502, 5, [2, 1]), (600, 1, []), (601, 1, []), (610, 2, []), (None, 1, [1, 1, 1, 1]), (700, None, [1, 1, 1, 1]), (710, 1, None)]
    rows += [(800, 9, [2**31, -(2**31), 0, 1]), (810, 8, [2**31, 0, 0, 0]), (820, 9, [2**31, 5, 5, 5])]
    got = mined(spark, rows, 10)
    assert got == brute(rows, 10) and len(got) > 500
    assert mined(spark, rows, 50, positives=2, negatives=3, low=0, high=100) == brute(rows, 50, 2, 3, 0, 100)


def test_empty_and_lonely_rows(spark):
    assert mined(spark, [], 1) == [] and mined(spark, [(1, 1, [1])], 1) == [] and mined(spark, [(1, 1, [1]), (2, 2, [1])], 1) == []


def test_far_groups_are_pruned_as_whole_nodes():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 3000
    v = np.rint(np.repeat(centres, 500, axis=0) + rng.normal(size=(20_000, 16)) * 20).astype(np.int64)
    labels = np.zeros(len(v), np.int64)
    order, root = mining.ball_tree(v, labels, mining.LEAF)
    rows = mining.Rows(root, order, order, labels, v[order])
    asked = np.arange(0, len(v), 5)
    o, top = mining.ball_tree(v[asked], labels[asked], mining.ANCHOR_LEAF)
    n = len(asked)
    far = np.full(n, mining._LEAST + 1), np.full(n, mining._MOST)
    anchors = mining.Rows(top, asked[o], asked[o], labels[asked], v[asked][o], np.arange(n + 1), *far)
    lists, scored = mining.dual_search(anchors, rows, 5, True)

    def leaves(node):
        return 1 if node.left is None else leaves(node.left) + leaves(node.right)

    assert scored < leaves(root) * leaves(top) / 5
    score = v[asked][o] @ v[order].T
    score[asked[o][:, None] == order[None, :]] = mining._LEAST
    assert (np.sort(score, axis=1)[:, :-6:-1] == lists.score).all()
