"""Hard negatives against all products in plain Python."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import hard_negatives
from fleetlens.llm.oracle import oracles
from fleetlens.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, id long, v string, block int, wanted string"
LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def whole(x):
    return int(x) * 256 if abs(x) >= 2**52 else math.floor(x * 256)


def brute(rows, positives=5, negatives=10):
    own = []
    for vec, v, label in rows:
        usable = v is not None and all(x is not None and math.isfinite(x) for x in v)
        if vec is not None and label is not None and usable:
            own.append((vec, (label + 1) % 10 if vec % 7 == 0 else label, tuple(map(whole, v))))
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = Counter()
    for anchor, label, v in {row for row in own if row[0] % 100 == 0}:
        others = [(-product(v, w), vec, own_label) for vec, own_label, w in own if vec != anchor]
        for score, positive, _ in sorted(x for x in others if x[2] == label)[:positives]:
            inside = (x for x in others if x[2] != label and -30 * score <= -100 * x[0] <= -90 * score)
            for rank, (found, negative, _) in enumerate(sorted(inside)[:negatives], 1):
                out[(anchor, positive, rank, negative, -score, -found)] += 1
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(3)
    found = hard_negatives.mine(df, F.expr("vec_id % 100 = 0"), F.expr(LABEL), **more)
    return Counter(map(tuple, found.collect()))


def random_rows(seed, count=500, width=6, labels=4):
    rng = np.random.default_rng(seed)
    return [(i * 5, [float(x) for x in rng.normal(0, 0.2, width)], int(rng.integers(labels))) for i in range(count)]


AWKWARD = [
    (None, [1.0], 1),
    (1, None, 1),
    (2, [1.0, None], 1),
    (3, [float("nan")], 1),
    (4, [float("inf"), 0.0], 1),
    (6, [0.5], None),
    (8, [], 1),
    (100, [], 2),
    (9, [0.25] * 9, 3),
    (200, [0.3, 0.1], 0),
    (200, [0.3, 0.1], 0),
    (200, [0.3, 0.1], 1),
    (11, [0.3, 0.1], 1),
    (11, [0.3, 0.1], 1),
]


def test_against_all_products(spark):
    rows = random_rows(1) + AWKWARD
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("block_rows, anchor_rows, sample_rows", [(64, 2, 40), (7, 1000, 1)])
def test_small_blocks_lose_nothing(spark, block_rows, anchor_rows, sample_rows):
    rows = random_rows(2, 300) + AWKWARD
    assert mined(spark, rows, block_rows=block_rows, anchor_rows=anchor_rows, sample_rows=sample_rows) == brute(rows)


def test_ties_and_copies(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.5]), rng.choice([0.0, 0.5, 1.0])], rng.randrange(3)) for i in range(0, 700, 4)]
    rows += [(1000 + i, [0.5, 0.5], 1) for i in range(200)]
    assert mined(spark, rows, block_rows=50) == brute(rows)


def test_exact_beyond_doubles(spark):
    rng = random.Random(4)
    # Products near 2^60: doubles would not tell neighbours apart.
    rows = [(i * 20, [float(rng.randrange(1, 2**21)) + rng.random(), float(rng.randrange(1, 2**21))], i % 3) for i in range(60)]
    assert mined(spark, rows) == brute(rows)
    # A vector whose own product does not fit a long takes part, as long as none returned is that large.
    rows = [(100, [0.5, 0.0], 1), (1, [0.25, 1e18], 1), (2, [0.1, -1e18], 2), (3, [0.2, 1e300], 3)]
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="(?i)overflow|too large|too big"):
        mined(spark, [(100, [1e18], 1), (1, [1e18], 1)])


def test_boxes_hold_their_rows_and_prune():
    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.normal(0, 1, (2000, 3)))
    tree = hard_negatives.Tree(np.arange(2000), np.zeros(2000), rows, leaf=16, fan=8)
    anchors = np.floor(256 * rng.normal(0, 1, (20, 3)))
    scores = tree.rows @ anchors.T
    for low, high in tree.bounds(anchors):
        per = -(-2000 // low.shape[1])
        assert low.shape == high.shape and per >= 1
    low, high = tree.bounds(anchors)[0]
    for leaf in range(low.shape[1]):
        own = scores[leaf * 16 : leaf * 16 + 16]
        assert (own.min(axis=0) >= low[:, leaf]).all() and (own.max(axis=0) <= high[:, leaf]).all()
    bounds, read = [[x.tolist() for x in pair] for pair in tree.bounds(anchors)], 0
    for i, anchor in enumerate(anchors):
        best, leaves = hard_negatives.best_first(
            tree, anchor, [x[i] for x, _ in bounds], [x[i] for _, x in bounds], np.ones(2000, bool), [(-np.inf, np.inf, -np.inf)], 10
        )
        read += leaves
        assert best[0] == sorted((-int(s), int(n)) for s, n in zip(scores[:, i], tree.ids))[:10]
    assert read < 20 * 125 / 4


def test_empty_table(spark):
    assert not mined(spark, []) and not mined(spark, [(1, None, 1), (100, [1.0], None)])
    assert not mined(spark, [(100, [1.0], 1)])


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = QUERIES["op11_hard_negatives"](spark, sf_dir)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = db.sql(oracles()["op11_hard_negatives"])
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
