"""Pairs of members of common groups, large ones included, against plain Python."""

import collections
import itertools
import random

import numpy as np
import pytest
from threadloom.operators import groups, relations


def test_large_groups_count(spark):
    rng = random.Random(3)
    groups = {1: range(320), 2: rng.sample(range(400), 310), 3: [5, 6], 4: [7], 5: rng.sample(range(400), 40)}
    want = collections.Counter(p for g in groups.values() for p in itertools.combinations(sorted(g), 2))
    rows = [(g, m) for g, ms in groups.items() for m in ms] + [(3, 5), (None, 1), (3, None)]
    members = spark.createDataFrame(rows, "group_id int, member int")
    for options in ({}, {"chunk": 50}):
        got = {(r.a, r.b): r.shared for r in relations.copresence(members, **options).collect()}
        assert got == dict(want)
    assert {(r.a, r.b) for r in relations.copresence(members, least=2).collect()} == {p for p, n in want.items() if n >= 2}


@pytest.mark.parametrize("strip", [2, 64])
def test_meetings_of_blocks_count_without_shuffled_pairs(spark, strip):
    rng = random.Random(4)
    sets = {g: rng.sample(range(90), n) for g, n in enumerate([80, 75, 60, 3, 2, 1, 40])}
    weight = {g: [2.5, 0.0, 1.0, -1.0][g % 4] for g in sets}
    count, total = collections.Counter(), collections.Counter()
    for g, ms in sets.items():
        for p in itertools.combinations(sorted(map(str, ms)), 2):
            count[p] += 1
            total[p] += weight[g]
    rows = spark.createDataFrame([(g, str(m), weight[g]) for g, ms in sets.items() for m in ms], "group_id int, member string, w double")
    x, y = (groups._strips(np.array(m), np.array(g), np.ones(len(m))) for m, g in (([0, 1, 2, 1], [5, 5, 6, 6]), ([3, 4, 3], [5, 6, 7])))
    assert groups._meeting(x[0], y[0])[1].tolist() == [[1, 0], [1, 1], [0, 1]]
    found = groups.pair_sums(rows, dense=True, strip=strip)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.a, r.b): r.total for r in found.collect()} == dict(count)
    got = {(r.a, r.b): r.total for r in groups.pair_sums(rows, weighted=True).collect()}
    assert got == dict(total) == {(r.a, r.b): r.total for r in groups.pair_sums(rows, weighted=True, dense=True, strip=strip).collect()}


def test_one_large_group_is_met_in_blocks(spark):
    """Pairs beyond the rows many times are not shuffled."""
    members = spark.range(0, 400).selectExpr("id % 4 as group_id", "id div 4 as member").unionByName(spark.range(500, 540).selectExpr("9 as group_id", "id as member"))
    found = relations.copresence(members)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 100 * 99 // 2 + 40 * 39 // 2 and found.where("shared = 4").count() == 100 * 99 // 2
