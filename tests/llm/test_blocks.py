"""Buckets too large for one task."""

from itertools import combinations

from pyspark.sql import functions as F

from deltaspan.llm import dedup


def test_members_of_different_components_meet_in_small_groups(spark):
    rows = [(k, 1000 * k + i, 0 if i < 200 else i) for k in (1, 2) for i in range(320)] + [(3, 9000 + i, 9000 + i) for i in range(100)]
    c = dedup.Config(group=400)
    groups = {}
    for r in dedup.blocked(spark.createDataFrame(rows, "key bigint, rep bigint, comp bigint").withColumn("n", F.lit(10)), c).collect():
        groups.setdefault(r.key, []).append(r.rep)
    key, comp = {rep: k for k, rep, _ in rows}, {rep: x for _, rep, x in rows}
    # No group is common to two buckets, none grows with its bucket, none has a member twice.
    assert all(len({key[x] for x in g}) == 1 and len(g) == len(set(g)) <= 2 * c.group // 10 for g in groups.values())
    met = {p for g in groups.values() for p in combinations(sorted(g), 2)}
    assert {(a, b) for a, b in combinations(sorted(key), 2) if key[a] == key[b] and comp[a] != comp[b]} <= met
    assert dedup.blocked(spark.createDataFrame([], "key bigint, rep bigint, comp bigint, n bigint"), c).count() == 0
