"""Targets by the stated rule, exact quotas, the tree's distribution, reruns."""

import re
from math import comb

from pyspark.sql import functions as F

from pitpanel.llm import mixing


def shares(sizes):
    """Iterated resharing: sizes by source, in weighing order."""
    weight = {s: k % 3 + 1 for k, s in enumerate(sizes)}
    left, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        for s in over:
            fixed[s] = 3.0 * sizes[s]
            left -= fixed[s]


def check(rows):
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.size
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    return shares({s: size[s] for s in order})


def test_taken(messy, nothing):
    named = messy.withColumn("doc_id", F.monotonically_increasing_id())
    sizes = {r.doc_id: (len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source)
             for r in named.collect()}
    got = {r.doc_id: r for r in mixing.taken(named).collect()}
    assert {k: r["size"] for k, r in got.items()} == {k: v[0] for k, v in sizes.items()}
    want = check([type("R", (), {"size": s, "source": x}) for s, x in sizes.values()])
    taken = {}
    for k, r in got.items():
        source = sizes[k][1]
        assert abs(r.target - want[source]) < 1e-6 and r.taken <= 3 * r["size"]
        taken[source] = taken.get(source, 0) + r.taken
    assert all(abs(taken[s] - t) <= 0.5 for s, t in want.items())
    again = {r.doc_id: r.taken for r in mixing.taken(named.repartition(5, "lang")).collect()}
    assert again == {k: r.taken for k, r in got.items()}
    assert mixing.taken(nothing).count() == 0


def test_targets_stop_at_three_times(spark):
    rows = spark.createDataFrame(
        [("a", 1000), ("b", 10), ("c", 5), (None, 400), ("d", 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = shares({"a": 1000, "b": 10, "c": 5, "d": 0, None: 400})
    assert {s: round(t, 6) for s, t in got.items()} == {s: round(t, 6) for s, t in want.items()}


def test_mix_gives_the_words_that_are_taken(messy):
    mixed = mixing.mix(messy)
    assert mixed.columns == messy.columns
    count = lambda df: df.groupBy("source").agg(F.sum(mixing.count_words(F.col("text")))
                                                .alias("n"))
    got = {r.source: r.n for r in count(mixed).collect()}
    want = {r.source: round(r.target) for r in
            mixing.targets(mixing.sized(messy)).collect() if r.target >= 0.5}
    assert got == want


def test_repeated_rows_are_each_drawn(spark):
    rows = [(1, "a b c d", "s", k) for k in range(50)] + [(2, "e f", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    assert sum(r.taken for r in mixing.taken(docs).collect()) == 202


def test_hypergeometric_is_the_inverse_distribution(spark):
    long = lambda n: F.lit(n).cast("long")
    rows = spark.range(2000).select(mixing.hypergeometric(
        long(50), long(20), long(25), (F.col("id") + 0.5) / 2000).alias("x")) \
        .groupBy("x").count().collect()
    for r in rows:
        assert abs(r["count"] - 2000 * comb(20, r.x) * comb(30, 25 - r.x) / comb(50, 25)) <= 1.1
    edges = spark.range(1).select(
        mixing.hypergeometric(long(7), long(7), long(3), F.lit(0.4)),
        mixing.hypergeometric(long(7), long(0), long(3), F.lit(0.4)),
        mixing.hypergeometric(long(0), long(0), long(0), F.lit(0.4))).first()
    assert tuple(edges) == (3, 0, 0)


def test_tree_keeps_quotas_and_capacity(spark):
    quotas = spark.createDataFrame([("a", 700), ("b", 37), (None, 3)], "source string, n long")
    rows = mixing.split_tree(quotas, 4).collect()
    by = lambda k: {x: sum(r.quota for r in rows if r[k] == x) for x in {r[k] for r in rows}}
    assert by("source") == {"a": 700, "b": 37, None: 3}
    assert len(by("shard")) == 16 and set(by("shard").values()) <= {46, 47}
    for s in ("a", "b", None):
        spans = sorted((r.start, r.quota) for r in rows if r.source == s and r.quota)
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
