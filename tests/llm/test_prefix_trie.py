"""The trie against plain dictionaries; contraction against sums by depth."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pitpanel.llm import prefix_trie
from pitpanel.llm.queries import rebuilt_trie

LOG = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
           "saved_tokens", "ends_sha256"]


def slow_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(
                ((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        below = [totals[c] for c in children.get(node, [])]
        here = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        totals[node] = (sum(b[0] for b in below) or 1, here + sum(b[1] for b in below))
        end = ",".join(str(c) for c in sorted(members[node]) if len(built[c]) == len(node))
        out.append((min(members[node]), len(node),
                    min(members[node[:-1]]) if node else None, len(members[node]),
                    len(below), *totals[node], hashlib.sha256(end.encode()).hexdigest()))
    return out


def found(spark, rows):
    log = rows if not isinstance(rows, list) else spark.createDataFrame(rows, LOG)
    return sorted((tuple(r) for r in rebuilt_trie(log).select(*COLUMNS).collect()), key=str)


def small_log(seed=6):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(200, 230), 305, 306, 417]:
        for t in range(rng.choice([1, 1, 2, 3, 6, 8])):
            turn = None if t == 0 and c % 9 == 4 else t
            rows.append((c, turn, rng.choice(["user", None, "assistant"]),
                         rng.choice(["hi", "ok", "", None, "é\U0001f600", "long " * 20])))
    rows += rows[:25]
    rows += [(None, 0, "user", "lost"), (203, 1, "user", "a"), (203, 1, "user", "b")]
    rng.shuffle(rows)
    return rows


def test_against_dictionaries(spark):
    rows = small_log()
    assert found(spark, rows) == sorted(slow_trie(rows), key=str)


def test_long_shared_and_crowded(spark, monkeypatch):
    """Chains of hundreds of turns, a third of all conversations alike, stretches of few."""
    monkeypatch.setattr(prefix_trie, "STRETCH", 7)
    monkeypatch.setattr(prefix_trie, "ENDS_RUN", 5)
    rows = [(0, t, "user", f"t{t}") for t in range(150)]
    rows += [(300, t, "user", f"t{t}" if t < 90 else "else") for t in range(95)]
    rows += [(c, t, "user", f"s{t}") for c in range(1000, 7000, 100) for t in range(3)]
    rows += [(c, 0, "user", f"own {c}") for c in range(7001, 7090)]
    assert found(spark, rows) == sorted(slow_trie(rows), key=str)


def test_clashing_columns_and_empty(spark):
    rows = small_log(3)
    log = spark.createDataFrame([(*r, "k", 1, 2) for r in rows],
                                LOG + ", ka string, part long, conv long")
    assert found(spark, log) == sorted(slow_trie(rows), key=str)
    assert found(spark, log.limit(0)) == []
    turnless = [(c, 0, None, None) for c in (101, 102, 103)]
    assert found(spark, turnless) == sorted(slow_trie(turnless), key=str)


@pytest.mark.parametrize("shape", ["chain", "random", "star"])
def test_contraction(spark, shape):
    rng, n = random.Random(1), 300
    parent = [None] + [{"chain": k - 1, "random": rng.randint(max(0, k - 4), k - 1),
                        "star": 0}[shape] for k in range(1, n)]
    own = [(rng.randint(0, 5), rng.randint(0, 5)) for _ in range(n)]
    rows = [(k + 1, -k, None if p is None else p + 1, None if p is None else -p, *w)
            for k, (p, w) in enumerate(zip(parent, own))]
    tree = spark.createDataFrame(rows, "ka long, kb long, pa long, pb long, "
                                       "leaves long, saved long")
    total = [list(w) for w in own]
    for k in range(n - 1, 0, -1):
        for i in (0, 1):
            total[parent[k]][i] += total[k][i]
    got = {r.ka - 1: [r.leaves, r.saved] for r in prefix_trie.subtree_sums(tree).collect()}
    assert got == dict(enumerate(total))


def test_ends_of_many_runs(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS_RUN", 3)
    paths = spark.createDataFrame([(c, 1, 5, 0, 0, 7, 8) for c in range(100)],
                                  "conv long, depth long, chars long, pa long, pb long, "
                                  "ka long, kb long")
    lengths = paths.select("conv", F.lit(1).cast("long").alias("length"))
    want = hashlib.sha256(",".join(map(str, range(100))).encode()).hexdigest()
    assert [r.ends_sha256 for r in prefix_trie.ends(paths, lengths).collect()] == [want]
