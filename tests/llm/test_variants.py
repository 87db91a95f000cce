"""Near words against all single edits; forms and roots against plain loops."""

import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from pitpanel.llm import variants


def counted(rows):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def slow_group(known):
    near = {w: [] for w in known}
    names = sorted(known)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in names:
        best = min(near[w], key=lambda v: (-known[v], v), default=None)
        form[w] = best if best is not None and known[best] >= 2 * known[w] else None
    out = []
    for w in names:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, known[w], len(near[w]),
                    None if form[w] is None else known[form[w]]))
    return out


def result(docs):
    return sorted(tuple(r) for r in variants.group(docs).collect())


def variant_rows(seed=11):
    """Words with planted variants at their ends and middles, repeats and long runs."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abeorstéß") for _ in range(rng.randint(5, 12)))
             for _ in range(60)]
    stems += ["aaaaaa", "aaaaaaa", "ababababab", "bababababa", "abababababa", "aaaab", "baaaa"]
    pool = []
    for stem in stems:
        pool += [stem] * rng.randint(1, 40)
        for _ in range(6):
            at, letter = rng.randint(0, len(stem)), rng.choice("abeorsté")
            made = rng.choice([stem[:at] + letter + stem[at:], stem[:at] + stem[at + 1:],
                               stem[:at] + letter + stem[at + 1:]])
            pool += [made] * rng.randint(1, 9)
    pool += ["q" * 500] * 3 + ["q" * 501] * 7 + ["xy" * 200] * 3 + ["xy" * 200 + "x"] * 9
    rng.shuffle(pool)
    texts = [" ".join(pool[i:i + 25]) for i in range(0, len(pool), 25)]
    return list(enumerate(texts))


def test_against_all_single_edits(spark):
    rows = variant_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = slow_group(counted(rows))
    assert result(docs) == sorted(want)
    assert sum(w[1] is not None for w in want) > 50 and any(w[1] != w[2] for w in want)


def test_messy_and_empty(spark, messy, nothing):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert result(messy) == sorted(slow_group(counted(rows)))
    assert result(nothing) == []


def test_one_gram_in_a_third_of_the_words(spark):
    rng = random.Random(2)
    words = ["zq" + "".join(rng.choice("abcd") for _ in range(6)) for _ in range(300)]
    words += ["".join(rng.choice("efgh") for _ in range(7)) for _ in range(600)]
    rows = [(k, " ".join(words)) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs) == sorted(slow_group(counted(rows)))


@given(st.lists(st.text("abcé", min_size=5, max_size=9), min_size=2, max_size=40))
@settings(max_examples=200, deadline=None)
def test_pivots_meet_prefixes(names):
    frequency = Counter(w[p:p + 2] for w in set(names) for p in range(len(w) - 1))
    prefix = {w: variants.prefix_of(w, frequency) for w in names}
    index, probes = {}, {}
    for w, (grams, _) in prefix.items():
        a, b = variants.pivots(grams)
        assert b - a >= 2
        pairs = [(frequency[w[p:p + 2]] + frequency[w[q:q + 2]]) for _, p in grams
                 for _, q in grams if q - p >= 2]
        assert frequency[w[a:a + 2]] + frequency[w[b:b + 2]] == min(pairs)
        roles = (variants.SAME, variants.SHORTER, variants.LONGER)
        probes[w] = {k for p in (a, b) for r in roles for k in variants.keys(w, p, r, True)}
        index[w] = {k for _, p in grams for r in roles
                    for k in variants.keys(w, p, r, False)}
    for v in prefix:
        for w in prefix:
            if one_edit(v, w) and prefix[v][1] <= prefix[w][1]:
                assert probes[v] & index[w]


def test_roots_of_long_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(40)]
    forms = spark.createDataFrame(chain + [("v", "w3")], "word string, form string")
    assert {tuple(r) for r in variants.roots(forms).collect()} == {
        (w, "w40") for w, _ in chain + [("v", "w3")]}


def test_no_table_of_words_is_broadcast(spark, monkeypatch, capsys):
    """The planner sizes the index as the words' file, so no threshold tells how large it is."""
    docs = spark.createDataFrame(variant_rows(), "doc_id long, text string")
    settle = variants.settle

    def seen(df):
        df.explain()
        return settle(df)

    monkeypatch.setattr(variants, "settle", seen)
    variants.group(docs).explain()
    plans = capsys.readouterr().out
    assert plans.count("SortMergeJoin") >= 4 and "Broadcast" not in plans
