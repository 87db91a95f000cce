"""Base counts against brute force; line frequency on planted lines and copies."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pitpanel.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    twice = Counter(windows)
    covered = {k for i, w in enumerate(windows) if twice[w] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered), failed)


def test_base_counts(messy, nothing):
    judged = rules.judge(messy.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1).cast("long"))))
    got = sorted(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols",
                                      "n_dup_lines", "n_repeat_words", "base_failed"))
                 for r in judged.collect())
    want = sorted((-1 if r.doc_id is None else r.doc_id, *counts(r.text))
                  for r in messy.collect())
    assert got == want
    assert rules.judge(nothing).count() == 0
    assert rules.clean(nothing).columns == nothing.columns and rules.clean(nothing).count() == 0


def prose(k, n=30):
    return " ".join(f"w{k}x{i}" for i in range(n))


def test_boilerplate_goes_and_copies_stay(spark):
    notice = "All rights reserved by the site and by its many readers, 2020"
    rows = [(k, f"{prose(k)}\n{notice}", "a") for k in range(40)]
    # Depleted: nearly all of it is the notice.
    rows += [(100, f"{notice}\nshort tail here", "a")]
    # Copies, exact and near, of one article are not boilerplate.
    article = "\n".join(prose(900 + i) for i in range(8))
    rows += [(200 + k, article, "a") for k in range(60)]
    rows += [(300 + k, article.replace("w903x4", f"z{k}"), "a") for k in range(60)]
    # On another host the notice is rare.
    rows += [(500, f"{notice}\nshort tail here", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in rules.judge(docs, least_share=0.0).collect()}
    assert [k for k, v in kept.items() if not v] == [100]
    cleaned = {r.doc_id: r.text for r in rules.clean(docs, least_share=0.0).collect()}
    assert cleaned[3] == prose(3) and cleaned[210] == article and notice in cleaned[500]
    assert 100 not in cleaned


def letters(k, n):
    """Prose without digits, which lines are normalised by."""
    return prose(k, n).translate(str.maketrans("0123456789", "abcdefghij"))


def test_depleted_documents_go_however_much_boilerplate_they_hold(spark):
    rng = random.Random(3)
    notices = ["\n".join(letters(f"menu{h}l{k}", 20) for k in range(9)) for h in range(2)]
    rows = [(k, f"{notices[0]}\n{letters(k, 20)}", "a") for k in range(200)]
    # Beside few unlike documents, many near copies that carry the same lines.
    rows += [(1000 + k, f"{notices[1]}\n{letters(1000 + k, 20)}", "b") for k in range(40)]
    copied = [letters(f"copy{i}", 20).split(" ") for i in range(30)]
    for k in range(600):
        lines = [list(x) for x in copied]
        for _ in range(3):
            lines[rng.randrange(30)][rng.randrange(20)] = f"edit{k}"
        text = "\n".join(" ".join(x) for x in lines)
        rows.append((2000 + k, f"{notices[1]}\n{text}", "b"))
    # Copies alone, each line of which is in hundreds of unequal texts.
    rows += [(5000 + r[0], r[1].split("\n", 9)[-1], "c") for r in rows if r[0] >= 2000]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in rules.judge(docs).filter("kept").collect()}
    assert kept == {r[0] for r in rows if r[0] >= 2000}
    cleaned = {r.doc_id: r.text for r in rules.clean(docs).collect()}
    assert cleaned == {r[0]: r[1].removeprefix(notices[1] + "\n")
                       for r in rows if r[0] >= 2000}


def test_clean_keeps_repeated_rows_and_columns(messy):
    kept = rules.clean(messy)
    assert kept.columns == messy.columns
    alive = {r.text for r in kept.collect()}
    n = messy.filter(F.col("text").isin(list(alive))).count()
    assert kept.count() == n


def boilerplate(spark):
    """Three notices, one of them edited here and there, over unlike documents of two hosts."""
    rng = random.Random(11)
    notices = [letters(f"notice{k}", 12) for k in range(3)]
    rows = []
    for k in range(120):
        edited = notices[2].split(" ")
        edited[rng.randrange(12)] = letters(f"edit{k}", 1)
        lines = [notices[0], notices[1] if k % 2 else " ".join(edited), notices[2]]
        own = [letters(k, 30)] if k % 10 else []
        rows.append((k, "\n".join(lines + own), f"host{k % 2}"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_a_full_bitmap_changes_no_verdict(spark, monkeypatch):
    docs = boilerplate(spark)

    def verdicts():
        return sorted((r.doc_id, r.kept, sorted(r.bad_lines or [])) for r in rules.judge(
            docs, least_share=0.0).collect())

    want = verdicts()
    assert any(bad for _, _, bad in want) and {kept for _, kept, _ in want} == {True, False}
    # Four words of 64 bits let nearly every row through to the joins.
    monkeypatch.setattr(rules, "BITMAP_WORDS", 4)
    monkeypatch.setattr(rules, "BITMAP_BLOCK", 2)
    assert verdicts() == want


def test_only_lines_near_candidates_are_dealt(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("k"))
    may = rules._may_hold(keys, F.col("k"))
    asked = spark.range(100_000).select("id", may(F.xxhash64("id")).alias("may")).collect()
    assert all(r.may == 1 for r in asked if r.id < 1000)
    assert sum(r.may for r in asked) < 1100
    nulls = spark.createDataFrame([(None,)], "k long")
    assert nulls.select(may(F.col("k")).alias("may")).first().may == 0
    # Written lines: none of those without a candidate's or a common line's hash.
    written = []
    real = rules.settle

    def spy(df):
        out = real(df)
        if "g" in out.columns:
            written.append(out.count())
        return out

    rows = [(k, f"{letters(k, 9)}\n{letters(f'b{k}', 9)}", "a") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rules.settle = spy
    try:
        assert rules.judge(docs).filter("kept").count() == 300
    finally:
        rules.settle = real
    assert written and sum(written) == 0


def test_bitmaps_are_no_constants_of_the_plans(spark, monkeypatch):
    # A scalar of 1 MB goes into the code of every task, once for each hash that asks it.
    plans = []
    real = rules.settle

    def spy(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    monkeypatch.setattr(rules, "settle", spy)
    judged = rules.judge(boilerplate(spark), least_share=0.0)
    assert {r.kept for r in judged.collect()} == {True, False}
    plans.append(judged._jdf.queryExecution().optimizedPlan().toString())
    assert any("bitmap" in p for p in plans)
    assert not any("scalar-subquery" in p for p in plans)
