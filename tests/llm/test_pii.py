"""Base spans against plain regular expressions; revealing terms on planted contexts."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from pitpanel.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, kind in enumerate(PLAIN)
            for m in re.finditer(PLAIN[kind], text or "") if holds(kind, m.group())]


def spans_of(row):
    return [(s.kind, s.start, s.end) for s in row.spans]


def test_base_spans(messy, nothing):
    rows = {(r.doc_id, r.text) for r in messy.collect()}
    want = sorted((str(i), base(t)) for i, t in rows)
    got = pii.find(messy).select("doc_id", "spans", "text_key").distinct().collect()
    assert sorted((str(r.doc_id), spans_of(r)) for r in got) == want
    assert pii.find(nothing).count() == 0
    assert pii.sanitise(nothing).columns == nothing.columns


def test_random_texts(spark):
    rng = random.Random(4)
    parts = ["a", "b.c", "@", ".", "..", "1", "25", "255", "256", "0", "+", "+1", "(2", ") ", "-",
             " ", "x_y%", "é", "\U0001f600", "4703443633947811", "4703 4436 3394-7811", "_@q.r"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += ["1.1.1.1 " * 1500, "a" * 60_000, "1" * 60_000, "+1" * 20_000,
              "a@b." * 9000, "+1" + "(" * 50_000, "1.2." * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.detect(docs, keep=("doc_id",)).select("doc_id", "spans").collect():
        assert spans_of(r) == base(texts[r.doc_id]), r.doc_id


def entity_corpus():
    rng = random.Random(5)
    filler = [f"word{k}" for k in range(400)]
    rows = []
    for k in range(1200):
        words = [rng.choice(filler) for _ in range(30)]
        if k % 120 == 0:
            # One person, always beside the same address in unlike sentences.
            words[rng.randint(8, 12)] = "Zaphodia"
            words[14] = "zb@mail.example"
        elif k % 120 < 3:
            words[14] = f"user{k}@mail.example"
        rows.append((k, " ".join(words)))
    return rows


def test_revealing_terms(spark):
    rows = entity_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.terms for r in pii.find(docs).collect()}
    hit = {k: t for k, t in found.items() if t}
    assert sorted(hit) == list(range(0, 1200, 120))
    for k, terms in hit.items():
        text = rows[k][1]
        assert [text[t.start:t.end] for t in terms] == ["Zaphodia"]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[120] and "[TERM]" in clean[120] and "Zaphodia" not in clean[120]
    assert clean[5] == rows[5][1]
    assert not any("@" in t for t in clean.values())


def test_one_passage_in_many_copies_reveals_nothing(spark):
    text = "please write to Marvinella at once under mv@mail.example for all the details"
    rows = [(k, f"{text} {k}") for k in range(50)] + [(100 + k, f"other text {k}")
                                                      for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.find(docs).filter("terms IS NOT NULL").count() == 0


def test_overlapping_spans_are_replaced_once(spark):
    docs = spark.createDataFrame([(1, "é +4703443633947811 z", 0)],
                                 "doc_id long, text string, n_chars long")
    row = pii.sanitise(docs).first()
    assert row.text in ("é [PHONE] z", "é +[CARD] z") or row.text.count("[") == 1
    assert row.n_chars == len(row.text)


def test_sanitise_keeps_rows_and_columns(messy):
    out = pii.sanitise(messy)
    assert out.columns == messy.columns and out.count() == messy.count()
    assert out.filter(F.col("text").isNull()).count() == messy.filter("text IS NULL").count()


def test_the_registered_query(spark, messy, tmp_path):
    more = spark.createDataFrame(
        [(900, "call +1 (262) 555-3752, pay 4703443633947811 from 9.9.9.9 or a@b.c, d@e.f")],
        "doc_id long, text string")
    docs = messy.select("doc_id", "text").unionByName(more)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names = list(PLAIN)
    want = []
    for r in docs.collect():
        spans = base(r.text)
        text = ",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans)
        counts = [sum(k == i for k, _, _ in spans) for i in range(len(names))]
        want.append((str(r.doc_id), *counts, hashlib.sha256(text.encode()).hexdigest(), text))
    got = queries.op7_pii_spans(spark, str(tmp_path)).collect()
    columns = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert sorted((str(r.doc_id), *(r[c] for c in columns)) for r in got) == sorted(want)
    assert ("900", 2, 1, 1, 1) in {w[:5] for w in want}


def test_a_common_word_beside_entities_is_one_row(spark):
    """Statistics of a term are one row, however many texts hold it; it reveals nothing."""
    rows = [(k, f"the a{k} common x{k} mail of user{k % 5}@mail.example here z{k} w{k} v{k}"
             if k % 3 == 0 else f"the common word {k} and more")
            for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.find(docs).filter("terms IS NOT NULL").count() == 0
