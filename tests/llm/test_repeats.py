"""Repeated strings against brute force."""

import hashlib
import random
from collections import Counter

from pitpanel.llm import repeats

LENGTH = 40


def fixture():
    rng = random.Random(3)
    parts = ["ab", "cde", "f g", "é", "\n", "xyz ", "  "]
    some = lambda n: "".join(rng.choice(parts) for _ in range(n))
    passages = [some(60) for _ in range(6)]
    docs = [(i, "".join(rng.choice([some(rng.randint(5, 40)), rng.choice(passages),
                                    rng.choice(passages)[:rng.randint(20, 200)]])
                        for _ in range(rng.randint(1, 6)))) for i in range(50)]
    docs += [(100, "a" * 500), (101, "ab" * 300), (102, ""), (103, None), (104, passages[0]),
             (105, passages[0]), (106, "x" + "a" * 39), (107, docs[5][1]), (108, docs[5][1]),
             (None, docs[7][1] + "q"), (109, "short"), (109, "short"), (3, docs[3][1])]
    return docs


def slow(docs, length):
    data = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(b[s:s + length] for _, b in data for s in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(docs, **options):
    return sorted(((r.key, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans),
                    r.kept_sha256) for r in repeats.removals(docs, **options).collect()), key=str)


def test_against_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(*r, "k", "p", "g") for r in rows],
                                 "doc_id long, text string, key string, places string, row string")
    want = slow(rows, LENGTH)
    assert found(docs, length=LENGTH, gram=10) == want
    # Every gram counts as crowded: the other exact way.
    assert found(docs, length=LENGTH, gram=10, crowded=1) == want
    assert found(docs, length=LENGTH, gram=30, crowded=4) == want
    assert repeats.removals(docs.limit(0)).count() == 0


def test_production_length(spark):
    rng = random.Random(11)
    letters = "abcdefgh \n"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared, just, under = text(900), text(400), text(399)
    rows = [(1, text(300) + shared + text(50)), (2, shared[100:] + text(700)),
            (3, text(10) + just), (4, just + text(10)), (5, text(10) + under),
            (6, under + text(10)), (7, text(2000)), (8, shared[:500] + text(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == slow(rows, 400)


def test_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 64)
    rng = random.Random(12)
    text = "".join(rng.choice("abcd") for _ in range(3000))
    data = (text + text[500:700]).encode()
    pieces, grams = repeats.anchors(data, 40, 10)
    monkeypatch.setattr(repeats, "PIECE", 1 << 19)
    whole, same = repeats.anchors(data, 40, 10)
    assert pieces.tolist() == whole.tolist() and grams.tolist() == same.tolist()
