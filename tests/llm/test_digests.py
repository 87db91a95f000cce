"""Entropy and features against slow versions; likeness and the order of documents."""

import hashlib
from collections import Counter
from math import log2

import numpy as np

from pitpanel.llm import digests
from tests.llm.conftest import messy_texts

FLAT = np.arange(digests.CLASSES)


def test_entropy_of_every_window():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 112, 400).astype(np.uint8)
    most = int(64 * 6 * 65536)
    for start, got in enumerate(digests.entropy_classes(data)):
        counts = Counter(data[start:start + 64].tolist()).values()
        total = sum(n * log2(n) for n in counts) * 65536
        assert abs((most - total) * 1024 / (most + 1) - got) < 1.01


def test_long_texts_are_looked_at_whole(monkeypatch):
    data = "".join(x or "" for x in messy_texts()[:40]).encode()
    want = digests.digests([data, data[:3000], b"", b"short"], FLAT)
    monkeypatch.setattr(digests, "PIECE", 512)
    assert digests.digests([data, data[:3000], b"", b"short"], FLAT) == want


def test_likeness():
    texts = [(x or "").encode() for x in messy_texts()]
    made = digests.digests(texts, FLAT)
    long = [k for k, t in enumerate(texts) if len(t) > 300][:12]
    for k in long:
        for j in long:
            value = digests.likeness(made[k], made[j])
            assert 0 <= value <= 1 and value == digests.likeness(made[j], made[k])
        assert digests.likeness(made[k], made[k]) == 1
    changed = texts[long[0]][:-40] + b"and now some other ending of the text."
    other, = digests.digests([changed], FLAT)
    assert digests.likeness(made[long[0]], other) > 0.4
    empty, = digests.digests([b""], FLAT)
    assert digests.likeness(empty, empty) == 1 and digests.likeness(empty, made[long[0]]) == 0


def test_compared_with_the_next(messy, nothing):
    rows = sorted(messy.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0,
                                                  r.text or ""))
    rarity = digests.rarity_of(messy)
    assert sorted(rarity.tolist()) == list(range(digests.CLASSES))
    want = []
    for r, after in zip(rows, rows[1:] + rows[:1]):
        a, b = r.text or "", after.text or ""
        quarter = len(a) // 4
        new = a[:len(a) - quarter] + b[:quarter] if quarter else a
        own, edit, following = digests.digests([a.encode(), new.encode(), b.encode()], rarity)
        want.append((str(r.doc_id), len(a), hashlib.sha256(new.encode()).hexdigest(), own, edit,
                     digests.likeness(own, edit), digests.likeness(own, following)))
    got = [(str(r.key), *r[1:]) for r in digests.compare_with_next(messy, rarity).collect()]
    assert sorted(got) == sorted(want)
    assert digests.compare_with_next(nothing, digests.rarity_of(nothing)).count() == 0
    prints = digests.fingerprints(messy, rarity, "text")
    assert "fingerprint" in prints.columns and "text" not in prints.columns
    assert prints.count() == len(rows)
