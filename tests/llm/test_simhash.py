"""Fingerprints and components against brute force."""

import random
import re

import numpy as np
import xxhash

from pitpanel.llm import simhash


def slow_print(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(prints, distance=4):
    """The smallest position that each print reaches, by all pairs."""
    a, root = np.array(prints, "<u8"), list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= distance):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_components(messy, nothing):
    rows = messy.collect()
    got = {}
    for r in simhash.components(messy).collect():
        got.setdefault(r.key, (r.fp % (1 << 64), r.component))
    prints = [slow_print(r.text) for r in rows]
    reach = groups(prints)
    for r, p, root in zip(rows, prints, reach):
        if r.doc_id is None:
            continue
        keys = [x.doc_id for x, g in zip(rows, reach) if g == root and x.doc_id is not None]
        assert got[r.doc_id] == (p, min(keys))
    assert simhash.components(nothing).count() == 0
    kept = simhash.deduplicate(messy)
    assert kept.columns == messy.columns
    assert kept.count() == len(set(reach))
    assert simhash.deduplicate(nothing).count() == 0


def test_rows_that_share_a_key_and_not_their_text(spark):
    rows = [(1, "one text of some words"), (1, "another thing, quite unlike it"),
            (2, "one text of some words"), (None, "one text of some words"), (None, "only here"),
            (None, "only here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in simhash.deduplicate(docs).collect()}
    assert got == {rows[0], rows[1], rows[4]} and simhash.deduplicate(docs).count() == 3


def spanning(a, b, values):
    """Whether links connect what all pairs within distance 4 connect."""
    at = {int(v): i for i, v in enumerate(values)}
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a, b):
        p, q = find(at[int(x)]), find(at[int(y)])
        root[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(values))]


def test_dense_bucket_is_searched_without_pairs():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 62, 4, dtype=np.uint64)
    values = np.unique([c ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 40, 3)))
                        for c in centre for _ in range(120)])
    one_bucket = np.zeros(len(values), "<u8")
    want = groups(values)
    for small in (4, 10_000):
        a, b = simhash.bucket_links(one_bucket, values, small=small)
        assert spanning(a, b, values) == want
    assert len(simhash.bucket_links(one_bucket, values, small=4)[0]) < len(values)


def test_any_close_pair_shares_a_bucket():
    rng = np.random.default_rng(6)
    for n in (10, 10**7, 10**10):
        masks = simhash.block_masks(simhash.block_count(n))
        for _ in range(200):
            flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(flip & m == 0 for m in masks)


def test_chains_connect(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99)], "a long, b long")
    found = {r.node: r.root for r in simhash.connect(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    both = len(a & b)
    return both / max(1, len(a) + len(b) - both)


def near_texts(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(40, 400))]
        texts.append(" ".join(base))
        for edits in (1, 2, len(base) // 90, len(base) // 60, len(base) // 40, len(base) // 12):
            changed = list(base)
            for at in rng.sample(range(len(base)), max(1, edits)):
                changed[at] = word()
            texts.append(" ".join(changed))
    return texts


def test_near_groups_against_all_pairs(spark):
    texts = near_texts()
    sets = [shingles(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.key: r.component for r in simhash.near_components(docs).collect()}
    linked = apart = wrong = near = 0
    for i in range(len(texts)):
        for j in range(i):
            s = similarity(sets[i], sets[j])
            same = found[i] == found[j]
            near += s >= 0.8
            linked += s >= 0.8 and same
            # Far texts can share a group through others, but not across bases.
            if i // 7 != j // 7:
                apart += 1
                wrong += same
    assert linked >= 0.95 * near and near > 300
    assert wrong == 0 and apart > 1000
    kept = {r.doc_id for r in simhash.drop_near(docs).collect()}
    assert kept == set(found.values())


def test_near_copies_of_the_tables(spark):
    """Every pair at 0.8 or more in the given table, found through rare shingles."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet") \
        .select("doc_id", "text").collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    holders = {}
    for key, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(key)
    pairs = {(a, b) for keys in holders.values() if len(keys) <= 60
             for a in keys for b in keys if a < b}
    near = [(a, b) for a, b in pairs if similarity(sets[a], sets[b]) >= 0.8]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.key: r.component for r in simhash.near_components(docs).collect()}
    assert len(near) >= 10
    assert sum(found[a] == found[b] for a, b in near) >= 0.95 * len(near)
    # No group without a pair at nearly 0.8 inside.
    groups = {}
    for key, component in found.items():
        groups.setdefault(component, []).append(key)
    for keys in groups.values():
        for key in keys if len(keys) > 1 else ():
            assert max(similarity(sets[key], sets[k]) if sets[key] else 1
                       for k in keys if k != key) > 0.74


def test_near_groups_of_messy_and_no_rows(messy, nothing):
    out = simhash.drop_near(messy)
    assert out.columns == messy.columns
    texts = [r.text for r in out.collect()]
    assert len({b" ".join((t or "").encode().lower().split()) for t in texts}) == len(texts)
    assert simhash.drop_near(nothing).count() == 0


def test_a_large_bucket_gives_a_link_per_member():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2 ** 63, dtype=np.uint64)
    looks = base ^ (np.uint64(1) << rng.integers(0, 60, 400).astype(np.uint64))
    looks[17] = base
    found = simhash._near_in_bucket(looks)
    assert sorted(x for _, x in found) == [k for k in range(400) if looks[k] != base or k > 17] \
        or len(found) == len(looks) - 1
    # The original is the hub of its copies.
    assert {looks[hub] for hub, _ in found} == {base}
    strangers = rng.integers(0, 2 ** 63, 300, dtype=np.uint64)
    assert len(simhash._near_in_bucket(strangers)) < 150


def test_a_large_group_of_edited_copies_is_whole_and_cheap(spark):
    """Copies of one text that are unlike each other, but near their original."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(220)]
    texts = [" ".join(base)]
    for _ in range(300):
        changed = list(base)
        for at in rng.sample(range(220), 4):
            changed[at] = word()
        texts.append(" ".join(changed))
    sets = [shingles(t) for t in texts]
    assert similarity(sets[1], sets[2]) < 0.8 < similarity(sets[0], sets[1])
    docs = spark.createDataFrame(list(enumerate(texts, 50)), "doc_id long, text string")
    found = [r.component for r in simhash.near_components(docs).collect()]
    assert found.count(50) >= 0.98 * len(texts)


def test_no_similar_pair_of_a_large_bucket_is_left_apart(spark):
    """Two texts edited alike stay together where the hub of their bucket is another's."""
    rng = np.random.default_rng(21)
    bits = simhash.WIDE_BITS

    def edited(fp, n):
        out = fp.copy()
        out[rng.choice(np.arange(simhash.WIDE_BLOCK, bits), n, replace=False)] ^= 1
        return out

    base = rng.integers(0, 2, bits, dtype=np.uint8)
    group = [base] + [edited(base, 150) for _ in range(40)]
    # Close to the base at first look, too far from it as a whole, and pairs of their own.
    far = [edited(base, 420) for _ in range(12)]
    group += [x for f in far for x in (f, edited(f, 60))]
    fps = np.array([np.packbits(f, bitorder="little").view("<u8") for f in group])
    n = np.full(len(fps), 200)
    least = simhash.LEAST_SIMILARITY - simhash.ALLOWANCE
    nodes = spark.createDataFrame(
        [(i + 1, bytearray(f.tobytes()), 200) for i, f in enumerate(fps)],
        "node long, fp binary, n long")
    want = {i: i for i in range(len(fps))}
    for _ in fps:
        for i in range(len(fps)):
            near = simhash._alike(fps, fps[i][None, :], n, n[i], least)
            want[i] = min(want[j] for j in np.flatnonzero(near))
    assert 12 <= len(set(want.values())) < 20
    linked = simhash.near_links(nodes, least)
    found = {r.node - 1: r.root - 1 for r in simhash.connect(linked).collect()}
    assert {i: found.get(i, i) for i in want} == want
