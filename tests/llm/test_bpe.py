"""Encoding against the tokenizers library; the codec's parts against exact merges."""

import random

import numpy as np
import pytest

from pitpanel.llm import bpe
from pitpanel.llm.queries import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def codec():
    with open(vocabulary_path(), encoding="utf-8") as file:
        return bpe.Codec(file.read())


@pytest.fixture(scope="module")
def library():
    tokenizer = tokenizers.Tokenizer.from_file(vocabulary_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ids_of(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def test_random_texts(codec, library):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "the", "ing", "'s", "'", "'ll", "9", "12", "é", "\x1c",
             "\x85", "\xa0", "​", "　", " ", "\U0001f600", "漢", "<|endoftext|>",
             "<|endof", "\r", "½", "ZZ", "!!", "..."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    for text, packed in zip(texts, codec.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(packed) == want
        assert codec.decode(packed) == library.decode(want, skip_special_tokens=False)


def test_compatible_pairs_are_those_that_merges_keep(codec):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 50256, 3000)
    got = codec.compatible(a, b)
    want = [codec.merge(codec.bytes_of[x] + codec.bytes_of[y]) == [x, y] for x, y in zip(a, b)]
    assert got.tolist() == want and 0 < got.sum() < len(a)


def test_both_paths_are_taken(codec):
    codec.known.clear()
    words = [" the", " thereofing", " nthtionly", " and", " ouenthst"]
    assert 0 < codec.learn(words) < len(words)


def test_long_run_without_spaces(codec, library):
    text = "".join(random.Random(3).choice("abcdeé") for _ in range(20_000))
    assert ids_of(codec.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_table(spark, messy, nothing, library):
    shared = bpe.share(spark, vocabulary_path())
    done = bpe.encode(messy, shared, decoded="again")
    assert done.columns == [c for c in messy.columns if c != "text"] + ["ids", "again"]
    texts = sorted((r.text or "") for r in messy.collect())
    rows = done.collect()
    assert sorted(r.again for r in rows) == texts
    assert all(ids_of(r.ids) == library.encode(r.again, add_special_tokens=False).ids
               for r in rows)
    back = bpe.decode(done.drop("again"), shared)
    assert sorted(r.text for r in back.collect()) == texts
    assert bpe.encode(nothing, shared).count() == 0


def test_short_and_long_words_merge_alike(codec):
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoin shrdlué-0") for _ in range(n)).encode()
             for n in range(1, 80) for _ in range(4)]
    for data in words:
        ids = [codec.id_of[data[i:i + 1]] for i in range(len(data))]
        assert codec._merge_short(list(ids)) == codec._merge_long(list(ids))
        assert b"".join(codec.bytes_of[i] for i in codec.propose(data)) == data


def test_memory_turns_over(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["always", "here"]) if rng.random() < 0.3 else
                      f"w{rng.randrange(10 ** 6)}" for _ in range(30)) for _ in range(60)]
    with open(vocabulary_path(), encoding="utf-8") as file:
        fresh = bpe.Codec(file.read())
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids_of(fresh.encode([t])[0]) for t in texts] == want
    assert len(fresh.known) + len(fresh.older) < 300
