"""The packed words against plain lists; files against the tokenizers library, id by id."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pitpanel.llm import bpe, packed_ids
from pitpanel.llm.queries import vocabulary_path

LARGEST = 2 ** 32 - 1


@pytest.fixture(scope="module")
def vocabulary(spark):
    return bpe.share(spark, vocabulary_path())


def round_trip(ids):
    words, sizes = packed_ids.pack(ids)
    assert words.dtype.itemsize == 8 and len(sizes) == -(-len(ids) // packed_ids.BLOCK)
    assert sizes.sum() == len(words)
    return packed_ids.unpack(words, sizes, len(ids))


@given(st.lists(st.tuples(st.integers(0, LARGEST) | st.integers(0, 70), st.integers(1, 400)),
                max_size=12))
@settings(max_examples=150, deadline=None)
def test_runs_and_single_ids(pieces):
    ids = np.array([v for v, n in pieces for _ in range(n)], np.uint32)
    assert (round_trip(ids) == ids).all()


def test_every_width_and_length():
    rng = np.random.default_rng(3)
    for bits in range(1, 33):
        for n in (1, 59, 61, 1023, 1024, 1025, 5000):
            ids = rng.integers(0, 2 ** bits, n, dtype=np.uint64).astype(np.uint32)
            assert (round_trip(ids) == ids).all()
    mixed = (2 ** (rng.random(20_000) * 32)).astype(np.uint64).astype(np.uint32)
    assert (round_trip(mixed) == mixed).all()


def test_words_are_as_full_as_their_layout_allows():
    assert len(packed_ids.pack(np.zeros(1024, np.uint32))[0]) == 1
    assert len(packed_ids.pack(np.arange(1024, dtype=np.uint32) % 2 + 2)[0]) == -(-1024 // 30)
    assert len(packed_ids.pack(np.arange(1024, dtype=np.uint32) + 2 ** 20)[0]) == 512


def expected(rows, codec):
    """(doc_id, start, n, crc) multiset by place; ties ordered as read."""
    out = {}
    for key, text in rows:
        ids = np.array(codec.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.setdefault(key, []).append((len(ids), zlib.crc32(ids.tobytes())))
    return {k: sorted(v) for k, v in out.items()}


def check(found, rows):
    codec = Tokenizer.from_file(vocabulary_path())
    codec.no_truncation()
    codec.no_padding()
    found.sort(key=lambda r: r.start)
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    keys = [(r.key is not None, r.key or 0) for r in found]
    assert keys == sorted(keys)
    got = {}
    for r in found:
        got.setdefault(r.key, []).append((r.n_tokens, r.crc))
    assert {k: sorted(v) for k, v in got.items()} == expected(rows, codec)


@pytest.mark.parametrize("shard_ids", [1, 3000, packed_ids.SHARD_IDS])
def test_files_hold_what_the_library_encodes(spark, messy, vocabulary, shard_ids):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    manifest = packed_ids.write(messy, vocabulary, 2, shard_ids=shard_ids)
    assert manifest.agg(F.sum("n_docs")).first()[0] == len(rows)
    found = packed_ids.read(manifest).withColumn("crc", F.crc32("ids")).collect()
    check(found, rows)


def test_one_key_on_a_third_of_the_rows(spark, vocabulary):
    rows = [(7 if k % 3 else k, f"the same text {k % 2}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = packed_ids.write(docs, vocabulary, 2)
    check(packed_ids.read(manifest).withColumn("crc", F.crc32("ids")).collect(), rows)


def test_stretches_of_a_shard(tmp_path, monkeypatch):
    monkeypatch.setattr(packed_ids, "CHUNK_IDS", 4096)
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 50_257, n).astype(np.uint32) for n in (3, 0, 9000, 1, 5000, 4096)]
    import pyarrow as pa
    writer = packed_ids.ShardWriter(str(tmp_path / "x.ids"), pa.string())
    for k, ids in enumerate(docs):
        writer.add(None if k == 1 else f"d{k}", ids)
    assert writer.close() == (len(docs), sum(map(len, docs)))
    shard, at = packed_ids.ShardReader(str(tmp_path / "x.ids")), 0
    for ids in docs:
        assert (shard.ids(at, len(ids)) == ids).all()
        at += len(ids)
    assert shard.documents.column("key").to_pylist() == ["d0", None, "d2", "d3", "d4", "d5"]
    with open(tmp_path / "y.ids", "wb") as file:
        file.write(b"not a shard at all, but long enough to hold a footer of one")
    with pytest.raises(ValueError):
        packed_ids.ShardReader(str(tmp_path / "y.ids"))


def test_empty_table(nothing, vocabulary):
    manifest = packed_ids.write(nothing, vocabulary, 2)
    assert manifest.count() == 0 and packed_ids.read(manifest).count() == 0
