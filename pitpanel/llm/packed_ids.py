"""Token ids in binary shards: Simple-8b words with escapes and block offsets.

Ids of documents in ascending key order make one stream, cut at document borders into
shard files. In a shard the stream is packed in blocks of ``BLOCK`` ids. A block is a row
of 64-bit words: the upper 4 bits of a word select how many ids of which width its other
60 bits hold (:data:`LAYOUT`); two selectors are escapes, one for a single id of any
width, one for a run of equal ids. Every block begins a new word and its offset is kept,
so any stretch of blocks is found by offset and decoded by array operations, one for each
selector that occurs.

A shard file is ``MAGIC``, the words, the block offsets (little-endian 64-bit, one more
than blocks), the documents (an Arrow IPC stream of key, first id in the shard, number of
ids), then the lengths of the three and the number of ids (four 64-bit integers) and
``MAGIC`` again. Each attempt of a task writes files of its own; the manifest, which
Spark commits, names the files of the attempts that counted, so a lost executor leaves
files behind that nothing refers to.

Documents are sent to range partitions before they are encoded, so texts move once and
ids are never shuffled. Ties of the key are spread by their text and place in the input:
a key that holds a third of all rows fills many partitions. Where a shard's ids begin
follows from the totals of the shards before it, summed by partition first.

Defined cases: null text counts as empty and gives the end id alone; null keys come
first; equal keys are ordered by text hash, then place in the input, and rows that agree
in both are interchangeable; a document of any length is packed whole in one shard,
however full that is; an empty table gives an empty manifest and no file; other columns
are ignored. Ids must be below 2**32.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.llm.bpe import SPLIT, _byte_letters
from pitpanel.llm.text import whole
from pitpanel.session import settle, shared_folder

MAGIC = b"IDS8B\x00\x00\x01"
BLOCK = 1024
#: (ids in a word, bits of each) by selector; selector 0 is a run, 14 a single id.
LAYOUT = ((0, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8),
          (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
RUN, SINGLE = 0, len(LAYOUT) - 1
#: Ids after which a shard is full, and ids packed or decoded at a time.
SHARD_IDS = 1 << 24
CHUNK_IDS = 1 << 18
_FOOTER = 4 * 8 + len(MAGIC)


# -- the code ---------------------------------------------------------------------------

def _choices(values: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(selector, ids taken) of the best word that could begin at each place.

    ``values`` and ``widths`` have one row per block, padded by one block of width 0:
    the padding lets a block's last word be a wide one.
    """
    rows, padded = widths.shape
    n = padded - BLOCK
    selector = np.full((rows, n), SINGLE, np.uint8)
    taken = np.ones((rows, n), np.int64)
    for s in range(SINGLE - 1, RUN, -1):
        count, bits = LAYOUT[s]
        over = np.zeros((rows, padded + 1), np.int32)
        np.cumsum(widths > bits, axis=1, out=over[:, 1:])
        fits = over[:, count:count + n] == over[:, :n]
        selector[fits] = s
        taken[fits] = count
    change = np.ones((rows, n), bool)
    change[:, :-1] = values[:, 1:n] != values[:, :n - 1]
    ends = np.where(change, np.arange(n), n)
    run = np.minimum.accumulate(ends[:, ::-1], axis=1)[:, ::-1] - np.arange(n) + 1
    longer = run > taken
    selector[longer], taken[longer] = RUN, run[longer]
    return selector, taken


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words in each block) of a stretch of ids; only its last block is short."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return np.empty(0, "<u8"), np.empty(0, np.int64)
    values = np.zeros((n_blocks, 2 * BLOCK), np.uint64)
    flat = np.zeros(n_blocks * BLOCK, np.uint64)
    flat[:len(ids)] = ids
    values[:, :BLOCK] = flat.reshape(n_blocks, BLOCK)
    limit = np.full(n_blocks, BLOCK)
    limit[-1] = len(ids) - (n_blocks - 1) * BLOCK
    widths = np.frexp(values.astype(np.float64))[1].astype(np.int16)
    selector, taken = _choices(values, widths)
    # All blocks step from word to word together.
    live, at = np.arange(n_blocks), np.zeros(n_blocks, np.int64)
    steps = []
    while len(live):
        steps.append((live, at))
        at = at + taken[live, at]
        on = at < limit[live]
        live, at = live[on], at[on]
    block = np.concatenate([s[0] for s in steps])
    start = np.concatenate([s[1] for s in steps])
    order = np.lexsort((start, block))
    block, start = block[order], start[order]
    chosen, count = selector[block, start], taken[block, start]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        which = np.flatnonzero(chosen == s)
        if s == RUN:
            length = np.minimum(count[which], limit[block[which]] - start[which])
            words[which] |= (length.astype(np.uint64) << np.uint64(32)) \
                | values[block[which], start[which]]
            continue
        width, bits = LAYOUT[s]
        for k in range(width):
            words[which] |= values[block[which], start[which] + k] << np.uint64(k * bits)
    return words.astype("<u8"), np.bincount(block, minlength=n_blocks)


def unpack(words: np.ndarray, sizes: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of whole blocks; ``sizes`` are the words of each, ``n_ids`` all their ids."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    body = words & np.uint64((1 << 60) - 1)
    counts = np.array([c for c, _ in LAYOUT])[selector]
    runs = selector == RUN
    counts[runs] = (body[runs] >> np.uint64(32)).astype(np.int64)
    block = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(counts)
    first_word = np.cumsum(sizes) - sizes
    start = ends - counts - (ends - counts)[first_word][block] + block * BLOCK
    # One block more than ids: the last word of a block may be padded.
    out = np.zeros((len(sizes) + 1) * BLOCK, np.uint32)
    limit = np.minimum((block + 1) * BLOCK, n_ids)
    for s in np.unique(selector):
        which = np.flatnonzero(selector == s)
        if s == RUN:
            out[_spread(start[which], counts[which])] = np.repeat(
                body[which] & np.uint64(0xFFFFFFFF), counts[which])
            continue
        width, bits = LAYOUT[s]
        mask = np.uint64((1 << bits) - 1)
        for k in range(width):
            at = start[which] + k
            inside = at < limit[which]
            out[at[inside]] = (body[which][inside] >> np.uint64(k * bits)) & mask
    return out[:n_ids]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every start, as many as its count."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - before, counts)


# -- shard files ------------------------------------------------------------------------

def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") \
        else (pafs.LocalFileSystem(), uri)


class ShardWriter:
    """Packs the ids of documents into one file."""

    def __init__(self, uri: str, key_type: pa.DataType) -> None:
        self.uri, self.key_type = uri, key_type
        system, path = _open(uri)
        self.file = system.open_output_stream(path)
        self.file.write(MAGIC)
        self.keys: list = []
        self.lengths: list[int] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.sizes: list[np.ndarray] = []

    def add(self, key, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= CHUNK_IDS:
            self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, upto: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        for at in range(0, upto, CHUNK_IDS):
            words, sizes = pack(ids[at:min(at + CHUNK_IDS, upto)])
            self.file.write(words.tobytes())
            self.sizes.append(sizes)
        self.held, self.n_held = [ids[upto:].copy()], len(ids) - upto

    def close(self) -> tuple[int, int]:
        """(documents, ids) of the finished file."""
        self._flush(self.n_held)
        sizes = np.concatenate([np.empty(0, np.int64), *self.sizes])
        offsets = np.r_[0, np.cumsum(sizes)].astype("<i8").tobytes()
        lengths = np.array(self.lengths, np.int64)
        table = pa.table({"key": pa.array(self.keys, self.key_type),
                          "first": np.cumsum(lengths) - lengths, "n_tokens": lengths})
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        documents = sink.getvalue()
        self.file.write(offsets)
        self.file.write(documents)
        self.file.write(np.array([int(sizes.sum()) * 8, len(offsets), len(documents),
                                  self.n_ids], "<i8").tobytes())
        self.file.write(MAGIC)
        self.file.close()
        return len(self.keys), self.n_ids


class ShardReader:
    """Random access to one shard file."""

    def __init__(self, uri: str) -> None:
        system, path = _open(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        footer = self.file.read_at(_FOOTER, max(size - _FOOTER, 0))
        if self.file.read_at(len(MAGIC), 0) != MAGIC or footer[-len(MAGIC):] != MAGIC:
            raise ValueError(f"{uri} is not a shard of packed ids")
        words, offsets, documents, self.n_ids = np.frombuffer(footer[:32], "<i8").tolist()
        at = len(MAGIC) + words
        self.offsets = np.frombuffer(self.file.read_at(offsets, at), "<i8")
        self.documents = pa.ipc.open_stream(
            self.file.read_at(documents, at + offsets)).read_all()

    def ids(self, first: int, n: int) -> np.ndarray:
        """The ids from ``first`` on, read and decoded from their blocks alone."""
        if not n:
            return np.empty(0, np.uint32)
        lo, hi = first // BLOCK, -(-(first + n) // BLOCK)
        a, b = int(self.offsets[lo]), int(self.offsets[hi])
        words = np.frombuffer(self.file.read_at((b - a) * 8, len(MAGIC) + a * 8), "<u8")
        held = min(hi * BLOCK, self.n_ids) - lo * BLOCK
        return unpack(words, np.diff(self.offsets[lo:hi + 1]), held)[
            first - lo * BLOCK:first - lo * BLOCK + n]


# -- encoding ---------------------------------------------------------------------------

class Encoder:
    """The ids that the tokenizers library gives, from the same vocabulary file.

    The encoding itself is the tiktoken library's, six times faster: in this kind of
    vocabulary a token's id is the rank of its merge.
    """

    def __init__(self, text: str) -> None:
        spec, letters = json.loads(text), _byte_letters()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i
                 for token, i in spec["model"]["vocab"].items() if token not in special}
        made = [ranks[bytes(letters[c] for c in "".join(
            m if isinstance(m, list) else m.split(" ")))] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("the vocabulary's ids don't follow the order of its merges")
        self.plain = tiktoken.Encoding("ids", pat_str=SPLIT, mergeable_ranks=ranks,
                                       special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        return self.plain.encode_to_numpy(text, allowed_special="all")


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The worker's encoder, built once for each vocabulary."""
    key = hash(shared.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def write(docs: DataFrame, vocabulary, end_id: int, key: str = "doc_id", text: str = "text",
          folder: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes the documents into shard files; returns their manifest.

    The manifest is (part, seq, path, n_docs, n_ids), in stream order by part and seq.
    ``vocabulary`` is what ``bpe.share`` returns; ``end_id`` ends every document.
    ``folder`` must be one that all executors see; the session's shared folder by default.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/packed-{uuid.uuid4().hex}"
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    rows = docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text")) \
        .select("key", F.xxhash64("text").alias("tie"),
                F.monotonically_increasing_id().alias("place"), "text")
    order = [F.col("key").asc_nulls_first(), F.col("tie"), F.col("place")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(vocabulary), TaskContext.get().partitionId()
        end, shard, done = np.array([end_id], np.uint32), None, []
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard is None:
                    shard = ShardWriter(f"{folder}/{part:06d}-{uuid.uuid4().hex}.ids",
                                        batch.schema.field(0).type)
                shard.add(k, np.concatenate([encoder.encode(t.as_py()), end]))
                if shard.n_ids >= shard_ids:
                    done.append((part, len(done), shard.uri, *shard.close()))
                    shard = None
        if shard is not None:
            done.append((part, len(done), shard.uri, *shard.close()))
        names = ["part", "seq", "path", "n_docs", "n_ids"]
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done)))))

    return settle(dealt.mapInArrow(
        run, "part long, seq long, path string, n_docs long, n_ids long"))


def read(manifest: DataFrame, key_type: str = "bigint") -> DataFrame:
    """(key, start, n_tokens, ids) of every document, read from the shard files.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian unsigned
    32-bit integers. Files are read in stretches of ``CHUNK_IDS``, or one document.
    """
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # One row per partition of the writing job.
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids"))
                          .alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    placed = manifest.join(before, "part").select(
        "path", (F.col("before") + inside).alias("shard_start"))
    tasks = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, shard_start in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _stretches(ShardReader(path), shard_start)

    return placed.repartition(tasks).mapInArrow(
        run, f"key {key_type}, start long, n_tokens long, ids binary")


def _stretches(shard: ShardReader, shard_start: int) -> Iterator[pa.RecordBatch]:
    keys = shard.documents.column("key").combine_chunks()
    first = shard.documents.column("first").to_numpy()
    lengths = shard.documents.column("n_tokens").to_numpy()
    ends, at = first + lengths, 0
    while at < len(first):
        upto = max(at + 1, int(np.searchsorted(ends, first[at] + CHUNK_IDS, "right")))
        ids = shard.ids(int(first[at]), int(ends[upto - 1] - first[at])).astype("<u4").tobytes()
        cuts = ((first[at:upto] - first[at]) * 4).tolist()
        stops = ((ends[at:upto] - first[at]) * 4).tolist()
        yield pa.RecordBatch.from_arrays(
            [keys.slice(at, upto - at), pa.array(first[at:upto] + shard_start),
             pa.array(lengths[at:upto]),
             pa.array([ids[a:b] for a, b in zip(cuts, stops)], pa.binary())],
            names=["key", "start", "n_tokens", "ids"])
        at = upto
