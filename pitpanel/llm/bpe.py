"""Byte-level BPE: speculate with greedy longest matches, verify, merge only failures.

Greedy longest match proposes a word's tokens. A sequence of tokens is what the merges
give exactly when every adjacent pair is *compatible*: undoing the merges of both from
the latest to the first, no merge across their border would have come earlier. That
test runs vectorised over all adjacent pairs of all new words at once; words with a
failing pair, and they alone, are merged exactly.

The vocabulary is a tokenizer JSON file whose path is a parameter; the driver reads it
once and broadcasts it (its size is fixed by the file). Ids are kept as a binary
column of little-endian unsigned 32-bit integers, the layout of token files.

Defined cases: null text counts as empty and gives no ids; strings of special tokens
inside a text become those tokens; equal texts get equal ids; a text of any length is
encoded whole, in chunks of bounded memory; null ids decode to null; ids outside the
vocabulary raise; an empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The byte-level split pattern of the vocabulary, its white space spelled
#: out (it excludes the separators U+001C to U+001F).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+"
         rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Characters of texts worked on together, and words remembered, in each worker.
CHUNK_CHARS = 1 << 19
REMEMBERED = 300_000
#: Bytes up to which a word's merges are found by scanning.
SHORT = 48
_NEVER = int(np.iinfo(np.int64).max)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """One vocabulary with its merges."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            if token not in special:
                self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.table = np.array(self.bytes_of, object)
        self.special = special
        self.special_split = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") \
            if special else None
        self.split = regex.compile(SPLIT)
        plain = {b: i for i, b in enumerate(self.bytes_of) if b and i not in special.values()}
        self.id_of = plain
        self.reach: dict[bytes, int] = {}
        for token in plain:
            start = token[:2]
            self.reach[start] = max(self.reach.get(start, 1), len(token))
        #: Rank by a * size + b; the token that a rank makes.
        self.merges: dict[int, int] = {}
        self.made: list[int] = []
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[a + b]
            self.merges[vocab[a] * size + vocab[b]] = rank
            self.made.append(made)
            self.left[made], self.right[made], self.rank[made] = vocab[a], vocab[b], rank
        keys = np.fromiter(self.merges, np.int64, len(self.merges))
        order = np.argsort(keys)
        self.size, self.pair_keys = size, keys[order]
        self.pair_ranks = np.fromiter(self.merges.values(), np.int64, len(self.merges))[order]
        # Tokens that the merges never produce from their own bytes can't be proposed.
        self.reachable = self._reachable(plain)
        #: Words met since the last turn, and those met before it.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _reachable(self, plain: dict[bytes, int]) -> np.ndarray:
        ok = np.zeros(self.size, bool)
        for data, i in plain.items():
            ok[i] = len(data) == 1 or self.merge(data) == [i]
        return ok

    def merge(self, data: bytes) -> list[int]:
        """The exact merges, by lowest rank, then leftmost."""
        ids = [self.id_of[data[i:i + 1]] for i in range(len(data))]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        """Scans a short word's ranks anew for every merge."""
        find, size, made = self.merges.get, self.size, self.made
        ranks = [find(a * size + b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            rank = min(ranks)
            if rank == _NEVER:
                break
            i = ranks.index(rank)
            ids[i] = made[rank]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = find(ids[i] * size + ids[i + 1], _NEVER)
            if i:
                ranks[i - 1] = find(ids[i - 1] * size + ids[i], _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """Keeps the pairs of a long word in a heap."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []
        for i, (a, b) in enumerate(zip(ids, ids[1:])):
            self._offer(heap, i, a, b)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                self._offer(heap, i, made, ids[after[j]])
            if before[i] >= 0:
                self._offer(heap, before[i], ids[before[i]], made)
        return [i for i in ids if i >= 0]

    def _offer(self, heap: list, at: int, a: int, b: int) -> None:
        rank = self.merges.get(a * self.size + b)
        if rank is not None:
            heapq.heappush(heap, (rank, at, self.made[rank], a, b))

    def propose(self, data: bytes) -> list[int]:
        """Greedy longest matches."""
        ids, at, n, id_of, reach = [], 0, len(data), self.id_of, self.reach
        while at < n:
            # No token that begins with these two bytes is longer.
            end = min(n, at + reach.get(data[at:at + 2], 1))
            token = id_of.get(data[at:end])
            while token is None:
                end -= 1
                token = id_of.get(data[at:end])
            ids.append(token)
            at = end
        return ids

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the border between each pair of tokens survives the merges."""
        good = self.reachable[a] & self.reachable[b]
        rows = np.flatnonzero(good)
        a, b = a[rows], b[rows]
        until_a, until_b = np.full(len(rows), _NEVER), np.full(len(rows), _NEVER)
        while len(rows):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)
            # A left part taken at the same rank goes first, a right part after it.
            crossed = (rank < until_a) & (rank <= until_b) & (rank < _NEVER)
            good[rows[crossed]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            on = ~crossed & ((rank_a >= 0) | (rank_b >= 0))
            undo_a = on & (rank_a > rank_b)
            undo_b = on & ~undo_a
            until_a = np.where(undo_a, rank_a, until_a)[on]
            until_b = np.where(undo_b, rank_b, until_b)[on]
            a = np.where(undo_a, self.right[a], a)[on]
            b = np.where(undo_b, self.left[b], b)[on]
            rows = rows[on]
        return good

    def learn(self, new: list[str]) -> int:
        """Encodes words into ``known``; returns how many had to be merged exactly."""
        data = [w.encode("utf-8", "surrogatepass") for w in new]
        proposed = [self.propose(d) for d in data]
        sizes = np.fromiter(map(len, proposed), np.int64, len(new))
        flat = np.fromiter((i for ids in proposed for i in ids), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(new)), sizes)
        inner = word[1:] == word[:-1]
        pairs, back = np.unique(flat[:-1][inner] * self.size + flat[1:][inner],
                                return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)[back]
        failed = np.zeros(len(new), bool)
        failed[word[1:][inner][~good]] = True
        failed[word[~self.reachable[flat]]] = True
        packed = flat.astype("<u4").tobytes()
        ends = (np.cumsum(sizes) * 4).tolist()
        known, start = self.known, 0
        for w, end in zip(new, ends):
            known[w] = packed[start:end]
            start = end
        for k in np.flatnonzero(failed):
            known[new[k]] = np.array(self.merge(data[k]), "<u4").tobytes()
        return int(failed.sum())

    def _words(self, text: str) -> list[str | bytes]:
        if self.special_split is None or not any(s in text for s in self.special):
            return self.split.findall(text)
        out: list[str | bytes] = []
        for piece in self.special_split.split(text):
            if piece in self.special:
                out.append(np.array([self.special[piece]], "<u4").tobytes())
            else:
                out += self.split.findall(piece)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._words(t) for t in texts]
        new: set = set()
        for words in split:
            new.update(words)
        known, older = self.known, self.older
        fresh = []
        for w in new:
            if w not in known and isinstance(w, str):
                if w in older:
                    known[w] = older[w]
                else:
                    fresh.append(w)
        if fresh:
            self.learn(fresh)
        out = [b"".join([w if isinstance(w, bytes) else known[w] for w in words])
               if any(s in text for s in self.special)
               else b"".join(map(known.__getitem__, words)) for text, words in zip(texts, split)]
        if len(known) > REMEMBERED // 2:
            # Words that come again are carried over; the rest is forgotten a turn later.
            self.older, self.known = known, {}
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(self.table[np.frombuffer(ids, "<u4")].tolist()) \
            .decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's codec, built once for each vocabulary."""
    text = shared.value
    key = hash(text)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(text)
    return _CODECS[key]


def share(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in chunks of bounded length; a longer text is a chunk of its own."""
    at, held, size = 0, [], 0
    for row, value in enumerate(column):
        text = value.as_py() or ""
        if held and size + len(text) > CHUNK_CHARS:
            yield at, held
            at, held, size = row, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield at, held


def encode(docs: DataFrame, vocabulary, text: str = "text", ids: str = "ids",
           decoded: str | None = None) -> DataFrame:
    """The documents with their token ids in ``ids`` in the place of their text.

    ``vocabulary`` is what :func:`share` returns. ``decoded`` names a column that gets
    the text decoded back from the ids.
    """
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            for at, texts in _slices(batch.column(len(rest))):
                encoded = codec.encode(texts)
                arrays = [c.slice(at, len(texts)) for c in batch.columns[:-1]]
                arrays.append(pa.array(encoded, pa.binary()))
                if decoded:
                    arrays.append(pa.array([codec.decode(e) for e in encoded], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    fields = [docs.schema[c] for c in rest] + [T.StructField(ids, T.BinaryType())]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))
    names = [f"c{i}" for i in range(len(fields))]
    renamed = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields)])
    out = docs.select(*rest, text).mapInArrow(run, renamed)
    return out.toDF(*[f.name for f in fields])


def decode(tokens: DataFrame, vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """The table with the text of its ids in the place of the ids."""
    rest = [c for c in tokens.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            texts = [None if x is None else codec.decode(x)
                     for x in (v.as_py() for v in batch.column(len(rest)))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string())], names=names)

    fields = [tokens.schema[c] for c in rest] + [T.StructField(text, T.StringType())]
    names = [f"c{i}" for i in range(len(fields))]
    renamed = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields)])
    return tokens.select(*rest, ids).mapInArrow(run, renamed).toDF(*[f.name for f in fields])
