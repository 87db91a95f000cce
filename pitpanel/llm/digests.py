"""Document fingerprints from improbable features in chained Bloom filters.

1. Every ``WINDOW``-byte window of a text has a Shannon entropy, kept in fixed point and
   so the same on any machine. Its class is its value in ``CLASSES`` steps.
2. The corpus is counted by class: a class is the more *improbable* the fewer windows
   it has, and that count ranks the windows.
3. A window is a *feature* if it is the rarest, leftmost among equals, in at least a
   quarter of the runs of ``reach`` windows that hold it. ``reach`` is ``REACH``, or in
   texts of fewer windows a power of two that leaves them some features as well.
4. A feature's hash sets ``HASHES`` bits in the current filter; a filter that holds
   ``FEATURES_PER_FILTER`` features is closed and the next one begins.
5. Two digests are compared by bit overlap: each filter of the one with fewer filters
   takes its best partner; overlap is normalised between what chance gives and all, and
   filters weigh by their features.

Texts of less than ``2 * WINDOW`` bytes have no ranks: each of their ``SHORT`` bytes long
windows is a feature (of a shorter text, all of it). They are unlike all longer texts.

Defined cases: null counts as empty; two empty texts are alike (1), an empty and another
one are not (0); equal texts have equal digests; a text of any length is digested whole;
repeated rows get equal digests, each row's next document being the following row;
an empty table gives an empty table; other columns are kept or ignored. The class
counts are ``CLASSES`` numbers, whatever the size of the corpus.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.llm.text import whole

WINDOW = 64
CLASSES = 1024
REACH = 64
SHORT = 8
BITS = 2048
HASHES = 5
FEATURES_PER_FILTER = 160
#: Bytes of a text that are looked at together; pieces overlap by what windows need.
PIECE = 1 << 18
_FINE = 1 << 16
_STEPS = np.round(np.array([0.0] + [
    n * np.log2(n) - (n - 1) * np.log2(n - 1) if n > 1 else 0.0
    for n in range(1, WINDOW + 1)]) * _FINE).astype(np.int64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """The entropy class of every window of the bytes (at least WINDOW of them).

    A window's sum of n log n over its byte counts changes by what the leaving byte
    and the entering byte add to their counts, and those counts are how often the byte
    stands in the WINDOW - 1 bytes after, or before, it.
    """
    n = len(data)
    before = np.ones(n, np.uint8)
    after = np.ones(n, np.uint8)
    for lag in range(1, min(WINDOW, n)):
        same = data[lag:] == data[:-lag]
        before[lag:] += same
        after[:-lag] += same
    enters, leaves = _STEPS[before], _STEPS[after]
    first = _STEPS[before[:WINDOW]].sum()
    total = np.concatenate(([first], first + np.cumsum(
        enters[WINDOW:] - leaves[: n - WINDOW])))
    most = int(WINDOW * np.log2(WINDOW) * _FINE)
    return np.clip((most - total) * CLASSES // (most + 1), 0, CLASSES - 1)


def _first_lowest(keys: np.ndarray, reach: int) -> np.ndarray:
    """For every run of ``reach`` keys its lowest one (keys are distinct)."""
    n = len(keys)
    pad = -n % reach
    top = np.iinfo(keys.dtype).max
    padded = np.concatenate([keys, np.full(pad, top, keys.dtype)]).reshape(-1, reach)
    head = np.minimum.accumulate(padded, axis=1).ravel()
    tail = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - reach + 1], head[reach - 1: n])


def feature_starts(ranks: np.ndarray) -> np.ndarray:
    """Starts of the popular windows, from every window's rank (low is rare)."""
    n = len(ranks)
    reach = min(REACH, 1 << ((n // 16).bit_length() - 1))
    keys = ranks.astype(np.int64) << 40 | np.arange(n)
    winners = _first_lowest(keys, reach) & ((1 << 40) - 1)
    return np.flatnonzero(np.bincount(winners, minlength=n) >= reach // 4)


def _window_hashes(data: np.ndarray, starts: np.ndarray | slice, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes (a multiple of 8) at each start."""
    words = np.lib.stride_tricks.sliding_window_view(data, size)[starts]
    h = np.zeros(len(words), np.uint64)
    for lane in np.ascontiguousarray(words).view("<u8").T:
        h = (h ^ lane) * _BASE
        h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def ranked(texts: list[bytes], rarity: np.ndarray) -> Iterator[np.ndarray | None]:
    """The window ranks of each text (None: shorter than two windows), in order.

    Short texts are looked at together, long ones in pieces; both are bounded by PIECE.
    """
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE):
            size += len(texts[end])
            end += 1
        data = np.frombuffer(b"".join(texts[at:end]), np.uint8)
        pieces = [entropy_classes(data[begin: begin + PIECE + WINDOW - 1])
                  for begin in range(0, len(data) - WINDOW + 1, PIECE)]
        ranks = rarity[np.concatenate(pieces)] if pieces else np.empty(0, np.int64)
        start = 0
        for text in texts[at:end]:
            yield ranks[start: start + len(text) - WINDOW + 1] if len(text) >= 2 * WINDOW else None
            start += len(text)
        at = end


def features(data: bytes, ranks: np.ndarray | None) -> np.ndarray:
    """The hashes of a text's features in order, each once."""
    if len(data) < SHORT:
        return np.array([xxhash.xxh64_intdigest(data, 7)], np.uint64) if data \
            else np.empty(0, np.uint64)
    array = np.frombuffer(data, np.uint8)
    every = _window_hashes(array, slice(None), SHORT) if ranks is None \
        else _window_hashes(array, feature_starts(ranks), WINDOW)
    _, first = np.unique(every, return_index=True)
    return every[np.sort(first)]


def filters(hashes: np.ndarray) -> np.ndarray:
    """(filters, BITS) booleans; the chain in order."""
    count = -(-len(hashes) // FEATURES_PER_FILTER)
    bits = np.zeros((count, BITS), bool)
    chain = np.arange(len(hashes)) // FEATURES_PER_FILTER
    for k in range(HASHES):
        at = (hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)
        bits[chain, at.astype(np.int64)] = True
    return bits


def digests(texts: list[bytes], rarity: np.ndarray) -> list[str]:
    """Each text's digest as a string: short or long, number of features, filters."""
    out = []
    for data, ranks in zip(texts, ranked(texts, rarity)):
        hashes = features(data, ranks)
        packed = base64.b64encode(np.packbits(filters(hashes), axis=1).tobytes()).decode()
        out.append(f"{'s' if ranks is None else 'l'}:{len(hashes)}:{packed}")
    return out


def _unpack(text: str) -> tuple[str, int, np.ndarray]:
    kind, count, packed = text.split(":")
    data = np.frombuffer(base64.b64decode(packed), np.uint8).reshape(-1, BITS // 8)
    return kind, int(count), data


def likeness(a: str, b: str) -> float:
    """How alike two digests are, 0 to 1; symmetric, 1 for equal digests."""
    if a == b:
        return 1.0
    (kind_a, n_a, x), (kind_b, n_b, y) = _unpack(a), _unpack(b)
    if not n_a or not n_b or kind_a != kind_b:
        return 0.0
    if (len(x), n_a, a) > (len(y), n_b, b):
        x, y, n_a, n_b = y, x, n_b, n_a
    bits_y = np.unpackbits(y, axis=1).astype(np.float32)
    on_y = bits_y.sum(axis=1)
    full = np.full(len(x), FEATURES_PER_FILTER)
    full[-1] = n_a - FEATURES_PER_FILTER * (len(x) - 1)
    best = np.zeros(len(x))
    for at in range(0, len(x), 256):
        bits_x = np.unpackbits(x[at:at + 256], axis=1).astype(np.float32)
        on_x = bits_x.sum(axis=1)
        shared = bits_x @ bits_y.T
        chance = np.outer(on_x, on_y) / BITS
        least = np.minimum(on_x[:, None], on_y[None, :])
        # Overlap within three deviations of chance counts as none.
        floor = chance + 3 * np.sqrt(chance * (1 - np.maximum(on_x[:, None], on_y) / BITS))
        score = np.clip((shared - floor) / np.maximum(least - floor, 1e-9), 0, 1)
        score[least <= floor] = 0
        best[at:at + 256] = score.max(axis=1)
    return float((best * full).sum() / full.sum())


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the first as many of the next."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter] if quarter else text


def _encoded(column: pa.Array) -> list[bytes]:
    return [(v.as_py() or "").encode("utf-8", "surrogatepass") for v in column]


def _chunks(column: pa.Array, rows: int = 256) -> Iterator[tuple[int, list[bytes]]]:
    for at in range(0, len(column), rows):
        yield at, _encoded(column.slice(at, rows))


def _count_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, itself = np.zeros(CLASSES, np.int64), np.arange(CLASSES)
    for batch in batches:
        for _, texts in _chunks(batch.column(0)):
            for classes in ranked(texts, itself):
                if classes is not None:
                    counts += np.bincount(classes, minlength=CLASSES)
    yield pa.RecordBatch.from_arrays(
        [pa.array(itself.astype(np.int32)), pa.array(counts)], names=["class", "n"])


def rarity_of(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The rank of every entropy class: 0 for the one that fewest windows have."""
    rows = docs.select(whole(F.col(text)).alias("text")) \
        .mapInArrow(_count_classes, "class int, n bigint") \
        .groupBy("class").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES, np.int64)
    for row in rows:
        counts[row["class"]] = row["n"]
    ranks = np.empty(CLASSES, np.int64)
    ranks[np.lexsort((np.arange(CLASSES), counts))] = np.arange(CLASSES)
    return ranks


def fingerprints(docs: DataFrame, rarity: np.ndarray, text: str = "text",
                 out: str = "fingerprint") -> DataFrame:
    """The documents with their digest in ``out``, in the place of their text."""
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [d for _, texts in _chunks(batch.column(len(rest)))
                    for d in digests(texts, rarity)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(made, pa.string())], names=names)

    fields = [docs.schema[c] for c in rest] + [T.StructField(out, T.StringType())]
    names = [f"c{i}" for i in range(len(fields))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields)])
    return docs.select(*rest, text).mapInArrow(run, schema).toDF(*[f.name for f in fields])


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, tail, key, text): ranges of ascending keys, each sorted in its partition.

    A range ends with the first row of the next one (the last: of the first) as ``tail``,
    so every row's successor is the row after it. Range borders are approximate quantiles
    of the keys; they and the ranges' first keys are a few numbers a shuffle partition.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), whole(F.col(text)).alias("text"))
    ranges = max(8, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = rows.select("key")
    cuts = keys.agg(F.percentile_approx(
        "key", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(10000))) \
        .first()[0] or []
    borders = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]) if cuts \
        else F.array().cast("array<bigint>")
    # Null keys come first, in a range of their own.
    part = F.when(F.col("key").isNull(), F.lit(0)).otherwise(F.aggregate(
        borders, F.lit(1), lambda acc, b: acc + F.when(F.col("key") > b, 1).otherwise(0)))
    firsts = {r["part"]: r["first"] for r in keys.select(part.alias("part"), "key")
              .groupBy("part").agg(F.min("key").alias("first")).collect()}
    held = sorted(firsts)
    before = dict(zip(held[1:], held)) | ({held[0]: held[-1]} if held else {})
    last = held[-1] if held else 0
    starts = F.array(*[F.lit(firsts.get(p)).cast("long") for p in range(last + 1)])
    previous = F.array(*[F.lit(before.get(p)).cast("int") for p in range(last + 1)])
    placed = rows.withColumn("part", part.cast("int"))
    is_first = F.col("key").eqNullSafe(F.get(starts, F.col("part")))
    places = F.concat(
        F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("tail"))),
        F.when(is_first, F.array(F.struct(
            F.get(previous, F.col("part")).alias("part"), F.lit(1).alias("tail"))))
        .otherwise(F.array().cast("array<struct<part:int,tail:int>>")))
    return placed.select("key", "text", F.explode(places).alias("p")) \
        .select("p.part", "p.tail", "key", "text").repartition("part") \
        .sortWithinPartitions("part", "tail", "key", "text")


COMPARED = ("key bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
            "edited_fingerprint string, near_edited double, near_next double")


def compare_with_next(docs: DataFrame, rarity: np.ndarray, key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """Each document's digest against its edited text's and the next document's."""
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Lists of (part, tail, key, text), each but the first repeating the last row."""
        held: list[tuple] = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:3]]
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(3).slice(at, 256).to_pylist()
                held += zip(*[c[at:at + 256] for c in columns], texts)
                yield held
                held = held[-1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: str | None = None
        for held in rows_of(batches):
            own = digests([r[3].encode("utf-8", "surrogatepass")
                           for r in held[known is not None:]], rarity)
            own = own if known is None else [known, *own]
            known = own[-1]
            pairs = [(i, a, b) for i, (a, b) in enumerate(zip(held, held[1:])) if not a[1]]
            new = [edited(a[3], b[3]) for _, a, b in pairs]
            data = [t.encode("utf-8", "surrogatepass") for t in new]
            made = digests(data, rarity)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array([a[2] for _, a, _ in pairs], pa.int64()),
                "n_chars": pa.array([len(a[3]) for _, a, _ in pairs], pa.int64()),
                "edited_sha256": [hashlib.sha256(d).hexdigest() for d in data],
                "fingerprint": pa.array([own[i] for i, _, _ in pairs], pa.string()),
                "edited_fingerprint": pa.array(made, pa.string()),
                "near_edited": pa.array([likeness(own[i], m) for (i, _, _), m in
                                         zip(pairs, made)], pa.float64()),
                "near_next": pa.array([likeness(own[i], own[i + 1]) for i, _, _ in pairs],
                                      pa.float64())},
                schema=arrow)

    arrow = pa.schema([("key", pa.int64()), ("n_chars", pa.int64()),
                       ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                       ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                       ("near_next", pa.float64())])
    return in_order(docs, key, text).mapInArrow(run, COMPARED)
