"""Removal of long repeated byte strings with a sparse enhanced suffix array.

A byte goes when a string of ``length`` bytes that covers it also starts elsewhere.

1. *Sparse suffixes.* Of the ``gram``-byte strings inside every ``length``-byte string, the
   one of lowest hash (leftmost among equals) is an anchor. The choice looks at the
   string alone, so both copies of a repeat have an anchor at the same place inside, and
   only suffixes at anchors have to be looked at: about two in ``length - gram`` bytes.
2. Anchors whose gram is unique in the corpus are dropped; the others fetch their context,
   ``length - gram`` bytes to the left and ``length`` from the anchor on.
3. *Common-prefix intervals.* The contexts of a gram, sorted by what follows, are a piece
   of the suffix array. One scan of their common-prefix lengths with a stack merges
   neighbours into intervals, deepest first. An interval's members are kept in the order
   of what precedes them, so that *left-extension diversity* shows between neighbours:
   two occurrences that become neighbours in an interval of depth r and share l bytes to
   the left are occurrences of one maximal repeat of l + r bytes. Comparing neighbours
   alone finds every occurrence's longest repeats, without pairs of a group.
4. Grams with more than ``crowded`` anchors are not brought together: each
   ``length``-byte string around their anchors is hashed and counted on its own, which
   finds the same repeats at more cost and spreads over all tasks.

Texts that are equal are one text here, and a text with a copy goes as a whole if it has
``length`` bytes; so a group of exact copies adds nothing to any other group.

Defined cases: null counts as empty; texts below ``length`` bytes lose nothing; repeats
inside one text count, overlapping ones too; repeated rows are copies; an empty table
gives an empty table; other columns are ignored. Kept bytes may cut a character.
"""

from __future__ import annotations

import hashlib
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.text import null_safe_key, whole
from pitpanel.session import settle

LENGTH = 400
GRAM = 100
CROWDED = 20_000
#: Bytes of a text that are hashed together; pieces overlap.
PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE_BITS = 20
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes that start at each place."""
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[length:] - sums[: n - length + 1]) * down[: n - length + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _lowest_of_runs(keys: np.ndarray, reach: int) -> np.ndarray:
    """The lowest of every ``reach`` neighbouring keys (keys are distinct)."""
    n = len(keys)
    padded = np.concatenate([keys, np.full(-n % reach, np.iinfo(keys.dtype).max, keys.dtype)])
    table = padded.reshape(-1, reach)
    head = np.minimum.accumulate(table, axis=1).ravel()
    tail = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - reach + 1], head[reach - 1: n])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes as signed longs) of a text's anchors, in order."""
    array = np.frombuffer(data, np.uint8)
    places, grams = [], []
    for begin in range(0, len(array) - length + 1, PIECE):
        piece = array[begin: begin + PIECE + length - 1]
        h = string_hashes(piece, gram)
        keys = h >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | np.arange(
            len(h), dtype=np.uint64)
        chosen = np.unique(_lowest_of_runs(keys, length - gram + 1)
                           & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        places.append(chosen + begin)
        grams.append(h[chosen])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(grams)[first].view(np.int64)


def _bytes(value: pa.Scalar) -> bytes:
    return (value.as_py() or "").encode("utf-8", "surrogatepass")


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                keys = batch.column(0).slice(at, 64).to_pylist()
                found = [anchors(_bytes(v), length, gram) for v in batch.column(1).slice(at, 64)]
                sizes = [len(p) for p, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(keys, np.int64), sizes)),
                     pa.array(np.concatenate([p for p, _ in found]).astype(np.int64)),
                     pa.array(np.concatenate([g for _, g in found]))],
                    names=["text_key", "place", "gram"])

    return run


def _fetch(length: int, gram: int):
    """Contexts of a text's anchors, and the strings around its crowded ones.

    Equal contexts of one text are one row with all their places.
    """
    before = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = (row["text"] or "").encode("utf-8", "surrogatepass")
                held: dict[tuple[int, bytes, bytes], list[int]] = {}
                crowded = []
                for place, h, many in zip(row["places"], row["grams"], row["many"]):
                    if many:
                        crowded.append(place)
                        continue
                    key = (h, data[max(0, place - before):place][::-1],
                           data[place:place + length])
                    held.setdefault(key, []).append(place)
                if held:
                    yield pa.RecordBatch.from_pydict({
                        "gram": pa.array([k[0] for k in held], pa.int64()),
                        "back": pa.array([k[1] for k in held], pa.binary()),
                        "ahead": pa.array([k[2] for k in held], pa.binary()),
                        "places": pa.array(list(held.values()), pa.list_(pa.int64())),
                        "text_key": pa.array([row["text_key"]] * len(held), pa.int64())})
                if crowded:
                    yield from _strings(row["text_key"], data, crowded)

    def _strings(key: int, data: bytes, crowded: list[int]) -> Iterator[pa.RecordBatch]:
        array = np.frombuffer(data, np.uint8)
        starts = np.unique(np.concatenate([
            np.arange(max(0, p - before), min(p, len(data) - length) + 1) for p in crowded]))
        if not len(starts):
            return
        h = np.empty(len(starts), np.uint64)
        for begin in range(0, len(array) - length + 1, PIECE):
            lo, hi = np.searchsorted(starts, [begin, begin + PIECE])
            if lo < hi:
                piece = string_hashes(array[begin: begin + PIECE + length - 1], length)
                h[lo:hi] = piece[starts[lo:hi] - begin]
        order = np.argsort(h, kind="stable")
        h, starts = h[order], starts[order]
        cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        yield pa.RecordBatch.from_pydict({
            "gram": pa.array(h[cuts].view(np.int64)),
            "back": pa.nulls(len(cuts), pa.binary()), "ahead": pa.nulls(len(cuts), pa.binary()),
            "places": pa.array(np.split(starts, cuts[1:]), pa.list_(pa.int64())),
            "text_key": pa.array(np.full(len(cuts), key))})

    return run


def _padded(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    joined = b"".join(v.ljust(width, b"\0") for v in values)
    return np.frombuffer(joined, np.uint8).reshape(len(values), width), sizes


def _shared(table: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes the rows a and b of a padded table share."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 1 << 14):
        x, y = a[at:at + (1 << 14)], b[at:at + (1 << 14)]
        differs = table[x] != table[y]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), table.shape[1])
        out[at:at + (1 << 14)] = np.minimum(first, np.minimum(sizes[x], sizes[y]))
    return out


def interval_neighbours(depths: list[int], order_back: list[int], least: int
                        ) -> tuple[list[int], list[int], list[int]]:
    """(a, b, depth): rows that become neighbours, by what precedes, in an interval.

    ``depths[i]`` is what sorted rows i - 1 and i share; the stack holds runs of rows with
    the depth that joins them to the run below. A run lists its rows in back order.
    """
    left, right, depth_of = [], [], []
    row_at = sorted(range(len(order_back)), key=order_back.__getitem__)

    def join(below: list[int], above: list[int], depth: int) -> list[int]:
        if len(below) < len(above):
            below, above = above, below
        for rank in above:
            at = bisect(below, rank)
            for other in below[max(0, at - 1): at + 1]:
                left.append(row_at[rank])
                right.append(row_at[other])
                depth_of.append(depth)
            below.insert(at, rank)
        return below

    stack: list[tuple[list[int], int]] = []
    for row, rank in enumerate(order_back):
        depth = depths[row] if depths[row] >= least else 0
        while len(stack) > 1 and stack[-1][1] > depth:
            above, joins = stack.pop()
            below, beneath = stack.pop()
            stack.append((join(below, above, joins), beneath))
        if not depth:
            stack.clear()
        stack.append(([rank], depth))
    while len(stack) > 1:
        above, joins = stack.pop()
        below, beneath = stack.pop()
        stack.append((join(below, above, joins), beneath))
    return left, right, depth_of


def covered(grams: list[int], back: list[bytes], ahead: list[bytes], counts: list[int],
            length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For sorted contexts: bytes before, and from the anchor on, inside of repeats."""
    n = len(grams)
    following, sizes = _padded(ahead, length)
    preceding, before = _padded(back, length - gram)
    rows = np.arange(n)
    depths = np.zeros(n, np.int64)
    depths[1:] = _shared(following, sizes, rows[1:], rows[:-1])
    same = np.zeros(n, bool)
    same[1:] = np.array(grams[1:]) == np.array(grams[:-1])
    depths[~same] = 0
    group = np.cumsum(~same)
    by_back = np.lexsort((preceding.view(f"S{length - gram}").ravel(), group))
    rank = np.empty(n, np.int64)
    rank[by_back] = rows
    a, b, depth = (np.array(x, np.int64) for x in interval_neighbours(
        depths.tolist(), rank.tolist(), gram))
    reach_back, reach_ahead = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(a):
        extension = _shared(preceding, before, a, b)
        long = extension + depth >= length
        for side in (a[long], b[long]):
            np.maximum.at(reach_back, side, extension[long])
            np.maximum.at(reach_ahead, side, depth[long])
    own = (np.array(counts) > 1) & (before + sizes >= length)
    return np.where(own, before, reach_back), np.where(own, sizes, reach_ahead)


def _scan(length: int, gram: int):
    """Spans of repeats from contexts sorted by gram and what follows."""
    def spans(held: dict[str, list]) -> pa.RecordBatch:
        counts = [len(p) for p in held["places"]]
        back, ahead = covered(held["gram"], held["back"], held["ahead"], counts, length, gram)
        keep = np.flatnonzero(ahead > 0)
        keys = np.repeat(np.array(held["text_key"], np.int64)[keep], np.array(counts)[keep])
        places = np.concatenate([np.empty(0, np.int64), *(held["places"][k] for k in keep)])
        each = np.repeat(keep, np.array(counts)[keep])
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array((places - back[each]).astype(np.int64)),
             pa.array((places + ahead[each]).astype(np.int64))],
            names=["text_key", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                for name, values in batch.slice(at, 8192).to_pydict().items():
                    held.setdefault(name, []).extend(values)
                last = held["gram"][-1]
                done = len(held["gram"])
                while done and held["gram"][done - 1] == last:
                    done -= 1
                if done:
                    yield spans({k: v[:done] for k, v in held.items()})
                    held = {k: v[done:] for k, v in held.items()}
        if held.get("gram"):
            yield spans(held)

    return run


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, spans, texts).

    documents: (key, text_key, n_bytes, copies, sha256), one row per document; spans:
    (text_key, spans) of texts with repeats, sorted and disjoint; texts: (text_key, text)
    that hold at least those.
    """
    rows = docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text")) \
        .withColumn("text_key", F.xxhash64("text", F.octet_length("text")))
    listed = settle(rows.select(
        "key", "text_key", F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("sha256")))
    found = settle(rows.filter(F.octet_length("text") >= length).select("text_key", "text")
                   .mapInArrow(_anchor_rows(length, gram),
                               "text_key bigint, place bigint, gram bigint"))
    places = found.groupBy("gram", "text_key", "place").agg(F.lit(1).alias("one"))
    grams = places.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = places.join(grams, "gram").groupBy("text_key").agg(F.collect_list(F.struct(
        "place", "gram", (F.col("n") > crowded).alias("many"))).alias("a"))
    # Of equal texts, one document brings the text.
    bringing = listed.groupBy("text_key").agg(F.min(null_safe_key(F.col("key"))).alias("row"))
    asked = shared.join(bringing, "text_key").select(
        "text_key", "row", F.col("a.place").alias("places"), F.col("a.gram").alias("grams"),
        F.col("a.many").alias("many"))
    texts = settle(rows.withColumn("row", null_safe_key(F.col("key")))
                   .join(asked, ["text_key", "row"]).drop("key", "row")
                   .dropDuplicates(["text_key"]))
    contexts = texts.mapInArrow(
        _fetch(length, gram),
        "gram bigint, back binary, ahead binary, places array<bigint>, text_key bigint")
    contexts = settle(contexts)
    spans = contexts.filter("ahead IS NOT NULL").repartition("gram") \
        .sortWithinPartitions("gram", "ahead").mapInArrow(
            _scan(length, gram), "text_key bigint, start bigint, end bigint")
    strings = contexts.filter("ahead IS NULL").select("gram", "text_key", "places")
    twice = strings.groupBy("gram").agg(F.sum(F.size("places")).alias("n")).filter("n > 1")
    more = strings.join(twice, "gram").select("text_key", F.explode("places").alias("start")) \
        .withColumn("end", F.col("start") + length)
    merged = spans.unionByName(more).groupBy("text_key").agg(F.sort_array(
        F.collect_set(F.struct("start", "end"))).alias("raw")) \
        .mapInArrow(_union, "text_key bigint, spans array<struct<start:bigint,end:bigint>>")
    copies = listed.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"))
    return listed.join(copies, "text_key"), settle(merged), texts.select("text_key", "text")


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spans with overlapping and touching ones as one."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        out = []
        for raw in batch.column(1).to_pylist():
            runs: list[dict] = []
            for span in raw:
                if runs and span["start"] <= runs[-1]["end"]:
                    runs[-1]["end"] = max(runs[-1]["end"], span["end"])
                else:
                    runs.append(dict(span))
            out.append(runs)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)],
                                         names=["text_key", "spans"])


def kept_bytes(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_key, spans, kept): the bytes of each text outside of its spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for value, runs in zip(batch.column(2), batch.column(1).to_pylist()):
                data, at, parts = _bytes(value), 0, []
                for span in runs:
                    parts.append(data[at:span["start"]])
                    at = span["end"]
                kept.append(b"".join([*parts, data[at:]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(kept, pa.binary())],
                names=["text_key", "spans", "kept"])

    return spans.join(texts, "text_key").select("text_key", "spans", "text").mapInArrow(
        run, "text_key bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
             gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """(key, n_bytes, spans, kept_sha256), one row per document."""
    listed, spans, texts = repeated_spans(docs, key, text, length, gram, crowded)
    kept = kept_bytes(spans, texts).select(
        "text_key", "spans", F.sha2("kept", 256).alias("kept_sha256"))
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"),
                             F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return listed.join(kept, "text_key", "left").select(
        "key", "n_bytes",
        F.when(gone, every).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest()))
        .otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"))
