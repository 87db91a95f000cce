"""SimHash near-duplicate groups by pigeonhole blocks.

A text's fingerprint has bit k set when over half of its shingle hashes have bit k
set. Fingerprints of at most ``distance`` differing bits are linked, and linked
documents form components.

Links without all pairs: equal fingerprints are one row. The 64 bits are split in
``m`` blocks; two close fingerprints differ in at most ``distance`` blocks, so they
agree on the rest, and each choice of ``m - distance`` blocks is one bucket key.
``m`` follows from the number of fingerprints by :func:`block_count`, so that a key
has about as many values as there are fingerprints: buckets stay small at any
size. Inside a bucket every pair is verified, either directly or, in buckets of a
dense group, by a search that takes linked fingerprints out of those still to be
looked at; it emits one link per member instead of all pairs.

Defined cases: null and wordless texts have fingerprint zero and are linked like any
other; shorter texts than a shingle hash their whole word sequence; repeated rows
and equal texts share a fingerprint; a null ``doc_id`` is never a component's
smallest unless all its ids are null; an empty table gives an empty table; other
columns are ignored by :func:`components` and kept by :func:`deduplicate`. The same holds
for :func:`near_components` and :func:`drop_near`; very long texts are hashed whole, in
parts; ties of a group's smallest key go to the row that comes first by text hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.text import free_name, whole
from pitpanel.session import settle

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Buckets up to this size compare their pairs directly.
SMALL_BUCKET = 48
#: Hashes whose bits are counted at a time.
COUNTED = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one whole text, as an unsigned integer."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(tokens) - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    total, counts = len(starts), np.zeros(64, np.int64)
    for at in range(0, total, COUNTED):
        part = np.array([digest(joined[a:b], seed) for a, b in
                         zip(starts[at:at + COUNTED], ends[at:at + COUNTED])], "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    set_bits = np.packbits(counts * 2 > total, bitorder="little")
    return int(set_bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), "<u8",
                             batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(values.view("<i8"))], names=["key", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): one row per document; fp holds the unsigned bits in a long."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints, f"key {kind}, fp bigint")


def block_count(n: int, distance: int = DISTANCE) -> int:
    """The fewest blocks for which a bucket key has at least ``n`` values."""
    m = distance + 2
    while m < 16 and 2 ** (64 * (m - distance) / m) < n:
        m += 1
    return m


def block_masks(m: int, distance: int = DISTANCE) -> list[int]:
    """One 64-bit mask for every choice of ``m - distance`` of ``m`` blocks."""
    edges = [round(64 * k / m) for k in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(blocks, m - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _search(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(member, smallest of its group) for the groups inside one bucket."""
    found, left = [], members
    while len(left) > 1:
        seed, left, queue = left[0], left[1:], [left[0]]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= distance
            if near.any():
                reached = left[near]
                queue.extend(reached)
                found.extend((int(x), int(seed)) for x in reached)
                left = left[~near]
    return found


def bucket_links(masked: np.ndarray, values: np.ndarray, distance: int = DISTANCE,
                 small: int = SMALL_BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller) of rows sorted by bucket key and value (unsigned)."""
    starts = np.flatnonzero(np.r_[True, masked[1:] != masked[:-1]])
    sizes = np.diff(np.r_[starts, len(masked)])
    bucket = np.repeat(np.arange(len(starts)), sizes)
    a, b = [], []
    direct = np.repeat((sizes > 1) & (sizes <= small), sizes)
    rows, group = values[direct], bucket[direct]
    for step in range(1, int(sizes[(sizes > 1) & (sizes <= small)].max(initial=1))):
        close = (group[step:] == group[:-step]) & (
            np.bitwise_count(rows[step:] ^ rows[:-step]) <= distance)
        a.append(rows[step:][close])
        b.append(rows[:-step][close])
    for start, size in zip(starts[sizes > small], sizes[sizes > small]):
        found = _search(values[start:start + size], distance)
        if found:
            pairs = np.array(found, "<u8")
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    none = np.empty(0, "<u8")
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _linker(masks: list[int], distance: int):
    by_choice = np.array(masks, "<u8")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        choice = table.column("choice").to_numpy()
        values = np.ascontiguousarray(table.column("fp").to_numpy()).view("<u8")
        masked = values & by_choice[choice]
        order = np.lexsort((values, masked, choice))
        choice, masked, values = choice[order], masked[order], values[order]
        for c in np.unique(choice):
            lo, hi = np.searchsorted(choice, [c, c + 1])
            a, b = bucket_links(masked[lo:hi], values[lo:hi], distance)
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view("<i8")), pa.array(b.view("<i8"))], names=["a", "b"])

    return linked


def links(distinct: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links that connect what is connected, from one row per fingerprint.

    A task holds 12 bytes a row of its partition; partitions follow the session's
    shuffle settings.
    """
    masks = block_masks(block_count(n, distance), distance)
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(
        F.lit(_signed(mask))).alias("bucket")) for i, mask in enumerate(masks)])
    rows = distinct.select("fp", F.explode(choices).alias("c")) \
        .select("fp", F.col("c.choice").alias("choice"), F.col("c.bucket").alias("bucket"))
    dealt = rows.repartition("choice", "bucket").select("choice", "fp")
    return dealt.mapInArrow(_linker(masks, distance), "a bigint, b bigint").distinct()


def connect(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of an edge can reach.

    Alternating star contraction: every round hangs a node's larger neighbours, then
    its smaller ones, under its smallest neighbour, until only stars are left. Every
    round is written to the shared folder, which cuts the lineage.
    """
    state = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .filter("u <> v").distinct())
    seen = None
    for _ in range(most_rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"),
                                                           F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        state = settle(small)
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))) \
            .first()
        if mark == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")) \
                .unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root"))) \
                .distinct()
        seen = mark
    raise RuntimeError("components did not settle")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text",
               distance: int = DISTANCE) -> DataFrame:
    """(key, fp, root, component): fingerprint, smallest reachable fingerprint and key."""
    prints = settle(fingerprints(docs, key, text))
    distinct = settle(prints.groupBy("fp").agg(F.min("key").alias("first")))
    roots = connect(links(distinct, distinct.count(), distance))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    classes = settle(rooted.select("fp", "root").join(smallest, "root"))
    return prints.join(classes, "fp", "left")


# -- near copies by similarity ----------------------------------------------------------
#
# Fingerprints of 64 bits don't tell a similarity of 0.8: such pairs differ by about 10
# bits, give or take 3, too many for blocks to be selective. The same method works on
# longer ones: of 2,048 bits a pair at 0.8 differs in 15 %, give or take 0.8 %, so the
# distance states the similarity, and blocks of 20 bits are many: a close pair agrees in
# one of the 102 with a chance of 0.98 at 0.8, and of 0.9999 at 0.9.

WIDE_BITS = 2048
WIDE_BLOCK = 20
WIDE_SHINGLE = 5
LEAST_SIMILARITY = 0.8
#: Allowance for what the distance leaves open: one deviation of the estimate.
ALLOWANCE = 0.012
#: Of the first 64 bits, those that candidates may differ in: 3.5 deviations from 0.8.
FIRST_LOOK = 20
_SEEDS = np.random.default_rng(SEED).integers(1, 2 ** 63, WIDE_BITS // 64, dtype=np.uint64) \
    | np.uint64(1)
#: Even sets can have as many ones as zeros; every other bit is then one.
_TIES = np.tile(np.array([0, 1], np.int64), WIDE_BITS // 2)


def wide_fingerprint(text: str | None) -> tuple[int, bytes, int]:
    """(key of the word sequence, fingerprint of 2,048 bits, distinct shingles)."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(tokens)
    key = xxhash.xxh64_intdigest(joined, SEED) if tokens else 0
    if not tokens:
        return key, bytes(WIDE_BITS // 8), 0
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(lengths) - 1
    last = max(1, len(tokens) - WIDE_SHINGLE + 1)
    starts = (ends - lengths + 1)[:last].tolist()
    stops = ends[min(WIDE_SHINGLE, len(tokens)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)],
                                np.uint64))
    counts = np.zeros(WIDE_BITS, np.int64)
    for at in range(0, len(hashes), 512):
        # Multiply, then fold the high half down: 32 words of bits for each shingle.
        z = hashes[at:at + 512, None] * _SEEDS
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(29)
        bits = np.unpackbits(z.view(np.uint8).reshape(len(z), -1), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    ones = counts * 2 + _TIES > len(hashes)
    return key, np.packbits(ones, bitorder="little").tobytes(), len(hashes)


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [wide_fingerprint(x.as_py()) for x in batch.column(1)]
        keys = np.array([f[0] for f in found], "<u8").view("<i8")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys), pa.array([f[1] for f in found], pa.binary()),
             pa.array([f[2] for f in found], pa.int64())], names=["key", "node", "fp", "n"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, node, look): one row for every block of a fingerprint."""
    n_blocks = WIDE_BITS // WIDE_BLOCK
    weights = np.left_shift(1, np.arange(WIDE_BLOCK), dtype=np.int64)
    numbers = np.arange(n_blocks, dtype=np.int64) << WIDE_BLOCK
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            data = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8) \
                .reshape(part.num_rows, -1)
            bits = np.unpackbits(data, axis=1, bitorder="little", count=n_blocks * WIDE_BLOCK)
            values = bits.reshape(len(bits), n_blocks, WIDE_BLOCK).astype(np.int64) @ weights
            look = np.ascontiguousarray(data[:, :8]).view("<i8").ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array((values | numbers).ravel()),
                 pa.array(np.repeat(part.column(0).to_numpy(), n_blocks)),
                 pa.array(np.repeat(look, n_blocks))], names=["bucket", "node", "look"])


def _near_in_bucket(looks: np.ndarray) -> list[tuple[int, int]]:
    """Links (from, to) of positions that connect all that first looks connect.

    Searched from the member nearest to the majority of all bits: edited copies are
    closer to their original than to each other, and every block has the same original.
    A dense group costs one link for each member, and no close pair is left apart.
    """
    found: list[tuple[int, int]] = []
    left = np.arange(len(looks))
    while len(left) > 1:
        bits = np.unpackbits(looks[left].view(np.uint8).reshape(-1, 8), axis=1)
        most = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(left)).view("<u8")[0]
        hub = int(np.bitwise_count(looks[left] ^ most).argmin())
        queue, left = [left[hub]], np.delete(left, hub)
        while queue and len(left):
            at = queue.pop(0)
            near = np.bitwise_count(looks[left] ^ looks[at]) <= FIRST_LOOK
            if near.any():
                reached, left = left[near], left[~near]
                queue.extend(reached)
                found.extend((int(at), x) for x in reached.tolist())
    return found


def _by_bucket(each: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """Runs on rows sorted by bucket, whole buckets at a time: a batch and one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            if not len(bucket):
                continue
            # The last bucket of a batch may go on in the next one.
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if cut:
                yield from each(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and held[-1].column(0)[0].as_py() != bucket[0]:
                yield from each(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from each(pa.Table.from_batches(held))

    return run


def _spans(bucket: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of the buckets of two rows and more."""
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if hi - lo > 1:
            yield lo, hi


def _close(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """(bucket, node, partner, size) of members that are close at first look to another.

    Partners connect the bucket; the start of a search is its own.
    """
    bucket, nodes = (table.column(c).to_numpy() for c in ("bucket", "node"))
    looks = np.ascontiguousarray(table.column("look").to_numpy()).view("<u8")
    rows: list[tuple[int, int, int]] = []
    for lo, hi in _spans(bucket):
        found = _near_in_bucket(looks[lo:hi])
        starts = {a for a, _ in found} - {b for _, b in found}
        rows.extend((lo + b, lo + a, hi - lo) for a, b in found)
        rows.extend((lo + a, lo + a, hi - lo) for a in starts)
    x, y, size = np.array(rows, np.int64).reshape(-1, 3).T
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[x]), pa.array(nodes[x]), pa.array(nodes[y]), pa.array(size)],
        names=["bucket", "node", "partner", "size"])


def _alike(fa: np.ndarray, fb: np.ndarray, na: np.ndarray, nb: np.ndarray,
           least: float) -> np.ndarray:
    """Whether fingerprints tell a similarity of ``least`` or more."""
    away = np.bitwise_count(fa ^ fb).sum(axis=1, dtype=np.int64) / WIDE_BITS
    shared = np.cos(np.pi * away) * np.sqrt(na * nb)
    return shared >= least * (na + nb - shared)


def _joined(fp: np.ndarray, n: np.ndarray, roots: np.ndarray,
            least: float) -> list[tuple[int, int]]:
    """Positions of two roots that a similar pair connects: a link for each root reached."""
    found: list[tuple[int, int]] = []
    left = np.arange(len(fp))
    while len(left):
        start = roots[left[0]]
        queue, left = left[roots[left] == start].tolist(), left[roots[left] != start]
        while queue and len(left):
            at = queue.pop()
            near = left[_alike(fp[left], fp[at][None, :], n[left], n[at], least)]
            if len(near):
                named, first = np.unique(roots[near], return_index=True)
                found.extend((int(at), int(near[k])) for k in first)
                reached = np.isin(roots[left], named)
                queue.extend(left[reached].tolist())
                left = left[~reached]
    return found


def _searched(least: float):
    def each(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, nodes, roots = (table.column(c).to_numpy() for c in ("bucket", "node", "root"))
        n = table.column("n").to_numpy()
        fp = np.frombuffer(b"".join(table.column("fp").to_pylist()), "<u8") \
            .reshape(len(nodes), -1)
        pairs = [(nodes[lo + a], nodes[lo + b]) for lo, hi in _spans(bucket)
                 for a, b in _joined(fp[lo:hi], n[lo:hi], roots[lo:hi], least)]
        a, b = np.array(pairs, "<i8").reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return each


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fa, fb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u8")
                      .reshape(batch.num_rows, -1) for k in (2, 3))
            na, nb = (batch.column(k).to_numpy() for k in (4, 5))
            yield batch.select(["a", "b"]).filter(pa.array(_alike(fa, fb, na, nb, least)))

    return run


def near_links(nodes: DataFrame, least: float) -> DataFrame:
    """(a, b): links that connect all similar nodes (node, fp, n) that agree in a block.

    First, every node that is close to another at first look tries one partner, that of
    its largest bucket; what is similar becomes one group, so a dense group falls
    together at a row for each member, whatever its pairs. Then the close members of
    every bucket are searched by whole fingerprints, but for members of one group.
    """
    rows = nodes.select("node", "fp").mapInArrow(_blocks, "bucket bigint, node bigint, look bigint")
    close = settle(rows.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(
        _by_bucket(_close), "bucket bigint, node bigint, partner bigint, size bigint"))
    # A row for each node, its buckets in an array: at most one for each block.
    active = settle(nodes.join(close.groupBy("node").agg(
        F.collect_list("bucket").alias("buckets")), "node"))
    chosen = close.filter("node <> partner").groupBy(F.col("node").alias("a")).agg(
        F.min_by("partner", F.struct(-F.col("size"), "partner")).alias("b"))
    sides = [active.select(F.col("node").alias(c), F.col("fp").alias(f"fp_{c}"),
                           F.col("n").alias(f"n_{c}")) for c in "ab"]
    first = settle(chosen.join(sides[0], "a").join(sides[1], "b")
                   .select("a", "b", "fp_a", "fp_b", "n_a", "n_b")
                   .mapInArrow(_similar(least), "a bigint, b bigint"))
    rest = active.join(connect(first), "node", "left").select(
        F.explode("buckets").alias("bucket"), "node",
        F.coalesce("root", "node").alias("root"), "fp", "n")
    last = rest.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(
        _by_bucket(_searched(least)), "a bigint, b bigint")
    return first.unionByName(settle(last))


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    least: float = LEAST_SIMILARITY) -> DataFrame:
    """(key, node, component): groups of texts whose word shingles are similar.

    Two texts are linked when the Jaccard similarity of their sets of five-word shingles
    is ``least`` or more, as the distance of their wide fingerprints tells it. Equal word
    sequences, letter case of A-Z aside, are one node; wordless texts are node 0.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    prints = settle(rows.mapInArrow(_wide, f"key {kind}, node bigint, fp binary, n bigint"))
    nodes = settle(prints.select("node", "fp", "n").dropDuplicates(["node"]))
    roots = connect(near_links(nodes.filter("n > 0"), least - ALLOWANCE))
    firsts = prints.groupBy("node").agg(F.min("key").alias("first"))
    rooted = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    classes = settle(rooted.select("node", "root").join(smallest, "root").drop("root"))
    return prints.select("key", "node").join(classes, "node", "left")


def drop_near(docs: DataFrame, key: str = "doc_id", text: str = "text",
              least: float = LEAST_SIMILARITY) -> DataFrame:
    """One document of each group of similar texts, chosen as :func:`deduplicate` does."""
    return _firsts(docs, key, text, lambda keyed, mark: near_components(
        keyed, mark, text, least))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text",
                distance: int = DISTANCE) -> DataFrame:
    """One document of each component: the smallest key's, one row of repeated rows.

    Rows are told apart by key and text, so rows that share a key and not their text
    can be in different components; null keys come last.
    """
    return _firsts(docs, key, text, lambda keyed, mark: components(keyed, mark, text, distance))


def _firsts(docs: DataFrame, key: str, text: str,
            group: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    mark, kept = free_name(docs, "_simhash_row", "_simhash_kept")
    keyed = docs.withColumn(mark, F.struct(
        F.col(key).isNull().alias("none"), F.col(key).alias("id"),
        F.xxhash64(whole(F.col(text))).alias("text")))
    found = group(keyed, mark)
    first = found.filter(F.col("key") == F.col("component")).select(
        F.xxhash64("key.none", "key.id", "key.text").alias(kept)).distinct()
    rows = keyed.withColumn(mark, F.xxhash64(f"{mark}.none", f"{mark}.id", f"{mark}.text"))
    return rows.join(first, F.col(mark) == F.col(kept), "left_semi") \
        .dropDuplicates([mark]).select(*docs.columns)
