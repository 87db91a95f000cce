"""Boosted trees of many folds at once, from histograms, with early stopping.

All folds grow their trees side by side over one table. A level of a tree is one pass:
every task turns its rows into sums of gradients per (fold, node, feature, bin), the sums
of all tasks are added, and the driver, which gets a table of fixed size per fold, picks
the splits. Trees are only ever added: a row's margin under the trees so far is a settled
column, and the few trees since then are applied on the fly. Nothing is fitted twice, and
a fold whose patience has run out takes no further part.

The table is held in blocks of many rows of one fold and side, a feature's bins side by
side, so a pass works on whole arrays and a tree is a few comparisons of bytes. Below the
root only the smaller child of a node is summed: its sibling is what the node has besides.
Features that a tree doesn't draw are not summed.

Rows have no missing value imputed: missing is a bin of its own, and every split learns
the side it goes to. The loss on the stopping rows is summed in the pass that begins the
next tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.operators.ordered import exact_quantiles
from pitpanel.session import settle

#: Bins of a feature besides that of missing values.
MAX_BINS = 128
#: Trees after which margins are written again.
SETTLE_EVERY = 50
#: Rows from which a block of the table is closed.
BLOCK_ROWS = 1 << 14
_TRAIN, _STOP = 1, 2


@dataclass(frozen=True)
class TreeOptions:
    max_trees: int = 2000
    patience: int = 50
    depth: int = 3
    step: float = 0.05
    min_leaf: int = 50
    row_share: float = 0.8
    column_share: float = 0.8
    l1: float = 1.0
    l2: float = 5.0
    seed: int = 42


@dataclass
class Tree:
    """A complete tree: inner nodes in level order, then the leaves' values.

    ``feature`` is -1 where a node isn't split; its rows all go left.
    """

    feature: np.ndarray
    upto: np.ndarray
    missing_left: np.ndarray
    values: np.ndarray

    def _right(self, node: int, bins: np.ndarray) -> np.ndarray:
        if self.feature[node] < 0:
            return np.zeros(bins.shape[1], bool)
        own, upto = bins[self.feature[node]], np.uint8(self.upto[node])
        # Bin 0 is missing; one less makes it the largest byte, on the right of any cut.
        return own > upto if self.missing_left[node] else own - np.uint8(1) >= upto

    def leaf(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Each row's node ``levels`` below the root; ``bins`` has a line per feature."""
        node = np.zeros(bins.shape[1], np.uint16)
        for level in range(levels):
            first = 2 ** level - 1
            right = self._right(first, bins)
            for at in range(1, 2 ** level):
                right ^= (right ^ self._right(first + at, bins)) & (node == at)
            node = node * np.uint16(2) + right
        return node


@dataclass
class Ensemble:
    """The trees of one fold; ``best`` of them count."""

    start: float
    edges: list[np.ndarray]
    options: TreeOptions
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    best: int = 0
    stopped: bool = False

    def bin(self, x: np.ndarray) -> np.ndarray:
        """Bins of rows of values, a line per feature."""
        out = np.zeros(x.shape[::-1], np.uint8)
        for k, edges in enumerate(self.edges):
            known = ~np.isnan(x[:, k])
            out[k, known] = np.searchsorted(edges, x[known, k], "left") + 1
        return out

    def note_loss(self, loss: float) -> None:
        """Loss after the latest tree; stops when the best is ``patience`` trees old."""
        self.losses.append(loss)
        if self.best == 0 or loss < self.losses[self.best - 1]:
            self.best = len(self.losses)
        elif len(self.losses) - self.best >= self.options.patience:
            self.stopped = True


def _margin(trees: Sequence[Tree], bins: np.ndarray, depth: int) -> np.ndarray:
    total = np.zeros(bins.shape[1])
    for tree in trees:
        total += tree.values.take(tree.leaf(bins, depth))
    return total


# -- sums of one pass -------------------------------------------------------------------

def _mixed(place: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on a row and a tree alone."""
    with np.errstate(over="ignore"):
        z = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) / 2.0 ** 64


@dataclass
class _Growing:
    """What a pass needs of a fold: the trees not settled and the one that grows.

    ``slots`` gives each node of the level its place in the sums, -1 where the node is
    known from its parent and its sibling.
    """

    recent: list[Tree]
    options: TreeOptions
    tree: Tree
    columns: list[int]
    widths: list[int]
    slots: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    @property
    def n_slots(self) -> int:
        return int(self.slots.max()) + 1

    @property
    def starts(self) -> np.ndarray:
        """Where each drawn feature's sums begin; the last is their number."""
        return np.r_[0, np.cumsum([self.widths[k] for k in self.columns])] * self.n_slots


@dataclass
class _Block:
    bins: np.ndarray
    y: np.ndarray
    place: np.ndarray
    margin: np.ndarray

    def take(self, chosen: np.ndarray) -> _Block:
        at = np.flatnonzero(chosen)
        return _Block(self.bins[:, at], self.y[at], self.place[at], self.margin[at])


def _add_loss(growing: _Growing, block: _Block, sums: np.ndarray) -> None:
    """The stop loss goes to the last slot."""
    margin = block.margin + _margin(growing.recent, block.bins, growing.options.depth)
    # log(1 + exp(-m)) for label 1 and log(1 + exp(m)) for label 0.
    sums[-1, 0] += np.logaddexp(0, np.where(block.y == 1, -margin, margin)).sum()
    sums[-1, 2] += len(margin)


def _add_block(growing: _Growing, block: _Block, level: int, number: int,
               sums: np.ndarray) -> None:
    """Adds (gradient, hessian, count) per drawn feature, slot and bin."""
    options = growing.options
    block = block.take(
        _mixed(block.place, options.seed * 1_000_003 + number) < options.row_share)
    slot = None
    if level:
        slot = growing.slots.take(growing.tree.leaf(block.bins, level))
        block, slot = block.take(slot >= 0), slot[slot >= 0]
    margin = block.margin + _margin(growing.recent, block.bins, options.depth)
    p = 1.0 / (1.0 + np.exp(-margin))
    weights = (block.y - p, p * (1 - p), None)
    starts = growing.starts
    for k, first, end in zip(growing.columns, starts, starts[1:]):
        at = block.bins[k].astype(np.int64)
        if slot is not None:
            at += slot * growing.widths[k]
        for c, w in enumerate(weights):
            sums[first:end, c] += np.bincount(at, w, minlength=end - first)


def _pass(blocks: DataFrame, growing: dict[int, _Growing], level: int,
          number: int) -> dict[int, np.ndarray]:
    """One pass over the blocks of the growing folds: fold -> sums."""
    shared = blocks.sparkSession.sparkContext.broadcast(growing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, side, block in _read_blocks(batch):
                mine = models[fold]
                own = sums.setdefault(fold, np.zeros((int(mine.starts[-1]) + 1, 3)))
                if side == _STOP:
                    _add_loss(mine, block, own)
                else:
                    _add_block(mine, block, level, number, own)
        yield _as_batch(sums)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(data.as_buffer(), np.float64).reshape(-1, 3)
                sums[fold] = sums[fold] + part if fold in sums else part
        yield _as_batch(sums)

    kind = "fold int, sums binary"
    read = blocks.where(F.col("fold").isin(*growing))
    if level:
        read = read.where(F.col("side") == _TRAIN)
    found = read.mapInArrow(run, kind).repartition(len(growing), "fold") \
        .mapInArrow(total, kind).collect()
    shared.unpersist()
    return {r.fold: np.frombuffer(r.sums, np.float64).reshape(-1, 3) for r in found}


def _as_batch(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(sums.keys(), pa.int32()),
         pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["fold", "sums"])


# -- growing ----------------------------------------------------------------------------

def _soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _gain(s: np.ndarray, o: TreeOptions) -> np.ndarray:
    return _soft(s[..., 0], o.l1) ** 2 / (s[..., 1] + o.l2)


def _value(s: np.ndarray, o: TreeOptions) -> float:
    return float(o.step * _soft(s[0], o.l1) / (s[1] + o.l2))


def _best_split(cells: dict[int, np.ndarray], columns: Sequence[int], o: TreeOptions):
    """(feature, upto, missing left, left sums, right sums) of one node, or None."""
    best, found = 1e-12, None
    for k in columns:
        missing, ordered = cells[k][0], cells[k][1:]
        whole = cells[k].sum(axis=0)
        below = np.cumsum(ordered, axis=0)[:-1]
        for missing_left in (True, False):
            left = below + missing if missing_left else below
            right = whole - left
            fits = (left[:, 2] >= o.min_leaf) & (right[:, 2] >= o.min_leaf)
            if not fits.any():
                continue
            gain = np.where(fits, _gain(left, o) + _gain(right, o) - _gain(whole, o), -np.inf)
            at = int(gain.argmax())
            if gain[at] > best:
                best, found = gain[at], (k, at + 1, missing_left, left[at], right[at])
    return found


def _cells(growing: _Growing, sums: np.ndarray, level: int,
           parents: list[dict[int, np.ndarray]]) -> list[dict[int, np.ndarray]]:
    """Per node of a level: drawn feature -> sums per bin.

    A node without a slot is its parent without its sibling; bins without rows there are
    exactly zero, as if they had been summed.
    """
    starts = growing.starts
    summed = [{k: sums[a:b].reshape(growing.n_slots, -1, 3)[slot]
               for k, a, b in zip(growing.columns, starts, starts[1:])}
              for slot in range(growing.n_slots)]
    nodes: list[dict[int, np.ndarray]] = []
    for node, slot in enumerate(growing.slots):
        if slot >= 0:
            nodes.append(summed[slot])
            continue
        sibling = summed[growing.slots[node ^ 1]]
        rest = {k: whole - sibling[k] for k, whole in parents[node // 2].items()}
        nodes.append({k: np.where(r[:, 2:] > 0, r, 0.0) for k, r in rest.items()})
    return nodes


def _grow(growing: _Growing, nodes: list[dict[int, np.ndarray]], level: int) -> None:
    """Splits the nodes of one level; the last one gives the leaves their values.

    Of each pair of children the smaller one gets a slot in the next level's sums.
    """
    o, tree, first = growing.options, growing.tree, 2 ** level - 1
    slots = np.full(2 * len(nodes), -1)
    for node, cells in enumerate(nodes):
        split = _best_split(cells, growing.columns, o)
        parts = (cells[growing.columns[0]].sum(axis=0), np.zeros(3))
        if split is not None:
            tree.feature[first + node], tree.upto[first + node] = split[0], split[1]
            tree.missing_left[first + node] = split[2]
            parts = split[3:]
        slots[node * 2 + int(parts[1][2] <= parts[0][2])] = node
        if level == o.depth - 1:
            tree.values[node * 2:node * 2 + 2] = [_value(s, o) for s in parts]
    growing.slots = slots


def fit(rows: DataFrame, features: Sequence[str], *, fold: str = "fold",
        label: str = "label_yoy", side: str = "side",
        options: TreeOptions = TreeOptions()) -> dict[int, Ensemble]:
    """Fold -> ensemble, from rows whose ``side`` is train or stop; labels are 0 or 1."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f).alias("x"))
                      for k, f in enumerate(features)])
    train = rows.where(F.col(side) == "train")
    long = train.select(fold, F.explode(cells).alias("c")).select(fold, "c.k", "c.x")
    edges: dict[int, list[list[float]]] = {}
    for r in exact_quantiles(long, "x", [i / MAX_BINS for i in range(1, MAX_BINS)],
                             [fold, "k"]).collect():
        edges.setdefault(r[fold], [[] for _ in features])[r["k"]].append(r["quantile"])
    rates = {r[fold]: r["rate"] for r in train.groupBy(fold).agg(
        F.avg(F.col(label).cast("double")).alias("rate")).collect()}
    ensembles = {}
    for one, rate in sorted(rates.items()):
        p = min(max(rate, 1e-9), 1 - 1e-9)
        ensembles[one] = Ensemble(
            float(np.log(p / (1 - p))),
            [np.unique(e) for e in edges.get(one, [[] for _ in features])], options)
    blocks = settle(_blocks(rows, features, fold, label, side, ensembles))
    widths = {one: [len(e) + 2 for e in ensemble.edges] for one, ensemble in ensembles.items()}
    settled = 0

    def begin(one: int, number: int) -> _Growing:
        rng = np.random.default_rng([options.seed, int(one), number])
        wanted = max(1, round(options.column_share * len(features)))
        inner = 2 ** options.depth - 1
        return _Growing(ensembles[one].trees[settled:], options,
                        Tree(np.full(inner, -1), np.zeros(inner, int), np.ones(inner, bool),
                             np.zeros(inner + 1)),
                        rng.choice(len(features), wanted, replace=False).tolist(), widths[one])

    def note(found: dict[int, np.ndarray]) -> None:
        for one, sums in found.items():
            ensembles[one].note_loss(sums[-1, 0] / max(sums[-1, 2], 1))

    for number in range(options.max_trees):
        growing = {f: begin(f, number) for f, e in ensembles.items() if not e.stopped}
        nodes: dict[int, list] = {one: [] for one in growing}
        for level in range(options.depth):
            found = _pass(blocks, growing, level, number)
            if level == 0 and number:
                note(found)
                growing = {f: g for f, g in growing.items() if not ensembles[f].stopped}
                if not growing:
                    return ensembles
            for one, mine in growing.items():
                nodes[one] = _cells(mine, found[one], level, nodes[one])
                _grow(mine, nodes[one], level)
        for one, mine in growing.items():
            ensembles[one].trees.append(mine.tree)
        if (number + 1) % SETTLE_EVERY == 0:
            blocks = settle(_with_margins(blocks, ensembles, settled))
            settled = number + 1
    note(_pass(blocks, {f: begin(f, options.max_trees) for f, e in ensembles.items()
                        if not e.stopped}, 0, options.max_trees))
    return ensembles


# -- blocks -----------------------------------------------------------------------------

_BLOCK_SCHEMA = "fold int, side int, bins binary, y binary, place binary, margin binary"
_BLOCK_COLUMNS = ["fold", "side", "bins", "y", "place", "margin"]


def _read_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, _Block]]:
    for fold, side, bins, y, place, margin in zip(*batch.columns):
        labels = np.frombuffer(y.as_buffer(), np.uint8)
        yield fold.as_py(), side.as_py(), _Block(
            np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, len(labels)), labels,
            np.frombuffer(place.as_buffer(), np.int64),
            np.frombuffer(margin.as_buffer(), np.float64))


def _write_block(fold: int, side: int, block: _Block) -> pa.RecordBatch:
    parts = [block.bins, block.y, block.place, block.margin]
    return pa.RecordBatch.from_arrays(
        [pa.array([fold], pa.int32()), pa.array([side], pa.int32()),
         *[pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts]],
        names=_BLOCK_COLUMNS)


def _blocks(rows: DataFrame, features: Sequence[str], fold: str, label: str, side: str,
            ensembles: dict[int, Ensemble]) -> DataFrame:
    """What passes read of the rows, many rows of one fold and side in a block."""
    shared = rows.sparkSession.sparkContext.broadcast(ensembles)
    n, limit = len(features), BLOCK_ROWS

    def joined(one: int, parts: list[_Block]) -> _Block:
        place = np.concatenate([p.place for p in parts])
        return _Block(np.concatenate([p.bins for p in parts], axis=1),
                      np.concatenate([p.y for p in parts]), place,
                      np.full(len(place), shared.value[one].start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list[_Block]] = {}
        for batch in batches:
            folds, sides, y, place = (batch.column(k).to_numpy() for k in range(4))
            x = np.column_stack([batch.column(4 + k).to_numpy(zero_copy_only=False)
                                 for k in range(n)]).astype(float)
            for one in np.unique(folds).tolist():
                for which in (_TRAIN, _STOP):
                    here = np.flatnonzero((folds == one) & (sides == which))
                    if not len(here):
                        continue
                    parts = waiting.setdefault((one, which), [])
                    parts.append(_Block(shared.value[one].bin(x[here]),
                                        y[here].astype(np.uint8), place[here], np.array([])))
                    if sum(len(p.y) for p in parts) >= limit:
                        yield _write_block(one, which, joined(one, waiting.pop((one, which))))
        for (one, which), parts in waiting.items():
            yield _write_block(one, which, joined(one, parts))

    chosen = rows.where(F.col(side).isin("train", "stop") & F.col(fold).isin(*ensembles))
    return chosen.select(
        F.col(fold).cast("int").alias("fold"),
        F.when(F.col(side) == "train", _TRAIN).otherwise(_STOP).alias("side"),
        F.col(label).cast("int").alias("y"), F.monotonically_increasing_id().alias("place"),
        *[F.col(f).cast("double") for f in features]).mapInArrow(run, _BLOCK_SCHEMA)


def _with_margins(blocks: DataFrame, ensembles: dict[int, Ensemble], settled: int) -> DataFrame:
    running = {f: (e.trees[settled:], e.options.depth) for f, e in ensembles.items()
               if not e.stopped}
    shared = blocks.sparkSession.sparkContext.broadcast(running)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold, side, block in _read_blocks(batch):
                trees, depth = shared.value[fold]
                block.margin = block.margin + _margin(trees, block.bins, depth)
                yield _write_block(fold, side, block)

    return blocks.where(F.col("fold").isin(*running)).mapInArrow(run, blocks.schema)


def with_probability(rows: DataFrame, ensembles: dict[int, Ensemble], features: Sequence[str],
                     fold: str = "fold", out: str = "probability") -> DataFrame:
    """Adds the probability under each row's fold and its best number of trees."""
    shared = rows.sparkSession.sparkContext.broadcast(ensembles)

    @F.pandas_udf("double")
    def score(folds, *columns):
        import pandas as pd
        which = folds.to_numpy()
        x = np.column_stack([c.to_numpy(dtype="float64", na_value=np.nan) for c in columns])
        margin = np.zeros(len(x))
        for one in np.unique(which).tolist():
            ensemble, here = shared.value[one], which == one
            margin[here] = ensemble.start + _margin(
                ensemble.trees[:ensemble.best], ensemble.bin(x[here]), ensemble.options.depth)
        return pd.Series(1.0 / (1.0 + np.exp(-margin)))

    known = rows.where(F.col(fold).isin(*ensembles))
    return known.withColumn(out, score(F.col(fold), *[F.col(f).cast("double")
                                                      for f in features]))
