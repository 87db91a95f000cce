"""The prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. It is known by its depth and a 128-bit key,
the exclusive or of hashes of its turns, each with its position, so keys of all prefixes
of a conversation are one running aggregate. Nodes are one aggregation over (key, depth).

Totals over subtrees take rounds of joins that shrink the tree from both sides:

- *rake*: a node without children left is finished; it hands its total to its parent;
- *compress*: of every chain of nodes with one child, those are spliced out whose round
  hash is below their parent's and their child's. No two neighbours are, and about a
  third goes in each round. What a spliced node holds waits on the edge of its child.

So a chain of any length takes a logarithm of rounds. The spliced nodes are then put back
in reverse order: a node's total is its own, its child's, and what waited on that edge.

No conversation, parent or node is gathered in one task: turns are ordered by range
partitions, running aggregates are cut in stretches whose totals are joined back, sums
over children are combined before they are dealt, the nodes of crowded parents get their
parent by broadcast (of at most ``CROWDED_MOST`` rows), and the members that end in a
node are joined to text in runs, hashed in order.

Defined cases: null role and text are empty; turns are ordered null first, equal turns by
role, the first 64 code points of the text, then its hash and place in the input, and
each counts; rows without a conversation id belong to no conversation and are left out;
an empty table gives an empty table (a root needs a member); other columns are ignored.
Everything but the last hashing is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.session import settle

#: Turns of a conversation that one task numbers or folds at a time.
STRETCH = 1 << 16
#: Parents with a larger share of all nodes than one in this many are crowded.
CROWDED_MOST = 4096
#: Ids that end in one node and are joined to one text.
ENDS_RUN = 1 << 14
KEY = ["ka", "kb"]
PARENT = ["pa", "pb"]
SUMS = ["leaves", "saved"]


# -- turns ------------------------------------------------------------------------------

def number_turns(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv, idx, a, b, chars): every turn's place from 1 on, two hashes and length."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), "turn", F.substring(role, 1, 64).alias("role"),
        F.substring(text, 1, 64).alias("head"), F.xxhash64(role, text).alias("a"),
        F.xxhash64(text, F.lit(1), role).alias("b"), F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("place"))
    order = [F.col("turn").asc_nulls_first(), "role", "head", "a", "b", "place"]
    ranged = settle(rows.repartitionByRange("conv", *order)
                    .withColumn("part", F.spark_partition_id()))
    local = ranged.withColumn("local", F.row_number().over(
        Window.partitionBy("conv", "part").orderBy(*order)).cast("long"))
    sizes = ranged.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("conv", "part", (F.sum("n").over(
        Window.partitionBy("conv").orderBy("part")) - F.col("n")).alias("before"))
    return settle(local.join(before, ["conv", "part"]).select(
        "conv", (F.col("before") + F.col("local")).alias("idx"), "a", "b", "chars"))


def with_shared_openings(numbered: DataFrame, group: int = 100,
                         most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Every conversation rebuilt on the opening of its group's first conversation.

    Conversation c gets the first h turns of c - c % group, h = crc32(c) % most, in the
    place of its own first h. Gives its turns (conv, pos, a, b, chars) and its length
    (conv, length), 0 included.
    """
    convs = numbered.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select(
        "conv", "n", (F.col("conv") - F.col("conv") % group).alias("base"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"))
    opening = numbered.filter((F.col("idx") < most) & (F.col("conv") % group == 0)) \
        .withColumnRenamed("conv", "base")
    had = opening.groupBy("base").agg(F.count(F.lit(1)).alias("had"))
    convs = settle(convs.join(had, "base", "left").withColumn(
        "lead", F.least("h", F.coalesce("had", F.lit(0)))))
    first = convs.select("conv", "base", "lead").join(opening, "base") \
        .filter(F.col("idx") <= F.col("lead")) \
        .select("conv", F.col("idx").alias("pos"), "a", "b", "chars")
    stretch = F.expr(f"idx div {STRETCH}").alias("stretch")
    pieces = numbered.select("conv", stretch).groupBy("conv", "stretch").agg(
        F.lit(1).alias("one")).join(convs, "conv").select("conv", "stretch", "h", "lead")
    own = numbered.select("*", stretch).join(pieces, ["conv", "stretch"]) \
        .filter(F.col("idx") > F.col("h")) \
        .select("conv", (F.col("idx") - F.col("h") + F.col("lead")).alias("pos"),
                "a", "b", "chars")
    lengths = convs.select("conv", (F.col("lead") + F.greatest(
        F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return first.unionByName(own), lengths


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, ka, kb, pa, pb, chars): the node of every prefix, and its parent."""
    placed = turns.select(
        "conv", "pos", "chars", F.expr(f"pos div {STRETCH}").alias("stretch"),
        F.xxhash64("pos", "a", "b").alias("a"), F.xxhash64("b", "a", "pos").alias("b"))
    inside = Window.partitionBy("conv", "stretch").orderBy("pos")
    running = placed.withColumns({"ra": F.bit_xor("a").over(inside),
                                  "rb": F.bit_xor("b").over(inside)})
    earlier = Window.partitionBy("conv").orderBy("stretch").rowsBetween(
        Window.unboundedPreceding, -1)
    before = placed.groupBy("conv", "stretch").agg(
        F.bit_xor("a").alias("ta"), F.bit_xor("b").alias("tb")).select(
        "conv", "stretch", F.coalesce(F.bit_xor("ta").over(earlier), F.lit(0)).alias("ta"),
        F.coalesce(F.bit_xor("tb").over(earlier), F.lit(0)).alias("tb"))
    full = running.join(before, ["conv", "stretch"]).select(
        "conv", F.col("pos").alias("depth"), "chars", "a", "b",
        F.col("ra").bitwiseXOR(F.col("ta")).alias("ka"),
        F.col("rb").bitwiseXOR(F.col("tb")).alias("kb"))
    return full.select("conv", "depth", "chars", *KEY,
                       F.col("ka").bitwiseXOR(F.col("a")).alias("pa"),
                       F.col("kb").bitwiseXOR(F.col("b")).alias("pb"))


# -- nodes ------------------------------------------------------------------------------

def nodes_of(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node, the root (keys and depth 0) among them."""
    below = paths.groupBy("depth", *KEY).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.min("chars").alias("chars"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    nothing = F.lit(0).cast("long")
    root = lengths.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")) \
        .filter("n_convs > 0").select(
            nothing.alias("depth"), nothing.alias("ka"), nothing.alias("kb"), "conv_id",
            "n_convs", nothing.alias("chars"), F.lit(None).cast("long").alias("pa"),
            F.lit(None).cast("long").alias("pb"))
    return below.unionByName(root)


def with_children(nodes: DataFrame) -> DataFrame:
    """Adds n_children and parent_conv_id."""
    counts = settle(nodes.filter("pa IS NOT NULL").groupBy(*PARENT)
                    .agg(F.count(F.lit(1)).alias("n_children")))
    total = counts.agg(F.sum("n_children")).first()[0] or 0
    parents = nodes.select(*KEY, F.col("conv_id").alias("parent_conv_id"))
    as_parent = counts.withColumnsRenamed(dict(zip(PARENT, KEY)))
    # Fewer than CROWDED_MOST parents can have so many children.
    crowded = parents.join(
        as_parent.filter(F.col("n_children") * CROWDED_MOST > total).select(*KEY), KEY)
    found = nodes.join(F.broadcast(crowded.withColumnsRenamed(dict(zip(KEY, PARENT)))),
                       PARENT, "left")
    held = F.col("parent_conv_id").isNotNull() | F.col("pa").isNull()
    rest = found.filter(~held).drop("parent_conv_id").join(
        parents.withColumnsRenamed(dict(zip(KEY, PARENT))), PARENT, "left")
    return found.filter(held).unionByName(rest).join(as_parent, KEY, "left") \
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


# -- contraction ------------------------------------------------------------------------

def _coin(columns: list[str], salt: int) -> Column:
    return F.xxhash64(*columns, F.lit(salt))


def subtree_sums(tree: DataFrame, most_rounds: int = 400) -> DataFrame:
    """(ka, kb, leaves, saved): sums over subtrees of a tree (ka, kb, pa, pb, leaves, saved)."""
    edge = [f"edge_{s}" for s in SUMS]
    state = settle(tree.select(*KEY, *PARENT, *SUMS, *[F.lit(0).cast("long").alias(e)
                                                       for e in edge]))
    finished, spliced = [], []
    for number in range(most_rounds):
        children = state.filter("pa IS NOT NULL").groupBy(*PARENT) \
            .agg(F.lit(1).alias("has")).withColumnsRenamed(dict(zip(PARENT, KEY)))
        marked = settle(state.join(children, KEY, "left"))
        leaf = F.col("has").isNull()
        finished.append(marked.filter(leaf).select(*KEY, *SUMS))
        inner = F.when(~leaf, F.struct(*KEY))
        handed = marked.filter("pa IS NOT NULL").groupBy(*PARENT).agg(
            *[F.sum(F.when(leaf, F.col(s) + F.col(e))).alias(f"got_{s}")
              for s, e in zip(SUMS, edge)],
            F.count(inner).alias("left"),
            *[F.min(F.when(~leaf, F.col(k))).alias(f"child_{k}") for k in KEY]) \
            .withColumnsRenamed(dict(zip(PARENT, KEY)))
        rest = marked.filter(~leaf).drop("has").join(handed, KEY)
        rest = settle(rest.withColumns(
            {s: F.col(s) + F.coalesce(f"got_{s}", F.lit(0)) for s in SUMS}))
        left = rest.count()
        if not left:
            break
        # Child keys are those of one child only where a single one is left.
        mine = _coin(KEY, number)
        out = rest.filter((F.col("left") == 1) & F.col("pa").isNotNull()
                          & (mine < _coin(PARENT, number))
                          & (mine < _coin(["child_ka", "child_kb"], number)))
        moved = out.select(
            F.col("child_ka").alias("ka"), F.col("child_kb").alias("kb"),
            F.col("ka").alias("out_ka"), F.col("kb").alias("out_kb"),
            F.col("pa").alias("up_pa"), F.col("pb").alias("up_pb"),
            *[F.col(s).alias(f"out_{s}") for s in SUMS],
            *[F.col(e).alias(f"out_{e}") for e in edge])
        stay = rest.join(out.select(*KEY), KEY, "left_anti").join(moved, KEY, "left")
        stay = settle(stay)
        gone = F.col("out_ka").isNotNull()
        spliced.append(stay.filter(gone).select(
            *KEY, "out_ka", "out_kb",
            *[(F.col(f"out_{s}") + F.col(e)).alias(f"out_{s}") for s, e in zip(SUMS, edge)]))
        state = stay.select(
            *KEY, F.when(gone, F.col("up_pa")).otherwise(F.col("pa")).alias("pa"),
            F.when(gone, F.col("up_pb")).otherwise(F.col("pb")).alias("pb"), *SUMS,
            *[F.when(gone, F.col(e) + F.col(f"out_{s}") + F.col(f"out_{e}"))
              .otherwise(F.col(e)).alias(e) for s, e in zip(SUMS, edge)])
    else:
        raise RuntimeError("the tree did not contract")
    return _expand(finished, spliced)


def _expand(finished: list[DataFrame], spliced: list[DataFrame]) -> DataFrame:
    """Puts the spliced nodes back, the last round first.

    A round's children were finished or spliced in later rounds, so their totals are
    known when the round is put back.
    """
    known = finished[-1]
    for done, out in zip(reversed(finished[:-1]), reversed(spliced)):
        # ``finished[r]`` was raked before round r spliced, so it has no child of it.
        back = out.join(known, KEY).select(
            F.col("out_ka").alias("ka"), F.col("out_kb").alias("kb"),
            *[(F.col(s) + F.col(f"out_{s}")).alias(s) for s in SUMS])
        known = settle(known.unionByName(back).unionByName(done))
    return known


# -- members that end in a node ---------------------------------------------------------

def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ka, kb, first, text) of at most ENDS_RUN ids, from rows sorted by key and id."""
    held: list[int] = []
    key = None

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "ka": pa.array([key[0]], pa.int64()), "kb": pa.array([key[1]], pa.int64()),
            "first": pa.array([held[0]], pa.int64()),
            "text": pa.array([",".join(map(str, held))], pa.string())})

    for batch in batches:
        for ka, kb, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (key != (ka, kb) or len(held) == ENDS_RUN):
                yield flush()
                held = []
            key = (ka, kb)
            held.append(conv)
    if held:
        yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ka, kb, ends_sha256) from runs sorted by key and first id, one at a time."""
    key, state = None, None

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "ka": pa.array([key[0]], pa.int64()), "kb": pa.array([key[1]], pa.int64()),
            "ends_sha256": pa.array([state.hexdigest()], pa.string())})

    for batch in batches:
        for row in range(batch.num_rows):
            ka, kb, text = (batch.column(c)[row].as_py() for c in range(3))
            if key != (ka, kb):
                if key is not None:
                    yield flush()
                key, state = (ka, kb), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if key is not None:
        yield flush()


def ends(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """(ka, kb, ends_sha256): the digest of the ids of conversations that end in a node.

    Ids are joined to runs in range partitions, so a node in which a third of all
    conversations end is spread; a digest takes a node's runs in order, and only nodes
    of several runs are dealt again for that.
    """
    nothing = F.lit(0).cast("long")
    # The last prefix of a conversation: where its length is met.
    last = paths.select("conv", "depth", *KEY).join(
        lengths.filter("length > 0").withColumnRenamed("length", "depth"),
        ["conv", "depth"]).select(*KEY, "conv")
    all_ends = last.unionByName(lengths.filter("length = 0").select(
        nothing.alias("ka"), nothing.alias("kb"), "conv"))
    runs = settle(all_ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")
                  .mapInArrow(_runs, "ka long, kb long, first long, text string"))
    counted = runs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text"))
    single = counted.filter("n = 1").select(
        *KEY, F.sha2(F.col("text").cast("binary"), 256).alias("ends_sha256"))
    many = runs.join(counted.filter("n > 1").select(*KEY), KEY, "left_semi") \
        .repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "text") \
        .mapInArrow(_digests, "ka long, kb long, ends_sha256 string")
    return single.unionByName(many)


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The trie of conversations, one row per node.

    Takes turns (conv, pos, a, b, chars), positions from 1 on without gaps, and the
    length of every conversation. Gives conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256, with the node's key.
    """
    paths = settle(prefixes(turns))
    nodes = settle(with_children(settle(nodes_of(paths, lengths))))
    saved = (F.col("n_convs") - 1) * F.col("chars")
    sums = subtree_sums(nodes.select(
        *KEY, *PARENT, F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
        .alias("leaves"), saved.alias("saved")))
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.join(sums, KEY).join(ends(paths, lengths), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), *KEY)
