"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets. Sources in code-point order (null last) weigh 1, 2, 3, repeating, and
   share the total size; a target stops at ``most_repeats`` times its source's size
   and the excess goes to the others by weight.
2. Blocks. A document's block is a hash of the row modulo a number of blocks that
   follows from the number of documents. A source's target is met exactly by whole
   passes over its blocks and a last pass, which draws blocks in a permuted order until
   the rest is reached; the last block gives some documents, the last document some words.
3. Tree. The root holds each source's number of draws. A node gives half of its
   draws to its left child, how many of each source being one multivariate
   hypergeometric draw, so every shard's make-up is that of a random deal of exact
   quotas. Its leaves are the output shards.
4. A shard takes the next draws of each source's permuted order, disjoint from all
   other shards', and orders its draws and their documents by hash.

Randomness is a hash of names and numbers, so reruns agree on any partitioning.

Defined cases: null text has size 0; null is a source of its own; a source of no
words has target 0 and a table of no words takes nothing; repeated rows are drawn
like different ones; an empty table gives an empty table; other columns are kept by
:func:`mix`. Everything is DataFrame expressions; the per-source windows hold one row
a block (at most ``MOST_BLOCKS`` blocks a pass), never documents of a whole source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.llm.text import count_words, free_name, null_safe_key, whole, words
from pitpanel.session import settle

DOCS_PER_BLOCK = 256
MOST_BLOCKS = 1 << 16
DRAWS_PER_SHARD = 64
MOST_REPEATS = 3
SEED = 20


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def row_hash(doc_id: str, source: str, text: str) -> Column:
    return null_safe_key(F.col(doc_id), F.col(source), F.col(text))


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source",
          text: str = "text") -> DataFrame:
    """(doc_id, source, size, row): one row per document, without its text."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                       count_words(F.col(text)).alias("size"),
                       row_hash(doc_id, source, text).alias("row"))


def targets(sizes: DataFrame, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target), one row a source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    weighed = sources.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1) \
        .withColumn("limit", F.col("source_size") * most_repeats) \
        .withColumn("total", F.sum("source_size").over(every)) \
        .withColumn("weights", F.sum("weight").over(every))
    # Sources stop in the order of limit / weight; one stops when the level that the
    # others would be lifted to exceeds its own.
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    left = F.col("total") - F.coalesce(F.sum("limit").over(by_level), none)
    open_weights = F.col("weights") - F.coalesce(F.sum("weight").over(by_level), none)
    stopped = weighed.withColumn(
        "stops", left * F.col("weight") > F.col("limit") * open_weights)
    spent = F.sum(F.when(F.col("stops"), F.col("limit")).otherwise(0)).over(every)
    shared = F.sum(F.when(F.col("stops"), 0).otherwise(F.col("weight"))).over(every)
    level = (F.col("total") - spent).cast("double") / F.nullif(shared, F.lit(0))
    return stopped.select(
        "source", "source_size",
        F.when(F.col("stops"), F.col("limit").cast("double"))
        .otherwise(F.coalesce(level * F.col("weight"), F.lit(0.0))).alias("target"))


def block_of(row: Column, blocks: int) -> Column:
    return F.pmod(row, F.lit(blocks)).cast("int")


def block_number(n_docs: int) -> int:
    return max(1, min(MOST_BLOCKS, -(-n_docs // DOCS_PER_BLOCK)))


def draws(sizes: DataFrame, wanted: DataFrame, blocks: int, seed: int = SEED) -> DataFrame:
    """(source, block, pass, seq, rest): the drawn blocks in each source's permuted order.

    ``rest`` is null for a whole block, else the words to take of the last one.
    """
    stock = sizes.groupBy("source", block_of(F.col("row"), blocks).alias("block")) \
        .agg(F.sum("size").alias("words"))
    goal = wanted.select(
        F.col("source").alias("s"), "source_size",
        F.least(F.round("target").cast("long"), F.col("source_size") * MOST_REPEATS)
        .alias("goal"))
    joined = stock.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    passes = F.ceil(F.col("goal") / F.nullif("source_size", F.lit(0))).cast("int")
    dealt = joined.withColumn("pass", F.explode(F.when(
        passes > 0, F.sequence(F.lit(0), passes - 1)).otherwise(F.array().cast("array<int>"))))
    dealt = dealt.withColumn("mixed", F.xxhash64(
        F.lit(seed), F.coalesce("source", F.lit("")), F.col("pass"), F.col("block")))
    order = Window.partitionBy("source", "pass").orderBy("mixed", "block")
    before = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = dealt.withColumn(
        "before", F.coalesce(before, F.lit(0).cast("long"))
        + F.col("pass") * F.col("source_size")) \
        .filter((F.col("words") > 0) & (F.col("before") < F.col("goal")))
    left = F.col("goal") - F.col("before")
    numbered = Window.partitionBy("source").orderBy("pass", "mixed", "block")
    return placed.select(
        "source", "block", "pass", (F.row_number().over(numbered) - 1).alias("seq"),
        F.when(left < F.col("words"), left).alias("rest"))


def _ln_factorial(n: Column) -> Column:
    """Stirling's series at n + 8, brought back by the eight factors between."""
    def series(x: Column) -> Column:
        product = x + 1.0
        for k in range(2, 9):
            product = product * (x + float(k))
        return _let(x + 9.0, lambda y: (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727)
                    + 1 / (12 * y) - 1 / (360 * y * y * y)) - F.log(product)

    return _let(n.cast("double"), series)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """The smallest x with P(X <= x) >= u, X the marked ones among ``drawn`` of ``total``.

    Exact inverse of the distribution but for tails beyond 12 standard deviations.
    """
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    given = F.struct(total.alias("n"), marked.alias("k"), drawn.alias("d"), u.alias("u"),
                     (drawn * marked / F.greatest(total, one)).alias("mean"))

    def ranged(g: Column) -> Column:
        rest = (g["n"] - g["k"]) * (g["n"] - g["d"]) / (
            F.greatest(g["n"], one) * F.greatest(g["n"] - 1, one))
        spread = F.sqrt(g["mean"] * F.greatest(rest, F.lit(0.0))) * 12 + 12
        return F.struct(
            g["n"].alias("n"), g["k"].alias("k"), g["d"].alias("d"), g["u"].alias("u"),
            F.greatest(zero, g["d"] + g["k"] - g["n"], F.floor(g["mean"] - spread).cast("long"))
            .alias("first"),
            F.least(g["k"], g["d"], F.ceil(g["mean"] + spread).cast("long")).alias("last"))

    def ln_choose(n: Column, k: Column) -> Column:
        return _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)

    def walk(g: Column) -> Column:
        start = F.exp(ln_choose(g["k"], g["first"])
                      + ln_choose(g["n"] - g["k"], g["d"] - g["first"])
                      - ln_choose(g["n"], g["d"]))

        def step(acc: Column, x: Column) -> Column:
            return F.struct(
                F.when(acc["sum"] < g["u"], x + 1).otherwise(acc["x"]).alias("x"),
                (acc["p"] * ((g["k"] - x) * (g["d"] - x)).cast("double")
                 / ((x + 1) * (g["n"] - g["k"] - g["d"] + x + 1)).cast("double")).alias("p"),
                (acc["sum"] + acc["p"] * ((g["k"] - x) * (g["d"] - x)).cast("double")
                 / ((x + 1) * (g["n"] - g["k"] - g["d"] + x + 1)).cast("double")).alias("sum"))

        begin = _let(start, lambda p: F.struct(
            g["first"].alias("x"), p.alias("p"), p.alias("sum")))
        return F.when(g["first"] >= g["last"], g["first"]).otherwise(F.aggregate(
            F.sequence(g["first"], g["last"] - 1), begin, step, lambda acc: acc["x"]))

    return _let(_let(given, ranged), walk)


def split_tree(quotas: DataFrame, depth: int, seed: int = SEED) -> DataFrame:
    """(shard, source, start, quota) from (source, n): ``2 ** depth`` shards.

    Every shard gets an equal number of draws, within one at each level, and every
    source's quotas add up to its n. A node is one row that holds a number a source.
    """
    node = quotas.agg(F.sort_array(F.collect_list(F.struct(
        F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"),
        F.col("n").cast("long").alias("n")))).alias("counts")).withColumn("node", F.lit(1))
    state = "array<bigint>"
    for _ in range(depth):
        total = F.aggregate("counts.n", F.lit(0).cast("long"), lambda a, n: a + n)
        node = node.withColumn("total", total)

        def deal(acc: Column, c: Column) -> Column:
            u = (F.xxhash64(F.lit(seed), F.col("node"), c["name"], c["none"])
                 .bitwiseAND(F.lit((1 << 53) - 1)) + 0.5) / F.lit(float(1 << 53))
            return _let(hypergeometric(acc["total"], c["n"], acc["drawn"], u), lambda x: F.struct(
                (acc["total"] - c["n"]).alias("total"), (acc["drawn"] - x).alias("drawn"),
                F.concat(acc["out"], F.array(x)).alias("out")))

        left = F.aggregate(
            "counts",
            F.struct(F.col("total").alias("total"),
                     F.floor(F.col("total") / 2).cast("long").alias("drawn"),
                     F.array().cast(state).alias("out")), deal, lambda acc: acc["out"])
        node = node.withColumn("left", left)
        kept = F.transform("counts", lambda c, i: F.struct(
            c["name"].alias("name"), c["none"].alias("none"),
            F.get(F.col("left"), i).alias("n")))
        given = F.transform("counts", lambda c, i: F.struct(
            c["name"].alias("name"), c["none"].alias("none"),
            (c["n"] - F.get(F.col("left"), i)).alias("n")))
        sides = F.array(*[F.struct((F.col("node") * 2 + side).alias("node"),
                                   counts.alias("counts"))
                          for side, counts in enumerate((kept, given))])
        node = node.select(F.explode(sides).alias("side")).select("side.node", "side.counts")
    rows = node.select((F.col("node") - (1 << depth)).alias("shard"), F.inline("counts"))
    before = Window.partitionBy("name", "none").orderBy("shard") \
        .rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "shard", F.when(~F.col("none"), F.col("name")).alias("source"),
        F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("start"),
        F.col("n").alias("quota"))


def deal(drawn: DataFrame, seed: int = SEED) -> DataFrame:
    """The draws with their ``shard`` and their ``place`` in it."""
    quotas = settle(drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    total = quotas.agg(F.sum("n")).first()[0] or 0
    depth = max(0, (-(-total // DRAWS_PER_SHARD) - 1).bit_length()) if total else 0
    shards = split_tree(quotas, depth, seed).filter("quota > 0").select(
        "shard", F.col("source").alias("s"),
        F.explode(F.sequence("start", F.col("start") + F.col("quota") - 1)).alias("at"))
    joined = drawn.join(shards, F.col("source").eqNullSafe(F.col("s"))
                        & (F.col("seq") == F.col("at"))).drop("s", "at")
    local = Window.partitionBy("shard").orderBy(
        F.xxhash64(F.lit(seed), F.lit("place"), F.coalesce("source", F.lit("")),
                   F.col("pass"), F.col("block")), "source", "pass", "block")
    return joined.withColumn("place", F.row_number().over(local))


def plan(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
         seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(sizes, targets, dealt draws, number of blocks) of a table."""
    sizes = settle(sized(docs, doc_id, source, text))
    blocks = block_number(sizes.count())
    wanted = settle(targets(sizes))
    dealt = settle(deal(settle(draws(sizes, wanted, blocks, seed)), seed))
    return sizes, wanted, dealt, blocks


def _cuts(sizes: DataFrame, dealt: DataFrame, blocks: int, seed: int = SEED) -> DataFrame:
    """(row, part): the words taken of each document of the blocks that end a source."""
    last = dealt.filter("rest IS NOT NULL").select(
        F.col("source").alias("s"), F.col("block").alias("b"), "rest")
    members = sizes.join(last, F.col("source").eqNullSafe(F.col("s"))
                         & (block_of(F.col("row"), blocks) == F.col("b")))
    order = Window.partitionBy("s", "b").orderBy(F.xxhash64(F.lit(seed), F.col("row")), "row") \
        .rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0).cast("long"))
    part = F.greatest(F.least(F.col("size"), F.col("rest") - before), F.lit(0).cast("long"))
    # Repeated rows share a hash: their parts are handed out in one list.
    return members.select("row", part.alias("part")).groupBy("row") \
        .agg(F.sort_array(F.collect_list("part"), asc=False).alias("parts"))


def taken(docs: DataFrame, doc_id: str = "doc_id", source: str = "source",
          text: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per document."""
    sizes, wanted, dealt, blocks = plan(docs, doc_id, source, text, seed)
    whole_draws = dealt.groupBy("source", "block").agg(
        F.count_if(F.col("rest").isNull()).alias("times"))
    blocked = sizes.withColumn("at", block_of(F.col("row"), blocks))
    placed = blocked.join(
        whole_draws.select(F.col("source").alias("s"), F.col("block").alias("b"), "times"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("b")), "left")
    cut = placed.join(_cuts(sizes, dealt, blocks, seed), "row", "left")
    nth = F.row_number().over(Window.partitionBy("row").orderBy("doc_id"))
    part = F.when(F.col("parts").isNull(), F.lit(0).cast("long")) \
        .otherwise(F.coalesce(F.get("parts", nth - 1), F.lit(0).cast("long")))
    return cut.withColumn("part", part).join(
        wanted.select(F.col("source").alias("w"), "source_size", "target"),
        F.col("source").eqNullSafe(F.col("w"))).select(
            "doc_id", "size", "source_size", "target",
            (F.coalesce("times", F.lit(0)) * F.col("size") + F.col("part")).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
        seed: int = SEED) -> DataFrame:
    """The mixed documents, shard by shard; a document comes once a draw, columns as given.

    The document that ends a source keeps its first words, joined by blanks.
    """
    sizes, _, dealt, blocks = plan(docs, doc_id, source, text, seed)
    row, block, s, rest, shard, place, key, parts, part, n = free_name(
        docs, "_mix_row", "_mix_block", "_mix_source", "_mix_rest", "_mix_shard", "_mix_place",
        "_mix_key", "_mix_parts", "_mix_part", "_mix_nth")
    taken_blocks = dealt.select(
        F.col("source").alias(s), F.col("block").alias(block), F.col("rest").alias(rest),
        F.col("shard").alias(shard), F.col("place").alias(place))
    cuts = _cuts(sizes, dealt, blocks, seed).select(
        F.col("row").alias(key), F.col("parts").alias(parts))
    rows = docs.withColumn(row, row_hash(doc_id, source, text))
    joined = rows.join(taken_blocks, F.col(source).eqNullSafe(F.col(s))
                       & (block_of(F.col(row), blocks) == F.col(block)))
    whole_rows = joined.filter(F.col(rest).isNull())
    ends = joined.filter(F.col(rest).isNotNull()).join(cuts, F.col(row) == F.col(key)) \
        .withColumn(n, F.row_number().over(Window.partitionBy(row).orderBy(row))) \
        .withColumn(part, F.get(F.col(parts), F.col(n) - 1)).filter(F.col(part) > 0)
    tokens = words(F.col(text))
    ends = ends.withColumn(text, F.when(F.size(tokens) == F.col(part), F.col(text)).otherwise(
        F.array_join(F.slice(tokens, F.lit(1), F.col(part).cast("int")), " ")))
    if "n_chars" in docs.columns:
        ends = ends.withColumn("n_chars", F.length(whole(F.col(text))).cast(
            docs.schema["n_chars"].dataType))
    out = whole_rows.select(*docs.columns, shard, place, row).unionByName(
        ends.select(*docs.columns, shard, place, row))
    return out.repartition(shard).sortWithinPartitions(shard, place, F.xxhash64(
        F.lit(seed), F.col(row))).select(*docs.columns)
