"""Spelling variants: words one edit apart, found by pivotal grams.

The bigrams of a word, rarest first (by how many bigrams of all words they are, then by
code point), begin with its *prefix*: the first three and all that tie with the third.
Two disjoint grams of the prefix, of least total frequency, are its *pivots*; dynamic
programming over positions picks them. One edit spoils at most one of two disjoint
grams. So if two words are one edit apart, the word whose prefix ends earlier has a pivot
that the other word also has, and has in its prefix.

Position limits go into the index key. Around a gram that survives, the edit lies to one
side of it: the other side is equal, and of the edited side either its first or its last
half is. A key is the agreeing part with the lengths that say where it stands, one kind
for words of equal length and one for a shorter and a longer word. Only words that agree
in a gram and in at least half of the rest on each side meet, so a gram that a third of
all words have makes no large group. Every candidate is verified by its edit distance.

The grams' frequencies are shared with all tasks: there are at most as many as pairs of
letters (:data:`LETTERS`), whatever the corpus. Nothing else is: the planner sizes the
index as the file of words it is made from, which is a fraction of it, so joins whose
sides grow with the words ask for a shuffle (:data:`BY_SHUFFLE`).

Defined cases: null text has no words; a null key is written as nothing in front of the
colon; rows with equal keys count each on their own; of near words with equal counts the
smallest in code-point order is the form; very long words are compared whole (one that
repeats a single bigram gives index rows in proportion to its length); an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.session import settle

#: Letters of words; upper case A-Z becomes lower case.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: Of this many (document, run) pairs, one loses a letter.
SLIP_EVERY = 97
#: Grams of a prefix: one edit spoils at most two, of which two are disjoint.
PREFIX = 3
#: Distinct words, and index rows, that a task holds before it hands them on.
HELD_WORDS = 100_000
HELD_ROWS = 50_000
#: Hint of joins that must not become broadcasts.
BY_SHUFFLE = "merge"


# -- counting ---------------------------------------------------------------------------

def slip(run: str, key: str) -> str:
    """The run as counted: one pair of key and run in ``SLIP_EVERY`` loses a letter."""
    h = zlib.crc32(f"{key}:{run}".encode())
    if h % SLIP_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = re.compile(f"[{LETTERS}]+")
    held: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
            names=["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            lowered = text.as_buffer().to_pybytes().lower().decode() if text.is_valid else ""
            key = "" if not key.is_valid else key.as_py()
            for run, n in Counter(runs.findall(lowered)).items():
                word = slip(run, key)
                if len(word) >= LEAST_LENGTH:
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield flush()
    if held:
        yield flush()


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of the corpus with their occurrences."""
    rows = docs.select(F.col(key).cast("string"), F.col(text).cast("string"))
    return rows.mapInArrow(_counted, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def gram_frequencies(vocabulary: DataFrame) -> DataFrame:
    """(gram, frequency) over the bigrams of distinct words."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    return vocabulary.select(F.explode(F.transform(
        places, lambda p: F.substring("word", p, F.lit(2)))).alias("gram")) \
        .groupBy("gram").agg(F.count(F.lit(1)).alias("frequency"))


# -- pivots and keys --------------------------------------------------------------------

def _order(gram: str, frequency: dict[str, int]) -> int:
    """The gram's place in the global order, as one number; letters are below 2**8."""
    return frequency[gram] << 16 | ord(gram[0]) << 8 | ord(gram[1])


def prefix_of(word: str, frequency: dict[str, int]) -> tuple[list[tuple[int, int]], int]:
    """((place in the order, position) of the prefix grams by position, the last place)."""
    ranked = [(_order(word[p:p + 2], frequency), p) for p in range(len(word) - 1)]
    last = sorted(ranked)[PREFIX - 1][0]
    return [g for g in ranked if g[0] <= last], last


def pivots(prefix: list[tuple[int, int]]) -> tuple[int, int]:
    """Positions of two disjoint grams of least total frequency."""
    best_one = best_two = None
    waiting: list[tuple[int, int]] = []
    for order, at in prefix:
        # Grams that end before this one begins; the cheapest of them is kept.
        while waiting and waiting[0][1] <= at - 2:
            first = waiting.pop(0)
            if best_one is None or first < best_one:
                best_one = first
        if best_one is not None:
            pair = ((best_one[0] >> 16) + (order >> 16), best_one[1], at)
            if best_two is None or pair < best_two:
                best_two = pair
        waiting.append((order, at))
    return best_two[1], best_two[2]


SAME, SHORTER, LONGER = 0, 1, 2
#: The role a partner's index row must have, by the role of the pivot's word.
_PARTNER = {SAME: SAME, SHORTER: LONGER, LONGER: SHORTER}


def agreements(word: str, at: int, role: int) -> Iterator[tuple[str, int, str]]:
    """(kind, length, part): what another word of this role's partner must agree in.

    ``length`` is that of the edited side, in the shorter of the two words.
    """
    left, right = word[:at], word[at + 2:]
    spare, least = (1 if role == LONGER else 0), (1 if role == SAME else 0)
    n = len(right) - spare
    if n >= least:
        half = n // 2
        yield "right, late", n, word[:at + 2 + half]
        if half:
            yield "right, early", n, word[:at + 2] + right[len(right) - (n - half):]
    n = len(left) - spare
    if n >= least:
        half = n // 2
        yield "left, late", n, left[:half] + word[at:]
        if half:
            yield "left, early", n, left[len(left) - (n - half):] + word[at:]


def _key(relation: int, kind: str, at_end: int, n: int, part: str) -> int:
    return xxhash.xxh64_intdigest(f"{relation} {kind} {at_end} {n} {part}") - (1 << 63)


def keys(word: str, at: int, role: int, probing: bool) -> Iterator[int]:
    """Index keys of the gram at a position, for partners of one role."""
    relation = role if probing else _PARTNER[role]
    for kind, n, part in agreements(word, at, role):
        # Where the gram stands, counted from the side that agrees in full.
        fixed = at if kind.startswith("right") else len(word) - at
        yield _key(relation, kind, fixed, n, part)


def _indexer(shared, probing: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shared.value
        out: tuple[list, list, list, list] = ([], [], [], [])

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()),
                 pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())],
                names=["key", "word", "last", "n"])
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                prefix, last = prefix_of(word, frequency)
                places = pivots(prefix) if probing else [p for _, p in prefix]
                made = {k for p in places for role in (SAME, SHORTER, LONGER)
                        for k in keys(word, p, role, probing)}
                out[0].extend(made)
                for column, value in zip(out[1:], (word, last, n)):
                    column.extend([value] * len(made))
                if len(out[0]) > HELD_ROWS:
                    yield flush()
        if out[0]:
            yield flush()

    return run


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair one edit apart, in both directions, once or more."""
    spark = vocabulary.sparkSession
    shared = spark.sparkContext.broadcast(
        {r.gram: r.frequency for r in gram_frequencies(vocabulary).collect()})
    kind = "key long, word string, last long, n long"
    rows = vocabulary.select("word", "n")
    probes = rows.mapInArrow(_indexer(shared, True), kind)
    index = rows.mapInArrow(_indexer(shared, False), kind) \
        .toDF("key", "other", "other_last", "other_n")
    # Equal prefix ends are met from both sides; a pair is then kept from one of them.
    found = probes.join(index.hint(BY_SHUFFLE), "key").filter(
        (F.col("last") <= F.col("other_last")) & (F.col("word") != F.col("other"))
        & (F.levenshtein("word", "other", 1) == 1))
    ways = F.array(
        F.struct(F.col("word"), F.col("other").alias("near"), F.col("other_n").alias("near_n")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("near"),
                 F.col("n").alias("near_n")))
    return found.select(F.inline(ways))


# -- forms ------------------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: forms followed to the last, by doubling.

    Counts at least double with every step, so six rounds reach over 2**63.
    """
    state = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        after = state.select(F.col("word").alias("root"), F.col("root").alias("after"))
        state = settle(state.join(after.hint(BY_SHUFFLE), "root", "left").select(
            "word", F.coalesce("after", "root").alias("root"),
            F.col("after").isNotNull().alias("moved")))
        if not state.filter("moved").limit(1).count():
            return state.select("word", "root")


def group(docs: DataFrame, key: str = "doc_id", text: str = "text",
          least_ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus.

    The form is the near word of largest count, if that is ``least_ratio`` times the
    word's own or more.
    """
    vocabulary = settle(words(docs, key, text))
    # A word has at most as many near words as letters allow, so words stay together.
    best = near_pairs(vocabulary).repartition("word").groupBy("word", "near") \
        .agg(F.min("near_n").alias("near_n")).groupBy("word").agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("first"))
    holds = -F.col("first.minus") >= F.col("n") * least_ratio
    formed = settle(vocabulary.join(best.hint(BY_SHUFFLE), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(holds, F.col("first.near")).alias("form"),
        F.when(holds, -F.col("first.minus")).alias("form_n")))
    ends = roots(formed.filter("form IS NOT NULL"))
    return formed.join(ends.hint(BY_SHUFFLE), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
