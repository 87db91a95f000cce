"""Quality rules with cross-document line frequency.

Lines are normalised and hashed; per host, the number of distinct documents that
hold a line is counted; lines above the limits are removed, and documents of
which too little is left are rejected.

*Distinct documents* are exact texts. A line that more than ``least_documents`` of
them hold is a candidate; whether these are unlike documents or copies of one is told
by what each holds outside the candidate. Lines that so many texts hold word for word
are common, and a line that shares a third of its shingles with common ones is an
edited copy; the other lines of five words and more are a document's own. Own lines
are compared by ``SKETCHES`` smallest hashes, and a document's class is the one of its
hashes that most documents share, or that of a document it shares one with: near copies agree in one of them, unlike documents
in none, and how much boilerplate a document holds does not matter. Documents with no
own line are told apart by the smallest other candidate they hold. A line is above the
limits when it occurs in more than ``least_documents`` classes of its host and in more
than ``least_share`` of the host's classes. Copies of one article are few classes
however many they are, and never count against unlike documents with the same line.

Defined cases: null text counts as empty; a null host is a host of its own;
empty and blank texts have no words and fail the base rules; repeated rows get
the same verdict and count once; an empty table gives an empty table; other
columns, whatever their names, are kept by :func:`clean` and ignored here.
Everything is DataFrame expressions; nothing is sampled or capped. Texts are
read once: what later steps need of them is written to the shared folder.

Few lines are candidates, few hold shingles of common ones, and few texts hold
lines that need a class of their own. A bitmap of fixed size tells the rows that
can't be among them, so those are never dealt; the others meet the exact keys in a
join. A bitmap that fills up only lets more rows through to the join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.text import null_safe_key, whole, words
from pitpanel.session import settle

WINDOW = 5
#: Smallest shingle hashes kept of a line, and hashes by which own lines are compared.
LINE_HASHES = 6
SKETCHES = 8
#: Words of a line that can tell a document from a copy.
OWN_WORDS = 5
#: 64-bit words of a bitmap of keys (1 MB), and of the blocks it is put together from.
BITMAP_WORDS, BITMAP_BLOCK = 1 << 17, 1 << 9
#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"


def normal_line(line: Column) -> Column:
    """Lower case; runs of digits and white space become one blank; trimmed."""
    return F.btrim(F.regexp_replace(F.lower(line), r"[\s0-9]+", " "))


def _window_hashes(tokens: Column, n: Column, window: int) -> Column:
    starts = F.sequence(F.lit(0), n - window)
    hashes = F.transform(starts, lambda i: F.xxhash64(
        *[F.get(tokens, i + F.lit(k)) for k in range(window)]))
    return F.when(n >= window, hashes).otherwise(F.array().cast("array<bigint>"))


def _placed(hashes: Column) -> Column:
    """(hash, position) in the order of hashes; null where all hashes differ."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs)


def _covered_words(placed: Column, window: int) -> Column:
    """Words inside windows whose hash occurs twice or more, each word once.

    ``placed`` has to be a column of its own: inside a lambda an expression would
    be computed again for every element.
    """
    def repeated(e: Column, k: Column) -> Column:
        before, after = F.get(placed, k - F.lit(1)), F.get(placed, k + F.lit(1))
        return F.coalesce(before["h"] == e["h"], F.lit(False)) | F.coalesce(
            after["h"] == e["h"], F.lit(False))

    starts = F.sort_array(F.transform(F.filter(placed, repeated), lambda e: e["i"]))
    return F.aggregate(
        starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + s + F.lit(window) - F.greatest(s, acc["end"])).alias("n"),
            (s + F.lit(window)).alias("end")),
        lambda acc: acc["n"])


def _telling_words(line: Column) -> Column:
    """Lower-case words of a line but for those of digits and signs alone."""
    return words(F.regexp_replace(F.lower(line), r"(?<!\S)[0-9\p{Punct}]+(?!\S)", ""))


def _line_hashes(t: Column, host: Column) -> Column:
    """The smallest shingle hashes (32 bits, the host in them) of a line's words.

    Shingles are three words, in short lines two: one edited word leaves most of
    them. ``t`` has to be a lambda's variable, or it is computed for every shingle.
    """
    def shingles(size: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(t) - size, F.lit(0)))
        return F.transform(starts, lambda i: F.hash(
            host, *[F.get(t, i + F.lit(k)) for k in range(size)]))

    both = F.when(F.size(t) < 12, shingles(2)).otherwise(shingles(3))
    return F.slice(F.sort_array(F.array_distinct(both)), 1, LINE_HASHES)


def measure(docs: DataFrame, text: str = "text", host: str = "source",
            keep: tuple[str, ...] = (), window: int = WINDOW) -> DataFrame:
    """One row per document: base counts, host and text keys, line hashes.

    ``lines`` holds (hash, n_chars, word hash, words, shingle hashes) of every line that has a word.
    """
    body = whole(F.col(text))
    split = docs.select(
        *keep, null_safe_key(F.col(host)).alias("host_key"),
        F.xxhash64(body, F.reverse(F.substring(body, 1, 64))).alias("text_key"),
        body.alias("body"), words(F.col(text)).alias("tokens"))
    counted = split.select(
        *keep, "host_key", "text_key", "body", "tokens", F.size("tokens").alias("n"),
        F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("worded"))
    hashed = counted.withColumn("hashes", _window_hashes(F.col("tokens"), F.col("n"), window))
    # One chain of transforms: nothing it needs is computed again for another line.
    read = F.transform("worded", lambda x: F.struct(
        F.length(x).alias("n"), normal_line(x).alias("normal"), _telling_words(x).alias("t")))
    lines = F.transform(read, lambda e: F.struct(
        F.xxhash64(e["normal"]).alias("h"), e["n"].alias("n"),
        F.xxhash64(F.col("host_key"), e["normal"], e["t"]).alias("c"),
        F.size(e["t"]).alias("w"), _line_hashes(e["t"], F.col("host_key")).alias("g")))
    placed = hashed.withColumn("placed", _placed(F.col("hashes")))
    return placed.select(
        *keep, "host_key", "text_key", F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("tokens", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("placed").isNull(), F.lit(0).cast("long"))
        .otherwise(_covered_words(F.col("placed"), window)).alias("n_repeat_words"),
        lines.alias("lines"))


def base_failed(least_words: int = 10, most_repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < least_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeat_percent)


def _place(key: Column) -> Column:
    """The word of a bitmap that a hash's bit is in."""
    return F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(BITMAP_WORDS - 1))


def _inside(key: Column) -> Column:
    return key.bitwiseAND(F.lit(63)).cast("int")


def _bitmap(keys: DataFrame, key: Column) -> DataFrame:
    """One row, ``bitmap``: a bit for each of the given hashes, at a fixed size."""
    k = key.cast("long")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), _inside(k))
    blank = keys.sparkSession.range(BITMAP_WORDS).select(
        F.col("id").alias("at"), F.lit(0).cast("long").alias("word"))
    filled = keys.select(_place(k).alias("at"), one.alias("word")).unionByName(blank) \
        .groupBy("at").agg(F.bit_or("word").alias("word"))
    blocks = filled.groupBy(F.floor(F.col("at") / BITMAP_BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("at", "word")))["word"].alias("words"))
    # Written, so that a plan that asks it several times stays small.
    return settle(blocks.agg(F.flatten(F.array_sort(F.collect_list(
        F.struct("block", "words")))["words"]).alias("bitmap")))


def _bit(bitmap: Column, asked: Column) -> Column:
    """Whether a hash may be among those of a bitmap: 1 where it may, 0 where it is not.

    A null hash is not among them.
    """
    a = asked.cast("long")
    return F.coalesce(F.getbit(F.get(bitmap, _place(a).cast("int")), _inside(a)), F.lit(0))


def _with_bit(rows: DataFrame, bitmap: DataFrame, *asked: Column) -> DataFrame:
    """The rows and, as ``at_most``, how many of the hashes asked may be among the bitmap's.

    The bitmap comes to the tasks by one broadcast. As a scalar it would be a constant of
    every expression that asks it, and the driver would write each copy into every task's code.
    """
    bits = [_bit(F.col("bitmap"), a) for a in asked]
    return rows.crossJoin(F.broadcast(bitmap)) \
        .select(*rows.columns, sum(bits[1:], bits[0]).alias("at_most"))


def _may_hold(keys: DataFrame, key: Column) -> Callable[[Column], Column]:
    """:func:`_bit` on the bitmap of the given hashes, for a table that asks it once."""
    bitmap = _bitmap(keys, key).scalar()
    return lambda asked: _bit(bitmap, asked)


def _own_lines(others: DataFrame, frequent: DataFrame, least_documents: int) -> DataFrame:
    """The lines of ``OWN_WORDS`` and more that are neither common nor edits of such.

    ``others`` are the lines that are no candidates.
    """
    asked = F.explode("g").alias("s")
    common = settle(frequent.groupBy("c", "text_key").agg(F.lit(1).alias("one"))
                    .groupBy("c").agg(F.count(F.lit(1)).alias("texts"))
                    .filter(F.col("texts") > least_documents).select("c"))
    shingles = settle(frequent.join(common, "c", "left_semi").select(asked).distinct())
    lines = others.unionByName(frequent.join(common, "c", "left_anti").select(*others.columns)) \
        .filter(F.col("w") >= OWN_WORDS)
    lines = _with_bit(lines, _bitmap(shingles, F.col("s")),
                      *[F.get("g", F.lit(k)) for k in range(LINE_HASHES)])
    close = F.col("at_most") * 3 >= F.size("g")
    near = settle(lines.filter(close))
    shared = near.select("c", asked).join(shingles, "s") \
        .groupBy("c", "s").agg(F.lit(1).alias("one")) \
        .groupBy("c").agg(F.count(F.lit(1)).alias("shared"))
    told = near.join(shared, "c", "left") \
        .filter(F.coalesce("shared", F.lit(0)) * 3 < F.size("g"))
    return lines.filter(~close).unionByName(told.select(*lines.columns)).drop("at_most")


def _classes(own: DataFrame) -> DataFrame:
    """(host_key, text_key, without, own): the class of a text's own lines.

    ``without`` is null for all of them; for each own line that is a candidate there
    is a row beside that without it, whose class is null where no other is left.
    """
    def smallest(k: int) -> Column:
        return F.min(F.array_min(F.transform("g", lambda x: F.xxhash64(F.lit(k), x))))

    each = [smallest(k).alias(f"s{k}") for k in range(SKETCHES)]
    text = ["host_key", "text_key"]
    left_out = settle(own.filter("frequent").select(*text, F.col("h").alias("without"))
                      .distinct())
    asked = _with_bit(own, _bitmap(left_out, F.xxhash64(*text)), F.xxhash64(*text))
    g = F.when(F.col("h") != F.col("without"), F.col("g"))
    sketches = own.groupBy(*text).agg(*each) \
        .withColumn("without", F.lit(None).cast("long")).unionByName(
            asked.filter("at_most = 1").join(left_out, text)
            .select(*text, "without", g.alias("g"))
            .groupBy(*text, "without").agg(*each))
    who = [*text, "without"]
    rows = sketches.select(*who, F.explode(F.array(
        *[f"s{k}" for k in range(SKETCHES)])).alias("s")) \
        .withColumn("who", F.xxhash64("text_key", F.coalesce("without", F.lit(0).cast("long"))))
    rows = settle(rows)
    shared = rows.groupBy("host_key", "s").agg(F.count(F.lit(1)).alias("n"))
    first = rows.select("host_key", "who", "s").join(shared, ["host_key", "s"]) \
        .groupBy("host_key", "who").agg(F.max(F.struct("n", "s")).alias("best"))
    # A copy that lacks the hash most copies share joins them by another one.
    passed = rows.select("host_key", "who", "s").join(first, ["host_key", "who"]) \
        .groupBy("host_key", "s").agg(F.max("best").alias("best"))
    return rows.join(passed, ["host_key", "s"], "left").groupBy(*who) \
        .agg(F.max("best")["s"].alias("own"))


def frequent_lines(measured: DataFrame, least_documents: int = 10,
                   least_share: float = 0.001) -> DataFrame:
    """(host_key, h): the lines above the limits.

    Copies of one line within a document and repeated documents are collapsed
    before anything is shuffled by line.
    """
    text = ["host_key", "text_key"]
    lines = measured.select(*text, F.explode("lines").alias("line")) \
        .select(*text, "line.h", "line.c", "line.w", "line.g")
    candidates = settle(
        lines.groupBy("host_key", "h", "text_key").agg(F.lit(1).alias("one"))
        .groupBy("host_key", "h").agg(F.count(F.lit(1)).alias("texts"))
        .filter(F.col("texts") > least_documents)
        .select("host_key", "h", F.lit(True).alias("frequent")))
    line_key = F.xxhash64("host_key", "h")
    asked = _with_bit(lines, _bitmap(candidates, line_key), line_key)
    marked = settle(asked.filter("at_most = 1").drop("at_most")
                    .join(candidates, ["host_key", "h"], "left"))
    frequent = marked.filter("frequent")
    others = asked.filter("at_most = 0").drop("at_most").withColumn("frequent", F.lit(None).cast("boolean")) \
        .unionByName(marked.filter(F.col("frequent").isNull()))
    own = settle(_classes(_own_lines(others, frequent, least_documents)))
    held = frequent.select(*text, "h").distinct()
    first = held.groupBy(*text).agg(
        F.slice(F.sort_array(F.collect_set("h")), 1, 2).alias("first"))
    texts = settle(measured.select(*text).distinct()
                   .join(own.filter("without IS NULL").drop("without"), text, "left")
                   .join(first, text, "left"))
    exceptions = own.filter("without IS NOT NULL").select(
        *text, F.col("without").alias("h"), F.struct(F.col("own").alias("own")).alias("but"))

    def class_of(own: Column, other: Column, last: Column) -> Column:
        return F.when(own.isNotNull(), F.struct(F.lit(0).alias("kind"), own.alias("key"))) \
            .when(other.isNotNull(), F.struct(F.lit(1).alias("kind"), other.alias("key"))) \
            .otherwise(F.struct(F.lit(2).alias("kind"), last.alias("key")))

    smallest, second = F.get("first", F.lit(0)), F.get("first", F.lit(1))
    outside = class_of(
        F.when(F.col("but").isNull(), F.col("own")).otherwise(F.col("but.own")),
        F.when(smallest == F.col("h"), second).otherwise(smallest), F.lit(0).cast("long"))
    counts = held.join(texts, text).join(exceptions, [*text, "h"], "left") \
        .select("host_key", "h", outside.alias("class")) \
        .groupBy("host_key", "h", "class").agg(F.lit(1).alias("one")) \
        .groupBy("host_key", "h").agg(F.count(F.lit(1)).alias("classes"))
    hosts = texts.select("host_key", class_of(F.col("own"), smallest, F.col("text_key"))
                         .alias("class")) \
        .groupBy("host_key", "class").agg(F.lit(1).alias("one")) \
        .groupBy("host_key").agg(F.count(F.lit(1)).alias("host_classes"))
    return counts.filter(F.col("classes") > least_documents) \
        .join(hosts, "host_key") \
        .filter(F.col("classes") > F.col("host_classes") * least_share) \
        .select("host_key", "h")


def depleted(measured: DataFrame, frequent: DataFrame, least_left: float = 0.3) -> DataFrame:
    """(host_key, text_key, bad_lines, is_depleted) of texts with such lines.

    Depleted are texts of whose lines less than ``least_left`` is left, by length.
    """
    total = F.aggregate("lines.n", F.lit(0).cast("long"), lambda a, n: a + n)
    hit = measured.select("host_key", "text_key", total.alias("total"),
                          F.explode("lines").alias("line")) \
        .select("host_key", "text_key", "total", "line.h", "line.n") \
        .join(settle(frequent), ["host_key", "h"]) \
        .groupBy("host_key", "text_key", "total").agg(
            F.sum("n").alias("removed"), F.collect_set("h").alias("bad_lines"))
    rows = measured.groupBy("host_key", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    left = F.col("total") - F.col("removed") / F.col("rows")
    return hit.join(rows, ["host_key", "text_key"]).select(
        "host_key", "text_key", "bad_lines", (left < F.col("total") * least_left)
        .alias("is_depleted"))


def judge(docs: DataFrame, text: str = "text", host: str = "source",
          keep: tuple[str, ...] = ("doc_id",), **limits) -> DataFrame:
    """One row per document: base counts, ``base_failed``, ``kept`` and the lines to remove."""
    measured = settle(measure(docs, text, host, keep))
    verdicts = depleted(measured, frequent_lines(measured, **limits))
    failed = base_failed()
    return measured.drop("lines") \
        .join(verdicts, ["host_key", "text_key"], "left") \
        .withColumn("base_failed", failed) \
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce("is_depleted", F.lit(False)))


def clean(docs: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The kept documents, without the lines above the limits; columns as they came."""
    body = whole(F.col(text))
    keys = {"host_key": null_safe_key(F.col(host)),
            "text_key": F.xxhash64(body, F.reverse(F.substring(body, 1, 64)))}
    verdicts = judge(docs, text, host, keep=(), **limits) \
        .select(F.col("host_key").alias("_hk"), F.col("text_key").alias("_tk"), "kept",
                "bad_lines") \
        .dropDuplicates(["_hk", "_tk"]).filter("kept") \
        .select("_hk", "_tk", F.col("bad_lines").alias("_bad"))
    rest = F.array_join(F.filter(F.split(body, "\n"), lambda x: ~F.array_contains(
        F.col("_bad"), F.xxhash64(normal_line(x)))), "\n")
    joined = docs.join(verdicts, (keys["host_key"] == F.col("_hk"))
                       & (keys["text_key"] == F.col("_tk")))
    cleaned = F.when(F.col("_bad").isNull(), F.col(text)).otherwise(rest)
    out = joined.withColumn(text, cleaned)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_bad").isNull(), F.col("n_chars"))
                             .otherwise(F.length(text)))
    return out.select(*docs.columns)
