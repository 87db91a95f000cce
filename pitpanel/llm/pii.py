"""Personal data: fixed patterns, and terms that reveal what the patterns found.

Every match of a pattern is a protected entity (its kind and value). The terms
around it are judged by information: over the documents of the corpus, a term
``t`` near entity ``e`` reveals ``log2(P(e | t) / P(e))`` bits. A term is withheld
near ``e`` when that is at least ``least_bits`` and at least ``least_share`` of the
``log2(1 / P(e))`` bits it takes to single the entity out, and when the two meet in
``least_contexts`` unlike contexts at least. Contexts are told apart by the smallest
hashes of their terms, so the same passage in many near copies is few contexts (where
they are fewer than half of a pair's distinct texts, it is taken to be one). There
are ``SKETCHES`` hash functions, of which the one that sees most contexts counts: under
another one, the smallest hash may be that of the very term.

Entities become their kind in brackets (generalised), revealing terms ``[TERM]``.

Defined cases: null text counts as empty and gives no spans; equal texts get equal
spans; matches that fail a kind's rule are dropped
without a retry; spans of different kinds may overlap and are merged when replaced;
an empty table gives an empty table; other columns are kept or ignored. Patterns
match in linear time: runs are possessive and start where they can first start.
Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.text import SPACE_CHARS, free_name, whole
from pitpanel.session import settle

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
             r"(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Characters besides white space that end a term.
TERM_ENDS = ".,;:!?()[]{}\"'<>|"
#: Code points looked at on either side of an entity.
REACH = 60
SKETCHES = 3
BLOCK = 512
_LONGS = "array<bigint>"


def _may_hold(body: Column, kind: str) -> Column:
    if kind == "email":
        return F.contains(body, F.lit("@"))
    if kind == "phone":
        return F.contains(body, F.lit("+"))
    return body.rlike(r"[0-9]\.[0-9]" if kind == "ip" else "[0-9][0-9 -]{11}")


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    size = F.length(digits)
    if kind == "phone":
        return size.between(9, 15)
    return F.when(size.between(13, 19), _luhn(digits, size)).otherwise(False)


def _luhn(digits: Column, size: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, size - i + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0


def _last(values: Column) -> Column:
    return F.coalesce(F.get(values, F.size(values) - 1), F.lit(0).cast("long"))


def _sums(values: Column) -> Column:
    """Running sums of a short array."""
    return F.aggregate(values, F.array().cast(_LONGS),
                       lambda acc, x: F.concat(acc, F.array(_last(acc) + x)))


def with_matches(docs: DataFrame, body: str, out: str) -> DataFrame:
    """Adds ``out``: array of (kind number, start, end, value), by kind, then start.

    Positions are code points, the end exclusive. A match starts where the pieces
    between matches and the matches before it end; these sums are taken in blocks,
    so a text of very many matches costs little more than their number.
    """
    for number, kind in enumerate(KINDS):
        found, lens, local, offs, made = (f"_{out}_{kind}_{x}" for x in
                                          ("found", "lens", "local", "offs", "spans"))
        pattern, text = PATTERNS[kind], F.col(body)
        docs = docs.withColumn(found, F.when(_may_hold(text, kind), F.struct(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
            F.split(text, pattern).alias("p"))))
        docs = docs.withColumn(lens, F.flatten(F.transform(
            F.col(found)["m"], lambda m, i: F.array(
                F.length(F.get(F.col(found)["p"], i)).cast("long"),
                F.length(m).cast("long")))))
        blocks = F.ceil(F.size(lens) / F.lit(BLOCK)).cast("int")
        docs = docs.withColumn(local, F.when(F.size(lens) > 0, F.transform(
            F.sequence(F.lit(0), blocks - 1),
            lambda b: _sums(F.slice(F.col(lens), b * BLOCK + 1, BLOCK)))))
        docs = docs.withColumn(offs, _sums(F.transform(F.col(local), _last)))
        ends = F.flatten(F.transform(F.col(local), lambda x, b: F.transform(
            x, lambda v: v + F.coalesce(F.get(F.col(offs), b - 1), F.lit(0).cast("long")))))
        docs = docs.withColumn(offs, ends)
        spans = F.transform(F.col(found)["m"], lambda m, i: F.struct(
            F.lit(number).alias("kind"), F.get(F.col(offs), i * 2).alias("start"),
            F.get(F.col(offs), i * 2 + 1).alias("end"), m.alias("value")))
        docs = docs.withColumn(made, F.filter(spans, lambda s: _valid(kind, s["value"]))) \
            .drop(found, lens, local, offs)
    names = [f"_{out}_{kind}_spans" for kind in KINDS]
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,value:string>>")
    return docs.withColumn(out, F.concat(*[F.coalesce(F.col(n), none) for n in names])) \
        .drop(*names)


def listed(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """The spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    """How many of the spans are of one kind, as a long."""
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def text_key(body: Column) -> Column:
    return F.xxhash64(body, F.length(body))


def detect(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (),
           reach: int = REACH) -> DataFrame:
    """(keep, text_key, spans, around): the base spans of each text and their contexts."""
    rows = docs.select(*keep, whole(F.col(text)).alias("_body"))
    rows = with_matches(rows, "_body", "spans")

    def context(s: Column) -> Column:
        left = F.greatest(s["start"] - reach, F.lit(0))
        return F.struct(
            s["kind"].alias("kind"), s["value"].alias("value"), s["start"].alias("start"),
            s["end"].alias("end"), left.alias("left_at"),
            F.substring("_body", left.cast("int") + 1, (s["start"] - left).cast("int"))
            .alias("left"),
            F.substring("_body", s["end"].cast("int") + 1, F.lit(reach + 1)).alias("right"))

    return rows.select(*keep, text_key(F.col("_body")).alias("text_key"), "spans",
                       F.transform("spans", context).alias("around"))


def _blank(text: Column) -> Column:
    """The text with everything that is not a term's character as a blank; same length."""
    return F.translate(text, SPACE_CHARS + TERM_ENDS, " " * len(SPACE_CHARS + TERM_ENDS))


def _terms(text: Column, at: Column, reach: int, is_left: bool) -> Column:
    """(term, start) of the whole terms of one side."""
    pieces = F.split(_blank(text), " ")
    placed = F.aggregate(
        pieces,
        F.struct(at.alias("at"), F.array().cast("array<struct<term:string,start:bigint>>")
                 .alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p) + 1).alias("at"),
            F.concat(acc["out"], F.array(F.struct(p.alias("term"), acc["at"].alias("start"))))
            .alias("out")),
        lambda acc: acc["out"])
    cut = at > 0 if is_left else F.length(text) > reach
    whole_terms = F.when(cut, F.slice(placed, 2, F.greatest(F.size(placed) - 1, F.lit(0)))
                         if is_left else
                         F.slice(placed, 1, F.greatest(F.size(placed) - 1, F.lit(0)))) \
        .otherwise(placed)
    return F.filter(whole_terms, lambda t: t["term"] != "")


def revealing(docs: DataFrame, detected: DataFrame, text: str = "text",
              least_contexts: int = 3, least_bits: float = 1.0, least_share: float = 0.9,
              least_variety: float = 0.5, reach: int = REACH) -> DataFrame:
    """(text_key, terms): sorted (kind, start, end) of the revealing terms of a text."""
    texts = detected.filter(F.size("spans") > 0).select(
        F.monotonically_increasing_id().alias("row"), "text_key", "spans", "around")
    near = texts.select("row", "text_key", "spans", F.explode("around").alias("e")) \
        .select("row", "text_key", "spans",
                F.xxhash64(F.col("e.kind"), F.col("e.value")).alias("entity"),
                F.concat(_terms(F.col("e.left"), F.col("e.left_at"), reach, True),
                         _terms(F.col("e.right"), F.col("e.end"), reach, False)).alias("terms"))

    def smallest(k: int) -> Column:
        return F.array_min(F.transform("terms", lambda t: F.xxhash64(F.lit(k), t["term"])))

    sketch = F.array(*[smallest(k) for k in range(SKETCHES)])
    rows = near.withColumn("contexts", sketch) \
        .select("row", "text_key", "spans", "entity", "contexts", F.explode("terms").alias("t")) \
        .select("row", "text_key", "spans", "entity", "contexts",
                F.xxhash64("t.term").alias("term"),
                F.col("t.start").alias("start"),
                (F.col("t.start") + F.length("t.term")).alias("end")) \
        .filter(~F.exists("spans", lambda s: (s["start"] < F.col("end"))
                          & (s["end"] > F.col("start")))).drop("spans")
    rows = settle(rows)
    pair_rows = rows.groupBy("entity", "term", "row").agg(F.min("text_key").alias("text_key")) \
        .groupBy("entity", "term", "text_key").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("entity", "term").agg(F.sum("n").alias("both"),
                                       F.count(F.lit(1)).alias("texts"))
    pair_contexts = rows.select("entity", "term", F.posexplode("contexts").alias("k", "context")) \
        .groupBy("entity", "term", "k", "context").agg(F.lit(1).alias("one")) \
        .groupBy("entity", "term", "k").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("entity", "term").agg(F.max("n").alias("contexts"))
    pairs = settle(pair_rows.join(pair_contexts, ["entity", "term"])
                   .filter((F.col("contexts") >= least_contexts)
                           & (F.col("contexts") >= F.col("texts") * least_variety)))
    # One row per term leaves each task, whatever the number of texts that hold it.
    spread = docs.select(F.explode(F.array_distinct(
        F.split(_blank_all(whole(F.col(text))), " "))).alias("t")) \
        .groupBy(F.xxhash64("t").alias("term")).agg(F.count(F.lit(1)).alias("term_rows"))
    entities = texts.select("row", F.explode("around").alias("e")) \
        .groupBy(F.xxhash64("e.kind", "e.value").alias("entity"), "row") \
        .agg(F.lit(1).alias("one")).groupBy("entity") \
        .agg(F.count(F.lit(1)).alias("entity_rows"))
    total = detected.agg(F.count(F.lit(1)).alias("total"))
    judged = pairs.join(spread, "term").join(entities, "entity").join(F.broadcast(total)) \
        .withColumn("bits", F.log2(F.col("both") * F.col("total")
                                   / (F.col("term_rows") * F.col("entity_rows")))) \
        .withColumn("needed", F.log2(F.col("total") / F.col("entity_rows"))) \
        .filter((F.col("bits") >= least_bits) & (F.col("bits") >= F.col("needed") * least_share))
    return rows.join(judged.select("entity", "term"), ["entity", "term"]) \
        .select("text_key", "start", "end").distinct().groupBy("text_key") \
        .agg(F.sort_array(F.collect_list(F.struct(
            F.lit(len(KINDS)).alias("kind"), "start", "end"))).alias("terms"))


def _blank_all(body: Column) -> Column:
    """As :func:`_blank`, by one pattern: cheaper over whole texts."""
    return F.regexp_replace(body, r"[\x09-\x0D.,;:!?()\[\]{}\"'<>|]", " ")


ALL_KINDS = (*KINDS, "term")


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
         **limits) -> DataFrame:
    """(keep, text_key, spans, terms): base spans and revealing terms per document."""
    detected = settle(detect(docs, text, keep))
    terms = revealing(docs, detected, text, **limits)
    # Most copies hold nothing; they take no part in the join by text.
    plain, held = (detected.filter(c).drop("around")
                   for c in (F.size("spans") == 0, F.size("spans") > 0))
    return held.join(terms, "text_key", "left").unionByName(
        plain.withColumn("terms", F.lit(None).cast(terms.schema["terms"].dataType)))


def _replaced(body: Column, marks: Column) -> Column:
    """The text with each of the disjoint, sorted marks in the place of its span."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])
    parts = F.transform(marks, lambda m, i: F.concat(
        F.substring(body, F.coalesce(F.get(marks, i - 1)["end"], F.lit(0)).cast("int") + 1,
                    (m["start"] - F.coalesce(F.get(marks, i - 1)["end"], F.lit(0))).cast("int")),
        F.get(names, m["kind"])))
    tail = F.substring(body, F.coalesce(F.get(marks, F.size(marks) - 1)["end"], F.lit(0))
                       .cast("int") + 1, F.length(body))
    return F.concat(F.array_join(parts, ""), tail)


def _merged(spans: Column) -> Column:
    """Disjoint (start, end, kind): spans that overlap become one, of the first's kind."""
    kind = "array<struct<start:bigint,end:bigint,kind:int>>"

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        longer = F.struct(last["start"].alias("start"),
                          F.greatest(last["end"], s["end"]).alias("end"),
                          last["kind"].alias("kind"))
        kept = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(F.size(acc) == 0, F.array(s)) \
            .when(s["start"] < last["end"], F.concat(kept, F.array(longer))) \
            .otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.sort_array(spans), F.array().cast(kind), step)


def sanitise(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The documents with entities generalised and revealing terms withheld."""
    mark, spans = free_name(docs, "_pii_key", "_pii_spans")
    found = find(docs, text, (), **limits).dropDuplicates(["text_key"])
    every = F.concat(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))),
        F.transform(F.coalesce("terms", F.array().cast(
            "array<struct<kind:int,start:bigint,end:bigint>>")), lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    marks = found.select(F.col("text_key").alias(mark), _merged(every).alias(spans)) \
        .filter(F.size(spans) > 0)
    body = whole(F.col(text))
    suspect = F.lit(False)
    for kind in KINDS:
        suspect = suspect | _may_hold(body, kind)
    joined = docs.filter(suspect).join(marks, text_key(body) == F.col(mark), "left") \
        .unionByName(docs.filter(~suspect), allowMissingColumns=True)
    out = joined.withColumn(text, F.when(F.col(spans).isNull(), F.col(text))
                            .otherwise(_replaced(body, F.col(spans))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars"))
                             .otherwise(F.length(text)))
    return out.select(*docs.columns)
