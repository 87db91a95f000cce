"""Entity identifiers: precedence, exact names, fuzzy names, probing."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.names import separator_variants, symbol

FUZZY_CUTOFF = 0.90
GRAM = 3


def name_map(current: DataFrame, log: DataFrame, *, entity: str = "ticker",
             name: str = "company_name", order: Sequence[str] = ("position",)) -> DataFrame:
    """Entity -> name: the current list wins, the log fills gaps, first seen first.

    ``order`` columns of each list say which row was seen first.
    """
    listed = current.select(entity, name, *order).withColumn("_source", F.lit(0))
    logged = log.select(entity, name, *order).withColumn("_source", F.lit(1))
    # Within the current list a later row replaces an earlier one.
    sign = F.when(F.col("_source") == 0, -F.col(order[0])).otherwise(F.col(order[0]))
    rest = [F.col(column) for column in order[1:]]
    both = listed.unionByName(logged).where(F.col(entity).isNotNull() & (F.col(entity).cast("string") != ""))
    return both.groupBy(entity).agg(
        F.min_by(name, F.struct("_source", sign.alias("_at"), *rest, name)).alias(name))


def _one_per_symbol(df: DataFrame, key: Column, *columns: str) -> DataFrame:
    """One row per symbol (``_key``) however it is spelled: the smallest cik's."""
    answered = df.where(F.col("cik").isNotNull()).select(key.alias("_key"), *columns)
    return answered.groupBy("_key").agg(
        F.min_by(F.struct(*columns), F.struct(*columns)).alias("_row")) \
        .select("_key", *[F.col(f"_row.{c}").alias(c) for c in columns])


def resolve_ids(entities: DataFrame, *, spans: DataFrame, overrides: DataFrame,
                recovered: DataFrame, current_map: DataFrame,
                entity: str = "ticker") -> DataFrame:
    """(entity, cik, valid_from, valid_to, route) by strict precedence.

    Span table, then override, then recovered id, then the current map under
    the symbol and its separator spellings. One row per span; entities nothing
    answers get a null id and route ``unresolved``. A source that spells one
    symbol twice answers once, with its smallest id.
    """
    wanted = entities.select(entity).distinct().withColumn("_symbol", symbol(entity))

    def source(df: DataFrame, route: str) -> DataFrame:
        return _one_per_symbol(df, symbol(entity), "cik").select(
            F.col("_key").alias("_symbol"), F.col("cik").alias(f"_{route}"))

    spelled = wanted.select(entity, F.posexplode(separator_variants(entity)).alias("_at", "_key"))
    mapped = (
        spelled.join(_one_per_symbol(current_map, symbol(entity), "cik"), "_key")
        .groupBy(entity).agg(F.min_by("cik", "_at").alias("_ticker_map")))
    spanned = spans.select(symbol(entity).alias("_symbol"), F.col("cik").alias("_span"),
                           "valid_from", "valid_to").distinct()
    answers = (
        wanted.join(spanned, "_symbol", "left")
        .join(source(overrides, "override"), "_symbol", "left")
        .join(source(recovered, "recovered"), "_symbol", "left")
        .join(mapped, entity, "left"))
    route = (F.when(F.col("_span").isNotNull(), "CIK_SPANS")
             .when(F.col("_override").isNotNull(), "CIK_OVERRIDES")
             .when(F.col("_recovered").isNotNull(), "recovered_ciks")
             .when(F.col("_ticker_map").isNotNull(), "ticker_map")
             .otherwise("unresolved"))
    return answers.select(
        entity, F.coalesce("_span", "_override", "_recovered", "_ticker_map").alias("cik"),
        "valid_from", "valid_to", route.alias("route"))


def resolve_for_census(entities: DataFrame, *, overrides: DataFrame, current_map: DataFrame,
                       entity: str = "ticker", title: str = "title") -> DataFrame:
    """(entity, cik, title, overridden): override first, else the current map.

    Each spelling is tried in turn, the override before the map.
    """
    wanted = entities.select(entity).distinct()
    spelled = wanted.select(entity, F.posexplode(separator_variants(entity)).alias("_at", "_key"))
    fixed = _one_per_symbol(overrides, symbol(entity), "cik") \
        .withColumnRenamed("cik", "_override")
    listed = _one_per_symbol(current_map, symbol(entity), "cik", title) \
        .select("_key", F.col("cik").alias("_mapped"), F.col(title).alias("_title"))
    hits = spelled.join(fixed, "_key", "left").join(listed, "_key", "left") \
        .where(F.col("_override").isNotNull() | F.col("_mapped").isNotNull())
    answer = F.struct(
        F.coalesce("_override", "_mapped").alias("cik"), F.col("_title").alias("title"),
        F.col("_override").isNotNull().alias("overridden"))
    best = hits.groupBy(entity).agg(F.min_by(answer, "_at").alias("_best"))
    return wanted.join(best, entity, "left").select(
        entity, F.col("_best.cik").alias("cik"), F.col("_best.title").alias("title"),
        F.coalesce("_best.overridden", F.lit(False)).alias("overridden"))


def name_candidates(registry: DataFrame, *, name: str = "norm", identifier: str = "cik",
                    position: str | None = None) -> DataFrame:
    """Distinct (name, identifier, position), position counting first appearances.

    Without a position column identifiers are ordered by their text.
    """
    at = F.min(position) if position else F.lit(0)
    return registry.where(F.col(name) != "").groupBy(name, identifier).agg(at.alias("position"))


def match_exact(targets: DataFrame, candidates: DataFrame, *, name: str = "norm",
                denied: DataFrame | None = None) -> DataFrame:
    """Tag each target ``exact`` / ``exact_ambiguous`` / ``none`` by its name.

    Only the number of identifiers per name travels; the identifiers stay in
    the candidate table. ``denied`` lists (name, identifier) pairs to ignore.
    """
    if denied is not None:
        candidates = candidates.join(denied, [name, "cik"], "left_anti")
    per_name = candidates.groupBy(name).agg(F.count(F.lit(1)).alias("n_candidates"))
    n = F.coalesce("n_candidates", F.lit(0))
    kind = (F.when(F.col(name) == "", "none").when(n == 1, "exact")
            .when(n > 1, "exact_ambiguous").otherwise("none"))
    return targets.join(per_name, name, "left").select(
        *targets.columns, n.alias("n_candidates"), kind.alias("match_kind"))


def _most_facts_first(identifier: str = "cik") -> Column:
    """Orders candidates by facts, then by position, then by identifier."""
    return F.struct((-F.col("n_records")).alias("few"), F.col("position"), F.col(identifier))


def probe_candidates(candidates: DataFrame, ranges: DataFrame, *, name: str = "norm",
                     identifier: str = "cik") -> DataFrame:
    """Of all of a name's candidates, the one with the most facts.

    The earliest candidate wins a tie; a name whose candidates have no facts
    gives no row.
    """
    answer = F.struct(F.col(identifier), "n_records", "first_period", "last_period")
    return (
        candidates.join(ranges, identifier).where(F.col("n_records") > 0)
        .groupBy(name)
        .agg(F.min_by(answer, _most_facts_first(identifier)).alias("_best"))
        .select(name, F.col(f"_best.{identifier}").alias("recovered_cik"),
                F.col("_best.n_records").alias("n_records"), "_best.first_period",
                "_best.last_period"))


# --- fuzzy names -----------------------------------------------------------


def _lost(length, other, matched):
    """Grams a name loses to a partner with which ``matched`` characters match in order.

    Each of the dropped characters breaks at most three 3-grams, each inserted
    one at most two.
    """
    return GRAM * (length - matched) + (GRAM - 1) * (other - matched)


def _require_lossless(cutoff: float, checked: int = 512) -> None:
    """The gram filter is exact only while every name keeps a shared gram.

    A similarity of c forces M >= c/2 * (la + lb) characters to match in order.
    Short lengths are checked one by one, with their rounding; beyond them the
    loss grows in proportion, and rounding adds less than ten grams.
    """
    half = cutoff / 2.0

    def lost(length: int) -> int:
        partners = range(max(1, math.ceil(length * half / (1 - half) - 1e-9)),
                         math.floor(length * (1 - half) / half + 1e-9) + 1)
        matched = {other: math.ceil(half * (length + other) - 1e-9) for other in partners}
        return max((_lost(length, other, m) for other, m in matched.items()
                    if m <= min(length, other)), default=0)

    slope = max(_lost(1, other, half * (1 + other)) for other in (half / (1 - half),
                                                                 (1 - half) / half))
    bad = next((n for n in range(GRAM, checked + 1) if lost(n) >= n - (GRAM - 1)), None)
    if bad is None and slope * checked + 10 >= checked:
        bad = checked + 1
    if bad is not None:
        raise ValueError(
            f"cutoff {cutoff} is too low for an exact {GRAM}-gram filter at length {bad}")


def _prefix_length(length: Column, cutoff: float) -> Column:
    """Grams of a name that suffice to meet every partner at the cutoff."""
    half = cutoff / 2.0
    partners = F.sequence(
        F.greatest(F.ceil(length * (half / (1 - half)) - 1e-9), F.lit(1)).cast("int"),
        F.floor(length * ((1 - half) / half) + 1e-9).cast("int"))

    def lost(other: Column) -> Column:
        matched = F.ceil((length + other) * half - 1e-9)
        return F.when(matched <= F.least(length, other), _lost(length, other, matched)) \
            .otherwise(0)

    return F.array_max(F.transform(partners, lost)) + 1


def _similarity_udf():
    @F.pandas_udf("struct<choose double, report double>")
    def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for targets, names in batches:
            rows = []
            for target, name in zip(targets, names):
                # The best name is chosen with the target as second sequence and
                # reported with it as first; the ratio is not symmetric.
                rows.append((SequenceMatcher(None, name, target).ratio(),
                             round(SequenceMatcher(None, target, name).ratio(), 3)))
            yield pd.DataFrame(rows, columns=["choose", "report"])

    return similarity


def fuzzy_pairs(targets: DataFrame, names: DataFrame, *,
                cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """Candidate (target, name) pairs that can reach the cutoff; none is missed.

    Both inputs hold distinct non-empty strings in a column ``norm``. Names are
    compared through their rarest 3-grams only: two strings at the cutoff share
    so many grams that they must share one among a computable number of each
    one's rarest, so frequent grams need not be joined on at all. Grams are
    counted per (gram, occurrence), the join key includes the partner's length,
    and an edit-distance bound drops most pairs before any Python runs.
    """
    _require_lossless(cutoff)
    half = cutoff / 2.0

    def grams(df: DataFrame) -> DataFrame:
        starts = F.sequence(F.lit(1), F.length("norm") - (GRAM - 1))
        listed = df.where(F.length("norm") >= GRAM).select(
            "norm", F.length("norm").alias("size"),
            F.explode(F.transform(
                starts, lambda i: F.substring(F.col("norm"), i, F.lit(GRAM)))).alias("gram"))
        # The n-th occurrence of a gram within one string is its own element.
        counted = listed.groupBy("norm", "size", "gram").agg(F.count(F.lit(1)).alias("_times"))
        return counted.select(
            "norm", "size", "gram",
            F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("nth"))

    name_grams, target_grams = grams(names), grams(targets)
    # Distinct grams are bounded by the alphabet, not by the data.
    frequency = name_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("_freq"))

    def prefix(df: DataFrame) -> DataFrame:
        rarest = Window.partitionBy("norm").orderBy("_freq", "gram", "nth")
        ranked = df.join(frequency, "gram", "left") \
            .withColumn("_freq", F.coalesce("_freq", F.lit(0))) \
            .withColumn("_rank", F.row_number().over(rarest))
        keep = _prefix_length(F.col("size"), cutoff)
        return ranked.where(F.col("_rank") <= keep).select("norm", "size", "gram", "nth")

    reach = F.sequence(
        F.ceil(F.col("size") * (half / (1 - half)) - 1e-9).cast("int"),
        F.floor(F.col("size") * ((1 - half) / half) + 1e-9).cast("int"))
    probes = prefix(target_grams).select(
        F.col("norm").alias("target"), "gram", "nth", F.explode(reach).alias("size"))
    listed = prefix(name_grams).withColumnRenamed("norm", "name")
    pairs = probes.join(listed, ["gram", "nth", "size"]).select("target", "name").distinct()
    allowed = F.floor((F.length("target") + F.length("name")) * (1 - cutoff) + 1e-9)
    return pairs.where(F.levenshtein("target", "name") <= allowed)


def match_fuzzy(targets: DataFrame, registry: DataFrame, *, name: str = "norm",
                cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """(name, match_name, similarity) for targets with a close registry name.

    The best ratio wins, of equal ratios the larger name in text order. Strings
    are made distinct first, so copies of one name are scored once. Reported
    for review, never adopted.
    """
    wanted = targets.select(F.col(name).alias("norm")).where(F.col("norm") != "").distinct()
    listed = registry.select(F.col(name).alias("norm")).where(F.col("norm") != "").distinct()
    unmatched = wanted.join(listed, "norm", "left_anti")
    scored = fuzzy_pairs(unmatched, listed, cutoff=cutoff).withColumn(
        "_score", _similarity_udf()("target", "name"))
    return (
        scored.where(F.col("_score.choose") >= cutoff)
        .groupBy("target")
        .agg(F.max_by(F.struct("name", F.col("_score.report").alias("similarity")),
                      F.struct(F.col("_score.choose"), F.col("name"))).alias("_best"))
        .select(F.col("target").alias(name), F.col("_best.name").alias("match_name"),
                F.col("_best.similarity").alias("similarity")))


def match_names(targets: DataFrame, registry: DataFrame, *, name: str = "norm",
                identifier: str = "cik", cutoff: float = FUZZY_CUTOFF,
                position: str | None = None, denied: DataFrame | None = None) -> DataFrame:
    """Targets tagged exact / exact_ambiguous / fuzzy / none with the matched name."""
    candidates = name_candidates(registry, name=name, identifier=identifier, position=position)
    if denied is not None:
        candidates = candidates.join(denied, [name, identifier], "left_anti")
    tagged = match_exact(targets, candidates, name=name)
    close = match_fuzzy(tagged.where(F.col("match_kind") == "none"), candidates,
                        name=name, cutoff=cutoff)
    joined = tagged.join(close, name, "left")
    is_exact = F.col("n_candidates") > 0
    return joined.select(
        *targets.columns, "n_candidates",
        F.when(F.col("match_name").isNotNull() & ~is_exact, "fuzzy")
        .otherwise(F.col("match_kind")).alias("match_kind"),
        F.when(is_exact & (F.col("match_kind") != "none"), F.col(name))
        .otherwise(F.col("match_name")).alias("match_name"),
        F.when(is_exact & (F.col("match_kind") != "none"), F.lit(1.0))
        .otherwise(F.col("similarity")).alias("similarity"))


def recover_missing(census: DataFrame, names: DataFrame, registry: DataFrame,
                    ranges: DataFrame, *, entity: str = "ticker",
                    first_seen: str = "first_seen_in_index",
                    last_seen: str = "last_seen_in_index",
                    position: str | None = None) -> DataFrame:
    """Ids for entities flagged NO_CIK, by company name.

    Exact kinds are probed for facts; fuzzy matches keep their name and score
    for review and get no id. ``names`` carries (entity, company_name, norm).
    """
    missing = census.where(F.col("flag") == "NO_CIK").select(entity, first_seen, last_seen)
    targets = missing.join(names, entity)
    matched = match_names(targets, registry, position=position)
    probed = probe_candidates(name_candidates(registry, position=position), ranges)
    found = matched.join(
        probed.select(F.col("norm").alias("_name"), "recovered_cik", "n_records",
                      F.col("first_period").alias("earliest_period_end")),
        (F.col("norm") == F.col("_name")) & F.col("match_kind").startswith("exact"), "left")
    return found.drop("_name").withColumn("tenure_days", F.datediff(last_seen, first_seen))


def propose_remaps(census: DataFrame, names: DataFrame, registry: DataFrame,
                   ranges: DataFrame, *, entity: str = "ticker",
                   position: str | None = None) -> DataFrame:
    """For SUSPECTED_REMAP entities, an older identifier of the same name.

    All other candidates of the name are probed; the proposal is adopted when
    its facts begin earlier. A name's two best candidates are enough for all of
    its entities, because at most one of them is an entity's current id.
    """
    suspects = census.where(F.col("flag") == "SUSPECTED_REMAP").select(
        entity, F.col("cik").alias("old_cik"), F.col("n_eps_records").alias("old_n_records"),
        F.col("earliest_period_end").alias("old_earliest")).join(names, entity, "left")
    candidates = name_candidates(registry, position=position)
    answer = F.struct("cik", "n_records", "first_period", "last_period")
    order = Window.partitionBy("norm").orderBy(_most_facts_first())
    leading = candidates.join(ranges, "cik").where(F.col("n_records") > 0) \
        .withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= 2)
    others = suspects.select(entity, "norm", "old_cik").join(leading, "norm") \
        .where(~F.col("cik").eqNullSafe(F.col("old_cik")))
    best = others.groupBy(entity).agg(F.min_by(answer, "_nth").alias("_best"))
    totals = candidates.groupBy("norm").agg(F.count(F.lit(1)).alias("_all"))
    own = candidates.select("norm", F.col("cik").alias("old_cik"), F.lit(1).alias("_own"))
    joined = suspects.join(best, entity, "left").join(totals, "norm", "left") \
        .join(own, ["norm", "old_cik"], "left")
    return joined.select(
        entity, "company_name", "old_cik", "old_n_records", "old_earliest",
        (F.coalesce("_all", F.lit(0)) - F.coalesce("_own", F.lit(0))).alias("n_candidates"),
        F.col("_best.cik").alias("new_cik"), F.col("_best.n_records").alias("new_n_records"),
        F.col("_best.first_period").alias("new_earliest"),
        F.col("_best.last_period").alias("new_latest"),
        F.coalesce(F.col("_best.first_period") < F.col("old_earliest"), F.lit(False))
        .alias("adopt"))
