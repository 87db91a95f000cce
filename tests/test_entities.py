import random
from difflib import SequenceMatcher, get_close_matches

import pytest
from pyspark.sql import functions as F

from pitpanel.functions.names import NOISE_WORDS, normalise_name, pad_id
from pitpanel.operators import entities, spans
from tests.test_membership import day


def test_name_normalisation(spark):
    rows = [("The Foo & Bar Co. (Class A), Inc.", "FOO AND BAR"), ("A/B  Group", "A B"),
            ("THE INC", ""), (None, ""), ("dup dup corp", "DUP DUP")]
    df = spark.createDataFrame(rows, "name string, want string")
    assert df.where(normalise_name("name") != F.col("want")).count() == 0
    assert len(NOISE_WORDS) == 24


def test_id_padding_keeps_long_ids(spark):
    df = spark.createDataFrame([("34",), ("12345678901",)], "v string")
    assert [r[0] for r in df.select(pad_id("v")).collect()] == ["0000000034", "12345678901"]


def test_precedence(spark):
    def ids(rows):
        return spark.createDataFrame(rows, "ticker string, cik string")

    wanted = spark.createDataFrame([("AA",), ("BRK.B",), ("OV",), ("RE",), ("no",)],
                                   "ticker string")
    span_rows = spark.createDataFrame(
        [("AA", "1", None, day(5)), ("AA", "2", day(6), None)],
        "ticker string, cik string, valid_from date, valid_to date")
    got = entities.resolve_ids(
        wanted, spans=span_rows, overrides=ids([("AA", "9"), ("OV", "8")]),
        recovered=ids([("RE", "7"), ("OV", "6")]), current_map=ids([("BRK-B", "5"), ("RE", "4")]))
    rows = sorted((r.ticker, r.cik or "", r.route) for r in got.collect())
    assert rows == [("AA", "1", "CIK_SPANS"), ("AA", "2", "CIK_SPANS"),
                    ("BRK.B", "5", "ticker_map"), ("OV", "8", "CIK_OVERRIDES"),
                    ("RE", "7", "recovered_ciks"), ("no", "", "unresolved")]
    text = {r.ticker: r.cik_span_used for r in spans.describe_spans(
        got.where(F.col("cik").isNotNull())).collect()}
    assert text["AA"] == f"1[:{day(5)}]|2[{day(6)}:]" and text["OV"] == "8"


def test_overlap_choice(spark):
    tenures = spark.createDataFrame(
        [("X", "N", day(0), day(1000)), ("Y", "N", day(3000), None), ("Z", "M", day(0), day(9))],
        "ticker string, norm string, tenure_start date, tenure_end date")
    candidates = spark.createDataFrame(
        [("N", "a", 0), ("N", "b", 1), ("N", "c", 2), ("N", "e", 3)],
        "norm string, cik string, position int")
    ranges = spark.createDataFrame(
        [("a", 5, day(2000), day(2500)), ("b", 3, day(600), day(2000)),
         ("c", 4, day(-100), day(900))],
        "cik string, n_records long, first_period date, last_period date")
    got = {r.ticker: r for r in spans.choose_by_overlap(tenures, candidates, ranges,
                                                        open_end=str(day(4000))).collect()}
    assert (got["X"].chosen_cik, got["X"].overlap_days, got["X"].rule) \
        == ("c", 900, "c_longest_overlap")
    assert (got["X"].n_candidates, got["X"].n_with_records, got["X"].n_overlapping) == (4, 3, 2)
    assert got["Y"].rule == got["Z"].rule == "d_unresolved_ambiguous"


RANGES = "cik string, n_records long, first_period date, last_period date"


def test_probe_looks_at_all_candidates_and_takes_the_first_on_ties(spark):
    candidates = spark.createDataFrame(
        [("N", c, i) for i, c in enumerate("abcdefg")] + [("M", c, i) for i, c in enumerate("xbc")],
        "norm string, cik string, position int")
    ranges = spark.createDataFrame([(c, n, day(0), day(1)) for c, n in
                                    (("b", 7), ("c", 7), ("f", 99), ("g", 99))], RANGES)
    got = {r.norm: (r.recovered_cik, r.n_records)
           for r in entities.probe_candidates(candidates, ranges).collect()}
    assert got == {"N": ("f", 99), "M": ("b", 7)}


def test_remaps_look_at_all_candidates_but_the_own(spark):
    registry = spark.createDataFrame([("N", c, i) for i, c in enumerate("abcdefg")],
                                     "norm string, cik string, position int")
    census = spark.createDataFrame(
        [("P", "SUSPECTED_REMAP", "a", 3, day(9)), ("Q", "SUSPECTED_REMAP", "f", 99, day(9))],
        "ticker string, flag string, cik string, n_eps_records long, earliest_period_end date")
    names = spark.createDataFrame([("P", "n", "N"), ("Q", "n", "N")],
                                  "ticker string, company_name string, norm string")
    ranges = spark.createDataFrame([(c, n, day(0), day(1)) for c, n in
                                    (("a", 3), ("b", 7), ("f", 99))], RANGES)
    got = {r.ticker: (r.new_cik, r.n_candidates, r.adopt) for r in entities.propose_remaps(
        census, names, registry, ranges, position="position").collect()}
    assert got == {"P": ("f", 6, True), "Q": ("b", 6, True)}


def test_one_id_per_symbol_however_spelled(spark):
    two = "ticker string, cik string"
    got = entities.resolve_ids(
        spark.createDataFrame([("A",), ("B-B",)], "ticker string"),
        spans=spark.createDataFrame([], two + ", valid_from date, valid_to date"),
        overrides=spark.createDataFrame([("a", "2"), ("A", "1")], two),
        recovered=spark.createDataFrame([("A", "9")], two),
        current_map=spark.createDataFrame([("B-B", "5"), ("b-b", "4"), ("B-B", "6")], two))
    assert {(r.ticker, r.cik, r.route) for r in got.collect()} == {
        ("A", "1", "CIK_OVERRIDES"), ("B-B", "4", "ticker_map")} and got.count() == 2


def brute_force(targets, names, cutoff=0.90):
    out = {}
    for target in set(targets) - set(names):
        close = get_close_matches(target, sorted(set(names)), n=1, cutoff=cutoff)
        if close:
            out[target] = (close[0], round(SequenceMatcher(None, target, close[0]).ratio(), 3))
    return out


def test_fuzzy_equals_brute_force(spark):
    rng = random.Random(11)
    words = ["HARMAN", "THURMAN", "INTERNATIONAL", "MOTORS", "STEEL", "ENERGY", "PARTNERS",
             "AMERICAN", "ELECTRIC", "BANCORP"]
    names = [" ".join(rng.sample(words, rng.choice([1, 2, 3]))) for _ in range(150)]

    def edit(text):
        letters = list(text)
        for _ in range(rng.choice([1, 1, 2, 3])):
            at = rng.randrange(len(letters))
            action = rng.choice("ids")
            if action == "i":
                letters.insert(at, rng.choice("ABCXYZ "))
            elif action == "d" and len(letters) > 1:
                letters.pop(at)
            else:
                letters[at] = rng.choice("ABCXYZ")
        return " ".join("".join(letters).split())

    targets = [t for t in (edit(rng.choice(names)) for _ in range(200)) if t]
    targets.append("HARMAN INTERNATIONAL")
    names.append("THURMAN INTERNATIONAL")
    # A name shared by a third of the registry must be scored once.
    names += ["AMERICAN ELECTRIC"] * 80
    got = entities.match_fuzzy(spark.createDataFrame([(t,) for t in targets], "norm string"),
                               spark.createDataFrame([(n,) for n in names], "norm string"))
    assert {r.norm: (r.match_name, r.similarity) for r in got.collect()} \
        == brute_force(targets, names)


def test_fuzzy_filter_refuses_inexact_cutoffs(spark):
    one = spark.createDataFrame([("ABCDEF",)], "norm string")
    with pytest.raises(ValueError, match="too low"):
        entities.fuzzy_pairs(one, one, cutoff=0.5)


def test_match_kinds(spark):
    registry = spark.createDataFrame(
        [("ACME STEEL WORKS", "1"), ("TWIN", "2"), ("TWIN", "3"), ("TWIN", "3")],
        "norm string, cik string")
    targets = spark.createDataFrame([("a", "ACME STEEL WORKS"), ("b", "TWIN"),
                                     ("c", "ACME STEEL WORK"), ("d", "OTHER"), ("e", "")],
                                    "ticker string, norm string")
    got = {r.ticker: r for r in entities.match_names(targets, registry).collect()}
    assert {k: r.match_kind for k, r in got.items()} == {
        "a": "exact", "b": "exact_ambiguous", "c": "fuzzy", "d": "none", "e": "none"}
    assert got["b"].n_candidates == 2 and got["c"].match_name == "ACME STEEL WORKS"
    denied = spark.createDataFrame([("ACME STEEL WORKS", "1")], "norm string, cik string")
    barred = {r.ticker: r.match_kind
              for r in entities.match_names(targets, registry, denied=denied).collect()}
    assert barred["a"] == "none" and barred["c"] == "none"
