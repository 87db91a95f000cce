import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pitpanel.contracts import BULK_PAYLOAD, NESTED_PAYLOAD, RECOVERED_IDS, ContractError, GateError
from pitpanel.operators import gates
from pitpanel.operators.features import build_features
from pitpanel.plans.features import build_verified
from pitpanel.sources import changelog, payloads, protocol, tables
from tests.test_features import panel


def test_csv_keeps_zero_padded_ids(spark, tmp_path):
    path = tmp_path / "ids.csv"
    path.write_text("# note\nticker,company_name,match_kind,resolution_rule,recovered_cik,"
                    "n_eps_records,earliest_period_end\nX,Foo,exact,a,0000000034,5.0,2011-03-31\n")
    row = tables.read_csv(spark, str(path), RECOVERED_IDS, comment="#").collect()[0]
    assert row.recovered_cik == "0000000034" and str(row.earliest_period_end) == "2011-03-31"


def test_provenance_block(spark, tmp_path):
    path = tmp_path / "predictions.csv"
    path.write_text("# Live predictions. PROSE: not a key\n#\n# cut_date   : 2026-09-04  (as of)\n"
                    "# model : logistic\n# Key : no\nticker,p\nX,0.5\n")
    header = tables.read_provenance(spark, str(path))
    assert {r.key: r.value for r in header.collect()} == {
        "cut_date": "2026-09-04  (as of)", "model": "logistic"}
    assert tables.first_token(header, "cut_date").collect()[0][0] == "2026-09-04"
    missing = {r.key for r in tables.missing_provenance(header).collect()}
    assert "cut_date" not in missing and "config" in missing
    differing = gates.inconsistent_provenance(header, {"model": "logistic", "config": "r3"})
    assert [r.key for r in differing.collect()] == ["config"]


def test_table_with_provenance_is_written_once(spark, tmp_path):
    df = panel(spark, [1, 0])
    path = str(tmp_path / "out")
    tables.write_with_provenance(df, {"cut_date": "2020-01-01", "n_train": 2}, path)
    data, provenance = tables.read_with_provenance(spark, path)
    assert data.count() == 2 and provenance == {"cut_date": "2020-01-01", "n_train": "2"}
    with pytest.raises(AnalysisException):
        tables.write_with_provenance(df, {"cut_date": "x"}, path)


def test_features_are_verified_on_the_written_table(spark, tmp_path):
    source = panel(spark, [1, 0, 1, None, 1])
    written = build_verified(source, str(tmp_path / "features"))
    assert written.count() == 5
    leaky = build_features(source).withColumn("prediction_date_lag_1", F.col("prediction_date"))
    with pytest.raises(GateError):
        tables.write_verified(leaky, str(tmp_path / "leaky"), gates.lag_leaks)


def test_missing_table_and_column(spark, tmp_path):
    with pytest.raises(AnalysisException):
        tables.read_table(spark, str(tmp_path / "none"))
    panel(spark, [1]).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ContractError):
        tables.read_table(spark, str(tmp_path / "p"), required=["nothing"])


def test_payload_units_and_fallback(spark):
    def record(value, start="2020-01-01", end="2020-03-31"):
        return {"start": start, "end": end, "filed": "2020-04-20", "val": value, "fy": 2020}

    primary = [{"cik": "1", "units": {"AUD": [record(9.0)], "USD/shares": [record(1.0)]}},
               {"cik": "2", "units": {"EUR": [record(3.0)], "AUD": [record(2.0)]}},
               {"cik": "3", "units": {}},
               {"cik": "4", "units": {"USD/shares": [record(7.0, start=None),
                                                     record(8.0, start="2019-04-01")]}}]
    bulk = [{"cik": c, "facts": {"us-gaap": {"EarningsPerShareDiluted": {
        "units": {"USD/shares": [record(5.0)]}}}}} for c in ("1", "3")]
    def rows(items, schema):
        return spark.createDataFrame([(json.dumps(i),) for i in items], "t string").select(
            F.from_json("t", schema).alias("p")).select("p.*")

    facts = payloads.ingest_facts(rows(primary, NESTED_PAYLOAD), rows(bulk, BULK_PAYLOAD))
    got = sorted((r.cik, r.val, r.source) for r in payloads.shape_facts(facts).collect())
    assert got == [("1", 1.0, "companyconcept"), ("2", 2.0, "companyconcept"),
                   ("3", 5.0, "companyfacts")]


def test_registry_is_read_as_latin_1(spark, tmp_path):
    path = tmp_path / "lookup.txt"
    path.write_bytes("SOCIÉTÉ X:0000000001:\n\nNO ID:\nTHE INC:0000000002:\n\"Q\" CO:0000000003:\n"
                     .encode("latin-1"))
    got = sorted((r.name, r.cik, r.norm) for r in payloads.read_registry(spark, str(path))
                 .collect())
    assert got == [('"Q" CO', "0000000003", "Q"), ("SOCIÉTÉ X", "0000000001", "SOCI T X")]


def test_change_log_columns_and_dates(spark):
    names = changelog.flatten_header([("Date", "Date"), ("Added", "Ticker"), ("Added", "Security"),
                                      ("Removed", "Ticker")])
    raw = spark.createDataFrame(
        [("May 27, 2025", " A ", "Aco", "nan"), ("2024-01-05", "", "", "B"), ("soon", "C", "", "")],
        names)
    got = [(str(r.date), r.added, r.removed) for r in changelog.normalise_changes(raw).collect()]
    assert got == [("2025-05-27", "A", None), ("2024-01-05", None, "B")]
    assert changelog.normalise_changes(raw, keep_undated=True).count() == 3
    with pytest.raises(ContractError):
        changelog.pick_column(names, "ticker", "swapped")


def test_protocol_revision(spark, tmp_path):
    document = {"revision": 3, "evaluation_protocol": {"folds": [
        {"fold": 1, "n_predict_rows": 5, "n_predict_rows_labelled": 4}]}}
    path = tmp_path / "protocol.json"
    path.write_text(json.dumps(document, indent=1))
    read = protocol.read_protocol(spark, str(path), revision=3)
    assert protocol.declared_folds(spark, read).collect()[0].n_predict_rows == 5
    with pytest.raises(ContractError):
        protocol.read_protocol(spark, str(path), revision=2)


def test_provenance_ends_with_the_header(spark, tmp_path):
    path = tmp_path / "run.csv"
    path.write_text("# commit : abc\n# prose only\na,b\n1,2\n# late : no\n")
    assert [(r.key, r.value) for r in tables.read_provenance(spark, str(path)).collect()] \
        == [("commit", "abc")]
    path.write_text("# commit : abc\n# commit : def\na,b\n")
    with pytest.raises(ValueError, match="more than once"):
        tables.read_provenance(spark, str(path))


def test_payloads_are_parsed_once(spark):
    parsed = spark.sparkContext.accumulator(0)

    @F.udf("map<string,array<struct<val:double>>>")
    def parse(i):
        parsed.add(1)
        return {"USD/shares": [(float(i),)]} if i % 2 else None

    primary = spark.range(60).select(F.col("id").cast("string").alias("cik"),
                                     parse("id").alias("units"))
    assert payloads.ingest_facts(primary, spark.createDataFrame(
        [], "cik string, facts map<string,map<string,struct<units:map<string,"
            "array<struct<val:double>>>>>>")).count() == 30
    assert parsed.value == 60
