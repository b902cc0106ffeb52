import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.functions import rules
from sightline.functions.columns import redact
from sightline.operators import detect as det
from sightline.operators import longform as lf
from sightline.plans import scanning

# One text per detector that has no match in the driver tables, and what is found in it.
SAMPLES = {
    "ipv4": ("src=10.1.2.3;", ["10.1.2.3"]),
    "ipv6": ("at 2001:0db8:85a3:0000:0000:8a2e:0370:7334.", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"]),
    "fqdn": ("see host-1.corp.example.com now", ["host-1.corp.example.com"]),
    "ports": ("host:8080 and", [":8080"]),
    "hostname_enterprise": ("on NYC-WEB01-12 ok", ["NYC-WEB01-12"]),
    "hostname_workstation": ("ws-ab1-3", ["ws-ab1-3"]),
    "hostname_server": ("SRV-DB-77!", ["SRV-DB-77"]),
    "device_guid": ("{123e4567-e89b-12d3-a456-426614174000}", ["123e4567-e89b-12d3-a456-426614174000"]),
    "email": ("to a.b+c@ex-1.org,", ["a.b+c@ex-1.org"]),
    "domain_user": ("CORP\\j.doe logged", ["CORP\\j.doe"]),
    "logon_event": ("event 4624 and 46245", ["4624"]),
    "http_status": ("404 4040", ["404"]),
    "api_endpoint": ("GET /api/v1/users", ["/api/v1/users"]),
    "url_path": ("https://x.y/z?q=1 end", ["https://x.y/z?q=1"]),
    "aws_instance": ("i-0abc1234def", ["i-0abc1234def"]),
    "aws_volume": ("vol-0abc1234", ["vol-0abc1234"]),
    "region_code": ("eu-west-1a", ["eu-west-1a"]),
    "swift_code": ("DEUTDEFF500 deutdeff", ["DEUTDEFF500"]),
    "iban": ("DE89370400440532013000", ["DE89370400440532013000"]),
    "card_number": ("4111111111111111", ["4111111111111111"]),
    "trading_symbol": ("NYSE:IBM", ["NYSE:IBM"]),
    "patient_id": ("PT123456", ["PT123456"]),
    "medical_record": ("MRN1234567", ["MRN1234567"]),
    "npi": ("1234567890", ["1234567890"]),
    "phi_marker": ("has SSN and dob", ["SSN"]),
    "customer_id": ("CUST123456", ["CUST123456"]),
    "order_id": ("ORD00AF12", ["ORD00AF12"]),
    "sku": ("ABC12345", ["ABC12345"]),
    "barcode": ("12345678", ["12345678"]),
    "asset_tag": ("AT123456", ["AT123456"]),
    "serial_number": ("SNAB12CD34", ["SNAB12CD34"]),
    "lot_number": ("LOT00FF11", ["LOT00FF11"]),
    "meter_id": ("MTR123456", ["MTR123456"]),
    "scada_tag": ("AB_1234", ["AB_1234"]),
    "grid_node": ("GN1234", ["GN1234"]),
    "cardholder_data": ("CHD123456", ["CHD123456"]),
    "financial_control": ("FC1234", ["FC1234"]),
    "eu_citizen_id": ("DE123456", ["DE123456"]),
    "consent_record": ("CON0011AABB", ["CON0011AABB"]),
}


def long(spark, values, table="t", column="c"):
    return spark.createDataFrame([(table, column, str(i), v) for i, v in enumerate(values)], "table string, column string, row_id string, value string")


@pytest.mark.parametrize("name", list(SAMPLES))
def test_detector(spark, name):
    detector = next(d for d in [*rules.DETECTORS, *rules.INDUSTRY_DETECTORS, *rules.COMPLIANCE_DETECTORS] if d.name == name)
    text, want = SAMPLES[name]
    row = spark.createDataFrame([(text,)], "t string").select(det.found_in(F.col("t"), detector).alias("f")).first()
    assert row["f"] == want


def test_letters_with_accents_are_part_of_a_word(spark):
    status = next(d for d in rules.DETECTORS if d.name == "http_status")
    row = spark.createDataFrame([("é404 404é 404",)], "t string").select(det.found_in(F.col("t"), status).alias("f")).first()
    assert row["f"] == ["404"]


def test_ignore_case_switch(spark):
    swift = next(d for d in rules.INDUSTRY_DETECTORS if d.name == "swift_code")
    df = spark.createDataFrame([("deutdeff",)], "t string")
    assert df.select(det.found_in(F.col("t"), swift)).first()[0] == []
    assert df.select(det.found_in(F.col("t"), swift, ignore_case=True)).first()[0] == ["deutdeff"]


def test_all_matches_count_unless_a_cap_is_asked_for(spark):
    frags = lf.raw_fragments(long(spark, [" ".join(f"10.0.0.{i}" for i in range(11))]))
    ipv4 = [d for d in rules.DETECTORS if d.name == "ipv4"]
    n = lambda **k: det.score(det.match_counts(frags, ipv4, **k)).first()["n_distinct"]
    assert n() == 11
    assert n(per_fragment=10) == 10


def test_long_texts_are_read_to_the_end(spark):
    frags = lf.raw_fragments(long(spark, ["x " * 300_000 + "10.9.8.7"]))
    found = det.detect(frags).collect()
    assert [r["evidence"] for r in found if r["detector"] == "ipv4"] == [["10.9.8.7"]]


def test_confidence_and_threshold(spark):
    # 1000 fragments and 3 distinct matches: 3 / 10 is exactly the threshold and is dropped.
    values = ["404", "405", "406"] + ["x"] * 997
    scored = det.score(det.match_counts(lf.raw_fragments(long(spark, values)))).filter("detector = 'http_status'").first()
    assert (scored["n_fragments"], scored["n_distinct"], scored["confidence"]) == (1000, 3, 0.3)
    assert det.detect(lf.raw_fragments(long(spark, values))).filter("detector = 'http_status'").count() == 0
    assert det.detect(lf.raw_fragments(long(spark, values + ["407"]))).filter("detector = 'http_status'").count() == 1


def test_evidence_is_the_smallest_five(spark):
    values = [str(100 + i) for i in range(50, 0, -1)]
    row = det.detect(lf.raw_fragments(long(spark, values))).filter("detector = 'http_status'").first()
    assert row["evidence"] == ["101", "102", "103", "104", "105"]
    assert row["confidence"] == 1.0


def test_empty_input(spark):
    assert det.detect(lf.raw_fragments(long(spark, []))).count() == 0


def fragments_of(spark, value):
    rows = lf.expand_fragments(long(spark, [value])).orderBy("fragment_no").collect()
    return [(r["origin"], r["fragment"]) for r in rows]


def test_json_fragments_of_any_depth(spark):
    text = '{"a": [1, 2.5, {"b\\"x": true, "c": null}], "d": {"e": {"f": {"g": {"h": {"i": "deep"}}}}}, "a": "again"}'
    got = fragments_of(spark, text)
    assert got[0] == ("raw", text)
    assert [f for _, f in got[1:]] == ["a", "1", "2.5", 'b"x', "true", "c", "d", "e", "f", "g", "h", "i", "deep", "a", "again"]


@pytest.mark.parametrize("text", ['{"a": 1', '{"a": 1} x {}', "{not json}", "<a><b></a>", "<!DOCTYPE html><p>x>", "aGVsbG8gd29ybGQhI", "user", "abcdefghijklmnop"])
def test_malformed_text_adds_nothing(spark, text):
    assert fragments_of(spark, text) == [("raw", text)]


def test_long_and_deep_texts_are_expanded(spark):
    long, escapes = "x" * 1_000_000, '\\"' * 100_000
    got = fragments_of(spark, f'{{"a":"{long}","b":"{escapes}","c":[1,true]}}')[1:]
    assert [f for _, f in got] == ["a", long, "b", '"' * 100_000, "c", "1", "true"]
    deep = "[" * 400 + '"end"' + "]" * 400
    assert fragments_of(spark, deep)[1:] == [("json", "end")]
    assert fragments_of(spark, "<a>" + "text " * 200_000 + "</a>")[1:] == [("xml", ("text " * 200_000).strip()), ("xml", "a")]


def test_short_base64_and_entities(spark):
    assert fragments_of(spark, base64.b64encode(b"ok!").decode())[1:] == [("base64", "ok!")]
    assert fragments_of(spark, "word") == [("raw", "word")]
    assert len(fragments_of(spark, '<!DOCTYPE a [<!ENTITY e "boom">]><a>&e;</a>')) == 1
    assert len(fragments_of(spark, "<html><p>not closed</html>")) == 1


def test_xml_and_base64_fragments(spark):
    assert fragments_of(spark, "<a><b> x </b><c/></a>")[1:] == [("xml", "a"), ("xml", "x"), ("xml", "b"), ("xml", "c")]
    encoded = base64.b64encode("mail to a@b.org, é".encode()).decode()
    assert fragments_of(spark, encoded)[1:] == [("base64", "mail to a@b.org, é")]


def test_one_broken_table_does_not_stop_the_others(spark):
    good = spark.createDataFrame([("10.0.0.1",)], "v string")
    out, failed = lf.union_tables({"good": good, "bad": good}, {"bad": "no_such_key"})
    assert [r["table"] for r in out.collect()] == ["good"]
    assert [(r["table"], "no_such_key" in r["error_message"]) for r in failed.collect()] == [("bad", True)]
    assert lf.union_tables({"good": good})[1].count() == 0
    with pytest.raises(ValueError):
        lf.union_tables({"bad": good}, {"bad": "no_such_key"})


def test_to_long_skips_nested_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "x", [1.0]), (2, None, None)], "id int, s string, v array<double>")
    rows = {(r["column"], r["value"]) for r in lf.to_long(df, "t", "id").collect()}
    assert rows == {("id", "1"), ("id", "2"), ("s", "x")}
    assert lf.to_long(df, "t", "id", per_column=1).groupBy("column").count().collect()[0]["count"] == 1


def detections(spark, rows):
    return spark.createDataFrame(rows, "table string, column string, area string, detector string, confidence double, evidence array<string>")


def test_industry_context_and_boost(spark):
    found = detections(spark, [("t", "c", "identity_context", "x", 0.5, ["MRN1234567"]), ("t", "d", "application_telemetry", "y", 0.5, ["MRN1234567"])])
    scores = {r["family"]: (round(r["score"], 6), r["pattern_matches"]) for r in det.industry_scores(found).collect()}
    assert scores["healthcare"] == (3.6, 2)
    assert det.best_family(det.industry_scores(found)).first()[0] == "healthcare"
    boosted = {r["column"]: round(r["confidence"], 6) for r in det.boost(found, F.lit("healthcare")).collect()}
    assert boosted == {"c": 0.9, "d": 0.5}


def test_no_industry_is_generic(spark):
    found = detections(spark, [("t", "c", "identity_context", "x", 0.5, ["plain words"])])
    assert det.best_family(det.industry_scores(found)).first()[0] == "generic"
    families = spark.createDataFrame([("generic",), ("energy",)], "family string")
    got = {(r["family"], r["regime"]) for r in det.compliance_relevance(families).collect()}
    assert got == {("generic", "ISO27001"), ("generic", "NIST"), ("energy", "NERC_CIP"), ("energy", "ICS_CERT"), ("energy", "NIST")}
    assert det.recommended_patterns(families).count() == 3


def test_hinted_columns(spark):
    catalog = spark.createDataFrame([("source_host",), ("plain",)], "column string")
    assert [r["hint_group"] for r in det.hinted_columns(catalog, rules.VARIANT_HINTS).collect()] == ["host_identifiers"]


@settings(max_examples=15, deadline=None)
@given(values=st.lists(st.text(min_size=1, max_size=12).filter(lambda s: "\x00" not in s), max_size=6))
def test_redaction_never_leaks(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    row = spark.createDataFrame([(values,)], "v array<string>").select(redact("v").alias("r")).first()
    assert row["r"] == [f"<redacted:{len(v)}>" for v in values[:3]]


@settings(max_examples=25, deadline=None)
@given(n=st.integers(0, 10**6), total=st.integers(0, 10**9))
def test_confidence_is_a_share(spark, n, total):
    value = spark.range(1).select(det.confidence(F.lit(n), F.lit(total))).first()[0]
    assert 0.0 <= value <= 1.0


@pytest.mark.parametrize("name", ["detections_identity", "detections_application"])
def test_an_area_is_searched_in_every_scanned_table(spark, tmp_path, name):
    text = "mail a.b@ex-1.org at https://x.y/api/v1 404, event 4624"
    rows = {
        "documents": spark.createDataFrame([(1, text)], "doc_id bigint, text string"),
        "pages": spark.createDataFrame([(1, text, text)], "page_id bigint, url string, html string"),
        "conversations": spark.createDataFrame([(1, text)], "conv_id bigint, text string"),
        "events": spark.createDataFrame([(1, 2, text, text)], "event_id bigint, user_id bigint, event_type string, props string"),
    }
    for table, df in rows.items():
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    found = {(r["table"], r["column"]) for r in scanning.QUERIES[name](spark, str(tmp_path)).collect()}
    assert found >= {(t, c) for t, (_, columns) in scanning.SCANNED.items() for c in columns}
    assert ("telemetry", "message") in found or name == "detections_application"
