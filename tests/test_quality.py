import pytest
from pyspark.sql import functions as F

from tabscope.operators import checks, duplicates, prepare, quality, registry
from tabscope.operators.quality import TableContract, ValueRule


def test_value_quality_fixture(spark):
    df = spark.createDataFrame(
        [("A", "No"), (None, "Yes"), ("   ", "Maybe"), ("D", "No")], "customer_id string, churn string"
    )
    rules = {"customer_id": ValueRule(required=True), "churn": ValueRule(required=True, allowed=("No", "Yes"))}
    rows = {r.column: r for r in quality.value_quality(df, rules).collect()}
    assert (rows["customer_id"].missing, rows["customer_id"].blank, rows["customer_id"].affected) == (1, 1, 2)
    assert rows["churn"].invalid == 1 and rows["churn"].issue_types == "Unexpected value"
    assert rows["customer_id"].affected_percent == 50.0


def test_value_rules_numeric_and_case(spark):
    df = spark.createDataFrame([("1",), ("2.5",), ("x",), ("-3",), ("99",)], "v string")
    rule = {"v": ValueRule(integer=True, minimum=0, maximum=50)}
    row = quality.value_quality(df, rule).collect()[0]
    assert row.issue_types == "Non-numeric value, Non-integer value, Below minimum, Above maximum" and row.invalid == 4
    text_rule = {"v": ValueRule(allowed=("X",), case_sensitive=False)}
    row = quality.value_quality(df, text_rule).collect()[0]
    assert (row.inconsistent, row.invalid) == (1, 4)


def test_missing_samples_collapse(spark):
    df = spark.createDataFrame([(None,), (None,), (" ",), ("q",), ("q",), ("r",)], "v string")
    rule = {"v": ValueRule(required=True, allowed=("a",))}
    rows = quality.value_issue_samples(df, rule, k=1).collect()
    assert {(r.issue, r.raw_value, r.n) for r in rows} == {
        ("Missing value", "<missing>", 2),
        ("Blank value", " ", 1),
        ("Unexpected value", "q", 2),
    }


@pytest.mark.parametrize(
    "bad", [dict(allowed=()), dict(allowed="abc"), dict(minimum=1), dict(numeric=True, minimum=3, maximum=2)]
)
def test_invalid_rules_are_rejected(bad):
    with pytest.raises(ValueError):
        ValueRule(**bad)


def test_key_profile_ignores_nulls(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k int")
    row = quality.key_profile(df, ["k"]).collect()[0].asDict()
    assert row == dict(rows=5, non_null=3, unique_values=2, missing=2, duplicated_values=1, duplicated_rows=2)
    assert quality.duplicated_rows(df, ["k"]).count() == 2


def test_hot_key_is_counted_whole(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.lit("x").alias("v"))
    assert quality.duplicated_rows(df, ["k"]).count() == 10001
    row = duplicates.identifier_conflicts(df, ["k"]).collect()[0]
    assert (row.k, row.group_size, row.classification) == (7, 10001, "Repeated identical record")


def test_type_families(spark):
    df = spark.createDataFrame([(1, 1.0, "a", True)], "i int, d double, s string, b boolean")
    rows = {r.column: r.status for r in quality.schema_check(df, {"i": "numeric", "d": "integer", "s": ["string", "int"], "z": "any"}).collect()}
    assert rows == {"i": "Match", "d": "Mismatch", "s": "Match", "b": "Not declared", "z": "Missing column"}
    assert not quality.matches_family(df.schema["b"].dataType, "numeric")
    with pytest.raises(ValueError):
        quality.matches_family(df.schema["b"].dataType, "quaternion")


def test_raw_contract_and_gate(spark):
    contract = TableContract(
        ("id", "c", "y"), {"id": "string", "c": "string", "y": "string"}, ("id",), "y", ("No", "Yes"), {"c": ("a", "b")}
    )
    good = spark.createDataFrame([("1", "a", "No"), ("2", "b", "Yes")], "id string, c string, y string")
    table = quality.raw_contract(good, contract)
    checks.assert_checks(table)
    bad = spark.createDataFrame([("1", "a", "No"), ("1", "z", None), (" ", "a", "No")], "id string, c string, y string")
    failed = {(r["check"], r.item, r.n_violations) for r in quality.raw_contract(bad, contract).where("not passed").collect()}
    assert failed == {
        ("identifiers_not_blank", "id", 1),
        ("identifiers_unique", "id", 2),
        ("target_valid", "y: missing", 1),
        ("target_valid", "y: absent", 1),
        ("categories_valid", "c: unexpected", 1),
        ("categories_valid", "c: absent", 1),
    }
    with pytest.raises(checks.ChecksFailed, match="identifiers_unique"):
        checks.assert_checks(quality.raw_contract(bad, contract), ["identifiers_unique"])


def test_duplicates_group_nulls(spark):
    df = spark.createDataFrame(
        [("a", 1, "x", "No"), ("b", 1, "x", "Yes"), ("c", None, "y", None), ("d", None, "y", None), ("a", 1, "x", "No")],
        "id string, n int, f string, y string",
    )
    assert [(r.id, r.group_size) for r in duplicates.exact_duplicates(df).collect()] == [("a", 2)]
    assert duplicates.exact_duplicate_rows(df).count() == 2
    profiles = {r.group_size: r for r in duplicates.repeated_profiles(df, ["n", "f"], ["id"], "y").collect()}
    assert profiles[3].classification == "Target disagreement" and profiles[2].classification == "Same target"
    summary = {r.metric: (r.group_count, r.row_count) for r in duplicates.duplicate_summary(df, ["id"], ["n", "f"], "y").collect()}
    assert summary["Exact duplicate records"] == (1, 2) and summary["Conflicting duplicate identifiers"] == (0, 0)
    assert summary["Repeated feature profiles"] == (2, 5) and summary["Repeated profiles with the same target"] == (1, 2)


def test_duplicate_summary_counts_and_shuffles_short_keys(spark):
    long = "w" * 40
    rows = [(1, 1, 0.5, "x", "N"), (1, 1, 0.5, "x", "N"), (1, 1, 0.5, long, "N"), (2, None, 0.5, long, None), (3, None, 0.5, long, None), (4, 2, 0.5, "", None), (5, 2, 0.5, None, "N")]
    df = spark.createDataFrame(rows, "id int, n int, q double, f string, y string")
    for extra in ({}, {"a": F.lit(1), "b": F.lit("z")}):  # more than four columns become one digest
        wide = df.withColumns(extra) if extra else df
        features = ["n", "q", "f", *extra]
        summary = {r.metric: (r.group_count, r.row_count) for r in duplicates.duplicate_summary(wide, ["id"], features, "y").collect()}
        assert summary == {
            "Exact duplicate records": (1, 2), "Duplicate identifiers": (1, 3), "Conflicting duplicate identifiers": (1, 3), "Repeated feature profiles": (1, 2),
            "Repeated profiles with the same target": (1, 2), "Repeated profiles with target disagreement": (0, 0),
        }
    mixed = [(1, 1, "a"), (2, 1, "b"), (3, 2, None), (4, 2, "~"), (5, 3, "v" * 50), (6, 3, "v" * 50)]
    got = duplicates.duplicate_summary(spark.createDataFrame(mixed, "id int, n int, y string"), ["id"], ["n"], "y").collect()
    assert [(r.group_count, r.row_count) for r in got] == [(0, 0), (0, 0), (0, 0), (3, 6), (1, 2), (2, 4)]
    # two aggregates of the rows, neither with a digest of numbers or an expanded row
    plan = duplicates.duplicate_summary(df, ["id"], ["n", "q"], "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "concat(" not in plan.replace("concat(=", "")


def test_row_digest_is_injective_on_borders(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc"), ("~", None)], "x string, y string")
    assert df.select(duplicates.row_digest(["x", "y"])).distinct().count() == 4


def test_registry_checks(spark):
    parent = spark.createDataFrame([(1, "open"), (2, "open"), (3, "closed")], "id int, state string")
    child = spark.createDataFrame([(10, 1), (11, 1), (12, 9), (13, None)], "cid int, ref int")
    assert [(r.reference, r.n) for r in registry.reference_check(child, "ref", parent, "id").collect()] == [(9, 1)]
    assert {r.id for r in registry.coverage_check(parent, "id", child, "ref").collect()} == {2, 3}
    assert {(r.id, r.links) for r in registry.link_counts(parent, "id", child, "ref").collect()} == {(1, 2), (2, 0), (3, 0)}
    rows = registry.blockers(parent, "id", child, "ref", "cid", F.col("state") == "open").collect()
    assert {(r.id, r.linked) for r in rows} == {(1, 10), (1, 11), (2, None)}
    ordered = registry.order_by_priority(parent, {"state": ["closed"]}, "id").collect()
    assert [r.id for r in ordered] == [3, 1, 2]
    arrays = spark.createDataFrame([([1, 5],), ([5],)], "refs array<int>")
    assert [(r.reference, r.n) for r in registry.reference_check(arrays, "refs", parent, "id").collect()] == [(5, 2)]


def test_target_encoding(spark):
    df = spark.createDataFrame([("No",), ("Yes",), ("?",), (None,)], "y string")
    encoded = prepare.encode_target(df, "y", {"No": 0, "Yes": 1})
    assert [r.label for r in encoded.collect()] == [0, 1, None, None]
    got = {r["check"]: r.n_violations for r in prepare.target_encoding_checks(encoded, "y").collect()}
    assert got == {"labels_present": 1, "labels_mapped": 1}
    with pytest.raises(ValueError):
        prepare.encode_target(df, "y", {"No": 0, "Yes": 2})


def test_preservation(spark):
    before = spark.createDataFrame([(1, "a", None), (2, "b", 1.0)], "k int, x string, v double")
    after = spark.createDataFrame([(1, "a", 0.0), (2, "B", 1.0)], "k int, x string, v double")
    failed = prepare.preservation_check(before, after, ["k"], ["v"]).where("not passed").collect()
    assert [(r["check"], r.item, r.n_violations) for r in failed] == [("column_unchanged", "x", 1)]
