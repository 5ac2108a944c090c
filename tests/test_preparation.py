import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tabscope.operators import checks, prepare
from tabscope.sources import identity, inventory, store, tables


def people(spark, rows=7043, positives=1869):
    return spark.range(rows).select(
        F.format_string("id-%05d", "id").alias("k"), F.when(F.col("id") < positives, "Yes").otherwise("No").alias("y")
    )


def test_published_split_sizes(spark):
    cut = prepare.stratified_split(people(spark), ["k"], "y", ["No", "Yes"])
    assert {r.split: r["count"] for r in cut.groupBy("split").count().collect()} == {"train": 4930, "validation": 1056, "test": 1057}
    checks.assert_checks(prepare.split_checks(people(spark), cut, ["k"], "y", ["No", "Yes"], tolerance=0.01))


def test_split_does_not_depend_on_order_or_partitions(spark):
    a = prepare.stratified_split(people(spark, 500, 90), ["k"], "y", ["No", "Yes"])
    b = prepare.stratified_split(people(spark, 500, 90).orderBy(F.desc("k")).repartition(9), ["k"], "y", ["No", "Yes"])
    c = prepare.stratified_split(people(spark, 500, 90), ["k"], "y", ["No", "Yes"], seed=43)
    rows = [{(r.k, r.split) for r in x.collect()} for x in (a, b, c)]
    assert rows[0] == rows[1] and rows[0] != rows[2] and len(rows[0]) == 500


def test_split_matches_direct_ranking(spark):
    df = people(spark, 300, 100)
    got = {r.k: r.split for r in prepare.stratified_split(df, ["k"], "y", ["No", "Yes"]).collect()}
    quota = {"Yes": None, "No": None}
    counts = spark.createDataFrame([("No", 200), ("Yes", 100)], "_c string, n bigint")
    quota = {r["_c"]: (r.n_train, r.n_validation) for r in prepare.split_quotas(counts, (0.7, 0.15, 0.15)).collect()}
    assert sum(q[0] for q in quota.values()) == 210
    for y in quota:
        keys = [r.k for r in df.where(F.col("y") == y).collect()]
        keys.sort(key=lambda k: hashlib.md5(f"42|{json.dumps([k])}".encode()).hexdigest())
        train, validation = quota[y]
        for i, k in enumerate(keys):
            assert got[k] == ("train" if i < train else "validation" if i < train + validation else "test")


def test_undeclared_labels_are_reported(spark):
    df = people(spark, 1000, 300).unionByName(spark.createDataFrame([("zz", None), ("zy", "?")], "k string, y string"))
    cut = prepare.stratified_split(df, ["k"], "y", ["No", "Yes"])
    assert cut.count() == 1002 and cut.where("split is null").count() == 2
    failed = {r["check"] for r in prepare.split_checks(df, cut, ["k"], "y", ["No", "Yes"]).where("not passed").collect()}
    assert failed == {"coverage_missing"}


def test_fractions_are_validated(spark):
    with pytest.raises(ValueError):
        prepare.stratified_split(people(spark, 10, 3), ["k"], "y", ["No", "Yes"], (0.5, 0.2, 0.2))


def test_folds_are_balanced(spark):
    folded = prepare.stratified_folds(people(spark, 503, 101), ["k"], "y", ["No", "Yes"], 5)
    rows = prepare.fold_classes(folded, "y").collect()
    for c in ("No", "Yes"):
        sizes = [r.validation_rows for r in rows if r["class"] == c]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    totals = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert sum(totals) == 503 and max(totals) - min(totals) <= 1


def test_membership_key_is_json(spark):
    df = spark.createDataFrame([(1, 'a"b', None)], "i int, s string, n string")
    assert json.loads(df.select(prepare.membership_key(df, ["i", "s", "n"])).collect()[0][0]) == [1, 'a"b', None]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(1, "a", 0.1), (2, None, 2.0), (2, None, 2.0)], "k int, t string, v double")
    one = identity.content_fingerprint(df).collect()[0]
    assert one == identity.content_fingerprint(df.orderBy(F.desc("k")).repartition(3)).collect()[0]
    assert one.digest != identity.content_fingerprint(df.distinct()).collect()[0].digest
    assert one.digest != identity.content_fingerprint(df.fillna("", ["t"])).collect()[0].digest


def test_write_idempotent_and_handoff(spark, tmp_path):
    path = str(tmp_path / "store")
    source = people(spark, 400, 120)
    cut = prepare.stratified_split(source, ["k"], "y", ["No", "Yes"])
    assert store.write_idempotent(cut, path, partition_by=["split"]).collect()[0].status == "created"
    assert store.write_idempotent(cut.repartition(3), path, partition_by=["split"]).collect()[0].status == "reused_equivalent"
    with pytest.raises(store.DivergentContent):
        store.write_idempotent(cut.where("y = 'No'"), path)
    checks.assert_checks(store.verify_handoff(spark, path, source, ["k"], "y", ["No", "Yes"]))
    assert store.write_idempotent(cut.where("y = 'No'"), path, overwrite=True).collect()[0].status == "overwritten"
    assert store.read_current(spark, path).count() == 280
    failed = store.verify_handoff(spark, path, source, ["k"], "y", ["No", "Yes"]).where("not passed").collect()
    assert {"class_present", "coverage_missing", "row_count_preserved"} <= {r["check"] for r in failed}


def test_quick_fingerprint(spark):
    df = spark.createDataFrame([(1, "a", 0.1, [1], {"m": 1}), (2, None, 2.0, None, None), (2, None, 2.0, None, None)], "k int, t string, v double, a array<int>, m map<string,int>")
    digest = lambda d: identity.quick_fingerprint(d).collect()[0]
    one = digest(df)
    assert one.rows == 3 and one == digest(df.orderBy(F.desc("k")).repartition(3))
    for other in (df.limit(2), df.fillna("", ["t"]), df.withColumn("v", F.col("v") + 1e-16 + 2e-16), df.where("k = 1"), df.limit(0)):
        assert digest(other).digest != one.digest
    pair = spark.createDataFrame([("x", None)], "a string, b string")
    assert digest(pair) != digest(pair.select(F.col("b").alias("a"), F.col("a").alias("b")))
    wide = spark.range(3).select("id", *[F.lit(None).cast("int").alias(f"n{i}") for i in range(70)])
    assert digest(wide) != digest(wide.fillna(0, ["n69"])) and digest(df.limit(0)).rows == 0
    # a sum of whole hashes, so two halves of a table add up
    assert digest(df) != digest(df.where("k = 2").union(df.where("k = 2")))


def test_a_plan_that_changes_is_not_committed(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(store.UnstableContent):
        store.write_idempotent(spark.range(50).withColumn("u", F.expr("uuid()")).withColumn("at", F.expr("reflect('java.lang.System', 'nanoTime')")), path)
    with pytest.raises(FileNotFoundError):
        store.read_current(spark, path)
    assert store.write_idempotent(spark.range(50), path).collect()[0].sequence == 1


def test_a_second_writer_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store.write_idempotent(spark.range(5), path)
    last = store._last

    def meanwhile(session, root):
        """Another writer commits after this one has looked."""
        number = last(session, root)
        monkeypatch.setattr(store, "_last", last)
        store.write_idempotent(spark.range(6), path, overwrite=True)
        return number

    monkeypatch.setattr(store, "_last", meanwhile)
    with pytest.raises(store.ConcurrentWrite):
        store.write_idempotent(spark.range(7), path, overwrite=True)
    assert store.read_current(spark, path).count() == 6 and store.manifest(spark, path).count() == 2
    # a manifest file that a dying writer left empty is passed over
    (tmp_path / "store" / "manifest" / "000000003.json").write_bytes(b"")
    assert store.write_idempotent(spark.range(8), path, overwrite=True).collect()[0].sequence == 4
    assert store.read_current(spark, path).count() == 8


def test_handoff_refuses_changed_and_lost_content(spark, tmp_path):
    path = str(tmp_path / "store")
    source = people(spark, 200, 60)
    cut = prepare.stratified_split(source, ["k"], "y", ["No", "Yes"])
    version = store.write_idempotent(cut, path).collect()[0].version
    failed = lambda: {r["check"] for r in store.verify_handoff(spark, path, source, ["k"], "y", ["No", "Yes"]).where("not passed").collect()}
    assert not failed()
    other = cut.withColumn("split", F.when(F.col("split") == "train", "test").otherwise(F.col("split")))
    other.write.mode("overwrite").parquet(f"{path}/{version}")
    assert "stored_digest_matches" in failed()
    cut.limit(150).write.mode("overwrite").parquet(f"{path}/{version}")
    assert {"stored_rows_match", "stored_digest_matches"} <= failed()


def test_csv_round_trip_and_strict_reads(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.1 + 0.2), (2, 'q"', -1e-9)], "k int, t string, v double")
    path = str(tmp_path / "csv")
    df.write.options(header="true", escape='"').csv(path)
    back = tables.read_table(spark, path, "k int, t string, v double", "csv", {"escape": '"'})
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        tables.read_table(spark, path, None, "csv")
    with pytest.raises(Exception):
        tables.read_table(spark, path, "k int, t int, v double", "csv").collect()


def test_write_splits_prunes(spark, tmp_path):
    path = str(tmp_path / "parts")
    tables.write_splits(prepare.stratified_split(people(spark, 100, 30), ["k"], "y", ["No", "Yes"]), path)
    only = spark.read.parquet(path).where("split = 'test'")
    assert only.count() == 15 and "PartitionFilters: [isnotnull(split" in only._jdf.queryExecution().toString()


def test_file_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_bytes(b"hello")
    (tmp_path / ".hidden").write_bytes(b"x")
    rows = {r.path: r for r in inventory.file_inventory(spark, str(tmp_path), ["sub/a.txt", "b.txt"]).collect()}
    assert set(rows) == {"sub/a.txt", "b.txt"} and rows["b.txt"].status == "missing"
    assert rows["sub/a.txt"].sha256 == hashlib.sha256(b"hello").hexdigest() and rows["sub/a.txt"].bytes == 5
    assert os.path.exists(tmp_path / ".hidden")


def test_large_files_are_streamed(spark, tmp_path):
    """Sizes around a read and a file that Spark's binary reader could not hold."""
    sizes = [0, 1, (1 << 20) - 1, 1 << 20, (1 << 20) + 1, 3_000_000]
    for n in sizes:
        (tmp_path / f"f {n}%.bin").write_bytes(bytes(i % 251 for i in range(n)))
    with open(tmp_path / "holes.bin", "wb") as f:
        f.truncate(2_200_000_000)
    rows = {r.path: r for r in inventory.file_inventory(spark, f"file:{tmp_path}", whole_bytes=100).collect()}
    assert len(rows) == len(sizes) + 1 and rows["holes.bin"].bytes == 2_200_000_000
    zeros, block = hashlib.sha256(), bytes(1_000_000)
    for _ in range(2200):
        zeros.update(block)
    assert rows["holes.bin"].sha256 == zeros.hexdigest()
    for n in sizes:
        assert rows[f"f {n}%.bin"].sha256 == hashlib.sha256(bytes(i % 251 for i in range(n))).hexdigest()


def test_inventory_of_tables_equals_local_hashes(spark):
    rows = inventory.file_inventory(spark, "/root/testdata/sf0.001").collect()
    assert [r.path for r in rows] == sorted(r.path for r in rows) and len(rows) > 10
    for r in rows:
        with open(f"/root/testdata/sf0.001/{r.path}", "rb") as f:
            content = f.read()
        assert (r.bytes, r.sha256) == (len(content), hashlib.sha256(content).hexdigest())
