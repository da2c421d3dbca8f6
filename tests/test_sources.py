"""Readers, writers, stores and inventories on small files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cohortaudit.sources import tables as T
from cohortaudit.streaming import answers


def test_read_table(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,\n")
    (tmp_path / "b.tsv").write_text("k\tv\n1\tx\n")
    assert T.read_table(spark, f"{tmp_path}/a.csv").count() == 2
    assert T.read_table(spark, f"{tmp_path}/b.tsv").columns == ["k", "v"]
    with pytest.raises(ValueError):
        T.read_table(spark, f"{tmp_path}/a.xlsx")
    rows = T.read_strings(spark, f"{tmp_path}/a.csv", ["k", "v"]).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [("1", "x"), ("2", None)]


def test_labels(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"k": "a", "x": 1}\n\n{"k": "b", "x": -1.0}\n')
    (tmp_path / "bad.json").write_text('{"k": "a", "x": 1}\n{oops\n')
    (tmp_path / "none.json").write_text('{"x": 1}\n')
    got = {r.k: r.x for r in T.read_labels(spark, f"{tmp_path}/ok.json", "k", ["x"]).collect()}
    assert got == {"a": 1.0, "b": -1.0}
    for name in ("bad", "none"):
        with pytest.raises(Exception, match="(?s).*"):
            T.read_labels(spark, f"{tmp_path}/{name}.json", "k", ["x"]).collect()


def test_reports_and_inventory(spark, tmp_path):
    for name in ("p1/s1.txt", "p2/s1.txt", "p2/s2.txt", "p2/note.txt", "p2/x.dcm"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    got = {r.study_id: r.text for r in T.read_reports(spark, str(tmp_path)).collect()}
    assert got == {1: "p1/s1.txt", 2: "p2/s2.txt"}
    files = T.inventory(spark, str(tmp_path), [("report", r"^s\d+\.txt$"), ("image", r"\.dcm$")], ["image"])
    rows = {r.name: r for r in files.where("category <> 'report'").collect()}
    assert rows["x.dcm"].sha256 is None and rows["note.txt"].sha256 == hashlib.sha256(b"p2/note.txt").hexdigest()
    assert T.access_gate(files, ["report", "image"]).first().status == "PASS"
    assert T.access_gate(files, ["report", "mask"]).first().missing == "mask"
    assert T.access_gate(files, ["mask"]).first().status == "BLOCKED"


def test_digests_in_chunks(spark, tmp_path):
    (tmp_path / "b c%20d.bin").write_bytes(b"x" * 3_000)
    (tmp_path / "small.bin").write_bytes(b"y")
    (tmp_path / "x.dcm").write_bytes(b"z" * 3_000)
    patterns = [("image", r"\.dcm$")]
    digests = lambda **k: {r.name: (r.size, r.sha256) for r in T.inventory(spark, str(tmp_path), patterns, ["image"], **k).collect()}
    assert digests(whole=1_000) == digests() == digests(whole=0)
    assert digests()["x.dcm"] == (3_000, None) and digests(whole=0)["b c%20d.bin"] == (3_000, hashlib.sha256(b"x" * 3_000).hexdigest())
    size = (1 << 31) + 5  # more than a value of a row can hold
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)
    want = hashlib.sha256()
    for at in range(0, size, 1 << 20):
        want.update(bytes(min(1 << 20, size - at)))
    assert digests()["large.bin"] == (size, want.hexdigest())


def test_checksums(spark):
    lines = spark.createDataFrame([("0" * 64 + "  a",), ("1" * 64 + " *b c",), ("junk",)], "value string")
    files = spark.createDataFrame([("a", "0" * 64), ("b c", "2" * 64), ("d", "3" * 64)], "name string, sha256 string")
    got = {r.name: r.status for r in T.verify_checksums(T.parse_manifest(lines), files).collect()}
    assert got == {"a": "verified", "b c": "mismatch", "d": "unlisted"}


def test_prediction_store(spark, tmp_path):
    rows = spark.createDataFrame([("s", 0.5, "src", "m", "C0", "p", 3, 1)], "study string, p double, site string, model string, condition string, label_source string, threshold int, seed int")
    T.save_predictions(rows, f"{tmp_path}/store", "abc")
    T.save_predictions(rows.withColumn("threshold", F.lit(5)), f"{tmp_path}/store", "abc")
    assert T.load_predictions(spark, f"{tmp_path}/store", "abc", model="m", threshold=3).count() == 1
    assert T.load_predictions(spark, f"{tmp_path}/store", "other", model="m").count() == 0
    with pytest.raises(ValueError):
        T.load_predictions(spark, f"{tmp_path}/store", "abc", study="s")
    plan = T.load_predictions(spark, f"{tmp_path}/store", "abc", threshold=3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(threshold" in plan


def test_a_saved_pass_replaces_itself(spark, tmp_path):
    path, keys = f"{tmp_path}/store", "site string, model string, condition string, label_source string, threshold int, seed int"
    schema = f"study string, p double, {keys}"
    one = lambda p, model: spark.createDataFrame([("s", p, "src", model, "C0", "p", 3, 1), ("t", p, "src", model, "C0", "p", 3, 1)], schema)
    held = lambda digest="abc": sorted((r.model, r.p) for r in T.load_predictions(spark, path, digest).collect())
    assert T.load_predictions(spark, path, "abc", "study string, p double", model="m").collect() == []
    T.save_predictions(one(0.5, "m").union(one(0.6, "n")), path, "abc")
    T.save_predictions(one(0.5, "m"), path, "abc")
    assert held() == [("m", 0.5)] * 2 + [("n", 0.6)] * 2
    T.save_predictions(one(0.7, "m"), path, "new")
    assert held() == [("n", 0.6)] * 2 and held("new") == [("m", 0.7)] * 2
    broken = one(0.9, "m").withColumn("p", F.when(F.col("study") == "t", F.raise_error(F.lit("half-written")).cast("double")).otherwise(F.col("p")))
    with pytest.raises(Exception, match="half-written"):
        T.save_predictions(broken.repartition(2), path, "new")
    assert held("new") == [("m", 0.7)] * 2


def test_shareable_output(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "label string, n int")
    T.write_aggregate(df, f"{tmp_path}/out", ["label", "n"])
    with pytest.raises(ValueError):
        T.write_aggregate(df.withColumn("patient", F.lit(1)), f"{tmp_path}/out", ["label", "n"])


def test_answers_batch_and_stream(spark, tmp_path):
    rows = [(1, "a", 10, 5.0), (2, "a", 12, 6.0), (3, "a", 12, 7.0), (4, "b", 1, 8.0)]
    log = spark.createDataFrame(rows, "id int, item string, t int, v double").withColumn("at", F.timestamp_seconds("t")).drop("t")
    want = {"a": 7.0, "b": 8.0}
    assert {r.item: r.v for r in T.latest_answers(log, ["item"], "at", "id").collect()} == want
    log.repartition(3).write.parquet(f"{tmp_path}/log")
    stream = answers.latest_stream(answers.read_log(spark, f"{tmp_path}/log", "id int, item string, v double, at timestamp", 1), ["item"], "at", "id")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {r.item: r.v for r in spark.table("latest").collect()} == want


def test_answers_followed_without_state(spark, tmp_path):
    schema, last = "id int, item string, v double, at timestamp", (["item"], "at", "id")
    log = lambda *rows: spark.createDataFrame(rows, "id int, item string, t int, v double").select("id", "item", "v", F.timestamp_seconds("t").alias("at"))
    store, now = f"{tmp_path}/store", lambda: {r.item: r.v for r in answers.stored(spark, store, schema, *last).collect()}
    assert now() == {} and answers.position(spark, store) is None
    answers.compact(spark, store, schema, *last)
    first, second = log((1, "a", 10, 5.0), (2, "a", 12, 6.0)), log((3, "a", 12, 7.0), (4, "b", 1, 8.0), (5, None, 1, 9.0))
    answers.save_batch(first, 0, store, *last)
    for _ in range(2):
        answers.save_batch(second, 1, store, *last)
        assert now() == {"a": 7.0, "b": 8.0, None: 9.0} and answers.position(spark, store) == 1
    # a batch that is not whole does not count
    log((6, "a", 99, 1.0)).write.parquet(f"{store}/batch-{2:012d}")
    (tmp_path / "store" / f"batch-{2:012d}" / "_SUCCESS").unlink()
    assert now()["a"] == 7.0 and answers.position(spark, store) == 1
    answers.compact(spark, store, schema, *last)
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == [f"base-{1:012d}", f"batch-{2:012d}"]
    # what is in the base may come again, and so may a late row
    answers.save_batch(second, 1, store, *last)
    answers.save_batch(log((7, "b", 0, 2.0), (8, "c", 0, 3.0)), 2, store, *last)
    assert now() == {"a": 7.0, "b": 8.0, None: 9.0, "c": 3.0} and answers.position(spark, store) == 2


def test_follow_goes_on_after_a_stop(spark, tmp_path):
    schema, last = "id int, item string, v double, at timestamp", (["item"], "at", "id")
    rows = spark.range(60).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("i"), F.col("id") % 7).alias("item"), F.col("id").cast("double").alias("v"), F.timestamp_seconds(F.col("id") * 31 % 60).alias("at"))
    for part in range(2):
        rows.where(F.col("id") % 2 == part).repartition(3).write.mode("append").parquet(f"{tmp_path}/log")
        q = answers.follow(answers.read_log(spark, f"{tmp_path}/log", schema, 1), f"{tmp_path}/store", schema, *last, f"{tmp_path}/cp", every=2).start()
        q.processAllAvailable()
        q.stop()
    got = answers.stored(spark, f"{tmp_path}/store", schema, *last)
    want = T.latest_answers(rows, *last)
    assert sorted(map(tuple, got.select("item", "id", "v").collect())) == sorted(map(tuple, want.select("item", "id", "v").collect()))
    assert answers.position(spark, f"{tmp_path}/store") == 5


def test_next_position(spark):
    order = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("q", "a", 1)], "reader string, item string, position int")
    done = spark.createDataFrame([("r", "a"), ("q", "a")], "reader string, item string")
    assert {r.reader: r.next for r in T.next_position(order, done, "reader", "item", "position").collect()} == {"r": 2, "q": None}


def test_reports_are_listed_and_read_in_tasks(spark, tmp_path):
    for name in ("s1.txt", "b/s1.txt", "a b%20é#/c/s2.txt", "a b%20é#/s3.txt", "_gone/s4.txt", ".gone/s5.txt", "_k=1/s6.txt", "s99999999999999999999.txt", "b/s7.text", "b/.s8.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "b/s9.txt").write_bytes(b"\xff")
    got = T.read_reports(spark, str(tmp_path))
    plain = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(str(tmp_path), wholetext=True).select(F.input_file_name().alias("name"), F.col("value").cast("binary").alias("text"))
    named = {(r.name, bytes(r.text)) for r in plain.collect()}
    rows = got.withColumn("text", F.col("text").cast("binary")).collect()
    assert sorted(r.study_id for r in rows) == [1, 2, 3, 6, 9]
    assert {(r.name, bytes(r.text)) for r in rows} == {x for x in named if not x[0].endswith(("9999.txt", f"{tmp_path.name}/s1.txt"))}
    # what the plan reads are tables of names: the driver has no list of the reports
    assert not [f for f in got.inputFiles() if f.endswith(".txt")]
