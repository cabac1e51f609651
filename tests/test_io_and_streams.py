import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from sparkattest.operators.history import distributions
from sparkattest.operators.leakage import external_hashes
from sparkattest.operators.models import ScorerRegistry, calibrate, fit, out_of_fold, score
from sparkattest.plans.training import train
from sparkattest.plans.verify import analyze
from sparkattest.sources import readers as R
from sparkattest.sources import writers as W
from sparkattest.streaming import jobs as J

AS_OF = dt.date(2025, 1, 1)
SF = "/root/testdata/sf0.001"


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_labeled_tree_and_admission(spark, tmp_path):
    base = str(tmp_path)
    put(f"{base}/genuine/a.pdf", b"%PDF-1.4 x")
    put(f"{base}/suspicious/deep/b.png", b"not a png")
    put(f"{base}/uncertain/c.txt", b"text")
    put(f"{base}/other/d.pdf", b"%PDF")
    put(f"{base}/other/genuine/e.pdf", b"%PDF")
    files = R.read_labeled_files(spark, base)
    assert sorted((r["label"], r["original_filename"]) for r in files.collect()) == [("genuine", "a.pdf"), ("suspicious", "b.png")]
    good, bad = R.admit(files)
    assert [r["original_filename"] for r in good.collect()] == ["a.pdf"]
    assert [r["reject_reason"] for r in bad.collect()] == ["magic"]
    assert external_hashes(files).count() == 2
    nested = f"{base}/genuine/set"
    put(f"{nested}/suspicious/f.pdf", b"%PDF")
    assert [(r["label"], r["original_filename"]) for r in R.read_labeled_files(spark, nested + "/").collect()] == [("suspicious", "f.pdf")]


def test_manifests_and_registry(spark, tmp_path):
    put(str(tmp_path / "m.json"), json.dumps({"records": [{"sha256": "x", "label": "genuine"}, {"sha256": "y"}]}, indent=1).encode())
    assert R.read_manifest_document(spark, str(tmp_path / "m.json")).count() == 2
    put(str(tmp_path / "e.json"), json.dumps({"a.pdf": {"category": "academic", "expected": "genuine"}}).encode())
    assert R.read_expectations(spark, str(tmp_path / "e.json")).first()["path"] == "a.pdf"
    put(str(tmp_path / "r.json"), json.dumps({"issuers": [{"name": "A", "aliases": ["B"], "enabled": True}]}).encode())
    assert R.read_registry(spark, str(tmp_path / "r.json")).first()["aliases"] == ["B"]


def test_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a" * 64, "genuine", "a.pdf"), ("b" * 64, "suspicious", "b.pdf")], "sha256 string, label string, original_filename string")
    W.write_manifest(W.manifest_records(rows), str(tmp_path / "m"))
    back = R.read_manifest(spark, str(tmp_path / "m")).collect()
    assert sorted((r["sha256"], r["label"], len(r["file_id"])) for r in back) == [("a" * 64, "genuine", 40), ("b" * 64, "suspicious", 40)]


def test_round_trips(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.createDataFrame([("x, \"y\"\nz", 1), (None, 0)], "text_snippet string, label int")
    W.export_csv(rows, f"{base}/csv")
    back = R.read_csv(spark, f"{base}/csv", rows.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    W.export_json(rows, f"{base}/json")
    assert spark.read.json(f"{base}/json").count() == 2
    assert W.write_training_table(rows.limit(0), f"{base}/none", dataset="d") is None and not os.path.exists(f"{base}/none")
    meta = W.write_training_table(rows, f"{base}/t", dataset="d").first()
    assert meta["row_count"] == 2 and spark.read.parquet(f"{base}/t/rows").count() == 2
    again = rows.repartition(3).agg(W.table_checksum(rows)).first()[0]
    assert again == meta["checksum"]
    snap = spark.createDataFrame([("prediction", "genuine", 3.0)], "kind string, item string, value double")
    W.save_snapshot(snap, f"{base}/s", "base")
    W.save_snapshot(snap, f"{base}/s", "later")
    assert W.load_snapshot(spark, f"{base}/s", "base").count() == 1
    for i in range(2):
        W.log_run(spark, f"{base}/runs", run_id=str(i), experiment="e", version="v1", timestamp=f"2024-01-0{i + 1}", model="forest", metrics={"f1": 0.5}, params={})
    assert R.read_runs(spark, f"{base}/runs", "e").count() == 2 and R.read_runs(spark, f"{base}/runs", "z").count() == 0


@pytest.fixture(scope="module")
def features(spark):
    from sparkattest.plans.queries.documents import training_features_df

    return training_features_df(spark, SF).cache()


def test_models(spark, features, tmp_path):
    model = fit(features, "forest", trees=5)
    scored = score(model, features)
    assert scored.filter("risk_score < 0 OR risk_score > 1 OR confidence < 0.5").count() == 0
    folds = out_of_fold(features, "document_id", "forest", trees=5).cache()
    assert folds.count() == features.count()
    for method in ("sigmoid", "isotonic"):
        assert calibrate(folds, method)(folds).filter("calibrated < 0 OR calibrated > 1").count() == 0
    registry = ScorerRegistry()
    registry.register("forest", lambda df: score(model, df))
    assert registry.names() == ["forest"] and registry.evidence("forest", features).count() == features.count()
    W.save_model(model, str(tmp_path), "v1", promoted=True)
    assert spark.read.json(str(tmp_path / "v1_metadata")).first()["promoted"] is True


def test_training_plan(spark):
    from sparkattest.plans.derived import derived

    out = train(derived(spark, SF, "raw_v"), "document_id", as_of=AS_OF, trees=5)
    assert out.name in ("forest", "logistic_regression") and out.test.first()["n"] > 0
    assert out.by_type.filter("group_value = 'overall'").count() == 1


DOC = "document_id long, owner string, text string, prediction string, risk_score double, confidence double, file_fingerprint string, cert_id_fingerprint string, identity_fingerprint string, created_at timestamp"


def documents(spark, ids):
    rows = [(i, "me", f"This is to certify that Ann Bee{i}", "error" if i == 4 else "genuine", 0.25, 0.75, f"f{i % 3}", None, None, dt.datetime(2024, 1, 1 + i % 3)) for i in ids]
    return spark.createDataFrame(rows, DOC)


def test_streams_equal_batch(spark, tmp_path):
    base = str(tmp_path)
    for part in (range(0, 4), range(4, 9)):
        documents(spark, part).coalesce(1).write.mode("append").parquet(f"{base}/in")
    batch = spark.read.parquet(f"{base}/in")
    stream = J.read_documents(spark, f"{base}/in", batch.schema, max_files=1)

    J.start_append(J.score_arrivals(stream, as_of=AS_OF).select("document_id", "candidate_name", "issuer_status"), f"{base}/scored", f"{base}/c1").awaitTermination()
    want = analyze(batch, as_of=AS_OF).select("document_id", "candidate_name", "issuer_status")
    assert sorted(map(str, spark.read.parquet(f"{base}/scored").collect())) == sorted(map(str, want.collect()))

    windows = J.windowed_metrics(stream, every="1 day")
    windows.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{base}/c2").start().awaitTermination()
    assert sorted(map(str, spark.table("win").collect())) == sorted(map(str, J.windowed_metrics(batch, every="1 day").collect()))

    J.start_duplicate_check(stream, f"{base}/hist", f"{base}/c3", seq="document_id", owner="owner", doc_id="document_id").awaitTermination()
    found = {r["document_id"]: r["duplicate_of"] for r in spark.read.parquet(f"{base}/hist").collect()}
    assert found[3] == 0 and found[5] == 2 and found[8] == 2 and found[0] is None and found[7] == 1

    events = stream.select(F.col("document_id").alias("verification_id"), F.lit("E").alias("event_type"), F.lit("failed").alias("status"), F.lit(" ").alias("title"), F.lit(None).cast("string").alias("description"), F.lit('{"code":"abcdefgh"}').alias("details"))
    J.start_event_log(events, f"{base}/events", f"{base}/c5").awaitTermination()
    row = spark.read.parquet(f"{base}/events").first()
    assert (row["severity"], row["title"], row["details"]) == ("error", "E", '{"code":"abcd****fgh"}')
    assert J.drop_recent_duplicates(stream, keys=["file_fingerprint"], ts="created_at", within="1 hour").isStreaming


def test_distributions_count_flags(spark):
    rows = [("genuine", None, "v", "U", '{"academic":1,"online":0}'), ("error", None, "v", "U", '{"academic":1}'), ("genuine", "x", "v", " ", "[")]
    got = {(r["dimension"], r["value"]): r["n"] for r in distributions(spark.createDataFrame(rows, "prediction string, review_status string, model_version string, issuer string, certificate_type string")).collect()}
    assert got[("certificate_type", "academic")] == 1 and got[("model_version", "v")] == 3 and ("issuer", "") not in got and got[("review_status", "low_risk")] == 1


def test_write_back_survives_a_failed_write(spark, tmp_path, monkeypatch):
    from sparkattest.plans import candidates as P
    from sparkattest.plans.derived import derived

    base, feedback = str(tmp_path), derived(spark, SF, "feedback_v")
    W.write_version(feedback, f"{base}/feedback", "v0")
    reviewed = derived(spark, SF, "reviewed_v").drop("split")
    candidate = P.build_candidate(reviewed, seq="document_id", batch="b1")
    before = sorted(map(str, W.read_version(spark, f"{base}/feedback").collect()))

    bad = F.when(F.col("document_id") > 100, F.raise_error(F.lit("disk full")).cast("string")).otherwise(F.col("split"))
    monkeypatch.setattr(P, "split_write_back", lambda f, rows: W.split_write_back(f, rows).withColumn("split", bad))
    with pytest.raises(Exception, match="disk full"):
        P.publish_back(candidate, f"{base}/feedback", f"{base}/batches", version="v1")
    monkeypatch.undo()
    assert W.current_version(spark, f"{base}/feedback") == "v0"
    assert sorted(map(str, W.read_version(spark, f"{base}/feedback").collect())) == before

    for _ in range(2):  # the rerun finishes, a further one changes nothing
        back = P.publish_back(candidate, f"{base}/feedback", f"{base}/batches", version="v1")
    assert W.current_version(spark, f"{base}/feedback") == "v1"
    want = {r["verification_id"]: r["split"] for r in candidate.rows.collect()}
    rows = back.collect()
    assert len(rows) == feedback.count()
    assert {r["verification_id"]: r["split"] for r in rows if r["dataset_batch"] == "b1"} == want
    assert all(r["split"] is None for r in rows if r["verification_id"] not in want)
    assert spark.read.parquet(f"{base}/batches").count() == len(want)
    with pytest.raises(ValueError):
        W.write_version(feedback, f"{base}/feedback", "v1")
    with pytest.raises(FileNotFoundError):
        W.read_version(spark, f"{base}/none")


CSV_SCHEMA = ST.StructType([ST.StructField("a", ST.StringType()), ST.StructField("b", ST.IntegerType()), ST.StructField("c", ST.StringType())])
ODD_FIELDS = ["plain", "", 'say "hi"', "two\nlines", "with, comma", "end\r\nof line", '"', "\n\n", "\u00e9\u4e16" * 40, "x\n" * 120]


def csv_text(rows, end="\n"):
    def field(v):
        return '"' + v.replace('"', '""') + '"' if any(ch in v for ch in ',"\r\n') else v

    return "a,b,c" + end + end.join(f"{field(a)},{b},{field(c)}" for a, b, c in rows) + end


@pytest.mark.parametrize("range_bytes", [48, 200, 1000, 1 << 20])
def test_csv_by_ranges_equals_whole_files(spark, tmp_path, range_bytes, monkeypatch):
    rows = [(ODD_FIELDS[i % 10], i, ODD_FIELDS[(i * 7 + 3) % 10]) for i in range(60)]
    put(str(tmp_path / "in" / "one.csv"), csv_text(rows).encode())
    put(str(tmp_path / "in" / "two.csv"), csv_text([("k", 1, "l"), ("long\n" * 300, 2, "m")]).encode())
    put(str(tmp_path / "in" / "header.csv"), b"a,b,c\n")
    put(str(tmp_path / "in" / "empty.csv"), b"")
    put(str(tmp_path / "in" / "returns.csv"), csv_text([("p", 5, "q\nr"), ("s", 6, "t")], "\r\n").encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole = sorted(map(tuple, R.read_csv(spark, str(tmp_path / "in"), CSV_SCHEMA).collect()), key=str)
    assert len(whole) == 64
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = sorted(map(tuple, R.read_csv(spark, str(tmp_path / "in"), CSV_SCHEMA, whole_files=False).collect()), key=str)
        assert got == whole
        if range_bytes == 200:  # the same without the broadcast list of ranges
            monkeypatch.setattr(R, "MAX_BROADCAST_RANGES", 0)
            assert sorted(map(tuple, R.read_csv_ranges(spark, str(tmp_path / "in"), CSV_SCHEMA).collect()), key=str) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_with_an_odd_quote_is_an_error(spark, tmp_path):
    put(str(tmp_path / "bad.csv"), b'a,b,c\nx,1,y\n"open,2,z\n')
    with pytest.raises(Exception, match="odd number of quotes"):
        R.read_csv(spark, str(tmp_path), CSV_SCHEMA, whole_files=False).collect()
