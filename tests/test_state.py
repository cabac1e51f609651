"""Streams with keyed state: restarts, replays, late rows and empty windows."""

import datetime as dt
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkattest.operators import drift
from sparkattest.operators.duplicates import prior_duplicates
from sparkattest.streaming import jobs as J

DOC = "document_id long, owner string, prediction string, file_fingerprint string, cert_id_fingerprint string, identity_fingerprint string"


def arrivals(ids):
    """Copies of several kinds, owners, error rows and rows without any fingerprint or owner."""
    return [
        (
            i, ["me", "you", None][i % 3 if i % 11 else 2], "error" if i % 5 == 4 else "genuine", f"f{i % 4}" if i % 2 else " ",
            f"c{i % 7}" if i % 3 else None, "x" if i % 13 == 0 else None,
        )
        for i in ids
    ]


def add(spark, path, rows, schema=DOC):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def check(spark, base):
    stream = J.read_documents(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema, max_files=1)
    query = J.start_duplicate_check(stream, f"{base}/report", f"{base}/state", seq="document_id", owner="owner", doc_id="document_id")
    query.awaitTermination()
    return query


def expected(rows):
    """Earliest valid document of the same owner by fingerprint, strongest kind first."""
    first = {}
    for i, owner, prediction, *prints in sorted(rows):
        for kind, value in zip(("file", "cert_id", "identity"), prints, strict=True):
            if prediction != "error" and owner and value and value.strip():
                first.setdefault((owner, kind, value), i)
    out = {}
    for i, owner, _, *prints in rows:
        hits = [(first[owner, k, v], k) for k, v in zip(("file", "cert_id", "identity"), prints, strict=True) if first.get((owner, k, v), i) < i]
        out[i] = hits[0] if hits else (None, None)
    return out


def reported(spark, base):
    rows = spark.read.parquet(f"{base}/report").collect()
    assert len(rows) == len({r["document_id"] for r in rows})
    assert all(r["is_duplicate"] == (r["duplicate_of"] is not None) for r in rows)
    return {r["document_id"]: (r["duplicate_of"], r["duplicate_type"]) for r in rows}


def test_first_occurrences_over_two_restarts(spark, tmp_path, monkeypatch):
    base, rows = str(tmp_path), arrivals(range(120))
    add(spark, f"{base}/in", rows[:40])
    query = check(spark, base)
    assert reported(spark, base) == expected(rows[:40])
    plan = query._jsq.lastProgress().json()
    assert "report" not in plan  # no source but the arriving documents
    add(spark, f"{base}/in", rows[40:70])

    written = J.write_batch

    def fails_after_writing(batch, path):
        written(batch, path)
        raise RuntimeError("executor lost")

    monkeypatch.setattr(J, "write_batch", fails_after_writing)
    with pytest.raises(Exception, match="executor lost"):
        check(spark, base)
    monkeypatch.undo()
    check(spark, base)  # replays the batch that failed
    assert reported(spark, base) == expected(rows[:70])
    add(spark, f"{base}/in", rows[70:])
    check(spark, base)
    assert reported(spark, base) == expected(rows)
    stored = spark.read.parquet(f"{base}/in")
    batch = prior_duplicates(stored, seq="document_id", owner="owner", doc_id="document_id", history=stored)
    assert {r["document_id"]: (r["duplicate_of"], r["duplicate_type"]) for r in batch.collect()} == expected(rows)


def test_a_late_earlier_document_changes_only_what_follows(spark, tmp_path):
    base = str(tmp_path)
    row = lambda i: (i, "me", "genuine", "same", None, None)
    for part in ([row(10), row(11)], [row(5)], [row(12)]):
        add(spark, f"{base}/in", part)
        check(spark, base)
    assert {i: d for i, (d, _) in reported(spark, base).items()} == {10: None, 11: 10, 5: None, 12: 5}


SCORED = "created_at timestamp, prediction string, review_status string, model_version string, issuer string, certificate_type string, risk_score double"
START = dt.datetime(2024, 1, 1)


def scored(day, n, share, risk):
    """n rows of a day of which `share` are suspicious."""
    return [
        (START + dt.timedelta(days=day, minutes=k), "suspicious" if k < share * n else "genuine", None, "v1", "Uni", '{"academic":1}', risk + k % 3 / 100)
        for k in range(n)
    ]


def plain_jsd(p, q):
    total_p, total_q = sum(p.values()), sum(q.values())
    out = 0.0
    for v in {*p, *q}:
        a, b = p[v] / total_p, q[v] / total_q
        m = (a + b) / 2
        out += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return round(math.sqrt(max(out / 2, 0)), 6)


def test_windows_are_judged_alone(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    from sparkattest.streaming.jobs import start_drift_watch

    calm = scored(-5, 60, 0.1, 0.2)
    frame = lambda rows: spark.createDataFrame(rows, SCORED)
    counts = J.drift_counts(frame(calm)).filter("dimension <> 'risk_score'")
    baseline = counts.select(F.col("dimension").alias("kind"), F.col("value").alias("item"), F.col("n").cast("double").alias("value")).union(
        spark.createDataFrame([("scalar", "risk_mean", 0.21), ("scalar", "risk_p95", 0.22)], "kind string, item string, value double")
    ).cache()

    days = {d: scored(d, 50, 0.1, 0.2) for d in (0, 1, 2)} | {4: scored(4, 30, 0.9, 0.6), 6: scored(6, 40, 0.1, 0.2)}  # nothing on days 3 and 5
    late = scored(0, 20, 1.0, 0.9)

    def run(rows):
        add(spark, f"{base}/in", rows, SCORED)
        stream = J.read_documents(spark, f"{base}/in", frame([]).schema, max_files=1)
        start_drift_watch(stream, baseline, f"{base}/drift", f"{base}/state").awaitTermination()

    run(days[0] + days[1])
    run(days[2])
    run(late)  # behind the watermark: dropped
    written = J.write_batch
    monkeypatch.setattr(J, "write_batch", lambda rows, path: (written(rows, path), 1 / 0))
    with pytest.raises(Exception, match="division by zero"):
        run(days[4])
    monkeypatch.undo()
    run(days[6])  # replays the failed batch first
    got = defaultdict(dict)
    for r in spark.read.parquet(f"{base}/drift").collect():
        assert r["measure"] not in got[(r["window_start"] - START).days]
        got[(r["window_start"] - START).days][r["measure"]] = r
    assert set(got) == {0, 1, 2, 4}  # day 6 is still open, days 3 and 5 had no rows
    kind = {"prediction": 1, "issuer": 4}
    for day, measures in got.items():
        rows = days[day]
        for name, column in kind.items():
            want = plain_jsd(Counter(r[column] for r in calm), Counter(r[column] for r in rows))
            assert measures[name]["value"] == pytest.approx(want, abs=2e-6), (day, name)
        risks = sorted(round(r[6], 4) for r in rows)
        assert measures["risk_mean_delta"]["value"] == pytest.approx(abs(round(sum(risks) / len(risks), 4) - 0.21), abs=1e-4)
        assert measures["risk_p95_delta"]["value"] == pytest.approx(abs(risks[int(0.95 * (len(risks) - 1))] - 0.22), abs=1e-4)
    alarmed = {day for day, m in got.items() if m["prediction"]["drifted"]}
    assert alarmed == {4} and got[4]["risk_mean_delta"]["drifted"] and not got[2]["risk_mean_delta"]["drifted"]


def test_distance_by_group_equals_the_pairwise_one(spark):
    base = spark.createDataFrame([("d", "a", 5.0), ("d", "b", 3.0), ("d", "c", 0.0), ("e", "x", 1.0)], "dimension string, value string, n double")
    rows = [(1, "d", "a", 2.0), (1, "d", "z", 2.0), (2, "d", "b", 7.0), (2, "e", "x", 3.0), (3, "f", "new", 1.0), (3, "d", "a", 0.0)]
    current = spark.createDataFrame(rows, "g int, dimension string, value string, n double")
    got = {(r["g"], r["dimension"]): (r["jsd"], r["baseline_empty"]) for r in drift.js_distance_by(base, current, ["g"]).collect()}
    for g in (1, 2, 3):
        pairwise = {r["dimension"]: (r["jsd"], r["baseline_empty"]) for r in drift.js_distance(base, current.filter(F.col("g") == g).drop("g")).collect()}
        for d in {r[1] for r in rows if r[0] == g}:
            assert got[g, d][0] == pytest.approx(pairwise[d][0], abs=2e-6)
            assert got[g, d][1] == (d == "f")
