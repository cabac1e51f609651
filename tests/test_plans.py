from pyspark.sql import functions as F

from sparkattest.operators.history import dashboard, filter_history
from sparkattest.plans.derived import derived
from sparkattest.plans.verify import analyze

SF = "/root/testdata/sf0.001"


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path):
    derived(spark, SF, "verifications_v").write.parquet(str(tmp_path / "v"))
    return spark.read.parquet(str(tmp_path / "v"))


def test_history_filters_reach_the_scan(spark, tmp_path):
    rows = filter_history(stored(spark, tmp_path), user_id="BUILDING", prediction="genuine", risk_max=0.2, date_to="2000-01-31")
    text = plan(rows.select("verification_id"))
    for part in ("EqualTo(user_id,BUILDING)", "EqualTo(prediction,genuine)", "LessThanOrEqual(risk_score,0.2)", "LessThan(created_at"):
        assert part in text, part
    assert "evidence_json" not in text


def test_dashboard_reads_only_its_columns_and_combines_map_side(spark, tmp_path):
    text = plan(dashboard(stored(spark, tmp_path)))
    assert "partial_count" in text and "filename" not in text and "evidence_json" not in text


def test_rules_add_no_shuffle_and_no_python(spark):
    import datetime as dt

    docs = spark.createDataFrame([(1, "text")], "document_id long, text string")
    text = plan(analyze(docs, as_of=dt.date(2024, 1, 1)).select("document_id", F.size("findings")))
    assert "Exchange" not in text and "Python" not in text


def test_rotation_of_one_template_uses_many_ranges(spark):
    """All rows in one template and one hour, or all without a time: ranges still share them, and ranks are exact."""
    import datetime as dt

    from sparkattest.operators import skew
    from sparkattest.operators.splits import template_splits

    schema = "document_id long, reviewer_label string, issuer string, certificate_type string, reviewed_at timestamp"
    hour = dt.datetime(2024, 1, 1, 10)
    for stamp in (lambda i: hour + dt.timedelta(seconds=i % 7), lambda i: None):
        rows = [(i, "confirmed_genuine", "Uni", "academic", stamp(i)) for i in range(3000)]
        df = spark.createDataFrame(rows, schema).repartition(5)
        seen = []
        original = skew.cut_lineage
        skew.cut_lineage = lambda t: seen.append(original(t)) or seen[-1]
        try:
            got = template_splits(df, "document_id").collect()
        finally:
            skew.cut_lineage = original
        order = sorted(range(3000), key=lambda i: (stamp(i) or hour, i))
        assert {r["document_id"]: r["template_index"] for r in got} == {i: k for k, i in enumerate(order)}
        shares = [r["count"] for r in seen[0].groupBy("_range").count().collect()]
        assert len(shares) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(shares) < 1500


def test_range_rank_of_many_groups_with_nulls(spark):
    from sparkattest.operators.skew import range_rank

    rows = [(i, None if i % 5 == 0 else f"g{i % 3}", None if i % 4 == 0 else i * 37 % 11) for i in range(200)]
    got = range_rank(spark.createDataFrame(rows, "id long, g string, v int"), ["g"], [F.col("v")], "id", pieces=7).collect()
    want = {}
    for group in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == group), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        want |= {r[0]: k for k, r in enumerate(own, 1)}
    assert {r["id"]: r["_rank"] for r in got} == want


def test_running_totals_with_far_values_use_many_bins(spark):
    from sparkattest.operators import skew

    values = [float(i) for i in range(500)] + [1e300, float("inf")]
    df = spark.createDataFrame([(v, 1 + i % 3) for i, v in enumerate(values)], "v double, n long")
    for descending in (False, True):
        got = {r["v"]: (r["upto_n"], r["all_n"]) for r in skew.running_totals(df, "v", ["n"], [], descending=descending).collect()}
        total, want = 0, {}
        for i, v in sorted(enumerate(values), key=lambda p: p[1], reverse=descending):
            total += 1 + i % 3
            want[v] = total
        assert got == {v: (t, total) for v, t in want.items()}


def _scans_of(spark, monkeypatch, path, build):
    """How often a report reads the table at `path`: in the tables it writes and in its own plan."""
    from sparkattest.operators import counters, drift, duplicates, skew

    plans = []

    def noted(original):
        return lambda df: plans.append(df) or original(df)

    for module in (counters, drift, duplicates, skew):
        monkeypatch.setattr(module, "cut_lineage", noted(module.cut_lineage))
    plans.append(build(spark.read.parquet(path)))
    monkeypatch.undo()
    return sum(line.count("Location") for p in plans for line in plan(p).splitlines() if path in line and "FileScan" in line)


def test_reports_read_their_table_once(spark, tmp_path, monkeypatch):
    from sparkattest.operators import drift
    from sparkattest.operators.quality import quality_report

    path = str(tmp_path / "v")
    rows = stored(spark, tmp_path)
    later = F.col("created_at") >= F.lit("1998-01-01").cast("timestamp_ntz")
    assert _scans_of(spark, monkeypatch, path, lambda t: drift.drift_between(t, later)) == 1
    assert _scans_of(spark, monkeypatch, path, drift.snapshot) == 1
    reviewed = str(tmp_path / "r")
    derived(spark, SF, "reviewed_v").write.parquet(reviewed)
    assert _scans_of(spark, monkeypatch, reviewed, quality_report) == 1
    apart = drift.drift_report(drift.snapshot(rows.filter(~later)), drift.snapshot(rows.filter(later)))
    assert sorted(map(str, drift.drift_between(rows, later).collect())) == sorted(map(str, apart.collect()))
    assert {r["value"] for r in drift.snapshot(rows.limit(0)).collect()} == {0.0}


def test_copies_read_their_table_twice(spark, tmp_path, monkeypatch):
    from sparkattest.operators.duplicates import mark_exact_copies, prior_duplicates

    stored(spark, tmp_path)
    path = str(tmp_path / "v")
    names = {"seq": "document_id", "owner": "user_id", "doc_id": "verification_id"}
    assert _scans_of(spark, monkeypatch, path, lambda t: prior_duplicates(t, **names)) == 2
    hashed = lambda t: t.withColumn("sha256", F.sha2("file_fingerprint", 256))
    assert _scans_of(spark, monkeypatch, path, lambda t: mark_exact_copies(hashed(t), seq="document_id")) == 2
    text = plan(mark_exact_copies(hashed(spark.read.parquet(path)), seq="document_id"))
    assert "WindowGroupLimit" in text  # two rows per hash and task before the shuffle
