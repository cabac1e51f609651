import random

import pytest
from pyspark.sql import functions as F

from sparkattest import constants as C
from sparkattest.operators.duplicates import dedupe_reviewed, mark_exact_copies, prior_duplicates
from sparkattest.operators.families import connected_families
from sparkattest.operators.leakage import (
    LeakageError, check_external_leakage, check_split_leakage, external_overlap, raise_if,
)
from sparkattest.operators.quality import schema_checks
from sparkattest.operators.skew import bucketed_rank, lookup_join
from sparkattest.operators.splits import assign_splits, greedy_takes, stratified_split, template_splits
from sparkattest.plans.candidates import build_candidate, publish

LINKS = "document_id long, file_fingerprint string, cert_id_fingerprint string, identity_fingerprint string, certificate_id string"


def random_links(n, seed):
    rng = random.Random(seed)

    def value(kind, size):
        return f"{kind}{rng.randrange(size)}" if rng.random() < 0.6 else rng.choice(["", None, " "])

    rows = [(i, value("f", n), value("c", n), value("i", n), value("z", n)) for i in range(n)]
    hot = [(n + i, "hot", None, None, None) for i in range(n // 3)]
    return rows + hot


def brute_families(rows):
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for r in rows:
        for k, v in enumerate(r[1:]):
            if v and v.strip():
                other = seen.setdefault((k, v.strip()), r[0])
                a, b = find(other), find(r[0])
                parent[max(a, b)] = min(a, b)
    return {r[0]: find(r[0]) for r in rows}


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_families_match_union_find(spark, hot_rows):
    rows = random_links(60, 5)
    df = spark.createDataFrame(rows, LINKS)
    got = {r["document_id"]: r["family_id"] for r in connected_families(df, "document_id", hot_rows=hot_rows).collect()}
    assert got == brute_families(rows)


def test_long_chain_and_no_links(spark):
    chain = [(i, f"f{i // 2}", f"c{(i + 1) // 2}", None, None) for i in range(120)]
    df = spark.createDataFrame(chain + [(500, None, None, None, None)], LINKS)
    got = {r["document_id"]: r["family_id"] for r in connected_families(df, "document_id").collect()}
    assert {v for k, v in got.items() if k < 500} == {0} and got[500] == 500


def test_greedy_takes_equal_a_family_walk():
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.randint(1, 9) for _ in range(rng.randint(1, 40))]
        target = rng.randint(0, sum(sizes))
        used, walked = 0, {}
        for s in sorted(sizes, reverse=True):
            if used + s <= target:
                used += s
                walked[s] = walked.get(s, 0) + 1
        takes = greedy_takes([(s, sizes.count(s)) for s in set(sizes)], target)
        assert {k: v for k, v in takes.items() if v} == walked


def test_split_keeps_families_whole_for_any_partitioning(spark):
    rows = random_links(60, 9)
    df = spark.createDataFrame(rows, LINKS)
    out = assign_splits(df.repartition(7), "document_id", test_fraction=0.3).collect()
    again = assign_splits(df.coalesce(1), "document_id", test_fraction=0.3).collect()
    assert sorted((r["document_id"], r["split"]) for r in out) == sorted((r["document_id"], r["split"]) for r in again)
    sides = {}
    for r in out:
        sides.setdefault(r["family_id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in sides.values())
    assert 0 < sum(r["split"] == "test" for r in out) <= round(len(rows) * 0.3)


def test_stratified_shares_are_exact(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 10 < 3).cast("int"))
    counts = {(r["label"], r["split"]): r["count"] for r in stratified_split(df, "id").groupBy("label", "split").count().collect()}
    assert counts[(1, "test")] == 60 and counts[(1, "validation")] == 45 and counts[(0, "test")] == 140 and counts[(0, "train")] == 455


def test_bucketed_rank_equals_one_global_order(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 5 else None, (i * 37) % 101) for i in range(200)], "id long, g int, v long")
    ranked = bucketed_rank(df, ["g"], F.floor(F.col("v") / 10), [F.col("v"), F.col("id")]).collect()
    for g in (0, 1, 2, None):
        mine = sorted((r for r in ranked if r["g"] == g), key=lambda r: (r["v"], r["id"]))
        assert [r["_rank"] for r in mine] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_lookup_join_hot_and_cold(spark, hot_rows):
    left = spark.createDataFrame([(i, "a" if i < 10 else f"k{i}") for i in range(20)], "id long, k string")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("m")).filter("k <> 'k15'")
    got = {r["id"]: (r["n"], r["m"]) for r in lookup_join(left, right, ["k"], "n", hot_rows=hot_rows).collect()}
    assert len(got) == 20 and got[3] == (10, 0) and got[12] == (1, 12) and got[15] == (None, None)


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_prior_duplicates_match_brute_force(spark, hot_rows):
    rng = random.Random(3)
    rows = [
        (i, rng.choice("ab"), f"d{i}", rng.choice(["genuine", "genuine", "error"]), rng.choice([None, "", "f1", f"f{i}"]),
         rng.choice([None, "c1", "c2"]), rng.choice([None, f"i{rng.randrange(6)}"]))
        for i in range(60)
    ]
    df = spark.createDataFrame(rows, "seq long, owner string, doc string, prediction string, file_fingerprint string, cert_id_fingerprint string, identity_fingerprint string")
    got = {r["seq"]: (r["duplicate_of"], r["duplicate_type"]) for r in prior_duplicates(df, seq="seq", owner="owner", doc_id="doc", hot_rows=hot_rows).collect()}
    for r in rows:
        want = (None, None)
        if r[3] != "error":
            for kind, at in (("file", 4), ("cert_id", 5), ("identity", 6)):
                earlier = [p for p in rows if p[0] < r[0] and p[1] == r[1] and p[3] != "error" and r[at] and p[at] == r[at]]
                if earlier:
                    want = (earlier[0][2], kind)
                    break
        assert got[r[0]] == want, r


def test_every_copy_is_marked(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "x")], "seq long, sha256 string")
    got = {r["seq"]: (r["duplicate_status"], r["duplicate_of"]) for r in mark_exact_copies(df, seq="seq", hot_rows=2).collect()}
    assert got == {1: ("duplicate", 3), 2: ("unique", None), 3: ("duplicate", 1), 4: ("duplicate", 1)}


def test_blank_fingerprints_are_not_duplicates(spark):
    rows = [(i, f"v{i}", "", None, " ") for i in range(3)] + [(9, "v1", "a", "b", "c"), (10, "v10", "a", "b", "c"), (11, "v11", "a", "b", "c")]
    df = spark.createDataFrame(rows, "seq long, verification_id string, file_fingerprint string, cert_id_fingerprint string, identity_fingerprint string")
    assert sorted(r["seq"] for r in dedupe_reviewed(df, seq="seq").collect()) == [0, 1, 2, 10]


def leak_frame(spark, rows):
    return spark.createDataFrame(rows, "certificate_id string, file_fingerprint string, split string")


def test_leakage_gates(spark):
    assert check_split_leakage(leak_frame(spark, [("a", "1", "train"), ("b", "2", "test"), ("", " ", "train"), ("", " ", "test")])).count() == 2
    with pytest.raises(LeakageError):
        check_split_leakage(leak_frame(spark, [("a", "1", "train"), ("a", "2", "test")]))
    with pytest.raises(LeakageError):
        check_split_leakage(leak_frame(spark, [("a", "1", "holdout")]))
    with pytest.raises(LeakageError):
        check_split_leakage(spark.createDataFrame([("a",)], "certificate_id string"))
    frozen = spark.createDataFrame([("1",), (None,)], "sha256 string")
    rows = leak_frame(spark, [("a", "1", "train"), ("b", "2", "test"), ("c", None, "test")])
    for limit in (100, 0):
        flags = sorted((r["certificate_id"], r["in_external_set"]) for r in external_overlap(rows, frozen, max_broadcast=limit).collect())
        assert flags == [("a", True), ("b", False), ("c", False)]
    with pytest.raises(LeakageError):
        check_external_leakage(rows, frozen)
    with pytest.raises(Exception, match="bad row"):
        raise_if(rows, F.col("split") == "test", "bad row").collect()
    assert raise_if(rows, F.col("split") == "other", "bad row").count() == 3


def test_templates(spark):
    rows = [(i, "confirmed_genuine" if i % 4 else "uncertain", "Uni A", "academic") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, reviewer_label string, issuer string, certificate_type string").withColumn(
        "reviewed_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    )
    rotated = template_splits(df, "id").collect()
    assert sorted(r["template_index"] for r in rotated) == list(range(30)) and {r["split"] for r in rotated} == {"train", "test"}
    assert len({r["split"] for r in template_splits(df, "id", whole_group=True).collect()}) == 1


def test_schema_checks_find_every_problem(spark):
    base = {c: F.lit(1.0) for c in C.FEATURE_COLUMNS}
    good = spark.range(4).select((F.col("id") % 2).cast("int").alias("label"), F.lit("academic").alias("certificate_type"), *[v.alias(k) for k, v in base.items()])
    assert all(r["violations"] == 0 for r in schema_checks(good).collect())
    bad = good.drop("qr_present").withColumns({"seal_present": F.lit("x"), "visual_noise": F.lit(None).cast("double"), "label": F.lit(3), "certificate_type": F.lit("odd")})
    got = {r["check_name"]: r["violations"] for r in schema_checks(bad).collect()}
    assert got["missing_features"] == 1 and got["dtype_mismatch"] == 1 and got["null_features"] == 4
    assert got["invalid_labels"] == 4 and got["empty_class"] == 1 and got["unknown_certificate_types"] == 4


def test_candidate_dataset_end_to_end(spark, tmp_path):
    rows = random_links(40, 2)
    df = spark.createDataFrame(rows, LINKS).withColumns(
        {
            "verification_id": F.concat(F.lit("V"), F.col("document_id").cast("string")), "label": (F.col("document_id") % 2).cast("int"),
            "certificate_type": F.lit("academic"), "issuer": F.lit("Uni"), "extraction_completeness": F.lit(0.8), "is_disagreement": F.lit(0),
            "features_available": F.lit(True),
        }
    )
    candidate = build_candidate(df, seq="document_id", batch="b1", test_fraction=0.25)
    assert {r["split"] for r in candidate.rows.select("split").distinct().collect()} == {"train", "test"}
    report = {(r["section"], r["item"], r["metric"]): r["value"] for r in candidate.report.collect()}
    assert report[("overall", "all", "n_rows")] == candidate.rows.count()
    assert report[("cross_split", "file_fingerprint", "shared_values")] == 0
    feedback = publish(candidate, df.select("verification_id"), str(tmp_path / "out"))
    assert feedback.filter("split IS NOT NULL").count() == candidate.rows.count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == candidate.rows.count()
