"""Prefix join, window and suffix-array deduplication, benchmark leaks: equal to brute force."""

import hashlib
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import LOWER, no_docs, odd_docs, odd_rows, prose, words

from sparkattest.llm import prefix_join, spaced_seeds, suffix_dedup, window_dedup
from sparkattest.llm._words import ranges


def _sha(data):
    return hashlib.sha256(data).hexdigest()


def _windows_cut(rows):
    """{(doc_id, text): covered word numbers}; documents in order of id, null first, then of the hash of the text."""
    seen, covered = {}, {}
    for i, t in sorted({(r[0], r[1] or "") for r in rows}, key=lambda d: (d[0] is not None, d[0] or 0, _order_of(d[1]))):
        w, marks = words(t), set()
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, t, k)) != (i, t, k):
                marks.update(range(k, k + 20))
        covered[i, t] = marks
    return covered


_HASHES = {}


def _order_of(text):
    return _HASHES[text]


@pytest.fixture
def hashed(spark):
    def run(rows):
        texts = spark.createDataFrame([(t,) for t in {r[1] or "" for r in rows}] or [("",)], "t string")
        _HASHES.update({r["t"]: r["h"] for r in texts.selectExpr("t", "xxhash64(t) AS h").collect()})

    return run


def test_windows_against_brute_force(spark, hashed):
    hashed(odd_rows())
    covered = _windows_cut(odd_rows())
    rows = window_dedup.remove_repeats(odd_docs(spark)).collect()
    assert len(rows) == len(odd_rows())
    for (i, t, *_), r in zip(sorted(odd_rows(), key=lambda r: r[4]), sorted(rows, key=lambda r: r["n_chars"]), strict=True):
        w, cut = words(t), covered[i, t or ""]
        assert r["doc_id"] == i and r["n_words_"] == len(w)
        assert words(r["text"]) == [x for k, x in enumerate(w) if k not in cut]
        assert r["n_removed_"] == len(cut)
        if not cut:
            assert r["text"] == t
    assert window_dedup.remove_repeats(no_docs(spark)).count() == 0


def test_windows_of_repeated_and_null_ids(spark, hashed):
    p = prose(31, 25)
    rows = [(None, f"{p} mid {p}"), (None, prose(32, 60)), (7, f"{prose(33, 30)} {p}"), (7, prose(34, 80)), (7, prose(34, 80)), (8, prose(34, 80))]
    hashed(rows)
    covered = _windows_cut(rows)
    got = window_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    left = sorted((str(r["doc_id"]), r["text"].split(), r["n_removed"]) for r in got)
    want = [(str(i), [x for k, x in enumerate(words(t)) if k not in covered[i, t]], len(covered[i, t])) for i, t in rows]
    assert left == sorted(want)
    assert [n for i, _, n in left if i == "7"].count(0) == 2 and ("None", prose(32, 60).split(), 0) in left


def test_ids_that_are_no_integers(spark):
    p = prose(35, 60)
    rows = [("d1", p), ("d2", p + " " + prose(36, 40)), ("d3", prose(37, 50)), (None, "short")]
    table = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: r["n_removed"] for r in window_dedup.remove_repeats(table).collect()}
    assert sorted((got["d1"], got["d2"])) == [0, 60] and got["d3"] == got[None] == 0
    bytes_cut = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(table).collect()}
    assert bytes_cut["d1"] == bytes_cut["d2"] == len(p) and bytes_cut["d3"] == 0
    assert {r["doc_id"] for r in prefix_join.keep_one(table).collect()} == {"d1", "d2", "d3", None}
    with pytest.raises(TypeError):
        prefix_join.linked_documents(table)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(5)
    for letters in (1, 2, 4):
        text = rng.integers(97, 97 + letters, 700).astype(np.uint8)
        raw = text.tobytes()
        sa, rank, eight = suffix_dedup.suffix_array(text)
        assert list(sa) == sorted(range(len(raw)), key=lambda i: raw[i:])
        lcp = suffix_dedup.common_prefixes(sa, rank, eight, 60)
        for r in range(1, len(raw)):
            a, b, n = raw[sa[r] :], raw[sa[r - 1] :], 0
            while n < min(len(a), len(b), 60) and a[n] == b[n]:
                n += 1
            assert lcp[r] == n


@pytest.mark.parametrize("shard_segments", [10_000, 3])
def test_suffix_removal_against_brute_force(spark, shard_segments):
    docs = {}
    for i, t, *_ in odd_rows():
        docs.setdefault(i, set()).add(t or "")
    shared = prose(9, 60)
    extra = [(100 + k, f"{k * 7919 % 1000:04d} " * 30 + shared + f" {k}") for k in range(30)] + [(200, "ab" * 300 + "c"), (201, "é" * 150)]
    docs |= {i: {t} for i, t in extra}
    count = Counter()
    for texts in docs.values():
        count.update({(k, raw[k : k + 200]) for t in texts for raw in [t.encode()] for k in range(len(raw) - 199)})
    times = Counter()
    for (_, s), n in count.items():
        times[s] += n
    table = odd_docs(spark).select("doc_id", "text", "kept").union(spark.createDataFrame([(i, t, "x") for i, t in extra], "doc_id long, text string, kept string"))
    table = table.filter("doc_id is not null")
    for r in suffix_dedup.remove_repeats(table, shard_segments=shard_segments).collect():
        raw = (r["text"] or "").encode()
        cover = np.zeros(len(raw), bool)
        for k in range(len(raw) - 199):
            if times[raw[k : k + 200]] > 1:
                cover[k : k + 200] = True
        kept = np.frombuffer(raw, np.uint8)[~cover].tobytes()
        assert (r["n_bytes"], r["n_removed"], _sha(r["kept_"])) == (len(raw), int(cover.sum()), _sha(kept)), r["doc_id"]
        assert len(r["removed_spans"]) == int((cover & ~np.r_[False, cover[:-1]]).sum()) if len(raw) else not r["removed_spans"]
        assert r["kept"] in ("clash", "x")
    assert suffix_dedup.remove_repeats(no_docs(spark)).count() == 0


def test_suffix_removal_of_repeated_ids(spark):
    passage = prose(71, 120)
    half = passage[: len(passage) // 2]
    rows = [(1, prose(72, 60) + passage)] + [(2, half + prose(73, 60))] * 3 + [(3, prose(74, 60) + passage + prose(75, 60))]
    rows += [(None, prose(76, 60) + half), (None, prose(77, 90)), (4, prose(78, 60)), (4, prose(79, 60) + passage[-300:])]
    times = Counter()
    for _, t in set(rows):
        times.update(t[k : k + 200] for k in range(len(t) - 199))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        t, cover = r["text"], np.zeros(len(r["text"]), bool)
        for k in range(len(t) - 199):
            if times[t[k : k + 200]] > 1:
                cover[k : k + 200] = True
        assert (r["doc_id"], bytes(r["kept"]).decode()) == (r["doc_id"], "".join(c for c, gone in zip(t, cover, strict=True) if not gone))


def _shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _components(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_copies_against_all_pairs(spark):
    rows = [(i, t) for i, t, *_ in odd_rows() if i is not None]
    base = prose(21, 80).split(" ")
    for k in range(40):  # a family of near copies that are not all linked directly
        w = list(base)
        for j in range(k % 6):
            w[(7 * k + 13 * j) % len(w)] = f"n{k}x{j}"
        rows.append((300 + k, " ".join(w)))
    sets = {i: _shingles(t) for i, t in rows}
    root = _components(sets)
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = prefix_join.linked_documents(table).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), root[i]) for i, s in sets.items()}
    assert len(got) == len(sets)
    kept = prefix_join.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in sets if root[i] == i)


def test_near_copies_odd_tables(spark):
    with_null = prefix_join.linked_documents(odd_docs(spark)).collect()
    assert {r["component_id"] for r in with_null if r["doc_id"] in (None, 1, 2)} == {None}  # the null id is the smallest
    assert prefix_join.linked_documents(no_docs(spark)).count() == 0
    assert prefix_join.keep_one(no_docs(spark)).count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    a, b, c, d = (prose(50 + k, 60) for k in range(4))
    rows = [(None, a), (None, b), (None, b), (None, None), (7, c), (7, d), (8, c + " end"), (9, b), (10, prose(60, 60))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in prefix_join.keep_one(table).collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (None, b), (None, None), (7, c), (7, d), rows[-1]], key=str)
    linked = prefix_join.linked_documents(table).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in linked) == sorted(
        [("None", "None")] * 3 + [("7", "7")] * 2 + [("8", "7"), ("9", "None"), ("10", "10")]
    )


def test_workers_of_the_suffix_arrays_take_few_bytes_at_a_time(monkeypatch):
    """A batch of many texts is cut up by bytes; before, the segments of a whole batch were held at once."""
    import pyarrow as pa

    texts = ["a" * 100_000, None, "", "b" * 300_000, "é" * 100_000, *["c" * 1_000] * 600]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["text", "n"])
    parts = list(ranges(batch, 0, suffix_dedup.TEXT_BYTES))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    sizes = [[len((t or "").encode()) for t in p.column(0).to_pylist()] for p in parts]
    assert all(sum(x) <= suffix_dedup.TEXT_BYTES or len(x) == 1 for x in sizes) and len(parts) > 3
    assert list(ranges(batch.slice(0, 0), 0)) == []
    assert [p.num_rows for p in ranges(batch.slice(3, 3), 0, 250_000)] == [1, 2]


def test_leaks(spark):
    item, short = prose(31, 40), "alpha beta gamma delta epsilon zeta eta theta"
    w = words(item)
    swapped = list(w)
    for k in (3, 9, 15, 21, 27, 33):
        swapped[k] = "other"
    broken = [x if k % 3 else "other" for k, x in enumerate(w)]
    benchmark = spark.createDataFrame([(1, item, "x"), (2, short, "x"), (3, None, "x"), (None, "a b c", "x"), (1, item, "x")], "item_id long, text string, tokens string")
    rows = [
        (1, prose(32, 50) + " " + item.upper() + " " + prose(33, 50)), (2, prose(34, 30) + " " + " ".join(swapped)), (3, " ".join(broken)),
        (4, "x " + short), (5, prose(35, 200)), (6, None), (7, ""), (None, item), (8, " ".join(w[10:30])), (9, " ".join(w[:10])), (1, prose(36, 20)),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, leak_doc string")
    found = {(r["doc_id"], r["item_id"]) for r in spaced_seeds.leaks(docs, benchmark).collect()}
    assert found == {(1, 1), (2, 1), (4, 2), (None, 1), (8, 1)}
    kept = spaced_seeds.remove_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] is None) for r in kept.collect()) == [(1, False), (3, False), (5, False), (6, True), (7, False), (9, False)]
    assert spaced_seeds.remove_leaks(docs.limit(0), benchmark).count() == 0
    assert spaced_seeds.remove_leaks(docs, benchmark.limit(0)).count() == len(rows)


def test_leaks_of_a_large_benchmark_shuffle(spark, monkeypatch):
    monkeypatch.setattr(spaced_seeds, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(spaced_seeds, "BROADCAST_IDS", 0)
    item = prose(41, 30)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b " + item), (2, prose(42, 30)), (None, item)], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in spaced_seeds.leaks(docs, benchmark).collect()) == ["1", "None"]
    assert [r["doc_id"] for r in spaced_seeds.remove_leaks(docs, benchmark).collect()] == [2]


def test_tokens_of_a_text_do_not_travel_to_a_large_benchmark(spark, monkeypatch):
    """Beyond the broadcast limit hits meet the items as narrow rows, one per alignment and frame; both paths find the same."""
    item = prose(43, 90)
    benchmark = spark.createDataFrame([(1, item), (2, item), (3, prose(44, 25))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b " + item), (2, prose(45, 30)), (None, prose(46, 40) + " " + prose(44, 25))], "doc_id long, text string")
    expected = sorted(map(str, spaced_seeds.leaks(docs, benchmark).collect()))
    monkeypatch.setattr(spaced_seeds, "BROADCAST_SEEDS", 0)
    found = spaced_seeds.leaks(docs, benchmark)
    assert sorted(map(str, found.collect())) == expected and len(expected) == 3
    blocks = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n\n")
    by_item = [b for b in blocks if ") Exchange" in b and "hashpartitioning(coalesce(item_id" in b]
    assert by_item and not any("tokens" in b for b in by_item)


def test_no_three_substitutions_hide_from_the_masks():
    from itertools import combinations

    size = spaced_seeds.WINDOW
    for missing in combinations(range(size), spaced_seeds.DIFFER):
        assert any(
            all(start + step not in missing for step in mask) for mask in spaced_seeds.MASKS for start in range(size - mask[-1])
        )


def test_sketches_rule_out_only_pairs_that_cannot_link():
    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 3, 40, 64, 65, 500, 600, 1500):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        for changed in (0, n // 20, n // 9, n // 4, n // 2, n):
            sets.append(np.unique(np.r_[base[changed:], rng.integers(0, 2**63, changed, dtype=np.uint64)]))
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    n = np.array([len(s) for s in sets])
    found = prefix_join.sketches(rows, np.concatenate(sets), n)
    assert max(len(s) * 8 / max(k, 64) for s, k in zip(found, n, strict=True)) <= 2
    assert prefix_join.sketches(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(2, np.int64)) == [b"", b""]
    open_far, far = 0, 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            common = len(np.intersect1d(a, b))
            may = prefix_join.may_link(int(n[i]), found[i], int(n[j]), found[j], 80)
            if 100 * common >= 80 * (len(a) + len(b) - common):
                assert may
            elif common * 2 <= min(len(a), len(b)):
                far, open_far = far + 1, open_far + may
    assert far > 1000 and open_far * 50 < far


def test_whole_sets_only_for_pairs_that_may_link(spark, monkeypatch):
    """Texts that share a passage but are not near copies send no sets to each other."""
    shared = prose(90, 30, 5000)
    rows = [(i, prose(100 + i, 150, 5000) + " " + shared) for i in range(40)]
    rows += [(100, rows[0][1].replace(shared.split()[3], "other", 1))]
    asked = []
    verified = prefix_join._verified
    monkeypatch.setattr(prefix_join, "_verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
    found = {r["doc_id"]: r["component_id"] for r in prefix_join.linked_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {**{i: i for i in range(40)}, 100: 0}
    assert sum(asked) <= 3


def test_windows_of_a_task_are_held_in_little_memory():
    """Neither task may hold more than about 70 bytes a window, nor all windows of a partition at once."""
    texts = [" ".join(f"{k}x{j}" for j in range(20_000)) for k in range(100)]
    ids, zeros = np.arange(100), np.zeros(100, np.int64)
    given = [pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts), pa.array(zeros)], names=["doc_id", "text", "tie"])]
    size, n = window_dedup.SIZE, sum(len(t.split()) for t in texts)
    list(window_dedup._window_entries(size, 1)(iter(given)))  # tables of powers are made once
    tracemalloc.start()
    try:
        entries = [None]
        for entries[0] in window_dedup._window_entries(size, 1)(iter(given)):
            pass
        mapped = tracemalloc.get_traced_memory()[1]
        entries = list(window_dedup._window_entries(size, 1)(iter(given)))
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        assert not list(window_dedup._marks(1)(iter(entries)))
        reduced = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert mapped < 50 * n and reduced < 70 * n, (mapped / n, reduced / n)
