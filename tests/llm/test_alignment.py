"""Token alignment: equal to a plain walk over both tokenizations."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import no_docs, odd_docs, odd_rows
from tokenizers import Tokenizer

from sparkattest.llm import queries, token_alignment
from sparkattest.llm.token_alignment import Tokenizers, align, linked_pairs, loaded, terminals


@pytest.fixture(scope="module")
def files():
    return queries.aligned_vocabularies()


def brute(rows, files):
    """One row per text, in order, by sets of common ends and explicit lists of links."""
    import sentencepiece

    a_side = Tokenizer.from_file(files[0])
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=files[3])
    tokens: Tokenizers = loaded(files)
    texts, held, counts = [], [], Counter()
    for _, text in rows:
        groups = []
        if text:
            raw = (" " + text).encode()
            a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            if b"".join(tokens.a_bytes[i] for i in a) == raw == b"".join(tokens.b_bytes[i] for i in b):
                ends = [set(np.cumsum([len(table[i]) for i in side]).tolist()) for table, side in ((tokens.a_bytes, a), (tokens.b_bytes, b))]
                i = j = at_a = at_b = 0
                for end in sorted(ends[0] & ends[1]):
                    group = ([], [])
                    while at_a < end:
                        at_a += len(tokens.a_bytes[a[i]])
                        group[0].append(a[i])
                        i += 1
                    while at_b < end:
                        at_b += len(tokens.b_bytes[b[j]])
                        group[1].append(b[j])
                        j += 1
                    groups.append(group)
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        texts.append(groups)
        held.append(links)
        counts.update(set(links))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for (i, _), groups, links in zip(rows, texts, held, strict=True):
        said = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((
            i, sum(len(xs) for xs, _ in groups), sum(len(ys) for _, ys in groups), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


EXTRA = [
    (20, "Ünïcödé naïve café — “quotes” … 漢字かな交じり文 🙂🙃👩‍👩‍👧 ​́"), (21, "a" * 6000), (22, " " * 5000 + "end"), (23, "<|endoftext|> and <s> </s> <unk>"),
    (24, "tab\tand\r\nline\n\n\nbreaks  two   three"), (25, "1234567890 3.14159 0x1F"), (26, "漢" * 700 + "é" * 300), (27, "\x00\x01\x7f"), (28, "ﬁ ½ Ⅷ"),
    (29, "🙂" * 400), (30, "don't I'll we've"), (31, " leading and trailing "),
]


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_against_brute_force(spark, files, limit):
    rows = [r[:2] for r in odd_rows()] + EXTRA
    table = odd_docs(spark).unionByName(spark.createDataFrame(EXTRA, "doc_id long, text string"), allowMissingColumns=True).repartition(3)
    got = align(table, files, broadcast_pairs=limit)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, files)
    assert align(no_docs(spark), files, broadcast_pairs=limit).count() == 0


def test_ids_of_other_types_and_only_empty_texts(spark, files):
    rows = [("a", "one two"), ("b", "one two three"), (None, None), ("", "")]
    got = align(spark.createDataFrame(rows, "doc_id string, text string"), files).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, files)
    got = align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), files).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_both_libraries_of_a_agree(files):
    tokens = loaded(files)
    for _, text in [*EXTRA, *[r[:2] for r in odd_rows()]]:
        if text:
            assert tokens.a(" " + text) == tokens.whole.encode(" " + text, add_special_tokens=False).ids
            assert len(text) > 4000 or tokens.a(" " + text) == tokens.fast.encode_ordinary(" " + text)


def test_pointer_jumping_on_chains_without_common_ends():
    # A ends at even, B at odd offsets: one component up to the shared last byte
    n = 5001
    a_end, b_end = np.r_[np.arange(2, 2 * n, 2), 2 * n + 1], np.r_[np.arange(1, 2 * n, 2), 2 * n + 1]
    last_a, last_b = terminals(a_end, b_end)
    assert set(last_a) == set(last_b) == {len(b_end) - 1}
    rng = np.random.default_rng(4)
    for _ in range(50):
        end = int(rng.integers(5, 60))
        a, b = (np.r_[np.sort(rng.choice(np.arange(1, end), rng.integers(1, end - 1), replace=False)), end] for _ in range(2))
        last_a, last_b = terminals(a, b)
        common = np.intersect1d(a, b)
        assert b[last_a].tolist() == common[np.searchsorted(common, a)].tolist()
        assert b[last_b].tolist() == common[np.searchsorted(common, b)].tolist()


def test_large_groups_are_multiplied(monkeypatch):
    rng = np.random.default_rng(6)
    group_a, group_b = np.repeat([0, 1, 2], [40, 1, 7]), np.repeat([0, 1, 2], [30, 2, 5])
    a, b, doc = rng.integers(0, 9, 48), rng.integers(0, 9, 37), np.array([0, 0, 1])
    plain = [x.tolist() for x in linked_pairs(doc, group_a, group_b, a, b)]
    monkeypatch.setattr(token_alignment, "LARGE", 30)
    assert [x.tolist() for x in linked_pairs(doc, group_a, group_b, a, b)] == plain


def test_registered_query(spark, files, tmp_path):
    rows = [r[:2] for r in odd_rows()]
    odd_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op12_token_alignment(spark, str(tmp_path)).collect()), key=str) == brute(rows, files)
