"""Katz backoff language model over word pairs.

Counts. Every text is a start mark, its words and an end mark. Pairs (previous, word) are counted
per Arrow batch, then summed; the table of pairs carries its pair count, and word and context
totals are sums over it. Words are 64-bit hashes.

Discounts. Counts r of 1 to `K` are discounted by Good-Turing:
d(r) = (r* / r - t) / (1 - t) with r* = (r + 1) n[r + 1] / n[r] and t = (K + 1) n[K + 1] / n[1]; where the counts of
counts do not give 0 < d < 1 (small data), r is discounted by n1 / (n1 + 2 n2) instead.

Backoff. A seen pair has d(c) c / c(context). The rest of a context's mass is spread over its unseen words
in proportion to their own probability: the weight is (1 - sum of the seen) / (1 - sum of the own
probabilities of the seen words), which makes every context sum to one exactly. Words
are discounted alike; what they leave is the probability of a word never seen. A context never seen backs
off with weight one. Each token is evaluated from its pair down to its word.

Chunks. The texts are kept as chunks of about `CHUNK_TOKENS` tokens: the hashes of their distinct words and every token as
a number among them. A chunk asks for the counts of its words, then of its pairs, then for the weights of its
contexts: it sends each hash once to the task of the hash's bucket, 7 bytes or less, with what it adds itself, and gets back the sum over
all chunks in the same order. So however frequent a word or pair is, it is one entry a chunk, and no table passes through one
task or the driver. A pair's share of its context is added by one chunk only, the one told that it owns the pair.
Pairs are told apart by 56 bits and the bucket number of a 64-bit hash.

Null and empty texts are the end mark alone. Rows are scored one by one, repeated rows included. Without
training rows every token has the probability of a word never seen, which is then one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import fresh, release, stored, tasks
from ._words import Words, forget, from_planes, mix, planes, slices

K = 5
START, END = 0x51A27, 0x0E7D
CHUNK_TOKENS = 1_500_000
HASH_BYTES = 7
SHARES = 2 * K + 1
STATS = [f"s{k}" for k in range(K + 3)]
CHUNK = "train binary, keys binary, sizes binary, counts binary, words binary, tokens binary, n_train long"
SENT = "bucket int, chunk long, hashes binary, counts binary, shares binary, wanted binary"


def _batch(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _numbers(blob: bytes, width: int) -> np.ndarray:
    return from_planes(np.frombuffer(blob, np.uint8), len(blob) // width, width)


def _packed(values: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs; the first byte says how many."""
    width = max((int(values.max(initial=0)).bit_length() + 7) // 8, 1)
    return bytes([width]) + planes(values, width)


def _unpacked(blob: bytes) -> np.ndarray:
    return _numbers(blob[1:], blob[0]).astype(np.int64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and the number of the value at every place; np.unique needs twice the memory."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(values), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], order[new], number


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token, each row closing with the end mark; and tokens per row."""
    words = Words(data, offsets, lower=True)
    token = np.full(len(words.starts) + len(words.counts), END, np.uint64)
    inner = np.ones(len(token), bool)
    inner[np.cumsum(words.counts + 1) - 1] = False
    token[inner] = words.hashes()
    return token, words.counts + 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(held: list[tuple]) -> pa.RecordBatch:
        tokens, counts, train, keys, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        words, _, number = _distinct(tokens)
        return _batch(CHUNK, [(
            train.astype(np.uint8).tobytes(), planes(keys.view(np.uint64), 8), _packed(sizes), _packed(counts),
            planes(np.diff(words, prepend=np.uint64(0)), 8), _packed(number), int(counts[train].sum()),
        )])

    forget()
    held: list[tuple] = []
    n = 0
    for batch in batches:
        train, keys, sizes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
        for at, data, offsets in slices(batch.column(0)):
            own = slice(at, at + len(offsets) - 1)
            tokens, counts = _tokens(data, offsets)
            held.append((tokens, counts, train[own], keys[own], sizes[own]))
            n += len(tokens)
            if n >= CHUNK_TOKENS:
                yield row(held)
                n = 0
    if held:
        yield row(held)


class _Chunk:
    """A chunk read back: words (sorted hashes), tokens (numbers of words), first token and train flag of each document."""

    def __init__(self, row: dict):
        self.words = np.cumsum(_numbers(row["words"], 8))
        self.tokens = _unpacked(row["tokens"]).astype(np.int32)
        self.counts = _unpacked(row["counts"])
        self.first = np.cumsum(self.counts) - self.counts
        self.train = np.frombuffer(row["train"], np.uint8).astype(bool)
        self.learned = np.repeat(self.train, self.counts)
        # a context is the number of a word, the start mark being one more
        self.contexts = np.r_[self.words, np.uint64(START)]
        self.previous = np.empty_like(self.tokens)
        self.previous[1:] = self.tokens[:-1]
        self.previous[self.first] = len(self.words)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct pairs, a token of each, and the pair of every token."""
        hashes = mix(self.contexts)[self.previous]
        hashes += self.words[self.tokens]
        return _distinct(mix(hashes))


def _order(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order in which hashes are sent, by bucket; edges of the buckets in it; and what is sent of each hash."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int32)
    rest = (hashes // np.uint64(buckets)) & np.uint64((1 << 8 * HASH_BYTES) - 1)
    order = np.lexsort((rest, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1)), rest


def _sent(chunk: int, hashes: np.ndarray, counts: np.ndarray, buckets: int, shares: np.ndarray | None = None, wanted: np.ndarray | None = None) -> Iterator[tuple]:
    """One row per bucket; hashes go as differences, the high bytes of which are mostly zero."""
    order, edges, rest = _order(hashes, buckets)
    for b in np.flatnonzero(np.diff(edges)):
        own = order[edges[b] : edges[b + 1]]
        more = (b"", b"") if shares is None else (_packed(shares[:, own].reshape(-1)), np.packbits(wanted[own]).tobytes())
        yield (int(b), chunk, planes(np.diff(rest[own], prepend=np.uint64(0)), HASH_BYTES), _packed(counts[own]), *more)


def _bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def _got(replies: list[dict], hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, and what the chunk owns, in the order of the hashes; and the weights it wanted, in the order of `_order`."""
    replies = sorted(replies, key=lambda r: r["bucket"])
    order = _order(hashes, buckets)[0]
    sums = [_unpacked(r["counts"]) for r in replies]
    total, owned = np.empty(len(hashes), np.int64), np.empty(len(hashes), bool)
    total[order] = np.concatenate(sums)
    owned[order] = np.concatenate([_bits(r["owned"], len(n)) for r, n in zip(replies, sums, strict=True)])
    return total, owned, np.frombuffer(b"".join(r["weight"] for r in replies), np.float64)


def _word_entries(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                c = _Chunk(row)
                yield _batch(SENT, list(_sent(row["chunk"], c.words, np.bincount(c.tokens[c.learned], minlength=len(c.words)), buckets)))

    return run


def _pair_entries(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                c = _Chunk(row)
                hashes, _, pair = c.pairs()
                yield _batch(SENT, list(_sent(row["chunk"], hashes, np.bincount(pair[c.learned], minlength=len(hashes)), buckets)))

    return run


REPLY = "chunk long, bucket int, counts binary, owned binary, weight binary, " + ", ".join(f"{s} long" for s in STATS)


def _replies(prices: _Prices | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over all chunks, in the order in which each chunk sent its hashes; for contexts the total that divides, and the weights wanted.

        The first row of a bucket carries its sums: of counts, of hashes with a count, and of hashes with counts 1 to K + 1.
        """
        forget()
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                hashes = np.cumsum(_numbers(r["hashes"], HASH_BYTES))
                held.setdefault(r["bucket"], []).append((r["chunk"], hashes, r["counts"], r["shares"], r["wanted"]))
        while held:
            bucket, parts = held.popitem()
            edges = np.cumsum([0, *(len(p[1]) for p in parts)])
            _, first, key = _distinct(np.concatenate([p[1] for p in parts]))
            total = np.bincount(key, weights=np.concatenate([_unpacked(p[2]) for p in parts])).astype(np.int64)  # exact below 2**53
            owned = np.zeros(edges[-1], bool)
            owned[first] = True
            stats = [int(total.sum()), int((total > 0).sum()), *np.bincount(total[total <= K + 1], minlength=K + 2)[1:].tolist()]
            if prices is not None:
                shares = np.zeros((SHARES, len(total)))
                for k, part in enumerate(parts):
                    for sums, own in zip(shares, _unpacked(part[3]).reshape(SHARES, -1), strict=True):
                        some = np.flatnonzero(own)
                        np.add.at(sums, key[edges[k] : edges[k + 1]][some], own[some])
                total, weight = prices.weights(total, shares)
            for k, (chunk, *_, wanted) in enumerate(parts):
                own = key[edges[k] : edges[k + 1]]
                yield _batch(REPLY, [(
                    chunk, bucket, _packed(total[own]), np.packbits(owned[edges[k] : edges[k + 1]]).tobytes(),
                    b"" if prices is None else weight[own][_bits(wanted, len(own))].tobytes(), *(stats if k == 0 else [0] * len(stats)),
                )])

    return run


def _answered(entries: DataFrame, buckets: int, prices: _Prices | None = None) -> DataFrame:
    return stored(entries.repartitionById(buckets, F.col("bucket")).mapInArrow(_replies(prices), REPLY))


def _sums(replies: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Sum of counts, number of hashes with a count, and counts of counts."""
    row = replies.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in STATS]).first()
    return int(row["s0"]), int(row["s1"]), {r: int(row[f"s{r + 1}"]) for r in range(1, K + 2)}


def discounts(n: dict[int, int]) -> list[float]:
    """d(1) .. d(K) from the counts of counts."""
    n1, n2 = n.get(1, 0), n.get(2, 0)
    plain = n1 / (n1 + 2 * n2) if n1 else 0.5
    t = (K + 1) * n.get(K + 1, 0) / n1 if n1 else 1.0
    out = []
    for r in range(1, K + 1):
        d = -1.0
        if n.get(r, 0) and t < 1:
            d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - t) / (1 - t)
        out.append(d if 0 < d < 1 else max(1 - max(plain, 0.1) / r, 1e-3))
    return out


def _discounted(count: np.ndarray, d: list[float]) -> np.ndarray:
    factors = np.r_[1.0, d, 1.0]
    return count * factors[np.minimum(count, K + 1)]


class _Prices:
    """What turns counts into probabilities: discounts, number of training tokens and types."""

    def __init__(self, n: int, v: int, of_words: dict[int, int], of_pairs: dict[int, int]):
        self.d1, self.d2 = discounts(of_words), discounts(of_pairs)
        low = sum(r * of_words[r] for r in range(1, K + 1))
        mass = n - low + sum(r * of_words[r] * self.d1[r - 1] for r in range(1, K + 1))
        self.unseen = 1 - mass / n if n else 1.0
        self.n, self.v, self.n_all = n, v, max(n, 1)
        if n and self.unseen <= 0:  # nothing was discounted: the unseen word takes a count of one
            self.n_all, self.unseen = n + 1, 1 / (n + 1)

    def own(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, _discounted(c, self.d1) / self.n_all, self.unseen)

    def shares(self, n: np.ndarray, c: np.ndarray, context: np.ndarray, contexts: int) -> np.ndarray:
        """What seen pairs add to their contexts, as integers: pairs by count, words by count, and the counts of the words above K."""
        by = [np.bincount(context[x == r], minlength=contexts) for x in (n, c) for r in range(1, K + 1)]
        high = c > K
        return np.array([*by, np.bincount(context[high], weights=c[high], minlength=contexts).astype(np.int64)])

    def weights(self, total: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What divides the counts of each context, and the weight of its unseen words: what discounts leave over what seen words do not cover."""
        left = sum(r * (1 - d) * n for r, d, n in zip(range(1, K + 1), self.d2, shares[:K], strict=True))
        covered = (sum(r * d * n for r, d, n in zip(range(1, K + 1), self.d1, shares[K : 2 * K], strict=True)) + shares[2 * K]) / self.n_all
        # where every count is above K nothing was discounted: the unseen take a count of one
        whole = (total > 0) & (left <= 0)
        total = total + whole
        weight = np.where(whole, 1.0, left) / np.maximum(total, 1) / np.maximum(1 - covered, 1e-15)
        return total, np.where(total > 0, weight, 1.0)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))


def _context_entries(buckets: int, prices: _Prices):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                c = _Chunk(row)
                count = _got(row["of_words"], c.words, buckets)[0]
                hashes, at, _ = c.pairs()
                n, adds, _ = _got(row["of_pairs"], hashes, buckets)
                wanted = np.zeros(len(c.contexts), bool)
                wanted[c.previous[at[n == 0]]] = True
                adds &= n > 0
                at, n = at[adds], n[adds]
                total = np.bincount(c.previous[at], weights=n, minlength=len(c.contexts)).astype(np.int64)
                shares = prices.shares(n, count[c.tokens[at]], c.previous[at], len(c.contexts))
                yield _batch(SENT, list(_sent(row["chunk"], c.contexts, total, buckets, shares, wanted)))

    return run


SUMS = "key long, size int, n long, k long, b double, s double"


def _scores(buckets: int, prices: _Prices):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                c = _Chunk(row)
                count = _got(row["of_words"], c.words, buckets)[0]
                hashes, at, pair = c.pairs()
                n = _got(row["of_pairs"], hashes, buckets)[0]
                before, word = c.previous[at], c.tokens[at]
                wanted = np.zeros(len(c.contexts), bool)
                wanted[before[n == 0]] = True
                total, _, weights = _got(row["of_contexts"], c.contexts, buckets)
                order, weight = _order(c.contexts, buckets)[0], np.ones(len(c.contexts))
                weight[order[wanted[order]]] = weights
                p = np.where(n > 0, _discounted(n, prices.d2) / np.maximum(total[before], 1), weight[before] * prices.own(count)[word])
                known, base = (count > 0).astype(np.int64)[c.tokens], prices.base(count)[c.tokens]
                known, base, logp = (np.add.reduceat(x, c.first) for x in (known, base, np.log10(p)[pair]))
                columns = (_numbers(row["keys"], 8).view(np.int64), _unpacked(row["sizes"]).astype(np.int32), c.counts, known, base, logp)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[f.split()[0] for f in SUMS.split(", ")])

    return run


class Model:
    """The chunks of all texts of `fit`, which hold what was learned from, and the number of training tokens."""

    def __init__(self, chunks: DataFrame, train_tokens: int):
        self.chunks, self.train_tokens = chunks, train_tokens


def _keys(text: Column) -> tuple[Column, Column, Column]:
    body = F.coalesce(text, F.lit(""))
    return body, F.xxhash64(body), F.octet_length(body)


def _chunked(docs: DataFrame, train: Column, text: str) -> DataFrame:
    body, key, size = _keys(F.col(text))
    rows = docs.select(body.alias("text"), F.coalesce(train, F.lit(False)).alias("train"), key.alias("key"), size.alias("size"))
    return stored(rows.mapInArrow(_chunks, CHUNK).withColumn("chunk", F.monotonically_increasing_id()))


def fit(docs: DataFrame, train: Column, text: str = "text") -> Model:
    """Keep all texts of the table as chunks, to learn from the rows where `train` holds."""
    chunks = _chunked(docs, train, text)
    return Model(chunks, int(chunks.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n")).first()["n"]))


def score(docs: DataFrame, model: Model, text: str = "text", *, fitted: bool = False) -> DataFrame:
    """Add n_tokens, n_known, base_score and score (log10) to the rows; names that are taken get underscores.

    Any texts can be scored: those that `fit` never met ask for counts beside its chunks. `fitted` says that all texts were in the table
    of `fit`, trained on or not, which spares their chunks. A score depends on the text alone, so it is found by a hash and the size of the text.
    """
    names = [fresh(docs, c) for c in ("n_tokens", "n_known", "base_score", "score")]
    chunks = model.chunks.withColumn("scored", F.lit(fitted))
    if not fitted:
        new = _chunked(docs, F.lit(False), text).withColumn("chunk", -1 - F.col("chunk"))
        chunks = chunks.unionByName(new.withColumn("scored", F.lit(True)))
    buckets = tasks(docs.sparkSession)
    of_words = _answered(chunks.mapInArrow(_word_entries(buckets), SENT), buckets)
    of_pairs = _answered(chunks.mapInArrow(_pair_entries(buckets), SENT), buckets)
    n, v, counts = _sums(of_words)
    prices = _Prices(n, v, counts, _sums(of_pairs)[2])

    def with_replies(chunks: DataFrame, **replies: DataFrame) -> DataFrame:
        for name, r in replies.items():
            own = r.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts", "owned", "weight")).alias(name))
            chunks = chunks.join(own, "chunk")
        return chunks

    asked = with_replies(chunks, of_words=of_words, of_pairs=of_pairs)
    of_contexts = _answered(asked.mapInArrow(_context_entries(buckets, prices), SENT), buckets, prices)
    del asked
    release(docs.sparkSession)
    answered = with_replies(chunks.filter("scored"), of_words=of_words, of_pairs=of_pairs, of_contexts=of_contexts)
    sums = answered.mapInArrow(_scores(buckets, prices), SUMS).groupBy("key", "size").agg(*[F.min(c).alias(c) for c in ("n", "k", "b", "s")])
    a, b = fresh(docs, "text_key"), fresh(docs, "text_size")
    of_text = sums.select(F.col("key").alias(a), F.col("size").alias(b), *[F.col(c).alias(out) for c, out in zip("nkbs", names, strict=True)])
    _, key, size = _keys(F.col(text))
    return docs.withColumns({a: key, b: size}).join(of_text, [a, b]).select(*docs.columns, *names)
