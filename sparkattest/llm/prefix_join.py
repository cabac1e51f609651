"""Near-duplicate documents by a grouped prefix join on word shingles.

1. A fixed-size sketch of document frequencies orders the shingles, rare ones first; any
   order gives exact results, this one keeps frequent passages out of the prefixes.
2. Documents with equal shingle sets form a class. Classes with equal size and equal prefix
   (the first n - ceil(t * n) + 1 shingles) form a group, so a group enters the join once.
3. Group pairs that share a prefix shingle and pass the size and position filters are
   expanded to class pairs and verified on whole sets. First every shingle pairs each of its
   groups with the smallest id of its size class: a linear number of pairs, mostly the same
   few heads, which joins up a large family of near copies. Then all remaining pairs between different
   components are verified, so no link is lost. Sketches of the sets, a bit or two a shingle, come first: they
   bound what two sets can share, and only pairs that may still link send whole sets.
4. Components come from star rounds on the verified links and the class members.

Shingles are told apart by 58-bit hashes, in a pair by 40 bits. A document with fewer words than a shingle is one shingle; without
words, or null, it has none and is linked to nothing. A document is a doc_id with a text: only rows equal in
both count as one. Documents are ordered by doc_id, a null one first, then by a hash. Other
columns are ignored here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ._graph import components
from ._tables import NO_ID, discard, document_key, fresh, own_number, stored, tasks
from ._words import Words, binary_column, forget, mix, rolling, slices

SHINGLE, PERCENT = 5, 80
CELLS = 1 << 18
MEMBERS_PER_TASK = 2000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Row number and token of every distinct shingle, by row, then frequency rank, then hash."""
    words = Words(data, offsets, lower=True)
    hashes = words.hashes()
    at, tokens = words.windows(hashes, size)
    rows = words.rows[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        whole = rolling(hashes, words.first[short], words.first[short] + words.counts[short], "word")
        rows, tokens = np.r_[rows, short], np.r_[tokens, whole]
    tokens = tokens >> np.uint64(6)
    if rank is not None:
        tokens |= rank[(tokens % np.uint64(CELLS)).astype(np.int64)] << np.uint64(58)
    order = np.lexsort((tokens, rows))
    rows, tokens = rows[order], tokens[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (tokens[1:] != tokens[:-1])
    return rows[keep], tokens[keep]


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a partner of any size must share with a set of n: ceil(percent * n / 100)."""
    return (n * percent + 99) // 100


def _frequency_ranks(texts: DataFrame, size: int) -> np.ndarray:
    """log2 of the document frequency of each sketch cell; `CELLS` numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            parts = [shingle_sets(data, offsets, size, None)[1] for _, data, offsets in slices(batch.column(0))]
            if not parts:
                continue
            tokens, end = np.empty(sum(map(len, parts)), np.uint64), 0
            while parts:  # each part is freed when it is copied
                part = parts.pop()
                tokens[end : end + len(part)] = part
                end += len(part)
            tokens.sort()
            # a shingle that a batch holds once says little; leaving it out keeps the cells free of noise
            same = np.r_[False, tokens[1:] == tokens[:-1], False]
            first = np.flatnonzero(~same[:-1] & same[1:])
            times = np.flatnonzero(same[:-1] & ~same[1:]) - first + 1
            cells = (tokens[first] % np.uint64(CELLS)).astype(np.int64)
            total += np.bincount(cells, weights=times, minlength=CELLS).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    counts = texts.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.ones(CELLS, np.float64)
    frequency[counts["cell"].to_numpy(np.int64)] = np.maximum(counts["n"].to_numpy(np.float64), 1)
    return np.minimum(np.log2(frequency), 63).astype(np.uint64)


def sketches(rows: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> list[bytes]:
    """One bit string per row: bit h mod width is flipped by every hash h; the width is a power of two, at least n and 64."""
    width = np.where(n > 0, np.maximum(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 64), 0)
    at = np.r_[0, np.cumsum(width)]
    place = at[rows] + (hashes & (width[rows] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=at[-1]) & 1).astype(np.uint8), bitorder="little")
    return [packed[s:e].tobytes() for s, e in zip(at[:-1] // 8, at[1:] // 8, strict=True)]


def _folded(sketch: int, bits: int, to: int) -> int:
    """The sketch that the same set has at a smaller width."""
    while bits > to:
        bits >>= 1
        sketch = (sketch >> bits) ^ (sketch & ((1 << bits) - 1))
    return sketch


def may_link(n1: int, sketch1: bytes, n2: int, sketch2: bytes, percent: int) -> bool:
    """False only for sets that cannot reach the threshold: every bit that differs stands for a shingle that only one of them has."""
    bits1, bits2 = 8 * len(sketch1), 8 * len(sketch2)
    bits = min(bits1, bits2)
    one, other = int.from_bytes(sketch1, "little"), int.from_bytes(sketch2, "little")
    differ = (_folded(one, bits1, bits) ^ _folded(other, bits2, bits)).bit_count()
    common = min(n1, n2, (n1 + n2 - differ) // 2)
    return (100 + percent) * common >= percent * (n1 + n2)


def _signatures(size: int, percent: int, rank):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            ids = batch.column(0)
            for row, data, offsets in slices(batch.column(1)):
                rows, tokens = shingle_sets(data, offsets, size, rank.value)
                n_rows = len(offsets) - 1
                n = np.bincount(rows, minlength=n_rows)
                first = np.r_[0, np.cumsum(n)]
                length = np.where(n > 0, n - needed(n, percent) + 1, 0)
                spread = mix(tokens)
                a = np.add.reduceat(np.r_[spread, np.uint64(0)], first[:-1]) if n_rows else spread
                b = np.add.reduceat(np.r_[mix(spread ^ np.uint64(0x5851F42D4C957F2D)), np.uint64(0)], first[:-1]) if n_rows else spread
                place = np.arange(len(tokens)) - np.repeat(first[:-1], n)
                in_prefix = place < np.repeat(length, n)
                p = np.add.reduceat(np.r_[np.where(in_prefix, mix(spread), np.uint64(0)), np.uint64(0)], first[:-1]) if n_rows else spread
                for sums in (a, b, p):
                    sums[n == 0] = 0
                blobs = [tokens[s : s + k].tobytes() for s, k in zip(first[:-1], length, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(row, n_rows), pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in (a, b, p)),
                        binary_column(blobs), binary_column(sketches(rows, spread, n)),
                    ],
                    names=["doc_id", "n", "sig_a", "sig_b", "prefix_sig", "prefix", "sketch"],
                )

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, g, n, pos) for every prefix shingle of a group."""
    for batch in batches:
        blobs = batch.column(2).to_pylist()
        counts = np.array([len(b) // 8 for b in blobs], np.int64)
        if not counts.sum():
            continue
        tokens = np.frombuffer(b"".join(blobs), "<i8")
        ends = np.cumsum(counts)
        pos = np.arange(len(tokens)) - np.repeat(ends - counts, counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(tokens), pa.array(np.repeat(batch.column(0).to_numpy(), counts)), pa.array(np.repeat(batch.column(1).to_numpy(), counts)), pa.array(pos)],
            names=["token", "g", "n", "pos"],
        )


def _passes(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Size and position filters: the shingles behind a shared one must suffice for the overlap."""
    rest = F.least(n1 - p1, n2 - p2)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * rest >= percent * (n1 + n2))


TOKEN_BYTES = 5


def _ways(pairs: DataFrame) -> DataFrame:
    """(id, u, part, side): where the documents of pairs meet, in front as u, behind as v.

    A u with many partners is repeated for every `MEMBERS_PER_TASK` of them.
    """
    counted = pairs.groupBy("u").agg(F.floor(F.count(F.lit(1)) / MEMBERS_PER_TASK).cast("int").alias("k"))
    heads = counted.select(F.col("u").alias("id"), "u", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("part"), F.lit(0).alias("side"))
    tails = pairs.join(counted, "u").select(
        F.col("v").alias("id"), "u", F.pmod(F.xxhash64("v"), F.col("k") + 1).cast("int").alias("part"), F.lit(1).alias("side")
    )
    return heads.union(tails)


def _plausible(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sketches leave it open whether they link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, (0, b"")
        for batch in batches:
            us, vs = [], []
            for u, side, v, n, sketch in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if side == 0:
                    head, own = u, (n, sketch)
                elif head == u and may_link(*own, n, sketch, percent):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    ways = _ways(pairs)
    sent = signed.join(ways, signed["doc_id"] == ways["id"]).select("u", "part", "side", F.col("id").alias("v"), "n", "sketch")
    together = sent.repartition(tasks(pairs.sparkSession), "u", "part").sortWithinPartitions("u", "part", "side")
    return together.mapInArrow(run, "u long, v long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int, rank) -> DataFrame:
    """The pairs (u, v) whose whole sets reach the threshold.

    A text that occurs in a pair goes once through its shingles and sends its set, 40 bits a token, to
    its pairs. Texts are always dealt by id: while the ids are few Spark would broadcast them, and
    the disk of a small run would say nothing about that of a large one.
    """
    ways = _ways(pairs).groupBy("id").agg(F.collect_list(F.struct("u", "part", "side")).alias("ways"))
    bodies = texts.join(ways.hint("merge"), texts["doc_id"] == ways["id"]).select("id", "text", "ways")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ways = batch.column(0).to_pylist(), batch.column(2)
            for row, data, offsets in slices(batch.column(1)):
                rows, tokens = shingle_sets(data, offsets, size, rank.value)
                small = np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]
                at = np.searchsorted(rows, np.arange(len(offsets)))
                out: list[tuple] = []
                for k, own in enumerate(ways.slice(row, len(offsets) - 1).to_pylist()):
                    blob = small[at[k] : at[k + 1]].tobytes()
                    out += [(w["u"], w["part"], w["side"], ids[row + k], blob) for w in own]
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["u", "part", "side", "v", "tokens"]
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in batches:
            us, vs = [], []
            for u, side, v, blob in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                found = np.zeros((len(blob) // TOKEN_BYTES, 8), np.uint8)
                found[:, :TOKEN_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, TOKEN_BYTES)
                found = np.sort(found.reshape(-1).view("<u8"))
                if side == 0:
                    head, own = u, found
                elif head == u:
                    common = len(np.intersect1d(own, found))
                    if 100 * common >= percent * (len(own) + len(found) - common):
                        us.append(u)
                        vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    sent = bodies.mapInArrow(send, "u long, part int, side int, v long, tokens binary")
    together = sent.repartition(tasks(pairs.sparkSession), "u", "part").sortWithinPartitions("u", "part", "side")
    return together.mapInArrow(run, "u long, v long")


def _linked(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) per key, for texts with document keys as doc_id."""
    spark = texts.sparkSession
    rank = spark.sparkContext.broadcast(_frequency_ranks(texts.select("text"), size))
    signed = stored(texts.mapInArrow(
        _signatures(size, percent, rank), "doc_id long, n long, sig_a long, sig_b long, prefix_sig long, prefix binary, sketch binary"
    ))
    same_set = ["n", "sig_a", "sig_b"]
    classes = stored(signed.filter("n > 0").groupBy(*same_set, "prefix_sig").agg(F.min("doc_id").alias("id")))
    groups = classes.groupBy("n", "prefix_sig").agg(F.min("id").alias("g"), F.count(F.lit(1)).alias("members"))
    membership = classes.join(groups.filter("members > 1"), ["n", "prefix_sig"], "left").select(
        "id", "n", F.coalesce("g", "id").alias("g"), F.coalesce("members", F.lit(1)).alias("members")
    )
    membership = stored(membership)
    leaders = membership.filter("id = g").select("g", "n")
    blobs = signed.filter("n > 0").select(F.col("doc_id").alias("g"), "n", "prefix").join(leaders, ["g", "n"], "left_semi")
    postings = blobs.dropDuplicates(["g", "n"]).select("g", "n", "prefix").mapInArrow(_postings, "token long, g long, n long, pos long")
    by_token = W.partitionBy("token")
    counted = postings.withColumn("_c", F.count(F.lit(1)).over(by_token)).filter("_c > 1").drop("_c")
    postings = stored(counted)
    full, signed = signed, stored(signed.drop("prefix"))
    discard(full)

    # a linear number of candidate pairs first
    size_class = F.floor(F.log("n") / F.log(F.lit(100.0 / percent)))
    heads = W.partitionBy("token", size_class).orderBy("g")
    head = F.struct(*[F.first(c).over(heads).alias(c) for c in ("g", "n", "pos")])
    linear = postings.withColumn("o", head).filter(
        (F.col("o.g") != F.col("g")) & _passes(F.col("n"), F.col("pos"), F.col("o.n"), F.col("o.pos"), percent)
    )
    in_group = membership.filter("members > 1 and g <> id").select(F.col("g").alias("o"), "id")
    pair = lambda a, b: [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]
    first_pairs = stored(linear.select(*pair(F.col("g"), F.col("o.g"))).union(in_group.select(*pair(F.col("o"), F.col("id")))).distinct())

    links = stored(_verified(stored(_plausible(first_pairs, signed, percent)), texts, size, percent, rank))
    roots = stored(components(links))

    # every remaining pair between different components
    placed = membership.join(roots, "id", "left").select("id", "g", "members", F.coalesce("root", "id").alias("root"))
    of_group = placed.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    open_postings = postings.join(of_group, "g")
    mixed = open_postings.groupBy("token").agg(F.min("low").alias("_low"), F.max("high").alias("_high")).filter("_low <> _high").select("token")
    open_postings = stored(open_postings.join(mixed, "token", "left_semi"))
    left = open_postings.select("token", *[F.col(c).alias(f"{c}1") for c in ("g", "n", "pos", "low", "high")])
    met = open_postings.join(left, "token").filter(
        (F.col("g1") < F.col("g"))
        & ((F.col("low") != F.col("high1")) | (F.col("high") != F.col("low1")) | (F.col("low") != F.col("high")))
        & _passes(F.col("n"), F.col("pos"), F.col("n1"), F.col("pos1"), percent)
    )
    group_pairs = met.select(F.col("g1").alias("a"), F.col("g").alias("b")).distinct()
    split_groups = of_group.filter("low <> high").select(F.col("g").alias("a"), F.col("g").alias("b"))
    one = placed.select(F.col("g").alias("a"), F.col("id").alias("i"), F.col("root").alias("ri"))
    other = placed.select(F.col("g").alias("b"), F.col("id").alias("j"), F.col("root").alias("rj"))
    expanded = group_pairs.union(split_groups).join(one, "a").join(other, "b").filter("ri <> rj and not (a = b and i > j)")
    rest = stored(expanded.select(*pair(F.col("i"), F.col("j"))).distinct().join(first_pairs, ["u", "v"], "left_anti"))
    more = _verified(stored(_plausible(rest, signed, percent)), texts, size, percent, rank)
    roots = stored(components(links.union(more)))

    labels = classes.join(roots, "id", "left").select(*same_set, F.col("id").alias("class_id"), F.coalesce("root", "id").alias("component_id"))
    keyed = signed.select("doc_id", *same_set).distinct()
    return keyed.join(labels, same_set, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )


def _named(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, Column]:
    """(key, doc_id, n_shingles, first, class_first) per document, and the key; `first` is (doc_id, key) of
    the smallest document of its component, `class_first` of its class, with `NO_ID` for null."""
    key, repeated = document_key(docs, doc_id, text)
    found = _linked(docs.select(key.alias("doc_id"), F.col(text).alias("text")), size, percent)
    of = lambda c: F.struct(F.col(c).alias("doc_id"), F.col(c).alias("key"))
    if not repeated:
        return found.select(
            F.col("doc_id").alias("key"), "doc_id", "n_shingles", of("component_id").alias("first"), of("class_id").alias("class_first")
        ), key
    # keys are hashes: the smallest of a component is found over the ids behind them
    ids = docs.select(key.alias("key"), own_number(docs, doc_id).alias("doc_id")).distinct()
    found = stored(found.withColumnRenamed("doc_id", "key").join(ids, "key"))
    for part, name in (("component_id", "first"), ("class_id", "class_first")):
        least = found.groupBy(part).agg(F.min(F.struct("doc_id", "key")).alias(name))
        found = found.join(least, part)
    return found.select("key", "doc_id", "n_shingles", "first", "class_first"), key


def linked_documents(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) per document.

    Two documents link when 100 * intersection >= percent * union of their shingle sets.
    component_id is the smallest doc_id reachable by links; class_id the smallest with the same set. doc_id must be an integer here.
    """
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} must be an integer column")
    out, _ = _named(docs, size, percent, doc_id, text)
    back = lambda c, name: F.when(F.col(c) != NO_ID, F.col(c)).alias(name)
    return out.select(
        back("doc_id", "doc_id"), "n_shingles", back("first.doc_id", "component_id"), back("class_first.doc_id", "class_id")
    )


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the smallest document of each component, by doc_id and then by hash.

    Rows that share a doc_id, or have none, and differ in their texts are documents of their own; rows equal in
    both become one row.
    """
    out, own = _named(docs, size, percent, doc_id, text)
    key = fresh(docs, "kept_id")
    kept = out.filter(F.col("key") == F.col("first.key")).select(F.col("key").alias(key))
    return docs.withColumn(key, own).join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
