"""Robust multivariate outliers: minimum covariance determinant per language and source.

Five transformed text statistics form a vector. Per (language, source) the estimate starts from
the rows nearest to the medians in units of the median deviation and takes concentration
steps: mean and covariance of the nearest `SHARE` of rows, new distances, again, each of which
lowers the determinant. Distances are scaled so that their median is that of a chi-square
variable; rows beyond `CUTOFF` are rejected. Everything is DataFrame expressions: moments come
from partially aggregated sums, the nearest rows from a histogram of distances with
`BINS` bins per factor e, so a source with a third of all rows is no special case.

Groups with fewer than `LEAST` rows are pooled by language, and languages that stay below by
one common group. `RIDGE` keeps the covariance regular where a statistic hardly varies, as most rows have no
repeated line or word; it is small enough for either of these to reject a row by itself.

Only rows that pass the base rule (`base_failed`) enter the estimates. A null text has no words and
fails the base rule; null languages and sources are groups of their own; repeated rows count as
often as they occur; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._tables import fresh, stored

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST, SHARE, STEPS, BINS = 200, 0.75, 4, 64
CUTOFF, MEDIAN = 100.0, 4.3515
RIDGE = (0.05, 0.005, 0.15, 0.25, 0.25)
P = len(RIDGE)
LOW_BITS = 24


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where a lambda in the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are sorted by 40 bits of a hash next to their position in one long, which
    sorts as primitives, and neighbours compared word by word. Where 40 bits do not tell two
    different windows apart, or positions need more than 24 bits, whole windows are sorted.
    """
    low = F.lit((1 << LOW_BITS) - 1).cast("long")
    at = lambda h, i: [F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)]

    def same(h, a, b):
        return reduce(lambda x, y: x & y, [p == q for p, q in zip(at(h, a), at(h, b), strict=True)])

    def neighbours(ordered, test):
        pairs = F.zip_with(F.slice(ordered, 1, F.size(ordered) - 1), F.slice(ordered, 2, F.size(ordered)), test)
        return F.filter(pairs, lambda p: p.isNotNull())

    def covered(pairs):
        starts = F.array_sort(F.array_distinct(F.flatten(pairs)))
        total = F.aggregate(
            starts, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        )
        return total["n"]

    def fast(h):
        packed = F.transform(
            F.sequence(F.lit(0), F.size(h) - 3),
            lambda i: F.xxhash64(*at(h, i)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")),
        )
        place = lambda x: x.bitwiseAND(low).cast("int")
        equal_bits = lambda a, b: F.shiftright(a.bitwiseXOR(b), LOW_BITS) == 0
        return _let(F.sort_array(packed), lambda s: neighbours(s, lambda a, b: F.when(equal_bits(a, b), F.array(place(a), place(b)))))

    def slow(h):
        key = lambda x: F.struct(x["col1"], x["col2"], x["col3"])
        whole = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.struct(
            F.get(h, i).alias("col1"), F.get(h, i + 1).alias("col2"), F.get(h, i + 2).alias("col3"), i.alias("i")))
        return _let(F.array_sort(whole), lambda s: neighbours(s, lambda a, b: F.when(key(a) == key(b), F.array(a["i"], b["i"]))))

    def of(h):
        short = F.size(h) <= (1 << LOW_BITS)
        return F.when(F.size(h) < 3, F.lit(0).cast("long")).when(
            short,
            _let(fast(h), lambda pairs: F.when(
                F.forall(pairs, lambda p: same(h, F.get(p, F.lit(0)), F.get(p, F.lit(1)))), covered(pairs)
            ).otherwise(covered(slow(h)))),
        ).otherwise(covered(slow(h)))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of whole texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = _let(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    names = {n: fresh(docs, n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    both = fresh(docs, "_counted")
    return docs.select(
        "*",
        F.length(F.translate(body, WHITE, "")).cast("long").alias(names["word_chars"]),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias(names["n_symbols"]),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias(names["n_dup_lines"]),
        counted.alias(both),
    ).withColumns({names["n_words"]: F.col(f"`{both}`.n"), names["n_repeat_words"]: F.col(f"`{both}`.r")}).drop(both)


def vector(n_words: str, word_chars: str, n_symbols: str, n_dup_lines: str, n_repeat_words: str) -> list[Column]:
    """The transformed statistics; rates are per word, all on a logarithmic scale."""
    words = F.greatest(F.col(n_words), F.lit(1))
    return [
        F.log(words), F.log(F.greatest(F.col(word_chars), F.lit(1)) / words), F.log1p(100 * F.col(n_symbols) / words),
        F.log1p(100 * F.col(n_dup_lines) / words), F.log1p(100 * F.col(n_repeat_words) / words),
    ]


def _moments(rows: DataFrame, weight: Column) -> DataFrame:
    """Mean m_i and Cholesky factor c_ij of the ridged covariance of the weighted rows of each group."""
    w = weight.cast("double")
    sums = [F.sum(w).alias("s")]
    sums += [F.sum(w * F.col(f"x{i}")).alias(f"s{i}") for i in range(P)]
    sums += [F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)]
    out = rows.groupBy("group").agg(*sums).filter("s > 0")
    out = out.withColumns({f"m{i}": F.col(f"s{i}") / F.col("s") for i in range(P)})
    for i in range(P):
        level = {}
        for j in range(i):
            rest = F.col(f"s{i}{j}") / F.col("s") - F.col(f"m{i}") * F.col(f"m{j}")
            for k in range(j):
                rest = rest - level[f"c{i}{k}"] * F.col(f"c{j}{k}")
            level[f"c{i}{j}"] = rest / F.col(f"c{j}{j}")
        own = F.greatest(F.col(f"s{i}{i}") / F.col("s") - F.col(f"m{i}") * F.col(f"m{i}"), F.lit(0.0)) + RIDGE[i]
        for k in range(i):
            own = own - level[f"c{i}{k}"] * level[f"c{i}{k}"]
        out = out.withColumns(level | {f"c{i}{i}": F.sqrt(F.greatest(own, F.lit(1e-9)))})
    return out.select("group", *[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i in range(P) for j in range(i + 1)])


def _squared(x: list[Column], of=F.col) -> Column:
    """Squared Mahalanobis distance from the columns of `_moments`, found by `of`, by forward substitution."""
    z: list[Column] = []
    for i in range(P):
        rest = x[i] - of(f"m{i}")
        for j in range(i):
            rest = rest - of(f"c{i}{j}") * z[j]
        z.append(rest / of(f"c{i}{i}"))
    return reduce(lambda a, b: a + b, [v * v for v in z])


def _distances(rows: DataFrame, moments: DataFrame) -> DataFrame:
    return rows.join(moments, "group").select("group", *_X, _squared([F.col(c) for c in _X]).alias("d2"))


_X = [f"x{i}" for i in range(P)]


def _bin(d2: Column) -> Column:
    return F.floor(F.log(F.greatest(d2, F.lit(1e-9))) * BINS)


def _quantile(rows: DataFrame, share: float, name: str) -> DataFrame:
    """First distance bin of each group that has at least `share` of its rows at or below it."""
    bins = rows.groupBy("group", _bin(F.col("d2")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    up = W.partitionBy("group").orderBy("bin")
    bins = bins.withColumns({"below": F.sum("n").over(up), "all": F.sum("n").over(W.partitionBy("group"))})
    return bins.filter(F.col("below") >= share * F.col("all")).groupBy("group").agg(F.min("bin").alias(name))


def estimate(rows: DataFrame) -> DataFrame:
    """Moments and distance scale of every group of rows (group, x0 .. x4)."""
    middle = rows.groupBy("group").agg(*[F.percentile_approx(c, 0.5, 10000).alias(f"q{i}") for i, c in enumerate(_X)])
    middle = stored(middle)
    centred = rows.join(middle, "group").select("group", *[F.abs(F.col(c) - F.col(f"q{i}")).alias(f"a{i}") for i, c in enumerate(_X)])
    spread = centred.groupBy("group").agg(*[F.percentile_approx(f"a{i}", 0.5, 10000).alias(f"b{i}") for i in range(P)])
    start = stored(middle.join(spread, "group"))
    first = [(F.col(c) - F.col(f"q{i}")) ** 2 / (2.2 * F.col(f"b{i}") ** 2 + RIDGE[i]) for i, c in enumerate(_X)]
    measured = rows.join(start, "group").select("group", *_X, reduce(lambda a, b: a + b, first).alias("d2"))
    for _ in range(STEPS):
        limit = stored(_quantile(measured, SHARE, "limit"))
        near = measured.join(limit, "group").withColumn("_near", _bin(F.col("d2")) <= F.col("limit"))
        moments = stored(_moments(near, F.col("_near")))
        measured = _distances(rows, moments)
    middle = _quantile(measured, 0.5, "mid").withColumn("scale", F.exp((F.col("mid") + 0.5) / BINS) / MEDIAN)
    return moments.join(middle.drop("mid"), "group")


def _groups(rows: DataFrame) -> DataFrame:
    """Name of the estimation group of each (lang, source)."""
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    name = lambda *cs: F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), c), F.lit("null")) for c in cs]))
    own = F.col("n") >= LEAST
    rest = F.sum(F.when(~own, F.col("n"))).over(W.partitionBy("lang"))
    return sizes.withColumn(
        "group", F.when(own, name("lang", "source")).when(rest >= LEAST, name("lang")).otherwise(F.lit("all"))
    ).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "group")


FIVE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(counted: DataFrame, lang: str = "lang", source: str = "source", five: list[str] = FIVE) -> DataFrame:
    """Add base_failed, distance (null if base_failed) and kept to rows with their statistics.

    The rows are read several times, of wide tables only the statistics: pass a stored table.
    Names that are taken get underscores.
    """
    names = {n: fresh(counted, n) for n in ("base_failed", "distance", "kept")}
    keys = [fresh(counted, k) for k in ("k_lang", "k_source")]
    failed = F.coalesce((F.col(five[0]) < 50) | (100 * F.col(five[4]) > 50 * F.col(five[0])), F.lit(True))
    x = [v.alias(f"x{i}") for i, v in enumerate(vector(*five))]
    own = [F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source")]
    passed = counted.filter(~failed).select(*own, *x)
    groups = stored(_groups(passed))
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    rows = stored(passed.join(groups, same).select("group", *[f"x{i}" for i in range(P)]))
    final = stored(estimate(rows)).join(groups.withColumnRenamed("group", "_group"), F.col("group") == F.col("_group"))
    held, measured = fresh(counted, "estimate"), fresh(counted, "d2")
    figures = [c for c in final.columns if c not in ("_group", "group", "_lang", "_source")]
    place = final.select(F.col("_lang").alias(keys[0]), F.col("_source").alias(keys[1]), F.struct(*figures).alias(held))
    at = counted[lang].cast("string").eqNullSafe(place[keys[0]]) & counted[source].cast("string").eqNullSafe(place[keys[1]])
    joined = counted.join(place, at, "left")
    of = lambda c: F.col(held)[c]
    judged = joined.withColumn(measured, F.when(~failed, _squared(list(vector(*five)), of) / of("scale")))
    return judged.select(
        *[F.col(c) for c in counted.columns], failed.alias(names["base_failed"]), F.col(measured).alias(names["distance"]),
        (~failed & F.coalesce(F.col(measured) <= CUTOFF, F.lit(False))).alias(names["kept"]),
    )


def judge_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents, texts included, with statistics and verdict."""
    names = [fresh(docs, n) for n in FIVE]
    return judge(stored(with_statistics(docs, text)), lang, source, names)
