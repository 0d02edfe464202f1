"""Quality rules: fixed base rules, then robust multivariate outliers.

Base statistics are computed inside each row with array functions, without a
shuffle. Their transformed vectors are then judged against a minimum covariance
determinant (MCD) estimate of their language and source. Equal vectors count once
there, so copies of one text, however many, have the weight of one. Concentration
steps start from lower quartiles, medians and upper quartiles, each with the median
absolute deviations from it, and keep the nearer half of the vectors; after
SEARCH_STEPS the start of the least determinant goes on alone. The vectors within
the RIM quantile of that estimate give the final mean and covariance, and these
every row its Mahalanobis distance. Only DataFrame and SQL functions are used.

Transformed statistics are whole thousandths and distances are ranked in fixed
bins, so medians and h-subsets come from exact, bounded histograms, sums are
exact decimals, and results do not depend on how rows are dealt to tasks.

Nulls: a null text has no words and fails the base rules; null languages and
sources form groups of their own. A group of fewer than MIN_GROUP distinct vectors,
too few for an estimate of its own, is judged by that of its parent, fitted by the
same steps: its language over all sources, and where that is too small as well, all
rows. Only a table with fewer than MIN_GROUP distinct vectors altogether has no
estimate; the base rules alone decide there. Repeated rows are judged alike. Columns
of the input named like the results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, plain

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_GROUP = 60
#: Near (n + p + 1) / 2 of n vectors, which withstands the largest share of outliers.
COVERAGE = 0.5
STARTS = (0.25, 0.5, 0.75)
SEARCH_STEPS = 3
STEPS = 6
RIM = 0.975
#: Largest squared distance that is kept: this quantile of the chi-square distribution (20.5) times MARGIN, as lengths
#: and shares have heavier tails than normal ones. 4.5 lies in the gap of the 0.1 tables (see the README).
QUANTILE, MARGIN = 0.999, 4.5
#: Up to so many (language, source) estimates are broadcast: about 40 MB; beyond, they are joined.
MAX_BROADCAST_GROUPS = 100_000
FEATURES = ("f_length", "f_word", "f_symbol", "f_line", "f_repeat")
#: Least standard deviation of each feature, in thousandths: a statistic that is
#: zero in most rows must not make every other value an outlier.
FLOORS = (100, 50, 60, 60, 60)
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _let(value: str, name: str, body: str) -> str:
    """Binds a value once; a repeated or lambda-nested reference would be computed again and again."""
    return f"transform(array({value}), {name} -> {body})[0]"


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Columns of these names in the input are replaced.
    """
    t = f"coalesce(`{text}`, '')"
    hashes = "transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"
    ordered = "sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))"
    again = "filter(transform(s, (x, j) -> if((j > 0 and s[j - 1].h = x.h) or (j < size(s) - 1 and s[j + 1].h = x.h), x.i, -1)), p -> p >= 0)"
    covered = f"size(array_distinct(flatten(transform({again}, p -> array(p, p + 1, p + 2)))))"
    # most texts repeat no window, which a hash set shows more cheaply than a sort
    repeats = f"if(size(w) < 4, 0, {_let(hashes, 'h', f'if(size(array_distinct(h)) = size(h), 0, {_let(ordered, "s", covered)})')})"
    words = f"array_remove(split({t}, '[ \\u0009-\\u000D]+'), '')"
    lines = f"filter(split({t}, '\\n'), l -> l rlike '[^ \\u0009-\\u000D]')"
    symbols = t
    for symbol in SYMBOLS:
        symbols = f"replace({symbols}, '{symbol}', '')"
    counted = F.expr(_let(words, "w", f"named_struct('n', size(w), 'c', length(array_join(w, '')), 'r', {repeats})"))
    out = df.withColumn("__counted", counted).withColumns(
        {
            "n_words": F.expr("cast(__counted.n as bigint)"),
            "n_repeat_words": F.expr("cast(__counted.r as bigint)"),
            "word_chars": F.expr("cast(__counted.c as bigint)"),
            "n_symbols": F.expr(f"cast(length({t}) - length({symbols}) as bigint)"),
            "n_dup_lines": F.expr("cast(" + _let(lines, "ls", "size(ls) - size(array_distinct(ls))") + " as bigint)"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__counted")


def with_features(df: DataFrame) -> DataFrame:
    """Adds the transformed statistics in thousandths: logarithms of length and mean word length, square roots of the shares of symbols, repeated lines and repeated words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    root = lambda c: F.sqrt(F.col(c) / n)
    exact = (F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), root("n_symbols"), root("n_dup_lines"), root("n_repeat_words"))
    return df.withColumns({name: F.round(1000 * x).cast("long") for name, x in zip(FEATURES, exact)})


def _incomplete_gamma(a: float, x: float) -> float:
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi_square(share: float, p: int) -> float:
    """The quantile of the chi-square distribution of p degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _incomplete_gamma(p / 2, mid / 2) < share else (low, mid)
    return low


def consistency(coverage: float, p: int) -> float:
    """The factor that makes the covariance of the nearest share of normal rows that of all rows."""
    return coverage / _incomplete_gamma(p / 2 + 1, chi_square(coverage, p) / 2)


def _cholesky(cov: dict[tuple[int, int], Column], centre: list[Column], p: int) -> dict[str, Column]:
    """Columns of a group's estimate: centre m_i and Cholesky factor l_ij, to be computed step by step."""
    return {f"m_{i}": centre[i] for i in range(p)} | {f"c_{i}_{j}": cov[i, j] for i in range(p) for j in range(i + 1)}


def _factored(groups: DataFrame, p: int) -> DataFrame:
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            groups = groups.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return groups.drop(*(f"c_{i}_{j}" for i in range(p) for j in range(i + 1)))


def with_distance(rows: DataFrame, model: DataFrame, keys: list[str], count: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Adds the squared Mahalanobis distance d2 from the estimate of the row's group; null where there is none.

    A group of several estimates gives one row for each; more: columns of the model to add.
    """
    p = len(FEATURES)
    names = [f"__g{i}" for i in range(len(keys))]
    own = model.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), *more, *(f"m_{i}" for i in range(p)), *(f"l_{i}_{j}" for i in range(p) for j in range(i + 1)))
    on = [rows[k].eqNullSafe(own[n]) for k, n in zip(keys, names)]
    out = rows.join(F.broadcast(own) if count <= MAX_BROADCAST_GROUPS else own, on, "left")
    for i in range(p):
        z = F.col(FEATURES[i]) - F.col(f"m_{i}")
        for k in range(i):
            z = z - F.col(f"l_{i}_{k}") * F.col(f"__z{k}")
        out = out.withColumn(f"__z{i}", z / F.col(f"l_{i}_{i}"))
    d2 = sum((F.col(f"__z{i}") * F.col(f"__z{i}") for i in range(1, p)), F.col("__z0") * F.col("__z0"))
    return out.withColumn("d2", d2).drop(*names, *(f"__z{i}" for i in range(p)), *(f"m_{i}" for i in range(p)), *(f"l_{i}_{j}" for i in range(p) for j in range(i + 1)))


def _estimate(kept: DataFrame, keys: list[str], coverage: float) -> DataFrame:
    """Mean and covariance of each group's rows, which are the nearest share of it."""
    p, whole, scale = len(FEATURES), "decimal(38,0)", consistency(coverage, len(FEATURES))
    sums = [F.sum(F.col(f).cast("decimal(18,0)")).cast(whole).alias(f"s_{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum((F.col(FEATURES[i]) * F.col(FEATURES[j])).cast("decimal(18,0)")).cast(whole).alias(f"q_{i}_{j}") for i in range(p) for j in range(i + 1)]
    moments = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *sums)
    n = F.col("__n").cast("double")
    mean = [F.col(f"s_{i}").cast("double") / n for i in range(p)]
    cov = {(i, j): (F.col(f"q_{i}_{j}").cast("double") / n - mean[i] * mean[j]) * scale + (float(FLOORS[i]) ** 2 if i == j else 0.0) for i in range(p) for j in range(i + 1)}
    return cut(_factored(moments.select(*keys, *(c.alias(k) for k, c in _cholesky(cov, mean, p).items())), p))


def _starts(vectors: DataFrame, sizes: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The first estimates of each group, numbered by __start."""
    p, names = len(FEATURES), [f"__k{i}" for i in range(len(keys))]
    same = lambda own: [vectors[k].eqNullSafe(own[n]) for k, n in zip(keys, names)]
    small = lambda df: F.broadcast(df) if count <= MAX_BROADCAST_GROUPS else df
    own = sizes.select(*(F.col(k).alias(n) for k, n in zip(keys, names)))
    centres = vectors.join(small(own), same(own), "left_semi").groupBy(*keys).agg(*(F.percentile(f, F.array(*map(F.lit, STARTS))).alias(f"m_{i}") for i, f in enumerate(FEATURES)))
    own = cut(centres).select(*(F.col(k).alias(n) for k, n in zip(keys, names)), *(f"m_{i}" for i in range(p)))
    near = vectors.join(small(own), same(own))
    spreads = [F.percentile(F.abs(F.col(f) - F.col(f"m_{i}")[s]), F.lit(0.5)).alias(f"s_{i}_{s}") for i, f in enumerate(FEATURES) for s in range(len(STARTS))]
    spread = near.groupBy(*keys).agg(*(F.first(f"m_{i}").alias(f"m_{i}") for i in range(p)), *spreads)
    # uncorrelated: the factor is diagonal
    factor = lambda s: [(F.greatest(1.4826 * F.col(f"s_{i}_{s}"), F.lit(float(FLOORS[i]))) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i in range(p) for j in range(i + 1)]
    each = [F.struct(F.lit(s).alias("__start"), *(F.col(f"m_{i}")[s].alias(f"m_{i}") for i in range(p)), *factor(s)) for s in range(len(STARTS))]
    return cut(spread.select(*keys, F.inline(F.array(*each))))


def _concentrated(vectors: DataFrame, model: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The estimates of the vectors nearest to the last ones of their group and start."""
    # ranked in fixed bins: the smallest one that at least the coverage of a group's vectors do not exceed
    own, names = [*keys, "__start"], [f"__k{i}" for i in range(len(keys) + 1)]
    binned = with_distance(vectors, model, keys, count, ("__start",)).where("d2 is not null").withColumn("__bin", F.floor(256 * F.log1p("d2")))
    limit = cut(binned.groupBy(*own).agg(F.ceil(F.percentile("__bin", F.lit(COVERAGE))).alias("__limit")))
    edge = limit.select(*(F.col(k).alias(n) for k, n in zip(own, names)), "__limit")
    kept = binned.join(F.broadcast(edge) if count <= MAX_BROADCAST_GROUPS else edge, [binned[k].eqNullSafe(edge[n]) for k, n in zip(own, names)]).where("__bin <= __limit")
    return _estimate(kept, own, COVERAGE)


def _least(model: DataFrame, keys: list[str]) -> DataFrame:
    """Each group's estimate of the least determinant."""
    p = len(FEATURES)
    rest = [c for c in model.columns if c not in keys]
    size = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, p)), F.log(F.col("l_0_0")))
    return cut(model.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(size, F.col("__start"))).alias("b")).select(*keys, "b.*"))


def _same(left: DataFrame, right: DataFrame, keys: list[str], names: list[str]) -> list[Column]:
    return [left[k].eqNullSafe(right[n]) for k, n in zip(keys, names)]


def _renamed(df: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return df.select(*(F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)), *more)


def _populations(vectors: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The vectors to fit, by __depth and keys (null beyond the depth), and the depth at which each group of keys is judged.

    A group that is too small for an estimate at one depth goes to its parent at the next.
    """
    names = [f"__r{i}" for i in range(len(keys))]
    groups = cut(vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))
    left, fitted, judged = groups.where(F.col("__n") < MIN_GROUP).drop("__n"), [], []
    large = groups.where(F.col("__n") >= MIN_GROUP).drop("__n")
    for depth in range(len(keys), -1, -1):
        own = keys[:depth]
        if depth < len(keys):
            wanted = _renamed(left.select(*own).distinct(), own) if own else None
            some = vectors.join(wanted, _same(vectors, wanted, own, names), "left_semi") if own else vectors
            some = cut(some.select(*own, *FEATURES).distinct())
            sizes = cut(some.groupBy(*own).agg(F.count(F.lit(1)).alias("__n")))
            good = sizes.where(F.col("__n") >= MIN_GROUP).drop("__n") if own else sizes.where(F.col("__n") >= MIN_GROUP)
            if own:
                of = _renamed(good, own)
                large = left.join(of, _same(left, of, own, names), "left_semi")
                left = cut(left.join(of, _same(left, of, own, names), "left_anti"))
                some = some.join(of, _same(some, of, own, names), "left_semi")
            else:
                large = left if good.count() else left.limit(0)
                some = some if good.count() else some.limit(0)
        else:
            of = _renamed(large, own)
            some = vectors.join(of, _same(vectors, of, own, names), "left_semi")
        blank = [F.lit(None).cast(vectors.schema[k].dataType).alias(k) for k in keys[depth:]]
        fitted.append(some.select(F.lit(depth).alias("__depth"), *own, *blank, *FEATURES))
        judged.append(large.select(F.lit(depth).alias("__depth"), *keys))
        if left.isEmpty():
            break
    whole, places = fitted[0], judged[0]
    for x, y in zip(fitted[1:], judged[1:]):
        whole, places = whole.unionByName(x), places.unionByName(y)
    return cut(whole), cut(places)


def fit(rows: DataFrame, keys: list[str], steps: int = STEPS) -> tuple[DataFrame, int]:
    """The MCD estimate by which each group is judged, from rows with the keys and FEATURES; and the number of groups."""
    p = len(FEATURES)
    vectors, places = _populations(cut(rows.select(*keys, *FEATURES).distinct()), keys)
    deep, count = ["__depth", *keys], places.count()
    sizes = vectors.select(*deep).distinct()
    if not count:
        blank = places.select(*keys)
        return _factored(blank.withColumns({f"m_{i}": F.lit(0.0) for i in range(p)} | {f"c_{i}_{j}": F.lit(1.0) for i in range(p) for j in range(i + 1)}), p), 0
    model = _starts(vectors, sizes, deep, count)
    for step in range(steps):
        if step == SEARCH_STEPS:
            model = _least(model, deep)
        model = _concentrated(vectors, model, deep, count)
    inner = with_distance(vectors, _least(model, deep), deep, count).where(F.col("d2") <= chi_square(RIM, p))
    model = _estimate(inner, deep, RIM)
    # each group with the estimate of its depth: the model's keys are null beyond that
    names = [f"__r{i}" for i in range(len(keys))]
    own = model.withColumnsRenamed({"__depth": "__d", **dict(zip(keys, names))})
    at = [places["__depth"] == own["__d"], *(F.when(places["__depth"] > i, places[k]).eqNullSafe(own[n]) for i, (k, n) in enumerate(zip(keys, names)))]
    return cut(places.join(F.broadcast(own) if count <= MAX_BROADCAST_GROUPS else own, at).drop("__d", *names)), count


def judge(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("lang", "source"), cutoff: float | None = None, fitted: DataFrame | None = None) -> DataFrame:
    """The rows of df with their statistics, base_failed, d2 and kept.

    fitted: rows with statistics already computed, where the caller has them.
    """
    if fitted is None:
        results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "estimate_depth", "kept")
        own, names = plain(df, results)
        inner = tuple(names[k] for k in keys)
        statistics = with_statistics(own, names[text])
        return judge(statistics, names[text], inner, cutoff, statistics).select(*names.values(), *results).toDF(*names, *results)
    rows = with_features(fitted)
    usable = rows.where(~F.col("base_failed")).select(*keys, *FEATURES)
    model, count = fit(usable, list(keys))
    model = model if "__depth" in model.columns else model.withColumn("__depth", F.lit(None).cast("int"))
    far = F.coalesce(F.col("d2") > (MARGIN * chi_square(QUANTILE, len(FEATURES)) if cutoff is None else cutoff), F.lit(False))
    return with_distance(rows, model, list(keys), count, ("__depth",)).withColumn("kept", ~F.col("base_failed") & ~far).withColumnRenamed("__depth", "estimate_depth").drop(*FEATURES)


def op10(docs: DataFrame) -> DataFrame:
    rows = cut(with_statistics(docs).select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    return judge(docs, fitted=rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
