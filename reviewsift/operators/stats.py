"""Exact percentiles without per-group buffers, and correlations from plain sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from reviewsift.session import materialize

#: Distinct values of a group that one task sorts at most.
SORTED_VALUES = 1 << 17
#: Parts of a larger set in one round of narrowing, and rows of a salted join's small side.
BUCKETS = 64
SALTS = 32


def long_values(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per (group, column, value); NULL and NaN are left out."""
    values = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return (
        df.select(*by, F.explode(values).alias("_v"))
        .select(*by, "_v.column", "_v.value")
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
    )


def value_levels(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """How often each value occurs per (group, column), as a written table.

    Values are counted before the shuffle, so a hot group shrinks to its distinct values, and
    everything else is computed from this table: the data is read once.
    """
    counted = long_values(df, by, columns).groupBy(*by, "column", "value")
    return materialize(counted.agg(F.count("*").alias("n")))


def _covers(percentages: dict[str, float], total: Column, first: Column, rows: Column) -> Column:
    """Whether a stretch of ranks from ``first`` on holds a rank that one of the percentiles needs."""
    holds = F.lit(False)
    for p in percentages.values():
        place = F.lit(float(p)) * (total - 1)
        for rank in (F.floor(place), F.ceil(place)):
            holds = holds | ((rank >= first) & (rank < first + rows))
    return holds


def _met(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a few rows per set to its many values; NULL is a set of its own.

    The few are repeated for each salt, so that a large set meets them in many tasks.
    """
    named = right.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    salted = named.withColumn("_r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    condition = F.pmod(F.xxhash64("value"), F.lit(SALTS)) == F.col("_r_salt")
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return left.join(salted, condition, how).drop("_r_salt", *[f"_r{i}" for i in range(len(keys))])


def _narrowed(levels: DataFrame, keys: list[str], percentages: dict[str, float], most: int) -> DataFrame:
    """Levels that can hold a wanted rank: at most ``most`` per (group, ``_before``).

    A set of more values is cut into ``BUCKETS`` by sketched quantiles of its values; counts per
    bucket tell which of them hold a wanted rank, and only those are kept and cut again. ``_before``
    is the number of rows below a bucket, which also names it.
    """
    sets = [*keys, "_before"]
    totals = levels.groupBy(*keys).agg(F.sum("n").alias("_total"))
    open_ = _met(levels, totals, keys).withColumn("_before", F.lit(0).cast("long"))
    cuts = [k / BUCKETS for k in range(1, BUCKETS)]
    while True:
        open_ = materialize(open_)
        sizes = open_.groupBy(*sets).agg(F.count("*").alias("_values"))
        if (sizes.agg(F.max("_values")).first()[0] or 0) <= most:
            return open_
        # A sketch of fixed size per set, merged from the tasks' own; small sets stay whole.
        sketched = open_.groupBy(*sets).agg(
            F.count("*").alias("_values"), F.percentile_approx("value", cuts, 20 * BUCKETS).alias("_cuts")
        )
        bounds = sketched.where(F.col("_values") > most).drop("_values")
        marked = _met(open_, bounds, sets, "left")
        below = F.size(F.filter("_cuts", lambda cut: cut < F.col("value")))
        marked = marked.withColumn("_bucket", F.when(F.col("_cuts").isNull(), 0).otherwise(below)).drop("_cuts")
        counts = marked.groupBy(*sets, "_bucket").agg(F.sum("n").alias("_rows"), F.max("_total").alias("_total"))
        # One row per bucket: at most BUCKETS in a window.
        earlier = W.partitionBy(*sets).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        counts = counts.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        kept = counts.where(_covers(percentages, F.col("_total"), F.col("_first"), F.col("_rows")))
        open_ = _met(marked, kept.select(*sets, "_bucket", "_first"), [*sets, "_bucket"])
        open_ = open_.drop("_before", "_bucket").withColumnRenamed("_first", "_before")


def percentiles_of(
    levels: DataFrame, percentages: dict[str, float], by: Sequence[str] = (), most: int = SORTED_VALUES
) -> DataFrame:
    """Percentiles of a table of :func:`value_levels`, by selection: no table is sorted as a whole.

    Sets of more than ``most`` distinct values are narrowed to the buckets that hold a wanted rank;
    what is left of a set is sorted in one task, with running sums for the exact rank.
    """
    keys = [*by, "column"]
    largest = levels.groupBy(*keys).agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0
    if largest > most:
        open_ = _narrowed(levels, keys, percentages, most)
    else:
        open_ = levels.withColumns({"_before": F.lit(0).cast("long"), "_total": F.sum("n").over(W.partitionBy(*keys))})
    upto = F.sum("n").over(W.partitionBy(*keys, "_before").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    ranked = open_.withColumn("_first", F.col("_before") + upto - F.col("n"))
    picks = []
    for name, p in percentages.items():
        place = F.lit(float(p)) * (F.col("_total") - 1)
        # A level covers the zero-based ranks [first, first + n - 1].
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            covers = (rank >= F.col("_first")) & (rank < F.col("_first") + F.col("n"))
            picks.append(F.max(F.when(covers, F.col("value"))).alias(f"_{side}_{name}"))
        picks.append(F.max(place - F.floor(place)).alias(f"_at_{name}"))
    picked = ranked.groupBy(*keys).agg(*picks)
    return picked.select(
        *keys,
        *[
            F.when(F.col(f"_lo_{n}") == F.col(f"_hi_{n}"), F.col(f"_lo_{n}"))
            .otherwise(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_at_{n}"))
            .alias(n)
            for n in percentages
        ],
    )


def exact_percentiles(
    df: DataFrame,
    columns: Sequence[str],
    percentages: dict[str, float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Linear-interpolation percentiles, one row per (group, column), one column per name."""
    return percentiles_of(value_levels(df, columns, by), percentages, by)


def correlations(
    df: DataFrame, pairs: Sequence[tuple[str, str]]
) -> tuple[DataFrame, dict[tuple[str, str], str]]:
    """Pearson correlation per pair over the rows where both values are present.

    A first pass reads means and missing counts (one row). The second pass sums products of
    the centred values, which is stable, and needs extra sums only for pairs in which a column
    has missing values. Returns the one-row table of sums and a SQL expression per pair; a
    constant column gives NULL. The sums are SQL text because there are hundreds of them.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    place = {c: i for i, c in enumerate(columns)}
    # Written once: the columns may be derived from whole texts, and both passes need them.
    numbers = materialize(
        df.select(*[F.col(c).cast("double").alias(f"v{i}") for c, i in place.items()])
    )
    first = numbers.selectExpr(
        *[f"avg(v{i}) as m{i}" for i in place.values()],
        *[f"count_if(v{i} is null) as n{i}" for i in place.values()],
    ).first()
    gaps = {c for c, i in place.items() if first[f"n{i}"]}
    centred = numbers.selectExpr(
        *[f"v{i} - double('{first[f'm{i}'] or 0.0!r}') as v{i}" for i in place.values()]
    )
    sums: dict[str, str] = {}

    def moments(x: str, y: str) -> tuple[str, str, str]:
        """Count, sum and sum of squares of x where y is present."""
        i, j = place[x], place[y]
        value, tail = f"v{i}", f"_{i}"
        if y in gaps and y != x:
            value, tail = f"if(v{j} is null, null, v{i})", f"_{i}_{j}"
        sums[f"n{tail}"] = f"double(count({value}))"
        sums[f"s{tail}"] = f"sum({value})"
        sums[f"q{tail}"] = f"sum({value} * {value})"
        return f"n{tail}", f"s{tail}", f"q{tail}"

    values = {}
    for x, y in pairs:
        n, sx, qx = moments(x, y)
        _, sy, qy = moments(y, x)
        cross = f"c_{place[x]}_{place[y]}"
        sums[cross] = f"sum(v{place[x]} * v{place[y]})"
        # Below this share a spread is rounding noise: the column is constant.
        floor = f"1e-18 * {qx} * {qy}"
        spread = f"({qx} - {sx} * {sx} / {n}) * ({qy} - {sy} * {sy} / {n})"
        values[(x, y)] = (
            f"if({n} > 0 and {spread} > {floor}, "
            f"({cross} - {sx} * {sy} / {n}) / sqrt({spread}), null)"
        )
    return centred.selectExpr(*[f"{e} as {name}" for name, e in sums.items()]), values
