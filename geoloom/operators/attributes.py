"""Operators on attributes. Layers are DataFrames; where the order of rows matters, the caller names the columns that give it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions import geometry as G
from geoloom.functions.keys import CASTS, finite, normalize_key


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def select_columns(df: DataFrame, keep: Sequence[str] | None = None, drop: Sequence[str] | None = None, geometry: str = "geometry") -> DataFrame:
    """The columns named (in that order) or all but them; the geometry always stays."""
    if (keep is None) == (drop is None):
        raise ValueError("give keep or drop")
    need(df, *(keep or drop or ()))
    if keep is not None:
        return df.select(*keep, *[c for c in df.columns if c == geometry and c not in keep])
    return df.drop(*[c for c in drop if c != geometry])


def filter_rows(df: DataFrame, condition: str, refs: Sequence[str], on_missing: str = "exclude", types: dict[str, str] | None = None) -> DataFrame:
    """Rows for which the SQL condition over the columns refs holds.

    types are cast first and stay so. A row that misses a value in refs is excluded, included, or an error.
    """
    need(df, *refs, *(types or ()))
    df = df.withColumns({c: CASTS[t](F.col(c)) for c, t in (types or {}).items()})
    missing = reduce(Column.__or__, [F.col(c).isNull() for c in refs], F.lit(False))
    if on_missing == "exclude":  # bare comparisons reach the scan
        return df.filter(~missing).filter(condition)
    holds = F.coalesce(F.expr(condition), F.lit(False))
    if on_missing == "include":
        return df.filter(missing | holds)
    if on_missing == "error":
        return df.filter(F.when(missing, F.raise_error(F.lit(f"a value of {', '.join(refs)} is missing"))).otherwise(holds))
    raise ValueError(f"on_missing: {on_missing}")


def calculate_field(df: DataFrame, value: str | Column, output_field: str, decimals: int | None = None, compared: Sequence[str | Column] = (), overwrite: bool = False) -> DataFrame:
    """A new number column: null if the value or an operand of a comparison (compared) is not a finite number."""
    if output_field in df.columns and not overwrite:
        raise ValueError(f"there is a column {output_field} already")
    as_column = lambda v: F.expr(v) if isinstance(v, str) else v
    out = finite(as_column(value))
    for c in compared:
        out = F.when(finite(as_column(c)).isNotNull(), out)
    return df.withColumn(output_field, out if decimals is None else F.bround(out, decimals))


def minimum(*values: Column) -> Column:
    """The least value, null if any is missing (least() would skip it)."""
    return F.when(reduce(Column.__or__, [v.isNull() for v in values]), None).otherwise(F.least(*values))


def maximum(*values: Column) -> Column:
    return F.when(reduce(Column.__or__, [v.isNull() for v in values]), None).otherwise(F.greatest(*values))


def clip_value(value: Column, low: Column, high: Column) -> Column:
    return minimum(maximum(value, low), high)


def classify(df: DataFrame, field: str, breaks: Sequence[float], labels: Sequence, output_field: str = "class") -> DataFrame:
    """The label of the interval that field is in; intervals are closed on the left."""
    need(df, field)
    if len(labels) != len(breaks) + 1 or any(a >= b for a, b in zip(breaks, breaks[1:], strict=False)):
        raise ValueError("breaks must rise, with one label more than breaks")
    v = finite(F.col(field))
    out = F.when(v.isNull(), None)
    for b, label in zip(breaks, labels, strict=False):
        out = out.when(v < b, F.lit(label))
    return df.withColumn(output_field, out.otherwise(F.lit(labels[-1])))


def ranking(df: DataFrame, by: Sequence[str], weights: Sequence[float], ascending: Sequence[bool] | None = None, output_field: str = "score") -> DataFrame:
    """The weighted sum of columns scaled to 0..1 over the layer; a constant column gives 0 to every row."""
    need(df, *by)
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError("weights must add up to 1")
    ends = df.agg(*[f(finite(F.col(c))).alias(f"__{n}{i}") for i, c in enumerate(by) for n, f in (("lo", F.min), ("hi", F.max))])
    score = F.lit(0.0)
    for i, (c, w) in enumerate(zip(by, weights, strict=True)):
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        part = F.try_divide(finite(F.col(c)) - lo, hi - lo)
        part = 1 - part if ascending and ascending[i] else part
        score = score + w * F.when(lo == hi, F.lit(0.0)).otherwise(part)
    # One row of extremes: its size does not grow.
    return df.crossJoin(F.broadcast(ends)).withColumn(output_field, score).drop(*ends.columns)


def gate(df: DataFrame, min_rows: int = 1, max_rows: int | None = None, require_fields: Sequence[str] = (), on_fail: str = "empty") -> DataFrame:
    """df if it has the rows and columns asked for; else no rows, df with a warning, or an error."""
    n = df.limit((max_rows or min_rows) + 1).count()
    ok = n >= min_rows and (max_rows is None or n <= max_rows) and all(f in df.columns for f in require_fields)
    if ok or on_fail == "warn":
        return df
    if on_fail == "error":
        raise ValueError(f"the gate is shut: {n} rows counted")
    return df.limit(0)


def top_n(df: DataFrame, by: str, n: int, order: str = "desc", ties: Sequence[str] = (), rank_field: str | None = None) -> DataFrame:
    """The n rows of largest (asc: smallest) number in by; equal ones in the order of ties. Missing numbers drop out."""
    need(df, by, *ties)
    key = F.col(by) if dict(df.dtypes)[by] in ("int", "bigint", "smallint") else finite(F.col(by))
    line = [key.asc() if order == "asc" else key.desc(), *ties]
    out = df.filter(key.isNotNull()).orderBy(*line).limit(n)
    # n rows: the window over all of them is bounded by the parameter.
    return out.withColumn(rank_field, F.row_number().over(Window.orderBy(*line)).cast("long")) if rank_field else out


def deduplicate(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], keep: str = "first") -> DataFrame:
    """One row for each value of by: the first or last by order, or that of the largest_geometry (areas before lines before
    points, then by area, then by length or perimeter; ties: the first by order). Rows that miss a key all stay.

    An aggregation that combines before the shuffle, so a key that many rows share does not gather in one task.
    """
    need(df, *by)
    missing = reduce(Column.__or__, [F.col(c).isNull() for c in by])
    if keep == "largest_geometry":
        g = F.col("geometry")
        measures = (F.coalesce(g["dim"], F.lit(-1)), F.coalesce(G.area(g), F.lit(0.0)), F.coalesce(G.outline(g), F.lit(0.0)))
        order = [*((-m).alias(f"__size{i}") for i, m in enumerate(measures)), *order]
    pick = F.max_by if keep == "last" else F.min_by
    one = df.filter(~missing).groupBy(*by).agg(pick(F.struct(*df.columns), F.struct(*order)).alias("__row")).select("__row.*")
    return one.unionByName(df.filter(missing))


def attribute_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str | None = None, columns: Sequence[str] | None = None, normalize: bool = True, on_duplicate: str = "error", order: Sequence[str] = ()) -> DataFrame:
    """left with columns of the right row of the same key (at most one); missing keys match each other.

    Names that left has already get the suffix _right. on_duplicate: error, or first by order.
    """
    right_on = right_on or left_on
    need(left, left_on)
    need(right, right_on, *(columns or ()))
    take = [c for c in (columns or right.columns) if c not in (right_on, "geometry")]
    key = normalize_key if normalize else (lambda c: c)
    names = {c: f"{c}_right" if c in left.columns else c for c in take}
    row = F.struct(*[F.col(c).alias(names[c]) for c in take])
    first = F.min_by(row, F.struct(*(order or [right_on])))
    one = right.groupBy(key(F.col(right_on)).alias("__rk")).agg(first.alias("__r"), F.count("*").alias("__n"))
    if on_duplicate == "error":
        one = one.withColumn("__r", F.when(F.col("__n") > 1, F.raise_error(F.lit("a key stands twice in the right table"))).otherwise(F.col("__r")))
    joined = left.withColumn("__lk", key(F.col(left_on))).join(one, F.col("__lk").eqNullSafe(F.col("__rk")), "left")
    return joined.select(*left.columns, *[F.col(f"__r.{n}").alias(n) for n in names.values()])


def vector_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, columns by name, what one lacks is null."""
    return a.unionByName(b, allowMissingColumns=True)


def collect(layers: dict[str, DataFrame], source_field: str | None = "source") -> DataFrame:
    """All rows of all layers by name, with the layer's name in source_field."""
    if not layers:
        raise ValueError("no layer")
    if source_field:
        for df in layers.values():
            if source_field in df.columns:
                raise ValueError(f"there is a column {source_field} already")
        layers = {n: df.withColumn(source_field, F.lit(n)) for n, df in layers.items()}
    return reduce(vector_union, layers.values())


def validate(df: DataFrame, required: Sequence[str] = (), types: dict[str, str] | None = None, ranges: dict[str, tuple[float | None, float | None]] | None = None, policy: str = "warn") -> tuple[DataFrame, Column]:
    """(df, flaws): flaws is an array column expression of the rules a row breaks; policy drop or abort acts on it."""
    rules = [F.when(F.col(c).isNull(), F.lit(f"{c}: missing")) for c in required]
    rules += [F.when(F.col(c).isNotNull() & CASTS[t](F.col(c)).isNull(), F.lit(f"{c}: not {t}")) for c, t in (types or {}).items()]
    for c, (lo, hi) in (ranges or {}).items():
        v = CASTS["float"](F.col(c))
        out = (v < lo if lo is not None else F.lit(False)) | (v > hi if hi is not None else F.lit(False))
        rules.append(F.when(out, F.lit(f"{c}: out of range")))
    flaws = F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>")
    if policy == "drop":
        df = df.filter(F.size(flaws) == 0)
    elif policy == "abort":
        df = df.filter(F.when(F.size(flaws) > 0, F.raise_error(F.concat(F.lit("invalid row: "), F.array_join(flaws, "; ")))).otherwise(True))
    return df.withColumns({c: CASTS[t](F.col(c)) for c, t in (types or {}).items()}) if types else df, flaws
