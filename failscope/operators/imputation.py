"""Chained imputation of mixed types: all imputations are one stacked table, with models by imputation.

A column's models come from the moments of the rows that have it, grouped by imputation (and class), in one aggregate; they
are a few numbers that are joined back by broadcast. Draws are hashes of key, imputation, cycle and column, so a rerun on any
partitioning gives the same tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.core import written
from .folds import discriminant, linear, moments, ridge, squared_error

#: A number of at most so many values is a class, as texts and truth values are; of more classes than MOST a gap gets the mode.
FEW, MOST = 2, 20


def _gone(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.typeName()
    return F.col(f"`{c}`").isNull() | F.isnan(f"`{c}`") if kind in ("double", "float") else F.col(f"`{c}`").isNull()


def _steady(x) -> float:
    """A model's number to ten digits, so that the order in which a run sums does not show in what it imputes."""
    return float(f"{float(x):.10g}")


def _draw(salt: str) -> Column:
    """A draw in [0, 1) by key and imputation."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col("_key").cast("string"), F.col("imputation").cast("string"), F.lit(salt))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def draw_steps(features: list[str], classes: int) -> list[dict[str, Column]]:
    """Columns by which ``_drawn``, a class by the draw ``_u`` and the models ``_w`` and ``_b``, is reached step by step: each
    score, exponential and share is a column that later ones name, as one expression would hold a copy of all scores in each
    of its many uses."""
    every = range(classes)
    scores = [F.col(f"_s{c}") for c in every]
    shares, total, drawn = [F.col(f"_p{c}") for c in every], F.lit(0.0), F.lit(0.0)
    for q in shares[:-1]:
        total = total + q
        drawn = drawn + (F.col("_u") >= total).cast("double")
    parts = [F.col(f"_q{c}") for c in every]
    return [
        {f"_s{c}": linear(F.col("_w")[c], features) + F.col("_b")[c] for c in every},
        {"_top": F.greatest(*scores) if classes > 1 else scores[0]},
        {f"_q{c}": F.coalesce(F.exp(scores[c] - F.col("_top")), F.lit(0.0)) for c in every},
        {"_sum": sum(parts[1:], parts[0])},
        {f"_p{c}": F.coalesce(F.try_divide(parts[c], F.col("_sum")), F.lit(0.0)) for c in every},
        {"_drawn": drawn},
    ]


def impute_many(df: DataFrame, cols: list[str], key: str = "row_id", m: int = 5, cycles: int = 5, noise: float = 0.1, salt: str = "0") -> DataFrame:
    """MD13: (imputation from 0, key, cols): ``m`` complete tables, types kept.

    Columns start at their mean, or at the most frequent class (ties: the smallest). In every cycle each incomplete column is
    modelled on all others over the rows that have it: a number by linear regression, whose prediction gets a normal deviate
    times ``noise`` times the regression's error; two or more classes by log-linear probabilities (a linear discriminant, of
    logistic form for two), of which a class is drawn. Classes enter other models as indicators. Text columns of more than
    MOST values keep the mode and enter no model. Whole numbers are rounded, and numbers of at most FEW values are classes.

    Null and NaN are gaps. A column without any value stays null and enters no model. Rows of one key draw alike. The stacked
    table is written once a column and cycle; complete input needs no model. No rows: none.
    """
    number = {c: isinstance(df.schema[c].dataType, NumericType) for c in cols}
    raw = df.select(F.col(key).alias("_key"), *[F.when(~_gone(df, c), F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(cols)])
    raw = written(raw)
    ids = [f"_{i}" for i in range(len(cols))]
    stats = raw.agg(*[F.count_distinct(i).alias(f"d{i}") for i in ids], *[F.count_if(F.col(i).isNull()).alias(f"g{i}") for i in ids], *[F.avg(F.col(i).cast("double")).alias(f"a{i}") for i, c in zip(ids, cols) if number[c]]).first()
    linear_, levels = [], {}
    for i, c in zip(ids, cols):
        if not stats[f"d{i}"]:
            continue
        if number[c] and stats[f"d{i}"] > FEW:
            linear_.append(i)
        elif stats[f"d{i}"] <= MOST:
            levels[i] = sorted(r[0] for r in raw.select(i).where(F.col(i).isNotNull()).distinct().collect())
        else:  # the mode, by a row
            levels[i] = [raw.where(F.col(i).isNotNull()).groupBy(i).count().orderBy(F.desc("count"), i).first()[0]]
    known = [*linear_, *levels]
    coded, modes = {}, {}
    for i in levels:
        value = {v: k for k, v in enumerate(levels[i])}
        if len(value) > 1:
            counts = {r[0]: r[1] for r in raw.groupBy(i).count().collect()}
            modes[i] = min(range(len(value)), key=lambda k: (-counts[levels[i][k]], k))  # noqa: B023
        coded[i] = F.lit(None).cast("double")
        for v, k in value.items():
            coded[i] = F.when(F.col(i) == F.lit(v), float(k)).otherwise(coded[i])
    start = [F.coalesce(F.col(i).cast("double"), F.lit(stats[f"a{i}"])).alias(i) for i in linear_] + [F.coalesce(coded[i], F.lit(float(modes.get(i, 0)))).alias(i) for i in levels]
    gaps = [F.col(i).isNull().alias(f"_g{i}") for i in known]
    d = raw.select("_key", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("imputation"), *start, *gaps)
    spark = df.sparkSession

    def indicators(target: str) -> dict[str, Column]:
        out = {f"_x{i}": F.col(i) for i in linear_ if i != target}
        return out | {f"_x{i}_{k}": (F.col(i) == k).cast("double") for i in modes if i != target for k in range(1, len(levels[i]))}

    for n in range(cycles):
        for i in [i for i in (*linear_, *modes) if stats[f"g{i}"]]:
            x = indicators(i)
            d = d.withColumns(x)
            seen = d.where(f"not _g{i}")
            if i in levels:
                cells, rows = moments(seen.withColumn("_c", F.col(i).cast("int")), ["imputation", "_c"], list(x)), []
                for j in range(m):
                    parts = {c: v for (k, c), v in cells.items() if k == j}
                    model = discriminant(parts) if x else {c: (np.zeros(0), float(np.log(v.n))) for c, v in parts.items()}
                    rows.append((j, [list(map(_steady, model[c][0])) if c in model else None for c in range(len(levels[i]))], [_steady(model[c][1]) if c in model else None for c in range(len(levels[i]))]))
                models = spark.createDataFrame(rows, "imputation int, _w array<array<double>>, _b array<double>")
                steps, value, u_ = draw_steps(list(x), len(levels[i])), F.col("_drawn"), _draw(f"{salt}/{n}/{i}")
            else:
                rows = []
                for (j,), part in moments(seen, ["imputation"], [*x, i]).items():
                    w, b = ridge(part, 1e-9) if x else (np.zeros(0), float(part.mean[-1]))
                    rows.append((j, list(map(_steady, w)), _steady(b), _steady(np.sqrt(squared_error(part, w, b) / part.n))))
                models = spark.createDataFrame(rows, "imputation int, _w array<double>, _b double, _e double")
                z = F.sqrt(-2 * F.log(F.greatest(F.col("_u"), F.lit(1e-12)))) * F.cos(2 * np.pi * _draw(f"{salt}/{n}/{i}/b"))
                steps, value, u_ = [], linear(F.col("_w"), list(x)) + F.col("_b") + z * noise * F.col("_e"), _draw(f"{salt}/{n}/{i}")
            d = d.join(F.broadcast(models), "imputation").withColumn("_u", u_)  # a row an imputation
            for columns in steps:
                d = d.withColumns(columns)
            kept = [c for c in d.columns if c in ("_key", "imputation", *known) or c.startswith("_g")]
            d = written(d.select(*[F.when(F.col(f"_g{i}"), value).otherwise(F.col(i)).alias(i) if c == i else F.col(c) for c in kept]))
    whole = {"byte", "short", "integer", "long"}

    def back(i: str, c: str) -> Column:
        kind = df.schema[c].dataType
        if i in levels:
            return F.element_at(F.array(*map(F.lit, levels[i])), F.col(i).cast("int") + 1).cast(kind)
        if i in linear_:
            return (F.round(i) if kind.typeName() in whole else F.col(i)).cast(kind)
        return F.lit(None).cast(kind)

    return d.select("imputation", F.col("_key").alias(key), *[back(i, c).alias(c) for i, c in zip(ids, cols)])


def impute(df: DataFrame, cols: list[str], key: str = "row_id", cycles: int = 5, noise: float = 0.1, salt: str = "0") -> DataFrame:
    """MD12: one complete table by :func:`impute_many`."""
    return impute_many(df, cols, key, 1, cycles, noise, salt).drop("imputation")
