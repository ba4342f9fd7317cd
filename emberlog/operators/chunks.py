"""Cuts of a table into chunks of about equal size along an order.

Bounds are approximate quantiles of whole columns: they only balance the tasks, results don't depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROWS, MOST, _FAN = 1_000_000, 4096, 16


def bounds(df: DataFrame, columns: list[str], rows: int = ROWS) -> list[list[int]]:
    """For each integer column, ascending bounds of chunks of about `rows` rows, MOST chunks at most.

    None are needed, and the lists are empty, if the table fits one chunk.
    """
    steps = ",".join(str(k / MOST) for k in range(1, MOST))
    marks = [F.expr(f"percentile_approx({c}, cast(split('{steps}', ',') as array<double>), {2 * MOST})") for c in columns]
    n, *found = df.agg(F.count("*"), *marks).first()
    parts = min(MOST, -(-n // rows))
    at = [k * MOST // parts - 1 for k in range(1, parts)]
    return [[f[k] for k in at] if f else [] for f in found]


def literals(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def below(df: DataFrame, name: str, marks: list[int], of: str) -> DataFrame:
    """Add how many of the ascending, distinct marks lie below a column, by levels of _FAN comparisons."""
    stride = 1
    while stride * _FAN <= len(marks):
        stride *= _FAN
    df = df.withColumn(name, F.lit(0).cast("bigint"))
    while stride:
        near = F.slice(literals(marks[stride - 1 :: stride]), (F.col(name) / stride).cast("int") + 1, _FAN)
        df = df.withColumn(name, F.col(name) + stride * F.size(F.filter(near, lambda x: x < F.col(of))))
        stride //= _FAN
    return df
