"""Deterministic draws, canonical row keys and row fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TWO_32 = 4294967296.0


def hash01(seed: int, key: Column) -> Column:
    """Uniform draw in [0, 1) from (seed, key).

    Depends on the key alone, so it is the same for any partitioning and after
    a task is run again, unlike ``rand(seed)``.
    """
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(TWO_32)


def hash01_sql(seed: int, key: str) -> str:
    """:func:`hash01` as a SQL expression, for predicates given as text."""
    return (f"cast(conv(substr(md5(concat('{seed}:', cast({key} as string))), 1, 8), 16, 10)"
            f" as double) / {TWO_32}D")


def value_json(col: Column, dtype: T.DataType) -> Column:
    """JSON text of one value; integral floats print as integers, NULL as null."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        number = col.cast("double")
        integral = number == F.rint(number)
        text = (F.when(integral & (F.abs(number) < F.lit(9.2e18)), number.cast("bigint").cast("string"))
                .when(integral & (F.abs(number) < F.lit(1e38)), number.cast("decimal(38,0)").cast("string"))
                .otherwise(number.cast("string")))
    elif isinstance(dtype, T.DecimalType):
        text = F.rtrim(F.rtrim(col.cast("string"), F.lit("0")), F.lit(".")) if dtype.scale else col.cast("string")
    elif isinstance(dtype, (T.IntegralType, T.BooleanType)):
        text = col.cast("string")
    else:
        quoted = F.to_json(F.array(col.cast("string")))
        text = F.when(col.isNotNull(), F.regexp_extract(quoted, r"(?s)^\[(.*)\]$", 1))
    return F.coalesce(text, F.lit("null"))


def row_key(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Canonical key of a row: columns by name, 1.0 equal to 1, NULL kept."""
    names = sorted(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    parts: list[Column] = []
    for i, name in enumerate(names):
        head = ("{" if i == 0 else ", ") + f'"{name}": '
        parts += [F.lit(head), value_json(F.col(name), types[name])]
    return F.concat(*parts, F.lit("}"))


def fingerprint(columns: Sequence[str]) -> list[Column]:
    """Two independent 64-bit hashes of a row, named ``fp1`` and ``fp2``.

    ``xxhash64`` skips NULLs, so the NULL positions are hashed as well.
    """
    cols = [F.col(c) for c in columns]
    nulls = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cols])
    return [F.xxhash64(nulls, *cols).alias("fp1"),
            F.xxhash64(*reversed(cols), nulls, F.lit(1)).alias("fp2")]
