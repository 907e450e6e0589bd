"""Where queries register themselves next to their SQL twin."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headroom.queries.twins import with_views
from headroom.queries.warehouse import Warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(warehouse) -> DataFrame`` under ``name``.

    ``sql`` is the statement the check engine runs on the same files; queries whose result
    no SQL can state (k-means, files written and read back) leave it out.
    """

    def register(fn: Callable[[Warehouse], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Warehouse(spark, folder))
        if sql is not None:
            TWINS[name] = with_views(sql)
        return fn

    return register


def rounded(
    df: DataFrame, digits: int | None = None, half_up: Iterable[str] | bool = ()
) -> DataFrame:
    """Doubles rounded and dates as text, so that two engines give equal values.

    Columns in ``half_up`` (True: every double) are rounded by arithmetic that both engines share,
    since amounts often end in an exact half of the last digit. Without ``digits`` those keep 4
    and the others 6.
    """
    cut = 10.0 ** (4 if digits is None else digits)
    digits = 6 if digits is None else digits
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    half_up = doubles if half_up is True else set(half_up or ())
    out = []
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
        if field.name in half_up:
            col = F.floor(col * F.lit(cut) + F.lit(0.5)) / F.lit(cut)
        elif kind == "double":
            col = F.round(col, digits)
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            col = F.date_format(col, "yyyy-MM-dd")
        out.append(col.alias(field.name))
    return df.select(*out)


def half_up_sql(expression: str, digits: int = 4) -> str:
    """The check engine's form of a ``half_up`` column."""
    return f"floor(({expression}) * 1e{digits} + 0.5) / 1e{digits}"
