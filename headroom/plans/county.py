"""ZIP-level census tables to one row of features per county."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from headroom.operators.grouping import numeric_columns, rollup_with_rates
from headroom.operators.reshape import null_to_zero

AGE_BANDS = ["pop.under5", *[f"pop.{a}_{a + 4}" for a in range(5, 85, 5)], "pop.85over"]

# Census rates and the count each is weighted by when ZIP areas are merged.
CENSUS_RATES = {
    **{band: "pop.total" for band in AGE_BANDS},
    "age_male": "pop.male",
    "age_female": "pop.female",
    "hh.avg_size": "hh.total",
    "hh.avg_family_size": "hh.total",
    "hh.median_income": "hh.total",
    "fer.unmarried_birth_pml": "pop.female",
    "fer.age15_50_birth_pml": "pop.female",
    "fer.age15_19_birth_pml": "pop.female",
    "fer.age20_34_birth_pml": "pop.female",
    "fer.age35_50_birth_pml": "pop.female",
}


def county_features(
    areas: DataFrame,
    more: Iterable[DataFrame],
    rates: Mapping[str, str],
    keys: Iterable[str] = ("state", "county"),
    zcta: str = "zcta",
    na_as_zero: bool = True,
    amounts: Iterable[str] = (),
) -> DataFrame:
    """Join ZIP tables on their area code, zero the gaps and roll up to counties.

    All tables join on the same column, so Spark shuffles each of them once by it.
    """
    keys = list(keys)
    joined = areas
    for table in more:
        joined = joined.join(table, zcta)
    if na_as_zero:
        joined = null_to_zero(joined, numeric_columns(joined, [*keys, zcta]))
    sums = [c for c in numeric_columns(joined, [*keys, zcta]) if c not in rates]
    return rollup_with_rates(joined, keys, sums, rates, na_as_zero, amounts)
