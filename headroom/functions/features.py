"""User-written feature expressions and the named presets."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_.]*|\d+(?:\.\d+)?|[-+*/()])")


@dataclass(frozen=True)
class Preset:
    practice_area: str
    features: str
    clusters: int


# The named presets and the cluster counts on offer.
PRESETS = {
    "Immigration": Preset("Immigration", "cit.not_citizen,hh.median_income,eth.hispanic,edu.enrolled", 35),
    "Divorce & Separation": Preset(
        "Divorce & Separation",
        "mar.yes,hh.married_couple,hh.median_income,fer.birth_count,fer.unmarried_birth_pml,emp.no",
        35,
    ),
    "Criminal Defense": Preset(
        "Criminal Defense",
        "age_male,emp.no/pop.base_count,hh.median_income,pov.below/pop.base_count,hh.male_only,"
        "eth.white+eth.asian",
        35,
    ),
    "DUI & DWI": Preset(
        "DUI & DWI",
        "(pop.15_19+pop.20_24+pop.25_29),emp.no/pop.base_count,hh.median_income,"
        "pov.below/pop.base_count,hh.male_only,eth.white",
        35,
    ),
    "Real Estate": Preset(
        "Real Estate",
        "hh.median_income,emp.military,eth.white,hh.families,"
        "(pop.25_29+pop.20_24+pop.15_19+pop.10_14+pop.5_9)",
        35,
    ),
    "Others": Preset(
        "Others",
        "(pop.15_19+pop.20_24+pop.25_29),emp.no/pop.base_count,hh.median_income,"
        "pov.below/pop.base_count,hh.male_only,eth.white",
        35,
    ),
}
CLUSTER_CHOICES = (5, 8, 15, 25, 35)


def plain_name(name: str) -> str:
    """Dotted names become underscored ones, which need no quoting."""
    return name.replace(".", "_")


def plain_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[plain_name(c) for c in df.columns])


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(f"unexpected text in feature expression: {text[at:]!r}")
        token = found.group(1)
        if out and out[-1] not in "+-*/(" and token not in "+-*/)":
            raise ValueError(f"operator missing before {token!r} in feature expression")
        out.append(token)
        at = found.end()
    return out


def _operand_end(tokens: list[str], start: int) -> int:
    """End of the operand at ``start``: one name or number, or a bracketed group."""
    at = start
    while at < len(tokens) and tokens[at] in "+-":
        at += 1
    depth = 0
    while at < len(tokens):
        depth += {"(": 1, ")": -1}.get(tokens[at], 0)
        at += 1
        if depth == 0:
            return at
    raise ValueError("unbalanced brackets in feature expression")


def _sql(tokens: list[str], columns: set[str]) -> str:
    out, at = [], 0
    while at < len(tokens):
        token = tokens[at]
        if token == "/":
            end = _operand_end(tokens, at + 1)
            out.append(f"/ nullif(cast({_sql(tokens[at + 1 : end], columns)} as double), 0d)")
            at = end
            continue
        if token[0].isalpha() or token[0] == "_":
            name = plain_name(token)
            if name not in columns:
                raise ValueError(f"unknown column in feature expression: {token}")
            token = f"`{name}`"
        elif token[0].isdigit():
            token = f"{float(token)!r}d"
        out.append(token)
        at += 1
    return " ".join(out)


def feature_column(text: str, columns: Iterable[str]) -> Column:
    """One expression over known columns with ``+ - * / ( )`` and numbers.

    Only names of the table, numbers and these operators pass, and Spark's own SQL
    parser does the rest. Division by zero gives NULL.
    """
    return F.expr(f"({_sql(_tokens(text), set(columns))})").cast("double")


def split_features(text: str) -> list[str]:
    return [part.strip() for part in text.split(",") if part.strip()]


def names_in(text: str) -> set[str]:
    """The columns that comma-separated expressions name."""
    return {t for part in split_features(text) for t in _tokens(part) if t[0].isalpha() or t[0] == "_"}


def feature_name(text: str) -> str:
    """Readable column name of an expression: its names joined by what links them."""
    words = {"/": "per", "+": "plus", "-": "minus", "*": "times"}
    return "_".join(words.get(t, plain_name(t)) for t in _tokens(text) if t not in "()")


def feature_expressions(df: DataFrame, text: str, keys: Iterable[str]) -> DataFrame:
    """Evaluate comma-separated expressions per row; keys are carried along."""
    columns = df.columns
    return df.select(
        *keys, *[feature_column(e, columns).alias(feature_name(e)) for e in split_features(text)]
    )


def feature_catalog(df: DataFrame, keys: Iterable[str]) -> list[tuple[str, str]]:
    """Sorted (name, type) of the columns a user may choose from."""
    skip = set(keys)
    return sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields if f.name not in skip)
