"""Column-name normalisation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def clean_names(names: list[str]) -> list[str]:
    """Lower-case names without non-word characters; collisions get ``_2, _3 …``, empty names ``col_<i>``."""
    cleaned: list[str] = []
    for place, name in enumerate(names):
        base = re.sub(r"\W", "", name).lower() or f"col_{place}"
        candidate, number = base, 1
        while candidate in cleaned:
            number += 1
            candidate = f"{base}_{number}"
        cleaned.append(candidate)
    return cleaned


def clean_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))
