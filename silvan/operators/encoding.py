"""Strings, factors and flags as integers, by rules that are kept for other frames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Rules:
    """column -> values in the order of their codes, from 1 for strings (0: missing or unknown); flags count 0 and 1, missing ones -1."""

    values: dict[str, list[str]] = field(default_factory=dict)
    flags: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        strings = {c: F.coalesce(F.array_position(F.array(*[F.lit(v) for v in known]) if known else F.array(F.lit(None).cast("string")), F.col(c)), F.lit(0)).cast("int") for c, known in self.values.items()}
        return df.withColumns(strings | {c: F.coalesce(F.col(c).cast("int"), F.lit(-1)) for c in self.flags})


def fit_rules(df: DataFrame, most: int = 10_000) -> Rules:
    """Sorted distinct values of every string column; more than `most` of them raise ValueError."""
    out = Rules(flags=[f.name for f in df.schema.fields if f.dataType.typeName() == "boolean"])
    for f in df.schema.fields:
        if f.dataType.typeName() == "string":
            found = [r[0] for r in df.select(f.name).where(F.col(f.name).isNotNull()).distinct().orderBy(f.name).limit(most + 1).collect()]
            if len(found) > most:
                raise ValueError(f"{f.name} has more than {most} values")
            out.values[f.name] = found
    return out
