"""Label columns: names, values, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Offending values that an error names at most.
NAMED = 5


def label_names(names: str | list[str] | None, default: str | None = None) -> list[str]:
    """Names as a list; none given means the default, if there is one."""
    if names is None:
        if default is None:
            raise ValueError("label columns are needed")
        names = default
    out = [names] if isinstance(names, str) else list(names)
    if not out or any(not n for n in out):
        raise ValueError("an empty list of label columns")
    if len(set(out)) != len(out):
        raise ValueError(f"label columns are named twice: {out}")
    return out


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def join_labels(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` that have labels, with them."""
    return df.join(labels, key)


def without_labels(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` that have none."""
    return df.join(labels, key, "left_anti")


def numeric(df: DataFrame, name: str) -> Column:
    """A label as a double: booleans as 0 and 1, numbers in strings read; null where it is none."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        low = F.lower(F.trim(F.col(name)))
        v = F.when(low == "true", F.lit(1.0)).when(low == "false", F.lit(0.0)).otherwise(F.expr(f"try_cast(trim(`{name}`) AS double)"))
    else:
        v = F.col(name).cast("double")
    return F.when(~F.isnan(v), v)


def invalid_labels(df: DataFrame, names: list[str]) -> DataFrame:
    """``label, value``: distinct values that are no numbers (null reads as ``null``)."""
    out = None
    for n in names:
        bad = df.filter(numeric(df, n).isNull()).select(F.lit(n).alias("label"), F.coalesce(F.col(n).cast("string"), F.lit("null")).alias("value")).distinct()
        out = bad if out is None else out.unionByName(bad)
    return out


def with_numeric_labels(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with its label columns as floats; an error names the values that are no numbers."""
    require_columns(df, names)
    bad = [f"{r['label']}={r['value']}" for r in invalid_labels(df, names).orderBy("label", "value").limit(NAMED).collect()]
    if bad:
        raise ValueError(f"labels that are no numbers: {', '.join(bad)}")
    return df.withColumns({n: numeric(df, n).cast("float") for n in names})
