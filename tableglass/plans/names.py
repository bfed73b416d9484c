"""Group keys under reserved names, so that no name of the user's meets one that an operator makes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tableglass.functions.columns import raw, value

KEY = "__tg_key"


def keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The table with a copy of each key (NaN read as NULL) under a reserved name, and these names."""
    names = [f"{KEY}{i}" for i in range(len(keys))]
    return df.select("*", *[value(df, k).alias(n) for k, n in zip(keys, names)]), names


def free(name: str, taken: Sequence[str]) -> str:
    """The name, with as many underscores behind it as make it differ from all taken ones."""
    while name in taken:
        name += "_"
    return name


def unkeyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys under their own names again; another column of such a name gets an underscore."""
    names, taken = [], list(keys)
    for c in df.columns:
        own = keys[int(c[len(KEY):])] if c.startswith(KEY) else free(c, taken)
        taken += [] if own in keys else [own]
        names.append(own)
    return df.toDF(*names)
