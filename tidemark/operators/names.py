"""Working names, so that a user's columns can be called anything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_names(outputs: Sequence[str]) -> None:
    """Raise ValueError if a result would have two columns of one name."""
    twice = sorted({c for c in outputs if list(outputs).count(c) > 1})
    if twice:
        raise ValueError(f"the result would have two columns named {', '.join(twice)}; rename the input column")


def inner_keys(keys: Sequence[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(keys))]


def neutral(df: DataFrame, keys: Sequence[str], **others: str | None) -> DataFrame:
    """Keys as ``_k0, _k1, ...`` and each named column under its working name."""
    named = [F.col(f"`{c}`").alias(name) for name, c in others.items() if c is not None]
    return df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, inner_keys(keys))], *named)


def given(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Back to the user's names: keys first, then ``{working name: name}``."""
    return df.select(
        *[F.col(n).alias(k) for k, n in zip(keys, inner_keys(keys))],
        *[F.col(f"`{n}`").alias(name) for n, name in columns.items()],
    )


def entity(keys: Sequence[str]) -> Column:
    """The keys as one value that is never null, so that joins on it keep null keys."""
    return F.struct(*keys) if keys else F.lit(0)


def unpacked(keys: Sequence[str], name: str = "_e") -> list[Column]:
    return [F.col(name)[k].alias(k) for k in keys]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    while name in df.columns:
        name = f"_{name}"
    return name
