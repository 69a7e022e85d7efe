"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrweave.session import cut, shared_dir  # noqa: F401

#: The six white-space characters that part words: space and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that `df` does not have yet (compared without case), one for each of `names`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; null counts as empty."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITE[1:], " " * 5)
    return F.array_remove(F.split(spaced, " "), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def held_out_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id written as text, modulo `modulus`; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


_kept: dict[str, Any] = {}


def drop_kept() -> None:
    """What other operators keep in this Python worker goes."""
    _kept.clear()


def kept(key: str, make: Callable[[], Any]) -> Any:
    """What an operator keeps in a Python worker across its tasks; another operator's goes first.

    Workers are reused, so the stores of all stages of a pipeline would add up.
    """
    if key not in _kept:
        drop_kept()
        _kept[key] = make()
    return _kept[key]


#: Rows up to which a slim table (two numbers a row) is broadcast once it has been counted; beyond it a join shuffles.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A slim table that is cheap to count (a checkpoint), marked for broadcast if its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def text_bytes(df: DataFrame, col: str = "text") -> tuple[int, int]:
    """Rows, and UTF-8 bytes of a column, by one aggregate over the whole table."""
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(col))), F.lit(0))).first()
    return int(rows), int(size)
