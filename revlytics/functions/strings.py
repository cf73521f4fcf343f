"""White space as Unicode has it, control separators included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
#: A run of white space, as a pattern.
GAP = f"[{WHITE}]+"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where the value is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def strip(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.btrim(text, F.lit(WHITE))
