"""Display-name lookup for feature rankings."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakscreen import schema as S


def display_name(c: str | Column, names: Mapping[str, str] = S.DISPLAY_NAMES) -> Column:
    """Short display name, defaulting to the key itself."""
    col = F.col(c) if isinstance(c, str) else c
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    return F.coalesce(F.try_element_at(m, col), col)
