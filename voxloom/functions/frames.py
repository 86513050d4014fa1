"""Pandas frames that convert to Arrow the same way whatever pandas infers for strings and missing values."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd


def frame(names: Sequence[str], rows: Iterable[tuple]) -> pd.DataFrame:
    """Rows as object columns: None stays null in integer columns, strings become one Arrow array."""
    columns = list(zip(*rows)) or [()] * len(names)
    return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(names, columns)})


def columns(**named: Iterable) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in named.items()})
