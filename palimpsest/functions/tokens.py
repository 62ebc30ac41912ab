"""Token counts and cuts by an injected byte-pair encoding (any object with encode and decode)."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_made: dict[Any, Any] = {}


def _once(make: Callable[[], Any], key: str) -> Any:
    if key not in _made:
        _made[key] = make()
    return _made[key]


def token_count(text: Column, make: Callable[[], Any], key: str) -> Column:
    """Number of tokens (null: 0). make builds the encoding once for each Python worker, kept under key."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        enc = _once(make, key)
        return texts.map(lambda t: len(enc.encode(t)) if t else 0).astype("int32")

    return count(text)


def truncate_tokens(text: Column, most: int, make: Callable[[], Any], key: str) -> Column:
    """The text of the first `most` tokens; shorter texts and null as they are."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        enc = _once(make, key)
        return texts.map(lambda t: t if not t or len(ids := enc.encode(t)) <= most else enc.decode(ids[:most]))

    return cut(text)
