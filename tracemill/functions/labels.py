"""Label, mask and calendar expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, functions as F

# Reserved tokens of the canonical event vocabulary.
PAD_TOKEN = "[PAD]"
UNK_TOKEN = "[UNK]"
MISSING_TOKEN = "[MISSING]"
OTHER_TOKEN = "[OTHER_ACTIVITY]"
END_TOKEN = "[END]"


def token(activity: str | Column, lifecycle: str | Column) -> Column:
    """``activity+lifecycle``; null when either part is null."""
    a = F.col(activity) if isinstance(activity, str) else activity
    b = F.col(lifecycle) if isinstance(lifecycle, str) else lifecycle
    return F.concat(a, F.lit("+"), b)


def lookup(mapping: Mapping, key: Column) -> Column:
    """Value of a small literal mapping, null where the key is absent."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(pairs, key)


def clean_token(value: Column) -> Column:
    """Null, empty and ``"nan"`` become the missing token."""
    text = value.cast("string")
    return F.when(text.isNull() | text.isin("", "nan"), F.lit(MISSING_TOKEN)).otherwise(text)


def before_last(value: Column, sep: str = "+") -> Column:
    """Text before the last separator; the whole text when there is none."""
    return F.when(
        F.instr(value, sep) > 0,
        F.substring(value, F.lit(1), F.length(value) - F.length(F.substring_index(value, sep, -1)) - len(sep)),
    ).otherwise(value)


def after_last(value: Column, sep: str = "+") -> Column:
    """Text after the last separator; null when there is none."""
    return F.when(F.instr(value, sep) > 0, F.substring_index(value, sep, -1))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Difference of two timestamps in seconds, microseconds kept."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def cycle(position: Column, period: int) -> tuple[Column, Column]:
    """sin and cos of a position on a cycle."""
    angle = position.cast("double") * F.lit(2.0) * F.pi() / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def any_present(cols: Sequence[str]) -> Column:
    """1 when any listed column is not null; 0 otherwise and for no columns."""
    if not cols:
        return F.lit(0)
    return F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(1)) for c in cols], F.lit(0))
