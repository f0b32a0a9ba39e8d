"""How values are shown: amounts, shares, networks, shortened ids, and a dash for what is not there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTHING = "—"


def _or_nothing(c: Column, shown: Column) -> Column:
    return F.when(c.isNull(), NOTHING).otherwise(shown)


def btc(sats: Column, digits: int = 8) -> Column:
    """Satoshis as BTC with so many decimals."""
    return _or_nothing(sats, F.format_string(f"%.{digits}f", sats / 1e8))


def percent(share: Column, digits: int = 1) -> Column:
    return _or_nothing(share, F.format_string(f"%.{digits}f%%", share * 100))


def ratio(part: Column, whole: Column) -> Column:
    """``hits/transactions``."""
    return F.when(part.isNull() | whole.isNull(), NOTHING).otherwise(F.format_string("%d/%d", part.cast("bigint"), whole.cast("bigint")))


def network(asn: Column) -> Column:
    return F.when(asn.isNull() | (asn == 0), NOTHING).otherwise(F.concat(F.lit("AS"), asn.cast("string")))


def shortened(text: Column, keep: int = 12) -> Column:
    """The first characters and an ellipsis, if there are more."""
    return _or_nothing(text, F.when(F.length(text) > keep, F.concat(F.substring(text, 1, keep), F.lit("…"))).otherwise(text))
