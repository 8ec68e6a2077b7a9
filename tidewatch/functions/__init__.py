"""Column functions of the transaction model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bank_number(bank: Column) -> Column:
    """A bank id without the zero padding that only some files carry."""
    return bank.cast("bigint").cast("string")


def account_key(bank: Column, account: Column) -> Column:
    """The key of an account: its number alone is not unique. Null if either part is."""
    return F.concat(bank, F.lit("|"), account)


def minute_stamp(text: Column) -> Column:
    """A `yyyy/MM/dd HH:mm` string as a timestamp without zone; malformed text is an error."""
    return F.to_timestamp_ntz(text, F.lit("yyyy/MM/dd HH:mm"))


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def microseconds(ts: Column) -> Column:
    """Microseconds since 1970, all that such a timestamp holds."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def day_number(day: Column, first_day: Column) -> Column:
    """1 on the first day of the data."""
    return (F.datediff(day, first_day) + 1).cast("bigint")


def grouped(x: Column, decimals: int = 0) -> Column:
    """A number with thousands separators, halves to even."""
    return F.format_number(x, decimals)


def plain(x: Column, decimals: int = 0) -> Column:
    """The same without separators."""
    return F.regexp_replace(F.format_number(x, decimals), ",", "")


def hash_bucket(key: Column, buckets: int = 10) -> Column:
    """Bucket from the first 32 bits of the key's MD5, the same in any engine."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def exact(x: Column, scale: int = 8) -> Column:
    """A float as a decimal, so that sums don't depend on their order."""
    return x.cast(f"decimal(28,{scale})")
