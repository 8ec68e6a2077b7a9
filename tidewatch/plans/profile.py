"""Profiles of the raw data and of the time split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import minute_stamp
from ..sources.raw import TRANSACTION_COLUMNS


def profile_counts(raw: dict[str, DataFrame]) -> DataFrame:
    """(metric, value): sizes, window, duplicates, self-transfers, currencies, blanks, orphans and pattern cover; one pass for what one pass can give."""
    t, a, p = raw["transactions"], raw["accounts"], raw["patterns"]
    bad = F.col("is_laundering") == "1"
    same = (F.col("from_bank") == F.col("to_bank")) & (F.col("from_account") == F.col("to_account"))
    whole = F.struct(*TRANSACTION_COLUMNS)
    ts = minute_stamp(F.col("timestamp"))
    one = {
        "transactions": F.count("*"),
        "laundering": F.count_if(bad),
        "calendar_days": F.countDistinct(F.substring("timestamp", 1, 10)),
        "window_minutes": F.timestamp_diff("MINUTE", F.min(ts), F.max(ts)),
        "duplicate_rows": F.count("*") - F.countDistinct(whole),
        "self_transfers": F.count_if(same),
        "self_transfers_laundering": F.count_if(same & bad),
        "cross_currency": F.count_if(F.col("receiving_currency") != F.col("payment_currency")),
        "same_currency_other_amount": F.count_if((F.col("receiving_currency") == F.col("payment_currency")) & (F.col("amount_received") != F.col("amount_paid"))),
        "non_positive": F.count_if((F.col("amount_paid").try_cast("double") <= 0) | (F.col("amount_received").try_cast("double") <= 0)),
        **{f"blank_{c}": F.count_if(F.col(c).isNull() | (F.trim(c) == "")) for c in TRANSACTION_COLUMNS},
    }
    row = t.agg(*[v.cast("bigint").alias(k) for k, v in one.items()])
    ends = t.select(F.explode(F.array("from_account", "to_account")).alias("account"), "is_laundering").groupBy("account").agg(F.max("is_laundering").alias("bad"))
    known = a.select(F.col("account_number").alias("account")).distinct()
    key = list(TRANSACTION_COLUMNS)
    cover = t.filter(bad).select(key).distinct().join(p.select(key).distinct(), key, "left_semi")
    rest = [
        ends.agg(F.count("*").alias("accounts_used"), F.count_if(F.col("bad") == "1").alias("accounts_with_laundering")),
        ends.join(known, "account", "left_anti").agg(F.count("*").alias("orphan_accounts")),
        a.agg(F.count("*").alias("accounts_listed"), F.countDistinct("account_number").alias("account_numbers")),
        p.agg(F.countDistinct("pattern_id").alias("pattern_groups"), F.countDistinct("pattern_type").alias("pattern_types"), F.countDistinct(whole).alias("pattern_rows"), F.countDistinct(F.when(F.col("is_laundering") != "1", whole)).alias("pattern_rows_unlabelled")),
        cover.agg(F.count("*").alias("laundering_in_patterns")),
    ]
    long = lambda r: r.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in r.columns])).alias("m")).select("m.*")
    return reduce(DataFrame.unionByName, map(long, [row, *rest]))


def profile_groups(raw: dict[str, DataFrame]) -> DataFrame:
    """(kind, name, rows, laundering) by day, currency and format."""
    t = raw["transactions"]
    names = {"day": F.substring("timestamp", 1, 10), "currency": F.col("payment_currency"), "format": F.col("payment_format")}
    each = t.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("name")) for k, v in names.items()])).alias("g"), F.col("is_laundering").cast("int").alias("bad"))
    return each.groupBy("g.kind", "g.name").agg(F.count("*").alias("rows"), F.sum("bad").alias("laundering"))


def split_counts(txns: DataFrame) -> DataFrame:
    """Per day: transactions, laundering ones, and different accounts at the ends of laundering ones."""
    ends = txns.select("day_index", F.explode(F.array("from_account_id", "to_account_id")).alias("a"), F.col("is_laundering").alias("l"))
    accounts = ends.groupBy("day_index").agg(F.countDistinct(F.when(F.col("l") == 1, F.col("a"))).alias("labelled_accounts"))
    days = txns.groupBy("day_index").agg(F.count("*").alias("transactions"), F.sum("is_laundering").alias("laundering_txns"))
    return days.join(accounts, "day_index")


def labelled_from_day(txns: DataFrame) -> DataFrame:
    """For each day, the different accounts labelled if validation starts there."""
    ends = txns.filter("is_laundering = 1").select("day_index", F.explode(F.array("from_account_id", "to_account_id")).alias("a"))
    last = ends.groupBy("a").agg(F.max("day_index").alias("last_day"))
    days = txns.select("day_index").distinct()
    return days.join(F.broadcast(last.groupBy("last_day").agg(F.count("*").alias("n"))), F.col("last_day") >= F.col("day_index"), "left").groupBy("day_index").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("labelled_accounts"))
