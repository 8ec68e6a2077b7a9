"""Typed, enriched and aggregated layers over the raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import account_key, bank_number, day_number, exact, minute_stamp
from ..operators.ranking import global_row_number
from ..sources import seeds

PATTERN_KEY = ("txn_ts", "from_account_id", "to_account_id", "amount_paid", "payment_currency", "amount_received", "receiving_currency", "payment_format", "is_laundering")


def usd_sum(c: Column) -> Column:
    """A sum of dollars that doesn't depend on the order of rows."""
    return F.sum(exact(c)).cast("double")


def _ends() -> dict[str, Column]:
    return {"from_account_id": account_key(bank_number(F.col("from_bank")), F.col("from_account")), "to_account_id": account_key(bank_number(F.col("to_bank")), F.col("to_account"))}


def staged_transactions(raw: DataFrame) -> DataFrame:
    """Typed transactions with a surrogate key; exact duplicates stay, each with its own key."""
    order = ["from_account", "to_bank", "to_account", "amount_paid", "payment_currency", "amount_received", "receiving_currency", "payment_format", "is_laundering"]
    t = global_row_number(raw, ["timestamp", "from_bank"], order, "txn_id", (F.substring("timestamp", 1, 13),)).withColumns(_ends())
    ts = minute_stamp(F.col("timestamp"))
    return t.select(
        "txn_id", ts.alias("txn_ts"), F.to_date(ts).alias("txn_date"),
        bank_number(F.col("from_bank")).alias("from_bank"), "from_account", bank_number(F.col("to_bank")).alias("to_bank"), "to_account", "from_account_id", "to_account_id",
        F.col("amount_received").cast("double").alias("amount_received"), "receiving_currency", F.col("amount_paid").cast("double").alias("amount_paid"), "payment_currency", "payment_format",
        F.col("is_laundering").cast("int").alias("is_laundering"),
        ((F.col("from_bank").cast("bigint") == F.col("to_bank").cast("bigint")) & (F.col("from_account") == F.col("to_account"))).alias("is_self_transfer"),
    )


def staged_accounts(raw: DataFrame) -> DataFrame:
    first = lambda c, mark: F.split_part(F.col(c), F.lit(mark), F.lit(1))
    return raw.select(account_key(F.col("bank_id"), F.col("account_number")).alias("account_id"), "bank_id", "account_number", "bank_name", first("bank_name", " Bank").alias("bank_country"), "entity_id", "entity_name", first("entity_name", " #").alias("entity_type"))


def staged_patterns(raw: DataFrame) -> DataFrame:
    return raw.withColumns(_ends()).select(
        F.col("pattern_id").cast("bigint").alias("pattern_id"), "pattern_type", minute_stamp(F.col("timestamp")).alias("txn_ts"), "from_account_id", "to_account_id",
        F.col("amount_paid").cast("double").alias("amount_paid"), "payment_currency", F.col("amount_received").cast("double").alias("amount_received"), "receiving_currency", "payment_format", F.col("is_laundering").cast("int").alias("is_laundering"),
    )


def enriched(transactions: DataFrame, patterns: DataFrame) -> DataFrame:
    """Dollar amounts, format risk, day numbers and, for diagnosis only, the pattern tag."""
    spark = transactions.sparkSession
    fx, risk = seeds.fx_rates(spark), seeds.format_risk(spark)  # 15 and 7 rows
    paid = fx.select(F.col("currency").alias("payment_currency"), F.col("usd_per_unit").alias("paid_rate"))
    received = fx.select(F.col("currency").alias("receiving_currency"), F.col("usd_per_unit").alias("received_rate"))
    start = transactions.agg(F.min("txn_date").alias("first_day"))  # one row
    t = transactions.join(F.broadcast(paid), "payment_currency", "left").join(F.broadcast(received), "receiving_currency", "left").join(F.broadcast(risk), "payment_format", "left").crossJoin(F.broadcast(start))
    t = t.join(patterns.select("pattern_id", "pattern_type", *PATTERN_KEY), list(PATTERN_KEY), "left")
    return t.select(
        "txn_id", "txn_ts", "txn_date", day_number(F.col("txn_date"), F.col("first_day")).alias("day_index"), "from_account_id", "to_account_id",
        (F.col("amount_paid") * F.col("paid_rate")).alias("amount_usd"), (F.col("amount_received") * F.col("received_rate")).alias("amount_received_usd"),
        "payment_currency", "receiving_currency", "payment_format", F.col("risk_weight").alias("format_risk_weight"), "is_self_transfer",
        (F.col("payment_currency") != F.col("receiving_currency")).alias("is_cross_currency"), "is_laundering", "pattern_id", "pattern_type",
    )


def edges(txns: DataFrame) -> DataFrame:
    """Movements between two different accounts."""
    return txns.filter(~F.col("is_self_transfer")).select("txn_id", "txn_ts", F.col("from_account_id").alias("src"), F.col("to_account_id").alias("dst"), "amount_usd", "is_laundering")


def pair_days(edge: DataFrame) -> DataFrame:
    """Both sides of every movement by account, counterparty and day: sent (or received), n, usd (a decimal) and largest.

    Counted before they are shuffled, once for all layers that count different counterparties: these are then mere counts of rows, by day or over
    any days, and no account's counterparties are ever held together.
    """
    ends = F.explode(F.array(F.struct(F.col("src").alias("account_id"), F.col("dst").alias("other"), F.lit(True).alias("sent")), F.struct(F.col("dst").alias("account_id"), F.col("src").alias("other"), F.lit(False).alias("sent"))))
    rows = edge.select(ends.alias("e"), F.to_date("txn_ts").alias("day"), "amount_usd").select("e.*", "day", "amount_usd")
    return rows.groupBy("account_id", "other", "sent", "day").agg(F.count("*").alias("n"), F.sum(exact(F.col("amount_usd"))).alias("usd"), F.max("amount_usd").alias("largest"))


def account_daily(pairs: DataFrame) -> DataFrame:
    """Flows of each account and active day, both sides, from pair_days; the largest amounts stay null where a side is absent."""
    out = []
    for name, mine in (("sent", F.col("sent")), ("recv", ~F.col("sent"))):
        of = lambda c, mine=mine: F.when(mine, F.col(c))
        out += [F.coalesce(F.sum(of("n")), F.lit(0)).alias(f"{name}_count"), F.coalesce(F.sum(of("usd")).cast("double"), F.lit(0.0)).alias(f"{name}_usd"), F.max(of("largest")).alias(f"max_{name}_usd"), F.count_if(mine).alias(f"{name}_distinct_counterparties")]
    return pairs.groupBy("account_id", "day").agg(*out)


def endpoints(txns: DataFrame) -> DataFrame:
    """Each transaction once for each account at its ends; a self-transfer once."""
    ends = F.when(F.col("is_self_transfer"), F.array("from_account_id")).otherwise(F.array("from_account_id", "to_account_id"))
    return txns.withColumn("account_id", F.explode(ends))


def activity_days(txns: DataFrame) -> DataFrame:
    """Days on which an account takes part in any transaction: the population of a time split."""
    return endpoints(txns).groupBy("account_id", F.col("txn_date").alias("day"), "day_index").agg(F.count("*").alias("n_txns"), F.sum("is_laundering").alias("n_laundering_txns"))


def account_profile(accounts: DataFrame, txns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every account, active or not, over the whole window; its flows from pair_days. is_laundering_account is a label, never a feature."""
    act = endpoints(txns).groupBy("account_id").agg(F.min("txn_ts").alias("first_txn_ts"), F.max("txn_ts").alias("last_txn_ts"), F.countDistinct("txn_date").alias("active_days"), F.sum(F.col("is_self_transfer").cast("int")).alias("n_self_transfers"), F.sum("is_laundering").alias("n_laundering_txns"))
    flows = []
    for name, degree, mine in (("sent", "out_degree", F.col("sent")), ("recv", "in_degree", ~F.col("sent"))):
        flows += [F.sum(F.when(mine, F.col("n"))).alias(f"n_{name}"), F.sum(F.when(mine, F.col("usd"))).cast("double").alias(f"{name}_usd"), F.count_if(mine).alias(degree)]
    each = pairs.groupBy("account_id", "other", "sent").agg(F.sum("n").alias("n"), F.sum("usd").alias("usd"))
    flow = each.groupBy("account_id").agg(*flows)
    zero = ["active_days", "n_sent", "sent_usd", "out_degree", "n_recv", "recv_usd", "in_degree", "n_self_transfers", "n_laundering_txns"]
    p = accounts.join(act, "account_id", "left").join(flow, "account_id", "left").fillna(0, zero)
    return p.select("account_id", "bank_id", "bank_country", "entity_id", "entity_type", "first_txn_ts", "last_txn_ts", *zero, (F.col("n_laundering_txns") > 0).alias("is_laundering_account"))


def dim_account(profile: DataFrame, accounts: DataFrame) -> DataFrame:
    return profile.join(accounts.select("account_id", "bank_name", "entity_name"), "account_id")
