"""Reference tables of fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Approximate US dollars for one unit, September 2022.
FX = (
    ("US Dollar", 1.0), ("Euro", 1.00), ("Swiss Franc", 1.03), ("Yuan", 0.145), ("Shekel", 0.29), ("Rupee", 0.0125), ("UK Pound", 1.15), ("Yen", 0.0070),
    ("Ruble", 0.0165), ("Bitcoin", 20000.0), ("Canadian Dollar", 0.77), ("Australian Dollar", 0.68), ("Mexican Peso", 0.050), ("Saudi Riyal", 0.266), ("Brazil Real", 0.19),
)
# Prior risk of a payment format, 0 to 3.
FORMAT_RISK = (("Cash", 3), ("Bitcoin", 3), ("Wire", 2), ("Cheque", 2), ("Credit Card", 1), ("ACH", 1), ("Reinvestment", 0))


def fx_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FX, "currency string, usd_per_unit double")


def format_risk(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMAT_RISK, "payment_format string, risk_weight int")
