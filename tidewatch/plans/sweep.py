"""A rule over a whole grid of parameters in one pass over the payments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seconds
from .evaluate import in_splits
from .params import StructuringParams


@dataclass(frozen=True)
class StructuringGrid:
    """Every band with every count and window; the choice is the best recall among cells of at most `most_per_1000` alerted accounts per 1,000."""

    threshold_usd: float = 10_000
    bands: tuple[float, ...] = (0.05, 0.10, 0.20, 0.30)
    min_txns: tuple[int, ...] = (3, 4, 5)
    windows: tuple[int, ...] = (24, 72, 168)
    most_per_1000: float = 10

    def cells(self) -> list[StructuringParams]:
        return [StructuringParams(self.threshold_usd, b, n, w) for b in self.bands for n in self.min_txns for w in self.windows]


def window_peaks(txns: DataFrame, grid: StructuringGrid, bucket_windows: int = 8) -> DataFrame:
    """account_id, day and for the k-th band and the j-th window `n_k_j`: the most payments of the band in a window that ends at one of them on that day.

    A payment of the narrowest band that holds it counts in all wider ones, and every payment makes one entry and, for each window, one exit, so all
    counts are running sums over one stream of events, sorted once.
    """
    floors = [StructuringParams(grid.threshold_usd, b, 3, 1).floor_usd for b in sorted(grid.bands)]
    usd = F.col("amount_usd")
    narrow = F.coalesce(*[F.when(usd >= F.lit(f), F.lit(k)) for k, f in enumerate(floors)])
    rows = txns.filter(~F.col("is_self_transfer") & (usd >= F.lit(floors[-1])) & (usd < F.lit(float(grid.threshold_usd)))).select(F.col("from_account_id").alias("account_id"), seconds(F.col("txn_ts")).alias("at"), F.to_date("txn_ts").alias("day"), narrow.alias("band"))
    longest = max(grid.windows) * 3600
    span = longest * bucket_windows
    rows = rows.withColumn("home", F.floor(F.col("at") / span)).withColumn("bucket", F.explode(F.sequence(F.col("home"), F.floor((F.col("at") + longest) / span))))
    event = lambda t, kind, window: F.struct(t.alias("t"), F.lit(kind).alias("kind"), F.lit(window).alias("window"))
    at = F.col("at")
    # at one time: entries, then readings, then exits (a payment exactly as old as the window still counts)
    events = [event(at, 0, -1), event(F.when(F.col("bucket") == F.col("home"), at), 1, -1), *[event(at + w * 3600, 2, j) for j, w in enumerate(grid.windows)]]
    flat = rows.select("account_id", "bucket", "day", "band", F.explode(F.array(*events)).alias("e")).select("account_id", "bucket", "day", "band", "e.*").filter("t is not null")
    so_far = Window.partitionBy("account_id", "bucket").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bands = range(len(floors))
    counts = {}
    for k in bands:
        inside = F.col("band") <= k
        for j in range(len(grid.windows)):
            step = F.when(inside & (F.col("kind") == 0), 1).when(inside & (F.col("kind") == 2) & (F.col("window") == j), -1).otherwise(0)
            counts[k, j] = F.sum(step).over(so_far).alias(f"c_{k}_{j}")
    read = flat.select("account_id", "day", "band", "kind", *counts.values()).filter("kind = 1")
    return read.groupBy("account_id", "day").agg(*[F.max(F.when(F.col("band") <= k, F.col(f"c_{k}_{j}"))).alias(f"n_{k}_{j}") for k, j in counts])


def structuring_sweep(txns: DataFrame, labels: DataFrame, tune_last_day: int = 7, grid: StructuringGrid = StructuringGrid()) -> DataFrame:
    """band_pct, min_txns, window_hours, n_alert_rows, n_alerted_accounts, tp_accounts, precision, account_recall, alerts_per_1000_accounts, lift and chosen: the structuring rule at every cell, on the tune split alone.

    Each number is that of the rule run by itself with the cell's parameters. Of cells with equal recall the one of fewer alerts is chosen, then the narrower
    band, the higher count, the shorter window; without a cell within the limit none. Payments after the tune split are not read.
    """
    tune = in_splits(txns, tune_last_day).filter("split = 'tune'")
    peaks = window_peaks(tune, grid)
    bands, cells = sorted(grid.bands), []
    for k, b in enumerate(bands):
        for n in grid.min_txns:
            cells += [(b, n, w, F.col(f"n_{k}_{j}") >= n) for j, w in enumerate(grid.windows)]
    # days and whether any: one row an account, then one row in all
    each = peaks.groupBy("account_id").agg(*[F.count_if(hit).alias(f"d{i}") for i, (_, _, _, hit) in enumerate(cells)])
    pop = labels.filter("split = 'tune'").select("account_id", (F.col("n_laundering_txns") > 0).cast("int").alias("bad"))
    known = pop.join(each, "account_id", "left")
    base = [F.count("*").alias("n_pop"), F.sum("bad").alias("n_bad")]
    sums = [x for i in range(len(cells)) for x in (F.sum(f"d{i}").alias(f"rows{i}"), F.count_if(F.col(f"d{i}") > 0).alias(f"alerted{i}"), F.sum(F.when(F.col(f"d{i}") > 0, F.col("bad"))).alias(f"tp{i}"))]
    whole = known.agg(*base, *sums)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    one = [F.struct(F.lit(b).alias("band_pct"), F.lit(n).alias("min_txns"), F.lit(w).alias("window_hours"), zero(f"rows{i}").alias("n_alert_rows"), zero(f"alerted{i}").alias("n_alerted_accounts"), zero(f"tp{i}").alias("tp_accounts")) for i, (b, n, w, _) in enumerate(cells)]
    t = whole.select("n_pop", "n_bad", F.explode(F.array(*one)).alias("c")).select("n_pop", "n_bad", "c.*")
    tp, n = F.col("tp_accounts"), F.col("n_alerted_accounts")
    t = t.withColumns({"precision": tp / F.nullif(n, F.lit(0)), "account_recall": tp / F.nullif(F.col("n_bad"), F.lit(0)), "alerts_per_1000_accounts": n * F.lit(1000.0).cast("double") / F.nullif(F.col("n_pop"), F.lit(0))})
    t = t.withColumn("lift", F.col("precision") / F.nullif(F.col("n_bad") / F.col("n_pop"), F.lit(0.0)))
    fits = (F.col("alerts_per_1000_accounts") <= grid.most_per_1000) & (n > 0)
    place = F.row_number().over(Window.partitionBy(fits).orderBy(F.desc("account_recall"), n, "band_pct", F.desc("min_txns"), "window_hours"))  # a row for each cell
    return t.withColumn("chosen", F.coalesce(fits & (place == 1), F.lit(False))).drop("n_pop", "n_bad")
