"""Simple paths in time that return to their start, found from two halves."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seconds

Keep = Callable[[str, DataFrame], DataFrame]


class RowBudgetExceeded(RuntimeError):
    """Half walks of one length are more than their row budget."""


def may_close(edges: DataFrame, hours: int) -> DataFrame:
    """The edges (src, dst, at in seconds, and others) that can still stand on a closed walk: after a payment into their start or before one back to it, and before a payment out of their end or after one that left it.

    Both within the window, by the latest and the earliest such payment of the account (running extremes in time order, n log n). A first payment has no
    payment before it, so the start must be paid again later; a last one has none after it, so its end must have paid before.
    """
    width = hours * 3600
    columns = edges.columns
    one = lambda df, account, role: df.withColumn("__account", F.col(account)).withColumn("__role", F.lit(role))
    w = Window.partitionBy("__account").orderBy("at")
    before, after = w.rangeBetween(Window.unboundedPreceding, -1), w.rangeBetween(1, Window.unboundedFollowing)
    other = F.when(F.col("__role") == "other", F.col("at"))
    earlier = F.coalesce(F.col("at") - F.max(other).over(before) <= width, F.lit(False))
    later = F.coalesce(F.min(other).over(after) - F.col("at") <= width, F.lit(False))

    def seen(df: DataFrame, mine: str, theirs: str, names: tuple[str, str]) -> DataFrame:
        rows = one(df, mine, "own").unionByName(one(edges.select("at", theirs), theirs, "other"), allowMissingColumns=True)
        flagged = rows.withColumns({names[0]: earlier, names[1]: later}).filter("__role = 'own'")
        return flagged.drop("__account", "__role")

    started = seen(edges, "src", "dst", ("__paid_before", "__paid_again")).filter("__paid_before or __paid_again")
    ended = seen(started, "dst", "src", ("__left_before", "__leaves_later"))
    first, middle, last = F.col("__paid_again") & F.col("__leaves_later"), F.col("__paid_before") & F.col("__leaves_later"), F.col("__paid_before") & F.col("__left_before")
    return ended.filter(first | middle | last).select(*columns)


def pruned(edges: DataFrame, hours: int, keep: Keep, most_rounds: int = 8) -> DataFrame:
    """may_close until a round takes less than one edge in ten, or most_rounds times: each round is stored and counted."""
    n = edges.count()
    for k in range(most_rounds):
        edges = keep(f"cycle_edges_{k}", may_close(edges, hours))
        left = edges.count()
        if left > 0.9 * n:
            break
        n = left
    return edges


def _single(edges: DataFrame) -> DataFrame:
    """The walks of one payment."""
    return edges.filter("src <> dst").select(F.col("src").alias("start"), F.col("dst").alias("end"), F.array("src", "dst").alias("path"), F.col("at").alias("first"), F.col("at").alias("last"), F.col("usd").alias("smallest"))


def _longer(walks: DataFrame, edges: DataFrame, hours: int, *beside: str) -> DataFrame:
    """The walks with one more payment, and the columns beside them.

    Joined on the walk's end and on time buckets of the window's length: a payment that may follow stands in the bucket of the walk's last time or in a
    later one up to the window's end, so an account's long history is not looked at.
    """
    width = hours * 3600
    bucket = lambda c: F.floor(c / width).cast("bigint")
    step = edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "at", F.col("usd"), bucket(F.col("at")).alias("slot"))
    looked = walks.withColumn("bucket", F.explode(F.sequence(bucket(F.col("last")), bucket(F.col("first") + width))))
    near = (F.col("from") == F.col("end")) & (F.col("slot") == F.col("bucket")) & (F.col("at") > F.col("last")) & (F.col("at") <= F.col("first") + width)
    grown = looked.join(step, near).filter(~F.array_contains("path", F.col("to")))
    return grown.select("start", F.col("to").alias("end"), F.array_append("path", F.col("to")).alias("path"), "first", F.col("at").alias("last"), F.least("smallest", "usd").alias("smallest"), *beside)


def half_walks(edges: DataFrame, max_hops: int, hours: int, row_budget: int | None, keep: Keep | None) -> dict[int, DataFrame]:
    """Simple walks (start, end, path, first, last, smallest) of 1 to max_hops payments with rising times within the window.

    With `keep` the longest are start, end, first and last only: what else belongs to them is found again for those that close (retraced). With a row budget all lengths are
    stored by `keep`, if there is one, and counted against it; without one `keep` stores those that more than one reader needs, and the longest are a plan for their one reader.
    """
    walks = {1: _single(edges)}
    for hops in range(2, max_hops + 1):
        grown = _longer(walks[hops - 1], edges, hours)
        if keep and hops == max_hops:
            grown = grown.select("start", "end", "first", "last")
        if row_budget is not None:
            grown = keep(f"walks_of_{hops}_hops", grown) if keep else grown
            if (n := grown.count()) > row_budget:
                raise RowBudgetExceeded(f"{n} walks of {hops} hops; the budget is {row_budget}")
        elif keep and hops < max_hops:
            grown = keep(f"walks_of_{hops}_hops", grown)
        walks[hops] = grown
    return walks


def facing(walks: dict[int, DataFrame], hours: int) -> DataFrame:
    """Of the half walks, as (pair, slot, kind, first, last), those that a walk between the same accounts in the other direction may follow or precede.

    What is shuffled is a few numbers for each half walk, once, whichever ways it may serve: as a way out and as a way back. pair holds hashes of both accounts, the lesser first;
    kind holds the number of payments, whether the row can be a way back, and the direction. Time is cut in slots of eight windows; a walk whose window ends in a later
    slot has a copy there that is only a way out. Accounts with equal hashes let too many rows stay, never too few.
    """
    width = hours * 3600
    slot = lambda c: F.floor(c / (8 * width)).cast("int")
    out, back = F.hash("start"), F.hash("end")
    pair = F.shiftleft(F.least(out, back).cast("bigint"), 32).bitwiseOR(F.greatest(out, back).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    marks = []
    for hops, df in walks.items():
        copies = F.explode(F.sequence(slot(F.col("first")), slot(F.col("first") + width))).alias("slot")
        rows = df.select(pair.alias("pair"), copies, (out < back).cast("int").alias("forth"), "first", "last")
        marks.append(rows.select("pair", "slot", (4 * F.lit(hops) + 2 * (F.col("slot") == slot(F.col("first"))).cast("int") + F.col("forth")).alias("kind"), "first", "last"))
    w = Window.partitionBy("pair", "slot")
    forth = _forth("kind") == 1
    ends = {f"__last_{x}": F.min(F.when(_forth("kind") == x, F.col("last"))).over(w) for x in (0, 1)}
    begins = {f"__first_{x}": F.max(F.when((_forth("kind") == x) & _own("kind"), F.col("first"))).over(w) for x in (0, 1)}
    theirs = lambda c: F.when(forth, F.col(f"__{c}_0")).otherwise(F.col(f"__{c}_1"))
    meets = (theirs("first") > F.col("last")) | (_own("kind") & (theirs("last") < F.col("first")))
    marks = reduce(DataFrame.unionByName, marks).repartition("pair", "slot")  # before the windows, whose inputs would be shuffled too
    return marks.withColumns(ends | begins).filter(meets | (_low("pair") == _high("pair"))).select("pair", "slot", "kind", "first", "last")


def _forth(kind: str) -> Column:
    return F.col(kind).bitwiseAND(F.lit(1))


def _own(kind: str) -> Column:
    return F.col(kind).bitwiseAND(F.lit(2)) == 2


def _low(pair: str) -> Column:
    return F.shiftright(pair, 32).cast("int")


def _high(pair: str) -> Column:
    return F.shiftright(F.shiftleft(pair, 32), 32).cast("int")


def matched(marks: DataFrame, min_hops: int, max_hops: int, hours: int) -> DataFrame:
    """The half walks of `facing` that another one leads back to their start in time, as (leaves, arrives, hops, leg_first, until), each once; the first two are hashes of the accounts."""
    width = hours * 3600
    side = lambda x: marks.select(*[F.col(c).alias(f"{x}_{c}") for c in marks.columns])
    hops = lambda x: F.shiftright(f"{x}_kind", 2)
    opposite = (_forth("a_kind") != _forth("b_kind")) | (_low("a_pair") == _high("b_pair"))
    lengths = (hops("a") - hops("b")).isin(0, 1) & (hops("a") + hops("b")).between(max(2, min_hops), max_hops)
    in_time = _own("b_kind") & (F.col("b_first") > F.col("a_last")) & (F.col("b_last") <= F.col("a_first") + width)
    met = side("a").join(side("b"), (F.col("a_pair") == F.col("b_pair")) & (F.col("a_slot") == F.col("b_slot")) & opposite & lengths & in_time)

    def leg(x: str) -> Column:
        forth, low, high = _forth(f"{x}_kind") == 1, _low(f"{x}_pair"), _high(f"{x}_pair")
        return F.struct(F.when(forth, low).otherwise(high).alias("leaves"), F.when(forth, high).otherwise(low).alias("arrives"), hops(x).alias("hops"), F.col(f"{x}_first").alias("leg_first"), F.col(f"{x}_last").alias("until"))

    return met.select(F.explode(F.array(leg("a"), leg("b"))).alias("leg")).select("leg.*").distinct()


def retraced(legs: DataFrame, edges: DataFrame, max_hops: int, hours: int) -> dict[int, DataFrame]:
    """The half walks that these legs stand for, whole, by their number of payments."""
    beside = ("arrives", "hops", "until")
    walks = _single(edges).join(legs, (F.hash("start") == F.col("leaves")) & (F.col("first") == F.col("leg_first"))).drop("leaves", "leg_first")
    out = {}
    for hops in range(1, max_hops + 1):
        out[hops] = walks.filter((F.col("hops") == hops) & (F.col("last") == F.col("until")) & (F.hash("end") == F.col("arrives"))).drop(*beside)
        walks = _longer(walks.filter((F.col("hops") > hops) & (F.col("last") < F.col("until"))), edges, hours, *beside).filter("last <= until")
    return out


def _closed(there: DataFrame, back: DataFrame, hops: int, hours: int) -> DataFrame:
    """Walks that go from start to end by `there` and return by `back`, later and over other accounts."""
    width = hours * 3600
    bucket = lambda c: F.floor(c / width).cast("bigint")
    a = there.withColumn("bucket", F.explode(F.sequence(bucket(F.col("last")), bucket(F.col("first") + width))))
    b = back.select(F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.expr("slice(path, 2, size(path) - 2)").alias("between"), F.col("first").alias("b_first"), F.col("last").alias("b_last"), F.col("smallest").alias("b_smallest"), bucket(F.col("first")).alias("slot"))
    meets = (F.col("end") == F.col("b_start")) & (F.col("start") == F.col("b_end")) & (F.col("bucket") == F.col("slot")) & (F.col("b_first") > F.col("last")) & (F.col("b_last") <= F.col("first") + width)
    found = a.join(b, meets).filter(~F.arrays_overlap("path", "between"))
    return found.select(F.concat("path", "between").alias("path"), F.lit(hops).alias("hops"), F.timestamp_add("SECOND", F.col("b_last"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias("closed_ts"), F.least("smallest", "b_smallest").alias("smallest"))


def closed_walks(edges: DataFrame, min_hops: int, max_hops: int, hours: int, row_budget: int | None = None, keep: Keep | None = None) -> DataFrame:
    """(path, hops, closed_ts, smallest) of walks over edges (src, dst, txn_ts, amount_usd) that close at their start.

    Times strictly increase and stay within `hours` of the first; no account but the start comes twice. A walk of h payments is one of h/2 (rounded up) that
    leaves its start and one of the rest that returns there: both halves come from the same table of walks of at most max_hops/2 payments and meet on start,
    end and time bucket, so what is stored grows with the root of the number of open walks of the full length. With `keep` edges that no closed walk can use go
    first, and only half walks that meet another in time are joined whole: which do is told by a few numbers for each (facing, matched), counted and persisted when this is
    called (`keep.kept` gets the frame where there is one). With a row budget half walks of each length are stored by `keep`, if there is one, and counted, and an error stops a search that has more;
    without one the longest go from their join straight into the shuffle of `facing`, however many they are.
    """
    edges = edges.select("src", "dst", seconds(F.col("txn_ts")).alias("at"), F.col("amount_usd").alias("usd"))
    if keep:
        edges = pruned(keep("cycle_edges", edges), hours, keep)
    half = (max_hops + 1) // 2
    walks = half_walks(edges, half, hours, row_budget, keep)
    if keep:
        near = facing(walks, hours).persist()
        legs = matched(near, min_hops, max_hops, hours).persist()
        legs.count()
        near.unpersist()
        getattr(keep, "kept", []).append(legs)
        walks = retraced(legs, edges, half, hours)
    closed = [_closed(walks[(h + 1) // 2], walks[h // 2], h, hours) for h in range(max(2, min_hops), max_hops + 1)]
    return reduce(DataFrame.unionByName, closed)
