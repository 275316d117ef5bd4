"""As-of join with a tolerance: each point meets the latest event of its key that is not too old.

Events of one key at one time become one moment. A moment is valid from its time until the next moment
of its key (lead over distinct times), or until the tolerance has passed. Time is cut into buckets;
a bucket that holds more than a 10,000th of all moments (and LARGE) is cut into slices of equal width, so that
no window partition follows the size of a key. The last moment of a slice finds its follower among
the first moments of later slices and of the buckets within the tolerance. Validity intervals are
copied to the slices that they touch; points join them by equality of key, bucket and slice, and the
one interval that contains the point is its match. Slices that hold more than a 10,000th of all points
are salted: their points are dealt out and their intervals copied. The two tables of dense and of
crowded slices have MOST_LARGE rows at most each, whatever the input's size; only they are broadcast.

Cases: points and events with a null key or time never match; copies of a point's row are matched
each; extra columns of the inputs are not read; an empty side gives points without a match, or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import LARGE, MOST_LARGE, all_of, stored

DAY = 86_400_000_000
TOLERANCE = 3 * DAY
_SLICE = ["key", "bucket", "slice"]


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; times without a zone count as UTC, whatever the session's zone is."""
    t = F.col(name)
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(t.cast("timestamp"))
    seconds = F.extract(F.lit("SECOND"), t) * 1_000_000
    return F.unix_date(t.cast("date")).cast("long") * DAY + F.hour(t).cast("long") * (DAY // 24) + F.minute(t).cast("long") * (DAY // 1440) + seconds.cast("long")


def _floored(at: Column, width: int) -> Column:
    return at - F.pmod(at, F.lit(width))


def _place(at: Column, width: int) -> Column:
    """The slice of a time in its bucket."""
    return F.floor((at - F.col("bucket")) * F.coalesce(F.col("slices"), F.lit(1)) / F.lit(width)).cast("int")


def _beyond(counts: DataFrame, total: int, name: str) -> DataFrame:
    """Groups with more than a MOST_LARGE-th of total rows, and into how many parts each is split; MOST_LARGE rows at most."""
    limit = max(LARGE, total // MOST_LARGE)
    return counts.where(F.col("n") > limit).withColumn(name, F.ceil(F.col("n") / limit).cast("int")).drop("n")


def moments(events: DataFrame, width: int) -> DataFrame:
    """events (key, at, value): one row per key and time, with the greatest value, the number of events, and the bucket's start."""
    some = events.where("key is not null and at is not null")
    return some.groupBy("key", "at").agg(F.max("value").alias("value"), F.count("*").alias("n_tied")).withColumn("bucket", _floored(F.col("at"), width))


def validity(moments_: DataFrame, dense: DataFrame, tolerance: int, width: int) -> DataFrame:
    """moments (stored) with until, the first time at which they no longer hold."""
    sliced = moments_.join(F.broadcast(dense), ["key", "bucket"], "left").withColumn("slice", _place(F.col("at"), width)).drop("slices")
    firsts = sliced.groupBy(*_SLICE).agg(F.min("at").alias("first"))
    inside = firsts.withColumn("later", F.lead("first").over(Window.partitionBy("key", "bucket").orderBy("slice")))
    steps = F.explode(F.sequence(F.lit(1), F.lit((width - 1 + tolerance) // width)))
    starts = moments_.groupBy("key", "bucket").agg(F.min("at").alias("first"))
    beyond = starts.select("key", "first", "bucket", steps.alias("step")).select("key", (F.col("bucket") - F.col("step") * width).alias("bucket"), "first").groupBy("key", "bucket").agg(F.min("first").alias("beyond"))
    followers = inside.join(beyond, ["key", "bucket"], "left").select(*_SLICE, F.coalesce("later", "beyond").alias("follower"))
    following = F.coalesce(F.lead("at").over(Window.partitionBy(*_SLICE).orderBy("at")), F.col("follower"))
    end = F.coalesce(F.try_add(F.col("at"), F.lit(tolerance + 1)), F.lit(2**63 - 1))
    return sliced.join(followers, _SLICE).withColumn("until", F.least(following, end)).select("key", "at", "until", "value", "n_tied")


def _spread(intervals: DataFrame, dense: DataFrame, width: int) -> DataFrame:
    """One row per interval and slice that it touches."""
    last = F.col("until") - 1
    over = intervals.withColumn("bucket", F.explode(F.sequence(_floored(F.col("at"), width), _floored(last, width), F.lit(width).cast("long"))))
    held = over.join(F.broadcast(dense), ["key", "bucket"], "left")
    lo, hi = _place(F.greatest("at", "bucket"), width), _place(F.least(last, F.col("bucket") + width - 1), width)
    return held.withColumn("slice", F.explode(F.sequence(lo, hi))).drop("slices")


def as_of(points: DataFrame, events: DataFrame, tolerance: int = TOLERANCE, width: int = DAY) -> DataFrame:
    """points (key, at and any others; a stored table), events (key, at, value): points with match (at, value, n_tied).

    key may have any type, at is a whole number, and value orders events of one time: the greatest
    counts, and nulls are the least. match is null where there is none. Names that begin with _ are taken.
    """
    m = stored(moments(events, width), "moments")
    per_bucket = m.groupBy("key", "bucket").agg(F.count("*").alias("n"))
    dense = stored(_beyond(per_bucket, m.count(), "slices"), "dense")
    intervals = _spread(validity(m, dense, tolerance, width), dense, width)

    able = F.col("key").isNotNull() & F.col("at").isNotNull()
    placed = points.where(able).withColumn("bucket", _floored(F.col("at"), width)).join(F.broadcast(dense), ["key", "bucket"], "left").withColumn("slice", _place(F.col("at"), width)).drop("slices")
    crowded = F.broadcast(stored(_beyond(placed.groupBy(*_SLICE).agg(F.count("*").alias("n")), points.count(), "salts"), "crowded"))
    salts = F.coalesce("salts", F.lit(1))
    salted = placed.join(crowded, _SLICE, "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int"))
    copied = intervals.join(crowded, _SLICE, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    held = copied.select(*[F.col(c).alias(f"_{c}") for c in (*_SLICE, "salt", "until")], F.struct("at", "value", "n_tied").alias("match"))
    same = all_of(*[F.col(c) == F.col(f"_{c}") for c in (*_SLICE, "salt")])
    met = salted.join(held.hint("merge"), same & (F.col("at") >= F.col("match.at")) & (F.col("at") < F.col("_until")), "left")
    return met.select(*points.columns, "match").unionByName(points.where(~able), allowMissingColumns=True)


def _odd_floored(id_: Column, at: Column) -> Column:
    """at, floored to whole days where the checksum of the id's digits is odd."""
    return F.when(F.crc32(id_.cast("string")) % 2 == 1, _floored(at, DAY)).otherwise(at)


def click_points(clicks: DataFrame) -> DataFrame:
    """One point per click_id: key, at. Of rows that share one, those with a client and a time go first, then the earliest, then the smallest client; rows without click_id are left out."""
    rows = clicks.select(F.col("click_id").cast("long").alias("click_id"), F.col("client_id").cast("long").alias("key"), micros(clicks, "ts").alias("raw"))
    rows = rows.where("click_id is not null").select("click_id", F.struct((F.col("key").isNull() | F.col("raw").isNull()).alias("lacks"), F.col("raw"), F.col("key")).alias("c"))
    once = rows.groupBy("click_id").agg(F.min("c").alias("c"))
    return once.select("click_id", F.col("c.key").alias("key"), _odd_floored(F.col("click_id"), F.col("c.raw")).alias("at"))


def order_events(sales: DataFrame) -> DataFrame:
    """Every sale as an order, and its twin where there is one: key, at, value (priority, then smaller sale_id, then larger total)."""
    cents = F.floor(F.lit(100) * F.col("total") + 0.5)
    finite = F.col("total").isNotNull() & ~F.isnan("total") & (F.abs("total") < 9e16)
    s = sales.select(F.col("client_id").cast("long").alias("key"), micros(sales, "sold_at").alias("raw"), F.col("sale_id").cast("long").alias("sale_id"), F.col("priority").cast("long").alias("priority"), F.when(finite, cents).cast("long").alias("cents"))
    one = F.struct("priority", "sale_id")
    two = F.struct((6 - F.col("priority")).alias("priority"), (-1 - F.col("sale_id")).alias("sale_id"))
    twin = F.coalesce(F.crc32(F.col("sale_id").cast("string")) % 3 != 0, F.lit(False))
    both = s.select("key", _odd_floored(F.col("sale_id"), F.col("raw")).alias("at"), "cents", F.explode(F.when(twin, F.array(one, two)).otherwise(F.array(one))).alias("o"))
    return both.select("key", "at", F.struct(F.col("o.priority").alias("priority"), F.bitwise_not("o.sale_id").alias("reverse_id"), "cents").alias("value"))


def last_orders(clicks: DataFrame, sales: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """The order that each click follows: click_id, client_id, ts_us, sale_id, lag_us, total_cents, n_tied (0 and nulls where there is none)."""
    found = as_of(stored(click_points(clicks), "points"), order_events(sales), tolerance)
    return found.select(
        "click_id", F.col("key").alias("client_id"), F.col("at").alias("ts_us"), F.bitwise_not("match.value.reverse_id").alias("sale_id"),
        (F.col("at") - F.col("match.at")).alias("lag_us"), F.col("match.value.cents").alias("total_cents"), F.coalesce("match.n_tied", F.lit(0)).cast("long").alias("n_tied"),
    )
