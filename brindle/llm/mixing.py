"""Mixing sources to target weights by capped water-filling, in DataFrame functions alone.

Sources weigh 1, 2, 3, repeating, in code-point order (null last); together they share the words of
all documents. A source's target stops at MAX_EPOCHS times its own words, and what is over is
reshared by weight among the rest until none is above. In closed form, with sources ordered by
cap / weight, the first k are at their cap and the others get level * weight, where level is the
rest of the words over the rest of the weights.

A target is whole repetitions of every document and a fraction of one more. Which documents take
part in that fraction is seeded: documents are ordered by a hash of their id, and the source's cut
is the last place where the running sum of words stays within what is wanted; the one later document
whose size is nearest to the remaining gap is taken too, if that narrows it. The running sums are
found by three refinements of hash ranges (4096 ranges each), so no window holds a source's rows.

Cases: null text has no words and is taken never; null sources form one source of their own, last;
sources without words have target 0; rows with the same doc_id share one hash and are taken
together; an empty table gives no rows; columns beyond doc_id, text and source pass through mix()
under their own names, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import stored

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 17
WORD = "[^\\x20\\x09-\\x0D]+"
#: Sources up to here are joined by broadcast (a row is some 100 bytes); beyond it the join is dealt by key.
BROADCAST_SOURCES = 50_000
_BITS, _LEVELS = 12, 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ticket(doc_id: Column, seed: int) -> Column:
    """Seeded place of a document in 0 .. 2^36 - 1."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 64 - _BITS * _LEVELS)


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple = WEIGHTS) -> DataFrame:
    """sources (source, source_size): adds weight and target. One row per source, so its windows are small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("weight", w).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    below = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = below.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest_words = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    rest_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    levels = ranked.withColumn("lvl", rest_words / rest_weight).withColumn("place", F.row_number().over(below))
    # the level is the first one that its own source's cap isn't below
    level = F.min(F.when(F.col("lvl") * F.col("weight") <= F.col("cap"), F.struct("place", "lvl"))).over(every)["lvl"]
    return levels.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))).select("source", "source_size", "weight", "target")


def plan(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple = WEIGHTS) -> DataFrame:
    """sizes (source, size, ticket): per source its size, target, whole repetitions and the last ticket of the fraction (cut)."""
    by_range = F.shiftright("ticket", _BITS * (_LEVELS - 1))
    hist = stored(sizes.groupBy("source", by_range.alias("r")).agg(F.sum("size").alias("size")), "mix-hist")
    filled = stored(water_fill(hist.groupBy("source").agg(F.sum("size").alias("source_size")), max_epochs, weights), "mix-sources")
    rep = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rep + F.lit(1e-9)).cast("long")
    goal = filled.select("source", "source_size", "weight", "target", whole.alias("whole"), F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size")).alias("want"))
    goal = goal.withColumn("prefix", F.lit(0).cast("long")).withColumn("got", F.lit(0).cast("long"))
    for level in range(_LEVELS):
        if level:
            width = _BITS * (_LEVELS - 1 - level)
            inside = _join_sources(sizes, goal.select("source", "prefix"))
            hist = inside.where(F.shiftright("ticket", width + _BITS) == F.col("prefix")).groupBy("source", F.shiftright("ticket", width).alias("r")).agg(F.sum("size").alias("size"))
        run = Window.partitionBy("h.source").orderBy("h.r")
        steps = hist.alias("h").join(goal.alias("g"), _same(F.col("h.source"), F.col("g.source")))
        steps = steps.select("g.*", F.col("h.r").alias("r"), F.col("h.size").alias("size"), (F.col("g.got") + F.sum("h.size").over(run)).alias("upto"))
        # of each source: the last range that stays wholly below what is wanted, and the first that passes it
        pick = steps.groupBy("source", "source_size", "weight", "target", "whole", "want").agg(
            F.max(F.when(F.col("upto") <= F.col("want"), F.col("upto"))).alias("full"),
            F.min("got").alias("had"),
            F.min(F.when(F.col("upto") > F.col("want"), F.col("r"))).alias("over_r"),
            F.min(F.when(F.col("upto") > F.col("want"), F.col("upto"))).alias("over"),
            F.max("r").alias("last_r"),
        )
        got = F.coalesce("full", "had")
        if level < _LEVELS - 1:
            goal = pick.select("source", "source_size", "weight", "target", "whole", "want", F.coalesce("over_r", F.col("last_r") + 1).alias("prefix"), got.alias("got"))
            goal = stored(goal, "mix-goal")
        else:
            last = F.when(F.col("over_r").isNull(), F.col("last_r")).otherwise(F.col("over_r") - 1)
            goal = pick.select("source", "source_size", "weight", "target", "whole", "want", got.alias("got"), last.alias("cut"))
        if level == 0:
            done = None
        if level < _LEVELS - 1:
            # sources whose fraction takes in every range need no refinement: their next prefix lies past the last range
            ended = goal.join(hist.groupBy("source").agg(F.max("r").alias("top")), _same(goal["source"], hist["source"])).where(F.col("prefix") > F.col("top")).select(goal["source"], "source_size", "weight", "target", "whole", "want", "got", (F.shiftleft(F.col("prefix"), _BITS * (_LEVELS - 1 - level)) - 1).alias("cut"))
            done = ended if done is None else done.unionByName(ended)
    goal = stored(goal.unionByName(done), "mix-cuts")
    # what is still wanted then goes to the one later document whose size is nearest to it
    gap = F.col("want") - F.col("got")
    later = _join_sources(sizes, goal.select("source", "want", "got", "cut")).where((F.col("ticket") > F.col("cut")) & (F.abs(gap - F.col("size")) < gap))
    fill = later.groupBy("source").agg(F.min(F.struct(F.abs(gap - F.col("size")).alias("miss"), "ticket")).alias("best")).select(F.col("source").alias("source_key"), F.col("best.ticket").alias("filler"))
    return stored(goal.join(fill, _same(goal["source"], fill["source_key"]), "left").drop("source_key"), "mix-plan")


def _join_sources(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Join on source; by broadcast behind a count of the sources, else dealt by key and a salt."""
    small = sources.withColumnRenamed("source", "source_key")
    if small.count() <= BROADCAST_SOURCES:
        return df.join(F.broadcast(small), _same(df["source"], F.col("source_key"))).drop("source_key")
    salts = 16
    many = small.withColumn("salt_key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn("salt", F.pmod(F.col("ticket"), F.lit(salts)).cast("int"))
    return salted.join(many, _same(salted["source"], F.col("source_key")) & (F.col("salt") == F.col("salt_key"))).drop("source_key", "salt", "salt_key")


def allocate(docs: DataFrame, seed: int = SEED, max_epochs: int = MAX_EPOCHS, weights: tuple = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), repeats and taken (size * repeats)."""
    sized = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), words(docs["text"]).alias("size"))
    sizes = stored(sized.withColumn("ticket", _ticket(F.col("doc_id"), seed)), "mix-sizes")
    return _repeats(sizes, plan(sizes, max_epochs, weights)).select("doc_id", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def _repeats(df: DataFrame, goals: DataFrame) -> DataFrame:
    joined = _join_sources(df, goals.select("source", "source_size", "target", "whole", "cut", "filler"))
    taking = (F.col("ticket") <= F.col("cut")) | F.coalesce(F.col("ticket") == F.col("filler"), F.lit(False))
    return joined.withColumn("repeats", F.when(F.col("size") > 0, F.col("whole") + taking.cast("long")).otherwise(F.lit(0).cast("long")))


def mix(docs: DataFrame, seed: int = SEED, max_epochs: int = MAX_EPOCHS, weights: tuple = WEIGHTS) -> DataFrame:
    """The mixed corpus: each document's row as often as the mix takes it, all columns as they were."""
    sizes = stored(docs.select(docs["source"].alias("source"), words(docs["text"]).alias("size"), _ticket(docs["doc_id"], seed).alias("ticket")), "mix-sizes")
    names = docs.columns
    held = docs.select(F.struct(*[docs[c] for c in names]).alias("doc"), docs["source"].alias("source"), words(docs["text"]).alias("size"), _ticket(docs["doc_id"], seed).alias("ticket"))
    taken = _repeats(held, plan(sizes, max_epochs, weights)).where(F.col("repeats") > 0)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select(*[F.col("doc")[c].alias(c) for c in names])
