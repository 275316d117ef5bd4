"""What the operators of this subpackage share: shared-folder tables, column safety, blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one block in block-wise comparisons; a task holds two blocks at most.
BLOCK_ROWS = 256
#: Groups of more rows may be joined by broadcast, MOST_LARGE of them at most.
LARGE = 64
MOST_LARGE = 10_000
#: Temporary folders of local applications that were given none.
_LOCAL: dict[str, str] = {}
#: Lists that gather the paths of what stored() writes, one per open written().
_GATHERING: ContextVar[tuple[list[str], ...]] = ContextVar("gathering", default=())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    # a session can't be given the setting once it runs: the folder is kept here
    return _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='brindle-')}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and outlives lost executors.

    The files go when the application ends, or once their reader is done: see written and discard.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brindle-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    for paths in _GATHERING.get():
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def written() -> Iterator[list[str]]:
    """The paths of what stored() writes inside, in order."""
    paths: list[str] = []
    before = _GATHERING.set((*_GATHERING.get(), paths))
    try:
        yield paths
    finally:
        _GATHERING.reset(before)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more: all that follows was written itself."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row: the optimizer doesn't copy it into body's lambdas."""
    return F.transform(F.array(value), body)[0]


def join_groups(df: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of df with groups, one row per key, whose column n says how many rows of df have that key.

    No key's rows meet in one task. Groups of more rows than LARGE and than a MOST_LARGE-th of total
    (the rows of df, or more) number MOST_LARGE at most, whatever the table's size: these go to every
    task by broadcast. The others are joined by key, and no key has more rows there than that limit.
    """
    limit = max(LARGE, total // MOST_LARGE)
    large = groups.where(F.col("n") > limit)
    hot = df.join(F.broadcast(large), keys)
    rest = df.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(groups.where(F.col("n") <= limit).hint("merge"), keys)
    return hot.unionByName(rest)


def with_groups(df: DataFrame, keys: list[str], total: int, *aggregates: Column, least: int = 1) -> DataFrame:
    """df with its group's size n and further aggregates beside each row; groups of fewer than least rows go. Reads df three times: pass a stored table."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"), *aggregates).where(F.col("n") >= least)
    return join_groups(df, groups, keys, total)


def blocked(df: DataFrame, keys: list[str], total: int, rows: int) -> DataFrame:
    """df with n, the size of each row's group where that is more than rows, and 1 where it isn't: only block_pairs asks for it.

    Groups of more than rows are few; those beyond a MOST_LARGE-th of all rows are broadcast, the others joined by key.
    """
    limit = max(rows, total // MOST_LARGE)
    groups = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > rows)
    out = df.join(F.broadcast(groups.where(F.col("n") > limit).withColumnRenamed("n", "n_large")), keys, "left")
    if limit > rows:
        some = groups.where(F.col("n") <= limit).withColumnRenamed("n", "n_some")
        out = out.join(some.hint("merge"), keys, "left")
    else:
        out = out.withColumn("n_some", F.lit(None).cast("long"))
    return out.withColumn("n", F.coalesce("n_large", "n_some", F.lit(1).cast("long"))).drop("n_large", "n_some")


def block_pairs(df: DataFrame, id_col: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Deal the rows of each group into blocks and copy each row to every pair of blocks it belongs to.

    df carries a column n, the size of the row's group. Adds blk (the row's own block), bi and bj
    (the pair, bi <= bj); a task that holds one (keys, bi, bj) compares block bi with block bj. No
    group is ever held whole by a task, and no pair of rows is ever a row of a table.
    """
    blocks = F.ceil(F.col("n") / F.lit(rows)).cast("int")
    dealt = df.withColumn("nb", F.greatest(F.lit(1), blocks)).withColumn("blk", F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.col("nb").cast("long")).cast("int"))
    return _paired(dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))).drop("nb", "n")


def _paired(df: DataFrame) -> DataFrame:
    return df.withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other")).drop("other")


class Stars:
    """Links within groups of rows (key, id), found in two steps.

    1. Every row is compared with its group's pivot, the smallest id: pairs() gives each such pair
       once, however many groups it is in. The work is in proportion to the rows.
    2. Rows that aren't linked with their pivot are compared with each other and with those that
       are, block by block: rest() deals them. Rows linked with one pivot are linked with each
       other already, and aren't compared again.

    Together this finds the connected components of all links within groups; a group of copies of
    one text costs one comparison per row, and only rows unlike the pivot cost more. Of groups with the
    same members (by a 128-bit hash) one is compared; large groups of one pivot that overlap are compared
    as one.
    """

    def __init__(self, members: DataFrame, name: str):
        """members: a stored table (key, id) of longs, each row once."""
        self.total = members.count()
        sums = [F.bit_xor(F.xxhash64(F.lit(k), F.col("id"))).alias(f"x{k}") for k in (1, 2)]
        groups = members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("pivot"), *sums).where("n > 1")
        groups = stored(groups.groupBy("n", "pivot", "x1", "x2").agg(F.min("key").alias("key")).select("key", "n", "pivot"), f"{name}-groups")
        pivots = join_groups(members, groups, ["key"], self.total)
        self.members = stored(pivots.where(F.col("id") != F.col("pivot")).select("key", "id", "pivot"), f"{name}-stars")

    def pairs(self, rows: int = BLOCK_ROWS) -> DataFrame:
        """(pivot, blk, head, id): per pivot, blocks of the ids to compare with it, and one row (head) for the pivot itself in each."""
        once = self.members.select("id", "pivot").distinct()
        once = stored(once, "star-pairs")
        blocks = F.ceil(F.col("n") / F.lit(rows)).cast("long")
        dealt = blocked(once, ["pivot"], self.total, rows).select("pivot", F.pmod(F.xxhash64("id", F.lit(7)), F.greatest(F.lit(1).cast("long"), blocks)).cast("int").alias("blk"), "id")
        heads = dealt.select("pivot", "blk").distinct().select("pivot", "blk", F.lit(True).alias("head"), F.col("pivot").alias("id"))
        return dealt.select("pivot", "blk", F.lit(False).alias("head"), "id").unionByName(heads)

    def rest(self, near: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
        """near: a stored table (id, pivot) of the pairs that are linked. (key, bi, bj, blk, id): what is still to be compared."""
        same = (self.members["id"] == near["id"]) & (self.members["pivot"] == near["pivot"])
        flagged = self.members.join(near.withColumn("hit", F.lit(True)).hint("merge"), same, "left").select("key", self.members["id"], self.members["pivot"], F.col("hit").isNull().alias("far"))
        flagged = stored(flagged, "star-rest")
        sizes = [F.count("*").alias("n"), F.sum(F.col("far").cast("long")).alias("n_far")]
        groups = stored(flagged.groupBy("key").agg(*sizes, F.min("pivot").alias("pivot")).where("n >= 2 and n_far >= 1"), "star-sizes")
        some = self._dealt(flagged, groups, sizes, rows)
        n_far = F.ceil(F.col("n_far") / F.lit(rows)).cast("long")
        n_near = F.ceil((F.col("n") - F.col("n_far")) / F.lit(rows)).cast("long")
        place = F.xxhash64("id", F.lit(7))
        one = F.col("n") <= rows
        blk = F.when(one, F.lit(0)).when(F.col("far"), F.pmod(place, F.col("n_f"))).otherwise(F.col("n_f") + F.pmod(place, F.greatest(F.col("n_n"), F.lit(1))))
        top = F.when(one, F.lit(0)).when(F.col("far"), F.col("n_f") + F.col("n_n") - 1).otherwise(F.col("n_f") - 1)
        dealt = some.withColumn("n_f", n_far).withColumn("n_n", n_near).withColumn("blk", blk.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), top.cast("int"))))
        return _paired(dealt).select("key", "bi", "bj", "blk", "id")

    def _dealt(self, flagged: DataFrame, groups: DataFrame, sizes: list[Column], rows: int) -> DataFrame:
        """(key, id, far, n, n_far): the rows of groups. Large groups of one pivot hold much the same rows, and are one group, each row once, where that makes fewer copies of rows."""
        shared = groups.where(F.col("n") > rows).withColumn("copies", _copies(rows))
        families = shared.groupBy("pivot").agg(F.count("*").alias("k"), F.sum("copies").alias("copies")).where("k > 1").select("pivot", "copies")
        families = stored(families, "star-families")
        alone = lambda g: join_groups(flagged.select("key", "id", "far"), g.select("key", "n", "n_far"), ["key"], self.total)
        if families.isEmpty():
            return alone(groups)
        shared = shared.join(families.select("pivot").hint("merge"), "pivot").select("key", "n")
        union = stored(join_groups(flagged, shared, ["key"], self.total).select("pivot", "id", "far").distinct(), "star-unions")
        met = union.groupBy("pivot").agg(*sizes).join(families.hint("merge"), "pivot").where(_copies(rows) < F.col("copies"))
        met = stored(met.select("pivot", "n", "n_far"), "star-met")
        own = groups.join(met.select("pivot").withColumn("met", F.lit(True)).hint("merge"), "pivot", "left").where((F.col("n") <= rows) | F.col("met").isNull())
        return alone(own).unionByName(join_groups(union, met, ["pivot"], self.total).withColumnRenamed("pivot", "key"))


def _copies(rows: int) -> Column:
    """How many rows Stars.rest makes of a group's n, n_far of which are far."""
    n, far = F.col("n"), F.col("n_far")
    n_f, n_n = F.ceil(far / F.lit(rows)), F.ceil((n - far) / F.lit(rows))
    return F.when(n <= rows, n).otherwise(far * (n_f + n_n) + (n - far) * n_f)


def grouped_batches(batches, keys: list[str], least_rows: int = 4096):
    """Re-cut an iterator of pandas frames, sorted by keys, so that no group straddles two frames."""
    import pandas as pd

    held: list = []
    size = 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        size += len(pdf)
        if size < least_rows:
            continue
        pdf = pd.concat(held, ignore_index=True) if len(held) > 1 else pdf
        last = pdf[keys].iloc[-1]
        same = (pdf[keys] == last).all(axis=1).to_numpy()
        start = len(pdf) - int(same[::-1].argmin()) if not same.all() else 0
        if start:
            yield pdf.iloc[:start].reset_index(drop=True)
        held, size = [pdf.iloc[start:]], len(pdf) - start
    if held:
        yield pd.concat(held, ignore_index=True)


def group_bounds(pdf, keys: list[str]):
    """Start and end of each run of equal keys."""
    import numpy as np

    if not len(pdf):
        return []
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(new)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)], strict=True))


class Forest:
    """Union-find over 0..n-1; what a task has linked, as one edge per row at most."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def join_matrix(self, linked) -> None:
        """linked: boolean square matrix; breadth-first over its rows."""
        import numpy as np

        left = np.ones(len(linked), bool)
        for s in range(len(linked)):
            if not left[s]:
                continue
            left[s] = False
            front = np.array([s])
            while len(front):
                near = linked[front].any(axis=0) & left
                front = np.flatnonzero(near)
                left[front] = False
                for x in front.tolist():
                    self.join(s, x)


def star_components(members: DataFrame, name: str, pairs: Callable, rest: Callable, rows: int = BLOCK_ROWS) -> DataFrame:
    """members: a stored table (key, id). Components of the links within keys' groups, as connected_components gives them.

    pairs(dealt) compares what Stars.pairs deals and gives (id, pivot) of the links; rest(dealt) does so
    for what Stars.rest deals and gives edges (a, b).
    """
    stars = Stars(members, name)
    near = stored(pairs(stars.pairs(rows)).distinct(), f"{name}-near")
    return connected_components(near.select(F.col("id").alias("a"), F.col("pivot").alias("b")).unionByName(rest(stars.rest(near, rows))))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b long): one row (node, component) per node of an edge; component is the smallest node reachable.

    Alternates large-star and small-star steps until the edges are stars. Each round is written to
    the shared folder, in place of the one before. Self-loops and repeated edges are allowed; nodes without an edge are not returned.
    """
    with written() as older:
        e = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def state() -> tuple[int, int]:
        """Edges, and nodes that keep them from being stars: those with two smaller neighbours, or with a smaller one and a larger one."""
        roles = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select(F.col("b"), F.lit(0), F.lit(1)))
        nodes = roles.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        r = nodes.agg(F.sum("up").alias("n"), F.count(F.when((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)), 1)).alias("bad")).first()
        return r["n"] or 0, r["bad"]

    n, bad = state()
    while bad:
        with written() as newer:
            # the rows of a hub never meet in one task: see join_groups
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
            starred = with_groups(both, ["u"], 2 * n, F.min("v").alias("m")).where(F.col("v") > F.col("u"))
            large = stored(starred.select(F.col("v").alias("a"), F.least("m", "u").alias("b")).where(F.col("a") != F.col("b")), "edges")
            starred = with_groups(large, ["a"], n, F.min("b").alias("m"))
            small = starred.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
            e = stored(small.where(F.col("a") != F.col("b")).distinct(), "edges")
        discard(e.sparkSession, [*older, *newer[:-1]])
        older = newer[-1:]
        n, bad = state()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
