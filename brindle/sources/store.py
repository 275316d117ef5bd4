"""Several tables under one pointer, changed together and read as they lie: new rows and tombstones are written beside the old ones and merged on reading.

A table is a list of layers, each a folder of Parquet files: whole rows, then changes. An upsert or a
delete writes its own rows only; a reader takes rows of earlier layers whose keys no later layer has.
compact() folds the changes into new whole rows, expire() deletes what no kept version names. All
tables of a store have one numbered pointer file, so a commit to several of them is seen as a whole or
not at all, and a writer that fails leaves layers that nothing points to. Writers are optimistic:
of two that began at one version, the second to finish fails and may begin again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.operators.index import last_by_key
from brindle.sources import files

#: Buckets of a table that is read by one column's values; the first write fixes them.
BUCKETS = 64
_GONE, _BUCKET, _LAYER = "_gone", "_bucket", "_layer"


class Conflict(RuntimeError):
    """Another writer was faster; what this one wrote is not pointed to."""


class Store:
    """Tables below root, a folder or URI that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def head(self, version: int | None = None) -> dict:
        """What a pointer says: version, tables by name, marks of streams. Without pointers: version 0 and no tables."""
        found = files.pointers(self.spark, self.root) if version is None else [version]
        if not found:
            return {"version": 0, "tables": {}, "marks": {}}
        told = json.loads(files.text(self.spark, f"{self.root}/CURRENT-{found[0]}"))
        return told if "tables" in told else {"version": found[0], "tables": {}, "marks": {}}  # a table that was swapped

    def tables(self) -> list[str]:
        return sorted(self.head()["tables"])

    def read(self, name: str, scope: DataFrame | None = None, version: int | None = None, exact: bool = True) -> DataFrame | None:
        """The rows of a table, or None where there is no such table.

        scope, rows of the column that the table is bucketed by, asks for the rows with these values: only
        the buckets that can hold them are opened, whatever their number (their bucket numbers, of which
        there are few, are what the driver sees). If it need not be exact, other rows of these buckets come along.
        """
        spec = self.head(version)["tables"].get(name)
        if spec is None:
            return None
        wanted = None
        if scope is not None and spec["by"]:
            scope = scope.select(spec["by"]).distinct()
            wanted = [r[0] for r in scope.select(_bucket(F.col(spec["by"]), spec["buckets"])).distinct().collect()]
        keys = spec["keys"]
        whole = [self._layer(x, spec, wanted) for x in spec["layers"] if not x["changes"]]
        changes = [self._layer(x, spec, wanted).withColumn(_LAYER, F.lit(i)) for i, x in enumerate(spec["layers"]) if x["changes"]]
        rows = reduce(_together, whole) if whole else None
        if changes:
            last = reduce(_together, changes)
            if len(changes) > 1:
                newest = Window.partitionBy(*keys).orderBy(F.desc(_LAYER))
                last = last.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")
            fresh = last.where(~F.col(_GONE)).drop(_GONE, _LAYER)
            rows = fresh if rows is None else _together(rows.join(last.select(*keys), keys, "left_anti"), fresh)
        if scope is not None and spec["by"]:
            rows = rows.join(scope, spec["by"], "left_semi") if exact else rows
        elif scope is not None:
            raise ValueError(f"{name} is not bucketed")
        return rows.select(*[c for c in rows.columns if c != _BUCKET])

    def _layer(self, layer: dict, spec: dict, wanted: list[int] | None) -> DataFrame:
        rows = self.spark.read.schema(StructType.fromJson(layer["schema"])).parquet(f"{self.root}/{layer['path']}")
        if not spec["by"]:
            return rows
        return rows if wanted is None else rows.where(F.col(_BUCKET).isin(wanted))

    @contextmanager
    def commit(self, mark: tuple[str, int] | None = None) -> Iterator[Change]:
        """Changes to any tables, pointed to together at the end; if the body raises, nothing has changed. mark (stream, batch) is remembered: see seen."""
        change = Change(self, self.head())
        yield change
        if mark is not None:
            change.state["marks"][mark[0]] = mark[1]
        change.publish()

    def seen(self, stream: str, batch: int) -> bool:
        """Whether a batch of a stream has been committed: one that is replayed has nothing to add."""
        return self.head()["marks"].get(stream, -1) >= batch

    def compact(self, *names: str, share: float = 0.0, most: int = 16) -> list[str]:
        """Fold the layers of tables into one of whole rows, where the changes are more than a share of the whole rows or there are more than `most` layers. Returns the tables' names."""
        state = self.head()
        done = []
        for name in names or sorted(state["tables"]):
            spec = state["tables"][name]
            changed = sum(x["rows"] for x in spec["layers"] if x["changes"])
            whole = sum(x["rows"] for x in spec["layers"] if not x["changes"])
            if changed > share * whole or len(spec["layers"]) > most:
                with self.commit() as c:
                    c.replace(name, self.read(name), spec["keys"], spec["by"], spec["buckets"])
                done.append(name)
        return done

    @contextmanager
    def pinned(self) -> Iterator[int]:
        """A version that expire() leaves alone while the body runs."""
        version = self.head()["version"]
        pin = f"{self.root}/PIN-{version}-{uuid.uuid4().hex}"
        files.put(self.spark, pin, "")
        try:
            yield version
        finally:
            files.delete(self.spark, pin)

    def expire(self, keep: int = 2, hours: float = 24.0) -> int:
        """Delete pointers but for the newest `keep` and pinned ones, and layers that none of these names and that are older than `hours` (a writer may still be at work on younger ones). Returns how many layers went."""
        found = files.pointers(self.spark, self.root)
        pins = {int(n.split("-")[1]) for n in files.names(self.spark, self.root) if n.startswith("PIN-")}
        stay = [v for i, v in enumerate(found) if i < max(1, keep) or v in pins]
        used = {x["path"] for v in stay for t in self.head(v)["tables"].values() for x in t["layers"]}
        for v in found:
            if v not in stay:
                files.delete(self.spark, f"{self.root}/CURRENT-{v}")
        before, gone = time.time() - 3600 * hours, 0
        for name in files.names(self.spark, self.root, folders=True):
            for layer, at in files.times(self.spark, f"{self.root}/{name}").items():
                if layer.startswith("l-") and f"{name}/{layer}" not in used and at <= before:
                    files.delete(self.spark, f"{self.root}/{name}/{layer}")
                    gone += 1
        return gone


class Change:
    """What one commit writes. Each method writes at once and returns how many rows, counted in the pass that writes them."""

    def __init__(self, store: Store, state: dict):
        self.store, self.state, self.base = store, state, state["version"]
        self.counts: dict[str, int] = {}
        self.last: dict[str, dict] = {}

    def replace(self, name: str, rows: DataFrame, keys: list[str] | tuple = (), by: str | None = None, buckets: int = BUCKETS) -> int:
        """A table's rows anew; with by, dealt into buckets of that column's hash."""
        self.state["tables"][name] = {"keys": list(keys), "by": by, "buckets": buckets, "layers": []}
        return self._write(name, rows, False)

    def append(self, name: str, rows: DataFrame, by: str | None = None, buckets: int = BUCKETS) -> int:
        """More rows of a table without keys."""
        self._table(name, [], by, buckets)
        return self._write(name, rows, False)

    def upsert(self, name: str, rows: DataFrame, keys: list[str], order: str | None = None, by: str | None = None, buckets: int = BUCKETS, unique: bool = False) -> int:
        """Rows in place of those with their keys; of rows that share keys one counts (see last_by_key), unless they are unique. by must follow from the keys; rows with a null key never replace each other."""
        spec = self._table(name, keys, by, buckets)
        once = rows if unique else last_by_key(rows, spec["keys"], order)
        changes = bool(spec["layers"])
        return self._write(name, once.withColumn(_GONE, F.lit(False)) if changes else once, changes)

    def delete(self, name: str, keys: DataFrame) -> int:
        """Tombstones for keys (with the column that the table is bucketed by); returns how many keys, held or not. Ask with a join where it matters."""
        spec = self.state["tables"][name]
        columns = list(dict.fromkeys([*spec["keys"], *([spec["by"]] if spec["by"] else [])]))
        return self._write(name, keys.select(*columns).distinct().withColumn(_GONE, F.lit(True)), True)

    def written(self, name: str) -> DataFrame:
        """The rows that this commit wrote last to a table, from disk; tombstones are none of them."""
        spec = self.state["tables"][name]
        rows = self.store._layer(self.last[name], spec, None)
        rows = rows.where(~F.col(_GONE)).drop(_GONE) if _GONE in rows.columns else rows
        return rows.drop(_BUCKET)

    def _table(self, name: str, keys: list[str], by: str | None, buckets: int) -> dict:
        return self.state["tables"].setdefault(name, {"keys": list(keys), "by": by, "buckets": buckets, "layers": []})

    def _write(self, name: str, rows: DataFrame, changes: bool) -> int:
        spec = self.state["tables"][name]
        seen = Observation()
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        path = f"{name}/l-{uuid.uuid4().hex}"
        out = rows
        if spec["by"]:
            # a bucket's rows in few files, and no task with much more than its share: adaptive execution cuts and joins
            out = rows.withColumn(_BUCKET, _bucket(F.col(spec["by"]), spec["buckets"])).hint("rebalance", F.col(_BUCKET))
        writer = out.write.partitionBy(_BUCKET) if spec["by"] else out.write
        writer.parquet(f"{self.store.root}/{path}")
        n = int(seen.get["rows"])
        self.last[name] = {"path": path, "changes": changes, "rows": n, "schema": json.loads(rows.schema.json())}
        if n or not spec["layers"]:
            spec["layers"].append(self.last[name])
        self.counts[name] = self.counts.get(name, 0) + n
        return n

    def publish(self) -> None:
        self.state["version"] = self.base + 1
        self.state["made"] = time.time()
        if not files.put_new(self.store.spark, f"{self.store.root}/CURRENT-{self.state['version']}", json.dumps(self.state)):
            raise Conflict(f"{self.store.root}: another writer made version {self.state['version']} first")


def _bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(_BUCKET)


def _together(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)
