"""The plan cache's tables as a log of versions under one folder.

A version is a file log/<number>.json, which exactly one writer can claim, and names a folder of data that was written
before it: the plans that changed, with their doors (`put`), or all of them (`write`). So a write is as large as its
changes, readers keep the version they began with, and data without a version is never read. Of the plans of one plan_id
the last version's counts, its doors included. After COMPACT_AFTER versions of changes one that holds all plans follows,
so a reader opens a bounded number of folders.

Doors are numbered from 0 in each version; what was numbered before is added when a version is claimed and read, so that
two writers' doors get different numbers. A version also says which batch of which stream it came from, and which version
that batch had read: a batch that runs again finds its own version, and answers from the one before.

A whole version has centres of its own for the index of doors, versions of changes place their doors by those that they
find: the index is extended by each write, and made anew with each whole version. Doors are written in order of home and
reach, so a search reads few parts of a file. Doors that another writer placed by other centres, or none, have no home.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import matrix
from ..operators import door_index
from ..session import settled
from . import files

PLANS = "plan_id string, query string, response string, variations array<string>, article string, created double"
DOORS = "plan_id string, kind string, text string, norm string, vec array<float>, seq bigint"
#: As they are read: beside DOORS, what the index of doors needs.
INDEXED = DOORS + ", home int, reach double, size double"
COMPACT_AFTER = 16


class PlanStore:
    """plans (PLANS) and doors (INDEXED) of the newest version, or of an earlier one."""

    def __init__(self, spark: SparkSession, path: str, compact_after: int = COMPACT_AFTER):
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), compact_after

    def last(self) -> int:
        """The newest version's number, 0 if there is none."""
        return max((int(n[:-5]) for n in files.names(self.spark, f"{self.path}/log") if n.endswith(".json")), default=0)

    def commit(self, version: int) -> dict:
        """What a version's file says; of version 0 what an empty store would say."""
        if not version:
            return {"whole": True, "data": None, "embedder": None, "seq_from": 0, "seq_to": 0, "streams": {}, "centres": None}
        return json.loads(files.read(self.spark, f"{self.path}/log/{version:012d}.json"))

    def _chain(self, version: int) -> list[tuple[int, dict]]:
        """The versions that make this one up: the last whole one and the changes since."""
        out = []
        while True:
            out.append((version, self.commit(version)))
            if out[-1][1]["whole"]:
                return out[::-1]
            version -= 1

    def read(self, version: int | None = None) -> tuple[DataFrame, DataFrame, str | None]:
        """plans, doors, name of the embedder that made the vectors."""
        chain = [(n, c) for n, c in self._chain(self.last() if version is None else version) if c["data"]]
        if not chain:
            return self.spark.createDataFrame([], PLANS), self.spark.createDataFrame([], INDEXED), None

        def part(table: str, schema: str, n: int, c: dict) -> DataFrame:
            return self.spark.read.schema(schema).parquet(f"{self.path}/data/{c['data']}/{table}").withColumn("version", F.lit(n))

        plans = [part("plans", PLANS, n, c) for n, c in chain]
        doors = [part("doors", INDEXED, n, c).withColumn("seq", F.col("seq") + F.lit(c["seq_from"])) for n, c in chain]
        strange = {n for n, c in chain if c.get("placed_by") != chain[-1][1].get("centres")}
        doors = [d.withColumn("home", F.lit(None).cast("int")) if n in strange else d for d, (n, _) in zip(doors, chain)]
        if len(chain) > 1:
            # Only the changes' ids are looked through: the whole version gives way to any of them.
            changed = reduce(DataFrame.unionByName, [p.select("plan_id", "version") for p in plans[1:]]).groupBy("plan_id").agg(F.max("version").alias("version"))
            plans, doors = ([x[0].join(changed, "plan_id", "left_anti"), reduce(DataFrame.unionByName, x[1:]).join(changed, ["plan_id", "version"], "left_semi").select(*x[0].columns)] for x in (plans, doors))
        whole = [reduce(DataFrame.unionByName, x).drop("version") for x in (plans, doors)]
        return whole[0], whole[1], chain[-1][1]["embedder"]

    def centres(self, version: int | None = None) -> np.ndarray | None:
        """The centres that the homes of that version's doors number, if it has any."""
        name = self.commit(self.last() if version is None else version).get("centres")
        return self._centres(name) if name else None

    def _centres(self, name: str) -> np.ndarray:
        return matrix(self.spark.read.parquet(f"{self.path}/centres/{name}").orderBy("number").select("vec").toPandas().vec)

    def _written(self, plans: DataFrame, doors: DataFrame, centres: str | None = None) -> dict:
        """The folder's name, one more than the greatest number of its doors, and the name of the centres that placed them: those given, or new ones."""
        name = uuid.uuid4().hex
        plans.write.parquet(f"{self.path}/data/{name}/plans")
        if centres:
            doors = door_index.homed(doors, self._centres(centres))
        else:
            doors = settled(doors, "doors")
            fitted = door_index.fit(doors)
            if fitted is not None:
                centres = name
                rows = [(n, [float(x) for x in c]) for n, c in enumerate(fitted)]
                self.spark.createDataFrame(rows, "number int, vec array<double>").coalesce(1).write.parquet(f"{self.path}/centres/{centres}")
                doors = door_index.homed(doors, fitted).repartitionByRange("home", "reach")
        placed = doors.sortWithinPartitions("home", "reach") if centres else doors
        placed.write.parquet(f"{self.path}/data/{name}/doors")
        most = self.spark.read.schema(DOORS).parquet(f"{self.path}/data/{name}/doors").agg(F.max("seq")).first()[0]
        return {"data": name, "numbers": 0 if most is None else most + 1, "placed_by": centres}

    def _claimed(self, whole: bool, written: dict, embedder: str, stream: dict | None = None, only: int | None = None) -> int | None:
        """The version that what was written became. only: this one or none."""
        while True:
            before = self.last()
            last = self.commit(before)
            if only is not None and before + 1 != only:
                return None
            if not whole and last["embedder"] not in (None, embedder):
                raise ValueError(f"the store's vectors are those of {last['embedder']}, not of {embedder}")
            first = 0 if whole else last["seq_to"]
            own = {stream["name"]: {"batch": stream["batch"], "read": stream["read"], "version": before + 1}} if stream else {}
            content = {"whole": whole, "data": written["data"], "embedder": embedder, "seq_from": first, "seq_to": max(last["seq_to"], first + written["numbers"]), "streams": last["streams"] | own}
            placed_by = written["placed_by"]
            content |= {"placed_by": placed_by, "centres": placed_by if whole else last.get("centres") or placed_by}
            if files.claim(self.spark, f"{self.path}/log/{before + 1:012d}.json", json.dumps(content)):
                return before + 1

    def write(self, plans: DataFrame, doors: DataFrame, embedder: str) -> int:
        """A version that has these plans only."""
        return self._claimed(True, self._written(plans, doors), embedder)

    def put(self, plans: DataFrame, doors: DataFrame, embedder: str, stream: dict | None = None) -> int:
        """A version in which these plans replaced those of their ids, or came new; their doors with them, seq from 0.

        stream: name, batch and read (the version that the batch was answered from).
        """
        version = self._claimed(False, self._written(plans, doors, self.commit(self.last()).get("centres")), embedder, stream)
        if len(self._chain(version)) > self.compact_after:
            self.compact(version)
        return version

    def compact(self, version: int) -> int | None:
        """All plans of this version as the next one, unless another writer takes that first."""
        plans, doors, embedder = self.read(version)
        written = self._written(plans, doors)
        made = self._claimed(True, written, embedder, only=version + 1)
        if made is None:
            files.delete(self.spark, f"{self.path}/data/{written['data']}")
            files.delete(self.spark, f"{self.path}/centres/{written['placed_by']}")
        return made

    def vacuum(self, version: int) -> None:
        """Deletes the data that neither this version nor a later one reads, and what no version names. No writer may be at work."""
        numbers = range(self._chain(version)[0][0], self.last() + 1)
        commits = [self.commit(n) for n in numbers]
        for folder, kept in (("data", {c["data"] for c in commits}), ("centres", {c.get("centres") for c in commits})):
            for name in files.names(self.spark, f"{self.path}/{folder}"):
                if name not in kept:
                    files.delete(self.spark, f"{self.path}/{folder}/{name}")

    def clear(self, embedder: str) -> int:
        return self.write(self.spark.createDataFrame([], PLANS), self.spark.createDataFrame([], DOORS), embedder)

    def batch_of(self, stream: str) -> dict | None:
        """batch, read and version of the last batch of that stream."""
        return self.commit(self.last())["streams"].get(stream)
