"""A record store on shared folders: an append-only log, snapshots of it, and the table that both give together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STORE, UPDATE, DELETE = "store", "update", "delete"


def checksum(payload: Column) -> Column:
    return F.crc32(F.concat_ws("|", F.col("op"), F.col("id").cast("string"), payload).cast("binary"))


def replay(snapshot: DataFrame, log: DataFrame, upto: int) -> DataFrame:
    """id, payload of what is alive: the snapshot, and over it the log's entries (seq, op, id, payload, crc) after its position `upto`.

    The last entry of an id counts.  The log ends before its first entry whose checksum is wrong: what follows a torn entry isn't trusted."""
    log = log.where(F.col("seq") > upto)
    torn = log.where(checksum(F.col("payload")) != F.col("crc")).agg(F.min("seq").alias("torn"))
    good = log.crossJoin(F.broadcast(torn)).where(F.col("torn").isNull() | (F.col("seq") < F.col("torn")))  # the broadcast has one row
    last = good.groupBy("id").agg(F.max(F.struct("seq", "op", "payload")).alias("x")).select(F.col("id").alias("i"), F.col("x.op").alias("op"), F.col("x.payload").alias("p"))
    j = snapshot.select("id", "payload").join(last, F.col("id") == F.col("i"), "full_outer").where(F.coalesce(F.col("op") != DELETE, F.lit(True)))
    return j.select(F.coalesce("id", "i").alias("id"), F.when(F.col("op").isNotNull(), F.col("p")).otherwise(F.col("payload")).alias("payload"))


class RecordStore:
    """Records (id bigint, payload string) under a folder.  Writers append whole batches; each batch is numbered after all before it."""

    LOG, SNAP = "seq bigint, op string, id bigint, payload string, crc bigint", "id bigint, payload string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        if not self._fs.exists(self._at(kind)):
            return []
        return sorted(int(s.getPath().getName().split("-")[1]) for s in self._fs.listStatus(self._at(kind)) if self._fs.exists(self._at(f"{kind}/{s.getPath().getName()}/_SUCCESS")))

    def log(self) -> DataFrame:
        n = self._numbers("log")
        return self.spark.read.schema(self.LOG).parquet(*[f"{self.path}/log/batch-{i}" for i in n]) if n else self.spark.createDataFrame([], self.LOG)

    def snapshot(self) -> tuple[DataFrame, int]:
        """The latest snapshot and the last seq that it covers."""
        n = self._numbers("snapshot")
        return (self.spark.read.schema(self.SNAP).parquet(f"{self.path}/snapshot/at-{n[-1]}"), n[-1]) if n else (self.spark.createDataFrame([], self.SNAP), -1)

    def append(self, rows: DataFrame, op: str = STORE) -> None:
        """rows (id, payload), or ids alone to delete."""
        batch = max(self._numbers("log") + [n >> 40 for n in self._numbers("snapshot")[-1:]], default=-1) + 1
        payload = F.col("payload").cast("string") if "payload" in rows.columns else F.lit(None).cast("string")
        own = rows.select((F.lit(batch << 40) + F.monotonically_increasing_id() % (1 << 40)).alias("seq"), F.lit(op).alias("op"), F.col("id").cast("bigint").alias("id"), payload.alias("payload"))
        own.withColumn("crc", checksum(F.col("payload"))).write.parquet(f"{self.path}/log/batch-{batch}")

    def scan(self) -> DataFrame:
        snap, upto = self.snapshot()
        return replay(snap, self.log(), upto)

    def get(self, record_id: int) -> DataFrame:
        """The record of one id: the filter reaches the files' statistics."""
        snap, upto = self.snapshot()
        return replay(snap.where(F.col("id") == record_id), self.log().where(F.col("id") == record_id), upto)

    def save(self) -> int:
        """Writes a snapshot of what is alive; the log stays."""
        last = self.log().agg(F.max("seq")).first()[0]
        upto = max(last if last is not None else -1, self.snapshot()[1])
        if upto not in self._numbers("snapshot"):
            self.scan().write.parquet(f"{self.path}/snapshot/at-{upto}")
        return upto

    def compact(self) -> None:
        """A snapshot, and away with the log and the snapshots that it makes superfluous."""
        upto = self.save()
        for n in self._numbers("log"):
            self._fs.delete(self._at(f"log/batch-{n}"), True)
        for n in self._numbers("snapshot"):
            if n != upto:
                self._fs.delete(self._at(f"snapshot/at-{n}"), True)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (n, hash) that doesn't depend on the order of rows, to hold a copy against its source."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("hash"))


class Backups:
    """Copies of a table under a folder, each with its fingerprint and the largest `seq` in it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self, df: DataFrame, name: str, since: int | None = None) -> None:
        """A full copy, or with `since` the rows of a greater seq."""
        (df if since is None else df.where(F.col("seq") > since)).write.parquet(f"{self.path}/{name}/data")
        kept = self.spark.read.parquet(f"{self.path}/{name}/data")
        last = F.max("seq").cast("bigint") if "seq" in kept.columns else F.lit(None).cast("bigint")
        fingerprint(kept).crossJoin(F.broadcast(kept.agg(last.alias("seq")))).select(F.lit(name).alias("name"), "n", "hash", "seq").coalesce(1).write.parquet(f"{self.path}/{name}/manifest")  # one row

    def list(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/*/manifest")

    def verify(self, name: str) -> bool:
        want = self.spark.read.parquet(f"{self.path}/{name}/manifest").first()
        got = fingerprint(self.spark.read.parquet(f"{self.path}/{name}/data")).first()
        return (want["n"], want["hash"]) == (got["n"], got["hash"])

    def restore(self, *names: str) -> DataFrame:
        """The rows of a full copy and of those that followed it; damaged ones are refused."""
        bad = [n for n in names if not self.verify(n)]
        if bad:
            raise ValueError(f"damaged: {', '.join(bad)}")
        return self.spark.read.parquet(*[f"{self.path}/{n}/data" for n in names])


def ancestors(pointers: DataFrame, heads: DataFrame) -> DataFrame:
    """id of everything that the heads (id) reach over pointers (id, parent), themselves included.

    The pointers are squared in each round, so a history of n steps takes log n rounds."""
    from ..functions.counting import stored

    jump = stored(pointers.where("parent is not null").select("id", "parent"))
    seen = stored(heads.select("id").distinct())
    n = -1
    while (now := seen.count()) != n:  # nothing new within twice the distance: all is there
        n = now
        step = seen.join(jump.withColumnRenamed("id", "i"), F.col("id") == F.col("i")).select(F.col("parent").alias("id"))
        seen = stored(seen.unionByName(step).distinct())
        two = jump.join(jump.select(F.col("id").alias("mid"), F.col("parent").alias("far")), F.col("parent") == F.col("mid")).select("id", F.col("far").alias("parent"))
        jump = stored(two.distinct())
    return seen


class Versions:
    """Snapshots of a table with parents, branches and tags, kept as a manifest that is written anew with each change."""

    FORM = "kind string, name string, id string, parent string, branch string, at bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._p = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        self._fs = self._p("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _turns(self) -> list[int]:
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(self._p("manifest")) if self._fs.exists(self._p(f"manifest/{s.getPath().getName()}/_SUCCESS"))) if self._fs.exists(self._p("manifest")) else []

    def manifest(self) -> list[dict]:
        """Snapshots, branches and tags; as many rows as there are of these."""
        n = self._turns()
        rows = self.spark.read.schema(self.FORM).parquet(f"{self.path}/manifest/{n[-1]}").collect() if n else []
        return [r.asDict() for r in rows] or [{"kind": "branch", "name": "main", "id": None, "parent": None, "branch": None, "at": 0}, {"kind": "current", "name": "main", "id": None, "parent": None, "branch": None, "at": 0}]

    def _keep(self, rows: list[dict]) -> None:
        n = self._turns()
        self.spark.createDataFrame([tuple(r[c.split()[0]] for c in self.FORM.split(", ")) for r in rows], self.FORM).coalesce(1).write.parquet(f"{self.path}/manifest/{(n or [0])[-1] + 1}")

    def _one(self, rows, kind, name=None) -> dict | None:
        return next((r for r in rows if r["kind"] == kind and (name is None or r["name"] == name)), None)

    def create(self, df: DataFrame, message: str) -> str:
        rows = self.manifest()
        branch = self._one(rows, "current")["name"]
        head = self._one(rows, "branch", branch)
        at = max(r["at"] for r in rows) + 1
        name = f"{fingerprint(df).first()['hash'] & 0xFFFFFFFFFFFF:012x}-{at}"
        df.write.parquet(f"{self.path}/data/{name}")
        rows.append({"kind": "snapshot", "name": message, "id": name, "parent": head["id"], "branch": branch, "at": at})
        head["id"] = name
        self._keep(rows)
        return name

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/{name}")

    def branch(self, name: str) -> None:
        rows = self.manifest()
        if self._one(rows, "branch", name):
            raise ValueError(f"there is a branch {name}")
        rows.append({"kind": "branch", "name": name, "id": self._one(rows, "branch", self._one(rows, "current")["name"])["id"], "parent": None, "branch": None, "at": 0})
        self._keep(rows)

    def checkout(self, name: str) -> None:
        rows = self.manifest()
        if not self._one(rows, "branch", name):
            raise ValueError(f"no branch {name}")
        self._one(rows, "current")["name"] = name
        self._keep(rows)

    def tag(self, snapshot: str, name: str) -> None:
        rows = self.manifest()
        rows.append({"kind": "tag", "name": name, "id": snapshot, "parent": None, "branch": None, "at": 0})
        self._keep(rows)

    def history(self, most: int = 100) -> list[str]:
        """Snapshots of the current branch, newest first."""
        rows = self.manifest()
        by = {r["id"]: r for r in rows if r["kind"] == "snapshot"}
        at, out = self._one(rows, "branch", self._one(rows, "current")["name"])["id"], []
        while at in by and len(out) < most:
            out.append(at)
            at = by[at]["parent"]
        return out

    def gc(self) -> int:
        """Drops snapshots that no branch reaches and no tag names; how many."""
        rows = self.manifest()
        by = {r["id"]: r for r in rows if r["kind"] == "snapshot"}
        live = {r["id"] for r in rows if r["kind"] == "tag"}
        for r in rows:
            at = r["id"] if r["kind"] == "branch" else None
            while at in by and at is not None:
                live.add(at)
                at = by[at]["parent"]
        gone = [i for i in by if i not in live]
        self._keep([r for r in rows if r["kind"] != "snapshot" or r["id"] in live])
        for i in gone:
            self._fs.delete(self._p(f"data/{i}"), True)
        return len(gone)
