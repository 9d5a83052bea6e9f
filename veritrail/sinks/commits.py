"""Tables that several runs append to: lots are written aside and count once a numbered commit names them.

    {path}/data/{name}/      rows of a lot, whether or not anything counts them
    {path}/commits/{n}/      the n-th commit: a file that holds the name of its lot

A commit is a folder renamed into place, so it is there whole or not at all, and of two runs that would make the same number
one is refused. It then looks at what the other has committed, leaves out of its own lot the keys that are there
now, and tries the next number. So runs side by side, retries and crashes at any step neither lose nor double a key. The
file system's rename must be atomic, as HDFS's and POSIX's are; plain object stores' are not.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Committed:
    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for part in ("data", "commits"):
            self._fs.mkdirs(self._at(f"{self.path}/{part}"))

    def version(self) -> int:
        """The number of the last commit; 0 before any."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/commits"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def read(self, after: int = 0, upto: int | None = None) -> DataFrame | None:
        """Rows of the commits after the one numbered `after`, up to `upto` (default: the last); None without any."""
        upto = self.version() if upto is None else upto
        if upto <= after:
            return None
        lots = self.spark.read.schema("lot string").json([f"{self.path}/commits/{n:012d}" for n in range(after + 1, upto + 1)])
        return self.spark.read.parquet(*[f"{self.path}/data/{r['lot']}" for r in lots.collect()])  # a row a commit

    def write_lot(self, rows: DataFrame) -> str:
        lot = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{lot}")
        return lot

    def append(self, rows: DataFrame, seen: int | None = None) -> int:
        """Commits rows, which were made from the table as of commit `seen` (default: as it is now); the number of the commit. Keys that
        others have committed since are left out, whatever their rows; repeated keys within rows stay."""
        seen = self.version() if seen is None else seen
        lot = self.write_lot(rows)
        while True:
            now = self.version()
            if now > seen:
                mine = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{lot}")
                fresh = self.write_lot(mine.join(self.read(seen, now).select(*self.keys).distinct(), self.keys, "left_anti"))
                self._drop(f"{self.path}/data/{lot}")
                lot, seen = fresh, now
            if self._commit(seen + 1, lot):
                return seen + 1

    def _commit(self, number: int, lot: str) -> bool:
        """Puts a commit in place; False if the number was taken."""
        aside, target = f"{self.path}/data/commit-{uuid.uuid4().hex}", f"{self.path}/commits/{number:012d}"
        self.spark.createDataFrame([(lot,)], "lot string").coalesce(1).write.json(aside)
        if not self._fs.exists(self._at(target)) and self._fs.rename(self._at(aside), self._at(target)):
            inner = f"{target}/{aside.rsplit('/', 1)[-1]}"  # where some file systems move what finds its target there
            if not self._fs.exists(self._at(inner)):
                return True
            aside = inner
        self._drop(aside)
        return False

    def _drop(self, path: str) -> None:
        self._fs.delete(self._at(path), True)

    def clean(self) -> int:
        """Deletes lots that no commit names, as crashed runs leave them; for when no run is at work. How many they were."""
        n = self.version()
        named = {r["lot"] for r in self.spark.read.schema("lot string").json([f"{self.path}/commits/{k:012d}" for k in range(1, n + 1)]).collect()} if n else set()
        lost = [s.getPath() for s in self._fs.listStatus(self._at(f"{self.path}/data")) if s.getPath().getName() not in named]
        for p in lost:
            self._fs.delete(p, True)
        return len(lost)
