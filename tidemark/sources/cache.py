"""Results kept for a while: a table per key in the shared folder, with the time at which it expires."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .written import shared_folder

#: What a read or a write of a table can raise.
FAILURES = (PySparkException, Py4JError)


class ResultCache:
    """Read-through cache. Entries are written once and never changed; the newest that has not expired counts.

    A key is any text. What cannot be read is made anew, and what cannot be stored is returned as made: the cache
    never stands between a caller and the result. ``purge`` deletes what has expired.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, seconds: float = 300.0) -> None:
        self.spark, self.folder, self.seconds = spark, folder or f"{shared_folder(spark)}/cache", seconds

    def _home(self, key: str) -> str:
        return f"{self.folder}/{hashlib.sha256(key.encode()).hexdigest()}"

    def _fs(self, path: str):  # noqa: ANN202
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _entries(self, home: str) -> list[int]:
        """Times of expiry, in milliseconds, of what has been written whole."""
        fs, where = self._fs(home)
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        done = [n for n in names if n.isdigit() and fs.exists(self._fs(f"{home}/{n}/_SUCCESS")[1])]
        return sorted(map(int, done), reverse=True)

    def set(self, key: str, df: DataFrame, seconds: float | None = None) -> DataFrame:
        """Store a result and return it as stored."""
        until = int((time.time() + (self.seconds if seconds is None else seconds)) * 1000)
        path = f"{self._home(key)}/{until}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def get(self, key: str, make: Callable[[], DataFrame] | None = None, seconds: float | None = None) -> DataFrame | None:
        """The stored result; if there is none that counts, the one that ``make`` gives, which is then stored; None without both."""
        home, now = self._home(key), time.time() * 1000
        try:
            kept = [e for e in self._entries(home) if e > now]
            if kept:
                return self.spark.read.parquet(f"{home}/{kept[0]}")
        except FAILURES:
            pass
        if make is None:
            return None
        df = make()
        try:
            return self.set(key, df, seconds)
        except FAILURES:
            return df

    def forget(self, key: str) -> None:
        fs, where = self._fs(self._home(key))
        fs.delete(where, True)

    def purge(self) -> int:
        """Delete entries that have expired; how many there were."""
        fs, where = self._fs(self.folder)
        gone, now = 0, time.time() * 1000
        for home in fs.listStatus(where) if fs.exists(where) else []:
            for entry in fs.listStatus(home.getPath()):
                if entry.getPath().getName().isdigit() and int(entry.getPath().getName()) <= now:
                    gone += fs.delete(entry.getPath(), True)
        return gone
