"""A table that grows by one folder per micro-batch and stays small in number of folders.

Folders are merged like the levels of a log-structured tree: ``fan_in`` folders
of a level become one of the next, so a table of n batches has at most
``fan_in * log(n)`` folders and each row is rewritten ``log(n)`` times. Which
folders are in force, and the last batch they hold, is said by the manifest with the highest
number: one small file, put in place by a rename. Whatever a crash leaves
behind is named by no manifest and is no part of the table; a batch that is
written again after its commit changes nothing.

Folders that a commit replaces stay for one more commit, for those who have just read the
manifest before it. One writer at a time: a second one fails to place its manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAN_IN = 8


class BatchStore:
    """``merge`` maps the union of some folders to the rows that take their place."""

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame] = lambda df: df, fan_in: int = FAN_IN):
        self.spark, self.path, self.merge, self.fan_in = spark, path, merge, fan_in
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._files = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def last_batch(self) -> int:
        """The last batch that is part of the table, -1 if there is none."""
        return self._manifest()[1]["last"]

    def put(self, batch: int, df: DataFrame) -> None:
        """Adds the rows of a batch, unless they are there already; then they are computed for the sake of the state only."""
        number, manifest = self._manifest()
        if batch <= manifest["last"]:
            df.write.format("noop").mode("overwrite").save()
            return
        folder = self._write(df)
        first, *rest = manifest["levels"] or [[]]
        self._commit(number + 1, {"last": batch, "levels": [[*first, folder], *rest], "latest": folder})

    def latest(self) -> DataFrame:
        """Rows of the last batch, as long as ``tidy`` has not been called since."""
        return self._read([self._manifest()[1]["latest"]])

    def tidy(self) -> None:
        """Merges every level that is full."""
        number, manifest = self._manifest()
        levels = [list(folders) for folders in manifest["levels"]]
        for level, folders in enumerate(levels):
            if len(folders) >= self.fan_in:
                merged = self._write(self.merge(self._read(folders)))
                folders.clear()
                if level + 1 == len(levels):
                    levels.append([])
                levels[level + 1].append(merged)
        if levels != manifest["levels"]:
            self._commit(number + 1, {**manifest, "levels": levels})
            self._sweep()

    def replace(self, batch: int, df: DataFrame) -> None:
        """The table becomes ``df``, which may be derived from it."""
        number, manifest = self._manifest()
        if batch > manifest["last"]:
            folder = self._write(df)
            self._commit(number + 1, {"last": batch, "levels": [[folder]], "latest": folder})
            self._sweep()

    def read(self) -> DataFrame | None:
        """All rows; None before the first batch."""
        folders = self.folders()
        return self._read(folders) if folders else None

    def folders(self) -> list[str]:
        return [f for level in self._manifest()[1]["levels"] for f in level]

    def _write(self, df: DataFrame) -> str:
        folder = f"data/{uuid.uuid4()}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{folder}" for folder in folders])

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._files.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(folder)]
        return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))

    def _manifest(self, back: int = 0) -> tuple[int, dict]:
        numbers = self._manifests()
        if len(numbers) <= back:
            return 0, {"last": -1, "levels": []}
        number = numbers[-1 - back]
        stream = self._files.open(self._path(f"{self.path}/manifests/{number:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return number, json.loads(text)

    def _commit(self, number: int, manifest: dict) -> None:
        written = self._path(f"{self.path}/manifests/{uuid.uuid4()}.tmp")
        stream = self._files.create(written, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        final = self._path(f"{self.path}/manifests/{number:012d}.json")
        if self._files.exists(final) or not self._files.rename(written, final):
            self._files.delete(written, False)
            raise RuntimeError(f"another writer has committed version {number} of {self.path}")

    def _sweep(self) -> None:
        """Removes folders and manifests that neither of the last two manifests needs."""
        wanted = {f for back in (0, 1) for level in self._manifest(back)[1]["levels"] for f in level}
        data = self._path(f"{self.path}/data")
        for status in self._files.listStatus(data):
            if f"data/{status.getPath().getName()}" not in wanted:
                self._files.delete(status.getPath(), True)
        for number in self._manifests()[:-2]:
            self._files.delete(self._path(f"{self.path}/manifests/{number:012d}.json"), False)
