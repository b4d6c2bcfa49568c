"""The chunk index on disk: days are written anew on their own, and chunks and markers become visible together."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from daybook.schemas import CHUNKS, INDEX_DAYS


class ChunkStore:
    """Chunks and index_days under a folder. A commit writes the days it changes to new folders and then publishes one small file, the list of
    every day's folder: readers see the state before it or after it, and a commit that is cut off leaves only folders that nobody names.

    Of two commits from one state the second fails. Folders of earlier states stay for those who still read them, until vacuum().
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._jvm = spark._jvm
        self._fs = self._place("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _place(self, name: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The number of the published state; -1 before the first."""
        published = self._place("published")
        names = [f.getPath().getName() for f in self._fs.listStatus(published)] if self._fs.exists(published) else []
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def days(self, version: int | None = None) -> dict[str, str]:
        """The folder of every day in a published state."""
        version = self.version() if version is None else version
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/published/{version}").first()[0]) if version >= 0 else {}

    def _rows(self, name: str, schema: str, days: list[str] | None) -> DataFrame:
        schema = StructType.fromDDL(schema)
        found = {d: tag for d, tag in self.days().items() if days is None or d in days}
        folders = [f for d, tag in sorted(found.items()) if self._fs.exists(self._place(f := f"{name}/{tag}/day={d}"))]
        if not folders:
            return self.spark.createDataFrame([], schema)
        inner = StructType([f for f in schema.fields if f.name != "day"])
        # the day stands in the folder's name alone
        parts = self.spark.read.schema(inner).parquet(*[f"{self.path}/{f}" for f in folders]).withColumn("day", F.regexp_extract(F.col("_metadata.file_path"), r"/day=([^/]*)/", 1))
        return parts.select(schema.names)

    def chunks(self, days: list[str] | None = None) -> DataFrame:
        return self._rows("chunks", CHUNKS, days)

    def index_days(self, days: list[str] | None = None) -> DataFrame:
        return self._rows("index_days", INDEX_DAYS, days)

    def commit(self, chunks: DataFrame, index_days: DataFrame, days: list[str]) -> int:
        """Replaces the given days by the rows of chunks and index_days, and gives the number of the new state."""
        version, tag = self.version(), uuid.uuid4().hex
        known = self.days(version)
        for name, rows in (("chunks", chunks), ("index_days", index_days)):
            rows.repartition("day", "owner_id").sortWithinPartitions("owner_id").write.partitionBy("day").parquet(f"{self.path}/{name}/{tag}")
        self._publish(version + 1, {**{d: t for d, t in known.items() if d not in days}, **dict.fromkeys(days, tag)})
        return version + 1

    def _publish(self, version: int, days: dict[str, str]) -> None:
        staged, target = self._place(f"staged/{uuid.uuid4().hex}"), self._place(f"published/{version}")
        out = self._fs.create(staged, False)
        out.write(json.dumps(days, sort_keys=True).encode())
        out.close()
        self._fs.mkdirs(self._place("published"))
        if self._fs.exists(target) or not self._fs.rename(staged, target):
            self._fs.delete(staged, False)
            raise RuntimeError(f"state {version} of {self.path} is there already")

    def vacuum(self) -> list[str]:
        """Removes what the published state doesn't name; (folders) that went. Nobody may be reading an earlier state, or committing."""
        version = self.version()
        named, gone = set(self.days(version).values()), []
        for name in ("chunks", "index_days", "published", "staged"):
            if self._fs.exists(self._place(name)):
                for f in self._fs.listStatus(self._place(name)):
                    if f.getPath().getName() not in named | {str(version)}:
                        self._fs.delete(f.getPath(), True)
                        gone.append(f"{name}/{f.getPath().getName()}")
        return sorted(gone)
