"""An index kept up to date from a stream of records.

Every micro-batch is indexed on its own and stored under its batch id, which
overwrites what a failed attempt of the same batch left: each record counts
once.  Reading merges the parts; ``compact`` folds them into one.  Counts per
flag and block need no watermark: late records add to their block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import SCHEMA, build, from_counts
from ..plans.catalog import _path


class StreamIndex:
    """Parts of an index below one folder."""

    def __init__(self, spark: SparkSession, root: str, every: int = 256):
        """``every`` so many batches the parts are folded into one; 0 leaves that to ``compact``."""
        self.spark, self.root, self.every = spark, root.rstrip("/"), every

    def add(self, records: DataFrame, batch: int) -> None:
        """Index one micro-batch; the same batch again replaces itself."""
        if batch <= self._folded():
            return
        build(records).write.mode("overwrite").parquet(f"{self.root}/parts/batch={batch}")
        if self.every and batch % self.every == self.every - 1:
            self.compact()

    def start(self, records: DataFrame, checkpoint: str, **options: str) -> StreamingQuery:
        """Feed a streaming table of records."""
        writer = records.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return (writer.trigger(**options) if options else writer).start()

    def _names(self, folder: str, prefix: str) -> list[int]:
        fs, p = _path(self.spark, f"{self.root}/{folder}")
        if not fs.exists(p):
            return []
        found = (s.getPath() for s in fs.listStatus(p))
        whole = [x for x in found if x.getName().startswith(prefix) and fs.exists(_path(self.spark, f"{x}/_SUCCESS")[1])]
        return sorted(int(x.getName().removeprefix(prefix)) for x in whole)

    def _folded(self) -> int:
        """The last batch that the folded part holds."""
        return max(self._names("folded", "upto="), default=-1)

    def read(self) -> DataFrame:
        """The index of all whole batches so far."""
        upto = self._folded()
        parts = [f"{self.root}/parts/batch={b}" for b in self._names("parts", "batch=") if b > upto]
        parts += [f"{self.root}/folded/upto={upto}"] if upto >= 0 else []
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return from_counts(self.spark.read.schema(SCHEMA).parquet(*parts))  # one scan, however many batches

    def compact(self) -> None:
        """Fold all parts into one, then delete them."""
        batches, upto = self._names("parts", "batch="), self._folded()
        last = max(batches, default=-1)
        if last <= upto:
            return
        self.read().write.mode("overwrite").parquet(f"{self.root}/folded/upto={last}")
        for folder, name in [*(("parts", f"batch={b}") for b in batches if b <= last), *(("folded", f"upto={u}") for u in self._names("folded", "upto=") if u < last)]:
            fs, p = _path(self.spark, f"{self.root}/{folder}/{name}")
            fs.delete(p, True)


def running_index(records: DataFrame) -> DataFrame:
    """The same as a stateful aggregation, for output mode ``update`` or ``complete``."""
    return records.groupBy("flag", "block_id").agg(F.count("*").alias("read_count"))
