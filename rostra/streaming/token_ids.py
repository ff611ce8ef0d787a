"""A17/W05 over a stream: each token gets an id once, and keeps it.

Tokens are dealt into `buckets` by hash. A bucket's keyed state holds the ids and frequencies of its
tokens and how many it has given; id = bucket + buckets * number, so ids are distinct without any
coordination, and a restarted query goes on from its checkpoint. Every micro-batch writes only the
tokens that it touched, to a folder of its own number; writing it again gives the same rows. A pointer file
then names the last complete batch: readers never see half a batch, and a crash between the two steps
leaves the table as it was.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import token_stream

BUCKETS = 64
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "token string, token_id long, tf long"


class TokenIds(StatefulProcessor):
    """State of a bucket: token -> (id, frequency), and the number of ids given."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "token string", "token_id long, tf long")
        self.given = handle.getValueState("given", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for part in rows:
            counts.update(part["token"])
        n = self.given.get()[0] if self.given.exists() else 0
        out = []
        for token in sorted(counts):  # in token order, so that a batch that is run again gives the same ids
            if self.known.containsKey((token,)):
                token_id, tf = self.known.getValue((token,))
            else:
                token_id, tf, n = key[0] + self.buckets * n, 0, n + 1
            tf += counts[token]
            self.known.updateValue((token,), (token_id, tf))
            out.append((token, token_id, tf))
        self.given.update((n,))
        yield pd.DataFrame(out, columns=["token", "token_id", "tf"])

    def close(self) -> None:
        pass


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


def _publish(sink: str, epoch: int) -> None:
    fs, base = _fs(sink)
    with fs.open_output_stream(f"{base}/_next", compression=None) as out:
        out.write(str(epoch).encode())
    fs.move(f"{base}/_next", f"{base}/_current")


def published(sink: str) -> int | None:
    """The number of the last complete batch."""
    fs, base = _fs(sink)
    if fs.get_file_info(f"{base}/_current").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{base}/_current", compression=None) as f:
        return int(f.read().decode())


def token_id_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, available_now: bool = True,
                    max_files_per_trigger: int | None = None, buckets: int = BUCKETS):
    """Starts the query. The session must keep state in RocksDB (`STATE_STORE`); it is set here."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    tokens = token_stream(spark, source, max_files_per_trigger)
    keyed = tokens.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    ids = keyed.groupBy("bucket").transformWithStateInPandas(TokenIds(buckets), _OUT, "Update", "None")

    def write(batch: DataFrame, epoch: int) -> None:
        done = published(sink)
        if done is not None and epoch <= done:
            return  # a batch that is run again after its rows were published
        batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch:09d}")
        _publish(sink, epoch)

    writer = ids.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def read_epochs(spark: SparkSession, sink: str) -> DataFrame:
    """(epoch, token, token_id, tf): what each complete batch wrote."""
    last = published(sink)
    if last is None:
        return spark.createDataFrame([], f"epoch int, {_OUT}")
    rows = spark.read.option("basePath", sink).schema(f"{_OUT}, epoch int").parquet(f"{sink}/epoch=*")
    return rows.where(F.col("epoch") <= last).select("epoch", "token", "token_id", "tf")


def read_token_ids(spark: SparkSession, sink: str) -> DataFrame:
    """(token, token_id, tf) as of the last complete batch."""
    newest = Window.partitionBy("token").orderBy(F.desc("epoch"))
    return (read_epochs(spark, sink).withColumn("_k", F.row_number().over(newest)).where("_k = 1")
            .select("token", "token_id", "tf"))
