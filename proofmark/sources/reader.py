"""The reader of labels behind a port: a data source that asks it for every request and gives a typed row for every answer.

``proofmark_reader`` is a data source in Python.  Requests are a table of keys in the shared folder, dealt into buckets by a hash of the key; a
bucket is a partition, so reads are spread over the executors and a lost one repeats its buckets only.  A client is made once a
partition and asked key by key, each call within a time limit and, where the reader did not answer in time or could not be
reached, once more.  What goes wrong with one key is that key's row and nobody else's failure:

* ``read``: the answer, as JSON text in ``payload``;
* ``missing``: the reader knows nothing of the key (not asked again);
* ``timeout``, ``unavailable``: no answer in all attempts;
* ``failed``: any other error (not asked again).

``RecordedReader`` answers from recorded results, dealt into the same buckets, so that a partition opens one bucket of them.  A hosted reader is another
client under the same port.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..storage import shared_dir

FORMAT = "proofmark_reader"
READS = "key string, status string, attempts int, payload string, detail string"
_ARROW = pa.schema([("key", pa.string()), ("status", pa.string()), ("attempts", pa.int32()), ("payload", pa.string()), ("detail", pa.string())])
#: Requests and recorded results of a bucket, about.
BUCKET_ROWS = 20_000
#: Answers that travel together.
BATCH = 1000


class Unavailable(RuntimeError):
    """The reader cannot be reached; the message may be shown."""


class Client(Protocol):
    """A reader: the JSON text of a key's extraction, ``KeyError`` if it knows none, ``Unavailable`` if it cannot be reached."""

    def read(self, key: str, timeout: float) -> str: ...


class RecordedReader:
    """Recorded results (key, payload) of one bucket, opened at the first question."""

    def __init__(self, options: dict, bucket: int):
        self.path, self.known = f"{options['recorded']}/bucket={bucket}", None

    def read(self, key: str, timeout: float) -> str:
        if self.known is None:
            self.known = {k: v for batch in stored(self.path, ["key", "payload"]) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
        return self.known[key]


def stored(folder: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches of the Parquet files of a folder, which need not be there."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    for f in sorted(store.get_file_info(fs.FileSelector(root, allow_not_found=True)), key=lambda f: f.path):
        if f.path.endswith(".parquet"):
            with store.open_input_file(f.path) as source:
                yield from pq.ParquetFile(source).iter_batches(columns=columns, use_threads=False)


class Questions:
    """Asks a client within a time limit; a call that hangs keeps its thread, and the next one gets another."""

    def __init__(self, client: Client, timeout: float, retries: int):
        self.client, self.timeout, self.retries, self.pool = client, timeout, retries, None

    def ask(self, key: str) -> tuple[str, int, str | None, str | None]:
        """(status, attempts, payload, detail)."""
        got = ("failed", None, None)
        for attempt in range(1, self.retries + 2):
            self.pool = self.pool or ThreadPoolExecutor(1)
            try:
                return "read", attempt, self.pool.submit(self.client.read, key, self.timeout).result(self.timeout), None
            except Late:
                self.pool.shutdown(wait=False, cancel_futures=True)
                self.pool = None
                got = ("timeout", None, "The reader gave no answer in time.")
            except KeyError:
                return "missing", attempt, None, "No extraction is recorded for this label."
            except Unavailable as e:
                got = ("unavailable", None, str(e))
            except Exception as e:  # one label's failure is its own
                return "failed", attempt, None, type(e).__name__
        return got[0], self.retries + 1, *got[1:]


class Bucket(InputPartition):
    def __init__(self, number: int):
        self.number = number


class Reads(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [Bucket(i) for i in range(int(self.options["buckets"]))]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        module, _, name = self.options.get("client", "").partition(":")
        client = getattr(importlib.import_module(module), name) if module else RecordedReader
        questions = Questions(client(self.options, partition.number), float(self.options.get("timeout", 15)), int(self.options.get("retries", 1)))
        rows: list[tuple] = []
        for batch in stored(f"{self.options['requests']}/bucket={partition.number}", ["key"]):
            for key in batch.column(0).to_pylist():
                rows.append((key, *questions.ask(key)))
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


class ReaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return READS

    def reader(self, schema: StructType) -> Reads:
        return Reads(self.options)


def _dealt(rows: DataFrame, buckets: int, path: str) -> str:
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(path)
    return path


def ask(requests: DataFrame, recorded: DataFrame | None = None, client: str = "", timeout: float = 15, retries: int = 1, folder: str | None = None) -> DataFrame:
    """``READS`` for the distinct non-null keys of ``requests``: from ``recorded`` (key, payload), or from a client named as module:factory."""
    spark: SparkSession = requests.sparkSession
    spark.dataSource.register(ReaderSource)
    folder = folder or shared_dir(spark)
    keys = requests.where("key IS NOT NULL").select(F.col("key").cast("string").alias("key")).distinct()
    buckets = max(1, -(-keys.count() // BUCKET_ROWS), spark.sparkContext.defaultParallelism)
    options = {"requests": _dealt(keys, buckets, f"{folder}/requests"), "buckets": buckets, "client": client, "timeout": timeout, "retries": retries}
    if recorded is not None:
        options["recorded"] = _dealt(recorded.where("key IS NOT NULL").groupBy("key").agg(F.max("payload").alias("payload")), buckets, f"{folder}/recorded")
    return spark.read.format(FORMAT).options(**options).load()
