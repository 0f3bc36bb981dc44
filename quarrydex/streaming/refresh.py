"""Continuous ingest: files and embedding requests as streams."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, root: str, per_trigger: int = 100) -> DataFrame:
    """New and changed files below ``root``, in micro-batches of ``per_trigger`` files."""
    return spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)


def refresh_on_change(spark: SparkSession, root: str, checkpoint: str, refresh: Callable[[], object], every: str | None = None, per_trigger: int = 100) -> StreamingQuery:
    """Run ``refresh`` once for every micro-batch of changed files.

    ``every`` is the cooldown between batches; without it what is there is processed
    and the query ends.  A batch that fails is run again after a restart; a refresh
    compares with the store, so running it twice changes nothing.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        if not df.isEmpty():
            refresh()

    writer = file_stream(spark, root, per_trigger).select("path").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def pending_requests(requests: DataFrame, late: str = "1 minute") -> DataFrame:
    """Requests (ts, action, text, priority) without those that repeat an action and text within the watermark."""
    rows = requests.withColumn("text_hash", F.sha2("text", 256))
    if rows.isStreaming:
        return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["action", "text_hash"])
    return rows.dropDuplicates(["action", "text_hash"])


def debounced(changes: DataFrame, quiet: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(window, repo_id, n): bursts of changes that end with a quiet time; one refresh each."""
    rows = changes.withWatermark("ts", late) if changes.isStreaming else changes
    return rows.groupBy(F.session_window("ts", quiet).alias("window"), "repo_id").agg(F.count("*").alias("n"))


class EmbeddingQueue:
    """Requests for vectors in micro-batches, the urgent ones first.

    ``run`` takes a list of texts and gives a vector of each.  A text that waits already
    isn't queued twice, but becomes urgent if it is asked for so.  A batch starts when it
    is full, or ``wait_s`` after its first request.
    """

    def __init__(self, run: Callable[[list[str]], dict[str, list[float]]], batch: int = 128, wait_s: float = 0.05):
        self.run, self.batch, self.wait_s = run, batch, wait_s
        self.lanes: tuple[OrderedDict[str, Future], ...] = (OrderedDict(), OrderedDict())
        self.ready, self.closed = threading.Condition(), False
        self.worker = threading.Thread(target=self._work, daemon=True)
        self.worker.start()

    def put(self, text: str, urgent: bool = False) -> Future:
        """The vector of ``text``, when its batch is done."""
        with self.ready:
            if self.closed:
                raise RuntimeError("the queue is closed")
            first, later = self.lanes
            waiting = first.get(text) or later.get(text)
            if waiting is not None and not (urgent and text in later):
                return waiting
            future = later.pop(text, None) or Future()
            (first if urgent else later)[text] = future
            self.ready.notify()
            return future

    def _take(self) -> dict[str, Future]:
        out: dict[str, Future] = {}
        for lane in self.lanes:
            while lane and len(out) < self.batch:
                text, future = lane.popitem(last=False)
                out[text] = future
        return out

    def _work(self) -> None:
        while True:
            with self.ready:
                self.ready.wait_for(lambda: self.closed or any(self.lanes))
                if not any(self.lanes):
                    return
                self.ready.wait_for(lambda: self.closed or sum(map(len, self.lanes)) >= self.batch, self.wait_s)
                taken = self._take()
            try:
                vectors = self.run(list(taken))
                for text, future in taken.items():
                    future.set_result(vectors.get(text))
            except Exception as e:  # noqa: BLE001
                for future in taken.values():
                    future.set_exception(e)

    def close(self) -> None:
        """Finish what waits, then stop."""
        with self.ready:
            self.closed = True
            self.ready.notify()
        self.worker.join()
