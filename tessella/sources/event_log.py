"""A replayable log of events on shared storage, and Spark's streaming and batch source over it (format ``event_log``).

A log has partitions; a row has an offset in its partition, without gaps. ``append_events`` adds segments: Parquet files of one
partition each, in order of offsets, committed as a whole by Spark's writer. The source offers offsets as a message broker does:
a query's checkpoint keeps from where to where each batch went, so a batch that was lost is read again with the same rows.

Options: ``path``; ``maxOffsetsPerTrigger`` with ``group``, so many rows a batch at most (the group's folder in the log remembers
what was planned, so a restarted query goes on from there, and what was committed after processing); ``rowsPerTask``. One query
a group. Rows are read inside tasks, a range of a segment each.

Defined cases: a log that isn't there yet has no rows; a null value is an event like any other; offsets that a checkpoint asks
for and that are gone are an error, not skipped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "partition int, offset bigint, value string"
ROWS_PER_TASK = 500_000


def _storage(path: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class Segments:
    """Which file holds which offsets of which partition. Footers are read once a file."""

    def __init__(self, path: str):
        self.fs, self.root = _storage(path)
        self.known: dict[str, tuple[int, int, int]] = {}

    def all(self) -> list[tuple[str, int, int, int]]:
        """(file, partition, first offset, end), in order."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        found = [f.path for f in self.fs.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True)) if f.is_file and f.base_name.startswith("part-") and f.extension == "parquet"]
        for path in found:
            if path not in self.known:
                with self.fs.open_input_file(path) as f:
                    meta = pq.ParquetFile(f).metadata
                at = [i for i in range(meta.num_columns) if meta.schema.column(i).name == "offset"][0]
                stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
                partition = int(path.rpartition("/partition=")[2].split("/")[0])
                self.known[path] = (partition, min((s.min for s in stats), default=0), max((s.max + 1 for s in stats), default=0))
        rows = [(p, *self.known[p]) for p in found]
        return sorted((r for r in rows if r[3] > r[2]), key=lambda r: r[1:])

    def ends(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for _, partition, _, end in self.all():
            out[str(partition)] = max(end, out.get(str(partition), 0))
        return out


class Range(InputPartition):
    """Offsets [low, high) of a segment that begins at ``first``."""

    def __init__(self, file: str, partition: int, first: int, low: int, high: int):
        self.file, self.partition, self.first, self.low, self.high = file, partition, first, low, high


def ranges(segments: Sequence[tuple[str, int, int, int]], start: dict[str, int], end: dict[str, int], rows: int) -> list[Range]:
    """Work for tasks: all offsets from start to end."""
    out = []
    for name, stop in end.items():
        begin = start.get(name, 0)
        if stop < begin:
            raise ValueError(f"partition {name} would go back from offset {begin} to {stop}: another query uses this group")
        found = 0
        for file, partition, first, last in segments:
            low, high = max(begin, first), min(stop, last)
            if str(partition) == name and low < high:
                found += high - low
                out += [Range(file, partition, first, at, min(high, at + rows)) for at in range(low, high, rows)]
        if found != stop - begin:
            raise ValueError(f"partition {name} has {found} of the {stop - begin} rows from offset {begin} to {stop}")
    return out


def _read(path: str, part: Range) -> Iterator:
    """Record batches of a range; row groups outside it aren't read."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    storage, _ = _storage(path)
    with storage.open_input_file(part.file) as f:
        file, at = pq.ParquetFile(f), part.first
        for g in range(file.num_row_groups):
            n = file.metadata.row_group(g).num_rows
            if at < part.high and at + n > part.low:
                for batch in file.iter_batches(row_groups=[g], columns=["offset", "value"]):
                    low, high = max(part.low - at, 0), min(part.high - at, batch.num_rows)
                    if low < high:
                        rows = batch.slice(low, high - low)
                        yield pa.RecordBatch.from_arrays([pa.array([part.partition] * rows.num_rows, pa.int32()), rows.column("offset").cast(pa.int64()), rows.column("value").cast(pa.string())], ["partition", "offset", "value"])
                    at += batch.num_rows
            else:
                at += n


class EventLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return EventLogReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return EventLogStream(dict(self.options))


class EventLogReader(DataSourceReader):
    """The whole log at once."""

    def __init__(self, options: dict[str, str]):
        self.path, self.rows = options["path"], int(options.get("rowspertask", ROWS_PER_TASK))

    def partitions(self) -> list[Range]:
        s = Segments(self.path)
        return ranges(s.all(), {}, s.ends(), self.rows)

    def read(self, partition: Range | None) -> Iterator:
        if partition is not None:
            yield from _read(self.path, partition)


class EventLogStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.rows = options["path"], int(options.get("rowspertask", ROWS_PER_TASK))
        self.most, self.group = int(options.get("maxoffsetspertrigger", 0)), options.get("group")
        if self.most and not self.group:
            raise ValueError("maxOffsetsPerTrigger needs a group, which remembers how far the query has planned")
        self.segments = Segments(self.path)
        self.offered: dict[str, int] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        ends = self.segments.ends()
        if not self.most:
            return ends
        at = self._recall("planned") if self.offered is None else self.offered
        left = {p: end - at.get(p, 0) for p, end in ends.items()}
        total = sum(left.values())
        # each partition moves on by its share of what is left, so all of them end together
        share = min(1.0, self.most / total) if total else 0.0
        self.offered = {p: at.get(p, 0) + min(n, -int(-n * share // 1)) for p, n in left.items()}
        return self.offered

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = ranges(self.segments.all(), start, end, self.rows)
        self._remember("planned", end)
        return out

    def read(self, partition: Range) -> Iterator:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        self._remember("committed", end)

    def _file(self, kind: str) -> str:
        return f"{self.segments.root}/_groups/{self.group}/{kind}.json"

    def _recall(self, kind: str) -> dict[str, int]:
        try:
            with self.segments.fs.open_input_file(self._file(kind)) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return {}

    def _remember(self, kind: str, offsets: dict) -> None:
        if not self.group:
            return
        fs, to = self.segments.fs, self._file(kind)
        fs.create_dir(to.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(temp := f"{to}.{uuid.uuid4().hex}") as f:
            f.write(json.dumps(offsets).encode())
        fs.move(temp, to)


def append_events(events: DataFrame, path: str, partitions: int = 8, key: Column | None = None, order: Sequence[str | Column] = (), value: str = "value") -> None:
    """Adds events to a log: dealt by a key (else by their own text), in order inside a partition, after what is there. One writer at a time."""
    ends = Segments(path).ends()
    dealt = events.withColumn("partition", F.pmod(F.xxhash64(F.col(value) if key is None else key), F.lit(partitions)).cast("int"))
    base = F.element_at(F.create_map(*[F.lit(x) for p, end in ends.items() for x in (int(p), end)]), F.col("partition")) if ends else F.lit(None)
    nth = F.row_number().over(Window.partitionBy("partition").orderBy(*(order or [value])))
    rows = dealt.withColumn("offset", F.coalesce(base, F.lit(0)) + nth - 1)
    rows.select("partition", F.col("offset").cast("bigint").alias("offset"), F.col(value).cast("string").alias("value")).sortWithinPartitions("partition", "offset").write.mode("append").partitionBy("partition").parquet(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLog)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("event_log").option("path", path).load()


def stream_log(spark: SparkSession, path: str, group: str | None = None, most: int = 0) -> DataFrame:
    """The log as a stream; ``most`` rows a batch need a group."""
    register(spark)
    reader = spark.readStream.format("event_log").option("path", path)
    reader = reader.option("group", group) if group else reader
    return (reader.option("maxOffsetsPerTrigger", str(most)) if most else reader).load()
