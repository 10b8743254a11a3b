"""Work on pieces with a mark before each, and files read by their heads: two Python data sources.

``work_through`` runs a caller's function on every piece of a run. Before a piece is begun, a task writes a mark with
the piece's key; after it, another with what came of it. So what a crash takes down is known by the marks that have no
second one, whatever became of the task. Finished content is a file in the task attempt's own folder. A task's commit
message says how much it has written; the driver puts the messages of a finished job into the manifest, and only what the
manifest names counts. An attempt that failed or a job that was given up leaves its marks and nothing else that is read.

``read_heads`` lists a folder and reads the first bytes of each file, whatever its size. The driver lists folders only
until there are enough of them to share out; tasks list the rest.

Paths are what pyarrow's file systems reach from driver and executors: a mounted folder, hdfs, s3 or gs.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# What a caller's function says about a piece: its kind, the content of a finished one, the reason of another. None: the
# piece never came back, and its mark stays alone.
Outcome = tuple[str, bytes | None, str | None] | None
Work = Callable[[dict], Outcome]

RESULT = "run_id long, ordinal long, source string, kind string, bytes long, reason string, file string"
MARK = "run_id long, ordinal long, at string, kind string"
HEAD_BYTES = 1024
FOLDERS = 64  # folders the driver looks for before it shares them out
FILES = 10_000  # files of one partition, where a folder has more
AT_ONCE = 256  # heads of one batch
IN_HAND = 32  # pieces of a batch that are Python values at a time


def store(path: str):
    """The file system of a path, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    from pyarrow import fs

    files, root = store(path)
    return files.get_file_info(root).type != fs.FileType.NotFound


def isolated(work: Work) -> Work:
    """``work``, with an exception as the piece's own failure."""
    def run(piece: dict) -> Outcome:
        try:
            return work(piece)
        except Exception as err:
            return "failed", None, f"{type(err).__name__}: {err}"
    return run


@dataclass
class Written(WriterCommitMessage):
    """What one task has written."""

    attempt: str
    pieces: int
    done: int


class Marks:
    """A task attempt's marks: appended and flushed one by one; where a store cannot append, an object each."""

    def __init__(self, files, folder: str, attempt: str):
        self.files, self.folder, self.attempt, self.n, self.out = files, folder, attempt, 0, None
        files.create_dir(folder, recursive=True)
        try:
            self.out = files.open_append_stream(f"{folder}/{attempt}.json")
        except NotImplementedError:
            pass

    def add(self, run: int, ordinal: int, at: str, kind: str | None = None) -> None:
        line = json.dumps({"run_id": run, "ordinal": ordinal, "at": at, "kind": kind}).encode() + b"\n"
        if self.out is not None:
            self.out.write(line)
            self.out.flush()
            return
        self.n += 1
        with self.files.open_output_stream(f"{self.folder}/{self.attempt}-{self.n}.json") as f:
            f.write(line)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


class PieceWriter(DataSourceArrowWriter):
    def __init__(self, path: str, work: str):
        self.path, self.work = path.rstrip("/"), work

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq

        work: Work = cloudpickle.loads(base64.b64decode(self.work))
        files, root = store(self.path)
        attempt = uuid.uuid4().hex
        marks, out, pieces, done, made = Marks(files, f"{root}/marks", attempt), None, 0, 0, set()
        schema = pa.schema([("run_id", pa.int64()), ("ordinal", pa.int64()), ("source", pa.string()), ("kind", pa.string()), ("bytes", pa.int64()), ("reason", pa.string()), ("file", pa.string())])
        try:
            for batch in iterator:
                rows = []
                for piece in (p for i in range(0, len(batch), IN_HAND) for p in batch.slice(i, IN_HAND).to_pylist()):
                    run, ordinal = piece["run_id"], piece["ordinal"]
                    marks.add(run, ordinal, "started")
                    said = work(piece)
                    if said is None:
                        continue
                    kind, content, reason = said
                    name = None
                    if kind == "done":
                        name = f"files/{attempt}/{run}/{ordinal}_{piece['source']}"
                        if run not in made:
                            made.add(run)
                            files.create_dir(f"{root}/files/{attempt}/{run}", recursive=True)
                        with files.open_output_stream(f"{root}/{name}") as f:
                            f.write(content or b"")
                        done += 1
                    rows.append((run, ordinal, piece["source"], kind, len(content or b"") if kind == "done" else None, reason, name))
                    marks.add(run, ordinal, "ended", kind)
                    pieces += 1
                if rows:
                    if out is None:
                        files.create_dir(f"{root}/results", recursive=True)
                        out = pq.ParquetWriter(f"{root}/results/{attempt}.parquet", schema, filesystem=files)
                    out.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema))
        finally:
            marks.close()
            if out is not None:
                out.close()
        return Written(attempt, pieces, done)

    def _record(self, folder: str, messages: list[Written | None]) -> None:
        files, root = store(self.path)
        files.create_dir(f"{root}/{folder}", recursive=True)
        lines = [json.dumps({"attempt": m.attempt, "pieces": m.pieces, "done": m.done}) for m in messages if m is not None]
        with files.open_output_stream(f"{root}/{folder}/{uuid.uuid4().hex}.json") as f:
            f.write("\n".join(lines).encode())

    def commit(self, messages: list[Written | None]) -> None:
        self._record("manifest", messages)

    def abort(self, messages: list[Written | None]) -> None:
        self._record("given-up", messages)


class Pieces(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quirework_pieces"

    def schema(self) -> str:
        return RESULT

    def writer(self, schema: T.StructType, overwrite: bool) -> PieceWriter:
        if overwrite:
            raise ValueError("a run adds to its folder; it replaces nothing")
        return PieceWriter(self.options["path"], self.options["work"])


def work_through(pieces: DataFrame, work: Work, path: str, deal: bool = False) -> None:
    """Run ``work`` on every row of ``pieces`` (run_id, ordinal, source, and whatever it needs) and keep what came of it.

    What ``work`` raises takes its task down, as a crash would; ``isolated`` makes it the piece's own failure. ``deal``
    deals the pieces out over all tasks first, in stretches of runs, so a run's folder is made by one task or few: for
    rows that are few bytes and much work, whose own files would give them to few tasks.
    """
    if deal:  # a fixed number: parts must not be put together by their size
        width = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pieces = pieces.repartitionByRange(width, "run_id", "ordinal").sortWithinPartitions("run_id", "ordinal")
    pieces.sparkSession.dataSource.register(Pieces)
    call = base64.b64encode(cloudpickle.dumps(work)).decode()
    pieces.write.format(Pieces.name()).mode("append").option("work", call).save(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(attempt, pieces, done) of every task that was committed."""
    return spark.read.schema("attempt string, pieces long, done long").json(f"{path}/manifest")


def results(spark: SparkSession, path: str) -> DataFrame:
    """The committed results."""
    d = spark.read.schema(RESULT).parquet(f"{path}/results")
    attempt = F.regexp_extract(F.col("_metadata.file_name"), r"^(\w+)\.parquet$", 1)
    return d.withColumn("attempt", attempt).join(manifest(spark, path), "attempt", "left_semi").drop("attempt")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, ordinal, name, length, head) of the committed files, by listing them and not by what was said of them."""
    d = read_heads(spark, f"{path}/files")
    at = lambda i: F.regexp_extract("path", r"/(\w+)/(-?\d+)/(-?\d+)_([^/]*)$", i)
    d = d.where(at(1) != "").select(at(1).alias("attempt"), at(2).cast("long").alias("run_id"), at(3).cast("long").alias("ordinal"), at(4).alias("name"), "length", "head")
    return d.join(manifest(spark, path), "attempt", "left_semi").drop("attempt")


def unfinished(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, ordinal) of pieces that were begun and never ended, in any attempt."""
    marks = spark.read.schema(MARK).json(f"{path}/marks")
    d = marks.groupBy("run_id", "ordinal").agg(F.count_if(F.col("at") == "ended").alias("ended"))
    return d.where("ended = 0").select("run_id", "ordinal")


# -- heads of files ----------------------------------------------------------------------------------------------


@dataclass
class Share(InputPartition):
    """Folders to list whole, and single files with their sizes."""

    folders: list[str]
    files: list[tuple[str, int]]


class HeadReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Share]:
        from pyarrow import fs

        files, root = store(self.path)
        folders, found = [root], []
        # Folder by folder, the widest level first, until there are enough to share out or none left to open.
        while folders and len(folders) < FOLDERS:
            inner = []
            for folder in folders:
                for x in files.get_file_info(fs.FileSelector(folder)):
                    inner.append(x.path) if x.type == fs.FileType.Directory else found.append((x.path, x.size))
            folders = inner
        step = -(-len(folders) // (4 * FOLDERS)) or 1
        shares = [Share(folders[i : i + step], []) for i in range(0, len(folders), step)]
        width = min(FILES, -(-len(found) // FOLDERS) or 1)
        return shares + [Share([], found[i : i + width]) for i in range(0, len(found), width)] or [Share([], [])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, _ = store(self.path)

        def listed() -> Iterator[tuple[str, int]]:
            yield from partition.files
            for folder in partition.folders:
                for x in files.get_file_info(fs.FileSelector(folder, recursive=True)):
                    if x.type == fs.FileType.File:
                        yield x.path, x.size

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            paths, sizes, heads = zip(*rows)
            names = [p.rsplit("/", 1)[-1] for p in paths]
            return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(names), pa.array(sizes, pa.int64()), pa.array(heads, pa.binary())], names=["path", "name", "length", "head"])

        rows = []
        for path, size in listed():
            head = b""
            if size and self.size:
                with files.open_input_file(path) as f:
                    head = f.read_at(min(self.size, size), 0)
            rows.append((path, size, head))
            if len(rows) >= AT_ONCE:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


class Heads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quirework_heads"

    def schema(self) -> str:
        return "path string, name string, length long, head binary"

    def reader(self, schema: T.StructType) -> HeadReader:
        return HeadReader(self.options["path"], int(self.options.get("headbytes", HEAD_BYTES)))


def read_heads(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> DataFrame:
    """path, name, length and the first ``size`` bytes of every file below a folder."""
    spark.dataSource.register(Heads)
    return spark.read.format(Heads.name()).option("headbytes", size).load(path)
