"""Trees of files read and written by executors: a ranged reader, a sink with one file a row, and a fan-out copy.

Executors reach files through pyarrow's file systems, so a root may be a local folder or any URI that
they know (``s3://``, ``gs://``, ``hdfs://`` and others). The three work on files of any size: the reader
takes the ranges that it needs, the copy goes through a chunk at a time; only the sink holds a row's
content.

* ``listed``: the names below a root, folder by folder and level by level. A task goes through a folder's
  entries as they come; what it finds is written to the shared folder, so no name passes the driver.
* ``frame_files``: frames below a root, with the facts of their directories. The listed names are dealt out in
  slices of ``SLICE``; a task reads, of each frame, a window at the beginning and then the blocks that its
  directories point to. Only the columns that are asked for are made: without a fact no byte is read.
* ``write_files``: (rel, content) as files below a root. Tasks write under temporary names below one folder
  of the job and note them in the shared folder; when all have ended and no name is held twice, other tasks
  rename them, so no file is ever seen half written. The temporary folder goes in any case.
* ``copy_files``: each file of a list to all of its destinations, read once, digested on the way.

Defined results: names that begin with ``._`` are shadow files and are left out, and so is what such a job
keeps below a folder that begins with ``.loomshed-``; a broken or vanished frame has its error and no
facts; null content is an empty file; a null, absolute or climbing name, or one given twice, fails the
write before anything is renamed.
"""

from __future__ import annotations

import datetime
import fnmatch
import hashlib
import os
import posixpath
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomshed.scratch import free, settings, stored
from loomshed.sources import tiff

#: Bytes read at a frame's beginning, and at a time elsewhere.
WINDOW, BLOCK = 512 << 10, 64 << 10
#: Names that one task reads, and bytes of their files.
SLICE, SLICE_BYTES = 5_000, 256 << 20
#: Names that a listing hands on at a time.
NAMES = 5_000
#: Bytes of a copy that are held.
CHUNK = 1 << 20
#: Rows of the sink that a task holds at a time, bytes from which it holds no more of them, and names that one renames.
HELD, HELD_BYTES, RENAMES = 128, 16 << 20, 20_000
#: Rows that one task of the sink may have however few the others have.
UNEVEN = 5_000
STAGE = ".loomshed-"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    if "://" in uri or uri.startswith("file:"):
        fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    else:
        fs, path = pafs.LocalFileSystem(), uri
    return fs, path.rstrip("/") or "/"


# The listing.

#: Names that no reader of frames sees, and those that Spark's readers of files do not see.
SHADOW, HIDDEN = r"\._", r"\.|_(?!.*=)|.*\._COPYING_$"


def entries(fs: pafs.FileSystem, folder: str, facts: bool = True) -> Iterator[tuple]:
    """(name, is a folder, bytes, time of change) of what a folder holds; a local folder is gone through entry by entry.

    Without ``facts`` no file is asked for its bytes and time. What goes meanwhile is left out.
    """
    if not isinstance(fs, pafs.LocalFileSystem):
        for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if f.type == pafs.FileType.Directory or f.is_file:
                yield f.base_name, not f.is_file, f.size, f.mtime
        return
    try:
        found = os.scandir(folder)
    except FileNotFoundError:
        return
    with found:
        for e in found:
            if e.is_dir():
                yield e.name, True, None, None
            elif e.is_file():
                try:
                    s = e.stat() if facts else None
                except FileNotFoundError:
                    continue
                at = s and datetime.datetime.fromtimestamp(s.st_mtime, datetime.UTC)
                yield e.name, False, s and s.st_size, at


def matcher(glob: str) -> Callable[[str], bool]:
    """Whether a name fits a glob of ``*``, ``?``, ``[...]`` and ``{a,b}``."""
    parts = re.split(r"\{([^{}]*)\}", glob)
    globs = [""]
    for i, part in enumerate(parts):
        globs = [g + p for g in globs for p in (part.split(",") if i % 2 else [part])]
    fits = re.compile("|".join(fnmatch.translate(g) for g in globs)).match
    return lambda name: fits(name) is not None


_LISTED = pa.schema(
    [("rel", pa.string()), ("folder", pa.bool_()), ("length", pa.int64()), ("modified", pa.timestamp("us", tz="UTC"))]
)


def listed(spark: SparkSession, root: str, glob: str = "*", anycase: bool = False, unseen: str = HIDDEN) -> DataFrame:
    """(rel, length, modified) of the files below ``root`` whose names match, as they are now; names like ``unseen`` are left out.

    Each level of folders is one job, and each folder is gone through by one task, which holds ``NAMES`` names.
    """
    fs, path = opened(root)
    if fs.get_file_info(path).type != pafs.FileType.Directory:
        raise FileNotFoundError(f"{root} is no folder")

    def run(batches):
        fs, path = opened(root)
        fits, hidden = matcher(glob.lower() if anycase else glob), re.compile(unseen).match
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                held = []
                for name, folder, size, at in entries(fs, posixpath.join(path, rel)):
                    if folder:
                        # A folder beginning with "._" is no shadow file.
                        if name.startswith(STAGE) or (unseen != SHADOW and hidden(name)):
                            continue
                    elif hidden(name) or not fits(name.lower() if anycase else name):
                        continue
                    held.append({"rel": posixpath.join(rel, name), "folder": folder, "length": size, "modified": at})
                    if len(held) == NAMES:
                        yield pa.RecordBatch.from_pylist(held, schema=_LISTED)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema=_LISTED)

    todo, out = spark.createDataFrame([("",)], "rel string").coalesce(1), None
    while True:
        level = stored(todo.mapInArrow(run, "rel string, folder boolean, length long, modified timestamp"), "listed")
        files = level.filter("not folder").drop("folder")
        out = files if out is None else out.unionByName(files)
        todo = level.filter("folder").select("rel")
        if not (n := todo.count()):
            return out
        todo = todo.repartition(max(1, min(n, 10 * spark.sparkContext.defaultParallelism)))


def dealt(found: DataFrame, most: int = SLICE) -> DataFrame:
    """Listed files, dealt out by name: a task gets about ``most`` of them or ``SLICE_BYTES``, and every core some."""
    told = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    cores = found.sparkSession.sparkContext.defaultParallelism
    return found.repartition(max(1, -(-told["n"] // most), -(-told["bytes"] // SLICE_BYTES), min(told["n"], cores)), "rel")


class Ranges:
    """A file as bytes that are read when they are looked at: a window first, then block by block.

    ``read`` counts the bytes that were fetched.
    """

    def __init__(self, file: pa.NativeFile, size: int, window: int = WINDOW, block: int = BLOCK):
        self.file, self.size, self.block, self.read = file, size, block, 0
        self.head = self._fetch(0, min(window, size))
        self.blocks: dict[int, bytes] = {}

    def __len__(self) -> int:
        return self.size

    def _fetch(self, start: int, n: int) -> bytes:
        data = self.file.read_at(n, start) if n > 0 else b""
        self.read += len(data)
        return data

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        if stop <= len(self.head):
            return self.head[start:stop]
        if stop - start > 4 * self.block:
            return self._fetch(start, stop - start)
        out = []
        for b in range(start // self.block, -(-stop // self.block)):
            if b not in self.blocks:
                self.blocks[b] = self._fetch(b * self.block, min(self.block, self.size - b * self.block))
            out.append(self.blocks[b])
        skip = start - start // self.block * self.block
        return b"".join(out)[skip : skip + stop - start]


#: Columns of a frame's file, and those of its directories.
FILE = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("rel", "clip", "name", "stem")],
        T.StructField("length", T.LongType()),
        T.StructField("modified", T.TimestampType()),
    ]
)


def _facts() -> T.StructType:
    from loomshed.sources.frames import FACTS

    return FACTS


@dataclass
class Slice(InputPartition):
    """Part ``n`` of ``parts`` of a folder's names."""

    folder: str
    n: int
    parts: int

    def __post_init__(self):
        super().__init__((self.folder, self.n, self.parts))


class FrameReader(DataSourceReader):
    """Slices of folders, and the frames in them.

    ``frame_files`` takes names from ``listed`` instead of these slices, whose tasks each list their folder again.
    """

    def __init__(self, schema: T.StructType, options: dict):
        self.columns = schema.names
        self.root = options["path"]
        self.glob = options.get("glob", "*.dng").lower()
        self.window, self.slice = int(options.get("window", WINDOW)), int(options.get("slice", SLICE))

    def _names(self, fs: pafs.FileSystem, folder: str) -> tuple[list[pafs.FileInfo], list[str]]:
        """Files of a folder that are frames, by name, and its folders."""
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        files = [f for f in found if f.is_file and not f.base_name.startswith("._") and fnmatch.fnmatchcase(f.base_name.lower(), self.glob)]
        folders = [f.path for f in found if f.type == pafs.FileType.Directory and not f.base_name.startswith(STAGE)]
        return sorted(files, key=lambda f: f.base_name), folders

    def partitions(self) -> list[InputPartition]:
        fs, root = opened(self.root)
        todo, out = [root], []
        while todo:
            folder = todo.pop()
            files, below = self._names(fs, folder)
            todo += below
            parts = -(-len(files) // self.slice)
            out += [Slice(folder, n, parts) for n in range(parts)]
        return out or [Slice(root, 0, 1)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        fs, root = opened(self.root)
        files, _ = self._names(fs, partition.folder)
        for info in files[partition.n :: partition.parts]:
            row = self._row(fs, root, posixpath.relpath(info.path, root), info.size, info.mtime)
            yield tuple(row.get(c) for c in self.columns)

    def _row(self, fs: pafs.FileSystem, root: str, rel: str, length: int, modified) -> dict:
        name = posixpath.basename(rel)
        row = {
            "rel": rel,
            "clip": posixpath.dirname(rel),
            "name": name,
            "stem": posixpath.splitext(name)[0],
            "length": length,
            "modified": modified,
        }
        if any(c not in row for c in self.columns):
            row |= self._told(fs, posixpath.join(root, rel))
        return row

    def _told(self, fs: pafs.FileSystem, path: str) -> dict:
        """The facts of a frame and the bytes that were read for them."""
        from loomshed.sources.frames import facts_of

        try:
            with fs.open_input_file(path) as f:
                data = Ranges(f, f.size(), self.window)
                return facts_of(data) | {"bytes_read": data.read}
        except OSError as e:
            return {"error": f"{type(e).__name__}: {e}", "bytes_read": 0}


class FrameFiles(DataSource):
    """Spark's name for the ranged reader."""

    @classmethod
    def name(cls) -> str:
        return "loomshed_frames"

    def schema(self) -> T.StructType:
        return T.StructType([*FILE.fields, *_facts().fields, T.StructField("bytes_read", T.LongType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FrameReader(schema, dict(self.options))


_ARROW = {
    T.StringType(): pa.string(),
    T.IntegerType(): pa.int32(),
    T.LongType(): pa.int64(),
    T.BinaryType(): pa.binary(),
    T.TimestampType(): pa.timestamp("us", tz="UTC"),
}


def arrow(schema: T.StructType) -> pa.Schema:
    """Arrow's names of the types of files and facts."""
    return pa.schema([(f.name, _ARROW[f.dataType]) for f in schema.fields])


def frame_files(spark: SparkSession, root: str, columns: list[str] | None = None, **options) -> DataFrame:
    """Frames below ``root``: columns of ``FILE``, facts, ``error`` and ``bytes_read``; only those named are made.

    Options: ``glob`` of names (case is not minded), ``window`` of bytes at a frame's beginning, ``slice`` of
    names that a task takes.
    """
    whole = FrameFiles({}).schema()
    schema = whole if columns is None else T.StructType([whole[c] for c in columns])
    found = listed(spark, root, options.get("glob", "*.dng"), anycase=True, unseen=SHADOW)
    name = F.substring_index("rel", "/", -1)
    if all(c in FILE.names for c in schema.names):
        made = {
            "clip": F.regexp_extract("rel", "^(.*)/[^/]*$", 1),
            "name": name,
            "stem": F.regexp_replace(name, r"^(\.*[^.].*)\.[^.]*$", "$1"),
        }
        return found.select(*[made.get(c, F.col(c)).alias(c) for c in schema.names])
    out, given = arrow(schema), {"path": root, **{k: str(v) for k, v in options.items()}}

    def run(batches):
        fs, path = opened(root)
        reader = FrameReader(schema, given)
        for batch in batches:
            rows = [reader._row(fs, path, *r.values()) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in schema.names} for r in rows], schema=out)

    return dealt(found, int(options.get("slice", SLICE))).select("rel", "length", "modified").mapInArrow(run, schema)


# The sink.


def safe(rel: str | None) -> str:
    """A relative name that stays below its root; raises for any other."""
    if not rel or rel.startswith("/") or rel.endswith("/") or any(p in ("", ".", "..") or p.startswith(STAGE) for p in rel.split("/")):
        raise ValueError(f"{rel!r} is no name of a file below a folder")
    return rel


def _drop_folder(fs: pafs.FileSystem, path: str) -> None:
    """Remove a folder; one that went meanwhile is gone."""
    try:
        fs.delete_dir(path)
    except FileNotFoundError:
        pass  # an attempt and the job's abort may both remove it


def _moved(fs: pafs.FileSystem, temp: str, path: str) -> None:
    """Rename a file; one that an earlier attempt has renamed is there.

    Renames from folder to folder take a lock of the whole local file system, so that tasks wait for each other
    however many there are. There a new name is a second link to the file, and the first is removed.
    """
    if isinstance(fs, pafs.LocalFileSystem):
        try:
            os.link(temp, path)
        except OSError:
            pass  # a file is there already, or the file system has no links: it is renamed
        else:
            return os.remove(temp)
    try:
        fs.move(temp, path)
    except FileNotFoundError:
        if fs.get_file_info(path).type != pafs.FileType.File:
            raise


def even(rows: DataFrame) -> DataFrame:
    """The rows, dealt out by name where one task has more than twice its share, as of a table whose file is one split.

    Rows are counted by the tasks that have them, without their content.
    """
    held = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    n, most = held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-n // RENAMES)), "rel") if most > max(UNEVEN, 2 * n // cores) else rows


def in_pieces(spark: SparkSession):
    """In this block, tasks get rows of contents by ``HELD``, or fewer where contents are large."""
    most = {"spark__sql__execution__arrow__maxRecordsPerBatch": str(HELD), "spark__sql__execution__arrow__maxBytesPerBatch": str(HELD_BYTES)}
    return settings(spark, **most)


def write_files(rows: DataFrame, root: str) -> None:
    """Write (rel, content) as files below ``root``; a file of the same name is replaced.

    Rows that lie in few tasks are dealt out first. What a task has written is a row a file in the shared folder, of the attempt that counts. An attempt that
    still runs when the job is given up may leave its folder behind; its name begins with ``STAGE``, so that no
    reader sees what is in it.
    """
    spark = rows.sparkSession
    fs, path = opened(root)
    stage = f"{path}/{STAGE}{uuid.uuid4().hex}"
    fs.create_dir(stage, recursive=True)

    def write(batches):
        fs, _ = opened(root)
        attempt, n = str(TaskContext.get().taskAttemptId()), 0
        fs.create_dir(f"{stage}/{attempt}", recursive=True)
        try:
            for batch in batches:
                rels, first = [safe(rel) for rel in batch.column(0).to_pylist()], n
                for content in batch.column(1):
                    with fs.open_output_stream(f"{stage}/{attempt}/{n}") as out:
                        if content.is_valid:
                            out.write(content.as_buffer())
                    n += 1
                temps = [f"{attempt}/{i}" for i in range(first, n)]
                yield pa.RecordBatch.from_arrays([pa.array(rels, pa.string()), pa.array(temps, pa.string())], names=["rel", "temp"])
        except BaseException:
            _drop_folder(fs, f"{stage}/{attempt}")
            raise

    def move(batches):
        fs, made = opened(root)[0], set()
        for batch in batches:
            for rel, temp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target = f"{path}/{rel}"
                if (folder := posixpath.dirname(target)) not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                _moved(fs, f"{stage}/{temp}", target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    narrow = rows.select(F.col("rel").cast("string").alias("rel"), F.col("content").cast("binary").alias("content"))
    try:
        with in_pieces(spark):
            told = stored(even(narrow).mapInArrow(write, "rel string, temp string"), "staged")
        c = F.count(F.lit(1)).alias("c")
        n, names = told.groupBy("rel").agg(c).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        if names < n:
            raise ValueError(f"{n - names} names are given twice")
        tasks = max(1, -(-n // RENAMES), min(n // 100, spark.sparkContext.defaultParallelism))
        told.repartition(tasks, "rel").mapInArrow(move, "n long").write.format("noop").mode("overwrite").save()
        free(told)
    finally:
        _drop_folder(fs, stage)


# The copy.

COPIED = "rel string, dest string, size long, sha256 string, verdict string"


def _temp(path: str, job: str, attempt: int | str) -> str:
    folder, name = posixpath.split(path)
    return f"{folder}/{STAGE}{job}-{attempt}-{name}"


def _fan_out(source: str, rel: str, targets: list[str], job: str, attempt: int) -> list[tuple]:
    """Copy one file to all its targets: read once, digested on the way, renamed when its bytes are there.

    A target that fails leaves the others alone; a source that fails leaves none. Either way no temporary file stays.
    """
    safe(rel)
    fs, path = opened(source)
    outs: dict[str, tuple] = {}
    failed: dict[str, str] = {}
    h, size = hashlib.sha256(), 0

    def drop(target: str, why: Exception) -> None:
        to, temp, out = outs.pop(target)
        failed[target] = f"COPY_FAIL: {why}"
        for step in (out.close, lambda: to.delete_file(temp)):
            try:
                step()
            except OSError:
                pass  # nothing more can be done for this target, and its error is told

    try:
        with fs.open_input_stream(f"{path}/{rel}", buffer_size=0) as data:
            for target in targets:
                try:
                    to, folder = opened(target)
                    to.create_dir(posixpath.dirname(f"{folder}/{rel}"), recursive=True)
                    temp = _temp(f"{folder}/{rel}", job, attempt)
                    outs[target] = to, temp, to.open_output_stream(temp)
                except OSError as e:
                    failed[target] = f"COPY_FAIL: {e}"
            while chunk := data.read(CHUNK):
                h.update(chunk)
                size += len(chunk)
                for target in list(outs):
                    try:
                        outs[target][2].write(chunk)
                    except OSError as e:
                        drop(target, e)
    except OSError as e:
        for target in list(outs):
            drop(target, e)
        return [(rel, t, None, None, f"SOURCE_FAIL: {e}") for t in targets]
    except BaseException:  # an attempt that is ended takes its temporary files with it
        for target in list(outs):
            drop(target, InterruptedError())
        raise
    for target, (to, temp, out) in list(outs.items()):
        try:
            out.close()
            to.move(temp, f"{opened(target)[1]}/{rel}")
        except OSError as e:
            drop(target, e)
    return [(rel, t, size, h.hexdigest(), failed.get(t, "COPIED")) for t in targets]


def copy_files(source: str, plan: DataFrame) -> DataFrame:
    """Copy each (rel, dests array<string>) of ``source`` to all its destination folders; (rel, dest, size, sha256, verdict).

    The plan is dealt out by name, so that a task has few files and a large one holds up no others. What is
    given is the written record of the copies, so that reading it copies nothing again. An attempt that is
    repeated writes under names of its own and ends in the same files; what a killed one has left is removed.
    """
    job = uuid.uuid4().hex

    def run(batches):
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for rel, dests in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = _fan_out(source, rel, sorted(set(dests)), job, attempt)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[i] for r in rows], kind)
                        for i, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()))
                    ],
                    names=["rel", "dest", "size", "sha256", "verdict"],
                )

    plan = stored(plan.select("rel", "dests"), "copy-plan")
    n, cores = plan.count(), plan.sparkSession.sparkContext.defaultParallelism
    told = stored(plan.repartition(max(1, -(-n // SLICE), min(n, 4 * cores)), "rel").mapInArrow(run, COPIED), "copied")

    def sweep(batches):
        for batch in batches:
            left = 0
            for rel, dests in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for dest in set(dests):
                    fs, folder = opened(dest)
                    where = posixpath.dirname(f"{folder}/{rel}")
                    if fs.get_file_info(where).type != pafs.FileType.Directory:
                        continue
                    for name, *_ in entries(fs, where, facts=False):
                        if name.startswith(f"{STAGE}{job}-"):
                            fs.delete_file(f"{where}/{name}")
                            left += 1
            yield pa.RecordBatch.from_arrays([pa.array([left], pa.int64())], names=["left"])

    folders = plan.withColumn("rel", F.regexp_replace("rel", "[^/]*$", "x")).groupBy("rel").agg(
        F.array_distinct(F.flatten(F.collect_set("dests"))).alias("dests")
    )
    folders.mapInArrow(sweep, "left long").write.format("noop").mode("overwrite").save()
    return told
