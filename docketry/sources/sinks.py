"""Files to take away: a data source that writes each named text to a file of its own, all at once.

    blocks.write.format("docketry-files").mode("append").save(folder)

Rows are (name, block); the blocks of a name come one after the other within a task and make up its file, in their order, so a file
can be larger than memory. `write_files` deals them so. Tasks write below a hidden folder of the job, each attempt in a place of its own;
only the attempts that Spark counts are committed. Where the target doesn't exist yet, the commit is one rename, so nothing is
visible before all of it is; otherwise files move into it one by one, and equal names are replaced. An aborted job removes what it
wrote. The driver learns one folder a task, not the files.

With option("deep", "true") files lie in FOLDERS folders, by the crc32 of their names. The commit then moves whole folders, and tasks
list and read a few folders each (`read_files`), so neither the driver nor a task holds a list of all files. A flat folder is for
what a person looks through: its files are moved one by one.

Names are plain file names. `numbered_names` makes them unique: the second file of a name gets `_2` before its suffix, and so on; slugs
hold no underscore, so no number makes another name.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from docketry.functions.order import numbered
from docketry.sources.shared import filesystem, ship

#: Folders of jobs that aren't committed begin with this.
HIDDEN = "_docketry-"
#: Folders of a deep target, and those that a task reads; a batch of files has about so many bytes, and no more files than that.
FOLDERS, TASK_FOLDERS, BATCH_BYTES, BATCH_FILES = 1024, 8, 1 << 22, 1 << 12


def folder_of(name: str) -> str:
    """The folder of a file in a deep target."""
    return f"{zlib.crc32(name.encode()) % FOLDERS:03x}"


@dataclass
class Attempt(WriterCommitMessage):
    """The folder that a task's attempt wrote its files to, and how many; none if it had no rows."""

    folder: str | None
    files: int


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, deep: bool = False):
        self.path, self.overwrite, self.deep = path.rstrip("/"), overwrite, deep
        above, _, name = self.path.rpartition("/")
        self.job = f"{above}/{HIDDEN}{name}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Attempt:
        system = filesystem(self.job)[0]
        folder, name, out, seen, made = None, None, None, set(), set()
        try:
            for row in iterator:
                if row[0] != name or out is None:
                    if not row[0] or row[0] in seen or "/" in row[0] or row[0].startswith((".", "_")):
                        raise ValueError(f"no name for a file, or rows of it apart: {row[0]!r}")
                    if out is not None:
                        out.close()
                    if folder is None:
                        folder = f"{self.job}/{uuid.uuid4().hex}"
                    name = row[0]
                    seen.add(name)
                    place = f"{folder}/{folder_of(name)}" if self.deep else folder
                    if place not in made:
                        system.create_dir(filesystem(place)[1], recursive=True)
                        made.add(place)
                    out = system.open_output_stream(filesystem(f"{place}/{name}")[1])
                if row[1] is not None:
                    out.write(row[1].encode())
        finally:
            if out is not None:
                out.close()
        return Attempt(folder, len(seen))

    def commit(self, messages: list[Attempt | None]) -> None:
        from pyarrow import fs

        system, target = filesystem(self.path)
        exists = system.get_file_info(target).type != fs.FileType.NotFound
        ready = target if exists and not self.overwrite else filesystem(f"{self.job}/ready")[1]
        system.create_dir(ready, recursive=True)
        there = {f.base_name for f in system.get_file_info(fs.FileSelector(ready)) if f.type == fs.FileType.Directory} if self.deep else set()

        def move(of: str, to: str) -> None:
            list(pool.map(lambda f: system.move(f.path, f"{to}/{f.base_name}"), system.get_file_info(fs.FileSelector(of))))

        with ThreadPoolExecutor(16) as pool:
            for own in (filesystem(m.folder)[1] for m in messages if m is not None and m.folder):
                if not self.deep:
                    move(own, ready)
                    continue
                for part in system.get_file_info(fs.FileSelector(own)):
                    # write_files deals whole folders to tasks, so a new one is moved as it is
                    if part.base_name in there:
                        move(part.path, f"{ready}/{part.base_name}")
                    else:
                        system.move(part.path, f"{ready}/{part.base_name}")
                        there.add(part.base_name)
        if ready != target:
            if exists:
                system.delete_dir(target)
            system.move(ready, target)
        self._clear(system)

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear(filesystem(self.job)[0])

    def _clear(self, system) -> None:
        from pyarrow import fs

        job = filesystem(self.job)[1]
        if system.get_file_info(job).type != fs.FileType.NotFound:
            system.delete_dir(job)


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docketry-files"

    def schema(self) -> str:
        return "name string, block string"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if [f.dataType.simpleString() for f in schema.fields] != ["string", "string"]:
            raise ValueError("rows are (name string, block string)")
        if not self.options.get("path"):
            raise ValueError("save() needs a folder")
        return FilesWriter(self.options["path"], overwrite, self.options.get("deep", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship(spark)
    spark.dataSource.register(FilesSource)


def numbered_names(rows: DataFrame, name: Column, suffix: str, order: list[Column | str]) -> DataFrame:
    """rows with file: name and suffix, with a number from the second of a name on, in the given order. A name can have any share of the rows."""
    own = numbered(rows.withColumn("_name", name), order, "_n", within=["_name"])
    return own.withColumn("file", F.concat("_name", F.when(F.col("_n") > 1, F.concat(F.lit("_"), F.col("_n").cast("string"))).otherwise(""), F.lit(suffix))).drop("_name", "_n")


def write_files(blocks: DataFrame, folder: str, order: list[Column | str] = (), mode: str = "append", deep: bool = False) -> None:
    """Write (name, block) rows: a file a name, its blocks in the order of the given columns. deep: in FOLDERS folders, for files of any number."""
    spark = blocks.sparkSession
    register(spark)
    place = F.crc32(F.col("name").cast("binary")) % FOLDERS if deep else F.col("name")
    keys = [place, F.col("name"), *(F.col(c) if isinstance(c, str) else c for c in order)]
    dealt = blocks.filter("name is not null").repartition(place).sortWithinPartitions(*keys).select("name", "block")
    dealt.write.format("docketry-files").option("deep", str(deep).lower()).mode(mode).save(folder)


def read_files(spark: SparkSession, folder: str, deep: bool = False) -> DataFrame:
    """(name, content) of the files in a folder that write_files wrote; of a flat one Spark's reader leaves out files without bytes."""
    if deep:
        ship(spark)
        raw = spark.range(0, FOLDERS, 1, FOLDERS // TASK_FOLDERS).mapInArrow(_read(folder), "name string, content binary")
        return raw.select("name", F.col("content").cast("string").alias("content"))
    raw = spark.read.format("binaryFile").load(folder)
    return raw.select(F.substring_index("path", "/", -1).alias("name"), F.col("content").cast("string").alias("content"))


def _read(folder: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        system, top = filesystem(folder.rstrip("/"))
        names, contents, held = [], [], 0
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for f in system.get_file_info(fs.FileSelector(f"{top}/{i:03x}", allow_not_found=True)):
                    with system.open_input_stream(f.path) as own:
                        contents.append(own.read())
                    names.append(f.base_name)
                    held += f.size
                    if held >= BATCH_BYTES or len(names) >= BATCH_FILES:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])
                        names, contents, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])

    return run
