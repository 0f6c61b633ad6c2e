"""Folders of files, listed in parallel, empty files too, and scanned again only where they changed.

Spark's own file reader leaves out empty files, and it cannot read a chosen few of a folder's
files without a list on the driver. Here a data source lists the folder, one task per
subfolder, and tasks load the files whose rows are left. Any store that Arrow reaches
by its address will do (local or mounted folders, HDFS, S3, Google's).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import spread

FORMAT = "leaksieve_files"
LISTED = "path string, modificationTime timestamp, length bigint"
#: Subfolders that listing is split into, and bytes of files that a task holds at once.
PARTS, BATCH_BYTES = 64, 32 << 20


def _store():
    """Address to store and path; defined inside, so that it travels with what uses it."""

    def store(address: str):
        from pyarrow import fs

        if address.startswith("file:"):
            address = "/" + address[5:].lstrip("/")
        return fs.FileSystem.from_uri(address)

    return store


def _listing_source():
    """The data source; a class made here travels whole to workers that have no such package."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    store, called, schema_, parts = _store(), FORMAT, LISTED, PARTS

    class Part(InputPartition):
        def __init__(self, folder: str, deep: bool):
            super().__init__((folder, deep))

    class Reader(DataSourceReader):
        def __init__(self, folder: str):
            self.folder = folder

        def _inside(self, path: str, deep: bool):
            from pyarrow import fs

            return store(self.folder)[0].get_file_info(fs.FileSelector(path, recursive=deep))

        @staticmethod
        def _shown(path: str, top: str) -> bool:
            return not any(name[:1] in ("_", ".") for name in path[len(top) :].split("/"))

        def partitions(self):
            """Level by level until there are enough subfolders; what lies above them is listed flat."""
            from pyarrow import fs

            flat, open_ = [], [store(self.folder)[1]]
            while open_ and len(open_) < parts:
                below = [i.path for p in open_ for i in self._inside(p, False) if i.type == fs.FileType.Directory]
                flat += open_
                open_ = below
            return [Part(p, False) for p in flat] + [Part(p, True) for p in open_]

        def read(self, partition):
            import pyarrow as pa
            from pyarrow import fs

            path, deep = partition.value
            top = store(self.folder)[1].rstrip("/") + "/"
            found = [i for i in self._inside(path, deep) if i.type == fs.FileType.File and self._shown(i.path, top)]
            prefix = self.folder.rstrip("/")
            for a in range(0, len(found), 10_000):
                some = found[a : a + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{prefix}/{i.path[len(top):]}" for i in some], pa.string()),
                        pa.array([(i.mtime_ns or 0) // 1000 for i in some], pa.timestamp("us", tz="UTC")),
                        pa.array([i.size for i in some], pa.int64()),
                    ],
                    ["path", "modificationTime", "length"],
                )

    class Listing(DataSource):
        @classmethod
        def name(cls):
            return called

        def schema(self):
            return schema_

        def reader(self, schema):
            return Reader(self.options["path"])

    return Listing


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every file under a folder: ``path, modificationTime, length``, empty ones too.

    Names that begin with ``_`` or ``.`` are passed over, as Spark does. The driver looks at
    folders only until there are enough to share out; tasks list these.
    """
    spark.dataSource.register(_listing_source())
    return spark.read.format(FORMAT).load(folder)


def load_files(listed: DataFrame, max_bytes: int | None = None, partitions: int | str | None = None) -> DataFrame:
    """The files of listed rows as ``filename, size_bytes, content, path``, as ``read_files`` gives them.

    Files of more than ``max_bytes`` are not loaded, nor are files that have gone since; their
    content is null, of which ``extract_text`` makes an error. ``partitions`` deals the rows out,
    see ``spread``. A task holds about 32 MB of files at once, or one file if that is larger.
    """
    store, batch_bytes = _store(), BATCH_BYTES

    def loaded(batches):
        import pyarrow as pa

        def content(path, length):
            if max_bytes is not None and length > max_bytes:
                return None
            files, inner = store(path)
            try:
                with files.open_input_stream(inner) as data:
                    return data.read()
            except FileNotFoundError:
                return None

        def batch(rows):
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(columns, ["filename", "size_bytes", "content", "path"])

        for found in batches:
            rows, held = [], 0
            for path, length in zip(found.column("path").to_pylist(), found.column("length").to_pylist()):
                if rows and held + length > batch_bytes:
                    yield batch(rows)
                    rows, held = [], 0
                rows.append((path.rsplit("/", 1)[-1], length, content(path, length), path))
                held += length
            if rows:
                yield batch(rows)

    dealt = spread(listed.select("path", "length"), partitions)
    return dealt.mapInArrow(loaded, "filename string, size_bytes bigint, content binary, path string")


_ID = ("path", "modificationTime", "length")


def unseen(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """The listed files that a manifest does not have with this time and length: new or changed ones."""
    return listed.join(manifest.select(*_ID).distinct(), list(_ID), "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{schema}, run int")
    return spark.read.schema(f"{schema}, run int").parquet(path)


def update(
    spark: SparkSession,
    folder: str,
    state: str,
    process: Callable[[DataFrame], DataFrame],
    max_bytes: int | None = None,
    partitions: int | str | None = None,
) -> int:
    """Processes the files that are new or changed since the last run; returns the run's number.

    ``process`` gets rows as of ``load_files`` and must keep ``path``. Under ``state``, which
    all executors must reach, lie the ``manifest`` (path, time, length), the ``results`` and the
    ``pending`` list, one folder per run. The list of files is written first and read back, so
    that files which arrive meanwhile wait for the next run. The manifest is written last, and a
    run that broke off has the same number when it is made again: it replaces what it had
    written, so no file is missed and none counts twice. A run that finds nothing leaves its
    number to the next.
    """
    manifest = _runs(spark, f"{state}/manifest", LISTED)
    run = (manifest.agg(F.max("run")).first()[0] or 0) + 1
    pending_path = f"{state}/pending/run={run}"
    unseen(list_files(spark, folder), manifest).write.mode("overwrite").parquet(pending_path)
    pending = spark.read.schema(LISTED).parquet(pending_path)
    process(load_files(pending, max_bytes, partitions)).write.mode("overwrite").parquet(f"{state}/results/run={run}")
    pending.write.mode("overwrite").parquet(f"{state}/manifest/run={run}")
    return run


def current(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """The latest results of the files that are in the folder now, as a run over all of them would give.

    Each file's latest finished run counts; results of older versions and of files that have
    gone are left out.
    """
    manifest = _runs(spark, f"{state}/manifest", LISTED)
    latest = manifest.groupBy("path").agg(F.max("run").alias("run"))
    there = list_files(spark, folder).select("path")
    results = spark.read.parquet(f"{state}/results")
    return results.join(latest.join(there, "path", "left_semi"), ["path", "run"], "left_semi").drop("run")



def save_files(files: DataFrame, folder: str) -> int:
    """Writes rows of ``path`` (below the folder) and ``content`` as files, by tasks; returns how many.

    A null content is an empty file. A task that is made again writes the same files again.
    """
    store = _store()

    def saved(batches):
        import pyarrow as pa

        target, top = store(folder)
        for found in batches:
            for path, content in zip(found.column("path").to_pylist(), found.column("content").to_pylist()):
                place = f"{top.rstrip('/')}/{path}"
                target.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with target.open_output_stream(place) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([found.num_rows], pa.int64())], ["n"])

    done = files.select("path", "content").mapInArrow(saved, "n bigint")
    return done.agg(F.sum("n")).first()[0] or 0
