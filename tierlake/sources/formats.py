"""Sources and sinks: JSON lines, positional lines, compressed manifests, versioned and append-only tables."""

from __future__ import annotations

import hashlib
import json
from collections import Counter

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Refused(ValueError):
    """An input that must not be read any further."""


def read_json_lines(spark: SparkSession, path: str, schema: str, *, strict: bool = True) -> DataFrame:
    """JSON lines with an explicit schema. ``strict`` fails on the first line that is no JSON object; else such lines are skipped. Blank lines are no lines."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    fields = T._parse_datatype_string(schema).add("_corrupt", T.StringType())
    parsed = lines.select("value", F.from_json("value", fields, {"columnNameOfCorruptRecord": "_corrupt"}).alias("j"))
    bad = F.col("j._corrupt").isNotNull() | F.col("j").isNull() | ~F.ltrim("value").startswith("{")
    names = [f.name for f in fields if f.name != "_corrupt"]
    if strict:
        checked = F.when(bad, F.raise_error(F.concat(F.lit("not a JSON object: "), F.left("value", F.lit(80))))).otherwise(F.col("j"))
        return parsed.select(checked.alias("j")).select(*(F.col(f"j.{n}").alias(n) for n in names))
    return parsed.where(~bad).select(*(F.col(f"j.{n}").alias(n) for n in names))


def read_positional(spark: SparkSession, path: str, names: list[str], *, comment: str = "#") -> DataFrame:
    """Tab-separated lines with exactly as many fields as ``names``; comments and ragged lines are left out. Empty fields are empty texts."""
    lines = spark.read.text(path).where(~F.col("value").startswith(comment)).select(F.split("value", "\t", -1).alias("f"))
    return lines.where(F.size("f") == len(names)).select(*(F.col("f")[i].alias(n) for i, n in enumerate(names)))


def list_sources(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, source_bytes, source_changed) of the files in a folder; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("source_path"), F.col("length").alias("source_bytes"), F.col("modificationTime").alias("source_changed"))


def _plain_path(uri: Column) -> Column:
    """A file's URI as the file listing names it: not escaped, one slash after the scheme of a local file."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def read_manifests(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Compressed JSON-line manifests (a folder or files) with where each row comes from: source_path, source_bytes, source_changed."""
    lines = spark.read.text(path).select("value", _plain_path(F.col("_metadata.file_path")).alias("source_path"), F.col("_metadata.file_size").alias("source_bytes"), F.col("_metadata.file_modification_time").alias("source_changed"))
    parsed = lines.where(F.trim("value") != "").select("source_path", "source_bytes", "source_changed", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("j"))
    return parsed.select("source_path", "source_bytes", "source_changed", "j.*")


def changed_sources(now: DataFrame, before: DataFrame) -> DataFrame:
    """(source_path, status): sources to read again (``new``, ``changed``) or to drop (``vanished``), by size and time of change; both sides one row a source."""
    stat = lambda df, n: df.select("source_path", F.struct("source_bytes", "source_changed").alias(n))
    j = stat(now, "a").join(stat(before, "b"), "source_path", "full")
    status = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "vanished").when(F.col("a") != F.col("b"), "changed")
    return j.select("source_path", status.alias("status")).where("status is not null")


def ingest_manifests(spark: SparkSession, path: str, root: str, schema: str) -> dict[str, int]:
    """Bring the table of manifest rows at ``root`` up to date with a folder; number of sources by status.

    Files are listed without being opened and compared by size and time with the list kept of the last ingest
    (``root``/sources, a versioned table of one row a file); only new and changed ones are read. Each source's rows are a
    partition of the table, so changed sources are overwritten, vanished ones dropped, and the others stay as they are.
    The list is swapped last: an ingest that was cut off is done again. The paths of changed files reach the driver.
    """
    now = list_sources(spark, path)
    kept = read_version(spark, f"{root}/sources").drop("folder") if current_version(spark, f"{root}/sources") else now.limit(0)
    status = {r["source_path"]: r["status"] for r in changed_sources(now, kept).collect()}
    folder = F.sha2(F.col("source_path"), 256)  # of a source in the table
    fresh = sorted(p for p, s in status.items() if s != "vanished")
    if fresh:
        rows = read_manifests(spark, fresh, schema).withColumn("folder", folder)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(f"{root}/rows")
        filled = {r[0] for r in rows.select("source_path").distinct().collect()}
    else:
        filled = set()
    for p in status:  # a source that vanished, or holds no row any more
        if status[p] == "vanished" or p not in filled:
            fs, at = path_of(spark, f"{root}/rows/folder={hashlib.sha256(p.encode()).hexdigest()}")
            fs.delete(at, True)
    if status:
        write_version(now.withColumn("folder", folder), f"{root}/sources")
    return dict(Counter(status.values()))


def path_of(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _pointer(spark: SparkSession, root: str) -> list[str]:
    fs, pointer = path_of(spark, f"{root}/CURRENT")
    return [r[0] for r in spark.read.text(f"{root}/CURRENT", wholetext=True).collect()[:1]][0].split("\n") if fs.exists(pointer) else []


def current_version(spark: SparkSession, root: str) -> int | None:
    """The version a table's pointer names; None before the first write."""
    said = _pointer(spark, root)
    return int(said[0]) if said else None


def version_note(spark: SparkSession, root: str) -> str:
    """What was noted with the current version; empty if nothing."""
    return "\n".join(_pointer(spark, root)[1:])


def write_version(df: DataFrame, root: str, note: str = "") -> int:
    """Write a whole new version, then swap the pointer by a rename: readers see the old table or the new one.

    The number of the version is claimed by a file that only one writer can create, and the pointer is swapped only if
    it still names the version the write began with: of two writers at a time the later is refused, and none overwrites
    the other's files. ``note`` is kept with the pointer.
    """
    spark = df.sparkSession
    base = current_version(spark, root) or 0
    version = base + 1
    while not create_new(spark, f"{root}/.CLAIM.{version:06d}"):
        version += 1
    df.write.mode("errorifexists").parquet(f"{root}/v{version:06d}")
    fs, new = path_of(spark, f"{root}/.CURRENT.{version}")
    out = fs.create(new, True)
    out.write(bytearray(f"{version}\n{note}" if note else str(version), "utf-8"))
    out.close()
    if (current_version(spark, root) or 0) != base:
        raise Refused(f"{root} was changed by another writer since version {base}")
    fs_api = spark.sparkContext._jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(fs_api.Options.Rename, 1)
    overwrite[0] = fs_api.Options.Rename.OVERWRITE
    fs_api.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, fs_api.Path(f"{root}/CURRENT"), overwrite)
    return version


def create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is there already."""
    fs, p = path_of(spark, path)
    try:
        return fs.createNewFile(p)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of a table, by default the current one."""
    version = version or current_version(spark, root)
    if version is None:
        raise Refused(f"{root} has no version")
    return spark.read.parquet(f"{root}/v{version:06d}")


def complete_folders(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(name, bytes) of the folders in ``root`` that were written to the end, by name."""
    fs, p = path_of(spark, root)
    if not fs.exists(p):
        return []
    found = [x.getPath() for x in fs.listStatus(p) if x.isDirectory()]
    done = [x for x in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted((x.getName(), fs.getContentSummary(x).getLength()) for x in done)


def append_rows(df: DataFrame, path: str, batch: int) -> None:
    """Append with an explicit sequence: files have no order in Spark."""
    df.withColumn("ingest_batch", F.lit(batch).cast("long")).write.mode("append").parquet(path)


def canonical_json(columns: list[str]) -> Column:
    """Rows as JSON with sorted keys, nulls kept and no blanks."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def export_lines(df: DataFrame, path: str, order: str) -> None:
    """All rows as canonical JSON lines, sorted by ``order`` across the numbered files."""
    df.repartitionByRange(order).sortWithinPartitions(order).select(canonical_json(df.columns).alias("value")).write.mode("overwrite").text(path)


def dump_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Write the tables that are the authority; what can be derived from them is rebuilt on restore."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def restore_tables(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a dump; a missing one is refused."""
    for n in names:
        fs, p = path_of(spark, f"{root}/{n}/_SUCCESS")
        if not fs.exists(p):
            raise Refused(f"{n} is missing in {root}")
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}


def split_valid(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and the others with the names of those they fail; a check that is null fails."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    marked = df.withColumn("failed", failed)
    return marked.where(F.size("failed") == 0).drop("failed"), marked.where(F.size("failed") > 0)


def load_document(path: str, version: int) -> dict:
    """A small configuration document; another schema version is refused."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    if not isinstance(doc, dict) or doc.get("schema_version") != version:
        raise Refused(f"{path} is no document of schema version {version}")
    return doc
