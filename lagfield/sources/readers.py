"""Scans: observation TSV, whitespace-delimited index files, saved splits."""

from __future__ import annotations

import bz2
import gzip
import io
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagfield.functions.timeops import day_of_year_timestamp, lenient_timestamp
from lagfield.functions.transforms import not_nan
from lagfield.operators.cleaning import keep_existing, sentinel_to_null
from lagfield.operators.bounded import settle
from lagfield.operators.keyed import first_per_key
from lagfield.schema import SCAN_MISSING, observation_schema


def scan_observations(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None
) -> DataFrame:
    """Tab-separated observations with a header; unparsable dates become null.

    Columns are bound by header name: the header of the file gives the order, the
    schema gives the types.
    """
    typed = {f.name: f.dataType for f in (schema or observation_schema()).fields}
    reader = spark.read.option("sep", "\t").option("header", True)
    header = reader.csv(path).columns  # names only; no inference pass
    layout = T.StructType([T.StructField(c, typed.get(c, T.StringType())) for c in header])
    df = reader.option("enforceSchema", False).option("nanValue", "NaN").schema(layout).csv(path)
    doubles = {c: not_nan(c) for c in header if isinstance(typed.get(c), T.DoubleType)}
    if "DateFormatted" in header:
        doubles["DateFormatted"] = lenient_timestamp("DateFormatted")
    return df.withColumns(doubles)


def _lines(spark: SparkSession, paths) -> DataFrame:
    """Whitespace tokens of each non-blank line, with its file and byte block.

    A file that breaks off gives the lines before that; ``damaged_files`` tells which do.
    """
    meta = F.col("_metadata")
    return (
        spark.read.option("ignoreCorruptFiles", True)
        .text(paths)
        .where(F.trim("value") != "")
        .select(
            F.split(F.trim("value"), r"\s+").alias("tokens"),
            F.is_valid_utf8("value").alias("legible"),
            meta["file_path"].alias("file"),
            meta["file_block_start"].alias("block"),
        )
    )


def split_fields(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """Tokens cast to double by position, a ``bad`` flag and a sortable position per line.

    A line is bad when a time field holds something that is no number, or when it
    has more tokens than fields. The running id keeps line order within a block; being
    in the same projection as the parsed numbers, it also keeps later filters above
    them, so that no line is tokenised or cast more than once.
    """
    number = {n: not_nan(F.get("tokens", F.lit(i)).try_cast("double")) for i, n in enumerate(names)}
    clock = [i for i, n in enumerate(names) if n in ("Year", "Day", "DOY", "Hour", "Minute")]
    bad = F.size("tokens") > len(names)
    for i in clock:
        token = F.get("tokens", F.lit(i))
        bad = bad | (token.isNotNull() & token.try_cast("double").isNull())
    position = F.struct(
        F.col("file").alias("f"), F.col("block").alias("b"), F.monotonically_increasing_id().alias("i")
    )
    return lines.select("file", "legible", position.alias("position"), bad.alias("bad"), *[v.alias(n) for n, v in number.items()])


# Bytes of a compressed file decompressed at a time.
PIECE = 1 << 20
_OPENERS = {".gz": gzip.open, ".bz2": bz2.open}


def _broken_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, reason) of the compressed files that cannot be decompressed to their end."""
    for batch in batches:
        files, reasons = [], []
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            opener = next(o for end, o in _OPENERS.items() if name.endswith(end))
            try:
                with opener(io.BytesIO(memoryview(content.as_buffer()))) as stream:
                    while stream.read(PIECE):
                        pass
            except (OSError, EOFError, zlib.error) as e:
                files.append(name)
                reasons.append(f"broken archive: {e}")
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(reasons, pa.string())], ["file", "reason"])


def damaged_files(spark: SparkSession, paths: str | Sequence[str], fields: Sequence[str]) -> tuple[DataFrame, int]:
    """((file, reason) of every file that cannot be used, number of all files); both computed once.

    What is listed is held against what was read: empty files, archives (gzip, bzip2) that break off or
    fail their checksum, files that give no line, files that are not UTF-8, and files with a line that
    cannot be parsed. One pass over the lines, and one over the bytes of compressed files.
    """
    name = F.col("_metadata.file_path").alias("file")
    files = spark.read.format("binaryFile").load(paths)
    # The listing that Spark has made, named as scans name files; scans leave empty files out.
    names = [n.replace("file:///", "file:/", 1) for n in files.inputFiles()]
    sizes = files.select(name, "length")
    archives = files.where(F.col("path").rlike(r"\.(gz|bz2)$") & (F.col("length") > 0)).select(name, "content")
    broken = archives.mapInArrow(_broken_archives, "file string, reason string")
    read = split_fields(_lines(spark, paths), fields).groupBy("file")
    read = read.agg(F.bool_or("bad").alias("bad"), F.bool_and("legible").alias("legible"), F.lit(True).alias("seen"))
    reason = (
        F.when(F.coalesce("length", F.lit(0)) == 0, F.lit("empty"))
        .when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("seen").isNull(), F.lit("no line could be read"))
        .when(~F.col("legible"), F.lit("not UTF-8"))
        .when(F.col("bad"), F.lit("a line that cannot be parsed"))
    )
    listed = spark.createDataFrame([(n,) for n in names], "file string").join(sizes, "file", "left")
    judged = listed.join(broken, "file", "left").join(read, "file", "left").select("file", reason.alias("reason"))
    return settle(judged.where("reason IS NOT NULL"), "damaged"), len(names)


def scan_index(
    spark: SparkSession,
    paths: str | Sequence[str],
    fields: Sequence[str],
    missing: Sequence[float] = (),
    skip_bad_files: bool = True,
) -> DataFrame:
    """Series ``(ts, values…)`` from headerless whitespace-delimited files.

    ``fields`` name the columns; those called Year, Day/DOY, Hour and Minute form
    the time, the rest are values. Rows without a complete time are dropped, listed
    placeholders become null, and the first row per instant in (file, line) order
    is kept. With ``skip_bad_files`` a damaged file is left out (see ``scan_index_reported``).
    """
    if skip_bad_files:
        return scan_index_reported(spark, paths, fields, missing)[0]
    return series_from_lines(split_fields(_lines(spark, paths), fields), fields, missing)


def scan_index_reported(
    spark: SparkSession, paths: str | Sequence[str], fields: Sequence[str], missing: Sequence[float] = ()
) -> tuple[DataFrame, DataFrame]:
    """(series of the files that can be used, (file, reason) of the others). Fails when none can."""
    damaged, files = damaged_files(spark, paths, fields)
    bad = damaged.count()
    if bad == files:
        found = "; ".join(f"{r.file}: {r.reason}" for r in damaged.limit(5).collect())
        raise ValueError(f"no input file could be parsed: {found}")
    lines = _lines(spark, paths)
    good = lines.join(damaged.select("file"), "file", "left_anti") if bad else lines
    return series_from_lines(split_fields(good, fields), fields, missing), damaged


def series_from_lines(parsed: DataFrame, fields: Sequence[str], missing: Sequence[float] = ()) -> DataFrame:
    clock = [f for f in fields if f in ("Year", "Day", "DOY", "Hour", "Minute")]
    values = [f for f in fields if f not in clock]
    doy = "DOY" if "DOY" in fields else "Day"
    ts = day_of_year_timestamp("Year", doy, "Hour", "Minute" if "Minute" in fields else None)
    rows = parsed.na.drop(subset=clock).select(
        "position", ts.alias("ts"), *[_clean(v, missing).alias(v) for v in values]
    )
    return first_per_key(rows.where(F.col("ts").isNotNull()), ["ts"], F.col("position"), values)


def _clean(name: str, missing: Sequence[float]) -> Column:
    return sentinel_to_null(name, missing) if missing else F.col(name)


def scan_minute_indices(spark, paths, mask: bool = False, skip_bad_files: bool = True) -> DataFrame:
    """Minute series of AL and SYM-H."""
    fields = ("Year", "Day", "Hour", "Minute", "AL_index", "SYM_H")
    return scan_index(spark, paths, fields, SCAN_MISSING if mask else (), skip_bad_files)


def scan_flux(spark, paths, mask: bool = False, skip_bad_files: bool = True) -> DataFrame:
    """Hourly series of F10.7."""
    return scan_index(
        spark, paths, ("Year", "Day", "Hour", "f107_index"), (999.9,) if mask else (), skip_bad_files
    )


def scan_kp(spark, paths, mask: bool = False, skip_bad_files: bool = True) -> DataFrame:
    """Hourly series of Kp."""
    return scan_index(
        spark, paths, ("Year", "DOY", "Hour", "Kp_index"), (99.9,) if mask else (), skip_bad_files
    )


def inventory(spark: SparkSession, sources: dict[str, str | Sequence[str]]) -> DataFrame:
    """(source, files, bytes) for each named path or glob; FileNotFoundError if empty.

    Only the listing is read: the file content column is pruned.
    """
    parts = []
    for name, path in sources.items():
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        except AnalysisException as e:
            raise FileNotFoundError(f"{name}: nothing at {path}") from e
        parts.append(files.select(F.lit(name).alias("source"), "length"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    counts = found.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    seen = {r.source for r in counts.collect()}  # one row per named source
    absent = set(sources) - seen
    if absent:
        raise FileNotFoundError(f"no files for {sorted(absent)}")
    return counts


def load_split(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One saved split; optionally only the wanted columns that exist."""
    df = spark.read.parquet(path)
    return keep_existing(df, columns)[0] if columns else df


def _unreadable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, reason) of the Parquet files of which not every column can be read."""
    import pyarrow.parquet as pq

    for batch in batches:
        files, reasons = [], []
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            try:
                for _ in pq.ParquetFile(pa.BufferReader(content.as_buffer())).iter_batches():
                    pass
            except (pa.ArrowException, OSError) as e:
                files.append(name)
                reasons.append(f"unreadable: {str(e).splitlines()[0][:200]}")
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(reasons, pa.string())], ["file", "reason"])


def skipped_files(spark: SparkSession, base: str) -> DataFrame:
    """(file, reason) of the Parquet files below ``base`` that ``load_all`` takes no row from though they should have some.

    Files that gave a row are good; only those that did not are opened one by one.
    """
    seen = _all_files(spark, base).select(F.col("_metadata.file_path").alias("file")).distinct()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    name = F.col("_metadata.file_path").alias("file")
    silent = [r.file for r in files.load(base).select(name).join(seen, "file", "left_anti").collect()]  # names only
    if not silent:
        return spark.createDataFrame([], "file string, reason string")
    opened = spark.read.format("binaryFile").load(silent).select(name, "content")
    return opened.mapInArrow(_unreadable, "file string, reason string")


def load_all(spark: SparkSession, base: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Every Parquet file below ``base`` as one table; unreadable files are skipped (``skipped_files``
    names them), columns absent from some files are null there."""
    df = _all_files(spark, base)
    return keep_existing(df, columns)[0] if columns else df


def _all_files(spark: SparkSession, base: str) -> DataFrame:
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("mergeSchema", True)
        .option("ignoreCorruptFiles", True)
        .option("pathGlobFilter", "*.parquet")
        .parquet(base)
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
