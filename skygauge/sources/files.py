"""Station files: CSV folders, station list, images, archive rows and exports."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge.functions.text import calendar_id, clean_header, station_name
from skygauge.operators.cleaning import clean_headers, to_double
from skygauge.session import land

# Raw headers of a yearly station file and its mark for a missing cell.
RAW_HEADERS = {
    "date": "Date",
    "highest_30_min_rainfall_mm": "Highest 30 Min Rainfall (mm)",
    "highest_60_min_rainfall_mm": "Highest 60 Min Rainfall (mm)",
    "highest_120_min_rainfall_mm": "Highest 120 Min Rainfall (mm)",
    "mean_temperature_c": "Mean Temperature (°C)",
    "maximum_temperature_c": "Maximum Temperature (°C)",
    "minimum_temperature_c": "Minimum Temperature (°C)",
    "mean_wind_speed_kmh": "Mean Wind Speed (km/h)",
    "max_wind_speed_kmh": "Max Wind Speed (km/h)",
}
MISSING_MARK = ""
ARCHIVE_COLUMNS = ("date", *[c for c in RAW_HEADERS if c != "date"], "location", "daily_rainfall_total_mm")


def file_stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)


def folder_name() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)


def _need_files(read):
    """Run a reader; a folder without files becomes FileNotFoundError."""
    try:
        return read()
    except AnalysisException as e:
        raise FileNotFoundError("No CSV files found") from e


def read_station_csv(spark: SparkSession, path: str | Sequence[str], **ids: Column) -> DataFrame:
    """Files of one header as text columns with clean names; ``ids`` are file-derived columns.

    A file whose header has other names or another order fails the read; ``concat_folder`` reads by name.
    """
    raw = _need_files(lambda: spark.read.option("header", True).option("enforceSchema", False).option("recursiveFileLookup", True)
                      .option("pathGlobFilter", "*.csv").csv(path))
    if not raw.columns:
        raise FileNotFoundError("No CSV files found")
    data = [F.col(f"`{c}`").alias(clean_header(c)) for c in raw.columns]
    return raw.select(*data, *[c.alias(n) for n, c in ids.items()])


def file_lines(spark: SparkSession, path: str | Sequence[str], **ids: Column) -> DataFrame:
    """Lines of every CSV below ``path``: file, start (of the file's block), value and file-derived columns."""
    lines = _need_files(lambda: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", *[c.alias(n) for n, c in ids.items()])


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Lines as fields: the given columns but ``value``, then header (the file's first line) and fields (null in the header's own row).

    Lines of a block arrive in their order, so the first line of a file's first block is its header and is
    carried along; rows of later blocks of a long file have a null header, to be looked up by file.
    Quotes are honoured within a line; empty lines are left out.
    """
    kept = [c for c in lines.columns if c != "value"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, start, header = None, None, None
        for pdf in batches:
            heads, fields, keep = [], [], []
            for i, (f, at, line) in enumerate(zip(pdf.file, pdf.start, pdf.value)):
                first = (f, at) != (file, start)
                if first:
                    file, start = f, at
                    header = line if at == 0 else None
                if not line and not (first and at == 0):
                    continue
                keep.append(i)
                heads.append(header)
                fields.append(None if first and at == 0 else next(csv.reader([line])))
            yield pdf.iloc[keep][kept].assign(header=heads, fields=fields)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.select(*kept).schema.fields)
    return lines.mapInPandas(parse, f"{types}, header string, fields array<string>")


def header_names(header: str) -> list[str]:
    """Clean column names of a header line."""
    return [clean_header(c) for c in next(csv.reader([header]), [])]


def header_audit(spark: SparkSession, path: str) -> DataFrame:
    """``file, columns``: every file with its set of stripped column names."""
    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"file": pdf.file, "columns": [sorted(c.strip() for c in next(csv.reader([h]), [])) for h in pdf.header]})

    heads = parsed_lines(file_lines(spark, path)).filter("fields is null")
    return heads.select("file", "header").mapInPandas(names, "file string, columns array<string>")


def header_counts(audit: DataFrame) -> DataFrame:
    """Number of files per set of column names; more than one row means the headers differ."""
    return audit.groupBy("columns").agg(F.count(F.lit(1)).alias("n_files"), F.min("file").alias("example"))


def concat_folder(spark: SparkSession, path: str | Sequence[str], output_dir: str | None = None, **ids: Column) -> DataFrame:
    """All CSVs below a folder, columns matched by name, file ids added.

    The files are read once: their lines are parsed and written as (header, fields), and each row is
    then projected by the place its own header gives to a column. Only the distinct headers, a few
    for any number of files, come to the driver. Columns stand in the order in which the headers, sorted, name them; a file without a
    column gives nulls, a name that a header has twice counts where it stands first.
    """
    ids = ids or {"csv_files": file_stem()}
    rows = land(parsed_lines(file_lines(spark, path, **ids)), "lines")
    heads = rows.filter("fields is null").select("file", F.col("header").alias("own"))
    headers = [r[0] for r in heads.select("own").distinct().orderBy("own").collect()]
    if not headers:
        raise FileNotFoundError("No CSV files found")
    names = list(dict.fromkeys(c for h in headers for c in header_names(h) if c not in ids))
    places = [(h, [own.index(c) if c in own else None for c in names]) for h, own in ((h, header_names(h)) for h in headers)]
    data = rows.filter("fields is not null")
    later = data.filter("header is null").drop("header").join(heads, "file").withColumnRenamed("own", "header")
    known = data.filter("header is not null").unionByName(later)
    placed = known.join(F.broadcast(spark.createDataFrame(places, "header string, places array<int>")), "header")  # one row per distinct header
    # an empty cell is a missing one, as in Spark's own CSV reader
    cell = lambda i: F.nullif(F.get("fields", F.get("places", F.lit(i))), F.lit(""))
    out = placed.select(*[cell(i).alias(c) for i, c in enumerate(names)], *ids)
    if output_dir:
        out.write.mode("overwrite").option("header", True).csv(output_dir)
    return out


def concat_stations(spark: SparkSession, root: str) -> DataFrame:
    """Station folders in one scan: ``csv_files`` from the file, ``location`` from its folder."""
    return concat_folder(spark, root, csv_files=file_stem(), location=folder_name())


def count_rows(spark: SparkSession, root: str) -> DataFrame:
    """Data rows per folder; the order of a file's columns does not matter."""
    lines = parsed_lines(file_lines(spark, root, location=folder_name()))
    return lines.groupBy("location").agg(F.count("fields").alias("n"))


def sample_file(spark: SparkSession, root: str, seed: int = 0) -> DataFrame:
    """Rows of one file drawn by seed, with location from the folder and year from the file name."""
    files = file_lines(spark, root).select("file").distinct()
    one = files.orderBy(F.xxhash64(F.regexp_extract("file", r"([^/]+/[^/]+)$", 1), F.lit(seed)), "file").first()
    if one is None:
        raise FileNotFoundError("No CSV files found")
    year = F.coalesce(F.nullif(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4})", 1), F.lit("")), F.lit("unknown"))
    return read_station_csv(spark, one[0], location=folder_name(), year=year)


def read_stations(spark: SparkSession, path: str, one_array: bool = True) -> DataFrame:
    """Station list: one JSON array per file, or one object per line."""
    return spark.read.option("multiLine", one_array).schema(
        "station_code string, station_name string, latitude double, longitude double").json(path)


def load_training(spark: SparkSession, path: str, numeric: Sequence[str]) -> DataFrame:
    """Station rows with a parsed date and numbers, columns by name; fails when the folder is absent."""
    raw = concat_folder(spark, path).drop("csv_files")
    return raw.withColumn("date", F.col("date").try_cast("date")).withColumns({c: to_double(c) for c in numeric})


def normalize_archive(df: DataFrame, station: str | Column | None = None) -> DataFrame:
    """Monthly archive rows: date from year, month, day; clean station name; fixed columns."""
    out = clean_headers(df)
    name = F.lit(station) if isinstance(station, str) else station if station is not None else F.col("location")
    out = out.withColumns({
        "date": F.make_date(*[F.col(c).cast("int") for c in ("year", "month", "day")]), "location": station_name(name)})
    missing = [c for c in ARCHIVE_COLUMNS if c not in out.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}. Got: {out.columns}")
    return out.select(*ARCHIVE_COLUMNS)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def submission(df: DataFrame, pred: str = "prediksi") -> DataFrame:
    """Export rows: id, year, month, day and the clipped prediction."""
    return df.select(
        calendar_id(F.col("location"), F.col("date")).alias("ID (kota)"), F.year("date").alias("tahun"),
        F.month("date").alias("bulan"), F.dayofmonth("date").alias("hari"),
        F.greatest(F.col(pred), F.lit(0.0)).alias("prediksi"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``plot_id, origin`` and image fields; unreadable files are dropped by the source."""
    img = spark.read.format("image").option("dropInvalid", True).load(path)
    stem = F.regexp_extract("image.origin", r"([^/]+?)(\.[^./]*)?$", 1)
    return img.select(stem.alias("plot_id"), "image.*")


def failed_images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """Files of the folder that the image source could not read."""
    every = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    good = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(path)
    return every.join(good.select(F.regexp_extract("image.origin", r"([^/]+)$", 1).alias("file")), "file", "left_anti")


def image_size_stats(images: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    dims = {"height": "h", "width": "w", "nChannels": "c"}
    aggs = [f(c).alias(f"{p}_{s}") for c, s in dims.items() for f, p in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    out = images.agg(F.count(F.lit(1)).alias("n_images"), *aggs)
    n_failed = failed.agg(F.count(F.lit(1)).alias("n")).scalar() if failed is not None else F.lit(0)
    return out.withColumn("n_failed", n_failed)


def image_pixels(images: DataFrame, rgb: tuple[int, int, int] | None = None, tolerance: int = 5) -> DataFrame:
    """Pixels of images as rows; with ``rgb`` only those near the colour leave the task."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels).astype(np.int16)
                bgr = a[:, :, :3] if r.nChannels >= 3 else np.repeat(a[:, :, :1], 3, axis=2)
                keep = np.ones(bgr.shape[:2], bool)
                if rgb is not None:
                    keep = (np.abs(bgr - np.array(rgb[::-1], np.int16)) <= tolerance).all(axis=2)
                y, x = np.nonzero(keep)
                p = bgr[y, x]
                yield pd.DataFrame({"plot_id": r.plot_id, "x": x, "y": y, "r": p[:, 2], "g": p[:, 1], "b": p[:, 0]})

    return images.select("plot_id", "height", "width", "nChannels", "data").mapInPandas(
        explode, "plot_id string, x int, y int, r int, g int, b int")
