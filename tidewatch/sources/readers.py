"""Sources and sinks (S rows of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import LABEL, TIME, Dataset, nan_to_null

NO_DATA = -99999.0


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema=None, **options) -> DataFrame:
    """A table of any Spark format, NaN turned to NULL."""
    reader = spark.read.format(format).options(**options)
    return nan_to_null((reader.schema(schema) if schema else reader).load(path))


def labelled(df: DataFrame, label: str, time: str, values: dict[str, str], errors: dict[str, str] | None = None, meta: DataFrame | None = None) -> Dataset:
    """A Dataset from columns of a table: new name to source column."""
    columns = [F.col(label).cast("string").alias(LABEL), F.col(time).alias(TIME)]
    columns += [F.col(c).cast("double").alias(n) for n, c in (values | (errors or {})).items()]
    return Dataset.of(df.select(*columns), values, errors or {}, meta)


def read_points(spark: SparkSession, path: str, lon_index: int = 0, lat_index: int = 1, others: tuple[int, ...] = ()) -> DataFrame:
    """lon, lat and further columns of a CSV with a header, picked by place."""
    df = spark.read.csv(path, header=True)
    picked = [F.col(f"`{df.columns[lon_index]}`").cast("double").alias("lon"), F.col(f"`{df.columns[lat_index]}`").cast("double").alias("lat")]
    return df.select(*picked, *[F.col(f"`{df.columns[k]}`") for k in others])


def raster_values(cells: DataFrame, no_data: float = NO_DATA, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Stored cell values as numbers: no-data to NULL, then scale and offset."""
    return cells.withColumn("value", F.when(F.col("value") != no_data, F.col("value") * scale + offset))


def geotransform(lon_min: float, lat_max: float, pixel: float) -> tuple[float, float, float, float, float, float]:
    return lon_min, pixel, 0.0, lat_max, 0.0, -pixel


def raster_extent(transform: tuple, height: int, width: int) -> tuple[float, float, float, float]:
    """West, east, south, north."""
    x0, dx, _, y0, _, dy = transform
    return x0, x0 + dx * width, y0 + dy * height, y0


def place_cells(cells: DataFrame, transform: tuple) -> DataFrame:
    """lon and lat of the centres of cells (j, i)."""
    x0, dx, _, y0, _, dy = transform
    return cells.withColumns({"lon": x0 + (F.col("i") + 0.5) * dx, "lat": y0 + (F.col("j") + 0.5) * dy})


def write_raster(cells: DataFrame, path: str, no_data: float = NO_DATA, scale: float = 1.0, offset: float = 0.0) -> None:
    """Cells (raster_id, band, j, i, value) as Parquet by raster and band, with no-data for NULL."""
    stored = cells.withColumn("value", F.coalesce((F.col("value") - offset) / scale, F.lit(no_data)))
    stored.write.mode("error").partitionBy("raster_id", "band").parquet(path)


def field_values(features: DataFrame, name: str, unique: bool = False) -> DataFrame:
    """A field of a feature table; sorted distinct values on request."""
    values = features.select(F.col("fields")[name].alias(name))
    return values.distinct().orderBy(name) if unique else values


def field_names(features: DataFrame) -> DataFrame:
    return features.select(F.explode(F.map_keys("fields")).alias("field")).distinct().orderBy("field")


def save_run(images: DataFrame, folder: str, run_id: int, data_type: str | None = None) -> str:
    """Images of a run in a new folder ``run_000000``; fails where it exists."""
    out = images.withColumn("pixels", F.col("pixels").cast(f"array<{data_type}>")) if data_type else images
    path = f"{folder.rstrip('/')}/run_{run_id:06d}"
    out.write.mode("error").parquet(path)
    return path


def linked(spark: SparkSession, folders: list[str]) -> DataFrame:
    """One view over the saved runs of several folders, with the file each row comes from."""
    return spark.read.option("recursiveFileLookup", "true").parquet(*sorted(folders)).withColumn("saved_in", F.input_file_name())


def write_paths(paths: DataFrame, path: str) -> None:
    """Rows of arrays and structs as CSV of JSON columns."""
    paths.select(*[F.to_json(F.struct(F.col(c).alias("v"))).alias(c) for c in paths.columns]).write.mode("error").csv(path, header=True, escape='"')


def read_paths(spark: SparkSession, path: str, schema: dict[str, str]) -> DataFrame:
    raw = spark.read.csv(path, header=True, escape='"')
    return raw.select(*[F.from_json(c, f"v {kind}")["v"].alias(c) for c, kind in schema.items()])


def snapshot(data: Dataset, name: str, whole: bool = False) -> Dataset:
    """Publish the present data under a name; frames don't change, so a reference is a copy."""
    out = data.with_result(name, data.df)
    return out.with_result(f"{name}.meta", data.meta) if whole and data.meta is not None else out


def constant_result(data: Dataset, name: str, rows: list, schema: str) -> Dataset:
    return data.with_result(name, data.df.sparkSession.createDataFrame(rows, schema))


def stitch_days(days: dict[str, DataFrame], south: float, north: float, west: float, east: float) -> DataFrame:
    """Observations of several days inside a box, with the day they come from."""
    out = None
    for name, df in days.items():
        part = df.where((F.col("pplat") >= south) & (F.col("pplat") <= north) & (F.col("pplon") >= west) & (F.col("pplon") <= east)).withColumn("day", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
