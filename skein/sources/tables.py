"""Readers with fixed schemas: notes, sessions, observations, reports, spectra, and a union of whatever is present."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skein.operators.etl import union_sources

NOTES = "patient_id string, note_id string, note_type string, specialty string, age int, gender string, primary_diagnosis string, diagnosis string, text string, keywords string"
SESSIONS = "vignette_id string, patient_id string, specialty string, experience_group string, complexity string, n_queries int, pivots array<int>, queries array<struct<order:int,diagnosis:string,text:string,target_note_id:string>>, ground_truth_note_ids array<string>"
OBSERVATION = "target string, instrument string, wavelengths array<double>, depths array<double>, uncertainties array<double>, timestamp double, true_params map<string,string>, source string, reference string"
DATASET = f"target_name string, pivot_step int, data_sources array<string>, observations array<struct<{', '.join(f.replace(' ', ':', 1) for f in OBSERVATION.split(', '))}>>, model_grid array<map<string,string>>"
ANNOTATIONS = {
    "query": "annotation_id string, vignette_id string, condition string, query_index int, query_text string, retrieved_note_ids string, usefulness int, safety string, safety_notes string, annotator_id string, timestamp string",
    "session": "annotation_id string, vignette_id string, condition string, trust int, workload_feedback string, annotator_id string, timestamp string",
    "adjudication": "adjudication_id string, vignette_id string, condition string, disputed_field string, control_value string, cma_value string, adjudicated_value string, adjudicator_id string, rationale string, timestamp string",
}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, on any file system that Spark knows."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def first_existing(spark: SparkSession, folder: str, *names: str) -> str | None:
    return next((f"{folder}/{n}" for n in names if exists(spark, f"{folder}/{n}")), None)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, plain or gzip; malformed values are null."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def notes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NOTES).json(path)


def sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SESSIONS).option("multiLine", True).json(path)


def turns(sessions_table: DataFrame) -> DataFrame:
    rows = sessions_table.select("vignette_id", F.posexplode("queries").alias("turn", "q"))
    return rows.select("vignette_id", "turn", "q.order", "q.diagnosis", "q.text", "q.target_note_id")


def dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DATASET).option("multiLine", True).json(path)


def observations(dataset_table: DataFrame) -> DataFrame:
    return dataset_table.select("target_name", "pivot_step", F.explode("observations").alias("o")).select("target_name", "pivot_step", "o.*")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """report_id and the whole text of each file."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("report_id"), F.col("value").alias("text"))


def parquet(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    return spark.read.option("recursiveFileLookup", recursive).parquet(path)


def number_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of at least as many numbers as names from loosely delimited text; comments and other rows are dropped."""
    parts = F.split(F.trim(F.col("value")), r"[\s,;]+")
    lines = spark.read.text(path).where(~F.trim(F.col("value")).startswith("#"))
    cast = lines.select(*(F.get(parts, F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(names)))
    return cast.where(" and ".join(f"`{n}` is not null" for n in names))


# Parts of column names that tell a column's role.
ROLES = {"wavelength": ("wave", "lambda", "wl"), "depth": ("depth", "rp", "transit"), "uncertainty": ("err", "unc", "sigma")}


def sniffed_spectrum(spark: SparkSession, path: str) -> DataFrame:
    """wavelength, depth, uncertainty of a delimited spectrum whose header names the roles; comments are dropped."""
    lines = spark.read.text(path).where(~F.trim(F.col("value")).startswith("#") & (F.trim(F.col("value")) != ""))
    header = lines.first()[0]
    sep = max(",\t; ", key=header.count)
    names = [n.strip().lower() for n in header.split(sep)]
    taken: dict[str, int] = {}
    for role in ("uncertainty", "wavelength", "depth"):
        taken[role] = next(k for k, n in enumerate(names) if k not in taken.values() and any(p in n for p in ROLES[role]))
    parts = F.split(F.col("value"), "\\" + sep if sep in ";" else sep)
    made = lines.select(*(F.trim(F.get(parts, F.lit(taken[r]))).try_cast("double").alias(r) for r in ("wavelength", "depth", "uncertainty")))
    return made.where("wavelength > 0 and depth is not null and uncertainty is not null")


def annotations(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The annotation table of a kind; a missing file is an empty table."""
    path = f"{folder}/{kind}_annotations.csv"
    return csv(spark, path, ANNOTATIONS[kind]) if exists(spark, path) else spark.createDataFrame([], ANNOTATIONS[kind])


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"*.jsonl": notes, "*.parquet": parquet}


def everything(spark: SparkSession, folder: str) -> DataFrame:
    """The union by name of all tables of a folder that a registered reader knows."""
    found = [read(spark, f"{folder}/{glob}") for glob, read in READERS.items() if exists(spark, f"{folder}/{glob}")]
    return union_sources(found) if found else spark.createDataFrame([], NOTES)


# A small literature corpus for evidence nodes.
LITERATURE = [("lit-1", "sulphur dioxide photochemistry in a warm giant", 1_580_000_000), ("lit-2", "water absorption in transmission spectra", 1_600_000_000), ("lit-3", "carbon dioxide detection at 4.3 micrometres", 1_660_000_000)]


def literature(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LITERATURE, "node_id string, text string, pub_time long")


class ArrowShards(DataSource):
    """Arrow IPC streams, one partition for each shard. Options: path (shards separated by ``;``), schema (DDL)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_shards"

    def schema(self) -> str:
        return self.options["schema_ddl"]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ShardReader(self.options["path"].split(";"), schema.names)


class _ShardReader(DataSourceReader):
    def __init__(self, paths: list[str], names: list[str]):
        self.paths, self.names = paths, names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa

        with pa.memory_map(partition.value) as source:
            for batch in pa.ipc.open_stream(source):
                yield batch.select(self.names)
