"""Tables in and out: typed reads, result tables, metrics documents and models."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from siftlode.functions.composition import ROW_ENDS, SYMBOLS
from siftlode.operators.order import kept

MEASUREMENTS = "id long, raw_value string, true_composition string, reduced_composition string, a double, b double, c double, alpha double, beta double, gamma double, spacegroup_no int, Z double, family string"
CANDIDATES = "material_id string, formula string, elements array<string>, n_elements int, spacegroup_no int, z_factor int, e_above_hull double, band_gap double, lattice struct<a:double,b:double,c:double,alpha:double,beta:double,gamma:double>"
LEAD_METRICS = "arrhenius struct<mace:struct<sigma300_mS_cm:double>>"
ELEMENTS = "element string, mass double, X double, mendeleev double, radius double"


def read_measurements(spark: SparkSession, train: str, test: str) -> DataFrame:
    """Both CSV files of measurements, told apart by ``split``."""
    one = lambda path, name: spark.read.schema(MEASUREMENTS).csv(path, header=True).withColumn("split", F.lit(name))
    return one(train, "train").unionByName(one(test, "test"))


#: One value that is a quoted text or has no comma, or nothing.
_FIELD = r'(?:"(?:[^"]|"")*"|[^,"]*)'


def read_checked(spark: SparkSession, path: str, schema: str = MEASUREMENTS, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of CSV files that fit the schema, and ``record, reason`` of lines that do not.

    Reasons: ``columns`` (more or fewer than the schema has), ``type`` (a value
    that is not of its column's type), ``quotes`` (quotes that do not match).
    The lines are read once, into a table of their own, as a second reading of
    other columns would judge them differently.
    """
    names = StructType.fromDDL(schema).names
    lines = kept(spark.read.schema(f"{schema}, _record string").csv(path, header=header, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_record"))
    whole = F.col("_record").rlike(f"^{_FIELD}(?:,{_FIELD})*$")
    fields = F.size(F.regexp_extract_all("_record", F.lit(f"(?:^|,){_FIELD}"), F.lit(0)))
    reason = F.when(~whole, "quotes").when(fields != len(names), "columns").otherwise("type")
    return lines.where("_record IS NULL").select(*names), lines.where("_record IS NOT NULL").select(F.col("_record").alias("record"), reason.alias("reason"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates; of a table of :func:`write_candidates` also its ``has_<element>`` columns."""
    found = spark.read.parquet(path)
    flags = [c for c in found.columns if c.startswith("has_")]
    return spark.read.schema(", ".join([CANDIDATES, *[f"{c} boolean" for c in flags]])).parquet(path)


def write_candidates(df: DataFrame, path: str, elements: tuple[str, ...] = ("Li", "S", "H")) -> None:
    """Candidates in folders by number of elements and by whether they have each of ``elements``, those that screens ask for most.

    A screen reads only the folders that it needs. Rows are dealt by folder and
    a hash, so a folder that most rows belong to is written by many tasks.
    """
    flags = {f"has_{e}": F.coalesce(F.array_contains("elements", e), F.lit(False)) for e in elements}
    rows = df.withColumns(flags | {"n_elements": F.size("elements")})
    folders = ["n_elements", *flags]
    dealt = rows.repartition(*folders, F.pmod(F.xxhash64("material_id"), F.lit(16)))
    dealt.sortWithinPartitions(*folders, "e_above_hull").write.mode("overwrite").partitionBy(*folders).parquet(path)


def read_metrics_json(spark: SparkSession, glob: str) -> DataFrame:
    """``label, sigma300_mS_cm`` of each metrics file; the label is the file's name without ``metrics_`` and ending."""
    label = F.regexp_extract(F.input_file_name(), r"([^/]*?)\.json$", 1)
    return spark.read.schema(LEAD_METRICS).json(glob, multiLine=True).select(F.regexp_replace(label, "^metrics_", "").alias("label"), F.col("arrhenius.mace.sigma300_mS_cm").alias("sigma300_mS_cm"))


def read_scalar(spark: SparkSession, path: str, field: str, kind: str = "double"):
    """One value of a JSON result."""
    return spark.read.json(path, multiLine=True).select(F.col(field).cast(kind)).first()[0]


def read_result(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A stored result table, to be read again instead of computed again: CSV by its schema, else parquet."""
    return spark.read.schema(schema).csv(path, header=True) if schema else spark.read.parquet(path)


def element_props(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The element dimension: number, row and group by rule; the measured properties from a CSV file.

    Without a path they come from ``elements.csv`` beside this module: standard
    atomic weights, Pauling's electronegativities, Pettifor's Mendeleev numbers
    and Slater's radii (in angstrom) of 40 elements that are usual in such
    solids; those of other elements are null.

    Groups follow from a row's length: the s block first, the p block last, the
    d block between; lanthanides and actinides are in group 3.
    """
    rows = []
    for z, symbol in enumerate(SYMBOLS, 1):
        row = next(k for k, end in enumerate(ROW_ENDS, 1) if z <= end)
        first, last = (ROW_ENDS[row - 2] if row > 1 else 0) + 1, ROW_ENDS[row - 1]
        from_end = last - z
        group = 1 if z == first else 18 if z == last else 2 if z == first + 1 else max(3, 18 - from_end)
        rows.append((symbol, z, row, group))
    own = spark.createDataFrame(rows, "element string, Z int, row int, group int")
    if path is None:
        with (Path(__file__).parent / "elements.csv").open() as lines:
            known = [(r["element"], *(float(r[x]) for x in ("mass", "X", "mendeleev", "radius"))) for r in csv.DictReader(lines)]
        return own.join(F.broadcast(spark.createDataFrame(known, ELEMENTS)), "element", "left")
    return own.join(F.broadcast(spark.read.schema(ELEMENTS).csv(path, header=True)), "element", "left")


def write_result(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def write_provenance(spark: SparkSession, columns: list[str], rows: list[tuple], folder: str, artefact: str) -> None:
    """A small table named after the artefact that it stands behind."""
    name = artefact.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    spark.createDataFrame(rows, columns).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_metrics(df: DataFrame, path: str) -> None:
    """A one-row nested document as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def report(df: DataFrame, n: int = 20) -> None:
    df.show(n, truncate=False)
