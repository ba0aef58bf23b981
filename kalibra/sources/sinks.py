"""Writers: tables, manifests and resumable appends."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable
from functools import reduce
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, gzip: bool = False, mark: bool = False) -> None:
    """SNK1, SNK2: with a header, and if asked for a byte order mark at each file's beginning."""
    if mark:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def write_by(df: DataFrame, path: str, *columns: str) -> None:
    """SNK2, SNK7: Parquet, a folder for each value of the columns, each written by few tasks."""
    df.repartition(*columns).write.mode("overwrite").partitionBy(*columns).parquet(path)


def write_report(sheets: dict[str, DataFrame], path: str) -> None:
    """SNK3: one Parquet table for each sheet of a report, of any size."""
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


#: Rows of a sheet of a workbook, at most; what is larger belongs into write_report().
ROWS = 10_000


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """SNK3: summary tables as the sheets of one XLSX file; one of over ROWS rows is refused."""
    space, spark = "http://schemas.openxmlformats.org", None
    parts, names = {}, []
    for i, (name, df) in enumerate(sheets.items(), 1):
        spark = df.sparkSession
        table = df.limit(ROWS + 1).toArrow()
        if table.num_rows > ROWS:
            raise ValueError(f"{name} has over {ROWS} rows")
        rows = [table.column_names, *zip(*[c.to_pylist() for c in table.columns])]
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{space}/spreadsheetml/2006/main"><sheetData>{"".join(f"<row>{"".join(map(cell, r))}</row>" for r in rows)}</sheetData></worksheet>'
        names.append((i, name))
    books = "".join(f'<sheet name={quoteattr(n[:31])} sheetId="{i}" r:id="r{i}"/>' for i, n in names)
    links = "".join(f'<Relationship Id="r{i}" Type="{space}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in names)
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i, _ in names)
    parts |= {
        "xl/workbook.xml": f'<workbook xmlns="{space}/spreadsheetml/2006/main" xmlns:r="{space}/officeDocument/2006/relationships"><sheets>{books}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{space}/package/2006/relationships">{links}</Relationships>',
        "_rels/.rels": f'<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="r1" Type="{space}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "[Content_Types].xml": f'<Types xmlns="{space}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    write_bytes(spark, out.getvalue(), path)


def cell(x) -> str:
    if x is None:
        return "<c/>"
    if isinstance(x, (int, float)) and not isinstance(x, bool) and x == x:
        return f"<c><v>{x!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>'


def write_bytes(spark: SparkSession, content: bytes, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """SNK5: a small text, such as a statement or metadata, through Spark's file systems."""
    write_bytes(spark, text.encode(), path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """SNK4."""
    write_text(spark, json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True), path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """SNK6: (path, length, sha256) of what was written."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


BATCH = "_batch"


def appended(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table of append_new(); none if no batch was committed."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = files.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(files) or not any(x.getPath().getName().startswith(f"{BATCH}=") for x in system.listStatus(files)):
        return None
    return spark.read.parquet(path).drop(BATCH)


def lacking(df: DataFrame, table: DataFrame | None, keys: list[str]) -> DataFrame:
    """The rows of df whose keys the table hasn't; null keys are alike."""
    if table is None:
        return df
    had = table.select(*[F.col(k).alias(f"_had_{i}") for i, k in enumerate(keys)]).distinct()
    return df.join(had, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_had_{i}")) for i, k in enumerate(keys)]), "left_anti")


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """SNK8: appends the rows whose keys the table at path lacks, so that a job that was cut off goes on; how many.

    Rows are written beside the table and become a batch of it by one rename, so a
    job that is cut off leaves a whole batch or none, where renames are atomic.
    Of rows with equal keys one is kept; null keys are keys, too.  One job at a time
    may append.
    """
    spark = df.sparkSession
    before = appended(spark, path)
    df = lacking(df.dropDuplicates(keys), before, keys)
    mark = uuid.uuid4().hex
    at = spark._jvm.org.apache.hadoop.fs.Path
    staged, batch = at(f"{path}/_staged-{mark}"), at(f"{path}/{BATCH}={mark}")
    df.write.parquet(str(staged.toString()))
    n = spark.read.schema(df.schema).parquet(staged.toString()).count()
    system = staged.getFileSystem(spark._jsc.hadoopConfiguration())
    if not n and before is not None:
        system.delete(staged, True)
    elif not system.rename(staged, batch):
        raise OSError(f"{staged.toString()} can't be renamed")
    return n


def resumed(df: DataFrame, path: str, keys: list[str], work: Callable[[DataFrame], DataFrame], size: int = 100_000) -> DataFrame:
    """The table at path after work on all rows of df whose keys it lacks, in batches of about size rows that are committed one after another.

    work returns rows with the keys; called again after it was cut off, it is given
    what no committed batch has.
    """
    spark = df.sparkSession
    n = max(1, -(-lacking(df, appended(spark, path), keys).count() // size))
    for i in range(n):
        part = df.where(F.pmod(F.xxhash64(*keys), F.lit(n)) == i)
        append_new(work(lacking(part, appended(spark, path), keys)), path, keys)
    return appended(spark, path)
