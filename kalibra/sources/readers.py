"""Readers of delimited, annotation, ontology and expression files, all as plans over Spark's own sources."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kalibra.storage import Scratch


def without_bom(df: DataFrame) -> DataFrame:
    """Column names without a byte order mark or blanks around them."""
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def delimited(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | None = None, comment: str | None = None, header: bool = True) -> DataFrame:
    """SRC1, SRC17, SRC26: a delimited file, plain or gzipped; without a schema all columns are strings."""
    reader = spark.read.option("header", header).option("sep", sep).option("multiLine", False)
    if comment:
        reader = reader.option("comment", comment)
    df = without_bom(reader.csv(path))
    if schema is None:
        return df
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])


def by_suffix(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """SRC2: CSV, TSV or XLSX by the file's name, gzipped or not."""
    name = path.lower().removesuffix(".gz")
    if name.endswith((".xlsx", ".xlsm")):
        return sheet_of(spark, path, sheet)
    if name.endswith((".tsv", ".tab")):
        return delimited(spark, path, "\t")
    if name.endswith(".txt"):
        return blanks(spark, path)
    return delimited(spark, path)


def blanks(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: a file whose columns are separated by runs of blanks, with a header line."""
    lines = spark.read.option("header", True).option("sep", "\u0001").option("quote", "").option("ignoreLeadingWhiteSpace", False).csv(path)
    if not lines.columns:
        return spark.createDataFrame([], T.StructType())
    names = lines.columns[0].lstrip("\ufeff").split()
    cells = F.split(F.trim(F.col(f"`{lines.columns[0]}`")), r"\s+")
    return lines.select(*[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)])


def optional(spark: SparkSession, path: str | None, schema: T.StructType) -> DataFrame:
    """SRC25: a mapping table, or an empty one where there is none."""
    return spark.createDataFrame([], schema) if path is None else delimited(spark, path, schema=schema)


# Workbooks


MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _ended(file, tag: str) -> Iterator[ET.Element]:
    """The elements of this name as they end, each taken out of its parent after that."""
    above: list[ET.Element] = []
    for what, found in ET.iterparse(file, ("start", "end")):
        if what == "start":
            above.append(found)
            continue
        above.pop()
        if found.tag == tag:
            yield found
            if above:
                above[-1].remove(found)


def _texts(x: ET.Element) -> str:
    return "".join(t.text or "" for t in x.iter(f"{MAIN}t"))


def _column(reference: str | None, default: int) -> int:
    letters = re.match(r"[A-Z]+", reference or "")
    return sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters[0]))) - 1 if letters else default


def _rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, n, cells) of an XLSX file; only its shared strings and one row are held."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                shared = [_texts(x) for x in _ended(f, f"{MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iterfind(f"{MAIN}sheets/{MAIN}sheet"):
            target = targets[sheet.get(LINK)].lstrip("/")
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
                for n, row in enumerate(_ended(f, f"{MAIN}row")):
                    cells: dict[int, str | None] = {}
                    for i, c in enumerate(row.iterfind(f"{MAIN}c")):
                        v = c.find(f"{MAIN}v")
                        own = _texts(c) if c.get("t") == "inlineStr" else v.text if v is not None else None
                        cells[_column(c.get("r"), i)] = shared[int(own)] if c.get("t") == "s" and v is not None else own
                    yield sheet.get("name"), n, [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def workbook(spark: SparkSession, path: str, required: list[str] = ()) -> dict[str, DataFrame]:
    """SRC4, SRC5: the sheets of a workbook, parsed row by row in a task; required ones must be there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in (x.as_py() for b in batches for x in b.column(0)):
            for part in batched(_rows(content), 4096):
                sheets, numbers, cells = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array(sheets, pa.string()), pa.array(numbers, pa.int64()), pa.array(cells, pa.list_(pa.string()))], names=["sheet", "n", "cells"])

    rows = Scratch(spark).write(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "sheet string, n long, cells array<string>"))
    heads = {r.sheet: r.cells for r in rows.where("n = 0").collect()}  # a row a sheet
    if missing := [s for s in required if s not in heads]:
        raise ValueError(f"{path} lacks the sheets {', '.join(missing)}")
    one = lambda name, head: rows.where((F.col("sheet") == name) & (F.col("n") > 0)).select(*[F.get("cells", F.lit(i)).alias(str(c)) for i, c in enumerate(head)])
    return {name: one(name, head) for name, head in heads.items()}


def sheet_of(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    sheets = workbook(spark, path, [sheet] if sheet else [])
    return sheets[sheet] if sheet else next(iter(sheets.values()))


# Expression


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of one file; n grows in their order, with gaps where the file is split."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.rtrim("value", F.lit("\r")).alias("value"))


def series_matrix(spark: SparkSession, path: str) -> DataFrame:
    """SRC6, SRC15: (probe, sample, value) of the table between the begin and end marks of a series matrix."""
    lines = numbered_lines(spark, path)
    marks = lines.agg(
        F.min(F.when(F.col("value").startswith("!series_matrix_table_begin"), F.col("n"))).alias("a"), F.min(F.when(F.col("value").startswith("!series_matrix_table_end"), F.col("n"))).alias("b")
    )
    rows = lines.crossJoin(marks).where("n > a and n < b and value <> ''")  # one row
    cells = F.transform(F.split("value", "\t"), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    rows = rows.select("n", cells.alias("c"))
    head = rows.orderBy("n").limit(1).select(F.col("n").alias("first"), F.col("c").alias("h"))
    body = rows.crossJoin(head).where("n > first")  # one row
    pairs = body.select(F.col("c")[0].alias("probe"), F.explode(F.slice(F.arrays_zip("h", "c"), 2, F.greatest(F.size("c") - 1, F.lit(1)))).alias("p"))
    return pairs.select("probe", F.col("p.h").alias("sample"), F.col("p.c").try_cast("double").alias("value"))


def series_samples(spark: SparkSession, path: str, groups: dict[str, str], other: str = "OTHER") -> DataFrame:
    """SRC7, SRC15: (sample, title, group): a series' samples, grouped by the first keyword that a title has, in lower case."""
    lines = numbered_lines(spark, path)
    cells = F.transform(F.split("value", "\t"), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    row = lambda mark: lines.where(F.col("value").startswith(mark)).select(F.posexplode(F.slice(cells, 2, F.size(cells))).alias("i", "x"))
    out = row("!Sample_geo_accession").select("i", F.col("x").alias("sample")).join(row("!Sample_title").select("i", F.col("x").alias("title")), "i")
    group = F.lit(other)
    for word, name in reversed(groups.items()):
        group = F.when(F.lower("title").contains(word), F.lit(name)).otherwise(group)
    return out.select("sample", "title", group.alias("group"))


def count_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """SRC14: (feature, sample, value) of a wide matrix whose first column names its rows."""
    wide = delimited(spark, path, sep)
    if len(wide.columns) < 3:
        raise ValueError(f"{path} has fewer than three columns")
    first, *rest = wide.columns
    numbers = wide.select(F.col(f"`{first}`").alias("feature"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in rest])
    return numbers.unpivot("feature", [f"`{c}`" for c in rest], "sample", "value")


def platform_annotation(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: (line): the lines of a platform's one TXT file, plain or in a ZIP, without comments."""

    def unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in (x.as_py() for b in batches for x in b.column(0)):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                texts = [n for n in z.namelist() if n.lower().endswith(".txt")]
                if len(texts) != 1:
                    raise ValueError(f"{len(texts)} text files in the archive")
                with io.TextIOWrapper(z.open(texts[0]), "utf-8-sig") as file:
                    while some := file.readlines(1 << 20):
                        yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\r\n") for x in some], pa.string())], names=["line"])

    if path.lower().endswith(".zip"):
        rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(unzipped, "line string")
    else:
        rows = spark.read.text(path).withColumnRenamed("value", "line")
    return rows.where(~F.col("line").startswith("#") & (F.col("line") != ""))


# Sets, annotations and ontologies


def gene_sets(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """SRC8: (module, source, feature) of a GMT file."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> ''").select(cells[0].alias("module"), F.get(cells, F.lit(1)).alias("source"), F.explode(F.slice(cells, 3, F.greatest(F.size(cells) - 2, F.lit(1)))).alias("feature"))
    rows = rows.where("feature <> ''")
    if expected is not None and (n := rows.select("module").distinct().count()) != expected:
        raise ValueError(f"{path} has {n} sets, not {expected}")
    return rows


def joined_sets(df: DataFrame, module: str, features: str, sep: str = ";") -> DataFrame:
    """SRC9: (module, feature) of a table with joined lists."""
    return df.select(F.col(module).alias("module"), F.explode(F.split(features, sep)).alias("feature")).select("module", F.trim("feature").alias("feature")).where("feature <> ''").distinct()


def annotations(spark: SparkSession, path: str, aspect: str = "P", least: int = 15) -> DataFrame:
    """SRC10: (symbol, term) of a GAF file: one aspect, no negated qualifiers, only lines with enough fields."""
    lines = spark.read.text(path).where(~F.col("value").startswith("!")).select(F.split("value", "\t", -1).alias("c"))
    rows = lines.where(F.size("c") >= least).select(F.col("c")[2].alias("symbol"), F.col("c")[3].alias("qualifier"), F.col("c")[4].alias("term"), F.col("c")[8].alias("aspect"))
    return rows.where((F.col("aspect") == aspect) & ~F.array_contains(F.split("qualifier", r"\|"), "NOT")).select("symbol", "term").distinct()


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: (term, name, namespace, obsolete, parents) of an OBO file's terms; parents by is_a and part_of."""
    stanzas = spark.read.option("lineSep", "\n\n").text(path).select(F.trim(F.regexp_replace("value", "\r", "")).alias("s")).where(F.col("s").startswith("[Term]"))
    one = lambda key: F.nullif(F.regexp_extract("s", rf"(?m)^{key}: (.*)$", 1), F.lit(""))
    every = lambda form: F.regexp_extract_all("s", F.lit(form), F.lit(1))
    parents = F.array_distinct(F.concat(every(r"(?m)^is_a: (\S+)"), every(r"(?m)^relationship: part_of (\S+)")))
    return stanzas.select(one("id").alias("term"), one("name").alias("name"), one("namespace").alias("namespace"), F.coalesce(one("is_obsolete") == "true", F.lit(False)).alias("obsolete"), parents.alias("parents"))


def ontology_edges(terms: DataFrame) -> DataFrame:
    """(child, parent) of live terms."""
    return terms.where("not obsolete").select(F.col("term").alias("child"), F.explode("parents").alias("parent"))


def pathway_links(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: (a, b) of a two-column link file, without the databases' prefixes."""
    cells = F.split("value", "\t")
    return spark.read.text(path).where("value <> ''").select(*[F.element_at(F.split(cells[i], ":"), -1).alias(n) for i, n in enumerate("ab")])


def named_network(links: DataFrame, names: DataFrame) -> DataFrame:
    """SRC16: (u, v, score) by symbol, of links (a, b, score) between identifiers and their names (id, symbol)."""
    one = names.select(F.col("id").alias("a"), F.col("symbol").alias("u"))
    two = names.select(F.col("id").alias("b"), F.col("symbol").alias("v"))
    return links.join(one, "a").join(two, "b").select("u", "v", "score")


# Web pages


def page_identity(pages: DataFrame, label: str | None = None) -> DataFrame:
    """(page_id, title, heading, labelled): what a page says it is about."""
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), "&amp;", "&"))
    find = lambda form: F.nullif(bare(F.regexp_extract("html", form, 1)), F.lit(""))
    marked = find(rf"(?is){re.escape(label)}\s*[:：]\s*([^<]+)") if label else F.lit(None).cast("string")
    return pages.select("page_id", find(r"(?is)<title[^>]*>(.*?)</title>").alias("title"), find(r"(?is)<h1[^>]*>(.*?)</h1>").alias("heading"), marked.alias("labelled"))


# Files


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """SRC24: (path, length, sha256) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def classified(files: DataFrame, rules: list[tuple[str, str]], other: str = "OTHER") -> DataFrame:
    """files with class, by the first pattern that a path has."""
    out = F.lit(other)
    for form, name in reversed(rules):
        out = F.when(F.col("path").rlike(form), F.lit(name)).otherwise(out)
    return files.withColumn("class", out)


def resolved(files: DataFrame, name: str) -> str:
    """SRC23: the path of a file by its name; copies may lie about if they are equal."""
    own = files.where(F.element_at(F.split("path", "/"), -1) == name)
    found = own.agg(F.min(F.struct(F.length("path").alias("n"), "path")).alias("first"), F.min("sha256").alias("low"), F.max("sha256").alias("high")).first()
    if found.first is None:
        raise FileNotFoundError(name)
    if found.low != found.high:
        raise ValueError(f"{name} has copies that differ")
    return found.first.path
