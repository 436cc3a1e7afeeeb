"""Scans and sinks.  Every raw column is read as text: identifiers must never be widened to numbers."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of the three raw sources.
PARTY = "Customer_ID Customer_Name Bank_Name Account_Number Account_Type IFSC Phone_Number".split()
BANK = ["Transaction_ID", "Date", "Timestamp", "Txn_Ref_Number", "Transaction_Mode", "Currency", "Transaction_Amount", "Balance", *(f"Sender_{x}" for x in PARTY), *(f"Receiver_{x}" for x in PARTY)]
CDR = "CDR_ID Call_Date Call_Start_Time A_Party_Number B_Party_Number Call_Type Call_Duration_Seconds IMSI IMEI First_BTS_Location First_Cell_Global_ID Roaming_Network_Circle".split()
IPDR = "IPDR_ID Session_Date Session_Start_Time Subscriber_IMSI Subscriber_MSISDN Device_IMEI Source_IP_Address Destination_IP_Address Destination_Port Cell_Global_ID Session_Duration_Seconds".split()


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def read_csv(spark: SparkSession, path: str, columns: list[str], missing_ok: bool = False) -> DataFrame:
    """All-text scan by header; a missing file is an empty table where ``missing_ok``."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], text_schema(columns))
    return spark.read.schema(text_schema(columns)).option("header", True).option("enforceSchema", False).csv(path)


def read_sources(spark: SparkSession, bank: str, cdr: str, ipdr: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return read_csv(spark, bank, BANK), read_csv(spark, cdr, CDR), read_csv(spark, ipdr, IPDR)


def read_truth_pairs(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """True links ``(source_id, target_id)``; a missing file holds none."""
    rows = read_csv(spark, path, [source, target, "Is_Correlated"], missing_ok=True)
    return rows.where(F.trim("Is_Correlated") == "1").select(F.col(source).alias("source_id"), F.col(target).alias("target_id")).distinct()


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; one file only where a reader asks for it."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def response_parts(df: DataFrame, dataset: str) -> Iterator[str]:
    """``{status, dataset_type, rows, columns, data}`` with all rows, in pieces: one partition at a time is on the driver."""
    start = json.dumps({"status": "success", "dataset_type": dataset, "rows": df.count(), "columns": df.columns})
    yield start[:-1] + ', "data": ['
    for i, row in enumerate(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
        yield (", " if i else "") + row.j
    yield "]}"


def response(df: DataFrame, dataset: str) -> str:
    """The whole response as one text."""
    return "".join(response_parts(df, dataset))


def markdown_report(figures: dict[str, object], histogram: DataFrame) -> str:
    """The reduction report from collected aggregates (a row for each bin)."""
    lines = ["# Reduction report", "", "| figure | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in figures.items()), "", "| transactions | customers |", "| --- | --- |"]
    return "\n".join(lines + [f"| {r.bin} | {r.n_customers} |" for r in histogram.orderBy("position").collect()]) + "\n"


def synthetic(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """Seeded transactions for fixtures: lognormal amounts, exponential gaps."""
    rows = spark.range(n).withColumn("amount", F.round(F.exp(F.randn(seed) + 7), 2)).withColumn("gap", (-F.log(1 - F.rand(seed + 1)) * 600).cast("bigint"))
    return rows.select(F.format_string("TXN_%08d", "id").alias("transaction_id"), "amount", "gap")


def read_text_grid(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Rows of tables in page text ``(doc, page, text)``: a line's cells are cut at tabs, else at two or more blanks; bare
    page numbers and lines of one cell are no rows; all rows of a document are padded to its widest."""
    lines = df.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.where(~F.col("line").rlike(r"(?i)^\s*(\d+|page\s+\d+.*)?\s*$"))
    cells = F.when(F.col("line").contains("\t"), F.split("line", "\t")).otherwise(F.split(F.trim("line"), r"\s{2,}"))
    rows = lines.withColumn("cells", F.transform(cells, F.trim)).where(F.size("cells") > 1)
    wide = rows.groupBy("doc").agg(F.max(F.size("cells")).alias("width"))
    pad = F.concat("cells", F.array_repeat(F.lit(None).cast("string"), F.col("width") - F.size("cells")))
    return rows.join(wide, "doc").select("doc", "page", F.col("line_no").alias("row_idx"), pad.alias("cells"))


def require_text(pages: DataFrame, least: int = 50) -> DataFrame:
    """Documents whose pages hold fewer characters than ``least`` are scans: an action on the result fails for them."""
    total = pages.groupBy("doc").agg(F.sum(F.length("text")).alias("chars"))
    check = F.when(F.coalesce("chars", F.lit(0)) >= least, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no text in the pages of "), F.col("doc"))).cast("boolean"))
    return pages.join(total.where(check).select("doc"), "doc")


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """Grid rows ``(doc, page, row_idx, cells)`` of PDF files; needs pdfplumber on the executors."""

    def run(frames):
        import io

        import pandas as pd
        import pdfplumber

        settings = [{}, {"vertical_strategy": "lines_strict", "horizontal_strategy": "lines_strict"}, {"vertical_strategy": "text", "horizontal_strategy": "text"}]
        for frame in frames:
            out = []
            for name, data in zip(frame["path"], frame["content"]):
                with pdfplumber.open(io.BytesIO(data)) as pdf:
                    for strategy in settings:
                        rows = [(name, p.page_number, [None if c is None else str(c) for c in r]) for p in pdf.pages for t in p.extract_tables(strategy) for r in t]
                        if rows:
                            break
                out += [(d, p, i, c) for i, (d, p, c) in enumerate(rows)]
            yield pd.DataFrame(out, columns=["doc", "page", "row_idx", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "doc string, page int, row_idx int, cells array<string>")
