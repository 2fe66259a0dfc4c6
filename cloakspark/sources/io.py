"""Readers, the paste parser and sinks."""

from __future__ import annotations

import ast
import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file or folder with a header. Without a schema, types are inferred (one more pass)."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By the path's ending: csv, json or jsonl, else Parquet."""
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    return read_csv(spark, path) if end == "csv" else spark.read.json(path) if end in ("json", "jsonl") else spark.read.parquet(path)


def _cell(value):
    return value if value is None or isinstance(value, str) else json.dumps(value) if isinstance(value, (dict, list, bool)) else str(value)


def _rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = list(dict.fromkeys(str(k) for r in rows for k in r))
    if not names:
        raise ValueError("nothing to read: no keys")
    flat = [tuple(_cell({str(k): v for k, v in r.items()}.get(n)) for n in names) for r in rows]
    return spark.createDataFrame(flat, ", ".join(f"`{n}` string" for n in names))


def read_paste(spark: SparkSession, text: str) -> DataFrame:
    """A pasted JSON object or array of objects, bare ``key: value`` pairs (JSON or Python literals), else CSV.

    Cells become strings. Text that starts like JSON but is not fails; nothing falls through from there. The paste is
    driver-side and small by nature.
    """
    t = text.strip()
    if t[:1] in ("{", "["):
        data = json.loads(t)
        data = [data] if isinstance(data, dict) else data
        if not all(isinstance(r, dict) for r in data):
            raise ValueError("a pasted array must hold objects")
        return _rows(spark, data)
    if ":" in t.split("\n", 1)[0].split(",", 1)[0]:
        for parse in (json.loads, ast.literal_eval):
            try:
                data = parse(f"{{{t}}}")
            except (ValueError, SyntaxError):
                continue
            if isinstance(data, dict):
                return _rows(spark, [data])
    return _rows(spark, [{k: v for k, v in r.items() if k is not None} for r in csv.DictReader(io.StringIO(t))])


def write(df: DataFrame, path: str, kind: str) -> None:
    """csv (with a header), jsonl or parquet; a folder of part files, as many as there are tasks."""
    if kind == "csv":
        df.write.option("header", True).csv(path)
    elif kind == "jsonl":
        df.write.json(path)
    elif kind == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"no such sink: {kind}")


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    """One JSON file at ``path``, in any store that Spark can write to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(json.dumps(manifest, indent=2, default=str).encode()))
    out.close()


def preview(df: DataFrame, n: int = 50) -> DataFrame:
    return df.limit(n)
