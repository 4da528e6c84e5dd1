"""Readers and writers of question, prediction, usage and text files.

All paths go through Spark's readers, so any store that Spark reads will do. Types are
never inferred from data: text columns stay text and are cast where they are used.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUESTION = T.StructType([T.StructField(n, T.StringType()) for n in ("_id", "id", "qid", "question", "answer", "type", "context")])
PREDICTION_FIELDS = ("prediction", "pred_answer", "predicted_answer", "response", "answer", "pred")


def suffix(path: str) -> str:
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower()


def read_records(spark: SparkSession, path: str, schema: T.StructType = QUESTION) -> DataFrame:
    """Records of .jsonl (one object a line), .json (a list, {"data": [...]} or a map from id to record) or .csv (all text)."""
    kind = suffix(path)
    if kind in ("jsonl", "ndjson"):
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if kind == "csv":
        return spark.read.option("header", True).option("multiLine", True).csv(path)
    if kind != "json":
        raise ValueError(f"no reader for {path}")
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    entries, record = T.ArrayType(schema), F.from_json
    as_list = whole.where(F.col("value").startswith("[")).select(F.explode(record("value", entries)).alias("r")).select("r.*")
    has_data = F.get_json_object("value", "$.data").isNotNull()
    in_data = whole.where(F.col("value").startswith("{") & has_data).select(F.explode(record(F.get_json_object("value", "$.data"), entries)).alias("r")).select("r.*")
    keyed = whole.where(F.col("value").startswith("{") & ~has_data).select(F.explode(record("value", T.MapType(T.StringType(), schema))).alias("key", "r"))
    first = schema.fieldNames()[0]
    named = keyed.select(F.coalesce(F.col(f"r.{first}"), F.col("key")).alias(first), *[F.col(f"r.{n}") for n in schema.fieldNames()[1:]])
    return as_list.unionByName(in_data).unionByName(named)


def read_merged(spark: SparkSession, glob: str, value: T.DataType) -> DataFrame:
    """Maps from id to value over several files; of one id the value in the last path stays."""
    rows = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.explode(F.from_json("value", T.MapType(T.StringType(), value))).alias("qid", "value"))
    return rows.groupBy("qid").agg(F.max_by("value", "path").alias("value"))


def read_optional(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    """The table at path, or an empty one of the schema if there is none."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def read_sources(spark: SparkSession, paths: list[str], schema: T.StructType, key: str) -> DataFrame:
    """Several tables, the later one overwriting the earlier by key; missing ones are empty; all missing is an error."""
    parts = []
    for ordinal, path in enumerate(paths):
        try:
            parts.append(spark.read.schema(schema).parquet(path).withColumn("_ordinal", F.lit(ordinal)))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    if not parts:
        raise FileNotFoundError(f"none of {paths} is there")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    last = rows.groupBy(key).agg(F.max("_ordinal").alias("_last"))
    return rows.join(last, key).where("_ordinal = _last").drop("_ordinal", "_last")


def read_labelled(spark: SparkSession, specs: list[str], schema: T.StructType) -> DataFrame:
    """label:path specs as one table with a column source."""
    rows = None
    for spec in specs:
        label, _, path = spec.partition(":")
        part = read_records(spark, path, schema).withColumn("source", F.lit(label))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if rows is None:
        raise ValueError("no sources")
    return rows


def read_texts(spark: SparkSession, folder: str, limit: int = 1400) -> DataFrame:
    """title (file stem) and passage (white space once, cut at a word within limit characters) of the *.txt of a folder."""
    whole = spark.read.text(f"{folder}/*.txt", wholetext=True)
    title = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1)
    tidy = F.trim(F.regexp_replace("value", r"\s+", " "))
    cut = F.when(F.length(tidy) <= limit, tidy).otherwise(F.regexp_replace(F.substring(tidy, 1, limit), r"\s+\S*$", ""))
    return whole.select(title.alias("title"), cut.alias("passage"))


def question_id(*, prefer_id: bool, position: Column) -> Column:
    """id before _id by presence, or _id, id, qid by truth; else the position."""
    if prefer_id:
        return F.coalesce("id", "_id", position.cast("string"))
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(full("_id"), full("id"), full("qid"), position.cast("string"))


def prediction(df: DataFrame, fields: tuple[str, ...] | None = None) -> Column:
    """The first present of the given fields, or the first true of the usual ones."""
    if fields:
        present = [f for f in fields if f in df.columns]
        return F.coalesce(*[F.col(f) for f in present[:1]], F.lit(""))
    return F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in PREDICTION_FIELDS if f in df.columns], F.lit(""))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_empty(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """An empty Parquet table that still has its schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def append_missing(df: DataFrame, path: str, key: str) -> DataFrame:
    """Rows of df whose key isn't in the table at path are appended; returns them as a plan on what was there before."""
    done = read_optional(df.sparkSession, path, df.schema).select(key).distinct()
    new = df.join(done, key, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def fingerprint(spark: SparkSession, glob: str) -> DataFrame:
    """name, length and sha256 of files. Spark's reader passes over empty ones, so these come from the list of files."""
    whole = spark.read.format("binaryFile").load(glob).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    empty = [(s.getPath().getName(),) for s in found or () if s.isFile() and s.getLen() == 0]
    return whole.unionByName(spark.createDataFrame(empty, "name string").select("name", F.lit(0).cast("long").alias("length"), F.sha2(F.lit("").cast("binary"), 256).alias("sha256")))


def forbidden_fields(schema: T.DataType, names: set[str], prefix: str = "") -> list[str]:
    """Dotted paths of fields with one of the names, at any depth of a schema."""
    found: list[str] = []
    if isinstance(schema, T.ArrayType):
        return forbidden_fields(schema.elementType, names, f"{prefix}[]")
    if isinstance(schema, T.MapType):
        return forbidden_fields(schema.valueType, names, f"{prefix}{{}}")
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            path = f"{prefix}.{f.name}" if prefix else f.name
            found += [path] if f.name in names else []
            found += forbidden_fields(f.dataType, names, path)
    return found
