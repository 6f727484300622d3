"""Reading and writing samples, runs and reports."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SAMPLE = "id string, text string, annotations array<struct<start:int,end:int,kind:string,text:string>>"
RUN = "sample_id string, option string, original_text string, outgoing_text string, response_text string, restored_text string, detections array<struct<kind:string,confidence:double,text:string,source:string>>, reverse_map map<string,string>, latency_ms double, mode string"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE).json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).json(path)


def violations(samples: DataFrame) -> DataFrame:
    """Annotations whose offsets do not give their text."""
    a = samples.select("id", "text", F.explode("annotations").alias("a"))
    return a.filter(~F.substring("text", F.col("a.start") + 1, F.col("a.end") - F.col("a.start")).eqNullSafe(F.col("a.text"))).select("id", "a.*")


def write_samples(samples: DataFrame, path: str, mode: str = "error") -> None:
    """Valid samples only; an invalid one stops the job before anything is written."""
    bad = violations(samples).limit(1).collect()
    if bad:
        raise ValueError(f"annotation does not match its text in sample {bad[0]['id']}")
    samples.select("id", "text", "annotations").write.mode(mode).json(path)


def write_runs(runs: DataFrame, path: str, mode: str = "error") -> None:
    runs.write.mode(mode).json(path)


def publish(parts: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """Workloads as one dataset, partitioned by workload."""
    every = None
    for name, df in parts.items():
        df = df.withColumn("workload", F.lit(name))
        every = df if every is None else every.unionByName(df)
    every.write.mode(mode).partitionBy("workload").parquet(path)


_BODY = "struct<model:string,stream:boolean,tools:array<variant>,functions:array<variant>,messages:array<struct<role:string,content:variant>>,extra_body:variant>"


def request_bodies(raw: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Chat requests from JSON lines; a message's content is a string or a list of blocks; unreadable
    requests have a null body."""
    body = F.from_json(column, _BODY)
    return raw.select(*keep, F.col(column).alias("raw"), F.when(body["messages"].isNotNull(), body).alias("body"))


def message_text(message: Column) -> Column:
    """The text of a message: its string, or its text blocks joined by newlines."""
    content = message["content"]
    blocks = F.coalesce(
        F.try_variant_get(content, "$", "array<struct<type:string,text:string>>"), F.array().cast("array<struct<type:string,text:string>>"),
    )
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"])
    text = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(F.array_join(texts, "\n"))
    return F.when(content.isNotNull(), text)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for what a query writes and reads back, below ``spark.checkpoint.dir``.  Only a
    session on one machine that names no folder gets a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="veilspan-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- reports
_RATES = ("exact_leak_rate", "partial_leak_rate", "combined_leak_rate", "false_positive_rate")
REPORT = ("option_name", "workload", "num_samples", "total_annotations", *_RATES, "quality_delta", "latency_ms_median", "latency_ms_p95")


def _fixed(c: Column, digits: int, missing: str = "", sign: str = "") -> Column:
    """A number with so many decimals, rounded by its exact binary value; the JVM rounds the shortest
    decimal that reads as the number instead.  Reports are small."""

    @F.arrow_udf(StringType())
    def written(values: pa.Array) -> pa.Array:
        return pa.array([missing if v is None or v != v else f"{v:{sign}.{digits}f}" for v in values.to_pylist()], pa.string())

    return written(c.cast("double"))


def csv_rows(report: DataFrame) -> DataFrame:
    digits = dict.fromkeys((*_RATES, "quality_delta"), 6) | {"latency_ms_median": 3, "latency_ms_p95": 3}
    return report.select(*[_fixed(F.col(c).cast("double"), digits[c]).alias(c) if c in digits else F.col(c) for c in REPORT])


def write_csv(report: DataFrame, path: str, mode: str = "error") -> None:
    csv_rows(report).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A report read back, with the file each row is from; None where there is none."""
    import glob

    if "://" not in path and not glob.glob(path):
        return None
    return spark.read.option("header", True).csv(path).withColumn("source_file", F.col("_metadata.file_path"))


def table_lines(report: DataFrame, style: str = "markdown") -> DataFrame:
    """(option_name, workload, line): a formatted line per report row."""
    cells = [
        F.col("option_name"),
        F.col("workload"),
        F.col("num_samples").cast("string"),
        *[_fixed(F.col(c), 3) for c in _RATES],
        _fixed(F.col("quality_delta").cast("double"), 3, "---", "+"),
        _fixed(F.col("latency_ms_median").cast("double"), 1, "---"),
    ]
    if style == "latex":
        line = F.concat(F.lit("  "), F.concat_ws(" & ", *cells), F.lit(" \\\\"))
    else:
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return report.select("option_name", "workload", line.alias("line"))


def kind_breakdown_lines(by_kind: DataFrame) -> DataFrame:
    """Leak rates per kind, highest first, ties by kind."""
    return by_kind.orderBy(F.desc("rate"), "kind").select(
        "kind", "rate", F.concat(F.lit("| "), F.col("kind"), F.lit(" | "), _fixed(F.col("rate"), 3), F.lit(" |")).alias("line"),
    )


def parse_breakdown(spark: SparkSession, path: str) -> DataFrame:
    """(kind, rate) from a written breakdown table."""
    cells = F.transform(F.split(F.col("value"), r"\|"), lambda x: F.trim(x))
    rows = spark.read.text(path).select(cells.alias("c")).filter(F.size("c") >= 4)
    return rows.select(F.col("c")[1].alias("kind"), F.expr("try_cast(c[2] as double)").alias("rate")).filter("rate IS NOT NULL")


def _put(spark: SparkSession, path: str, lines: list[str]) -> None:
    """One small text file, wherever Spark can write."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray("\n".join([*lines, ""]).encode("utf-8")))
    out.close()


HEAD = ("Option", "Workload", "N", "Exact", "Partial", "Combined", "FP", "Quality", "Median ms")


def write_report(report: DataFrame, by_kind: DataFrame, folder: str) -> None:
    """CSV, Markdown, LaTeX and the breakdown; a report has a row per option and workload, so its
    lines are gathered on the driver."""
    spark = report.sparkSession
    lines = {
        style: [r["line"] for r in table_lines(report, style).orderBy("option_name", "workload").collect()]
        for style in ("markdown", "latex")
    }
    _put(spark, f"{folder}/report.md", [f"| {' | '.join(HEAD)} |", "|" + "---|" * len(HEAD), *lines["markdown"]])
    _put(spark, f"{folder}/report.tex", lines["latex"])
    kinds = [r["line"] for r in kind_breakdown_lines(by_kind).collect()]
    _put(spark, f"{folder}/leak_by_kind.md", ["| Kind | Leak Rate |", "|------|----------:|", *kinds])
    write_csv(report, f"{folder}/report_csv", "overwrite")


def write_metrics(summary: DataFrame, path: str, mode: str = "error") -> None:
    """A summary of semantic leaks or utility as JSON lines."""
    summary.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_metrics(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).json(path)


def figure_data(report: DataFrame) -> DataFrame:
    """Leak against latency per option, and whether no other option is better in both."""
    p = report.groupBy("option_name").agg(F.avg("combined_leak_rate").alias("leak"), F.avg("latency_ms_median").alias("latency"))
    # best leak at each latency, and at any smaller one: a row per option, no join of all with all
    best = p.groupBy("latency").agg(F.min("leak").alias("here"))
    before = Window.partitionBy(F.lit(1)).orderBy("latency").rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("before", F.min("here").over(before))
    worse = (F.col("here") < F.col("leak")) | F.coalesce(F.col("before") <= F.col("leak"), F.lit(False))
    return p.join(best, "latency").select("option_name", "leak", "latency", worse.alias("dominated"))
