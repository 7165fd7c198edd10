"""Table packs and other JSON documents as DataFrames.

Files of lines are read in splits, so that a large one takes many tasks. ``line`` is (start of the split, place in what
the task read): in order inside a file, and the same on every run over the same splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiloom.functions import scalars as S
from kpiloom.schemas import ENVELOPE, KPI, PACK, VALID_FILE


#: Fixed value: the year in the name of a file of tables, and of an extraction from it.
YEAR_IN_NAME = r"linked_tables\((\d{4})\)"


def lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(file, line, text) of every line of the files at ``path``."""
    reader = spark.read
    if not path.endswith((".jsonl", ".json")):
        reader = reader.option("pathGlobFilter", glob)
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("line"), F.col("value").alias("text"))


def jsonl(spark: SparkSession, path: str, strict: bool = True, glob: str = "*.jsonl") -> DataFrame:
    """Packs of JSON lines with ``file`` and ``line``; blank lines and comments (``//``, ``#``) are left out.

    Strict: a malformed line fails the query. Otherwise it gives a row whose ``corrupt`` holds the line. A folder
    without a file of that name is an error either way.
    """
    df = lines(spark, path, glob)
    if not df.inputFiles():
        raise FileNotFoundError(f"no {glob} in {path}")
    t = S.strip(F.col("text"))
    df = df.where((t != "") & ~t.startswith("//") & ~t.startswith("#"))
    if strict:
        return df.select("file", "line", F.from_json("text", PACK, {"mode": "FAILFAST"}).alias("p")).select("file", "line", "p.*")
    parsed = F.from_json("text", f"{PACK}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    return df.select("file", "line", parsed.alias("p")).select("file", "line", "p.*")


def first_per_file(packs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` packs of each file."""
    w = Window.partitionBy("file").orderBy("line")
    return packs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def with_year(packs: DataFrame) -> DataFrame:
    """Packs with ``year`` from the table id where it is missing: the column to partition and prune by."""
    return packs.withColumn("year", F.coalesce("year", S.table_year_medium(F.col("table_id"))))


def of_year(packs: DataFrame, year: int | str) -> DataFrame:
    """Packs of a year by table id; ids with a short prefix belong to every year."""
    return packs.where(S.in_year_lax(F.col("table_id"), str(year)))


def tables_per_year(packs: DataFrame) -> DataFrame:
    y = S.table_year_medium(F.col("table_id"))
    return packs.where(y.isNotNull()).groupBy(y.alias("year")).agg(F.count("*").alias("n"))


def years(packs: DataFrame) -> DataFrame:
    return packs.select(S.table_year_medium(F.col("table_id")).alias("year")).where("year is not null").distinct().orderBy("year")


def extractions(spark: SparkSession, path: str) -> DataFrame:
    """KPIs of extraction files in either envelope: file, year (of the file name), table_id, place and KPI fields."""
    df = spark.read.schema(ENVELOPE).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    df = df.select(F.col("_metadata.file_path").alias("file"), F.nullif(F.regexp_extract(F.col("_metadata.file_name"), YEAR_IN_NAME, 1), F.lit("")).alias("file_year"), "metadata.model", "tables", "results")
    t = F.coalesce(F.transform("tables", lambda x: F.struct(x["table_id"].alias("table_id"), x["extraction_result"]["kpis"].alias("kpis"))), F.array().cast("array<struct<table_id:string,kpis:array<struct<name:string,key:string,units:string,value:string,year:int,row_name:string,row_idx:int,col_name:string,col_idx:int,source_model:string>>>>"))
    r = F.coalesce(F.transform("results", lambda x: F.struct(x["table_id"].alias("table_id"), x["kpis"].alias("kpis"))), F.slice(t, 1, 0))
    df = df.select("file", "file_year", "model", F.posexplode(F.concat(t, r)).alias("entry", "x")).where("x.table_id is not null and x.table_id <> '' and size(x.kpis) > 0")
    return df.select("file", "file_year", "model", "entry", "x.table_id", F.posexplode("x.kpis").alias("place", "k")).select("file", "file_year", "model", "entry", "table_id", "place", "k.*")


def valid_kpis(spark: SparkSession, path: str) -> DataFrame:
    """KPIs of ``valid_*.json`` files with evidence flattened, in order of files and places."""
    df = spark.read.schema(VALID_FILE).option("multiLine", True).option("pathGlobFilter", "valid_*.json").json(path)
    df = df.select(F.col("_metadata.file_name").alias("file"), F.posexplode("valid_kpis").alias("place", "k"))
    return df.select("file", "place", "k.name", "k.key", "k.units", "k.value", "k.year", "k.evidence.*")


def links(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a links file."""
    node = "struct<kpi_id:string,name:string,value:string,key:string,year:int,units:string,next_kpi_id:string,prev_kpi_id:string,row_idx:int,col_idx:int,row_name:string,col_name:string,table_id:string>"
    return spark.read.schema(f"total_nodes long, nodes array<{node}>").option("multiLine", True).json(path).select(F.inline("nodes"))


def latest_file(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file): the newest of the files that match."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "modificationTime")
    return df.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("file"))


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """(file, table_id, model, error, kpis) of checkpoint files: a bare list of results or an envelope with ``results``.

    A file that is absent, corrupt or of another form has no rows; it never fails.
    """
    result = f"struct<table_id:string,model:string,error:string,kpis:array<{KPI}>>"
    out = f"file string, table_id string, model string, error string, kpis array<{KPI}>"
    try:
        df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], out)
    listed = F.when(F.col("value").startswith("["), F.from_json("value", f"array<{result}>")).otherwise(F.from_json("value", f"results array<{result}>")["results"])
    return df.select("file", F.inline(listed)).where("table_id is not null or error is not null or kpis is not null")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Earlier results (table_id, model, error, kpis); empty where nothing was written yet."""
    schema = "table_id string, model string, error string, kpis string"
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def markdown_tables(spark: SparkSession, path: str) -> DataFrame:
    """Pipe tables of paginated Markdown as packs: page marks ``{N}----``, header line, rule, rows."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), "value")
    pages = df.select("doc_id", F.explode(F.split("value", r"(?m)(?=^\{\d+\}-{4,})")).alias("body")).withColumn("page", F.nullif(F.regexp_extract("body", r"^\{(\d+)\}-", 1), F.lit("")).try_cast("int"))
    found = pages.select("doc_id", "page", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?m)(?:^\|.*\|[ \t]*(?:\n|\z)){2,}"), F.lit(0))).alias("nr", "t"))
    split_row = lambda r: F.transform(F.split(F.regexp_replace(S.strip(r), r"^\||\|$", ""), r"\|", -1), S.strip)
    rows = F.transform(F.filter(F.split("t", "\n"), lambda r: (S.strip(r) != "") & ~r.rlike(r"^\|[\s:|-]+\|[ \t]*$")), split_row)
    out = found.withColumn("all", rows).withColumn("head", F.get("all", F.lit(0))).withColumn("body", F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))))
    return out.select(
        F.concat("doc_id", F.lit("_P"), F.coalesce(F.col("page").cast("string"), F.lit("0")), F.lit("_T"), F.col("nr").cast("string")).alias("table_id"), "doc_id", F.lit(None).cast("int").alias("year"), "page",
        F.lit(None).cast("string").alias("bucket"), F.lit("").alias("section_name"), F.lit("").alias("title"), F.array("head").alias("headers"), F.col("head").alias("merged_headers"), F.col("body").alias("rows"), F.transform("body", lambda r: F.get(r, F.lit(0))).alias("stub_col"),
    )
