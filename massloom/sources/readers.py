"""Scans of spectra, catalogues and templates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom import fixed


def discover(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, suffix) of every data file below a folder; templates and reports are left out.

    Only directory listings are read; file contents stay untouched.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.element_at(F.split(name, r"\."), -1))
    return files.withColumn("name", name).withColumn("suffix", suffix).filter(
        F.col("suffix").isin(*fixed.DATA_SUFFIXES) & ~name.contains("sample_submission") & ~name.endswith(".report.json"))


def inventory(spark: SparkSession, path: str, limit: int = 200) -> DataFrame:
    """First ``limit`` files in path order with their size, and whether the listing was cut."""
    files = discover(spark, path).select("path", "length", "suffix")
    total = files.agg(F.count(F.lit(1))).scalar()
    return files.orderBy("path").limit(limit).withColumn("truncated", total > limit)


def content_digest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """sha256 per file, hashed where the file is read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
            .load(path).select("path", "length", F.sha2("content", 256).alias("digest")))


def folder_digest(files: DataFrame, root: str) -> DataFrame:
    """One digest over (relative path, file digest), with file and byte counts.

    Files fall into slices by the first four digits of their path's digest; a
    slice is hashed in path order and the slice digests in slice order, so the
    paths of a large folder never meet in one task.
    """
    rel = F.element_at(F.split("path", "\\Q" + root.rstrip("/").split("://")[-1].removeprefix("file:") + "/\\E"), -1)
    d = files.select(rel.alias("p"), F.col("digest").alias("d"), "length")
    items = F.array_sort(F.collect_list(F.struct("p", "d")))
    text = F.array_join(F.transform(items, lambda x: F.concat_ws("\u0000", x["p"], x["d"])), "\n")
    parts = d.groupBy(F.substring(F.sha2("p", 256), 1, 4).alias("s")).agg(F.sha2(text, 256).alias("h"), F.count(F.lit(1)).alias("c"), F.sum("length").alias("b"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("s", "h"))), lambda x: x["h"])
    return parts.agg(F.sha2(F.array_join(joined, "\n"), 256).alias("digest"), F.sum("c").alias("files"), F.sum("b").alias("bytes"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per non-blank line; a byte-order mark on the first line is ignored."""
    text = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"))
    return text.filter(F.trim("line") != "").select(
        F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_delimited(spark: SparkSession, path: str, schema: str, arrays: list[str] = (), sep: str = ",") -> DataFrame:
    """Header rows; the listed columns hold JSON arrays as text."""
    df = spark.read.schema(schema).option("header", True).option("sep", sep).option("escape", '"') \
        .option("mode", "FAILFAST").csv(path)
    for c in arrays:
        df = df.withColumn(c, F.from_json(F.col(c), "array<double>"))
    return df


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Parquet scan of the named columns; the projection reaches the file reader."""
    return spark.read.parquet(path).select(*columns)


def read_mgf(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """Peak-list text: one row per BEGIN IONS / END IONS block.

    Returns file, start, headers (map of lower-cased keys, the last value of a
    repeated key), the headers pepmass and adduct as columns whose filters reach
    the source, peaks, and ``problem`` (null when the block is well formed).
    """
    from massloom.sources import peaklist

    peaklist.register(spark)
    reader = spark.read.format("peaklist")
    return (reader.option("splitBytes", split_bytes) if split_bytes else reader).load(path)


def unbalanced_mgf(spark: SparkSession, path: str) -> DataFrame:
    """Files whose BEGIN and END lines differ in number."""
    line = F.upper(F.trim("value"))
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), line.alias("line"))
    return d.groupBy("file").agg(F.count_if(F.col("line") == "BEGIN IONS").alias("begins"),
                                 F.count_if(F.col("line") == "END IONS").alias("ends")).filter(F.col("begins") != F.col("ends"))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def snapshot_counters(df: DataFrame, windows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(mass-selected rows, counters) of a public structure snapshot read as text."""
    from massloom.functions.numeric import finite
    from massloom.operators.ranges import inside_windows

    require_columns(df, list(fixed.SNAPSHOT_COLUMNS))
    d = df.withColumn("mass", F.col("exact_molecular_weight").try_cast("double"))
    usable = finite("mass") & (F.col("mass") > 0)
    near = inside_windows(d.filter(usable), windows) if windows is not None else d.filter(usable)
    named = (F.trim(F.coalesce("canonical_smiles", F.lit(""))) != "") & (F.trim(F.coalesce("identifier", F.lit(""))) != "")
    scanned = d.agg(F.count(F.lit(1)).alias("csv_rows"), F.count_if(~F.coalesce(usable, F.lit(False))).alias("invalid_mass"))
    counted = near.agg(F.count_if(~named).alias("missing_structure_or_id"), F.count_if(named).alias("mass_selected"))
    counters = scanned.select("*", counted.select("missing_structure_or_id").scalar().alias("missing_structure_or_id"),
                              counted.select("mass_selected").scalar().alias("mass_selected"))
    return near.filter(named).select("identifier", "canonical_smiles", "mass"), counters


def comma_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """Comma-separated number text -> array<double>."""
    for c in columns:
        df = df.withColumn(c, F.transform(F.split(F.col(c), ","), lambda x: x.cast("double")))
    return df


def resolve_field(df: DataFrame, field: str, columns: dict[str, str] | None = None, required: bool = True) -> Column:
    """First non-blank alias of a logical field, case-insensitive; an explicit mapping wins."""
    present = {c.lower(): c for c in df.columns}
    names = (columns[field].lower(),) if columns and field in columns else fixed.ALIASES[field]
    types = dict(df.dtypes)
    found = [F.when(F.trim(present[n]) != "", F.col(present[n])) if types[present[n]] == "string" else F.col(present[n])
             for n in names if n in present]
    if not found and required:
        raise ValueError(f"missing {field}; supply an explicit column mapping")
    if not found:
        return F.lit(None).cast("string")
    value = F.coalesce(*found)
    if required:
        kind = types[present[next(n for n in names if n in present)]]
        value = F.coalesce(value, F.raise_error(F.lit(f"missing {field}")).cast(kind))
    return value


def read_template(spark: SparkSession, path: str, id_column: str, guess_column: str) -> DataFrame:
    """Two-column template with each id's 0-based ``row``; blank or repeated ids fail.

    Rows are numbered in file order: by file name, then block, then position.
    """
    from massloom.operators.ordering import global_rank

    df = spark.read.option("header", True).csv(path)
    if sorted(df.columns) != sorted([id_column, guess_column]):
        raise ValueError("template must have exactly the id and the guess column")
    ids = df.select(id_column, F.col("_metadata.file_name").alias("__f"), F.col("_metadata.file_block_start").alias("__b"),
                    F.monotonically_increasing_id().alias("__i"))
    ranked = global_rank(ids, ["__f", "__b", "__i"], "row").select(id_column, "row")
    blank = F.coalesce(F.trim(id_column), F.lit("")) == ""
    seen = ranked.groupBy(id_column).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("ids"), F.max("n").alias("most"), F.count_if(blank).alias("blank")).first()
    if not seen["ids"] or seen["most"] > 1 or seen["blank"]:
        raise ValueError("template ids must be present, unique and non-blank")
    return ranked


def whitelist(df: DataFrame, columns: list[str] = fixed.QUERY_COLUMNS) -> DataFrame:
    """Only these columns may enter a query; answers never do."""
    return require_columns(df, list(columns)).select(*columns)


def normalise_energies(text: Column, explicit: bool) -> Column:
    """JSON list or scalar text -> array; explicit electron-volt text must parse, free text becomes empty."""
    t = F.trim(text)
    parsed = F.when(t.startswith("["), F.from_json(t, "array<double>")).otherwise(
        F.when(t.try_cast("double").isNotNull(), F.array(t.try_cast("double"))))
    ok = parsed.isNotNull() & F.forall(parsed, lambda e: e.isNotNull() & ~F.isnan(e) & (e >= 0))
    empty = F.array().cast("array<double>")
    if explicit:
        return F.when(text.isNull() | (t == ""), empty).when(ok, parsed).otherwise(
            F.raise_error(F.concat(F.lit("invalid collision energy list: "), t)).cast("array<double>"))
    return F.when(F.coalesce(ok, F.lit(False)), parsed).otherwise(empty)
