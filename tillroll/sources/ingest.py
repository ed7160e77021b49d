"""Landing-file ingest: one parse plan for CSV / JSON / Parquet files, used by
the batch scan (S1, S7, S18) and by the auto-ingest stream with its rejects,
load audit and retry (S2-S5, T1, V7); the load monitoring listings (S8-S11).
S6 creates the schema.

Layout under one store root (a shared path):

    <root>/tables/<table>/batch_id=N/     loaded rows, with the file they came from
    <root>/rejects/<table>/batch_id=N/    rejected rows with reasons
    <root>/audit/<table>/batch_id=N/      one row per landing file, empty files included
    <root>/retries/<table>/retry_id=R/    rows a retry run accepted, with their reject's key
    <root>/resolved/<table>/retry_id=R/   keys of the rejects a committed retry run settled
    <root>/checkpoints/<table>/           stream offsets (files seen)

The stream lists files (path, time and length, no content), so its checkpoint
remembers every file already loaded; a file rewritten under the same name is
not read again (corrections need a new name). Each micro-batch reads its listed
files through the batch scan. ``foreachBatch`` is at-least-once, so each batch
overwrites its own ``batch_id`` partition in all three outputs: a retried batch
replaces its earlier partial output instead of duplicating it. Nothing is
cached: the accepted and the rejected rows are two passes over the files (one
where the first counts no rejected row), and the audit counts what was written.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tillroll import schemas as S
from tillroll.operators.quality import latest_version, rule_reasons
from tillroll.session import path_exists

CORRUPT = "_corrupt_record"
SOURCE = ["source_file", "source_time"]  # lineage columns of a loaded row
MAX_FILES = 10_000  # files per micro-batch where neither max_files nor max_bytes is given


def job_name_of(table: str) -> str:
    return f"{table}_import_job"


def with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])


def _reader(spark: SparkSession, schema: T.StructType, fmt: str, multi_line: bool = False):
    r = spark.read
    if fmt == "csv":
        # Positional columns, one header line skipped, never inferred.
        return (r.format("csv").schema(with_corrupt(schema)).option("header", True).option("multiLine", multi_line)
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))
    if fmt == "json":
        return (r.format("json").schema(with_corrupt(schema)).option("multiLine", multi_line)
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))
    if fmt == "parquet":
        return r.format("parquet").schema(schema)
    raise ValueError(f"unsupported format {fmt}")


def apply_defaults(df: DataFrame, table: str) -> DataFrame:
    """A blank field of a column with a default takes the default."""
    for col, value in S.DEFAULTS.get(table, {}).items():
        if col in df.columns:
            dtype = df.schema[col].dataType
            df = df.withColumn(col, F.coalesce(F.col(col), F.lit(value).cast(dtype)))
    return df


def table_rules(table: str, schema: T.StructType) -> dict[str, Column]:
    """Load-time rules: declared NOT NULL columns, VARCHAR lengths."""
    names = {f.name for f in schema.fields}
    rules: dict[str, Column] = {}
    for c in S.NOT_NULL.get(table, []):
        if c in names:
            rules[f"{c}_not_null"] = F.col(c).isNotNull()
    for c, n in S.MAX_LENGTH.get(table, {}).items():
        if c in names:
            rules[f"{c}_max_length_{n}"] = F.col(c).isNull() | (F.length(F.col(c)) <= n)
    return rules


@dataclass
class Parsed:
    """What a parse plan makes of its input: the accepted rows (defaults
    applied) and the rejected ones (raw line and reasons), each with the
    columns carried along."""
    good: DataFrame
    rejected: DataFrame


def parse(raw: DataFrame, table: str, schema: T.StructType, rules: dict[str, Column] | None = None,
          carry: list[str] = (), seen: Observation | None = None) -> Parsed:
    """The parse plan: split parsed records into accepted and rejected rows.

    ``raw`` holds the schema's columns, the corrupt-record column where the
    format has one, and the ``carry`` columns. A record is rejected when a
    field does not fit its declared type or the line's columns do not match
    (``malformed_line``), or when it breaks a rule. A pass over the accepted
    rows leaves the number of rejected ones in ``seen``.
    """
    fields = [f.name for f in schema.fields]
    rules = table_rules(table, schema) if rules is None else rules
    has_corrupt = CORRUPT in raw.columns
    fits = F.col(CORRUPT).isNull() if has_corrupt else F.lit(True)
    # Spark parses only the columns a query uses. The hash (never below the
    # least integer) makes every column used, so that a bad field rejects its
    # line whatever a query selects later.
    every = F.hash(*[F.col(f"`{c}`") for c in fields]) >= F.lit(-2147483648)
    checks = {"malformed_line": fits & every, **rules}
    # one condition that is compiled: no array of reasons is made for a row that has none
    ok = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in checks.values()])
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in fields]))
    line = F.coalesce(F.col(CORRUPT), line) if has_corrupt else line
    accepted = raw.where(ok)
    if seen:
        accepted = raw.withColumn("_ok", ok).observe(seen, F.count_if(~F.col("_ok")).alias("rejected")).where("_ok")
    return Parsed(apply_defaults(accepted.select(*fields, *carry), table),
                  raw.where(~ok).select(line.alias("raw_line"), rule_reasons(checks).alias("reasons"), *carry))


def file_name(path: Column) -> Column:
    """One spelling of a file's path: local files come as file:/x and as file:///x.

    The pattern runs only for the other spellings, not for every row.
    """
    spelt = ~path.startswith("file:/") | (path.startswith("file:///") & ~path.startswith("file:////"))
    return F.when(spelt, path).otherwise(F.regexp_replace(path, "^file:/+", "file:///"))


def scan(spark: SparkSession, table: str, path: str | list[str], fmt: str = "csv", schema: T.StructType | None = None,
         rules: dict[str, Column] | None = None, multi_line: bool = False, seen: Observation | None = None) -> Parsed:
    """Landing files as accepted and rejected rows, with their source file and its time.

    ``multi_line`` lets a quoted CSV field (or a JSON record) span lines; such
    files are not split, each is read by one task.
    """
    schema = schema or S.TABLES[table]
    raw = _reader(spark, schema, fmt, multi_line).load(path).select(
        "*", file_name(F.col("_metadata.file_path")).alias(SOURCE[0]), F.col("_metadata.file_modification_time").alias(SOURCE[1]))
    return parse(raw, table, schema, rules, SOURCE, seen)


def read_csv(spark: SparkSession, table: str, prefix: str, schema: T.StructType | None = None,
             multi_line: bool = False) -> DataFrame:
    """Accepted rows of one table's landing prefix (``scan`` has the rejected ones)."""
    return read_any(spark, table, prefix, "csv", schema, multi_line)


def read_any(spark: SparkSession, table: str, path: str, fmt: str = "csv",
             schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """Accepted rows of CSV, JSON or Parquet landing files, defaults applied."""
    return scan(spark, table, path, fmt, schema, multi_line=multi_line).good.drop(*SOURCE)


@dataclass
class Store:
    """Where one ingest pipeline keeps its tables, rejects, audit and offsets."""
    root: str

    def table(self, t: str) -> str:
        return f"{self.root}/tables/{t}"

    def rejects(self, t: str) -> str:
        return f"{self.root}/rejects/{t}"

    def audit(self, t: str) -> str:
        return f"{self.root}/audit/{t}"

    def retries(self, t: str) -> str:
        return f"{self.root}/retries/{t}"

    def resolved(self, t: str) -> str:
        return f"{self.root}/resolved/{t}"

    def checkpoint(self, t: str) -> str:
        return f"{self.root}/checkpoints/{t}"


FILES_DDL = "path string, modificationTime timestamp, length long, content binary"
LISTING_DDL = "path string, file_path string, file_modification_time timestamp, length long"


def _literal(path: str) -> str:
    """A path whose characters mean themselves to Hadoop's path patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _audit_rows(files: DataFrame, loaded_counts: DataFrame, rejected_counts: DataFrame, job: str, table: str) -> DataFrame:
    """One audit row per file of ``files`` (file_path, file_modification_time), also without rows."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return (files.select("file_path", "file_modification_time")
            .join(loaded_counts, "file_path", "left").join(rejected_counts, "file_path", "left")
            .withColumn("rows_loaded", zero("rows_loaded")).withColumn("rows_rejected", zero("rows_rejected"))
            .select(F.lit(job).alias("job_name"), F.lit(table).alias("table_name"), "file_path", "file_modification_time",
                    (F.col("rows_loaded") + F.col("rows_rejected")).alias("rows_total"), "rows_loaded", "rows_rejected",
                    F.when(F.col("rows_loaded") + F.col("rows_rejected") == 0, "empty")
                    .when(F.col("rows_rejected") == 0, "loaded").when(F.col("rows_loaded") == 0, "failed")
                    .otherwise("partial").alias("status"),
                    F.current_timestamp().alias("load_time")))


def _counts(df: DataFrame, col: str, name: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("file_path")).agg(F.count(F.lit(1)).alias(name))


def _log_offset(spark: SparkSession, checkpoint: str, batch_id: int) -> int:
    """Last file-log entry of a micro-batch (-1 before the first)."""
    path = f"{checkpoint}/offsets/{batch_id}"
    if batch_id < 0 or not path_exists(spark, path):
        return -1
    lines = spark.read.text(path).where(F.col("value").contains("logOffset"))
    return lines.select(F.get_json_object("value", "$.logOffset").cast("int")).first()[0]


def batch_files(spark: SparkSession, checkpoint: str, batch_id: int) -> DataFrame | None:
    """``(file_path, file_modification_time)`` of every file of a micro-batch, from
    the stream's log of files seen. A scan never returns a file of no bytes; the
    log has it. None where the batch has no log."""
    last = _log_offset(spark, checkpoint, batch_id)
    if last < 0:
        return None
    first = _log_offset(spark, checkpoint, batch_id - 1) + 1
    paths = [p for k in range(first, last + 1) for p in (f"{checkpoint}/sources/0/{k}", f"{checkpoint}/sources/0/{k}.compact")]
    entry = F.from_json("value", "path string, timestamp long, batchId long")
    return (spark.read.text([p for p in paths if path_exists(spark, p)]).select(entry.alias("e"))
            .where(F.col("e.batchId").between(first, last)).groupBy(file_name(F.col("e.path")).alias("file_path"))
            .agg(F.timestamp_millis(F.max("e.timestamp")).alias("file_modification_time")))


def _batch_writer(table: str, schema: T.StructType, store: Store, job: str, fmt: str,
                  rules: dict[str, Column], multi_line: bool = False, db: str | None = None):
    def process(listing: DataFrame, batch_id: int) -> None:
        spark = listing.sparkSession
        # bounded by max_files: the stream's own listing is in the driver too
        files = [tuple(r) for r in listing.select(*[c.split()[0] for c in LISTING_DDL.split(", ")]).collect()]
        paths = [_literal(f[0]) for f in files if f[3]]
        seen = Observation() if paths else None
        if paths:
            p = scan(spark, table, paths, fmt, schema, rules, multi_line, seen)
        else:
            nothing = T.StructType([*schema.fields, T.StructField(SOURCE[0], T.StringType()), T.StructField(SOURCE[1], T.TimestampType())])
            p = parse(spark.createDataFrame([], nothing), table, schema, rules, SOURCE)
        at = lambda base: f"{base(table)}/batch_id={batch_id}"
        p.good.write.mode("overwrite").parquet(at(store.table))
        # a second pass only where the first has met rejected rows
        rejected = p.rejected if seen is None or seen.get["rejected"] else p.rejected.where(F.lit(False))
        (rejected.select(F.lit(job).alias("job_name"), F.col(SOURCE[0]).alias("file_path"),
                         F.col(SOURCE[1]).alias("file_modification_time"), F.monotonically_increasing_id().alias("position"),
                         "raw_line", "reasons", F.current_timestamp().alias("error_time"))
         .write.mode("overwrite").parquet(at(store.rejects)))
        good = spark.read.schema(f"{SOURCE[0]} string").parquet(at(store.table))
        bad = spark.read.schema("file_path string").parquet(at(store.rejects))
        listed = batch_files(spark, store.checkpoint(table), batch_id)
        listed = spark.createDataFrame(files, LISTING_DDL) if listed is None else listed
        (_audit_rows(listed, _counts(good, SOURCE[0], "rows_loaded"),
                     _counts(bad, "file_path", "rows_rejected"), job, table)
         .write.mode("overwrite").parquet(at(store.audit)))
        if db:
            add_partition(spark, db, table, batch_id)

    return process


def ingest(spark: SparkSession, table: str, src: str, store: Store, fmt: str = "csv",
           schema: T.StructType | None = None, max_files: int | None = None,
           max_bytes: str | None = None, job: str | None = None, rules: dict[str, Column] | None = None,
           recursive: bool = False, await_done: bool = True, multi_line: bool = False,
           every: str | None = None, db: str | None = None):
    """Load every new file under ``src`` into ``store``.

    Runs as a Structured Streaming query. By default (``availableNow``) it
    loads all files not yet recorded in the checkpoint, in batches of
    ``max_files`` files or ``max_bytes``, and stops. With ``every`` (such as
    ``1 minute``) it keeps running and loads what has arrived at each tick;
    stop the returned query to end it. With ``db`` each batch's partition is
    added to the catalog table as the batch commits, so its rows can be
    queried at once. Returns the StreamingQuery.
    """
    schema = schema or S.TABLES[table]
    job = job or job_name_of(table)
    rules = table_rules(table, schema) if rules is None else rules
    reader = spark.readStream.format("binaryFile").schema(FILES_DDL)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    else:
        reader = reader.option("maxFilesPerTrigger", max_files or MAX_FILES)
    if recursive:
        # The catch-all loader reads every file below the root.
        reader = reader.option("recursiveFileLookup", "true")
    stream = reader.load(src).select("path", file_name(F.col("_metadata.file_path")).alias("file_path"),
                                     F.col("modificationTime").alias("file_modification_time"), "length")
    writer = (stream.writeStream
              .foreachBatch(_batch_writer(table, schema, store, job, fmt, rules, multi_line, db))
              .option("checkpointLocation", store.checkpoint(table))
              .queryName(f"{job}-{uuid.uuid4().hex[:8]}"))   # unique: two loads may run at once
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    q = writer.start()
    if await_done and not every:
        q.awaitTermination()
    return q


def open_rejects(spark: SparkSession, store: Store, table: str) -> DataFrame:
    """Rejected rows that no committed retry run has settled. A reject's key is
    (batch_id, position); its file is ``file_path``."""
    rej = _read_or_empty(spark, store.rejects(table), REJECT_DDL)
    done = _read_or_empty(spark, store.resolved(table), RESOLVED_DDL).select("reject_batch", "position")
    return (rej.join(done, (rej.batch_id == done.reject_batch) & (rej.position == done.position), "left_anti"))


def retry(spark: SparkSession, table: str, store: Store, fmt: str = "csv", schema: T.StructType | None = None,
          rules: dict[str, Column] | None = None, repair: Callable[[Column], Column] | None = None,
          db: str | None = None) -> int:
    """V7: parse the open rejects of a table again and load those that now pass.

    What may have changed is the schema, the rules, or the line itself:
    ``repair`` maps the raw line to a mended one. Accepted rows are loaded
    under a batch id of their own (-1 for the first run, -2, ...) and keep the
    source file and time of their reject, so they count as that file's rows.
    Returns the number of rows loaded; the others stay open.

    A run is committed by the keys it settles, written last. A run that died
    before is repeated under the same id and overwrites what it had written;
    a committed run's rejects are open no more, so running again adds nothing.
    """
    schema = schema or S.TABLES[table]
    rejects = open_rejects(spark, store, table)
    run = (_read_or_empty(spark, store.resolved(table), RESOLVED_DDL).agg(F.max("retry_id")).first()[0])
    run = 0 if run is None else run + 1
    line = repair(F.col("raw_line")) if repair else F.col("raw_line")
    ddl, options = S.ddl(with_corrupt(schema)), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    row = F.from_json(line, ddl, options) if fmt == "json" else F.from_csv(line, ddl, options)
    key = ["reject_batch", "position"]
    # A generator is run once a row and stays above the anti join. As a plain
    # column the parse would be written out again for every field and check
    # that uses it, and run below the join on settled rejects too.
    raw = rejects.select(F.inline(F.array(row)), F.col("file_path").alias(SOURCE[0]),
                         F.col("file_modification_time").alias(SOURCE[1]), F.col("batch_id").alias("reject_batch"), "position")
    p = parse(raw, table, schema, rules, [*SOURCE, *key])
    staged = f"{store.retries(table)}/retry_id={run}"
    p.good.write.mode("overwrite").parquet(staged)
    good = spark.read.schema(p.good.schema).parquet(staged)
    n = good.agg(F.count(F.lit(1))).first()[0]
    if not n:
        return 0
    batch_id = -(run + 1)
    good.drop(*key).write.mode("overwrite").parquet(f"{store.table(table)}/batch_id={batch_id}")
    tried = rejects.groupBy("file_path", "file_modification_time").agg(F.count(F.lit(1)).alias("_n"))
    now = _counts(good, SOURCE[0], "rows_loaded")
    left = tried.join(now, "file_path", "left").select(
        "file_path", (F.col("_n") - F.coalesce("rows_loaded", F.lit(0))).alias("rows_rejected"))
    (_audit_rows(tried, now, left, f"{table}_retry_job", table)
     .write.mode("overwrite").parquet(f"{store.audit(table)}/batch_id={batch_id}"))
    good.select(*key).write.mode("overwrite").parquet(f"{store.resolved(table)}/retry_id={run}")
    if db:
        add_partition(spark, db, table, batch_id)
    return n


def path_missing(e: Exception) -> bool:
    """True for the analysis error Spark raises when a path does not exist."""
    cond = getattr(e, "getCondition", None) or getattr(e, "getErrorClass", None)
    return (cond and cond() == "PATH_NOT_FOUND") or "PATH_NOT_FOUND" in str(e)


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if path_missing(e):  # nothing loaded yet
            return spark.createDataFrame([], schema)
        raise


STATUSES = ["empty", "loaded", "partial", "failed"]  # from best to worst
AUDIT_DDL = ("job_name string, table_name string, file_path string, file_modification_time timestamp, "
             "rows_total long, rows_loaded long, rows_rejected long, status string, load_time timestamp, "
             "batch_id int")
REJECT_DDL = ("job_name string, file_path string, file_modification_time timestamp, position long, raw_line string, "
              "reasons array<string>, error_time timestamp, batch_id int")
RESOLVED_DDL = "reject_batch int, position long, retry_id int"


def loaded(spark: SparkSession, store: Store, table: str, lineage: bool = False) -> DataFrame:
    """The loaded rows of a table (batch_id is the load batch), with
    ``lineage`` also the source file and its modification time."""
    df = spark.read.parquet(store.table(table))
    return df if lineage else df.drop(*SOURCE)


def audit(spark: SparkSession, store: Store, tables=None) -> DataFrame:
    tables = tables or [t for t in S.TABLES]
    parts = [_read_or_empty(spark, store.audit(t), AUDIT_DDL) for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def load_history(spark: SparkSession, store: Store, n: int | None = 10, tables=None) -> DataFrame:
    """Newest loaded files first: file, rows, status, LIMIT n (None: all)."""
    h = (audit(spark, store, tables)
         .select("job_name", "file_path", "rows_loaded", "rows_rejected", "status", "load_time", "batch_id")
         .orderBy(F.col("load_time").desc(), F.col("batch_id").desc(), "file_path"))
    return h if n is None else h.limit(n)


def load_errors(spark: SparkSession, store: Store, n: int = 10, tables=None) -> DataFrame:
    """Newest rejected rows first, LIMIT n; rows that a retry has loaded are listed no more."""
    tables = tables or [t for t in S.TABLES]
    parts = [open_rejects(spark, store, t) for t in tables]
    rej = parts[0]
    for p in parts[1:]:
        rej = rej.unionByName(p)
    return rej.orderBy(F.col("error_time").desc(), F.col("batch_id").desc(), "raw_line", "file_path").limit(n)


def load_jobs(spark: SparkSession, store: Store, pattern: str = "%_import_job", tables=None) -> DataFrame:
    """One row per load job matching ``pattern``: files, rows, and the
    worst status among the files of its newest batch."""
    a = audit(spark, store, tables)
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    return (a.where(F.col("job_name").like(pattern))
            .groupBy("job_name", "table_name")
            .agg(F.count(F.lit(1)).alias("files"), F.sum("rows_loaded").alias("rows_loaded"),
                 F.sum("rows_rejected").alias("rows_rejected"),
                 F.max(F.struct("load_time", "batch_id", rank.alias("rank"), "status")).getField("status").alias("latest_status"),
                 F.max("load_time").alias("last_load_time")))


def load_detail(spark: SparkSession, store: Store, job: str, tables=None) -> DataFrame:
    """Per-file processing detail of one job."""
    return audit(spark, store, tables).where(F.col("job_name") == job)


def create_tables(spark: SparkSession, db: str = "analytics", location: str | None = None) -> list[str]:
    """Idempotent schema and table creation (CREATE ... IF NOT EXISTS).

    With ``location`` (a Store root) the database lives under it and the
    tables are external Parquet tables over the store's table folders,
    partitioned by load batch.
    """
    db_loc = f" LOCATION '{location}/warehouse'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}{db_loc}")
    made = []
    for t, schema in S.TABLES.items():
        loc = f" LOCATION '{location}/tables/{t}'" if location else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {db}.{t} ({S.ddl(schema)}, batch_id INT) "
                  f"USING parquet PARTITIONED BY (batch_id){loc}")
        made.append(f"{db}.{t}")
    return made


def table_counts(spark: SparkSession, db: str = "analytics") -> DataFrame:
    """Row count per catalog table of the schema (A7 over the catalog)."""
    parts = [spark.table(f"{db}.{t}").agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(t).alias("table_name"), "row_count") for t in S.TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def add_partition(spark: SparkSession, db: str, table: str, batch_id: int) -> None:
    """Make one load batch visible in the catalog table."""
    spark.sql(f"ALTER TABLE {db}.{table} ADD IF NOT EXISTS PARTITION (batch_id={batch_id})")


def refresh_partitions(spark: SparkSession, db: str = "analytics") -> None:
    """Register newly loaded batch partitions with the catalog tables."""
    for t in S.TABLES:
        try:
            spark.sql(f"ALTER TABLE {db}.{t} RECOVER PARTITIONS")
        except Exception as e:  # nothing loaded for this table yet
            if "does not exist" not in str(e) and not path_missing(e):
                raise


def current_rows(spark: SparkSession, store: Store, table: str, latest_only: bool = True) -> DataFrame:
    """The rows of a loaded table without lineage.

    With ``latest_only`` the newest file wins (V8): of every primary key the
    rows of the file with the latest modification time (then the greatest
    path) are kept, all of them, so two lines of one file stay two lines. The
    files are numbered in that order first (a list as long as there are files,
    like the listing of a load), so the rows are compared and moved with a
    number instead of a time and a path.
    """
    df = loaded(spark, store, table, lineage=True)
    keys = S.PRIMARY_KEYS[table]
    if not (latest_only and keys):
        return df.drop("batch_id", *SOURCE)
    files = df.select(*[F.col(c).alias(f"_{c}") for c in SOURCE]).distinct()
    files = files.select("*", F.row_number().over(Window.orderBy("_source_time", "_source_file")).alias("_file"))
    of_file = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SOURCE]
    rows = df.join(F.broadcast(files), reduce(lambda a, b: a & b, of_file)).drop("batch_id", *SOURCE, *[f"_{c}" for c in SOURCE])
    return latest_version(rows, keys, ["_file"]).drop("_file")


def star_from_store(spark: SparkSession, store: Store, latest_only: bool = True):
    """The star schema over the loaded tables of a store (``current_rows`` of
    each). Order items carry ``unit_price``; the builders derive ``line_amount``."""
    from tillroll.sources.testdata import Star
    return Star(**{t: current_rows(spark, store, t, latest_only) for t in ("orders", "order_items", "customers", "products")})
