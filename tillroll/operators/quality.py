"""Data-quality operators (V1-V8): the reference's declared constraints
(NOT NULL, primary keys, types and lengths) turned into checks, plus
referential checks, header-vs-lines reconciliation, validation with
rejects, retry of rejected lines and deduplication.

Every check is one pass of aggregates (count_if per column) or a keyed
aggregate; none collects rows to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import line_revenue, with_line_amount
from tillroll.schemas import ddl


def _long_format(agg: DataFrame, table: str, names: list[str], value: str) -> DataFrame:
    """One row per column out of a one-row wide aggregate."""
    rows = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"`_{n}`").alias(value))
                     for n in names])
    return agg.select(F.lit(table).alias("table_name"), F.inline(rows))


def check_not_null(df: DataFrame, cols: list[str], table: str = "") -> DataFrame:
    """V1: NULL count per column, one scan."""
    agg = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{c}") for c in cols])
    return _long_format(agg, table, cols, "null_count")


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """V2: key values that occur more than once, with their copy count."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1))


def type_violation(col: Column, dtype: T.DataType, max_len: int | None = None) -> Column:
    """True when a non-null value does not fit the declared type / length."""
    text = col.cast("string")
    if isinstance(dtype, T.StringType):
        bad = F.lit(False)
    else:
        bad = col.isNotNull() & text.try_cast(dtype).isNull()
    if max_len is not None:
        bad = bad | (col.isNotNull() & (F.length(text) > max_len))
    return bad


def check_types(df: DataFrame, schema: T.StructType, max_length: dict[str, int] | None = None,
                table: str = "") -> DataFrame:
    """V3: values per column that do not fit the declared type or VARCHAR length."""
    max_length = max_length or {}
    cols = [f.name for f in schema.fields if f.name in df.columns]
    agg = df.agg(*[F.count_if(type_violation(F.col(f"`{f.name}`"), f.dataType, max_length.get(f.name)))
                   .alias(f"_{f.name}") for f in schema.fields if f.name in df.columns])
    return _long_format(agg, table, cols, "violations")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """V4: child rows whose key has no parent row (LEFT ANTI join).

    The parent keys are deduplicated first (partial aggregation), so a key
    repeated in the parent cannot pile up in one task: an anti join can only
    split its left side for skew.
    """
    return child.join(parent.select(key).distinct(), key, "left_anti")


def check_refs(checks: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """V4 summary: orphan count per named child -> parent relation."""
    parts = [orphans(c, p, k).agg(F.count(F.lit(1)).alias("orphans"))
             .select(F.lit(name).alias("check_name"), "orphans")
             for name, (c, p, k) in checks.items()]
    return reduce(DataFrame.unionByName, parts)


def reconcile_orders(orders: DataFrame, items: DataFrame) -> DataFrame:
    """V5: header total vs the sum of its line revenue, per order.

    Items are aggregated per order before the join (partial aggregation
    first); an order without items has line_total 0.
    """
    lines = (with_line_amount(items).groupBy("order_id")
             .agg(F.sum(line_revenue()).alias("line_total")))
    return (orders.select("order_id", F.col("total_amount").alias("header_total"))
            .join(lines, "order_id", "left")
            .withColumn("line_total", F.coalesce("line_total", F.lit(0)))
            .withColumn("difference", F.col("header_total") - F.col("line_total")))


def rule_reasons(rules: dict[str, Column]) -> Column:
    """Array of the names of the rules a row breaks (empty = valid)."""
    return F.filter(F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name))
                              for name, cond in rules.items()]), lambda x: x.isNotNull())


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """V6: split into (good rows, rejected rows + reasons array)."""
    tagged = df.withColumn("_reasons", rule_reasons(rules))
    good = tagged.where(F.size("_reasons") == 0).drop("_reasons")
    bad = tagged.where(F.size("_reasons") > 0).withColumnRenamed("_reasons", "reasons")
    return good, bad


def schema_rules(schema: T.StructType, not_null: list[str], max_length: dict[str, int]) -> dict[str, Column]:
    """Rules implied by a declared table: NOT NULL columns and VARCHAR lengths."""
    rules: dict[str, Column] = {}
    for c in not_null:
        rules[f"{c}_not_null"] = F.col(c).isNotNull()
    for c, n in max_length.items():
        rules[f"{c}_max_{n}"] = F.col(c).isNull() | (F.length(F.col(c).cast("string")) <= n)
    return rules


def validation_summary(df: DataFrame, rules: dict[str, Column], table: str) -> DataFrame:
    """V6 summary: good and rejected row counts in one pass."""
    ok = F.size(rule_reasons(rules)) == 0
    return df.agg(F.lit(table).alias("table_name"), F.count_if(ok).alias("good_rows"),
                  F.count_if(~ok).alias("rejected_rows"))


def retry_rejects(rejects: DataFrame, schema: T.StructType, line_col: str = "raw_line",
                  rules: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """V7: re-parse rejected raw CSV lines against ``schema``; return
    (rows that now parse and pass ``rules``, lines still rejected).

    A line that does not fit the schema fills the corrupt-record column
    (PERMISSIVE mode), so a legitimately empty nullable field is not
    mistaken for a parse failure.
    """
    with_corrupt = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
    parsed = rejects.select(F.col(line_col),
                            F.from_csv(F.col(line_col), ddl(with_corrupt),
                                       {"mode": "PERMISSIVE",
                                        "columnNameOfCorruptRecord": "_corrupt"}).alias("_row"))
    parse_ok = F.col("_row._corrupt").isNull()
    rows = parsed.where(parse_ok).select(line_col, *[F.col(f"_row.`{f.name}`") for f in schema.fields])
    good, bad = validate(rows, rules or {})
    still = (parsed.where(~parse_ok).select(line_col)
             .unionByName(bad.select(line_col)))
    return good.drop(line_col), still


def dedupe(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """V8: one row per key, the one with the greatest ``order`` columns
    (remaining columns break ties, so the survivor is deterministic).

    A max over a struct is an ordinary aggregate: partial aggregation runs
    before the shuffle, so a key with millions of copies costs one row per
    task, unlike a row_number() window that sorts the whole key in one task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*[F.col(c) for c in order + rest])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in order + rest])


def latest_version(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """V8 "latest load wins": of every key the rows of its greatest version, all of them.

    The greatest version per key is an ordinary aggregate, one row per key and
    task before the shuffle; the join back is an inner join whose row side AQE
    can split where one key holds much of the table. Null keys are keys like
    others. The join is by the keys alone; that a row's version is not below
    its key's greatest is checked on the pairs. One numeric version column is
    aggregated by hashing, several (or text) by sorting.
    """
    newest = (df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
              .agg((F.max(version[0]) if len(version) == 1 else F.max(F.struct(*version))).alias("_v")))
    same = [df[k].eqNullSafe(newest[f"_k{i}"]) for i, k in enumerate(keys)]
    best = F.struct(newest["_v"].alias(version[0])) if len(version) == 1 else newest["_v"]
    same.append(F.struct(*[df[c] for c in version]) >= best)
    return df.join(newest, reduce(lambda a, b: a & b, same)).select(*[df[c] for c in df.columns])
