"""Sinks. Every writer runs in the executors; nothing is gathered first."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import null_safe_join
from ..schema import SECTIONS


def _flat(df):
    """CSV columns: maps and arrays as JSON text, NaN and infinities as NULL."""
    columns = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f.name)
        if kind in ("map", "array", "struct"):
            c = F.to_json(c)
        elif kind in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def write_yearly_csv(df, path, section=None, order="line_number", mode="overwrite"):
    """One CSV directory per fiscal year in document order.

    Rows are range-partitioned on year and order, so a large year becomes
    several ordered files instead of one task.
    """
    rows = df
    if section is not None and section.lower() != "all":
        name = next((s for s in SECTIONS if s.lower() == section.lower()), section)
        rows = df.where(F.col("section") == name)
    if order in rows.columns:
        rows = rows.repartitionByRange("fiscal_year", order).sortWithinPartitions(
            "fiscal_year", order)
    _flat(rows).write.mode(mode).partitionBy("fiscal_year").option("header", True).csv(path)


def write_csv(df, path, mode="overwrite"):
    _flat(df).write.mode(mode).option("header", True).csv(path)


def write_json_records(df, path, mode="overwrite"):
    """Records with NULLs kept as fields, so that every record has one shape."""
    clean = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        clean.append(c.alias(f.name))
    df.select(*clean).write.mode(mode).option("ignoreNullFields", False).json(path)


def nest(df, keys, columns, out, order):
    """One row per key with its child rows as an ordered array."""
    entry = F.struct(*[F.col(o).alias(f"_{i}") for i, o in enumerate(order)],
                     F.struct(*columns).alias("row"))
    return df.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["row"]).alias(out))


def _finite(columns, df):
    """Columns with NaN and infinities as NULL."""
    return [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c)
            if df.schema[c].dataType.typeName() in ("double", "float") else F.col(c) for c in columns]


def hierarchy_text(parents, children, keys, columns, out="programs", order=("rank",)):
    """Nested records as pieces of text, one row per parent and child, in writing order.

    A parent's piece opens its record and its list, each child's piece follows with the
    comma it needs, the last one closes both and ends the line. Rows are dealt and sorted
    by parent, and each piece needs its neighbours only, so a parent may have any number
    of children. Keys are unique among parents; children without a parent are left out;
    NULL keys match.
    """
    keep = {"ignoreNullFields": "false"}
    head = F.to_json(F.struct(*_finite(parents.columns, parents)), keep)
    blank = [F.lit(None).cast(children.schema[o].dataType).alias(f"__o{i}") for i, o in enumerate(order)]
    opening = parents.select(*keys, F.lit(0).alias("__kind"), *blank, head.alias("__text"))
    each = children.select(
        *[F.col(k).cast(parents.schema[k].dataType).alias(k) for k in keys], F.lit(1).alias("__kind"),
        *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)],
        F.to_json(F.struct(*_finite(columns, children)), keep).alias("__text"))
    sort = ["__kind", *[f"__o{i}" for i in range(len(order))], "__text"]
    by = W.partitionBy(*keys).orderBy(*sort)
    rows = opening.unionByName(each).repartitionByRange(*keys).withColumns({
        "__before": F.lag("__kind").over(by), "__after": F.lead("__kind").over(by),
        "__parent": F.first("__kind").over(by)})
    name = F.to_json(F.struct(F.lit(1).alias(out)))  # {"programs":1}
    label = F.substr(name, F.lit(2), F.length(name) - 4)
    opened = F.concat(F.expr("left(__text, length(__text) - 1)"), F.lit(","), label, F.lit(":"), F.when(
        F.col("__after").isNull(), F.lit("null}\n")).otherwise(F.lit("[")))
    child = F.concat(F.when(F.col("__before") == 1, F.lit(",")).otherwise(F.lit("")), "__text", F.when(
        F.col("__after").isNull(), F.lit("]}\n")).otherwise(F.lit("")))
    again = (F.col("__kind") == 0) & (F.col("__before") == 0)
    piece = F.when(again, F.raise_error(F.lit("two parents share a key")).cast("string")).when(
        F.col("__kind") == 0, opened).otherwise(child)
    return rows.where(F.col("__parent") == 0).select(piece.alias("value"))


def write_hierarchy(parents, children, keys, columns, path, out="programs", order=("rank",),
                    mode="overwrite"):
    """Parent records with nested children, one JSON record a line.

    ``children`` holds rollup rows (programs of a department, projects of a
    program), already one row each. Pieces of a record are rows of a text
    file with a blank in between, so no task holds the children of a parent.
    """
    text = hierarchy_text(parents, children, list(keys), columns, out, list(order))
    text.write.mode(mode).option("lineSep", " ").text(path)
    _name_as_json(parents.sparkSession, path)


def _name_as_json(spark, path):
    """Give the committed text parts of a folder the ending of what they hold."""
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = to_path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            fs.rename(status.getPath(), to_path(folder, name[:-len(".txt")] + ".json"))


def write_by_department(df, path, mode="overwrite", max_rows=5_000_000):
    """One directory per department; large departments become several files."""
    df.write.mode(mode).partitionBy("department_code").option(
        "maxRecordsPerFile", max_rows).parquet(path)


def write_analysis(tables, path, fmt="parquet", mode="overwrite"):
    """One directory per named analysis table."""
    for name, df in tables.items():
        target = f"{path}/{name}"
        if fmt == "csv":
            write_csv(df, target, mode)
        else:
            df.write.mode(mode).format(fmt).save(target)


def refresh_field(df, source, keys, field):
    """Clear a column and fill it from its source; repeating it changes nothing."""
    base = df.drop(field) if field in df.columns else df
    one = source.groupBy(*keys).agg(F.max(field).alias(field))
    return null_safe_join(base, one, list(keys))
