"""Writing: stamped appends, deletes, typed CSV exports with a manifest, expiry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import AccessContext

BOM = "﻿"


def stamped(rows: DataFrame, ctx: AccessContext, tenant: str = "tenant_id", new: bool = True) -> DataFrame:
    """Rows with tenant and audit columns set. A row of another tenant fails the write."""
    if ctx.tenant_id is None:
        raise ValueError("a write needs a tenant")
    now, user = F.lit(ctx.as_of).cast("timestamp_ntz"), F.lit(ctx.user_id).cast("long")
    if tenant in rows.columns:
        own = F.col(tenant).isNull() | (F.col(tenant) == ctx.tenant_id)
        rows = rows.withColumn(tenant, F.when(own, F.lit(ctx.tenant_id)).otherwise(F.raise_error(F.lit("a row of another tenant"))).cast("long"))
    else:
        rows = rows.withColumn(tenant, F.lit(ctx.tenant_id).cast("long"))
    if new:
        return rows.withColumns({"created_at": now, "created_by": user, "is_deleted": F.lit(False), "version": F.lit(1)})
    version = F.col("version") if "version" in rows.columns else F.lit(0)
    return rows.withColumns({"updated_at": now, "updated_by": user, "version": version + 1})


def soft_deleted(rows: DataFrame, ids: DataFrame, key: str, ctx: AccessContext) -> DataFrame:
    """rows with those of the given ids marked deleted."""
    marked = rows.join(ids.select(key).distinct().withColumn("__gone", F.lit(True)), key, "left")
    hit = F.coalesce("__gone", F.lit(False)) & ~F.col("is_deleted")
    now = F.lit(ctx.as_of).cast("timestamp_ntz")
    return marked.withColumns(
        {"is_deleted": F.col("is_deleted") | hit, "deleted_at": F.when(hit, now).otherwise(F.col("deleted_at")), "deleted_by": F.when(hit, F.lit(ctx.user_id).cast("long")).otherwise(F.col("deleted_by"))}
    ).drop("__gone")


def hard_deleted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


@dataclass(frozen=True)
class ExportColumn:
    """A column of an export: source field, title, kind (auto, string, number, bool, date, datetime, offset), format, order."""

    field: str
    title: str
    kind: str = "auto"
    format: str | None = None
    order: int = 0
    hidden: bool = False


def normalized(columns: list[ExportColumn]) -> list[ExportColumn]:
    """Shown columns by order, then as given; repeated fields are an error."""
    shown = [c for c in columns if not c.hidden and c.title.strip()]
    if len({c.field.lower() for c in shown}) != len(shown):
        raise ValueError("a field is exported twice")
    return sorted(shown, key=lambda c: c.order)


def formatted(x: Column, kind: str, fmt: str | None, dtype: str, zone: str = "UTC") -> Column:
    """A cell as text. Numbers with a format 0.00 round half away from zero; times are shown in `zone`."""
    if kind == "auto":
        kind = {"boolean": "bool", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime", "string": "string"}.get(dtype, "number")
    if kind == "number":
        digits = len(fmt.partition(".")[2]) if fmt else None
        return x.cast("string") if digits is None else F.round(x.cast("decimal(38,10)"), digits).cast(f"decimal(38,{digits})").cast("string")
    if kind == "bool":
        return F.when(x, F.lit("true")).when(~x, F.lit("false"))
    if kind == "date":
        return F.date_format(x, fmt or "yyyy-MM-dd")
    if kind in ("datetime", "offset"):
        local = F.convert_timezone(F.lit("UTC"), F.lit(zone), x.cast("timestamp_ntz"))
        return F.date_format(local, fmt or "yyyy-MM-dd HH:mm:ss")
    return x.cast("string")


def export_lines(rows: DataFrame, columns: list[ExportColumn], order: list[Column], zone: str = "UTC", max_rows: int | None = None) -> tuple[str, DataFrame]:
    """(header line, frame of one column `value`): an export's CSV lines in order; the caller's order must be total.

    Values are quoted only where they hold a comma, quote or line break.
    """
    shown, kinds = normalized(columns), dict(rows.dtypes)
    ordered = rows.orderBy(*order)
    if max_rows is not None:
        ordered = ordered.limit(max_rows)
    quote = lambda x: F.when(x.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(x, F.lit("")))
    cells = [quote(formatted(F.col(c.field), c.kind, c.format, kinds[c.field], zone)) for c in shown]
    head = ",".join('"' + c.title.replace('"', '""') + '"' if any(x in c.title for x in ',"\r\n') else c.title for c in shown)
    return head, ordered.select(F.concat_ws(",", *cells).alias("value"))


def write_csv(rows: DataFrame, columns: list[ExportColumn], order: list[Column], path: str, zone: str = "UTC", max_rows: int | None = None) -> DataFrame:
    """Write an export by Spark's commit protocol and return its manifest: file, bytes, sha256.

    The folder `header` holds the byte order mark and the header line, the folder `rows` the sorted part files: joined in
    the order of their names they are the export.
    """
    head, body = export_lines(rows, columns, order, zone, max_rows)
    spark = rows.sparkSession
    spark.createDataFrame([(BOM + head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    body.write.mode("overwrite").text(f"{path}/rows")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("file")


def expired(artifacts: DataFrame, as_of: Column, most: int) -> DataFrame:
    """Ready artifacts past their time, oldest first, a batch of them."""
    return artifacts.filter((F.col("status") == "Ready") & (F.col("expires_at") < as_of)).orderBy("expires_at", "id").limit(most)
