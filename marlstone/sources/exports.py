"""Named exports: a provider gives rows and columns, a writer a format."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from ..context import AccessContext
from .sinks import ExportColumn, write_csv

Provider = Callable[[SparkSession, AccessContext, dict], DataFrame]
IDENTITY = ("tenantid", "tenant_id", "storeid", "store_id", "userid", "user_id")


@dataclass(frozen=True)
class Export:
    """A named export: its rows, columns, total order and the permission that it asks for."""

    rows: Provider
    columns: list[ExportColumn]
    order: Callable[[], list[Column]]
    permission: str


EXPORTS: dict[str, Export] = {}
WRITERS: dict[str, Callable[..., DataFrame]] = {"csv": write_csv}


def canonical(query: dict) -> str:
    """JSON of a query with sorted keys and without the caller's identity."""

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in sorted(x.items()) if k.lower() not in IDENTITY}
        return [clean(v) for v in x] if isinstance(x, list) else x

    return json.dumps(clean(query), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def fingerprint(query: dict) -> str:
    """SHA-256 of the canonical query: equal requests have equal fingerprints."""
    return hashlib.sha256(canonical(query).encode()).hexdigest()


def run_export(spark: SparkSession, name: str, ctx: AccessContext, permissions: set[str], query: dict, path: str, fmt: str = "csv", max_rows: int | None = None) -> DataFrame:
    """Write a named export to path/fingerprint and return its manifest; the permission is checked when it runs."""
    export = EXPORTS[name]
    if export.permission not in permissions:
        raise PermissionError(export.permission)
    return WRITERS[fmt](export.rows(spark, ctx, query), export.columns, export.order(), f"{path}/{fingerprint(query)}", max_rows=max_rows)
