"""Scoped table scans: the only way from a table name to rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import AccessContext


@dataclass(frozen=True)
class TableScope:
    """How rows of a table belong to tenants and stores.

    kind: tenant (by tenant), store_only (tenant and own store), shared (tenant and shared stores) or none.
    """

    kind: str = "tenant"
    tenant: str = "tenant_id"
    store: str = "store_id"
    owner: str = "created_by"
    deleted: str | None = "is_deleted"
    key: str = "id"


def tenant_filter(scope: TableScope, ctx: AccessContext) -> Column:
    """Own tenant; nothing without a tenant."""
    return F.lit(False) if ctx.tenant_id is None else F.col(scope.tenant) == ctx.tenant_id


def store_filter(scope: TableScope, ctx: AccessContext) -> Column:
    """Own store; nothing without a store."""
    return F.lit(False) if ctx.store_id is None else F.col(scope.store) == ctx.store_id


def shared_filter(scope: TableScope, ctx: AccessContext, store_id: int | None = None) -> Column:
    """Shared stores, narrowed to an explicit one; nothing without shares."""
    allowed = [s for s in ctx.share_ids if store_id is None or s == store_id]
    return F.col(scope.store).isin(allowed) if allowed else F.lit(False)


def policy_filter(policy: str, scope: TableScope, ctx: AccessContext) -> Column:
    """Predicate of a resource policy; unknown policies and absent parts see nothing."""
    known: dict[str, Callable[[], Column]] = {
        "all_tenant": lambda: tenant_filter(scope, ctx),
        "current_store": lambda: store_filter(scope, ctx),
        "shared_stores": lambda: shared_filter(scope, ctx),
        "assigned_stores": lambda: F.col(scope.store).isin(list(ctx.assigned_store_ids)) if ctx.assigned_store_ids else F.lit(False),
        "own": lambda: F.lit(False) if ctx.user_id is None else F.col(scope.owner) == ctx.user_id,
    }
    return known[policy]() if policy in known else F.lit(False)


class Catalog:
    """Named tables with scopes over one root folder of Parquet tables, or given DataFrames."""

    def __init__(self, spark: SparkSession, root: str | None = None, frames: dict[str, DataFrame] | None = None, scopes: dict[str, TableScope] | None = None):
        self.spark, self.root, self.frames, self.scopes = spark, root, frames or {}, scopes or {}

    def raw(self, name: str) -> DataFrame:
        """Unscoped rows, for maintenance across tenants."""
        return self.frames[name] if name in self.frames else self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def scan(self, name: str, ctx: AccessContext, policy: str | None = None, tenant_id: int | None = None) -> DataFrame:
        """Rows that ctx may see, without deleted ones; tenant_id reads an explicit tenant."""
        scope = self.scopes.get(name, TableScope())
        rows = self.raw(name)
        if scope.deleted and scope.deleted in rows.columns:
            rows = rows.filter(~F.col(scope.deleted))
        if scope.kind == "none":
            return rows
        if tenant_id is not None:
            return rows.filter(F.col(scope.tenant) == tenant_id)
        rows = rows.filter(tenant_filter(scope, ctx))
        if scope.kind == "store_only":
            rows = rows.filter(store_filter(scope, ctx))
        elif scope.kind == "shared":
            rows = rows.filter(shared_filter(scope, ctx))
        return rows.filter(policy_filter(policy, scope, ctx)) if policy else rows

    def by_id(self, name: str, ctx: AccessContext, value: int) -> DataFrame:
        """The row of an id, if ctx may see it."""
        return self.scan(name, ctx).filter(F.col(self.scopes.get(name, TableScope()).key) == value).limit(1)

    def after(self, name: str, last: int, most: int) -> DataFrame:
        """The next rows of all tenants in id order: keyset batches for maintenance."""
        key = self.scopes.get(name, TableScope()).key
        return self.raw(name).filter(F.col(key) > last).orderBy(key).limit(most)


def share_sets(stores: DataFrame, store: str = "store_id", parent: str = "parent_id", kind: str = "store_type") -> DataFrame:
    """store, shared: one row per store whose data a store shares.

    A franchise shares with itself; headquarters with itself and its direct children; a direct store with its
    parent and that one's children; others with themselves.
    """
    me = stores.select(F.col(store).alias("store"), F.col(parent).alias("p"), F.col(kind).alias("k"))
    kids = me.select(F.col("p").alias("head"), F.col("store").alias("shared")).filter("head is not null")
    own = me.select("store", F.col("store").alias("shared"))
    down = me.filter("k = 'headquarters'").join(kids, F.col("store") == F.col("head")).select("store", "shared")
    across = me.filter("k = 'direct' and p is not null").join(kids, F.col("p") == F.col("head")).select("store", "shared")
    up = me.filter("k = 'direct' and p is not null").select("store", F.col("p").alias("shared"))
    return own.union(down).union(across).union(up).distinct()
