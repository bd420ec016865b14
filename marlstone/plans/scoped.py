"""Scoped scans and searches over the business tables: a region is a tenant, a nation a store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import AccessContext
from ..operators import search as S
from ..operators.joins import checked_broadcast
from ..session import table
from ..sources.catalog import Catalog, TableScope, share_sets
from .registry import query

AS_OF = datetime(2000, 1, 1)
SCOPES = {
    "customers": TableScope("tenant", "n_regionkey", "c_nationkey", "c_custkey", None, "c_custkey"),
    "suppliers": TableScope("shared", "n_regionkey", "s_nationkey", "s_suppkey", None, "s_suppkey"),
    "store_customers": TableScope("store_only", "n_regionkey", "c_nationkey", "c_custkey", None, "c_custkey"),
}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Customers and suppliers with the region of their nation as the tenant."""
    nation = checked_broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name"))
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    customers = customer.join(nation, customer.c_nationkey == nation.n_nationkey).drop("n_nationkey")
    suppliers = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).drop("n_nationkey")
    return Catalog(spark, sf_dir, {"customers": customers, "suppliers": suppliers, "store_customers": customers}, SCOPES)


CUSTOMERS = "(select c.*, n.n_regionkey, n.n_name from customer c join nation n on c.c_nationkey = n.n_nationkey)"
SUPPLIERS = "(select s.*, n.n_regionkey, n.n_name from supplier s join nation n on s.s_nationkey = n.n_nationkey)"
CUSTOMER_SEARCH = S.SearchSpec(["c_name", "c_mktsegment"], {"balance": ["c_acctbal desc"], "name": ["c_name"]}, "name", "c_custkey", "c_custkey")


@query(f"""select c_custkey, c_name, c_mktsegment from {CUSTOMERS} where n_regionkey = 1 and (contains(lower(c_name), 'build') or contains(lower(c_mktsegment), 'build'))
order by c_acctbal desc, c_custkey limit 20 offset 20""")
def scoped_tenant_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL2, FIL9, ST2, ST4: second page of a tenant's customers by keyword."""
    rows = catalog(spark, sf_dir).scan("customers", AccessContext(AS_OF, tenant_id=1))
    return S.page_rows(S.search(rows, CUSTOMER_SEARCH, " BUILD ", sort="balance"), 2, 0).select("c_custkey", "c_name", "c_mktsegment")


@query("select c_custkey, c_name from customer where false")
def missing_scope_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL2: no tenant, no rows."""
    return catalog(spark, sf_dir).scan("customers", AccessContext(AS_OF)).select("c_custkey", "c_name")


@query(f"select s_suppkey, s_name from {SUPPLIERS} where n_regionkey = 2 and s_nationkey in (2, 7, 12)")
def shared_store_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL4: rows of shared stores."""
    return catalog(spark, sf_dir).scan("suppliers", AccessContext(AS_OF, tenant_id=2, share_ids=(2, 7, 12))).select("s_suppkey", "s_name")


@query(f"select c_custkey, c_acctbal from {CUSTOMERS} where n_regionkey = 2 and c_nationkey = 7")
def store_only_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL3: rows of the own store."""
    return catalog(spark, sf_dir).scan("store_customers", AccessContext(AS_OF, tenant_id=2, store_id=7)).select("c_custkey", "c_acctbal")


@query(f"select c_custkey from {CUSTOMERS} where n_regionkey = 1 and c_nationkey in (1, 6, 11)")
def policy_assigned_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3, FIL5: a resource policy on top of the tenant."""
    return catalog(spark, sf_dir).scan("customers", AccessContext(AS_OF, tenant_id=1, assigned_store_ids=(1, 6, 11)), "assigned_stores").select("c_custkey")


@query(f"select c_custkey, c_name from {CUSTOMERS} where n_regionkey = 4")
def explicit_tenant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4: an explicit tenant overrides the context's."""
    return catalog(spark, sf_dir).scan("customers", AccessContext(AS_OF, tenant_id=1), tenant_id=4).select("c_custkey", "c_name")


@query(f"select c_custkey, c_name, c_acctbal from {CUSTOMERS} where n_regionkey = 2 and c_custkey = 16")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: one row by id, within scope."""
    return catalog(spark, sf_dir).by_id("customers", AccessContext(AS_OF, tenant_id=2), 16).select("c_custkey", "c_name", "c_acctbal")


@query("select c_custkey, c_name from customer where c_custkey > 100 order by c_custkey limit 50")
def keyset_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7, SRC8: the next batch in key order."""
    return catalog(spark, sf_dir).after("customers", 100, 50).select("c_custkey", "c_name")


@query("""with s as (select n_nationkey as store, case when n_nationkey % 5 = 0 then null else n_nationkey - n_nationkey % 5 end as p,
  case when n_nationkey % 5 = 0 then 'headquarters' when n_nationkey % 2 = 0 then 'direct' else 'franchise' end as k from nation)
select store, store as shared from s union select s.store, c.store from s join s c on c.p = s.store where s.k = 'headquarters'
union select store, p from s where k = 'direct' and p is not null union select s.store, c.store from s join s c on c.p = s.p where s.k = 'direct'""")
def share_set_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL7: who shares with whom, by the kind of store."""
    n = F.col("n_nationkey")
    stores = table(spark, sf_dir, "nation").select(
        n.alias("store_id"),
        F.when(n % 5 != 0, n - n % 5).alias("parent_id"),
        F.when(n % 5 == 0, "headquarters").when(n % 2 == 0, "direct").otherwise("franchise").alias("store_type"),
    )
    return share_sets(stores)


PART_SEARCH = S.SearchSpec(
    ["p_name", "p_brand", "p_type"],
    {"price": ["p_retailprice"], "price_desc": ["p_retailprice desc"], "name": ["p_name"], "size": ["p_size desc"]},
    "name",
    "p_partkey",
    "p_partkey",
)


@query("select p_partkey, p_name, p_retailprice from part where p_retailprice >= 900.5 and p_retailprice <= 960 order by p_retailprice desc, p_partkey limit 100")
def price_range_named_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL10, ST4: a range with a named sort."""
    found = S.search(table(spark, sf_dir, "part"), PART_SEARCH, filters=[S.range_filter("p_retailprice", 900.5, 960)], sort="price_desc")
    return found.limit(100).select("p_partkey", "p_name", "p_retailprice")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'red') or contains(lower(p_brand), 'red') or contains(lower(p_type), 'red')")
def keyword_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL9: a keyword in any of three columns."""
    return table(spark, sf_dir, "part").filter(S.keyword_filter(PART_SEARCH.keyword_columns, "red")).select("p_partkey", "p_name")


@query("select p_partkey, p_name from part where p_partkey = 42")
def numeric_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL13: a number is an id."""
    return S.search(table(spark, sf_dir, "part"), PART_SEARCH, "42").select("p_partkey", "p_name")


@query("""select o_orderkey, o_orderpriority from orders where starts_with(o_orderpriority, '1') and o_orderstatus = 'F' and o_orderdate >= timestamp '1997-01-01'""")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL8, FIL11, FIL12, FIL14: present arguments filter, absent and unknown ones don't."""
    filters = [S.choice_filter("o_orderstatus", "f", ["F", "O", "P"]), S.choice_filter("o_orderstatus", "nonsense", ["F"]), S.presence_filter("o_totalprice", True), S.presence_filter("o_totalprice", None)]
    rows = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1") & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")))
    for f in filters:
        rows = rows.filter(f)
    return rows.select("o_orderkey", "o_orderpriority")


@query("select event_id, user_id from events where json_extract_string(props, '$.k') = '7'")
def json_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL15, SC32: an exact value inside JSON."""
    return table(spark, sf_dir, "events").filter(S.json_value_filter("props", "$.k", 7)).select("event_id", "user_id")


@query("""select o_orderkey, o_orderpriority from (select * from orders order by o_orderdate desc, o_orderkey limit 2000)
where contains(lower(o_orderpriority), 'urgent') or contains(lower(o_orderstatus), 'urgent')""")
def keyword_after_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL16: a keyword over the newest 2000 rows; the cap is part of the result."""
    newest = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(2000)
    return newest.filter(S.keyword_filter(["o_orderpriority", "o_orderstatus"], "urgent")).select("o_orderkey", "o_orderpriority")


@query("select p_retailprice, p_partkey, p_name from part")
def picked_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1-PRJ4: requested columns, in their order, ignoring case."""
    return S.pick_columns(table(spark, sf_dir, "part"), ["P_RetailPrice", "p_partkey", "P_NAME"])
