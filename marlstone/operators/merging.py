"""Merging records that tell of the same thing: scored pairs, components, a survivor, back-filled fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import keys_compatible, org_match_key
from ..session import settled
from .analytics import first_per_key
from .joins import block_components, contained_either_way, pairs_in_block


SUPPLIER_KEY = "__supplier_key"
COMPARED = ["source", "outcome_type", "rank", "supplier", "package_no", "sequence_no", "page", "evidence", "lot_no", "lot_name", "amount"]  # and, with_keys, SUPPLIER_KEY


def with_keys(rows: DataFrame) -> DataFrame:
    """Outcome records with the match key of their supplier: cleaned once a row, compared once a pair."""
    return rows.withColumn(SUPPLIER_KEY, org_match_key(F.col("supplier")))


def _both(c: str) -> Column:
    """Both sides have a value and it is alike, ignoring case: then neither is blank if one is not."""
    a, b = F.col(f"{c}_a").cast("string"), F.col(f"{c}_b").cast("string")
    return (F.trim(a) != "") & (F.upper(a) == F.upper(b))


def _compatible(c: str) -> Column:
    """One side lacks a value, or one holds the other: every text holds the empty one."""
    a, b = F.lower(F.trim(F.coalesce(f"{c}_a", F.lit("")))), F.lower(F.trim(F.coalesce(f"{c}_b", F.lit(""))))
    return F.contains(a, b) | F.contains(b, a)


def outcome_pair_score() -> Column:
    """Points of a pair of outcome records over COMPARED and SUPPLIER_KEY; 0 where type, rank, supplier, package or lots contradict each other."""
    clash = lambda c: F.coalesce(F.col(f"{c}_a") != F.col(f"{c}_b"), F.lit(False))
    supplier = keys_compatible(F.col(f"{SUPPLIER_KEY}_a"), F.col(f"{SUPPLIER_KEY}_b"))
    evidence_ = _both("evidence") | ((F.length("evidence_a") >= 12) & (F.length("evidence_b") >= 12) & contained_either_way(F.col("evidence_a"), F.col("evidence_b")))
    alike = F.col("outcome_type_a") == F.col("outcome_type_b")
    hard = alike & ~clash("rank") & ~clash("package_no") & supplier & _compatible("lot_no") & _compatible("lot_name")
    rules = [
        (_both("package_no"), 25), (_both("sequence_no") & ~clash("page"), 30), (evidence_, 30), (F.abs(F.col("amount_a") - F.col("amount_b")) < F.lit(0.01).cast("decimal(18,2)"), 10), (_both("page"), 10),
    ]
    # Supplier (40), lot number (25), lot name (15) and type (10) are alike wherever nothing contradicts: their points are no question of a pair.
    score = F.lit(40 + 25 + 15 + 10)
    for holds, weight in rules:
        score = score + F.when(F.coalesce(holds, F.lit(False)), weight).otherwise(0)
    return F.when(hard, score).otherwise(F.lit(0))


def outcome_threshold() -> Column:
    """Points from which two records are one: 65 between a model's and a PDF table's, 70 where one side is either, else 85."""
    of = lambda s: (F.col("source_a") == s, F.col("source_b") == s)
    (ai_a, ai_b), (pdf_a, pdf_b) = of("ai"), of("pdf")
    return F.when((ai_a & pdf_b) | (pdf_a & ai_b), 65).when(ai_a | ai_b | pdf_a | pdf_b, 70).otherwise(85)


def merge_records(rows: DataFrame, block: list[str], key: str, compared: list[str], score: Column, threshold: Column | int, best: list[Column], fill: list[str], fill_order: list[Column] | None = None, members: str | None = None) -> DataFrame:
    """One row per component of pairs scored at or above the threshold: the best row, its empty fields filled from the others.

    Pairs are made within a block, which is one document's records and so bounded; they are scored once, and components are told block by block. `score` and `threshold` are over the columns
    suffixed _a and _b; `best` ranks survivors and must end in a unique key; a field is filled with the value of the first row
    that has one, by `fill_order` (by `best` where not given). `members` names a column for the size of the component.
    """
    rows = settled(rows, "records")
    pairs = settled(pairs_in_block(rows, block, key, compared).filter(score >= threshold).select(*block, f"{key}_a", f"{key}_b"), "pairs")
    labels = block_components(pairs, block, f"{key}_a", f"{key}_b", pairs.count()).select(F.col("node").alias(key), F.col("label").alias("__group"))
    labels = settled(labels, "labels")
    w = Window.partitionBy("__group")
    ranked = rows.join(labels, key).withColumns({"__rn": F.row_number().over(w.orderBy(*best)), "__p": F.row_number().over(w.orderBy(*(fill_order or best)))})
    first = [F.min_by(F.struct(*rows.columns), "__rn").alias("__s"), F.count("*").alias("__n")]
    filled = ranked.groupBy("__group").agg(*first, *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__p"))).alias(f"__{c}") for c in fill])
    out = [F.coalesce(F.col(f"__s.{c}"), F.col(f"__{c}")).alias(c) if c in fill else F.col(f"__s.{c}").alias(c) for c in rows.columns]
    merged = filled.select(*out, *([F.col("__n").alias(members)] if members else []))
    # A record that is in no pair stays as it is.
    alone = rows.join(labels, key, "left_anti")
    return merged.unionByName(alone.withColumn(members, F.lit(1).cast("long")) if members else alone)


def greedy_uncovered(rows: DataFrame, on: list[str], key: str, order: list[Column], covers: Column) -> DataFrame:
    """Rows that a walk in order keeps: one falls if a row kept before it covers it, and a row that fell covers nothing.

    covers: over the columns of the row before, suffixed _a, and of the row in question, suffixed _b; only rows equal in `on` meet. `order` must be
    total and `key` unique. The walk is done in rounds over all groups at once: a row stays when all rows that cover it fell, and falls when one of them stays;
    there are as many rounds as the longest chain of such decisions. Undecided rows alone enter the next round.
    """
    place = F.row_number().over(Window.partitionBy(*on).orderBy(*order))
    placed = settled(rows.withColumn("__place", place), "placed")
    side = lambda s: placed.select(*on, *[F.col(c).alias(f"{c}{s}") for c in placed.columns if c not in on])
    met = side("_a").join(side("_b"), on).filter((F.col("__place_a") < F.col("__place_b")) & covers)
    edges = settled(met.select(F.col(f"{key}_a").alias("by"), F.col(f"{key}_b").alias("row")), "covers")
    fell = None
    while not edges.isEmpty():
        # A row that covers and that nothing undecided covers stays: what it covers falls, and so what those cover is free of them.
        stays = edges.select("by").distinct().join(edges.select(F.col("row").alias("by")).distinct(), "by", "left_anti")
        falls = settled(edges.join(stays, "by", "left_semi").select("row").distinct(), "fell")
        fell = falls if fell is None else fell.unionByName(falls)
        left = edges.join(falls, "row", "left_anti").join(falls.select(F.col("row").alias("by")), "by", "left_anti")
        edges = settled(left, "covers")
    out = placed.drop("__place")
    return out if fell is None else out.join(fell.select(F.col("row").alias(key)), key, "left_anti").select(*rows.columns)


def less_specific_pruned(rows: DataFrame, group: list[str], package: str, supplier: str, lot_no: str, lot_name: str, order: list[Column]) -> DataFrame:
    """Rows left of each group (package, outcome, rank): one a supplier, and none without a lot where a row with package and lot stands.

    The preferred row of a supplier is the first by lot number, lot name, package, then `order`, which must be total.
    """
    there = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    lot = there(lot_no) | there(lot_name)
    one = first_per_key(rows, [*group, supplier], [there(lot_no).desc(), lot.desc(), there(package).desc(), *order])
    strong = one.filter(lot & there(package)).select(*[F.col(g).alias(f"__of_{g}") for g in group]).distinct()
    on = ~lot
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    return one.join(strong, on, "left_anti")


def upsert_organisations(old: DataFrame, seen: DataFrame, name: str, fill: list[str], update: list[str], newest: list[Column]) -> DataFrame:
    """Master data of organisations after a load of mentions: match_key and the columns of fill_or_update.

    Mentions are put together by the match key of their name, which is computed once for each distinct name; of each column the newest mention that has a value counts.
    Names without a key (blank, only marks) name nobody. old: match_key, name, fill and update columns.
    """
    keys = seen.select(name).distinct().withColumn("match_key", org_match_key(F.col(name))).filter("match_key <> ''")
    rows = seen.join(keys, name).withColumn("__place", F.row_number().over(Window.partitionBy("match_key").orderBy(*newest)))
    columns = [name, *fill, *update]
    new = rows.groupBy("match_key").agg(*[F.min_by(c, F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.col("__place"))).alias(c) for c in columns])
    return fill_or_update(old, new, "match_key", [name, *fill], update)


def fill_or_update(old: DataFrame, new: DataFrame, key: str, fill: list[str], update: list[str]) -> DataFrame:
    """Master data after a load: keys of either side; `fill` columns keep their value unless null, `update` columns take the new one unless null."""
    o, n = old.select(*[F.col(c).alias(f"o_{c}") for c in [key, *fill, *update]]), new.select(*[F.col(c).alias(f"n_{c}") for c in [key, *fill, *update]])
    both = o.join(n, F.col(f"o_{key}") == F.col(f"n_{key}"), "full")
    take = lambda c, a, b: F.coalesce(F.col(f"{a}_{c}"), F.col(f"{b}_{c}")).alias(c)
    return both.select(take(key, "o", "n"), *[take(c, "o", "n") for c in fill], *[take(c, "n", "o") for c in update])
