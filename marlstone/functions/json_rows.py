"""JSON documents as rows of tokens: masking, search by name and canonical form, at any depth, in built-in functions only.

A document is cut into tokens by one pattern; windows over the tokens of a document tell the level of each, where each bracket closes and
what lies within a member. Work is linear in the tokens but for sorting them by place. VARIANT parsing tells what is JSON and orders the keys of the canonical
form. A document is named by a key that is unique among the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from .masking import MASK, SENSITIVE_KEYS

TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]:,]|[^\s{}\[\]:,"]+'
CHARACTER = 40  # bytes that a character of a document takes as token rows: a token has some four, its row some 160 bytes
IDENTITY = ["tenantid", "tenant_id", "storeid", "store_id", "userid", "user_id"]  # fixed values: who asks, no part of what is asked


def is_json(x: Column) -> Column:
    """Whether a text can be read as JSON, members that stand there twice included."""
    return F.get_json_object(x, "$").isNotNull()


def _placed(rows: DataFrame, key: str, column: str) -> DataFrame:
    """rows dealt by their key before they are cut up, by the characters of all documents: documents are shuffled, and not their tokens."""
    return spread(rows, [key], (rows.agg(F.sum(F.length(column))).first()[0] or 0) * CHARACTER)


def tokens(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, pos, tok, level, opens, closes, name, named, starts_in, ends, begins: the tokens of all documents that are JSON.

    level: brackets open around the token, its own included. name: the member's name without quotes, lower case, of a token that begins its value (`named` is true
    then). starts_in: place of the bracket that the token stands in directly. ends: of an opening bracket, the place where it closes.
    """
    return _tokens(_placed(rows, key, column), key, column)


def _tokens(rows: DataFrame, key: str, column: str) -> DataFrame:
    each = rows.filter(is_json(F.col(column))).select(key, F.posexplode(F.regexp_extract_all(column, F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
    w = Window.partitionBy(key).orderBy("pos")
    opens, closes = F.col("tok").isin("{", "["), F.col("tok").isin("}", "]")
    each = each.withColumns({"opens": opens, "closes": closes, "named": F.coalesce(F.lag("tok").over(w) == ":", F.lit(False)), "__name": F.lag("tok", 2).over(w)})
    depth = F.sum(F.when(F.col("opens"), 1).when(F.col("closes"), -1).otherwise(0)).over(w)
    each = each.withColumn("level", depth + F.when(F.col("closes"), 1).otherwise(0))
    bracket = F.col("opens") | F.col("closes")
    same = Window.partitionBy(key, "level", bracket).orderBy("pos")
    inner = Window.partitionBy(key, "level").orderBy("pos")
    return each.select(
        key, "pos", "tok", "level", "opens", "closes", "named", F.when(F.col("named"), F.lower(F.expr("substring(__name, 2, length(__name) - 2)"))).alias("name"),
        F.last(F.when(F.col("opens"), F.col("pos")), ignorenulls=True).over(inner).alias("starts_in"), F.when(F.col("opens"), F.lead("pos").over(same)).alias("ends"), F.when(F.col("closes"), F.lag("pos").over(same)).alias("begins"),
    )


def _within(each: DataFrame, key: str, member: Column) -> DataFrame:
    """each with `chosen` (begins the value of a chosen member) and `hidden` (lies behind the first token of such a value)."""
    w = Window.partitionBy(key).orderBy("pos")
    marked = each.withColumn("chosen", F.coalesce(F.col("named") & member, F.lit(False)))
    bracket = F.col("opens") | F.col("closes")
    same = Window.partitionBy(key, "level", bracket).orderBy("pos")
    closing = F.col("closes") & F.coalesce(F.lag("chosen").over(same), F.lit(False))
    step = F.when(F.col("chosen") & F.col("opens"), 1).when(closing, -1).otherwise(0)
    marked = marked.withColumn("__step", step)
    before = F.coalesce(F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("hidden", before > 0).drop("__step")


def _joined(kept: DataFrame, key: str, name: str, comma: str, colon: str) -> DataFrame:
    """key and the document made of the tokens `out`, commas put where one value follows another."""
    w = Window.partitionBy(key).orderBy("pos")
    values = kept.filter("tok <> ','")
    last, after = F.lag("out").over(w), F.lead("tok").over(w)
    is_key = F.startswith("tok", F.lit('"')) & F.coalesce(after == ":", F.lit(False))
    values = values.withColumn("__key", is_key)
    between = last.isNotNull() & ~last.isin("{", "[", ":") & ~F.col("tok").isin("}", "]", ":")
    shown = F.concat(F.when(between, F.lit(comma)).otherwise(F.lit("")), F.when(F.col("out") == ":", F.lit(colon)).otherwise(F.col("out")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "__shown"))), lambda x: x["__shown"])
    return values.withColumn("__shown", shown).groupBy(key).agg(F.array_join(parts, "").alias(name))


def masked(rows: DataFrame, key: str, column: str) -> DataFrame:
    """rows with the values of sensitive members masked at any depth, whole objects and lists as one; what is not JSON stays."""
    plain = F.replace(F.col("name"), F.lit("-"), F.lit(""))
    sensitive = F.exists(F.array(*[F.lit(s) for s in SENSITIVE_KEYS]), lambda s: F.contains(plain, s))
    placed = _placed(rows, key, column)
    each = _within(_tokens(placed, key, column), key, sensitive)
    kept = each.filter("not hidden").withColumn("out", F.when(F.col("chosen"), F.lit(f'"{MASK}"')).otherwise(F.col("tok")))
    # A masked object's bracket stands for the whole: it is a value like any other.
    kept = kept.withColumn("tok", F.col("out"))
    done = _joined(kept, key, "__masked", ", ", ": ")
    return placed.join(done, key, "left").withColumn(column, F.coalesce("__masked", column)).select(*rows.columns)


def found(rows: DataFrame, key: str, column: str, names: list[str]) -> DataFrame:
    """key and, for each name, the first scalar under it, ignoring case: outer objects before inner ones, members in order; null if there is none."""
    placed = _placed(rows, key, column)
    each = _tokens(placed, key, column).filter(F.col("named") & ~F.col("opens") & (F.col("tok") != "null") & F.col("name").isin([n.lower() for n in names]))
    text = F.when(F.startswith("tok", F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), "tok", F.lit("}")), "$.v")).otherwise(F.col("tok"))
    firsts = [F.min(F.when(F.col("name") == n.lower(), F.struct("starts_in", "pos", text.alias("t"))))["t"].alias(n) for n in names]
    return placed.select(key).join(each.groupBy(key).agg(*firsts), key, "left")


def canonical(rows: DataFrame, key: str, column: str, name: str, without: list[str] = IDENTITY) -> DataFrame:
    """rows with `name`: the document without the caller's identity at any depth, keys in order, no blanks; null for what is not JSON or has a member twice."""
    w = Window.partitionBy(key).orderBy("pos")
    placed = _placed(rows, key, column)
    each = _within(_tokens(placed, key, column), key, F.col("name").isin(without))
    # The name and the colon before a chosen value go with it.
    gone = F.col("hidden") | F.col("chosen") | F.coalesce(F.lead("chosen").over(w), F.lit(False)) | F.coalesce(F.lead("chosen", 2).over(w) & (F.lead("tok").over(w) == ":"), F.lit(False))
    kept = each.withColumn("__gone", gone).filter("not __gone").withColumn("out", F.col("tok"))
    done = _joined(kept, key, "__left", ",", ":")
    return placed.join(done, key, "left").withColumn(name, F.to_json(F.try_parse_json("__left"))).drop("__left")


def fingerprints(rows: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """rows with the SHA-256 of the canonical form: equal requests have equal fingerprints."""
    return canonical(rows, key, column, "__canonical").withColumn(name, F.sha2("__canonical", 256)).drop("__canonical")
