"""Secret scan over an incremental blob ledger, in DataFrame operations only.

Every text version is addressed by its content (SHA-256). A ledger says with which version of which rule a
blob has been scanned, clean blobs included; only unseen pairs of blob and rule version are scanned, and the
findings are joined back to all paths.

Match positions come without a UDF: `split` gives the pieces between the matches of a rule and
`regexp_extract_all` the matches; a running sum of their lengths, one row a match, gives starts and ends in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle, table


@dataclass(frozen=True)
class Rule:
    """A pattern; `least` is the fewest characters that its `measured` group needs for a match to count.

    `hint` is a cheap condition that every text with a match fulfils; texts without it skip the pattern.
    """

    kind: str
    pattern: str
    measured: int
    least: int
    hint: str
    base: bool = False
    version: int = 1

    @property
    def name(self) -> str:
        """How the ledger calls this version of the rule."""
        return f"{self.kind}:{self.version}"


# The three base rules of the contract, in the order in which ties are listed.
# hex asks for 32 characters in the pattern itself: the maximal runs are the same.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"(?i)passw(?:or)?d|secret|token|api_?key", True),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 16, "AKIA", True),
    Rule("hex", r"([0-9a-f]{32,})", 1, 32, r"[0-9a-f]{32}", True),
)
EXTRA_RULES = (
    Rule("private_key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 20, "PRIVATE KEY-----"),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 1, 32, "eyJ"),
    Rule("hub_token", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 40, "gh[pousr]_"),
    Rule("uri_password", r"([a-z][a-z0-9+]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{1,128}@)", 1, 8, "://"),
)
RULES = BASE_RULES + EXTRA_RULES
FOUND = "array<struct<start:bigint,rank:int,kind:string,end:bigint,base:boolean,version:int>>"
NEAR_BLOBS = 500_000  # blobs, of some 100 bytes each, that are sent to all tasks at most; more are joined by shuffle


def _parts(text: Column, rule: Rule) -> Column:
    """array<struct<gap, len, size>> of one rule's matches: characters before it since the last one, in it, in its measured group."""
    pieces, matches = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.measured))
    return F.zip_with(
        F.slice(pieces, 1, F.size(matches)),
        F.arrays_zip(matches.alias("m"), measured.alias("g")),
        lambda piece, m: F.struct(F.length(piece).alias("gap"), F.length(m["m"]).alias("len"), F.length(m["g"]).alias("size")),
    )


def suspect(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether a text may hold a match of any of the rules."""
    out = F.lit(False)
    for rule in rules:
        out = out | text.rlike(rule.hint)
    return out


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, found of those rows of (blob, text, due) with a finding; only rules whose name is in `due` are applied.

    found is ordered by start, then rule order. Work and memory follow the number of matches: each is a row.
    """
    none = F.array().cast("array<struct<gap:int,len:int,size:int>>")
    each = [
        F.struct(
            F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), F.lit(rule.base).alias("base"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"),
            F.when(F.array_contains("due", rule.name) & F.col("text").rlike(rule.hint), _parts(F.col("text"), rule)).otherwise(none).alias("parts"),
        )
        for rank, rule in enumerate(rules)
    ]
    by_rule = blobs.select("blob", F.inline(F.array(*each))).filter(F.size("parts") > 0)
    match = by_rule.select("blob", "rank", "kind", "base", "version", "least", F.posexplode("parts").alias("at", "p"))
    upto = F.sum(F.col("p.gap") + F.col("p.len")).over(W.partitionBy("blob", "rank").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    placed = match.withColumn("end", upto.cast("bigint")).filter(F.col("p.size") >= F.col("least"))
    one = F.struct((F.col("end") - F.col("p.len")).alias("start"), "rank", "kind", "end", "base", "version")
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(one)).cast(FOUND).alias("found"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    """A ledger that has seen nothing."""
    return spark.createDataFrame([], f"blob string, rules array<string>, found {FOUND}")


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings of every path, and what a caller appends to the ledger.

    versions: one row per historical version (path, text); the same text may stand under many paths.
    ledger: blob, rules (names of the rule versions that it was scanned with), found, of earlier runs; null scans everything.
    Returns (findings, news): findings has `path`, `blob`, `found` for every row of versions; news has a row for every
    blob scanned now, clean ones too. Null text counts as empty, null paths keep their row, repeated rows stay repeated,
    other columns are dropped (so clashing names do no harm), an empty table gives empty results.

    With a ledger, digests alone meet it first; a text is read again, at one of its paths, only where a pair is
    unseen. Without one every pair is unseen, so digest and hints come in one pass and only texts with a hint are kept for the
    patterns. A text under a third of all paths is no hot key: blobs are distinct before anything is joined but the paths themselves.
    """
    spark = versions.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    rows = versions.select(F.col(path).alias("path"), content.alias("text"))
    names = F.array(*[F.lit(r.name) for r in rules])
    none = F.array().cast(FOUND)
    if ledger is None:
        read = settle(rows.select("path", F.sha2("text", 256).alias("blob"), F.when(suspect(F.col("text"), rules), F.col("text")).alias("text")), "read")
        paths = read.select("path", "blob")
        due = paths.select("blob").distinct().withColumn("due", names)
        texts = read.filter("text is not null").groupBy("blob").agg(F.first("text").alias("text")).withColumn("due", names)
        known = None
    else:
        mark = F.xxhash64("text")
        read = settle(rows.select("path", mark.alias("mark"), F.sha2("text", 256).alias("blob")), "read")
        paths = read.select("path", "blob")
        blobs = read.groupBy("blob").agg(F.min(F.struct("path", "mark")).alias("one"))
        past = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"), F.flatten(F.collect_list("found")).alias("found"))
        met = settle(blobs.join(past, "blob", "left").select("blob", "one", F.array_except(names, F.coalesce("rules", F.array().cast("array<string>"))).alias("due"), "found"), "met")
        due = met.filter(F.size("due") > 0).select("blob", "due")
        # Findings of rule versions that stand no more are left out.
        current = F.filter("found", lambda f: F.array_contains(names, F.concat_ws(":", f["kind"], f["version"])))
        known = met.filter(F.size("found") > 0).select("blob", current.alias("found"))
        n = due.count()
        if n == 0:
            texts = None
        else:
            wanted = met.filter(F.size("due") > 0).select("blob", "due", F.col("one.path").alias("__path"), F.col("one.mark").alias("__mark"))
            wanted = F.broadcast(wanted) if n <= NEAR_BLOBS else wanted
            at = rows.join(wanted, F.col("path").eqNullSafe(F.col("__path")) & (mark == F.col("__mark")))
            texts = at.filter(suspect(F.col("text"), rules)).dropDuplicates(["blob"]).select("blob", "text", "due")
    # Settled before it is joined back: scanned once for both results, and a hot blob's paths can be split.
    scanned = settle(scan_blobs(texts, rules), "scanned") if texts is not None else spark.createDataFrame([], f"blob string, found {FOUND}")
    news = due.join(scanned, "blob", "left").select("blob", F.col("due").alias("rules"), F.coalesce("found", none).alias("found"))
    found = scanned
    if known is not None:
        found = known.unionByName(scanned).groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))
    joined = paths.join(found, "blob", "left").select("path", "blob", F.coalesce("found", none).alias("found"))
    return joined, news


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of the findings in every text of documents."""
    found, _ = scan_versions(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        F.col("path").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def _sql_kind(rank: int, rule: Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
  select doc_id, {rank} as rank, '{rule.kind}' as kind, {str(rule.base).lower()} as base,
         list_sum([length(x) for x in pieces[1:i]]) + coalesce(list_sum([length(x) for x in hits[1:i - 1]]), 0) as s,
         length(hits[i]) as len, length(measured[i]) as size, {rule.least} as least
  from (select *, unnest(range(1, len(hits) + 1)) as i from (
    select doc_id, string_split_regex(t, '{p}') as pieces, regexp_extract_all(t, '{p}') as hits, regexp_extract_all(t, '{p}', {rule.measured}) as measured
    from (select doc_id, coalesce(text, '') as t from documents)))"""


OP5_SQL = (
    "with spans as ("
    + " union all ".join(_sql_kind(i, r) for i, r in enumerate(RULES))
    + """), kept as (select *, kind || ':' || cast(s as bigint) || ':' || cast(s + len as bigint) as span from spans where size >= least),
per_doc as (select doc_id, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as k, count(*) filter (kind = 'hex') as h,
  string_agg(span, ',' order by s, rank) filter (base) as base_spans, string_agg(span, ',' order by s, rank) as spans from kept group by doc_id)
select d.doc_id, coalesce(a, 0) as n_assign, coalesce(k, 0) as n_access, coalesce(h, 0) as n_hex,
  sha256(coalesce(base_spans, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join per_doc using (doc_id)"""
)
