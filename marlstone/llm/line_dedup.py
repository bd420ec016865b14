"""Line deduplication by overlapping three-line windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import no_id, plain_id, table

WINDOW = 3
BLANKS = " \t\r\f\u00a0"


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """Remove lines that lie in a later occurrence of a repeated window of consecutive lines.

    Lines are split at line feeds; they compare without surrounding blanks. Blank lines are never counted
    or removed. A window is `window` consecutive non-blank lines; of all windows with equal lines, the one
    with the smallest (doc_id, position) is the first, and every other one marks its positions. Marked
    positions of a document merge, and their lines go. Every removed line stays at its first place.

    Returns docs with `text` replaced, and n_lines, n_removed (long; `counts` names them otherwise). Null text stays null with 0 lines; texts
    of fewer than `window` non-blank lines hold no window; null ids sort first; ids that are no whole numbers sort as strings, null like the empty one; rows that share id and text
    are the same occurrence, so neither is later than the other. Other columns stay.

    Windows travel as two 64-bit hashes, the id and a position. The first place of each window is a
    partially aggregated minimum, so a passage in a third of the documents is no hot group there; the join back
    has one row per repeated window on one side, which AQE can split. Texts are moved once, when the marks
    of their lines meet them by id and content.
    """
    rows = docs.withColumns(
        {
            "__id": F.coalesce(plain_id(docs, doc_id), no_id(docs, doc_id)),
            "__h": F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
            "__null": F.col(text).isNull(),
            "__lines": F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1),
        }
    ).drop(text)
    trimmed = F.transform("__lines", lambda x, i: F.struct(i.alias("ord"), F.trim(x, F.lit(BLANKS)).alias("t")))
    solid = rows.select("__id", "__h", F.filter(trimmed, lambda x: x["t"] != "").alias("s"))
    line = lambda i, k: F.get("s", i + k)["t"]
    keys = F.transform(
        F.when(F.size("s") >= window, F.sequence(F.lit(0), F.size("s") - window)),
        lambda i: F.struct(
            F.xxhash64(*[line(i, k) for k in range(window)]).alias("a"),
            F.xxhash64(F.lit("second"), *[line(i, k) for k in reversed(range(window))]).alias("b"),
            F.array(*[F.get("s", i + k)["ord"] for k in range(window)]).alias("at"),
        ),
    )
    windows = solid.select("__id", "__h", F.inline(keys))
    place = F.struct("__id", "__h", "at")
    first = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") != F.col("last"))
    later = windows.join(first.select("a", "b", "first"), ["a", "b"]).filter(place != F.col("first"))
    # A document's own line numbers: no more of them than it has lines.
    marks = later.groupBy("__id", "__h").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("__gone"))
    out = rows.join(marks.hint("shuffle_hash"), ["__id", "__h"], "left")
    gone = F.coalesce("__gone", F.array().cast("array<int>"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), gone), lambda i: F.get("__lines", i))
    out = out.withColumns(
        {
            text: F.when(~F.col("__null"), F.array_join(left, "\n")),
            counts[0]: F.when(F.col("__null"), 0).otherwise(F.size("__lines")).cast("long"),
            counts[1]: F.size(gone).cast("long"),
        }
    )
    return out.select(*docs.columns, *[c for c in counts if c not in docs.columns])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its remaining text and counts of lines."""
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = """
with raw as (select doc_id, coalesce(text, '') as t, text is null as none from documents),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as ord from raw),
solid as (select *, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(160)) as s from lines),
numbered as (select doc_id, ord, s, row_number() over (partition by doc_id order by ord) - 1 as pos from solid where s <> ''),
windows as (select doc_id, pos, s || chr(10) || lead(s, 1) over w || chr(10) || lead(s, 2) over w as key from numbered window w as (partition by doc_id order by pos)),
ranked as (select *, row_number() over (partition by key order by doc_id, pos) as n from windows where key is not null),
gone as (select distinct doc_id, pos + k as pos from ranked, (values (0), (1), (2)) as v(k) where n > 1),
kept as (select s.doc_id, s.ord, s.line, g.pos is not null as removed from solid s
  left join numbered n on s.doc_id = n.doc_id and s.ord = n.ord left join gone g on g.doc_id = n.doc_id and g.pos = n.pos)
select r.doc_id, case when none then null else coalesce(k.text, '') end as text,
  case when none then 0 else k.n_lines end as n_lines, coalesce(k.n_removed, 0) as n_removed
from raw r left join (select doc_id, string_agg(line, chr(10) order by ord) filter (not removed) as text,
  count(*) as n_lines, count(*) filter (removed) as n_removed from kept group by doc_id) k using (doc_id)
"""
