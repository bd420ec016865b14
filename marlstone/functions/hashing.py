"""Content, URL and source hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_or_empty


def content_hash(x: Column) -> Column:
    """SHA-256 of the text with white space made single blanks."""
    return F.sha2(F.trim(F.regexp_replace(text_or_empty(x), r"\s+", " ")), 256)


def url_hash(x: Column) -> Column:
    """SHA-256 of the address: scheme to path in lower case without a last slash, query and fragment as they are."""
    y = F.trim(x)
    path, query, mark = F.regexp_extract(y, r"^([^?#]*)", 1), F.regexp_extract(y, r"\?([^#]*)", 1), F.regexp_extract(y, r"#(.*)$", 1)
    file_name = F.parse_url(y, F.lit("QUERY"), F.lit("fileName"))
    whole = F.concat(
        F.lower(F.rtrim(path, F.lit("/"))),
        F.when(F.lower(path).endswith("/downloadwinfile") & (F.trim(F.coalesce(file_name, F.lit(""))) != ""), F.concat(F.lit("?filename="), F.trim(file_name)))
        .otherwise(F.concat(F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(mark != "", F.concat(F.lit("#"), mark)).otherwise(""))),
    )
    return content_hash(whole)


def source_hash(*parts: Column, trim: bool = True) -> Column:
    """SHA-256 of the parts joined by the unit separator; null parts are empty."""
    each = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("\u001f", *[F.trim(p) if trim else p for p in each]), 256)
