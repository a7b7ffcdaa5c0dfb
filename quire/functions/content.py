"""Content and formatting functions as Column expressions.

Python truthiness (``a or b`` skips None *and* empty strings) is expressed
with ``nullif(x, '')`` inside ``coalesce``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c) -> Column:
    """Null when the string is null or empty (Python falsy string)."""
    return F.nullif(_col(c), F.lit(""))


def has_content(raw_content="raw_content", raw_source="raw_source",
                markdown="markdown", summary="summary") -> Column:
    """Any of the four texts is non-empty."""
    return F.coalesce(nz(raw_content), nz(raw_source), nz(markdown), nz(summary)).isNotNull()


def primary_content(markdown="markdown", raw_content="raw_content",
                    raw_source="raw_source") -> Column:
    """Markdown -> raw_content -> raw_source (last one as is)."""
    return F.coalesce(nz(markdown), nz(raw_content), _col(raw_source))


def summary_content(summary="summary", markdown="markdown",
                    raw_content="raw_content", raw_source="raw_source") -> Column:
    """Summary -> primary content."""
    return F.coalesce(nz(summary), nz(markdown), nz(raw_content), _col(raw_source))


def primary_source(markdown="markdown", raw_content="raw_content",
                   raw_source="raw_source") -> Column:
    """Which field C2 picked (for reporting and the ``fallback`` flag)."""
    return (F.when(nz(markdown).isNotNull(), "markdown")
            .when(nz(raw_content).isNotNull(), "raw_content")
            .when(_col(raw_source).isNotNull(), "raw_source"))


def html_pick(raw_content="raw_content", raw_source="raw_source") -> Column:
    """raw_content, else raw_source; whitespace-only gives null. A
    whitespace raw_content does not fall back (it is non-empty)."""
    x = F.coalesce(nz(raw_content), _col(raw_source))
    return F.when(F.regexp_replace(x, r"^\s+|\s+$", "") != "", x)


def strip_ws(c) -> Column:
    """Python ``str.strip()`` (Spark ``trim`` only strips spaces)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def content_sha1(c="raw_content") -> Column:
    """Hex sha1 of the UTF-8 text, only for a non-empty text."""
    return F.when(nz(c).isNotNull(), F.sha1(_col(c)))


def parse_iso_ts(c) -> Column:
    """ISO-8601 text to a UTC wall-clock TIMESTAMP_NTZ; unparsable gives
    null. A zone suffix (``Z``, ``+hh:mm``, ``+hhmm``, ``+hh``) is subtracted
    explicitly, so the result does not depend on the session time zone (a
    cast through TIMESTAMP would; a direct cast to TIMESTAMP_NTZ would drop
    the offset)."""
    x = F.trim(_col(c))
    pat = r"^(.*[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?)(Z|[+-][0-9]{2}(?::?[0-9]{2})?)$"
    zone = F.regexp_extract(x, pat, 2)
    local = F.when(zone != "", F.regexp_extract(x, pat, 1)).otherwise(x)
    base = local.try_cast("timestamp_ntz")
    digits = F.regexp_replace(zone, ":", "")
    sign = F.when(zone.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    hh = F.when((zone == "") | (zone == "Z"), F.lit(0)).otherwise(F.substring(digits, 2, 2).cast("int"))
    mm = F.when(F.length(digits) == 5, F.substring(digits, 4, 2).cast("int")).otherwise(F.lit(0))
    return base - F.make_dt_interval(F.lit(0), sign * hh, sign * mm, F.lit(0))


def iso_format(c) -> Column:
    """Python ``datetime.isoformat()`` of a naive timestamp: fraction only
    when it is not zero."""
    ts = _col(c)
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(ts, "SSSSSS")
    return F.when(ts.isNull(), None).when(frac == "000000", base).otherwise(
        F.concat(base, F.lit("."), frac))


def json_row(df) -> Column:
    """The row as a JSON object: nulls kept, history as objects, timestamps in
    ISO format with all their digits."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName().startswith("timestamp"):
            c = iso_format(c)
        elif f.name == "history":
            c = F.transform(c, lambda h: F.struct(h["author"].alias("author"), iso_format(h["date"]).alias("date"),
                                                  h["comment"].alias("comment")))
        cols.append(c.alias(f.name))
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


HISTORY_TYPE = "array<struct<author:string,date:string,comment:string>>"


def parse_history(c) -> tuple[Column, Column]:
    """I8: (parsed, raw) of a history text: the list of edits, or, where the
    text is no JSON list of objects, the text itself; one of both is null."""
    x = _col(c)
    objects = F.from_json(x, "array<string>")
    is_list = F.ltrim(x).startswith("[") & objects.isNotNull() & F.forall(objects, lambda e: F.json_object_keys(e).isNotNull())
    ok = F.coalesce(is_list, F.lit(False))
    return F.when(ok, F.from_json(x, HISTORY_TYPE)), F.when(~ok, x)


# Frontmatter block = first line '---' (padded), lazily up to the next
# '---' line. Applied before a Python-like strip.
FRONTMATTER_RE = r"(?s)\A[ \t]*---[ \t]*\r?\n(?:.*?\n)??[ \t]*---[ \t]*\r?(?:\n|\z)"


def strip_frontmatter(c) -> Column:
    """Drop a leading YAML frontmatter block, then strip whitespace."""
    return strip_ws(F.regexp_replace(_col(c), FRONTMATTER_RE, ""))
