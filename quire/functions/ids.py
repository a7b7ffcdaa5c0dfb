"""Identifier functions as Column expressions (JVM-side, codegen-friendly).

normalize_id      B1/B2  free text -> canonical label ``SCP-002``
label_number      B4/I2  first ``SCP-<digits>`` number of a label
parse_scp_number  I2     ``SCP-002`` / ``2`` -> 2, else null (error)
shard_folder      I3     ``scp-100-j`` -> ``1/0/0/-/j``
file_link         I4     file name stem for staged / exported files
identifier_variants C4   lookup keys of an item
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference for the same labels).
LABEL_PREFIX = "SCP-"
DEFAULT_DOMAIN = "scp-wiki.wikidot.com"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad3_digits(digits: Column) -> Column:
    """``int(digits)`` formatted ``%03d`` for an ASCII digit string of any length
    (no cast, so no overflow): strip leading zeros, left-pad to 3."""
    stripped = F.regexp_replace(digits, r"^0+(?=[0-9])", "")
    return F.when(F.length(stripped) < 3, F.lpad(stripped, 3, "0")).otherwise(stripped)


def normalize_id(c, pad_prefixed: bool = True) -> Column:
    """Canonical label of a user-given identifier.

    pad_prefixed=True  is the loader rule (B1): ``scp-2`` -> ``SCP-002``.
    pad_prefixed=False is the import/export script rule (B2): ``scp-2`` -> ``SCP-2``.
    """
    x = _col(c)
    is_digits = x.rlike(r"^[0-9]+$")
    prefixed = F.lower(x).startswith("scp-")
    rest = F.substring(x, 5, 1 << 30)
    up = F.upper(x)
    prefixed_value = up
    if pad_prefixed:
        prefixed_value = F.when(rest.rlike(r"^[0-9]+$"),
                                F.concat(F.lit(LABEL_PREFIX), pad3_digits(rest))).otherwise(up)
    return (F.when(x.isNull(), None)
            .when(is_digits, F.concat(F.lit(LABEL_PREFIX), pad3_digits(x)))
            .when(prefixed, prefixed_value)
            .when(up.startswith(LABEL_PREFIX), up)
            .otherwise(F.concat(F.lit(LABEL_PREFIX), up)))


def label_number(c) -> Column:
    """Number used by range selection: first ``SCP-(\\d+)`` in the upper-cased
    label (so ``SCP-100-J`` counts as 100); null when there is none."""
    digits = F.regexp_extract(F.upper(_col(c)), r"SCP-(\d+)", 1)
    return F.when(digits != "", digits.try_cast("decimal(38,0)")).cast("decimal(38,0)")


def parse_scp_number(c) -> Column:
    """Strict number parse of the item model: optional ``SCP-`` (any case), then
    an integer. ``SCP-100-J`` gives null (a validation error)."""
    x = F.trim(_col(c))
    body = F.regexp_replace(x, r"(?i)^SCP-", "")
    return F.when(body.rlike(r"^[+-]?[0-9]+$"), body.try_cast("bigint"))


def shard_folder(scp=None, link=None, title=None) -> Column:
    """One folder per character of the identifier after the ``scp-`` prefix."""
    parts = [F.nullif(_col(c), F.lit("")) for c in (scp, link, title) if c is not None]
    ident = F.coalesce(*parts, F.lit(""))
    body = F.lower(F.regexp_replace(ident, r"(?i)^scp-", ""))
    return F.when(body == "", F.lit("unknown")).otherwise(F.array_join(F.split(body, ""), "/"))


def file_link(link, scp=None) -> Column:
    """File name stem: the link (else lower(scp)), forced to start with ``scp-``."""
    base = _col(link)
    if scp is not None:
        base = F.coalesce(base, F.lower(_col(scp)))
    return (F.when(base.startswith("scp-"), base)
            .when(F.upper(base).startswith(LABEL_PREFIX), F.lower(base))
            .otherwise(F.concat(F.lit("scp-"), F.lower(base))))


def identifier_variants(scp="scp", scp_number="scp_number", link="link") -> Column:
    """[scp, str(number), link] plus ``SCP-%03d`` when number < 1000 and that
    string is not already one of the three (first three are not de-duplicated)."""
    s, n, l = _col(scp), _col(scp_number), _col(link)
    base = F.array(s, n.cast("string"), l)
    padded = F.concat(F.lit(LABEL_PREFIX), F.format_string("%03d", n))
    return F.when((n < 1000) & ~F.array_contains(base, padded),
                  F.concat(base, F.array(padded))).otherwise(base)
