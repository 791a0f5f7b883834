"""Column expressions: labels, ratios, sentinels, keys, time text, formats, hashes.

All of these are built-in Spark expressions (whole-stage codegen, no Python
per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = -999999


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- labels -----------------------------------------------------------------

def label_map_strict(col, positive: str = "M", negative: str = "B") -> Column:
    """Exact text map: positive -> 1, negative -> 0, anything else -> NULL."""
    c = _c(col)
    return F.when(c == positive, F.lit(1)).when(c == negative, F.lit(0))


def label_indicator(col, positive: str = "m") -> Column:
    """1 when the lower-case text equals ``positive``, else 0 (NULL -> 0)."""
    return F.coalesce((F.lower(_c(col).cast("string")) == positive.lower()).cast("int"), F.lit(0))


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def threshold(prob, cut: float = 0.5, inclusive: bool = False) -> Column:
    """Class from probability: ``> cut`` (logistic scripts) or ``>= cut`` (network scripts)."""
    p = _c(prob)
    return (p >= cut).cast("int") if inclusive else (p > cut).cast("int")


# --- ratios and missing values ----------------------------------------------

def guarded_ratio(num, den) -> Column:
    """num / den when den > 0, else NULL."""
    return F.when(_c(den) > 0, _c(num) / _c(den))


def plain_ratio(num, den) -> Column:
    """num / den; division by zero gives NULL (where R would give Inf)."""
    return F.try_divide(_c(num), _c(den))


def null_if_sentinel(col, sentinel: float = SENTINEL) -> Column:
    return F.when(_c(col) != sentinel, _c(col))


def value_or_sentinel(col, sentinel=SENTINEL) -> Column:
    return F.coalesce(_c(col), F.lit(sentinel))


def nan_to_null(col) -> Column:
    return F.when(~F.isnan(_c(col)), _c(col))


# --- unit conversions -------------------------------------------------------

def ns_to_s(col) -> Column:
    return _c(col) / F.lit(1e9)


def fraction_to_pct(col) -> Column:
    return _c(col) * F.lit(100.0)


_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(col) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock (TIMESTAMP_NTZ) value.

    Computed as a calendar difference, so it does not depend on the session
    time zone (a cast to TIMESTAMP would, and would lose an hour at DST
    changes).  For TIMESTAMP input the difference of two values is still exact."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), _c(col))


def interval_seconds(start, end) -> Column:
    """Seconds between two timestamps, microsecond exact."""
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(1e6)


# --- keys -------------------------------------------------------------------

def build_key(*cols, sep: str = "_") -> Column:
    return F.concat_ws(sep, *[_c(c) for c in cols])


def key_prefix(col, sep: str = "_") -> Column:
    """Part before the first separator (``Block_Type.split('_')[0]``)."""
    return F.split_part(_c(col), F.lit(sep), F.lit(1))


# --- power-meter time text --------------------------------------------------

def power_time_text(ts) -> Column:
    """Render a timestamp the way the power meter writes it: nothing padded,
    milliseconds as an integer after the dot (``2024-1-5 0:14:47.10``)."""
    t = _c(ts)
    ms = F.floor(epoch_micros(t) / 1000) % 1000
    return F.concat(
        F.year(t).cast("string"), F.lit("-"), F.month(t).cast("string"), F.lit("-"),
        F.dayofmonth(t).cast("string"), F.lit(" "), F.hour(t).cast("string"), F.lit(":"),
        F.minute(t).cast("string"), F.lit(":"), F.second(t).cast("string"), F.lit("."),
        ms.cast("string"))


_TIME_RE = r"^\s*(\d+)-(\d+)-(\d+)[ T](\d+):(\d+):(\d+)(?:\.(\d+))?\s*$"


def parse_power_time(text, ms_mode: str = "integer") -> Column:
    """Parse meter time text to TIMESTAMP_NTZ.

    ``ms_mode='integer'``: the digits after the dot count milliseconds
    (``46.8`` is 46.008 s) - what the meter means.  ``'decimal'``: the digits are
    a decimal fraction (``46.8`` is 46.8 s) - what a generic parser reads.  More
    than three digits cannot count milliseconds and are read as a decimal fraction
    in both modes; digits beyond microseconds are cut.
    """
    t = _c(text)
    part = [F.regexp_extract(t, _TIME_RE, i) for i in range(1, 8)]
    frac_txt = part[6]
    decimal = F.concat(F.lit("0."), F.rpad(F.substring(frac_txt, 1, 6), 6, "0")).cast("decimal(9,6)")
    if ms_mode == "integer":
        frac = (F.when(F.length(frac_txt) > 3, decimal)
                .otherwise(F.when(frac_txt == "", F.lit(0)).otherwise(frac_txt.try_cast("int")).cast("decimal(9,6)") / F.lit(1000)))
    elif ms_mode == "decimal":
        frac = decimal
    else:
        raise ValueError("ms_mode must be 'integer' or 'decimal'")
    sec = (part[5].cast("int").cast("decimal(9,6)") + frac).cast("decimal(16,6)")
    ok = F.regexp_like(t, F.lit(_TIME_RE))
    return F.when(ok, F.make_timestamp_ntz(part[0].cast("int"), part[1].cast("int"), part[2].cast("int"),
                                           part[3].cast("int"), part[4].cast("int"), sec))


# --- chart labels -------------------------------------------------------------

def format_fixed(col, digits: int = 2, suffix: str = "") -> Column:
    c = _c(col)
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f{suffix}", c))


def format_sci_or_fixed(col, limit: float = 1000.0) -> Column:
    """``%.2e`` above ``limit``, else ``%.2f`` (MSE bar labels)."""
    c = _c(col)
    return F.when(c > limit, F.format_string("%.2e", c)).when(c.isNotNull(), F.format_string("%.2f", c))


# --- deterministic hashing ----------------------------------------------------

def hash32(*parts, seed: int = 42) -> Column:
    """First 8 hex digits of md5('seed:part1:part2...') as a BIGINT in [0, 2^32).

    The same number comes out of DuckDB with
    ``('0x' || substr(md5(...), 1, 8))::BIGINT``, so splits are checkable.
    """
    txt = F.concat_ws(":", F.lit(str(seed)), *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(txt), 1, 8), 16, 10).cast("bigint")


TWO32 = 4294967296.0
