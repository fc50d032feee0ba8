"""Column expressions shared by the operators. All of them stay in the JVM; ``mixed_array`` and ``mixed_runs`` are NumPy twins of ``mixed``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Coefficients of the published rational approximation of the normal quantile (P. J. Acklam).
QNORM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02,
           -3.066479806614716e01, 2.506628277459239e00)
QNORM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01,
           -1.328068155288572e01)
QNORM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00,
           4.374664141464968e00, 2.938163982698783e00)
QNORM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
QNORM_LOW = 0.02425

# Barcode format, label aliases, missing markers.
BARCODE = r"^TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}(-[0-9]{2}[A-Z]?(-[A-Z0-9]+)*)?$"
GROUP_ALIASES = {"OVCA": "OV", "AML": "LAML"}
NA_STRINGS = ("na", "nan", "null", "")
TRUE_STRINGS = ("TRUE", "T", "1", "YES")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and infinities become NULL; do this once at ingest."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def safe_number(c: str | Column) -> Column:
    """Parse text to double; anything not a finite number is NULL."""
    return finite(col(c).try_cast("double"))


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation aggregate that is NULL, not an error, for a constant column or n < 2."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def safe_slope(y: str | Column, x: str | Column) -> Column:
    """Least-squares slope of y on x, NULL for constant x."""
    return F.try_divide(F.covar_samp(y, x), F.var_samp(x))


def clip_floor(c: str | Column, floor: float = 0.0) -> Column:
    """Values below ``floor`` become ``floor``; NULL stays NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(floor)))


def fisher_z(r: Column) -> Column:
    return F.atanh(r)


def fisher_ci(r: str | Column, n: str | Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Confidence limits of a correlation; NULL for n < 4 or |r| = 1."""
    r, n = col(r), col(n)
    usable = (n >= 4) & (F.abs(r) < 1)
    half = F.lit(z) / F.sqrt(F.greatest(n - 3, F.lit(1)))
    return (
        F.when(usable, F.tanh(F.atanh(r) - half)),
        F.when(usable, F.tanh(F.atanh(r) + half)),
    )


def _poly(coefs: Sequence[float], x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def qnorm(p: str | Column) -> Column:
    """Standard normal quantile for 0 < p < 1 (relative error about 1e-9); NULL outside."""
    p = col(p)
    q = p - 0.5
    centre = _poly(QNORM_A, q * q) * q / (_poly(QNORM_B, q * q) * (q * q) + 1.0)
    lo = F.sqrt(F.log(p) * -2.0)
    hi = F.sqrt(F.log(1.0 - p) * -2.0)
    low = _poly(QNORM_C, lo) / (_poly(QNORM_D, lo) * lo + 1.0)
    high = -_poly(QNORM_C, hi) / (_poly(QNORM_D, hi) * hi + 1.0)
    return (
        F.when((p > 0) & (p < QNORM_LOW), low)
        .when((p >= QNORM_LOW) & (p <= 1 - QNORM_LOW), centre)
        .when((p > 1 - QNORM_LOW) & (p < 1), high)
    )


def pnorm_two_sided(z: Column) -> Column:
    """Two-sided normal p-value from |z|, by a Chebyshev fit of the complementary error function.

    The relative error is about 1e-7 in the whole tail, so small p-values keep their digits.
    """
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (x * 0.5 + 1.0)
    # Coefficients of the fit, highest power first.
    fit = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    return t * F.exp(_poly(fit, t) - x * x)


def draw_key(seed: str | int, *ids: str | Column) -> Column:
    """Text that orders rows at random but reproducibly: md5 of seed and ids."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(i).cast("string") for i in ids]))


def draw_number(seed: str | int, *ids: str | Column) -> Column:
    """A reproducible integer in [0, 2^32) from seed and ids."""
    return F.conv(F.substring(draw_key(seed, *ids), 1, 8), 16, 10).cast("long")


#: Resolution of ``mixed``: the largest prime below 2^31. Products with the multipliers stay below 2^63, so no engine overflows.
DRAW_RANGE = (1 << 31) - 1
# Multipliers of the published minimal-standard generators, and shifts.
MIX_STEPS = ((48271, 15), (69621, 14), (16807, 13))


def mixed(x: str | Column) -> Column:
    """A reproducible number in [0, 2^31) from a nonnegative integer below 2^32: cheap enough for one per draw."""
    x = col(x)
    for factor, shift in MIX_STEPS:
        x = (x + 1) * F.lit(factor).cast("long") % DRAW_RANGE
        x = x.bitwiseXOR(F.shiftright(x, shift))
    return x


def mixed_array(x: np.ndarray) -> np.ndarray:
    """``mixed`` of an array of 64-bit integers."""
    for factor, shift in MIX_STEPS:
        x = (x + 1) * factor
        x = (x & DRAW_RANGE) + (x >> 31)
        x -= DRAW_RANGE * (x >= DRAW_RANGE)
        x ^= x >> shift
    return x


#: Numbers that ``mixed_runs`` makes at once: its arrays stay in a core's own cache.
RUN = 1 << 15


@lru_cache(maxsize=4)
def _multiples(n: int) -> np.ndarray:
    """0..n-1 times the first multiplier of ``mixed``, modulo its range."""
    return (np.arange(n) * MIX_STEPS[0][0] % DRAW_RANGE).astype(np.uint32)


def mixed_runs(starts: np.ndarray, n: int) -> np.ndarray:
    """``mixed`` of start, start + 1, ... start + n - 1 for each start below 2^32: (starts, n), unsigned 32-bit.

    The first product of a run follows from that of its start by addition, and only the products need 64 bits.
    """
    out = np.empty((len(starts), n), np.uint32)
    (factor, shift), *rest = MIX_STEPS
    head = ((np.asarray(starts, np.int64) + 1) % DRAW_RANGE * factor % DRAW_RANGE).astype(np.uint32)[:, None]
    turns = _multiples(1 << max(n - 1, 1).bit_length())[:n]
    top, rows = np.uint32(DRAW_RANGE), max(1, RUN // max(n, 1))
    for r in range(0, len(head), rows):
        for c in range(0, n, RUN):
            x = head[r : r + rows] + turns[c : c + RUN]
            low = x - top  # wraps to a large number where x is in range already
            np.minimum(x, low, out=x)
            x ^= np.right_shift(x, np.uint32(shift), out=low)
            wide = np.empty(x.shape, np.uint64)
            for factor, step in rest:
                x += np.uint32(1)
                wide[...] = x
                wide *= np.uint64(factor)
                low[...] = wide & np.uint64(DRAW_RANGE)
                wide >>= np.uint64(31)
                x[...] = wide
                x += low
                np.minimum(x, np.subtract(x, top, out=low), out=x)
                x ^= np.right_shift(x, np.uint32(step), out=low)
            out[r : r + rows, c : c + RUN] = x
    return out


def parse_barcode(c: str | Column) -> Column:
    """Struct (patient, key, kind) of a barcode; NULL when it does not have the format."""
    c = col(c)
    return F.when(
        c.rlike(BARCODE),
        F.struct(
            F.substring(c, 1, 12).alias("patient"),
            F.substring(c, 1, 15).alias("key"),
            F.when(F.length(c) >= 15, F.substring(c, 14, 2)).otherwise("").alias("kind"),
        ),
    )


def unit_interval(c: str | Column) -> tuple[Column, Column]:
    """(value, valid): missing markers give NULL and valid; text outside [0, 1] gives NULL and not valid."""
    text = F.lower(F.trim(col(c)))
    missing = text.isNull() | text.isin(*NA_STRINGS)
    number = safe_number(text)
    inside = F.coalesce(number.between(0.0, 1.0), F.lit(False))
    return F.when(~missing & inside, number), missing | inside


def alias_values(c: str | Column, aliases: dict[str, str] = GROUP_ALIASES) -> Column:
    """Replace old label spellings, keep all others."""
    c = col(c)
    out = c
    for old, new in aliases.items():
        out = F.when(c == old, F.lit(new)).otherwise(out)
    return out


def truthy(c: str | Column) -> Column:
    return F.coalesce(F.upper(F.trim(col(c))).isin(*TRUE_STRINGS), F.lit(False))


def trim_record(df: DataFrame) -> DataFrame:
    """Strip blanks and carriage returns from every text column."""
    return df.select(
        *[
            F.regexp_replace(F.col(f.name), r"^\s+|\s+$", "").alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def target_transforms(floor: float = 0.0) -> dict[str, tuple]:
    """Named (forward, inverse) pairs for the label."""
    return {
        "identity": (lambda y: y, lambda p: p),
        "clip": (lambda y: y, lambda p: clip_floor(p, floor)),
        "log1p": (lambda y: F.log1p(y), lambda p: clip_floor(F.expm1(p), floor)),
    }


def to_m_value(beta: str | Column, eps: float = 1e-3) -> Column:
    b = col(beta)
    b = F.when(b.isNotNull(), F.least(F.greatest(b, F.lit(eps)), F.lit(1 - eps)))
    return F.log2(b / (1.0 - b))


def from_m_value(m: str | Column) -> Column:
    p = F.pow(F.lit(2.0), col(m))
    return p / (p + 1.0)


def mixture_signal(purity: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """(log ratio, allele fraction) of a tumour-normal mixture; NULL when nothing is left."""
    total = purity * (a + b) + (1.0 - purity) * 2.0
    positive = total > 0
    return F.when(positive, F.log2(total / 2.0)), F.when(positive, (purity * b + (1.0 - purity)) / total)


def offset_stratum(offset: str | Column) -> Column:
    size = F.abs(col(offset))
    return F.when(size < 2, "small").when(size < 5, "moderate").when(size >= 5, "large")


def interval_columns(pred: Column, q: Column, reportable: Column) -> list[Column]:
    """Lower and upper limits, blank unless the row may be reported and q is finite, with a status."""
    shown = reportable & q.isNotNull()
    return [
        F.when(shown, clip_floor(pred - q)).alias("lower"),
        F.when(shown, pred + q).alias("upper"),
        F.when(~reportable, "not_reportable").when(q.isNull(), "unbounded").otherwise("interval").alias("interval_status"),
    ]


def display_mask(pred: Column, reportable: Column, engineering_only: Column) -> Column:
    """The shown estimate: only for reportable rows of real runs."""
    return F.when(reportable & ~engineering_only, pred)


def title_key(c: str | Column, length: int = 60) -> Column:
    """Lower-cased alphanumerics of a title, first ``length`` characters."""
    return F.substring(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", ""), 1, length)


def split_stat_name(c: str | Column) -> tuple[Column, Column]:
    """``pearson_part1`` -> (``pearson``, ``part1``)."""
    parts = F.split(col(c), "_", 2)
    return parts.getItem(0), parts.getItem(1)


def first_match(rules: Sequence[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds, NULL if none does."""
    out = None
    for test, name in rules:
        test = F.coalesce(test, F.lit(False))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def right_closed_bin(x: Column, breaks: Column) -> Column:
    """1-based bin of x among sorted ``breaks`` (array): right-closed, the lowest break included, else NULL."""
    below = F.size(F.filter(breaks, lambda b: b < x))
    lowest, highest = F.element_at(breaks, 1), F.element_at(breaks, -1)
    return F.when((x >= lowest) & (x <= highest), F.greatest(below, F.lit(1)))
