"""Column expressions shared by the operators. All of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from chaintally.constants import SINK_ADDRESSES


def as_col(value):
    return value if isinstance(value, Column) else F.col(value)


def hex_address(binary):
    """Binary address or hash as the lowercase ``0x`` text used everywhere else."""
    return F.lower(F.concat(F.lit("0x"), F.hex(binary)))


def scaled(raw, decimals):
    """An integer amount in display units.

    Sums are taken over the integers first, so results do not depend on how Spark happens
    to order the rows; the one division happens last.
    """
    exponent = F.lit(decimals) if isinstance(decimals, int) else as_col(decimals)
    return as_col(raw).cast("double") / F.pow(F.lit(10.0), exponent)


def ratio(numerator, denominator):
    """NULL instead of an error when the denominator is zero."""
    return F.try_divide(as_col(numerator).cast("double"), as_col(denominator).cast("double"))


def not_sink(column, addresses=SINK_ADDRESSES):
    return ~as_col(column).isin(*addresses)


def explorer_link(column, prefix, text=None):
    """HTML anchor to a page about the value of ``column``."""
    target = as_col(column).cast("string")
    label = target if text is None else F.lit(text)
    return F.concat(
        F.lit(f'<a href="{prefix}'), target, F.lit('" target="_blank">'), label, F.lit("</a>"))


def zero_if_null(column):
    return F.coalesce(as_col(column), F.lit(0))
