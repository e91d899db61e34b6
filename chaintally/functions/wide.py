"""Exact arithmetic on whole amounts of up to 256 bits, as three decimal limbs.

A limb has 26 digits, so a decimal(38,0) sum of limbs holds 10 ** 12 rows. Sums are taken limb
by limb, in any order and with either sign, and carried only when they are read.

``of(df, column)`` tells how to calculate with a column: as a plain number, or as a struct of
limbs, which is what an amount stored as text becomes. Once settled, such structs compare, sort
and take minima like the numbers they stand for: the highest limb comes first and has the sign.
"""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from chaintally.functions.columns import as_col, scaled

DIGITS, LIMBS = 26, ("low", "mid", "high")
_KIND = "decimal(38,0)"


def limbs(value, kind=None):
    """name -> column of each limb of a non-negative whole amount, stored as a number or as text.

    A numeric ``kind`` (the column's type) is split by arithmetic, which costs far less than digits do.
    """
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        none = F.when(as_col(value).isNotNull(), F.lit(0)).cast(_KIND)
        return dict(zip(LIMBS, (as_col(value).cast(_KIND), none, none)))
    if isinstance(kind, T.DecimalType):
        whole, unit = as_col(value).cast(_KIND), F.lit(str(10 ** DIGITS)).cast("decimal(27,0)")
        over = whole >= unit
        return {"low": F.when(over, whole % unit).otherwise(whole).cast(_KIND),
                "mid": F.when(over, F.floor((whole - whole % unit) / unit)).when(whole.isNotNull(), F.lit(0)).cast(_KIND),
                "high": F.when(whole.isNotNull(), F.lit(0)).cast(_KIND)}
    text = F.lpad(as_col(value).cast("string"), DIGITS * len(LIMBS), "0")
    return {name: F.substring(text, DIGITS * (len(LIMBS) - 1 - k) + 1, DIGITS).cast(_KIND)
            for k, name in enumerate(LIMBS)}


def carried(low, mid, high):
    """The limbs of a sum with low and mid between zero and the unit; high has the sign."""
    unit = F.lit(str(10 ** DIGITS)).cast(_KIND)

    def split(x):
        rest = F.pmod(x, unit)
        return rest, ((x - rest) / unit).cast(_KIND)

    low, carry = split(as_col(low))
    mid, carry = split(as_col(mid) + carry)
    return low, mid, as_col(high) + carry


def is_positive(low, mid, high):
    low, mid, high = carried(low, mid, high)
    return (high > 0) | ((high == 0) & ((mid > 0) | (low > 0)))


def as_double(low, mid, high):
    """The nearest double, up to its last digit."""
    def magnitude(*parts):
        a, b, c = carried(*parts)
        return (c.cast("double") * F.lit(10.0 ** (2 * DIGITS)) + b.cast("double") * F.lit(10.0 ** DIGITS)
                + a.cast("double"))

    parts = [as_col(x) for x in (low, mid, high)]
    negative = carried(*parts)[2] < 0
    return F.when(negative, -magnitude(*[-x for x in parts])).otherwise(magnitude(*parts))


def as_units(low, mid, high, decimals):
    """The amount in display units; the only step that rounds."""
    exponent = F.lit(decimals) if isinstance(decimals, int) else as_col(decimals)
    return as_double(low, mid, high) / F.pow(F.lit(10.0), exponent)


class Plain:
    """Calculation with a column of numbers."""

    @property
    def zero(self):
        return F.lit(0)

    def total(self, c, window=None):
        """Sum of a column, over a window if one is given; to be settled."""
        return F.sum(c) if window is None else F.sum(c).over(window)

    def settled(self, df, *columns):
        """``df`` with totals and differences in ``columns`` ready to be compared."""
        return df

    def or_zero(self, c):
        return F.coalesce(as_col(c), self.zero)

    def negative(self, c):
        return -as_col(c)

    def minus(self, a, b):
        return as_col(a) - as_col(b)

    def plus(self, a, b):
        return as_col(a) + as_col(b)

    def above_zero(self, c):
        return as_col(c) > self.zero

    def below_zero(self, c):
        return as_col(c) < self.zero

    def double(self, c):
        return as_col(c).cast("double")

    def units(self, c, decimals):
        return scaled(c, decimals)


class Limbs(Plain):
    """Calculation with structs of limbs, highest first; totals and differences are settled before they are compared."""

    @property
    def zero(self):
        return F.struct(*[F.lit(0).cast(_KIND).alias(n) for n in reversed(LIMBS)])

    def _each(self, c, act):
        return F.struct(*[act(as_col(c)[n]).cast(_KIND).alias(n) for n in reversed(LIMBS)])

    def total(self, c, window=None):
        return self._each(c, lambda x: Plain.total(self, x, window))

    def settled(self, df, *columns):
        def settle(c):
            limb = F.col(c)
            parts = carried(*[limb[n] for n in LIMBS])
            whole = F.struct(*[x.cast(_KIND).alias(n) for n, x in reversed(list(zip(LIMBS, parts)))])
            return F.when(limb[LIMBS[0]].isNotNull(), whole)

        return df.withColumns({c: settle(c) for c in columns})

    def negative(self, c):
        return self._each(c, lambda x: -x)

    def minus(self, a, b):
        return F.struct(*[(as_col(a)[n] - as_col(b)[n]).cast(_KIND).alias(n) for n in reversed(LIMBS)])

    def plus(self, a, b):
        return F.struct(*[(as_col(a)[n] + as_col(b)[n]).cast(_KIND).alias(n) for n in reversed(LIMBS)])

    def double(self, c):
        return as_double(*[as_col(c)[n] for n in LIMBS])

    def units(self, c, decimals):
        return as_units(*[as_col(c)[n] for n in LIMBS], decimals)


def of(df, column):
    """How to calculate with a column of ``df``, by its type alone."""
    return Limbs() if isinstance(df.schema[column].dataType, T.StructType) else Plain()


def gathered(df, column):
    """``df`` with its three columns of summed limbs as one settled ``column``."""
    whole = df.withColumn(column, F.struct(*reversed(LIMBS)))
    return Limbs().settled(whole, column).drop(*LIMBS)


def amounts(df, column="raw"):
    """``df`` with an amount to calculate with: numbers as decimals, text, which may be wider, as limbs."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df.withColumn(column, F.col(column).cast(_KIND))
    parts = limbs(column)
    whole = F.struct(*[parts[n].alias(n) for n in reversed(LIMBS)])
    return df.withColumn(column, F.when(F.col(column).isNotNull(), whole))
