"""Sums and products that do not depend on how rows are partitioned, checksums, and field comparison."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Six digits of 46 bits, from 2 ** 92 down to 2 ** -138.
DIGIT_BITS, DIGITS = 46, 6
SCALES = [2.0 ** (DIGIT_BITS * (2 - i)) for i in range(DIGITS)]
LIMIT = 2.0 ** (DIGIT_BITS * 3)


def _guarded(value: Column) -> Column:
    bad = F.isnan(value) | (F.abs(value) >= LIMIT)
    return F.when(bad, F.raise_error(F.lit("an exact sum takes finite values below 2 ** 138")).cast("double")).otherwise(value)


def sum_columns(df: DataFrame, value: str, prefix: str = "__d") -> DataFrame:
    """Add one column per digit of `value`; step by step, so that no expression repeats another."""
    df = df.withColumn(f"{prefix}r", _guarded(F.col(value).cast("double")))
    for i, scale in enumerate(SCALES):
        rest = F.col(f"{prefix}r")
        df = df.withColumn(f"{prefix}{i}", F.when(rest < 0, F.ceil(rest * (1 / scale))).otherwise(F.floor(rest * (1 / scale))).cast("long"))
        df = df.withColumn(f"{prefix}r", rest - F.col(f"{prefix}{i}").cast("double") * scale)
    return df.drop(f"{prefix}r")


def exact_sum(df: DataFrame, value: str, keys: list[str], into: str = "sum") -> DataFrame:
    """Sum of `value` per keys, bit for bit the same for any partitioning; missing values count as 0."""
    wide = sum_columns(df.withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(0.0))), value)
    told = _carried(wide.groupBy(*keys).agg(*_digit_sums()) if keys else wide.agg(*_digit_sums()))
    return told.select(*keys, _joined(range(DIGITS)).alias(into))


def _digit_sums() -> list[Column]:
    return [F.coalesce(F.sum(F.col(f"__d{i}").cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).alias(f"__s{i}") for i in range(DIGITS)]


def _carried(told: DataFrame) -> DataFrame:
    """Summed digits in canonical form: all but the first lie in [0, 2 ** DIGIT_BITS), so that equal sums have equal digits."""
    base = F.lit(2**DIGIT_BITS).cast("decimal(20,0)")
    for i in range(DIGITS - 1, 0, -1):
        low = F.col(f"__s{i}")
        told = told.withColumn("__c", F.floor(low / base).cast("decimal(20,0)"))
        told = told.withColumns({f"__s{i}": low - F.col("__c") * base, f"__s{i - 1}": F.col(f"__s{i - 1}") + F.col("__c")})
    return told


def _joined(digits: Iterable[int]) -> Column:
    """The number that some of the digits make, the smallest added first."""
    total = F.lit(0.0)
    for i in sorted(digits, reverse=True):
        total = total + F.col(f"__s{i}").cast("double") * SCALES[i]
    return total


#: The digit that counts ones; those after it are the fraction.
ONES = SCALES.index(1.0)


def exact_product(df: DataFrame, value: str, keys: list[str], into: str = "product", integer: bool = False) -> DataFrame:
    """Product per keys, bit for bit the same for any partitioning.

    A factor is 2 ** (e + l), with e a whole number near its logarithm and l what
    is left. The sum of all e and the digits of the sum of all l are exact, and so
    is the split of their total into a whole number and a fraction. Signs join by
    exclusive or of the sign bits, that of a zero included. Missing values are
    skipped; a product with a NaN, or of a zero and an infinity, is missing.
    """
    v, size = F.col(value).cast("double"), F.abs(F.col(value).cast("double"))
    plain = (size > 0) & (size < float("inf"))
    near = F.when(plain, F.rint(F.log2(size))).otherwise(F.lit(0.0))
    # in two steps: 2 ** 1074, by which the smallest numbers are scaled, isn't a double
    half = F.rint(F.col("__e") / 2)
    rest = F.when(plain, F.log2(size * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - F.col("__e")))).otherwise(F.lit(0.0))
    df = df.where(F.col(value).isNotNull()).withColumn("__e", near).withColumns({
        "__l": rest, "__sign": F.shiftrightunsigned(raw_bits(v), 63), "__none": size == 0, "__all": size == float("inf"), "__odd": F.isnan(v),
    })
    wide = sum_columns(df, "__l")
    flags = [F.coalesce(F.bit_xor("__sign"), F.lit(0)).alias("__sign"), *(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("__none", "__all", "__odd"))]
    aggs = [*flags, *_digit_sums(), F.coalesce(F.sum(F.col("__e").cast("long")), F.lit(0)).alias("__e")]
    told = _carried(wide.groupBy(*keys).agg(*aggs) if keys else wide.agg(*aggs))
    told = told.withColumn("__k", F.least(F.greatest(F.col("__e") + _joined(range(ONES + 1)), F.lit(-4000.0)), F.lit(4000.0)))
    step = lambda n: F.pow(F.lit(2.0), n)
    part = F.rint(F.col("__k") / 4)  # of a power of two that may not be a double by itself
    magnitude = step(_joined(range(ONES + 1, DIGITS))) * step(part) * step(part) * step(part) * step(F.col("__k") - 3 * part)
    unsigned = F.when(F.col("__none"), F.lit(0.0)).when(F.col("__all"), F.lit(float("inf"))).otherwise(magnitude)
    lost = F.col("__odd") | (F.col("__none") & F.col("__all"))
    out = F.when(~lost, F.when(F.col("__sign") == 1, -unsigned).otherwise(unsigned))
    return told.select(*keys, (F.rint(out).cast("long") if integer else out).alias(into))


def raw_bits(value: Column) -> Column:
    """The 64 bits of a double as a long; a missing value has those of NaN."""
    return F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), F.coalesce(value.cast("double"), F.lit(float("nan")))).cast("long")


def checksum(df: DataFrame, value: str, keys: list[str] | None = None, mask_value: float | None = None, into: str = "checksum") -> DataFrame:
    """Order-independent sum of raw bit patterns, wrapped to 64 bits; cells equal to mask_value are left out."""
    if mask_value is not None:
        df = df.where(F.col(value) != mask_value)
    bits = raw_bits(F.col(value)) if dict(df.dtypes)[value] in ("double", "float") else F.col(value).cast("long")
    df = df.withColumn("__bits", bits.cast("decimal(38,0)"))
    total = F.coalesce(F.sum("__bits"), F.lit(0).cast("decimal(38,0)"))
    m = F.lit(str(2**64)).cast("decimal(38,0)")
    low = F.pmod(total, m)
    wrapped = F.when(low >= F.lit(str(2**63)).cast("decimal(38,0)"), low - m).otherwise(low).cast("long").alias(into)
    return df.groupBy(*keys).agg(wrapped) if keys else df.agg(wrapped)
