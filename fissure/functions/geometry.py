"""Column expressions over paired intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mapping types with their weights in tenths.
UNIQUE, ANCHORED, MULTIPLE = 1, 2, 3
WEIGHT_TENTHS = {UNIQUE: 10, ANCHORED: 5, MULTIPLE: 1}


def col(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}.{name}" if prefix else name)


def inner_size(prefix: str = "") -> Column:
    """Bases between the two blocks, as the pipeline counts them."""
    return col(prefix, "start2") - col(prefix, "end1") + 1


def size_off_expected() -> Column:
    return F.abs(inner_size() - F.col("exp_size").cast("int"))


def length_tolerance() -> Column:
    """Most that two mappings' sizes may differ, from their library's truncated statistics."""
    return 2 * F.col("num_devs").cast("int") * F.col("variance").cast("int")


def span_tolerance() -> Column:
    return 2 * (F.col("exp_size").cast("int") + F.col("num_devs").cast("int") * F.col("variance").cast("int"))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Bases that two intervals share; negative for a gap."""
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def mapping_type(n1: Column, n2: Column) -> Column:
    return F.when((n1 == 1) & (n2 == 1), UNIQUE).when((n1 == 1) | (n2 == 1), ANCHORED).otherwise(MULTIPLE)


def weight_tenths(kind: Column) -> Column:
    """Ten times a mapping type's weight: whole numbers sum alike in any order."""
    out = F.lit(None).cast("long")
    for k, w in WEIGHT_TENTHS.items():
        out = F.when(kind == k, F.lit(w).cast("long")).otherwise(out)
    return out


def variant_class(reach: int = 1_000_000) -> Column:
    """Kind of breakpoint by strands, local where both ends lie within reach on one chromosome; null for other strands."""
    kind = F.when(F.col("strand1") == F.col("strand2"), "inversion").when((F.col("strand1") == "+") & (F.col("strand2") == "-"), "deletion").when((F.col("strand1") == "-") & (F.col("strand2") == "+"), "duplication")
    known = F.col("strand1").isin("+", "-") & F.col("strand2").isin("+", "-")
    near = (F.col("chrom1") == F.col("chrom2")) & (F.col("max_end2") - F.col("min_start1") <= reach)
    return F.when(known, F.concat(F.when(near, "local_").otherwise("distant_"), kind))


def mates_agree(a: str, b: str) -> Column:
    """Whether two mappings of one route can support the same breakpoint: sizes, spans and a common inner span (within_: both blocks on one chromosome)."""
    lengths = F.abs(col(a, "size_off") - col(b, "size_off")) <= F.greatest(col(a, "length_tol"), col(b, "length_tol"))
    spread = F.abs(col(b, "start1") - col(a, "start1")) + F.abs(col(b, "end2") - col(a, "end2"))
    spans = spread <= F.greatest(col(a, "span_tol"), col(b, "span_tol"))
    both_within = col(a, "within_") & col(b, "within_")
    common = ~both_within | (F.least(col(a, "start2"), col(b, "start2")) - F.greatest(col(a, "end1"), col(b, "end1")) > 0)
    return lengths & spans & common
