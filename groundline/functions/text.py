"""Scalar expressions shared by all operators (JVM side)."""
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


def strip(c) -> Column:
    """Without Unicode white space at both ends; null stays null. A trim, not a pattern: only the ends are looked at."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE))


def ident(c) -> Column:
    """A stripped id; blank ids are null."""
    s = strip(c)
    return F.when(s != "", s)


def code(c) -> Column:
    """Kinds, statuses and predicates: stripped, upper case."""
    return F.upper(strip(c))


def accepted() -> Column:
    return code("review_status").isin("AUTO_VERIFIED", "HUMAN_APPROVED") & (code("assertion_kind") != "INFERRED")
