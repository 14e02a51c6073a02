"""Ordered enumerations as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from the gravest.
SEVERITIES = ("Critical", "High", "Medium", "Low", "Info")


def severity_rank(severity: Column | str) -> Column:
    """0 for the gravest; 5 for what is no severity."""
    s = F.col(severity) if isinstance(severity, str) else severity
    return F.coalesce(*(F.when(s == x, F.lit(i)) for i, x in enumerate(SEVERITIES)), F.lit(5))


def parse_severity(text: Column | str) -> Column:
    """Severity of a text in any case, with white space around it; Medium for others."""
    s = F.initcap(F.trim(F.col(text) if isinstance(text, str) else text))
    return F.when(s.isin(*SEVERITIES), s).otherwise(F.lit("Medium"))
