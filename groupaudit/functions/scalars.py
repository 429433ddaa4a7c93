"""Column expressions for paths, codes, dates, labels and missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from groupaudit.functions.hashing import col

MISSING = "MISSING"


# --- paths and names ---------------------------------------------------------


def file_name(path: str | Column) -> Column:
    return F.regexp_extract(col(path), r"([^/\\]*)$", 1)


def stem(path: str | Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: str | Column) -> Column:
    """Lower-case last extension, empty when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r".\.([^.]*)$", 1))


def absolute(path: str | Column, root: str) -> Column:
    p = col(path)
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))


# File-name and archive-member patterns.
SESSION_TASK_PATTERN = r"^(\d+)-(.+)$"
MEMBER_GROUP_PATTERN = r"(?:^|/)(\d+)[-_]"

NO_PREFIX = "no session number before the first hyphen of the name"


def session_and_task(name: str | Column) -> tuple[Column, Column, Column]:
    """(session, task, reject reason) of a file stem."""
    s = F.regexp_extract(col(name), SESSION_TASK_PATTERN, 1)
    t = F.regexp_extract(col(name), SESSION_TASK_PATTERN, 2)
    matched = col(name).rlike(SESSION_TASK_PATTERN)
    return (
        F.when(matched, s.try_cast("bigint")),
        F.when(matched, t),
        F.when(~F.coalesce(matched, F.lit(False)), F.lit(NO_PREFIX)),
    )


def member_group(path: str | Column) -> Column:
    g = F.regexp_extract(col(path), MEMBER_GROUP_PATTERN, 1)
    return F.when(g != "", g)


# --- codes and labels --------------------------------------------------------

# Accepted sex codes.
SEX_CODES = {"w": "F", "f": "F", "female": "F", "m": "M", "male": "M"}


def recode(c: str | Column, mapping: Mapping[str, str], default: str = "") -> Column:
    """Literal code map over trimmed values; anything else becomes ``default``."""
    value = F.trim(col(c))
    out = None
    for k, v in mapping.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def namespaced(prefix: str, key: str | Column) -> Column:
    return F.concat(F.lit(prefix + "_"), col(key).cast("string"))


def blank_when(c: str | Column, condition: Column) -> Column:
    return F.when(condition, F.lit("")).otherwise(F.coalesce(col(c), F.lit("")))


def label_is(c: str | Column, positive: str) -> Column:
    return (col(c) == positive).cast("int")


def label_is_not(c: str | Column, negative: str) -> Column:
    return (col(c) != negative).cast("int")


def label_in_sets(c: str | Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """positive / negative / other by membership of two sets."""
    return (
        F.when(col(c).isin(list(positive)), "positive")
        .when(col(c).isin(list(negative)), "negative")
        .otherwise("other")
    )


def healthy_when_blank(*fields: str) -> Column:
    """Healthy iff every field is NULL."""
    cond = F.lit(True)
    for f in fields:
        cond = cond & F.col(f).isNull()
    return cond


# --- dates -------------------------------------------------------------------

DAYS_PER_YEAR = 365.25


def as_date(c: str | Column) -> Column:
    """Date of a date, timestamp or text column; unreadable text becomes NULL."""
    return F.to_date(F.try_to_timestamp(col(c).cast("string")))


def age_years(born: str | Column, event: str | Column) -> Column:
    """Fractional age in years."""
    return F.datediff(col(event), col(born)) / F.lit(DAYS_PER_YEAR)


def age_floor(born: str | Column, event: str | Column) -> Column:
    """Whole years, floored."""
    return F.floor(age_years(born, event)).cast("int")


# --- missing values ----------------------------------------------------------


def or_missing(c: str | Column) -> Column:
    """Trimmed text, with NULL and blank as one explicit level."""
    return F.coalesce(F.nullif(F.trim(col(c).cast("string")), F.lit("")), F.lit(MISSING))


def number_or_null(c: str | Column) -> Column:
    """Double or NULL; NaN counts as missing."""
    v = F.trim(col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(v), v)


def non_blank(c: str | Column) -> Column:
    return F.coalesce(F.trim(col(c).cast("string")) != "", F.lit(False))


def finite_or_zero(c: str | Column) -> Column:
    """Feature policy: NULL, NaN and infinities become 0."""
    v = col(c)
    return F.when(is_finite(v), v).otherwise(F.lit(0.0))


def is_finite(v: Column) -> Column:
    return F.coalesce(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), F.lit(False))


# --- quality, governance text ------------------------------------------------


def passes_quality(confidence: str, label: str, threshold: float, include_unlabeled: bool = False) -> Column:
    """Confidence at least the threshold (off when negative) and a label unless waived."""
    keep = F.lit(True) if threshold < 0 else F.col(confidence) >= F.lit(threshold)
    return keep if include_unlabeled else keep & F.col(label).isNotNull()


# Literal markup that must not appear in published text.
LEAK_PATTERNS = {
    "bold": r"\*\*[^*\n]+\*\*",
    "table_rule": r"\|\s*-{3,}",
    "heading": r"(?m)^#{2,}\s",
}
ARXIV_PATTERN = r"arXiv:(\d{4}\.\d{4,5})"


def leaks(text: str | Column) -> Column:
    """Array of (pattern, snippet): every pattern that occurs, with its first whole occurrence."""
    found = [
        F.when(
            col(text).rlike(pattern),
            F.struct(F.lit(k).alias("pattern"), F.regexp_extract(col(text), f"({pattern})", 1).alias("snippet")),
        )
        for k, pattern in LEAK_PATTERNS.items()
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def evidence_tier(repeats: Column, control: Column | None = None) -> Column:
    """EVALUATION from eight repeats on, SCREENING below, CONTROL for negative controls."""
    tier = F.when(repeats >= 8, "EVALUATION").otherwise("SCREENING")
    return tier if control is None else F.when(control, "CONTROL").otherwise(tier)


def status_class(status: str | Column) -> Column:
    """Free-text status reduced to a closed set, first match wins."""
    s = F.upper(F.coalesce(col(status), F.lit("")))
    return (
        F.when(s.startswith("UNTESTED") | (s == ""), "UNTESTED")
        .when(s.contains("PARTIAL"), "PARTIAL")
        .when(s.contains("FALSIFIED"), "FALSIFIED")
        .when(s.contains("SUPPORTED"), "CLAIM SUPPORTED")
        .otherwise(col(status))
    )


def found_or_raise(value: Column, what: str) -> Column:
    """The value, or a runtime error when the lookup found nothing."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"no match for {what}")))


def identifiers(text: str | Column, pattern: str = ARXIV_PATTERN) -> Column:
    """All first-group matches of a pattern in a text."""
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(1))
