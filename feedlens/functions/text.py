"""Text helpers as JVM-side column expressions (no Python per row).

Python's ``str.strip()`` / ``str.split()`` treat a wider set of characters as whitespace
than SQL ``trim`` (which leaves newlines). The set is spelled out once below so that Spark
(Java regex) and DuckDB (RE2) apply the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, in code point order.
WHITESPACE_CODEPOINTS = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
WHITESPACE = "".join(chr(c) for c in WHITESPACE_CODEPOINTS)


def _ranges(cps):
    out, start, prev = [], cps[0], cps[0]
    for c in cps[1:]:
        if c != prev + 1:
            out.append((start, prev))
            start = c
        prev = c
    return out + [(start, prev)]


# Same set as a regex class valid in both Java regex and RE2; consecutive code points are written
# as ranges, which Java matches several times faster than a list of single characters.
WS_CLASS = "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}"
                         for a, b in _ranges(WHITESPACE_CODEPOINTS)) + "]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace incl. newlines and NBSP."""
    return F.trim(_c(x), F.lit(WHITESPACE))


def py_str(x) -> Column:
    """``str(value)`` as pandas would render a missing value: NULL becomes ``'nan'``."""
    return F.coalesce(_c(x).cast("string"), F.lit("nan"))


def clean_whitespace(x) -> Column:
    """Strip, then collapse every whitespace run into one space."""
    return F.regexp_replace(strip(x), WS_CLASS + "+", " ")


def clean_field(x) -> Column:
    """``str(x).strip().replace('\\n', ' ')`` (fine-tuning prompt fields)."""
    return F.replace(strip(py_str(x)), F.lit("\n"), F.lit(" "))


def extract_feedback(x) -> Column:
    """Text after ``Feedback: `` on the last line, stripped; NULL when there is none."""
    pattern = "Feedback: ([^\\n]*)\\n?\\z"
    return F.when(_c(x).rlike(pattern), strip(F.regexp_extract(_c(x), pattern, 1)))


def first_line(x) -> Column:
    """First line of a generation, stripped."""
    return strip(F.substring_index(_c(x), "\n", 1))


def until_blank_line(x) -> Column:
    """Generation cut at the first blank line (stop sequence ``\\n\\n``)."""
    return F.substring_index(_c(x), "\n\n", 1)


def word_count(x) -> Column:
    """Number of whitespace-separated tokens (Python ``len(s.split())``)."""
    s = strip(x)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, WS_CLASS + "+")))


def bool_flag(x) -> Column:
    """Command-line flag parser: anything but the text ``0`` is true."""
    return _c(x) != F.lit("0")


# ---- DuckDB counterparts ----

SQL_WHITESPACE = "(" + " || ".join(f"chr({c})" for c in WHITESPACE_CODEPOINTS) + ")"


def sql_strip(e: str) -> str:
    return f"trim({e}, {SQL_WHITESPACE})"


def sql_py_str(e: str) -> str:
    return f"coalesce(CAST({e} AS VARCHAR), 'nan')"


def sql_clean_field(e: str) -> str:
    return f"replace({sql_strip(sql_py_str(e))}, chr(10), ' ')"
