"""Column helpers for lines of source code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a decision, as insignificant, as a literal.
DECISIONS = r"\b(?:if|else\s+if|elif|for|while|case|catch|except|switch)\b|\?\?|\?\.|&&|\|\||(?<![=!<>])\?(?!\.)"
INSIGNIFICANT = r"^(?:\/\/|#|\*|\/\*)|^(?:import|from|export|package|using)\b|^[{}()\[\];,]+$"


def trimmed(line: Column) -> Column:
    """Without leading and trailing white space of any script."""
    return F.when(line.rlike(r"[^\x20-\x7E]"), F.regexp_replace(line, r"(?U)^\s+|\s+$", "")).otherwise(F.trim(line))  # in plain text only blanks are white space


def normalize_line(line: Column) -> Column:
    """A significant line with one kind of space, of string and of number; null for others."""
    return normalized(trimmed(line))


def normalized(t: Column) -> Column:
    """``normalize_line`` of a trimmed line. A step is taken only by lines that it changes."""
    out = F.when(t.rlike(r"[\t\n\x0B\f\r]|  "), F.regexp_replace(t, r"\s+", " ")).otherwise(t)
    out = F.when(F.contains(t, F.lit("'")) | F.contains(t, F.lit('"')), F.regexp_replace(out, r"""['"][^'"]*['"]""", "S")).otherwise(out)
    out = F.when(t.rlike("[0-9]"), F.regexp_replace(out, r"\b[0-9]+\b", "N")).otherwise(out)
    return F.when((F.length(t) >= 12) & ~t.rlike(INSIGNIFICANT), out)


def strip_literals(line: Column) -> Column:
    """Without escapes, strings and comments."""
    for pattern, new in ((r"\\.", ""), (r"'[^']*'", "''"), (r'"[^"]*"', '""'), (r"`[^`]*`", "``"), (r"//.*$", ""), (r"#.*$", "")):
        line = F.regexp_replace(line, pattern, new)
    return line


def decisions(text: Column) -> Column:
    return F.regexp_count(text, F.lit(DECISIONS))


def significant(line: Column) -> Column:
    """Neither blank nor a comment."""
    return says(trimmed(line))


def says(t: Column) -> Column:
    """``significant`` of a trimmed line."""
    return (t != "") & ~(t.startswith("//") | t.startswith("#") | t.startswith("*"))


def significant_lines(text: Column) -> Column:
    """How many lines of a text are ``significant``: one pass over the text, which is not taken apart."""
    return F.regexp_count(text, F.lit(r"(?U)(?:\A|\n)[\s&&[^\n]]*+(?!//|[#*])\S"))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits for each character."""
    chars = F.split(value, "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double"))
    n = F.size(chars).cast("double")
    return F.when(F.length(value) > 0, F.aggregate(counts, F.lit(0.0), lambda s, k: s - k / n * F.log2(k / n))).otherwise(0.0)
