"""Scalar text functions as column expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decision words and what they mean.
INCLUDE_WORDS, EXCLUDE_WORDS = ("INCLUDE", "KEEP", "1", "TRUE"), ("EXCLUDE", "PRUNE", "0", "FALSE")


@lru_cache
def _folds() -> dict[str, str]:
    """Characters whose case folding isn't their lower case (the sharp s, the final sigma, ligatures and others)."""
    every = (chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    return {x: x.casefold() for x in every if x.casefold() != x.lower()}


@lru_cache
def _fold_ranges() -> str:
    """Those characters as ranges of a regular expression, which tests a character against one after the other."""
    out: list[list[int]] = []
    for i in sorted(map(ord, _folds())):
        if out and i == out[-1][1] + 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out)


def casefold(c: Column) -> Column:
    """Unicode's full case folding: lower case, and character by character only where a text has one that folds otherwise."""
    folds = _folds()
    table = F.create_map(*[F.lit(x) for kv in folds.items() for x in kv])
    one = F.transform(F.split(c, ""), lambda x: F.coalesce(table[x], F.lower(x)))
    ascii_only = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_only, F.lower(c)).when(c.rlike(f"[{_fold_ranges()}]"), F.array_join(one, "")).otherwise(F.lower(c))


def local_name(c: Column) -> Column:
    """What follows the last slash or hash of an IRI (a trailing one is passed over)."""
    return F.regexp_extract(c, "([^/#]*)[/#]*$", 1)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def word_count(c: Column) -> Column:
    """Runs of non-space characters."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def links(html: Column) -> Column:
    """Targets of anchors, in page order."""
    return F.regexp_extract_all(html, F.lit('<a[^>]*href="([^"]*)"'), F.lit(1))


def turtle_escape(c: Column) -> Column:
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def label_unescape(c: Column) -> Column:
    """The two escapes of the restricted dialect."""
    return F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))


def decision(c: Column) -> Column:
    """1 or 0 of a decision word; an error for any other word, null for null."""
    word = F.upper(F.trim(c.cast("string")))
    bad = F.raise_error(F.concat(F.lit("not a decision: "), word)).cast("int")
    return F.when(word.isin(*INCLUDE_WORDS), 1).when(word.isin(*EXCLUDE_WORDS), 0).when(word.isNull(), F.lit(None).cast("int")).otherwise(bad)


def outermost_object(c: Column) -> Column:
    """The text from the first to the last brace: JSON that is wrapped in other words."""
    return F.regexp_extract(c, r"(?s)(\{.*\})", 1)


def dataset_id(c: Column) -> Column:
    """A dataset's id as text: trimmed, and digits without leading zeros."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=[0-9])", "")).otherwise(text)
