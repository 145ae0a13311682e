"""Prompt texts: demonstrations, templates and the checks on a generated prompt."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIELD = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def demonstration_block(rows: DataFrame, text: str = "evidence") -> DataFrame:
    """One row (block): numbered demonstrations (ord, evidence, decision) with their decisions, a line each.

    A prompt's demonstrations are few; the block is one string by nature.
    """
    line = F.concat(F.col("ord").cast("string"), F.lit(". "), F.col(text), F.lit(" => "), F.when(F.col("decision") == 1, "INCLUDE").otherwise("EXCLUDE"))
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("block"))


def render(template: str, values: dict[str, str]) -> str:
    """The template with ``{{ name }}`` fields filled; an unknown or an unused name is an error."""
    names = set(_FIELD.findall(template))
    if names != set(values):
        raise ValueError(f"fields {sorted(names ^ set(values))} don't fit the template")
    return _FIELD.sub(lambda m: values[m[1]], template)


def problems(text: str, least: int = 500, headings: tuple[str, ...] = (), fences: bool = True) -> list[str]:
    """What is wrong with a generated prompt: too short, a heading missing, an unfilled field, a code fence."""
    out = [] if len(text.strip()) >= least else [f"fewer than {least} characters"]
    out += [f"no heading with {h}" for h in headings if not re.search(rf"(?im)^#{{1,3}}\s+.*\b{re.escape(h)}\b", text)]
    if _FIELD.search(text):
        out.append("an unfilled field")
    if not fences and "```" in text:
        out.append("a code fence")
    return out


def accepted(candidates: Column, least: int = 500) -> Column:
    """The first of an array of attempts that is long enough, null if none is."""
    return F.element_at(F.filter(candidates, lambda x: F.length(F.trim(x)) >= least), 1)
