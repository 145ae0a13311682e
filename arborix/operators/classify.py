"""Classifiers: a frontier DataFrame in, the same rows with ``classification`` and ``confidence`` out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fixpoint import ordinals, settle_by

INCLUDE, EXCLUDE, NO_MATCH = "INCLUDE", "EXCLUDE", "NO_MATCH"


class Classifier(Protocol):
    def __call__(self, frontier: DataFrame) -> DataFrame: ...


@dataclass
class TableClassifier:
    """Recorded verdicts (node, classification, confidence, and seed if ``by_seed``); a missing one is ``missing``."""

    verdicts: DataFrame
    missing: str = NO_MATCH
    by_seed: bool = False
    unique: bool = False  # one verdict a key, as ``stored`` has them

    @property
    def keys(self) -> list[str]:
        return ["seed", "node"] if self.by_seed else ["node"]

    def _own(self) -> DataFrame:
        return self.verdicts.select(*self.keys, F.upper("classification").alias("classification"), F.col("confidence").cast("double").alias("confidence"))

    def stored(self) -> TableClassifier:
        """The same with its verdicts stored by node, so that no level makes them again."""
        return self if self.unique else replace(self, verdicts=settle_by(self._own(), "node", self.keys), unique=True)

    def __call__(self, frontier: DataFrame) -> DataFrame:
        own = self.verdicts if self.unique else self._own().dropDuplicates(self.keys)
        return frontier.join(own, self.keys, "left").withColumn("classification", F.coalesce("classification", F.lit(self.missing)))


@dataclass
class RuleClassifier:
    """A condition over the frontier's columns."""

    condition: Column
    confidence: float = 1.0

    def __call__(self, frontier: DataFrame) -> DataFrame:
        return frontier.withColumn("classification", F.when(self.condition, INCLUDE).otherwise(EXCLUDE)).withColumn("confidence", F.lit(self.confidence))


@dataclass
class PythonClassifier:
    """A Python function from evidence texts to (classification, confidence) pairs, called on batches in workers."""

    decide: Callable[[list[str]], list[tuple[str, float]]]
    evidence: str = "evidence"
    batch_size: int = 20

    def __call__(self, frontier: DataFrame) -> DataFrame:
        decide, name, size = self.decide, self.evidence, self.batch_size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out: list[tuple[str, float]] = []
                for at in range(0, len(batch), size):
                    asked = batch[name].iloc[at : at + size].tolist()
                    got = decide(asked)
                    if len(got) != len(asked) or any(x[0] not in (INCLUDE, EXCLUDE) for x in got):
                        raise ValueError("exactly one decision for each candidate is needed")
                    out += got
                yield batch.assign(classification=[x[0] for x in out], confidence=[float(x[1]) for x in out])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frontier.schema) + ", classification string, confidence double"
        return frontier.mapInPandas(run, schema)


@dataclass
class ThresholdClassifier:
    """Scores (node, score) against a threshold; a reached node without a score is an error when it is read."""

    scores: DataFrame
    threshold: float

    def stored(self) -> ThresholdClassifier:
        """The same with its scores stored by node, so that no level makes them again."""
        return self if hasattr(self.scores, "stored_at") else replace(self, scores=settle_by(self.scores.select("node", "score"), "node"))

    def __call__(self, frontier: DataFrame) -> DataFrame:
        rows = frontier.join(self.scores.select("node", "score"), "node", "left")
        score = F.when(F.col("score").isNull(), F.raise_error(F.concat(F.lit("no score for "), "node")).cast("double")).otherwise(F.col("score"))
        return rows.withColumn("confidence", score).withColumn("classification", F.when(F.col("confidence") >= self.threshold, INCLUDE).otherwise(EXCLUDE)).drop("score")


def batches(rows: DataFrame, order: list[str], size: int, group: list[str] | None = None) -> DataFrame:
    """``rows`` with ``batch`` (from 0) and ``idx`` (from 1): an ordered list, by group, in chunks of ``size``."""
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) if group else ordinals(rows, order)
    return numbered.withColumn("batch", F.floor(F.col("n") / size).cast("long")).withColumn("idx", (F.col("n") % size + 1).cast("long")).drop("n")


def messages(batched: DataFrame, text: str, group: list[str]) -> DataFrame:
    """(group, batch, message): the numbered evidence lines of each batch."""
    line = F.struct("idx", F.concat(F.col("idx").cast("string"), F.lit(". "), F.col(text)).alias("line"))
    return batched.groupBy(*group, "batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("message"))


def request_lines(message_rows: DataFrame, prefix: str, system: str) -> DataFrame:
    """JSON request lines with keys ``<prefix>_batch<number in six digits>``."""
    key = F.format_string(prefix + "_batch%06d", "batch")
    return message_rows.select(F.to_json(F.struct(key.alias("key"), F.struct(F.lit(system).alias("system"), F.col("message").alias("user")).alias("request"))).alias("value"))


def checked_probabilities(rows: DataFrame) -> DataFrame:
    """Rows (classification, p_include, p_exclude): the two must sum to 1 and the greater be the choice."""
    wrong = (F.abs(F.col("p_include") + F.col("p_exclude") - 1) > 1e-5) | F.when(F.col("classification") == INCLUDE, F.col("p_include") < F.col("p_exclude") - 1e-6).otherwise(F.col("p_exclude") < F.col("p_include") - 1e-6)
    return rows.filter(F.when(wrong, F.raise_error(F.lit("probabilities do not fit the choice")).cast("boolean")).otherwise(True))


def probability_answers(rows: DataFrame, payloads: DataFrame, overridden: list[str] | None = None) -> DataFrame:
    """Rows (batch, idx, node) with choice, probabilities and confidence from one JSON payload (batch, value) a batch.

    A payload has a model and answers named ``candidate_<idx>``, each a choice with the probabilities of INCLUDE and EXCLUDE
    (an object, or a list of value and probability). Malformed ones are errors when read: no model, names that aren't just
    those asked for, no two probabilities that sum to 1, a choice that isn't the likelier. A refusal is an error too, but for
    nodes of ``overridden``, which are excluded without probabilities.
    """
    answer = "struct<name:string,type:string,choice:string,confidence:double,probabilities:string>"
    text = F.get_json_object("value", "$.answers")
    listed = F.from_json(text, f"array<{answer}>")
    mapped = F.from_json(text, f"map<string,{answer}>")
    parsed = payloads.select("batch", F.get_json_object("value", "$.model").alias("response_model"), F.when(text.startswith("["), F.transform(listed, lambda x: F.struct(x["name"].alias("name"), x.alias("a")))).otherwise(F.transform(F.map_entries(mapped), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("a")))).alias("answers"))
    given = parsed.select("batch", "response_model", F.explode_outer("answers").alias("x")).select("batch", "response_model", "x.name", "x.a")
    named = given.groupBy("batch", "name").agg(F.first("response_model").alias("response_model"), F.first("a").alias("a"), F.count(F.lit(1)).alias("times"))
    asked = rows.withColumn("name", F.concat(F.lit("candidate_"), F.col("idx").cast("string")))
    joined = asked.join(named, ["batch", "name"], "full_outer")
    probabilities = F.col("a.probabilities")
    pairs = F.from_json(probabilities, "array<struct<value:string,probability:double>>")
    of = lambda word: F.when(probabilities.startswith("["), F.get(F.filter(pairs, lambda p: p["value"] == word), F.lit(0))["probability"]).otherwise(F.get_json_object(probabilities, f"$.{word}").cast("double"))
    chosen = F.when(F.col("choice") == INCLUDE, F.col("p_include")).otherwise(F.col("p_exclude"))
    override = (F.col("a.type") == "refusal") & F.col("node").isin(*(overridden or [""]))
    rows_ = joined.withColumns({"p_include": of(INCLUDE), "p_exclude": of(EXCLUDE), "choice": F.col("a.choice"), "override": F.coalesce(override, F.lit(False))})
    outside = lambda c: F.col(c).isNull() | ~F.col(c).between(0, 1)
    fault = (
        F.when(F.col("idx").isNull() | F.col("a").isNull() | (F.col("times") != 1), "answers are not exactly the candidates")
        .when(F.col("response_model").isNull(), "no response model")
        .when(F.col("override"), F.lit(None).cast("string"))
        .when(F.coalesce(F.col("a.type"), F.lit("")) != "choice", "not a choice")
        .when(outside("p_include") | outside("p_exclude"), "no two probabilities")
        .when(F.abs(F.col("p_include") + F.col("p_exclude") - 1) > 1e-5, "probabilities do not sum to one")
        .when(~F.coalesce(F.col("choice").isin(INCLUDE, EXCLUDE), F.lit(False)) | (chosen < F.greatest("p_include", "p_exclude") - 1e-6), "the choice is not the likelier")
    )
    checked = rows_.filter(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(True))
    plain = lambda c: F.when(~F.col("override"), c)
    return checked.select(*rows.columns, F.when(F.col("override"), EXCLUDE).otherwise(F.col("choice")).alias("classification"), plain(F.col("a.confidence")).alias("confidence"), plain(F.col("p_include")).alias("p_include"), plain(F.col("p_exclude")).alias("p_exclude"), plain(chosen).alias("selected_probability"), "response_model", F.col("override").alias("overridden"))


def response_schema(kind: str = "json_schema") -> dict:
    """The JSON schema of a batch's response: ``json_schema`` (closed objects) or ``open_api`` (upper-case types, titles, ordering)."""
    fields = {"idx": ("integer", {"minimum": 1}), "classification": ("string", {"enum": [INCLUDE, EXCLUDE]}), "confidence": ("number", {"minimum": 0.0, "maximum": 1.0})}
    closed = kind == "json_schema"
    name = (lambda t: t) if closed else str.upper

    def record(properties: dict, title: str) -> dict:
        out = {"type": name("object"), "properties": properties, "required": list(properties)}
        return out | ({"additionalProperties": False} if closed else {"title": title})

    one = record({k: {"type": name(t), **{x: float(v) if x == "minimum" and not closed else v for x, v in rest.items()}} | ({} if closed else {"title": k.capitalize()}) for k, (t, rest) in fields.items()}, "PromptDecision")
    if not closed:
        one["propertyOrdering"] = list(fields)
    return record({"evaluations": {"type": name("array"), "items": one} | ({} if closed else {"title": "Evaluations"})}, "BatchResponse")
