"""Learned quality rules as decision lists, with DataFrame functions only.

``statistics`` computes per-text counts with built-in expressions; ``learn`` grows and prunes conjunctions of
thresholds by sequential covering, from grouped counts over all labelled rows; ``DecisionList.verdict`` emits the rules
as one ordered conditional expression.

* A null or empty text has no words: all counts are 0 and the base rule fails. Repeated rows are scored each alone.
* Words are runs of ``[^\\x20\\x09-\\x0D]``; characters are code points. Windows are told apart by 64-bit hashes.
* Ties between candidate thresholds go to the first statistic and the lowest threshold. Without labels, or with labels
  of one kind, the list is empty and its verdict is "keep". Null labels are ignored.
* Extra columns are kept by ``with_statistics`` under their own names, whatever they are; only one of the name that is
  given for the statistics (``stats``) is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize

#: Counts of a text, and ratios of them in thousandths that the rules may use besides.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("symbols_per_mille", "repeat_per_mille", "dup_lines_per_mille", "word_length_milli", "upper_per_mille", "distinct_per_mille", "bars_per_mille", "marks_per_mille")
_SPACES = "\t\n\x0b\x0c\r"
WINDOW = 8
#: Labels that are broadcast at most (12 bytes each) to find labelled texts; above this both sides are shuffled.
BROADCAST_LABELS = 1_000_000


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and names it within ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _words_sql() -> str:
    """From ``w``, the words: their number, how many differ, and how many lie in windows found twice or more."""
    gaps = f"aggregate(transform(p, (v, j) -> CASE WHEN j + 1 < size(p) THEN least({WINDOW}, get(p, j + 1) - v) ELSE {WINDOW} END), 0, (a, b) -> a + b)"
    again = "transform(filter(s, (e, j) -> get(s, j - 1).x = e.x OR get(s, j + 1).x = e.x), e -> e.i)"
    covered = _let("array_sort(transform(g, (x, i) -> struct(x, i)))", "s", _let(f"array_sort({again})", "p", gaps))
    windows = _let(f"transform(sequence(1, size(h) - {WINDOW - 1}), i -> xxhash64(slice(h, i, {WINDOW})))", "g", f"CASE WHEN size(array_distinct(g)) = size(g) THEN 0 ELSE {covered} END")
    return _let("transform(w, x -> xxhash64(x))", "h", f"struct(CAST(size(h) AS BIGINT) AS n_words, CAST(size(array_distinct(h)) AS BIGINT) AS n_distinct, CAST(CASE WHEN size(h) <= {WINDOW} THEN 0 ELSE {windows} END AS BIGINT) AS n_repeat_words)")


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "stats") -> DataFrame:
    """``docs`` with a struct column ``name`` of COUNTS and RATIOS (all long)."""
    own = [c for c in docs.columns if c != name]
    at = {x: free_name(docs, x) for x in ("w", "word_chars", "n_symbols", "bars", "marks", "upper", "lines", "s")}
    of = lambda x, field="": F.col(f"`{at[x]}`{field and '.' + field}")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    dropped = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    raw = docs.select(
        *[docs[f"`{c}`"] for c in own],
        F.array_remove(F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " "), "").alias(at["w"]),
        F.length(F.translate(text, " " + _SPACES, "")).cast("long").alias(at["word_chars"]),
        dropped("#*$%&|<>").cast("long").alias(at["n_symbols"]),
        dropped("|").cast("long").alias(at["bars"]),
        dropped("!?").cast("long").alias(at["marks"]),
        dropped("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias(at["upper"]),
        F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))[0].alias(at["lines"]),
    )
    raw = raw.withColumn(at["s"], F.expr(_let(f"`{at['w']}`", "w", _words_sql())))
    per_mille = lambda a, b: (a * 1000 / F.greatest(b, F.lit(1))).cast("long")
    words, chars = of("s", "n_words"), of("word_chars")
    stats = F.struct(
        words.alias("n_words"),
        chars.alias("word_chars"),
        of("n_symbols").alias("n_symbols"),
        of("lines", "d").cast("long").alias("n_dup_lines"),
        of("s", "n_repeat_words").alias("n_repeat_words"),
        per_mille(of("n_symbols"), chars).alias("symbols_per_mille"),
        per_mille(of("s", "n_repeat_words"), words).alias("repeat_per_mille"),
        per_mille(of("lines", "d"), of("lines", "n")).alias("dup_lines_per_mille"),
        per_mille(chars, words).alias("word_length_milli"),
        per_mille(of("upper"), chars).alias("upper_per_mille"),
        per_mille(of("s", "n_distinct"), words).alias("distinct_per_mille"),
        per_mille(of("bars"), words).alias("bars_per_mille"),
        per_mille(of("marks"), words).alias("marks_per_mille"),
    )
    return raw.select(*[f"`{c}`" for c in own], stats.alias(name))


def base_failed(stats: Column) -> Column:
    """Too short, or more than 30 % of the words in repeated windows."""
    return (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold) and its counts among the pruning rows."""

    conditions: tuple[tuple[str, bool, int], ...]
    bad: int
    good: int

    def holds(self, stats: Column) -> Column:
        out = F.lit(True)
        for name, above, threshold in self.conditions:
            out = out & ((stats[name] > threshold) if above else (stats[name] <= threshold))
        return out


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = ()

    def rule_number(self, stats: Column) -> Column:
        """The first rule that holds, from 1; 0 if none."""
        if not self.rules:
            return F.lit(0)
        out = F.when(self.rules[0].holds(stats), F.lit(1))
        for i, rule in enumerate(self.rules[1:], 2):
            out = out.when(rule.holds(stats), F.lit(i))
        return out.otherwise(F.lit(0))

    def verdict(self, stats: Column) -> Column:
        """True: keep."""
        return self.rule_number(stats) == 0


def learn(labelled: DataFrame, max_rules: int = 8, max_conditions: int = 3, points: int = 24, precision: float = 0.9, least: int = 3) -> DecisionList:
    """Decision list for label 0 from ``labelled`` (stats, quality), over all its rows.

    Rows are dealt by a hash to a growing part (two thirds) and a pruning part. A rule grows by the condition with the
    most gain in information, then loses its last conditions while that makes (bad - good) / (bad + good) on the
    pruning part no worse; it enters the list if at least ``precision`` of the pruning rows that it covers, and
    ``least`` of them, are bad. Rows covered by it leave both parts. Candidate thresholds are ``points`` quantiles among
    bad rows and as many among all. All counts are grouped sums: only (statistic, bin) totals reach the driver.
    """
    names = COUNTS + RATIOS
    rows = labelled.filter(F.col("quality").isin(0, 1)).select(*[F.col("stats")[n].alias(n) for n in names], (F.col("quality") == 0).cast("int").alias("bad"))
    rows = rows.filter(" AND ".join(f"{n} IS NOT NULL" for n in names))
    at = [(i + 0.5) / points for i in range(points)]
    found = rows.groupBy("bad").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(n, at, 2000).alias(n) for n in names]).collect()
    if len(found) < 2:
        return DecisionList()
    cuts = {n: sorted({int(v) for r in found for v in r[n]}) for n in names}
    # the bin of a value: how many cuts lie below it; a condition "> cut[i]" is then "bin > i"
    binned = rows.select("bad", (F.pmod(F.xxhash64(*names), F.lit(3)) == 0).cast("int").alias("prune"), *[sum(((F.col(n) > c).cast("int") for c in cuts[n]), F.lit(0)).cast("short").alias(n) for n in names])
    binned = materialize(binned.groupBy(*binned.columns).agg(F.count(F.lit(1)).alias("n")), "rules")
    covers = lambda conditions: F.expr(" AND ".join([f"{n} {'>' if above else '<='} {i}" for n, above, i in conditions]) or "true")

    def totals(rest: DataFrame) -> dict:
        """(prune, bad, statistic) -> {bin: rows}"""
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("bin")) for n in names]))
        out: dict = {}
        for r in rest.select("prune", "bad", "n", pairs.alias("x")).groupBy("prune", "bad", "x.name", "x.bin").agg(F.sum("n").alias("n")).collect():
            out.setdefault((r["prune"], r["bad"], r["name"]), {})[r["bin"]] = r["n"]
        return out

    from math import log2

    rules: list[Rule] = []
    rest = binned
    while len(rules) < max_rules:
        conditions: list[tuple[str, bool, int]] = []
        inside = rest
        pruned: list[tuple[int, int]] = []  # (bad, good) of the pruning part after each condition
        while True:
            counts = totals(inside)
            some = names[0]
            bad, good = (sum(counts.get((0, b, some), {}).values()) for b in (1, 0))
            if conditions:
                pruned.append(tuple(sum(counts.get((1, b, some), {}).values()) for b in (1, 0)))
            if not bad or not good or len(conditions) >= max_conditions:
                break
            before, best = log2(bad / (bad + good)), (0.0, None)
            for n in names:
                b_bins, g_bins = counts.get((0, 1, n), {}), counts.get((0, 0, n), {})
                low_b = low_g = 0
                for i in range(len(cuts[n])):
                    low_b, low_g = low_b + b_bins.get(i, 0), low_g + g_bins.get(i, 0)
                    for above, b, g in ((True, bad - low_b, good - low_g), (False, low_b, low_g)):
                        if b and (gain := b * (log2(b / (b + g)) - before)) > best[0] + 1e-9:
                            best = (gain, (n, above, i))
            if best[1] is None:
                break
            conditions.append(best[1])
            inside = inside.filter(covers([best[1]]))
        worth = lambda x: (x[0] - x[1]) / (x[0] + x[1]) if sum(x) else -1.0
        while len(conditions) > 1 and worth(pruned[len(conditions) - 2]) >= worth(pruned[len(conditions) - 1]):
            conditions.pop()
        b, g = pruned[len(conditions) - 1] if conditions else (0, 0)
        if not conditions or b < least or b < precision * (b + g):
            break
        rules.append(Rule(tuple((n, above, cuts[n][i]) for n, above, i in conditions), b, g))
        rest = rest.filter(~covers(conditions))
    return DecisionList(tuple(rules))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: its counts, base_failed, kept, and the number of the rule that it fell to (0: none).

    The statistics are computed once and stored (numbers only); labels join those, never texts.
    """
    stats = materialize(with_statistics(docs.select(docs["doc_id"], docs["text"])).select("doc_id", "stats"), "statistics")
    rules = learn(stats.join(labels.select(labels["doc_id"], labels["quality"]), "doc_id").select("stats", "quality"))
    s = F.col("stats")
    return stats.select("doc_id", *[s[n].alias(n) for n in COUNTS], base_failed(s).alias("base_failed"), (~base_failed(s) & rules.verdict(s)).alias("kept"), rules.rule_number(s).cast("int").alias("rule"))


def learn_from(docs: DataFrame, labels: DataFrame) -> DecisionList:
    """Rules from the labelled documents alone. Few enough labels are broadcast, so that texts stay where they are."""
    own = labels.select(labels["doc_id"], labels["quality"])
    some = docs.select(docs["doc_id"], docs["text"]).join(F.broadcast(own) if own.count() <= BROADCAST_LABELS else own, "doc_id")
    return learn(materialize(with_statistics(some).select("stats", "quality"), "labelled"))
