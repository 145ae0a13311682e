"""Deterministic samples, folds, chunks and neighbours: orders by a hash of the row's key, so no task draws numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fixpoint import discard, is_empty, ordinals, settle
from .neighbours import nearest

__all__ = ["analogies", "augmented", "balanced", "contrastive", "drawn", "fold_assignments", "folds", "nearest", "permuted", "references", "round_robin", "split_edges", "vote"]


def drawn(seed: int, *keys: Column | str) -> Column:
    """A row's draw: the MD5 of the seed and its keys, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def balanced(rows: DataFrame, size: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """``size`` rows: half positives, the rest negatives, topped up from what is left."""
    draw = drawn(seed, key)
    half = F.when(F.col("target") == 1, F.lit(size // 2)).otherwise(F.lit(size - size // 2))
    ranked = rows.withColumn("_draw", draw).withColumn("_n", F.row_number().over(Window.partitionBy("target").orderBy("_draw", key))).filter(F.col("_n") <= size)  # no more of a class is ever taken, so each task keeps that many
    return ranked.orderBy((F.col("_n") > half).cast("int"), "_draw", key).limit(size).drop("_draw", "_n")


def round_robin(rows: DataFrame, size: int, bucket: list[str], seed: int = 42, key: str = "row_id") -> DataFrame:
    """``size`` rows, one of each bucket in turn, buckets and rows in drawn order."""
    own = Window.partitionBy(*bucket).orderBy("_draw", key)
    ranked = rows.withColumn("_draw", drawn(seed, key)).withColumn("_round", F.row_number().over(own)).filter(F.col("_round") <= size).withColumn("_bucket", drawn(seed, *bucket))
    return ranked.orderBy("_round", "_bucket", *bucket).limit(size).drop("_draw", "_round", "_bucket")


def contrastive(rows: DataFrame, keep: int, prune: int, prop: str, seed: int = 42, key: str = "row_id") -> DataFrame:
    """``keep`` positives and ``prune`` negatives in turn over properties that have both, then over the others."""
    both = rows.groupBy(prop).agg(F.count_distinct("target").alias("_kinds"))
    own = Window.partitionBy(prop, "target").orderBy("_draw", key)
    ranked = rows.join(both, prop).withColumn("_draw", drawn(seed, key)).withColumn("_round", F.row_number().over(own)).filter(F.col("_round") <= max(keep, prune)).withColumn("_late", (F.col("_kinds") < 2).cast("int"))
    first = lambda wanted, n: ranked.filter(wanted).orderBy("_late", "_round", prop, key).limit(n)
    return first(F.col("target") == 1, keep).unionByName(first(F.col("target") == 0, prune)).drop("_kinds", "_draw", "_round", "_late")


def folds(seeds: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(seed, fold): near-equal parts of the drawn order."""
    own = settle(seeds.select("seed").distinct().withColumn("_draw", drawn(seed, "seed")))
    each, more = divmod(own.count(), n)  # the first ``more`` folds have one seed more
    place, cut = F.col("_rank"), more * (each + 1)
    late = F.lit(more) + F.floor((place - cut) / max(each, 1))
    return ordinals(own, ["_draw", "seed"], "_rank").select("seed", F.when(place < cut, F.floor(place / (each + 1))).otherwise(late).cast("long").alias("fold"))


def fold_assignments(branches: DataFrame) -> DataFrame:
    """(test, validation, training): ordered pairs of different branches, the rest in order. Branches are few."""
    names = branches.select("branch").distinct()
    every = names.agg(F.sort_array(F.collect_set("branch")).alias("all"))
    pairs = names.select(F.col("branch").alias("test")).join(F.broadcast(names.select(F.col("branch").alias("validation"))), F.col("test") != F.col("validation"))
    return pairs.join(F.broadcast(every), how="cross").select("test", "validation", F.array_except("all", F.array("test", "validation")).alias("training"))


def permuted(i: Column, half: Column, *key: Column) -> Column:
    """A keyed permutation of range(4 ** half) at ``i``: four rounds of a Feistel network over MD5."""
    size = F.call_function("shiftleft", F.lit(1).cast("long"), half)
    left, right = F.floor(i / size).cast("long"), (i % size).cast("long")
    for turn in range(4):
        digits = F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key], F.lit(str(turn)), right.cast("string"))), 1, 8)
        left, right = right, left.bitwiseXOR(F.conv(digits, 16, 10).cast("long") % size)
    return left * size + right


def references(queries: DataFrame, pool: DataFrame, k: int, seed: int = 42, other_seed: bool = False) -> DataFrame:
    """(query, reference, n): ``k`` references of each query's own group, drawn without repeats; optionally of another seed only.

    The pool's groups are numbered once. A query draws places in its group by a permutation of its own and takes what lies
    there, so no query meets its whole group; the query itself, and rows of its seed, are passed over by drawing on. All
    are taken where fewer than ``k`` are admissible.
    """
    numbered = ordinals(pool.select("reference", "group", F.col("seed").alias("rs")), ["group", "reference", "rs"], "place")
    groups = settle(numbered.groupBy("group").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size")))
    half = F.greatest(F.lit(1), F.ceil(F.length(F.bin(F.col("size") - 1)) / 2)).cast("int")
    asked = queries.select("query", "group", F.col("seed").alias("qs")).join(groups, "group").withColumn("half", half)
    asked = settle(asked.withColumn("domain", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("half") * 2)).withColumn("upto", F.lit(0).cast("long")))
    numbered, out, turn = settle(numbered.select("place", "reference", "rs")), None, 2
    while not is_empty(asked):
        # on average turn * k of these are places of the group
        stop = F.least("domain", F.col("upto") + F.ceil(F.lit(turn * k) * F.col("domain") / F.col("size")))
        drawn_i = asked.select("query", "qs", "first", "size", "half", F.explode(F.sequence("upto", stop - 1)).alias("i"))
        places = drawn_i.withColumn("x", permuted(F.col("i"), F.col("half"), F.lit(seed), F.col("query"))).filter("x < size").select("query", "qs", "i", (F.col("first") + F.col("x")).alias("place"))
        got = places.join(numbered, "place").filter("query <> reference")
        if other_seed:
            got = got.filter("qs <> rs")
        found = settle(got.select("query", "reference", "i"))
        out = found if out is None else out.unionByName(found)
        enough = out.groupBy("query").count().filter(F.col("count") >= k)
        asked = settle(asked.withColumn("upto", stop).filter(F.col("upto") < F.col("domain")).join(enough, "query", "left_anti"))
        turn *= 2
    if out is None:
        out = queries.select("query").join(pool.select("reference"), F.lit(False)).withColumn("i", F.lit(0).cast("long"))
    n = F.row_number().over(Window.partitionBy("query").orderBy("i"))
    return out.select("query", "reference", n.cast("long").alias("n")).filter(F.col("n") <= k)


def vote(neighbours: DataFrame, labels: DataFrame, threshold: float = 0.5, majority: bool = False) -> DataFrame:
    """(query, votes, score, prediction): the mean label of a query's neighbours against a threshold.

    ``majority`` compares the number of keeping votes with the threshold instead.
    """
    rows = neighbours.join(labels.select("id", F.col("label").cast("double").alias("vote")), "id").groupBy("query").agg(F.count(F.lit(1)).alias("votes"), F.avg("vote").alias("score"), F.count_if(F.col("vote") >= threshold).alias("keeps"))
    passed = F.col("keeps") >= threshold if majority else F.col("score") >= threshold
    return rows.select("query", "votes", "score", passed.cast("long").alias("prediction"))


def analogies(queries: DataFrame, keeping: DataFrame, pruning: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(query, reference, pattern, valid): pairs kk and pp are valid analogies, kp and pk are not."""
    own = F.when(F.col("target") == 1, "k").otherwise("p")
    pool = keeping.select(F.col("id").alias("reference"), "seed", F.lit("k").alias("group")).unionByName(pruning.select(F.col("id").alias("reference"), "seed", F.lit("p").alias("group")))
    out = None
    for kind in ("k", "p"):
        got = references(queries.select(F.col("id").alias("query"), F.lit(kind).alias("group"), "seed"), pool.filter(F.col("group") == kind), k, seed, other_seed=True)
        rows = got.join(queries.select(F.col("id").alias("query"), own.alias("q")).distinct(), "query").select("query", "reference", F.concat("q", F.lit(kind)).alias("pattern"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("valid", F.col("pattern").isin("kk", "pp"))


def augmented(pairs: DataFrame, properties: tuple[str, ...] = ("symmetry", "inner-symmetry"), training: bool = False) -> DataFrame:
    """Pairs of vectors (a, b, c, d) with the forms that ``properties`` allow: "symmetry", "inner-symmetry", "reflexivity".

    With both symmetries there is the inner symmetry of the symmetric form too. Reflexive forms are for valid pairs (all, if there is no column ``valid``) in training alone.
    """
    unknown = set(properties) - {"symmetry", "inner-symmetry", "reflexivity"}
    if unknown:
        raise ValueError(f"no such properties: {sorted(unknown)}")
    form = lambda name, order: F.struct(F.lit(name).alias("form"), *[F.col(x).alias(y) for x, y in zip(order, "abcd", strict=True)])
    forms = [form("plain", "abcd")]
    if "symmetry" in properties:
        forms.append(form("symmetry", "cdab"))
    if "inner-symmetry" in properties:
        forms.append(form("inner_symmetry", "badc"))
    if {"symmetry", "inner-symmetry"} <= set(properties):
        forms.append(form("inner_symmetry_of_symmetry", "dcba"))
    every = F.array(*forms)
    if "reflexivity" in properties and training:
        valid = F.col("valid") if "valid" in pairs.columns else F.lit(True)
        every = F.when(valid, F.concat(every, F.array(form("reflexivity", "abab"), form("reflexivity_of_second", "cdcd")))).otherwise(every)
    rest = [c for c in pairs.columns if c not in ("a", "b", "c", "d")]
    return pairs.select(*rest, F.explode(every).alias("x")).select(*rest, "x.*")


def split_edges(edges: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """``edges`` (src, dst, …) with ``held_out``: whole unordered pairs, taken greedily in drawn order, no node losing its last pair.

    In turn, a pair is held out if both its ends have another pair that isn't, until the fraction of all pairs is reached. A
    node refuses its last pair in the order alone, and only if it gave all before: so only pairs that are some node's last can be
    refused, and such a pair waits only for earlier ones at that node. Rounds settle all pairs whose earlier ones are settled,
    which gives what the turn by turn pass gives.
    """
    pair = lambda c: F.array_sort(F.array("src", "dst"))[c]
    rows = edges.withColumns({"_a": pair(0), "_b": pair(1)})
    order = ["draw", "_a", "_b"]
    pairs = ordinals(rows.select("_a", "_b").distinct().withColumn("draw", drawn(seed, F.concat_ws("~", "_a", "_b"))), order, "n").select("n", "_a", "_b")
    pairs = settle(pairs)
    target = round(pairs.count() * fraction)
    last = pairs.select("n", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("node")).groupBy("node").agg(F.max("n").alias("last"))
    ends = lambda c, name: last.select(F.col("node").alias(c), F.col("last").alias(name))
    marked = pairs.join(ends("_a", "la"), "_a").join(ends("_b", "lb"), "_b")
    waiting = settle(marked.filter("n = la OR n = lb").select("n", "_a", "_b", (F.col("n") == F.col("la")).alias("at_a"), (F.col("n") == F.col("lb")).alias("at_b"), F.lit(None).cast("boolean").alias("refused")))
    while not is_empty(waiting.filter("refused IS NULL")):
        # of the pairs at a node that aren't its last: is one refused, are all settled?
        sides = waiting.select("refused", F.explode(F.array_distinct(F.filter(F.array(F.when(~F.col("at_a"), F.col("_a")), F.when(~F.col("at_b"), F.col("_b"))), lambda x: x.isNotNull()))).alias("node"))
        known = sides.groupBy("node").agg(F.max(F.coalesce("refused", F.lit(False))).alias("gave_not"), F.min(F.col("refused").isNotNull()).alias("settled"))
        of = lambda c, s: known.select(F.col("node").alias(c), F.col("gave_not").alias(f"gave_{s}"), F.col("settled").alias(f"settled_{s}"))
        joined = waiting.join(of("_a", "a"), "_a", "left").join(of("_b", "b"), "_b", "left")
        # refused by an end, not refused, or unknown yet
        says = lambda s: F.when(~F.col(f"at_{s}"), False).when(F.coalesce(f"gave_{s}", F.lit(False)), False).when(F.coalesce(f"settled_{s}", F.lit(True)), True)
        after = settle(joined.select("n", "_a", "_b", "at_a", "at_b", F.coalesce("refused", says("a") | says("b")).alias("refused")))
        discard(waiting)
        waiting = after
    taken = ordinals(pairs.join(waiting.filter("refused").select("n"), "n", "left_anti"), ["n"], "turn").filter(F.col("turn") < target)
    return rows.join(taken.select("_a", "_b", F.lit(True).alias("_held")), ["_a", "_b"], "left").select(*edges.columns, F.coalesce("_held", F.lit(False)).alias("held_out"))
