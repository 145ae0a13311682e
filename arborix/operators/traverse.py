"""Breadth-first traversals as driver loops over joins.

Each level is one plan: join the frontier to the edges, drop what was visited, keep the least way to each node, classify,
store the level. Visited nodes are never gathered; only a level's counts reach the driver. All seeds of a per-seed
traversal run at once.

A node keeps its parent and the step from there; no path travels. Ways are compared by ranks: a frontier node's rank is its
place among all frontier nodes by (its parent's rank, its step), numbered by range partitions, and a step's rank is its place among all
steps by their words. Paths are put together at the end, each round doubling the stretch that a node knows. Reachability from many seeds keeps
one bit for each seed, 64 to a row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborix.functions.text import casefold, local_name

from .classify import INCLUDE, NO_MATCH, Classifier
from .fixpoint import bucket_count, discard, is_empty, ordinals, settle, settle_by

#: Seeds that are broadcast at most when bits are spread to rows (some 50 bytes each); above this they are joined by a shuffle.
BROADCAST_SEEDS = 100_000


def relation_word(pred: Column, inverse: Column) -> Column:
    """A relation's name in a path."""
    return F.concat(F.when(inverse, "inverse ").otherwise(""), pred)


def along(forest: DataFrame, piece: Column) -> DataFrame:
    """(seed, node, text): the pieces of all rows from the root to each row of ``forest`` (seed, node, parent), joined.

    ``parent`` is null at roots. A row knows the text from an ancestor on; each round it takes over what that ancestor
    knows, so a forest of depth d takes log(d) rounds.
    """
    state = settle(forest.select("seed", "node", F.col("parent").alias("above"), piece.alias("text")))
    while not is_empty(state.filter("above IS NOT NULL")):
        upper = state.select("seed", F.col("node").alias("above"), F.col("above").alias("next"), F.col("text").alias("head"))
        longer = state.filter("above IS NOT NULL").join(upper, ["seed", "above"]).select("seed", "node", F.col("next").alias("above"), F.concat("head", "text").alias("text"))
        after = settle(state.filter("above IS NULL").unionByName(longer))
        discard(state)
        state = after
    return state.select("seed", "node", "text")


def _named(rows: DataFrame, labels: DataFrame | None, unlabelled: Callable[[Column], Column] = local_name) -> DataFrame:
    """``rows`` with the label of ``node`` as ``_label``: without one what ``unlabelled`` makes of it, without labels the node itself."""
    if labels is None:
        return rows.withColumn("_label", F.col("node"))
    own = labels.select("node", F.col("label").alias("_label")).groupBy("node").agg(F.min("_label").alias("_label"))
    return rows.join(own, "node", "left").withColumn("_label", F.coalesce(F.nullif("_label", F.lit("")), unlabelled(F.col("node"))))


def with_paths(visited: DataFrame, labels: DataFrame | None = None, word: Callable[[Column, Column], Column] = relation_word, unlabelled: Callable[[Column], Column] = local_name) -> DataFrame:
    """``visited`` with ``path``: ``A --relation--> B …`` by labels (node, label), ``(seed node)`` for a seed."""
    named = _named(visited, labels, unlabelled)
    step = F.concat(F.lit(" --"), word(F.col("pred"), F.col("inverse")), F.lit("--> "), "_label")
    texts = along(named, F.when(F.col("parent").isNull(), F.col("_label")).otherwise(step))
    joined = visited.join(texts, ["seed", "node"])
    return joined.select(*visited.columns, F.when(F.col("parent").isNull(), "(seed node)").otherwise(F.col("text")).alias("path"))


def _ranked_steps(edges: DataFrame, labels: DataFrame | None, word: Callable[[Column, Column], Column]) -> DataFrame:
    """Edges with ``step``: the place of (relation, target's label) among all, as it goes on in a path (before " --")."""
    named = _named(edges.select("pred", "inverse", F.col("dst").alias("node")).distinct(), labels)
    worded = named.select("pred", "inverse", "node", F.concat(word(F.col("pred"), F.col("inverse")), F.lit("--> "), "_label", F.lit(" --")).alias("words"))
    placed = ordinals(settle(worded), ["words", "node", "pred", "inverse"], "step")
    return edges.join(placed.select("pred", "inverse", F.col("node").alias("dst"), "step"), ["pred", "inverse", "dst"])


def _roots(seeds: DataFrame) -> DataFrame:
    return seeds.select(F.col("node").alias("seed"), "node").distinct().select("seed", "node", F.lit(0).cast("long").alias("depth"), F.lit(None).cast(seeds.schema["node"].dataType).alias("parent"), F.lit(None).cast("string").alias("pred"), F.lit(None).cast("boolean").alias("inverse"))


def gated_bfs(edges: DataFrame, seeds: DataFrame, classifier: Classifier, max_depth: int | None = None, per_seed: bool = False, labels: DataFrame | None = None, word: Callable[[Column, Column], Column] = relation_word, ranked: bool = True) -> DataFrame:
    """(seed, node, depth, classification, confidence, included, parent, pred, inverse) of all nodes reached through included ones.

    ``edges``: directed (src, pred, inverse, dst). Seeds are included at depth 0 and never classified. Each level's new
    nodes are classified in one call; of several ways to a node the one with the least seed and path in words counts, its
    words being those of ``with_paths`` (a label that holds " --" itself counts as shorter than what follows it). Without ``ranked`` only the seed and the last step are compared.
    ``per_seed`` traverses each seed on its own.
    """
    key = ["seed", "node"] if per_seed else ["node"]
    classifier = _stored(classifier)
    links = edges.select("src", "pred", "inverse", "dst")
    if ranked:
        plain = settle(links)
        links = settle_by(_ranked_steps(plain, labels, word), "src")
        discard(plain)
    else:
        links = settle_by(links, "src")  # once, not again at each level
    level = settle(_roots(seeds).select("seed", "node", "depth", F.lit("SEED").alias("classification"), F.lit(1.0).alias("confidence"), F.lit(True).alias("included"), "parent", "pred", "inverse"))
    columns = level.columns
    visited, depth, included = level, 0, level.count()
    frontier = ordinals(level.select("seed", F.col("node").alias("src")), ["seed"], "rank") if ranked else level.select("seed", F.col("node").alias("src"))
    most, width = included, (links.agg(F.max("step")).first()[0] or 0) + 1 if ranked else 1
    while included and (max_depth is None or depth < max_depth):
        depth += 1
        reached = frontier.join(links, "src").withColumnRenamed("dst", "node")
        fresh = reached.join(visited.select(*key), key, "left_anti")
        way = F.struct(*(["rank", "step"] if ranked else []), "seed", "src", "pred", "inverse")
        chosen = fresh.groupBy(*key).agg(F.min(way).alias("way"))
        asked = chosen.select(F.col("way.seed").alias("seed"), "node", F.lit(depth).cast("long").alias("depth"), F.col("way.src").alias("parent"), "way.pred", "way.inverse", *(["way.rank", "way.step"] if ranked else []))
        judged = classifier(asked).withColumn("included", F.col("classification") == INCLUDE)
        level = settle(judged.select(*columns, *(["rank", "step"] if ranked else [])))
        found, included = level.agg(F.count(F.lit(1)), F.count_if("included")).first()
        if not found:
            break
        visited = visited.unionByName(level.select(*columns))
        frontier = level.filter("included").select("seed", F.col("node").alias("src"), *(["rank", "step"] if ranked else []))
        if ranked and included and (max_depth is None or depth < max_depth):
            if most * width * width < 1 << 63:  # the next level's ranks fit into 64 bits
                frontier, most = frontier.select("seed", "src", (F.col("rank") * width + F.col("step")).alias("rank")), most * width
            else:
                frontier, most = ordinals(frontier, ["rank", "step", "src"], "place").select("seed", "src", F.col("place").alias("rank")), included
    return visited


def stored_links(edges: DataFrame) -> DataFrame:
    """(src, dst) of ``edges``, stored once for several traversals by ``gated_nodes``."""
    return settle_by(edges.select("src", "dst"), "src")


def _stored(classifier: Classifier) -> Classifier:
    return classifier.stored() if hasattr(classifier, "stored") else classifier


def gated_nodes(links: DataFrame, seeds: DataFrame, classifier: Classifier, max_depth: int | None = None) -> DataFrame:
    """(node, depth, classification, confidence, included): as ``gated_bfs`` over all seeds, where nobody asks for the ways.

    ``links`` are those of ``stored_links``. Of a node's ways none is chosen, so a level is its distinct nodes.
    """
    classifier = _stored(classifier)
    level = settle(seeds.select("node").distinct().select("node", F.lit(0).cast("long").alias("depth"), F.lit("SEED").alias("classification"), F.lit(1.0).alias("confidence"), F.lit(True).alias("included")))
    visited, depth, included = level, 0, True
    while included and (max_depth is None or depth < max_depth):
        depth += 1
        reached = level.filter("included").select(F.col("node").alias("src")).join(links, "src").select(F.col("dst").alias("node")).distinct()
        fresh = reached.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        level = settle(classifier(fresh).withColumn("included", F.col("classification") == INCLUDE).select(*visited.columns))
        found, included = level.agg(F.count(F.lit(1)), F.count_if("included")).first()
        if not found:
            break
        visited = visited.unionByName(level)
    return visited


def thesaurus_bfs(pairs: DataFrame, seeds: DataFrame, labels: DataFrame, classifier: Classifier, max_iterations: int | None = None) -> DataFrame:
    """(node, depth, parent, relations, classification, confidence, included) of concepts reached through included ones.

    ``pairs``: undirected neighbours (src, dst, relations). Each level's included concepts are gone through in the order of
    label and name (the ``seeds`` (node, place) in that of place), and what the last of them says about a neighbour stays: parent and relations are
    the last writer's. A concept is visited once it is asked about, whatever the verdict.
    """
    found = last_writers(pairs, seeds, labels, classifier, max_iterations)
    told = pairs.select(F.col("src").alias("parent"), F.col("dst").alias("node"), "relations")
    return found.join(told, ["parent", "node"], "left").select("node", "depth", "parent", "relations", "classification", "confidence", "included")


def last_writers(links: DataFrame, seeds: DataFrame, labels: DataFrame, classifier: Classifier, max_iterations: int | None = None, name: Callable[[Column], Column] = lambda node: node) -> DataFrame:
    """``thesaurus_bfs`` without what is said: links (src, dst), which may repeat, and for each node the last that led to it.

    The concepts of a level are numbered in their order once, so that of the links to a node the one of the greatest number
    stays. ``name`` makes a node's name where nodes are numbers: those are told apart without sorting, for all columns have a fixed length.
    """
    own = settle_by(labels.groupBy("node").agg(F.min("label").alias("label")), "node")
    classifier = _stored(classifier)
    links = settle_by(links.select("src", "dst"), "src")
    kind = links.schema["src"].dataType
    level = settle(seeds.select("node", F.lit(0).cast("long").alias("depth"), F.lit(None).cast(kind).alias("parent"), F.lit(INCLUDE).alias("classification"), F.lit(1.0).alias("confidence"), F.lit(True).alias("included")))
    frontier = ordinals(seeds.select(F.col("node").alias("src"), "place"), ["place", "src"], "turn").select("src", "turn")
    visited, depth, included = level, 0, True
    while included and (max_iterations is None or depth < max_iterations):
        depth += 1
        reached = frontier.hint("shuffle_hash").join(links, "src")  # links lie in buckets and aren't sorted anew at each level
        last = reached.groupBy(F.col("dst").alias("node")).agg(F.max_by("src", "turn").alias("parent"))
        asked = last.join(visited.select("node"), "node", "left_anti").select("node", F.lit(depth).cast("long").alias("depth"), "parent")
        level = settle(classifier(asked).withColumn("included", F.col("classification") == INCLUDE).select(*visited.columns))
        found, included = level.agg(F.count(F.lit(1)), F.count_if("included")).first()
        if not found:
            break
        visited = visited.unionByName(level)
        if included and (max_iterations is None or depth < max_iterations):
            label = F.coalesce(F.nullif("label", F.lit("")), local_name(name(F.col("node"))))
            turns = level.filter("included").select("node").join(own, "node", "left").select(F.col("node").alias("src"), casefold(label).alias("cf"), name(F.col("node")).alias("name"))
            frontier = ordinals(turns, ["cf", "name"], "turn").select("src", "turn")
    discard(links, own)
    return visited


def _numbered(seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seed, chunk, bit) of the distinct seeds, 64 to a chunk, stored; and the rows as (node, chunk, bits)."""
    numbers = ordinals(seeds.select("seed").distinct(), ["seed"], "n")
    numbers = settle(numbers.select("seed", F.floor(F.col("n") / 64).cast("int").alias("chunk"), (F.col("n") % 64).cast("int").alias("bit")))
    return numbers, _packed(seeds, numbers)


def _packed(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """(node, chunk, bits) of ``rows`` (seed, node)."""
    few = numbers.count() <= BROADCAST_SEEDS
    joined = rows.select("seed", "node").join(F.broadcast(numbers) if few else numbers, "seed")
    return joined.groupBy("node", "chunk").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def _spread(rows: DataFrame, numbers: DataFrame, bits: str = "bits") -> DataFrame:
    """``rows`` (chunk, bits, …) once for each seed whose bit is set, with ``seed``."""
    few = numbers.count() <= BROADCAST_SEEDS
    own = numbers.select("seed", F.col("chunk").alias("of"), "bit")
    set_ = (F.col("chunk") == F.col("of")) & (F.call_function("getbit", F.col(bits), F.col("bit")) == 1)
    return rows.join(F.broadcast(own) if few else own, set_).drop("chunk", "of", "bit", bits)


def _new_bits(reached: DataFrame, met: DataFrame) -> DataFrame:
    """(node, chunk, bits) of ``reached`` that aren't in ``met`` (rows of both may repeat a node)."""
    zero = F.lit(0).cast("long")
    both = reached.select("node", "chunk", F.col("bits").alias("now"), zero.alias("before")).unionByName(met.select("node", "chunk", zero.alias("now"), F.col("bits").alias("before")))
    fresh = both.groupBy("node", "chunk").agg(F.bit_or("now").alias("now"), F.bit_or("before").alias("before"))
    return fresh.select("node", "chunk", F.col("now").bitwiseAND(F.bitwise_not("before")).alias("bits")).filter("bits <> 0")


def _step_bits(frontier: DataFrame, links: DataFrame) -> DataFrame:
    return frontier.select(F.col("node").alias("src"), "chunk", "bits").join(links, "src").select(F.col("dst").alias("node"), "chunk", "bits")  # ``_new_bits`` groups them


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, masked: DataFrame | None = None) -> DataFrame:
    """(seed, node, depth): everything reachable from each seed (seeds: node, or seed and node), masked nodes never entered.

    A level holds (node, bits), a bit for each seed: the edges of a node are followed once a level for 64 seeds.
    """
    own = seeds if "seed" in seeds.columns else seeds.select(F.col("node").alias("seed"), "node")
    links = edges.select("src", "dst")
    if masked is not None:
        links = links.join(masked.select(F.col("node").alias("dst")).distinct(), "dst", "left_anti")
    numbers, roots = _numbered(own.select("seed", "node").distinct())
    levels = _waves(settle_by(links, "src", ["src", "dst"]), roots, max_depth)
    return _spread(reduce(DataFrame.unionByName, levels), numbers).select("seed", "node", "depth")


def _waves(links: DataFrame, roots: DataFrame, max_depth: int | None = None, wanted: DataFrame | None = None) -> list[DataFrame]:
    """(node, chunk, bits, depth) of each level, stored: the seeds that first reach a node there. With ``wanted`` (node, chunk, bits) up to the last of these."""
    levels, visited = [settle(roots.withColumn("depth", F.lit(0).cast("long")))], None
    left = wanted
    while max_depth is None or len(levels) <= max_depth:
        if left is not None:
            had = levels[-1].select("node", "chunk", F.col("bits").alias("had"))
            after = settle(left.join(had, ["node", "chunk"], "left").select("node", "chunk", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))).alias("bits")).filter("bits <> 0"))
            if left is not wanted:
                discard(left)
            left = after
            if is_empty(left):
                break
        visited = levels[-1] if visited is None else visited.unionByName(levels[-1])
        wave = levels[-1] if wanted is None else levels[-1].hint("shuffle_hash")
        level = settle(_new_bits(_step_bits(wave, links), visited).withColumn("depth", F.lit(len(levels)).cast("long")))
        if is_empty(level):
            break
        levels.append(level)
    return levels


def _towards(links: DataFrame, levels: list[DataFrame], wanted: DataFrame) -> list[DataFrame]:
    """(src, chunk, dst, ord, bits) from each of ``levels`` to the next, stored: the steps on shortest ways to ``wanted`` (node, chunk, bits)."""
    back, steps = settle_by(links.select("src", "dst", "ord"), "dst"), []
    n, by = bucket_count(links.sparkSession), ["src", "chunk"]
    for k in range(len(levels) - 1, 0, -1):
        asked = wanted.select("node", "chunk", "bits")
        if steps:
            asked = asked.unionByName(steps[0].select(F.col("src").alias("node"), "chunk", "bits"))
        asked = asked.groupBy("node", "chunk").agg(F.bit_or("bits").alias("asked"))
        here = levels[k].join(asked, ["node", "chunk"]).select(F.col("node").alias("dst"), "chunk", F.col("bits").bitwiseAND(F.col("asked")).alias("bits")).filter("bits <> 0")
        into = here.hint("shuffle_hash").join(back, "dst").select("src", "chunk", "dst", "ord", "bits").repartition(n, *by)
        own = levels[k - 1].select(F.col("node").alias("src"), "chunk", F.col("bits").alias("own")).repartition(n, *by).hint("shuffle_hash")
        step = into.join(own, by).withColumn("bits", F.col("bits").bitwiseAND(F.col("own"))).filter("bits <> 0")
        steps.insert(0, settle_by(step.select("src", "chunk", "dst", "ord", "bits"), by))
    discard(back)
    return steps


def shortest_paths(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, per_seed: bool = False, wanted: DataFrame | None = None) -> DataFrame:
    """(node, seed, depth, parent, pred, inverse, ord): the first path by breadth-first order from sorted seeds to every node.

    ``edges`` carry ``ord``, the place among a node's neighbours. The path of least seed, then least sequence of places
    is the one that a queue would find first; each level's nodes are ranked by it. ``per_seed`` gives each seed a path of its own to every node.
    With ``wanted`` (seed, node) each seed has its own paths too, but only those to wanted nodes and to what lies on them: bits
    tell which nodes of a level can lie on a shortest way, so the others get no rows.
    """
    key = ["seed", "node"] if per_seed else ["node"]
    links = settle_by(edges.select("src", "pred", "inverse", "dst", F.col("ord").cast("long").alias("ord")), "src")
    if wanted is not None:
        return _paths_to(links, seeds, wanted, max_depth)
    first = links.agg(F.min("ord"), F.max("ord")).first()
    least, width = first[0] or 0, (first[1] or 0) - (first[0] or 0) + 2
    place = F.coalesce(F.col("ord") - least + 1, F.lit(0).cast("long"))
    level = settle(_roots(seeds).withColumn("ord", F.lit(None).cast("long")))
    columns = level.columns
    levels, most = [level], 1
    frontier = level.select("seed", F.col("node").alias("src"), F.lit(0).cast("long").alias("rank"))
    if not per_seed:
        frontier, most = ordinals(level.select("seed", F.col("node").alias("src")), ["seed"], "rank"), level.count()
    while max_depth is None or len(levels) <= max_depth:
        depth = len(levels)
        if most * width >= 1 << 63:  # ranks would outgrow 64 bits: number them anew, in the same order
            frontier = ordinals(frontier, ["rank", "seed", "src"], "place").select("seed", "src", F.col("place").alias("rank"))
            most = frontier.count()
        reached = frontier.join(links, "src").withColumnRenamed("dst", "node").withColumn("rank", F.col("rank") * width + place)
        fresh = reached.join(reduce(DataFrame.unionByName, [x.select(*key) for x in levels]), key, "left_anti")
        chosen = fresh.groupBy(*key).agg(F.min(F.struct("rank", "seed", "src", "pred", "inverse", "ord")).alias("way"))
        level = settle(chosen.select(F.col("way.seed").alias("seed"), "node", F.lit(depth).cast("long").alias("depth"), F.col("way.src").alias("parent"), "way.pred", "way.inverse", "way.ord", "way.rank"))
        found, highest = level.agg(F.count(F.lit(1)), F.max("rank")).first()
        if not found:
            break
        levels.append(level.select(*columns))
        frontier, most = level.select("seed", F.col("node").alias("src"), "rank"), highest + 1
    return reduce(DataFrame.unionByName, levels)


def _paths_to(links: DataFrame, seeds: DataFrame, wanted: DataFrame, max_depth: int | None) -> DataFrame:
    """``shortest_paths`` to what is ``wanted``, over stored links.

    A way goes along steps that lie on shortest ways alone, one row for 64 seeds, not along all links of each seed's nodes. Seeds are chunks and
    bits; where nodes are numbers, all columns have a fixed length. Predicates are read at the end, for the ways that are left.
    """
    roots = _roots(seeds)
    numbers, first = _numbered(roots.select("seed", "node"))
    few = numbers.count() <= BROADCAST_SEEDS
    by_seed = F.broadcast(numbers) if few else numbers
    asked = settle(_packed(wanted.filter("node IS NOT NULL").select("seed", "node").distinct(), numbers))
    steps = _towards(links, _waves(links, first, max_depth, asked), asked)
    frontier, most, levels = roots.select("seed", "node").join(by_seed, "seed").select(F.col("node").alias("src"), "chunk", "bit", F.lit(0).cast("long").alias("rank")), 1, []
    for step in steps:
        least, highest = step.agg(F.min("ord"), F.max("ord")).first()
        least, width = least or 0, (highest or 0) - (least or 0) + 2
        if most * width >= 1 << 63:  # ranks would outgrow 64 bits: number them anew, in the same order
            frontier = ordinals(frontier, ["rank", "chunk", "bit", "src"], "place").select("src", "chunk", "bit", F.col("place").alias("rank"))
            most = frontier.count()
        reached = frontier.hint("shuffle_hash").join(step, ["src", "chunk"]).filter(F.call_function("getbit", F.col("bits"), F.col("bit")) == 1)
        rank = F.col("rank") * width + F.coalesce(F.col("ord") - least + 1, F.lit(0).cast("long"))
        level = settle(reached.withColumn("rank", rank).groupBy("chunk", "bit", F.col("dst").alias("node")).agg(F.min("rank").alias("rank"), F.min_by("src", "rank").alias("parent")))
        found, top = level.agg(F.count(F.lit(1)), F.max("rank")).first()
        if not found:
            break
        place = F.col("rank") % width
        levels.append(level.select("chunk", "bit", "node", F.lit(len(levels) + 1).cast("long").alias("depth"), "parent", F.when(place > 0, place - 1 + least).alias("ord")))
        frontier, most = level.select(F.col("node").alias("src"), "chunk", "bit", "rank"), top + 1
    if not levels:
        return roots.withColumn("ord", F.lit(None).cast("long"))
    own = wanted.select("seed", "node").join(by_seed, "seed").select("chunk", "bit", "node")
    ends = own
    for k in range(len(levels) - 1, -1, -1):
        levels[k] = settle(levels[k].join(ends, ["chunk", "bit", "node"], "left_semi"))
        ends = own.unionByName(levels[k].select("chunk", "bit", F.col("parent").alias("node")).distinct())
    ways = reduce(DataFrame.unionByName, levels)
    told = links.select(F.col("src").alias("parent"), F.col("dst").alias("node"), F.col("ord").alias("_ord"), "pred", "inverse")
    ways = ways.hint("shuffle_hash").join(told, ["parent", "node"]).filter(F.col("ord").eqNullSafe(F.col("_ord"))).join(by_seed, ["chunk", "bit"])
    ways = ways.groupBy("seed", "node").agg(F.min(F.struct("depth", "parent", "pred", "inverse", "ord")).alias("way")).select("seed", "node", "way.*")
    return roots.withColumn("ord", F.lit(None).cast("long")).unionByName(ways)


def _masks(rows: DataFrame, numbers: DataFrame, name: str) -> DataFrame:
    """(node, chunk, mask) of ``rows`` (seed, node), or (node, mask) with all bits of rows (node) that hold for all seeds."""
    if "seed" in rows.columns:
        return _packed(rows.select("seed", "node").distinct(), numbers).withColumnRenamed("bits", name)
    return rows.select("node").distinct().withColumn(name, F.lit(-1).cast("long"))


def bridge_bfs(edges: DataFrame, seeds: DataFrame, decided: DataFrame, classifier: Classifier, max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth, classification, confidence, included) of decision nodes, per seed, across bridge nodes.

    ``decided`` (seed, node; or node, for all seeds) has the decision nodes. A level's frontier is first closed over nodes without a decision,
    which are passed without being judged; the decision nodes met on the way are judged, and the included ones are the
    next frontier. A node once met is never retried. Waves hold a bit for each seed; rows of seeds are made for the judged nodes alone.
    """
    links = settle_by(edges.select("src", "dst"), "src", ["src", "dst"])
    numbers, roots = _numbered(seeds.select(F.col("node").alias("seed"), "node").distinct())
    marks = settle_by(_masks(decided, numbers, "own"), "node")
    by = [c for c in ("node", "chunk") if c in marks.columns]
    frontier = settle(roots)
    met, out, depth = frontier, None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        wave, found = frontier, None
        while True:
            near = _new_bits(_step_bits(wave, links), met).join(marks, by, "left").withColumn("own", F.coalesce("own", F.lit(0).cast("long")))
            near = settle(near.select("node", "chunk", "bits", F.col("bits").bitwiseAND(F.col("own")).alias("asked"), F.col("bits").bitwiseAND(F.bitwise_not("own")).alias("passed")))
            if is_empty(near):
                break
            met = met.unionByName(near.select("node", "chunk", "bits"))
            asked = near.select("node", "chunk", F.col("asked").alias("bits")).filter("bits <> 0")
            found = asked if found is None else found.unionByName(asked)
            wave = near.select("node", "chunk", F.col("passed").alias("bits")).filter("bits <> 0")
        if found is None:
            break
        judged = classifier(_spread(found, numbers).select("seed", "node").withColumn("depth", F.lit(depth).cast("long")))
        level = settle(judged.select("seed", "node", "depth", "classification", "confidence", (F.col("classification") == INCLUDE).alias("included")))
        out = level if out is None else out.unionByName(level)
        frontier = settle(_packed(level.filter("included"), numbers))
        if is_empty(frontier):
            break
    if out is None:
        empty = seeds.limit(0).select(F.col("node").alias("seed"), "node")
        return empty.select("seed", "node", F.lit(0).cast("long").alias("depth"), F.lit(NO_MATCH).alias("classification"), F.lit(0.0).alias("confidence"), F.lit(False).alias("included"))
    return out


def two_phase_bfs(edges: DataFrame, seeds: DataFrame, first: DataFrame, later: DataFrame, decided: DataFrame, gates: DataFrame | None = None, allowed: DataFrame | None = None, bridges: bool = True) -> DataFrame:
    """(seed, node, depth) of decision nodes over logical edges (src, pred, dst), hops counted with bridge nodes; ``decided`` as in ``bridge_bfs``.

    ``first`` and ``later`` (predicate) are the properties of the first and of later hops. ``gates`` (seed, node, target; or node, target, for all seeds):
    only nodes with target 1 are expanded among the decision nodes. ``allowed`` (node) restricts what may be entered;
    without ``bridges`` only decision nodes may.
    """
    links = edges.select("src", "pred", "dst")
    if allowed is not None:
        links = links.join(allowed.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    numbers, roots = _numbered(seeds.select(F.col("node").alias("seed"), "node").distinct())
    zero = F.lit(0).cast("long")
    marks = _masks(decided, numbers, "own")
    if gates is not None:
        open_ = _masks(gates.filter("target = 1"), numbers, "open")
        if "chunk" in open_.columns and "chunk" not in marks.columns:
            marks = marks.join(numbers.select("chunk").distinct(), how="cross")
        marks = marks.join(open_, [c for c in ("node", "chunk") if c in marks.columns and c in open_.columns], "left")
    else:
        marks = marks.withColumn("open", F.lit(-1).cast("long"))
    marks = settle_by(marks, "node")
    by = [c for c in ("node", "chunk") if c in marks.columns]
    links = settle_by(links, "src")
    level = settle(roots.select("node", "chunk", "bits", zero.alias("own"), F.col("bits").alias("expands"), zero.alias("depth")))
    visited, depth = level, 0
    while True:
        depth += 1
        hop = links.join(F.broadcast((first if depth == 1 else later).select(F.col("predicate").alias("pred")).distinct()), "pred", "left_semi")
        wave = level.select("node", "chunk", F.col("expands").alias("bits")).filter("bits <> 0")
        near = _new_bits(_step_bits(wave, hop), visited).join(marks, by, "left")
        own = F.col("bits").bitwiseAND(F.coalesce("own", zero))
        near = near.select("node", "chunk", "bits" if bridges else own.alias("bits"), own.alias("own"), F.col("bits").bitwiseAND(F.bitwise_not(own)).alias("between"), own.bitwiseAND(F.coalesce("open", zero)).alias("open"))
        near = near.filter("bits <> 0").select("node", "chunk", "bits", "own", (F.col("open").bitwiseOR(F.col("between")) if bridges else F.col("open")).alias("expands"), F.lit(depth).cast("long").alias("depth"))
        level = settle(near)
        if is_empty(level):
            break
        visited = visited.unionByName(level)
    return _spread(visited.filter("own <> 0").select("node", "depth", "chunk", F.col("own").alias("bits")), numbers).select("seed", "node", "depth")


def ancestor_gating(rows: DataFrame) -> DataFrame:
    """Replay of recorded verdicts: ``rows`` (seed, node, parent, raw) with ``effective`` and ``reason``.

    A row counts as it was judged if its parent's effective verdict is 1 (a blank parent is the seed); below a 0 it is
    PRUNED_BY_ANCESTOR, without a verdict NO_MATCH, and with a parent that never resolves NO_PARENT.
    """
    verdict = F.coalesce(F.col("raw"), F.lit(0))
    own = F.when(F.col("raw").isNull(), "NO_MATCH").otherwise("JUDGED")
    top = (F.coalesce(F.col("parent"), F.lit("")) == "") | (F.col("parent") == F.col("seed"))
    columns = rows.columns
    level = settle(rows.filter(top).select(*columns, verdict.cast("int").alias("effective"), own.alias("reason")))
    done, rest = level, settle(rows.filter(~top))
    while not is_empty(level):
        parents = level.groupBy("seed", F.col("node").alias("parent")).agg(F.max("effective").alias("above"))
        joined = rest.join(parents, ["seed", "parent"], "left")
        ready = joined.filter("above IS NOT NULL")
        level = settle(ready.select(*columns, F.when(F.col("above") == 0, 0).otherwise(verdict).cast("int").alias("effective"), F.when(F.col("above") == 0, "PRUNED_BY_ANCESTOR").otherwise(own).alias("reason")))
        if is_empty(level):
            break
        done = done.unionByName(level)
        rest = settle(joined.filter("above IS NULL").select(*columns))
    return done.unionByName(rest.select(*columns, F.lit(0).cast("int").alias("effective"), F.lit("NO_PARENT").alias("reason")))


def embedding_sequences(paths: DataFrame, vectors: DataFrame) -> DataFrame:
    """(key, sequence): the vectors of a path's nodes in order; paths with a node that has none are dropped."""
    steps = paths.select("key", F.size("nodes").alias("length"), F.posexplode("nodes").alias("pos", "node"))
    found = steps.join(vectors.select("node", "vector"), "node")
    rows = found.groupBy("key", "length").agg(F.sort_array(F.collect_list(F.struct("pos", "vector"))).alias("x"))
    return rows.filter(F.size("x") == F.col("length")).select("key", F.transform("x", lambda s: s["vector"]).alias("sequence"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one but not of the other (with multiplicity), marked left or right: an audit passes if there are none."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def replay_audit(live: DataFrame, again: DataFrame, gold: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(check, depth, node, live, replay): how two traversals (node, depth, included) differ; they agree if there are no rows.

    Checked are each level's nodes (``layer``), the verdicts of nodes that both have (``included``), and precision, recall, F1 and accuracy
    against ``gold`` (node) up to ``tolerance`` (``metric precision``, …).
    """
    from .metrics import METRICS, set_metrics

    a, b = (x.select("node", F.col("depth").alias(f"{n}_depth"), F.col("included").alias(f"{n}_in")) for x, n in ((live, "l"), (again, "r")))
    both = a.join(b, "node", "full_outer")
    text = lambda c: F.col(c).cast("string")
    layer = both.filter("NOT l_depth <=> r_depth").select(F.lit("layer").alias("check"), F.coalesce("l_depth", "r_depth").cast("long").alias("depth"), "node", text("l_depth").alias("live"), text("r_depth").alias("replay"))
    verdict = both.filter("l_depth IS NOT NULL AND r_depth IS NOT NULL AND NOT l_in <=> r_in").select(F.lit("included").alias("check"), F.col("l_depth").cast("long").alias("depth"), "node", text("l_in").alias("live"), text("r_in").alias("replay"))
    of = lambda x, n: set_metrics(x.filter("included"), gold, x.filter("NOT included")).select(*[F.col(m).alias(f"{n}_{m}") for m in METRICS])
    pair = of(live, "l").join(of(again, "r"), how="cross")  # one row each
    apart = F.filter(F.array(*[F.struct(F.lit(f"metric {m}").alias("check"), F.col(f"l_{m}").alias("live"), F.col(f"r_{m}").alias("replay")) for m in METRICS]), lambda x: F.abs(x["live"] - x["replay"]) > tolerance)
    scores = pair.select(F.explode(apart).alias("x")).select("x.check", F.lit(None).cast("long").alias("depth"), F.lit(None).cast("string").alias("node"), F.col("x.live").cast("string").alias("live"), F.col("x.replay").cast("string").alias("replay"))
    return layer.unionByName(verdict).unionByName(scores)
