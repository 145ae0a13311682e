"""Labels, edges and graph profiles over triples (s, p, o, o_kind, o_lang)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborix.functions.text import casefold, local_name

from .fixpoint import bucket_count, ordinals

_RDFS, _SKOS, _DCT = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2004/02/skos/core#", "http://purl.org/dc/terms/"
#: Predicates whose literals name a node, the preferred first.
PREFERRED, ALTERNATIVE = (_SKOS + "prefLabel", _RDFS + "label"), (_SKOS + "altLabel", _SKOS + "hiddenLabel")
#: SKOS relations between concepts.
SKOS_RELATIONS = (_SKOS + "broader", _SKOS + "narrower", _SKOS + "related")
#: Predicates that annotate and are never traversed.
ANNOTATIONS = (
    *(_SKOS + x for x in ("prefLabel", "altLabel", "hiddenLabel", "notation", "definition", "scopeNote", "historyNote", "changeNote", "editorialNote", "note")),
    *(_RDFS + x for x in ("label", "comment")),
    *(_DCT + x for x in ("title", "description", "created", "modified", "source")),
)
#: Schemes of a thesaurus whose concepts may have some relations that aren't SKOS, and those relations.
THESAURUS_SCHEMES = ("https://lod.nal.usda.gov/nalt", "https://lod.nal.usda.gov/nalt-core", "https://lod.nal.usda.gov/nalt-taxon")
THESAURUS_RELATIONS = ("https://lod.nal.usda.gov/naltv#taxonomicRank", "https://lod.nal.usda.gov/naltv#hasProduct", "https://lod.nal.usda.gov/naltv#productOf")


def literal_candidates(triples: DataFrame, predicates: tuple[str, ...], language: str = "en") -> DataFrame:
    """(node, p, label, rank, n): literals of the predicates that count, in order.

    Of a node's and predicate's literals those in ``language`` or without a language count (rank 0 and 1); others only
    where there are none (rank 2). Ties go by casefold, then by the text itself.
    """
    rows = triples.filter(F.col("p").isin(*predicates) & (F.col("o_kind") == "literal") & (F.trim("o") != ""))
    rank = F.when(F.lower("o_lang") == language, 0).when(F.col("o_lang").isNull() | (F.col("o_lang") == ""), 1).otherwise(2)
    group = Window.partitionBy("s", "p")
    rows = rows.select("s", "p", "o", rank.alias("rank")).withColumn("best", F.min("rank").over(group)).filter("rank < 2 OR best = 2")
    return rows.select(F.col("s").alias("node"), "p", F.col("o").alias("label"), "rank", F.row_number().over(group.orderBy("rank", casefold(F.col("o")), "o")).alias("n"))


def preferred_labels(triples: DataFrame, language: str = "en") -> DataFrame:
    """(node, label, alternatives): the first preferred label; a node with only alternatives has the first promoted."""
    order = {p: i for i, p in enumerate((*PREFERRED, *ALTERNATIVE))}
    rows = literal_candidates(triples, (*PREFERRED, *ALTERNATIVE), language)
    place = F.lit(len(order))
    for p, i in order.items():
        place = F.when(F.col("p") == p, i).otherwise(place)
    rows = rows.withColumn("place", place).withColumn("first", F.row_number().over(Window.partitionBy("node").orderBy("place", "n")))
    rows = rows.withColumn("cf", casefold(F.col("label")))
    chosen = rows.filter("first = 1").select("node", "label", F.col("cf").alias("chosen_cf"))
    others = rows.filter(F.col("p").isin(*ALTERNATIVE)).join(chosen.select("node", "chosen_cf"), "node").filter("cf <> chosen_cf")
    others = others.groupBy("node", "cf").agg(F.min(F.struct("place", "n", F.col("label").alias("alt"))).alias("x"))
    alternatives = others.groupBy("node").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["alt"]).alias("alternatives"))
    return chosen.drop("chosen_cf").join(alternatives, "node", "left").withColumn("alternatives", F.coalesce("alternatives", F.array().cast("array<string>")))


def structural_edges(triples: DataFrame, labels: DataFrame, annotations: tuple[str, ...] = ANNOTATIONS) -> DataFrame:
    """(src, pred, dst) of triples between labelled nodes by predicates that aren't annotations."""
    named = labels.select("node").distinct()
    rows = triples.filter((F.col("o_kind") == "iri") & ~F.col("p").isin(*annotations)).select(F.col("s").alias("src"), F.col("p").alias("pred"), F.col("o").alias("dst"))
    return rows.join(named.withColumnRenamed("node", "src"), "src", "left_semi").join(named.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "pred", "dst").distinct()


def directed(edges: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """(src, pred, inverse, dst): every edge both ways, or only the (predicate, inverse) pairs of ``relations``."""
    both = edges.select("src", "pred", F.lit(False).alias("inverse"), "dst").unionByName(edges.select(F.col("dst").alias("src"), "pred", F.lit(True).alias("inverse"), F.col("src").alias("dst")))
    if relations is None:
        return both
    return both.join(relations.select(F.col("predicate").alias("pred"), "inverse").distinct(), ["pred", "inverse"], "left_semi").select("src", "pred", "inverse", "dst")


def adjacency(edges: DataFrame, labels: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """``directed`` edges with ``ord``: a node's neighbours by casefolded label, IRI, predicate and direction."""
    rows = directed(edges, relations).join(labels.select(F.col("node").alias("dst"), F.col("label").alias("dst_label")), "dst", "left")
    order = Window.partitionBy("src").orderBy(casefold(F.col("dst_label")), "dst", "pred", "inverse")
    return rows.select("src", "pred", "inverse", "dst", F.row_number().over(order).cast("long").alias("ord"))


def numbered_adjacency(edges: DataFrame, labels: DataFrame, name: Callable[[Column], Column]) -> DataFrame:
    """``adjacency`` of nodes that are numbers, ``name`` making their names; rows may repeat an edge.

    Labels are folded and ordered once a node, not once an edge, and edges are shuffled without any text but their predicate.
    """
    known = labels.filter("label IS NOT NULL").select("node", casefold(F.col("label")).alias("cf"), name(F.col("node")).alias("name"))
    places = ordinals(known, ["cf", "name"], "place").select(F.col("node").alias("dst"), "place")
    rows = directed(edges).join(places, "dst", "left").repartition(bucket_count(edges.sparkSession), "src")
    order = Window.partitionBy("src").orderBy("place", F.when(F.col("place").isNull(), name(F.col("dst"))), "pred", "inverse")
    return rows.select("src", "pred", "inverse", "dst", F.row_number().over(order).cast("long").alias("ord"))


def relation_specs(edges: DataFrame) -> DataFrame:
    """(predicate, inverse): each predicate in use, both ways."""
    return edges.select(F.col("pred").alias("predicate")).distinct().select("predicate", F.explode(F.array(F.lit(False), F.lit(True))).alias("inverse"))


def name_index(names: DataFrame, name: Column) -> DataFrame:
    """(cf, nodes, n): nodes (sorted) by the casefold of a name."""
    return names.select("node", casefold(name).alias("cf")).filter("cf <> ''").groupBy("cf").agg(F.sort_array(F.collect_set("node")).alias("nodes")).withColumn("n", F.size("nodes").cast("long"))


def resolve(references: DataFrame, labels: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(reference, node, problem): IRIs, then prefixed names, then unique local names, then unique labels.

    A problem is "unknown" or "ambiguous: " and up to five nodes.
    """
    ref = F.trim("reference")
    bare = F.regexp_replace(ref, "^<|>$", "")
    expanded = bare
    for prefix, iri in (prefixes or {}).items():
        expanded = F.when(bare.startswith(prefix + ":"), F.concat(F.lit(iri), F.substring_index(bare, ":", -1))).otherwise(expanded)
    asked = references.select("reference", expanded.alias("iri"), casefold(ref).alias("cf")).distinct()
    known = labels.select(F.col("node").alias("iri"), F.col("node").alias("by_iri"))
    by_local = name_index(labels, local_name(F.col("node"))).select("cf", F.col("nodes").alias("locals"))
    by_label = name_index(labels, F.col("label")).select("cf", F.col("nodes").alias("labelled"))
    rows = asked.join(known, "iri", "left").join(by_local, "cf", "left").join(by_label, "cf", "left")
    only = lambda c: F.when(F.size(c) == 1, F.element_at(c, 1))
    many = F.when(F.size("locals") > 1, F.col("locals")).when(F.col("locals").isNull() & (F.size("labelled") > 1), F.col("labelled"))
    node = F.coalesce("by_iri", F.when(F.size("locals") > 1, F.lit(None)).otherwise(F.coalesce(only("locals"), only("labelled"))))
    problem = F.when(node.isNull(), F.coalesce(F.concat(F.lit("ambiguous: "), F.array_join(F.slice(many, 1, 5), ", ")), F.lit("unknown")))
    return rows.select("reference", node.alias("node"), problem.alias("problem"))


def profile(triples: DataFrame, concept_class: str = _SKOS + "Concept") -> DataFrame:
    """One row: labelled nodes, concepts, their share, SKOS and foreign concept edges, thesaurus, and "skos" or "general".

    A graph is "skos" if at least 95 % of the labelled nodes are concepts, some SKOS relation joins concepts, and no
    predicate outside of SKOS does; in the known thesaurus (by its schemes) its own relations may.
    """
    kind = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    own = triples.select("s", "p", "o", "o_kind").distinct()
    concepts = own.filter((F.col("p") == kind) & (F.col("o") == concept_class)).select("s").distinct()
    named = own.filter(F.col("p").isin(*PREFERRED, *ALTERNATIVE) & (F.col("o_kind") == "literal") & (F.trim("o") != "")).select("s").distinct()
    marked = named.join(concepts.withColumn("concept", F.lit(1)), "s", "left")
    counts = marked.agg(F.count(F.lit(1)).alias("labelled"), F.count("concept").alias("concepts"))
    links = own.filter((F.col("o_kind") == "iri") & (F.col("p") != kind)).join(concepts, "s", "left_semi").join(concepts.withColumnRenamed("s", "o"), "o", "left_semi")
    foreign = ~F.col("p").startswith(_SKOS)
    edges = links.agg(F.count_if(F.col("p").isin(*SKOS_RELATIONS)).alias("skos_edges"), F.count_if(foreign).alias("other_edges"), F.count_if(foreign & ~F.col("p").isin(*THESAURUS_RELATIONS)).alias("unknown_edges"))
    schemes = own.agg((F.count_if((F.col("p") == _SKOS + "inScheme") & F.col("o").isin(*THESAURUS_SCHEMES)) > 0).alias("thesaurus"))
    share = F.when(F.col("labelled") > 0, F.col("concepts") / F.col("labelled")).otherwise(0.0)
    every = counts.join(F.broadcast(edges), how="cross").join(F.broadcast(schemes), how="cross").withColumn("share", share)  # one row each
    allowed = (F.col("other_edges") == 0) | (F.col("thesaurus") & (F.col("unknown_edges") == 0))
    return every.withColumn("graph_type", F.when((F.col("share") >= 0.95) & (F.col("skos_edges") > 0) & allowed, "skos").otherwise("general"))


def display(label: Column, alternatives: Column) -> Column:
    return F.when(F.size(alternatives) > 0, F.concat(label, F.lit(" ("), F.array_join(alternatives, ", "), F.lit(")"))).otherwise(label)


def relation_pairs(edges: DataFrame) -> DataFrame:
    """(src, dst, relations): undirected neighbours with the sorted set of relation names between them."""
    return directed(edges).groupBy("src", "dst").agg(F.sort_array(F.collect_set("pred")).alias("relations"))


def logical_edges(edges: DataFrame) -> DataFrame:
    """(src, pred, dst) with inverse edges under ``(-)`` names."""
    return edges.select("src", "pred", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.concat(F.lit("(-)"), "pred").alias("pred"), F.col("src").alias("dst")))


def canonical(logical: DataFrame) -> DataFrame:
    """Logical edges in their source orientation, distinct."""
    back = F.col("pred").startswith("(-)")
    return logical.select(F.when(back, F.col("dst")).otherwise(F.col("src")).alias("src"), F.regexp_replace("pred", r"^\(-\)", "").alias("pred"), F.when(back, F.col("src")).otherwise(F.col("dst")).alias("dst")).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    own = nodes.select("node").distinct()
    return edges.join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "pred", "dst").distinct()


def per_seed_subgraphs(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(seed, src, pred, dst) of edges inside each seed's nodes (members: seed, node, depth; the seed itself depth 0).

    Where all depths of a seed are known, only edges between neighbouring depths stay.
    """
    every = members.groupBy("seed").agg(F.min(F.col("depth").isNotNull()).alias("all_known"))  # a window would hold a seed's nodes in one task
    known = members.join(every, "seed")
    a = known.select("seed", F.col("node").alias("src"), F.col("depth").alias("da"), "all_known")
    b = known.select(F.col("seed").alias("seed_b"), F.col("node").alias("dst"), F.col("depth").alias("db"))
    rows = edges.join(a, "src").join(b, "dst").filter("seed = seed_b AND (NOT all_known OR abs(da - db) = 1)")
    return rows.select("seed", "src", "pred", "dst").distinct()


def bridge_candidates(unreached: DataFrame, edges: DataFrame, expected: DataFrame) -> DataFrame:
    """(node, pred, inverse, bridge): neighbours of unreached nodes outside the expected ones; a null row if none."""
    outside = directed(edges).join(expected.select(F.col("node").alias("dst")).distinct(), "dst", "left_anti")
    return unreached.select("node").distinct().join(outside.select(F.col("src").alias("node"), "pred", "inverse", F.col("dst").alias("bridge")), "node", "left").select("node", "pred", "inverse", "bridge")


def degrees(edges: DataFrame, predicates: tuple[str, ...]) -> DataFrame:
    """(node, degree): distinct neighbours by predicate and direction, summed."""
    rows = directed(edges.filter(F.col("pred").isin(*predicates)))
    return rows.groupBy("src", "pred", "inverse").agg(F.count_distinct("dst").alias("n")).groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("degree"))


def targets(edges: DataFrame, relations: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(node, target): distinct neighbours through a property list, within ``allowed`` ids if given."""
    rows = directed(edges, relations).select(F.col("src").alias("node"), F.col("dst").alias("target")).distinct()
    return rows if allowed is None else rows.join(allowed.select(F.col("node").alias("target")).distinct(), "target", "left_semi").select("node", "target")


def traversal_subgraph(visited: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, pred, dst) of the steps that reached included nodes, in source orientation; each must be an edge."""
    steps = visited.filter("included AND depth > 0")  # what leads to an included node's parent is a step to an included node too
    own = steps.select(F.when(F.col("inverse"), F.col("node")).otherwise(F.col("parent")).alias("src"), "pred", F.when(F.col("inverse"), F.col("parent")).otherwise(F.col("node")).alias("dst")).distinct()
    checked = own.join(edges.select("src", "pred", "dst", F.lit(True).alias("known")).distinct(), ["src", "pred", "dst"], "left")
    return checked.filter(F.when(F.col("known"), True).otherwise(F.raise_error(F.lit("a step is not an edge of the source")).cast("boolean"))).select("src", "pred", "dst")


def fallback_labels(labels: DataFrame, languages: tuple[str, ...] = ("en", "fr")) -> DataFrame:
    """(node, label) of (node, lang, label): the first language that a node has, commas and semicolons as spaces; else empty."""
    one = [F.min(F.when(F.col("lang") == x, F.col("label"))).alias(x) for x in languages]
    return labels.groupBy("node").agg(*one).select("node", F.translate(F.coalesce(*languages, F.lit("")), ",;", "  ").alias("label"))


def unseen_neighbours(edges: DataFrame, nodes: DataFrame, predicate: str, seen: DataFrame) -> DataFrame:
    """(node): sources of ``predicate`` edges into the nodes, without those seen."""
    rows = edges.filter(F.col("pred") == predicate).join(nodes.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
    return rows.join(seen.select("node").distinct(), "node", "left_anti")
