"""Triples from text files.

``read_ntriples`` and ``read_restricted_turtle`` are line scans with built-in functions, split like any text table.
``read_turtle`` takes documents that use more of the language: files are split at lines as any text, each split's statements are parsed by its
task, and what lies over the ends of splits is put together and parsed afterwards. ``rdfxml`` reads RDF/XML.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.functions.text import label_unescape
from arborix.operators.fixpoint import settle

TRIPLES = "s string, p string, o string, o_kind string, o_lang string, o_datatype string"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"


def ntriples_unescape(c: Column) -> Column:
    """A literal's escapes decoded by built-in functions: those of JSON, the apostrophe's, and eight-digit code points."""
    code = lambda x: F.conv(x, 16, 10).cast("int")
    unit = lambda v: F.concat(F.lit("\\u"), F.lpad(F.hex(v), 4, "0"))
    pair = lambda v: F.concat(unit(F.lit(0xD800) + F.shiftright(v - 0x10000, 10)), unit(F.lit(0xDC00) + (v - 0x10000).bitwiseAND(0x3FF)))
    long = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\\U([0-9A-Fa-f]{8})"), F.lit(1)))
    short = F.aggregate(long, c, lambda text, x: F.replace(text, F.concat(F.lit("\\U"), x), F.when(code(x) < 0x10000, unit(code(x))).otherwise(pair(code(x)))))
    plain = F.regexp_replace(short, r"(?<!\\)((?:\\\\)*)\\'", "$1'")
    return F.when(c.contains("\\"), F.get_json_object(F.concat(F.lit('{"v":"'), plain, F.lit('"}')), "$.v")).otherwise(c)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples lines as TRIPLES; comments and blank lines are skipped, and reading a line that is no triple is an error."""
    line = F.trim("value")
    pattern = r'^(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$'
    part = lambda i: F.nullif(F.regexp_extract(line, pattern, i), F.lit(""))
    rows = spark.read.text(path).filter((line != "") & ~line.startswith("#")).filter(F.when(line.rlike(pattern), True).otherwise(F.raise_error(F.concat(F.lit("no triple: "), line)).cast("boolean")))
    iri = part(3)
    return rows.select(
        F.regexp_replace(part(1), "^<|>$", "").alias("s"),
        part(2).alias("p"),
        F.coalesce(iri, part(4), ntriples_unescape(F.regexp_extract(line, pattern, 5))).alias("o"),
        F.when(iri.isNotNull(), "iri").when(part(4).isNotNull(), "bnode").otherwise("literal").alias("o_kind"),
        part(6).alias("o_lang"),
        part(7).alias("o_datatype"),
    )


def read_restricted_turtle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges (s, p, o, line), labels (node, label)) of lines ``wd:Q wdt:P wd:Q .`` and ``wd:Q rdfs:label "…"@en .``"""
    rows = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    edge = r"^\s*wd:(\S+)\s+wdt:(\S+)\s+wd:(\S+)\s*\.\s*$"
    label = r'^\s*wd:(\S+)\s+rdfs:label\s+"((?:[^"\\]|\\.)*)"@en\s*\.\s*$'
    pick = lambda p, i: F.regexp_extract("value", p, i)
    edges = rows.filter(F.col("value").rlike(edge)).select(pick(edge, 1).alias("s"), pick(edge, 2).alias("p"), pick(edge, 3).alias("o"), "line")
    labels = rows.filter(F.col("value").rlike(label)).select(pick(label, 1).alias("node"), label_unescape(pick(label, 2)).alias("label"))
    return edges, labels


_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<iri><[^>]*>)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z][A-Za-z0-9-]*)|(?P<type>\^\^)|(?P<mark>[.;,\[\]()])(?=\s|$|[\]\)\[\(<"'#;,.])|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?=[\s.;,)\]])|(?P<name>(?:[^\s<>"';,()\[\]#.]|\.(?=[^\s.;,)\]]))+)""", re.S)
_XSD = "http://www.w3.org/2001/XMLSchema#"
_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_TYPE = _RDF + "type"


def turtle_unescape(text: str) -> str:
    short = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}

    def one(m: re.Match) -> str:
        return chr(int(m[1] or m[2], 16)) if m[1] or m[2] else short.get(m[3], m[3])

    return re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\(.)", one, text, flags=re.S)


def parse_turtle(text: str, prefixes: dict[str, str] | None = None, base: str = "", names: str = "b") -> list[tuple]:
    """TRIPLES rows of a Turtle document: prefixes, bases, lists of predicates and objects, nested blank nodes, collections.

    ``prefixes`` and ``base`` hold at its begin; ``names`` begins the names of blank nodes without one.
    """
    tokens = [(m.lastgroup, m[0]) for m in _TOKEN.finditer(text) if m.lastgroup]
    prefixes = dict(prefixes or {})
    rows: list[tuple] = []
    at, blanks = 0, 0

    def blank() -> str:
        nonlocal blanks
        blanks += 1
        return f"_:{names}{blanks}"

    def iri(kind: str, value: str) -> tuple[str, str]:
        if kind == "iri":
            value = turtle_unescape(value[1:-1])
            return (value if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value) else base + value), "iri"
        if value == "a":
            return _TYPE, "iri"
        if value.startswith("_:"):
            return value, "bnode"
        prefix, colon, rest = value.partition(":")
        if not colon or prefix not in prefixes:
            raise ValueError(f"unknown prefix in {value!r}")
        return prefixes[prefix] + rest, "iri"

    def term() -> tuple:
        nonlocal at, blanks
        kind, value = tokens[at]
        at += 1
        if kind in ("text", "long"):
            literal, lang, datatype = turtle_unescape(value[3:-3] if kind == "long" else value[1:-1]), None, None
            if at < len(tokens) and tokens[at][0] == "lang":
                lang = tokens[at][1][1:].lower()
                at += 1
            elif at < len(tokens) and tokens[at][0] == "type":
                datatype = iri(*tokens[at + 1])[0]
                at += 2
            return literal, "literal", lang, datatype
        if kind == "number":
            return value, "literal", None, _XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer")
        if value in ("true", "false"):
            return value, "literal", None, _XSD + "boolean"
        if value == "[":
            node = blank()
            if tokens[at][1] == "]":
                at += 1
            else:
                predicates(node)
                at += 1
            return node, "bnode", None, None
        if value == "(":
            cells, members = [], []
            while tokens[at][1] != ")":
                members.append(term())
                cells.append(blank())
            at += 1
            for i, (cell, member) in enumerate(zip(cells, members, strict=True)):
                rest = (cells[i + 1], "bnode") if i + 1 < len(cells) else (_RDF + "nil", "iri")
                rows.extend([(cell, _RDF + "first", *member), (cell, _RDF + "rest", *rest, None, None)])
            return (cells[0], "bnode", None, None) if cells else (_RDF + "nil", "iri", None, None)
        return (*iri(kind, value), None, None)

    def predicates(subject: str) -> None:
        nonlocal at
        while True:
            predicate = iri(*tokens[at])[0]
            at += 1
            while True:
                rows.append((subject, predicate, *term()))
                if at < len(tokens) and tokens[at][1] == ",":
                    at += 1
                    continue
                break
            while at < len(tokens) and tokens[at][1] == ";":
                at += 1
            if at >= len(tokens) or tokens[at][1] in (".", "]"):
                return

    while at < len(tokens):
        kind, value = tokens[at]
        if value.lower() in ("@prefix", "prefix", "@base", "base"):
            if value.lower().endswith("prefix"):
                prefixes[tokens[at + 1][1].rstrip(":")] = tokens[at + 2][1][1:-1]
                at += 3
            else:
                base = tokens[at + 1][1][1:-1]
                at += 2
            if at < len(tokens) and tokens[at][1] == ".":
                at += 1
            continue
        subject = term()[0]
        if tokens[at][1] != ".":
            predicates(subject)
        if at >= len(tokens) or tokens[at][1] != ".":
            raise ValueError("a statement has no end")
        at += 1
    return rows


_CLOSING = {'"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""', re.S), "'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*'''", re.S)}


def statement_ends(text: str, inside: str = "") -> tuple[list[int], list[tuple[str, str]], str]:
    """Where statements of whole lines of Turtle end, the prefixes ("@" for bases) that they declare, and the quotes of a long string that goes on.

    ``inside``: the quotes of the long string in which the lines begin.
    """
    at, ends, declared, words = 0, [], [], []
    if inside:
        m = _CLOSING[inside].match(text)
        if not m:
            return [], [], inside
        at = m.end()
    while at < len(text):
        m = _TOKEN.match(text, at)
        quotes = text[at : at + 3]
        if quotes in _CLOSING and not (m and m.lastgroup == "long"):
            return ends, declared, quotes
        if not m:
            at += 1
            continue
        at = m.end()
        if not m.lastgroup:
            continue
        words = [*words[-2:], m[0]]
        key = words[0].lower().lstrip("@") if len(words) > 1 else ""
        given = m.lastgroup == "iri" and ((words[1].rstrip(":"), 3) if len(words) == 3 and key == "prefix" else ("@", 2) if len(words) > 1 and words[-2].lower().lstrip("@") == "base" else None)
        if given:
            declared.append((given[0], m[0][1:-1]))
        if m[0] == "." or given and not words[-given[1]].startswith("@"):  # PREFIX and BASE have no dot
            ends.append(at)
            words = []
    return ends, declared, ""


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """TRIPLES of Turtle files of any size, parsed by splits.

    A first job tells for each split how its lines end if they begin in a statement or inside of a long string, and what
    prefixes they declare; so every split's begin is known (a row a split meets on the driver). Then each split's whole statements are parsed where
    they are, and the pieces at its ends are joined to those of its neighbours.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, str]]:
        now, have = None, []
        for batch in batches:
            for key, part in batch.groupby(["file", "block"], sort=False):
                if key != now and have:
                    yield *now, "\n".join(have) + "\n"
                    have = []
                now = key
                have += part["value"].tolist()
        if have:
            yield *now, "\n".join(have) + "\n"

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for file, block, text in blocks(batches):
            out = []
            for inside in ("", *_CLOSING):
                ends, declared, left = statement_ends(text, inside)
                out.append((file, block, inside, bool(ends), json.dumps(declared), left))
            yield pd.DataFrame(out, columns=["file", "block", "inside", "ends", "declared", "left"])

    seen: dict = {}
    for r in lines.mapInPandas(look, "file string, block long, inside string, ends boolean, declared string, left string").collect():  # three rows a split
        seen.setdefault((r["file"], r["block"]), {})[r["inside"]] = r
    begins, file, inside, known, owner = {}, None, "", {}, None
    for n, (key, ways) in enumerate(sorted(seen.items())):
        if key[0] != file:
            file, inside, known, owner = key[0], "", {}, n
        begins[key] = (n, inside, dict(known), owner)
        known |= dict(json.loads(ways[inside]["declared"]))
        owner = n if ways[inside]["ends"] else owner
        inside = ways[inside]["left"]
    told = spark.sparkContext.broadcast(begins)
    names = [x.split()[0] for x in TRIPLES.split(", ")]

    def statements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for file, block, text in blocks(batches):
            n, inside, known, owner = told.value[file, block]
            ends, declared, _ = statement_ends(text, inside)
            first, last = (ends[0], ends[-1]) if ends and n != owner else (0, ends[-1]) if ends else (len(text), len(text))
            prefixes = {k: v for k, v in known.items() if k != "@"}
            head = text[:first]
            if first and declared and ends and n != owner:  # what the head itself declares holds for the rest
                prefixes |= {k: v for k, v in statement_ends(head, inside)[1] if k != "@"}
            base = dict(statement_ends(head, inside)[1]).get("@", known.get("@", "")) if first else known.get("@", "")
            rows = parse_turtle(text[first:last], prefixes, base, f"s{n}b")
            out = pd.DataFrame(rows, columns=names, dtype=object).assign(statement=-1, place=n, piece=None, known=None)
            pieces = [(owner, head)] * (first > 0) + [(n if ends else owner, text[last:])] * (last < len(text))
            later = {**known, **dict(declared)}
            ends_of = pd.DataFrame([(None,) * len(names) + (s, n, p, json.dumps(known if i == 0 and first > 0 else later)) for i, (s, p) in enumerate(pieces)], columns=[*names, "statement", "place", "piece", "known"], dtype=object)
            yield pd.concat([out, ends_of]) if len(ends_of) else out

    parsed = settle(lines.mapInPandas(statements, TRIPLES + ", statement int, place int, piece string, known string"))
    pieces = parsed.filter("piece IS NOT NULL").groupBy("statement").agg(F.sort_array(F.collect_list(F.struct("place", "piece", "known"))).alias("x"))  # of one statement
    joined = pieces.select("statement", F.array_join(F.transform("x", lambda p: p["piece"]), "").alias("text"), F.element_at("x", 1)["known"].alias("known"))

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, text, known in zip(batch["statement"], batch["text"], batch["known"], strict=True):
                prefixes = json.loads(known)
                base = prefixes.pop("@", "")
                yield pd.DataFrame(parse_turtle(text, prefixes, base, f"e{n}b"), columns=names, dtype=object)

    return parsed.filter("statement = -1").select(*names).unionByName(joined.mapInPandas(rest, TRIPLES))
