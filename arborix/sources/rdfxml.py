"""RDF/XML as a Spark data source: a file is a partition, parsed by events in bounded chunks.

Node elements (described, typed, nested), property elements with resources, literals, datatypes, ``parseType`` Resource, Collection
and Literal, property attributes, ``rdf:li``, reified statements, ``xml:base`` and ``xml:lang``. Text or elements where the
grammar has none, and documents that aren't well-formed, are errors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urldefrag, urljoin
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .arrays import BLOCK, Run, files_of, opened

RDF, XML = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/XML/1998/namespace"
COLUMNS = ("s", "p", "o", "o_kind", "o_lang", "o_datatype")
#: Attributes that say something about the syntax, and names that can't be nodes or properties.
SYNTAX = {RDF + x for x in ("about", "ID", "nodeID", "resource", "datatype", "parseType", "li", "aboutEach", "aboutEachPrefix", "bagID", "RDF", "Description")}
OLD = {RDF + x for x in ("aboutEach", "aboutEachPrefix", "bagID")}


@dataclass
class Frame:
    """An open element: what its children and its text are."""

    kind: str  # root, node, property, collection, literal
    base: str
    lang: str | None
    subject: str = ""
    predicate: str = ""
    datatype: str | None = None
    statement: str | None = None
    text: str = ""
    items: int = 0
    object: tuple | None = None
    members: list | None = None
    depth: int = 0


class Events:
    """Triples of a document from its events; ``rows`` is taken out as it fills."""

    def __init__(self, base: str, blanks: str = "x") -> None:
        self.rows: list[tuple] = []
        self.stack: list[Frame] = []
        self.base, self.blanks, self.n, self.ids = base, blanks, 0, set()

    def blank(self) -> str:
        self.n += 1
        return f"_:{self.blanks}{self.n}"

    def triple(self, s: str, p: str, o: tuple, statement: str | None = None) -> None:
        self.rows.append((s, p, *o))
        if statement:
            node = lambda x: (x, "bnode" if x.startswith("_:") else "iri", None, None)
            self.rows += [(statement, RDF + "type", *node(RDF + "Statement")), (statement, RDF + "subject", *node(s)), (statement, RDF + "predicate", *node(p)), (statement, RDF + "object", *o)]

    @staticmethod
    def ref(x: str) -> tuple:
        return x, "bnode" if x.startswith("_:") else "iri", None, None

    def _named(self, frame: Frame, value: str) -> str:
        found = f"{urldefrag(frame.base)[0]}#{value}"
        if found in self.ids:
            raise ValueError(f"rdf:ID {value} occurs twice")
        self.ids.add(found)
        return found

    def start(self, name: str, attributes: dict[str, str]) -> None:
        above = self.stack[-1] if self.stack else None
        if above is not None and above.kind == "literal":
            above.depth += 1
            space, _, local = name.rpartition("}")
            above.text += f"<{local}" + (f' xmlns="{space}"' if space else "") + "".join(f" {k.rpartition('}')[2]}={quoteattr(v)}" for k, v in sorted(attributes.items())) + ">"
            return
        plain = {k.replace("}", ""): v for k, v in attributes.items()}
        base = urljoin(above.base if above else self.base, plain.pop(XML + "base", "")) if XML + "base" in plain else (above.base if above else self.base)
        lang = plain.pop(XML + "lang", None)
        lang = (above.lang if above else None) if lang is None else (lang.lower() or None)
        plain = {k: v for k, v in plain.items() if not k.startswith(XML)}
        iri = name.replace("}", "")
        if "}" not in name:
            raise ValueError(f"element {name} has no namespace")
        if OLD & plain.keys():
            raise ValueError("aboutEach and bagID aren't part of RDF any more")
        if above is None and iri == RDF + "RDF":
            self.stack.append(Frame("root", base, lang))
        elif above is None or above.kind in ("root", "collection", "property"):
            self._node(above, iri, plain, base, lang)
        else:
            self._property(above, iri, plain, base, lang)

    def _node(self, above: Frame | None, iri: str, plain: dict, base: str, lang: str | None) -> None:
        if iri in SYNTAX - {RDF + "Description"}:
            raise ValueError(f"{iri} can't be a node")
        frame = Frame("node", base, lang)
        names = [k for k in (RDF + "about", RDF + "ID", RDF + "nodeID") if k in plain]
        if len(names) > 1:
            raise ValueError("a node has more than one name")
        value = plain.pop(names[0]) if names else ""
        frame.subject = self.blank() if not names else urljoin(base, value) if names[0] == RDF + "about" else f"_:{value}" if names[0] == RDF + "nodeID" else self._named(frame, value)
        if iri != RDF + "Description":
            self.triple(frame.subject, RDF + "type", self.ref(iri))
        self._attributes(frame.subject, plain, base, lang)
        if above is not None and above.kind == "collection":
            above.members.append(frame.subject)
        elif above is not None and above.kind == "property":
            if above.object is not None or above.text.strip():
                raise ValueError("a property has more than one value")
            above.object = self.ref(frame.subject)
        self.stack.append(frame)

    def _attributes(self, subject: str, plain: dict, base: str, lang: str | None) -> None:
        for k, v in plain.items():
            if k in SYNTAX:
                raise ValueError(f"attribute {k} has no place here")
            self.triple(subject, k, self.ref(urljoin(base, v)) if k == RDF + "type" else (v, "literal", lang, None))

    def _property(self, above: Frame, iri: str, plain: dict, base: str, lang: str | None) -> None:
        if iri == RDF + "li":
            above.items += 1
            iri = f"{RDF}_{above.items}"
        if iri in SYNTAX:
            raise ValueError(f"{iri} can't be a property")
        frame = Frame("property", base, lang, above.subject, iri)
        if RDF + "ID" in plain:
            frame.statement = self._named(frame, plain.pop(RDF + "ID"))
        kind, datatype = plain.pop(RDF + "parseType", None), plain.pop(RDF + "datatype", None)
        resource, blank = plain.pop(RDF + "resource", None), plain.pop(RDF + "nodeID", None)
        if sum(x is not None for x in (kind, datatype, resource, blank)) > 1 or (kind or datatype) and plain:
            raise ValueError("attributes of a property contradict each other")
        frame.datatype = datatype and urljoin(base, datatype)
        if kind == "Resource":
            node = self.blank()
            self.triple(above.subject, iri, self.ref(node), frame.statement)
            frame = Frame("node", base, lang, node)
        elif kind == "Collection":
            frame.kind, frame.members = "collection", []
        elif kind is not None:
            frame.kind, frame.datatype = "literal", RDF + "XMLLiteral"
        elif resource is not None or blank is not None or plain:
            node = urljoin(base, resource) if resource is not None else f"_:{blank}" if blank is not None else self.blank()
            frame.object = self.ref(node)
            self._attributes(node, plain, base, lang)
        self.stack.append(frame)

    def text(self, data: str) -> None:
        if not self.stack:
            return
        frame = self.stack[-1]
        if frame.kind == "literal":
            frame.text += escape(data)
        elif frame.kind == "property" and frame.object is None:
            frame.text += data
        elif data.strip():
            raise ValueError(f"text where none can be: {data.strip()[:40]!r}")

    def end(self, name: str) -> None:
        frame = self.stack[-1]
        if frame.kind == "literal" and frame.depth:
            frame.depth -= 1
            frame.text += f"</{name.rpartition('}')[2]}>"
            return
        self.stack.pop()
        if frame.kind == "collection":
            cells = [self.blank() for _ in frame.members]
            for cell, member, rest in zip(cells, frame.members, [*cells[1:], RDF + "nil"], strict=False):
                self.triple(cell, RDF + "first", self.ref(member))
                self.triple(cell, RDF + "rest", self.ref(rest))
            frame.object = self.ref(cells[0] if cells else RDF + "nil")
        elif frame.kind in ("property", "literal") and frame.object is None:
            frame.object = (frame.text, "literal", None if frame.datatype else frame.lang, frame.datatype)
        elif frame.kind == "property" and frame.text.strip():
            raise ValueError("a property has text and a node")
        if frame.kind in ("property", "collection", "literal"):
            self.triple(frame.subject, frame.predicate, frame.object, frame.statement)


def triples(stream, base: str, blanks: str = "x") -> Iterator[list[tuple]]:
    """Rows of a document in blocks, as its stream is read."""
    events, parser = Events(base, blanks), expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = events.start, events.end, events.text
    try:
        while data := stream.read(BLOCK):
            parser.Parse(data, False)
            if events.rows:
                yield events.rows
                events.rows = []
        parser.Parse(b"", True)
    except expat.ExpatError as e:
        raise ValueError(f"not well-formed: {e}") from e
    yield events.rows


class RdfXml(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rdf_xml"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in COLUMNS)

    def reader(self, schema) -> DataSourceReader:
        return RdfXmlReader(self.options)


class RdfXmlReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.base = options["path"], options.get("base", "")

    def partitions(self) -> list[InputPartition]:
        found = sorted({p for s in (".rdf", ".owl", ".xml") for p, _, _ in files_of(self.path, s)})
        return [Run(p, "", i, 0) for i, p in enumerate(found)] or [Run("", "", 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with opened(partition.path) as f:
            for rows in triples(f, self.base or partition.path, f"f{partition.begin}x"):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(COLUMNS))], names=list(COLUMNS))


def read_rdfxml(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Triples of RDF/XML files (a file, or a folder's .rdf, .owl and .xml); relative names go by ``base`` or the file's path."""
    spark.dataSource.register(RdfXml)
    reader = spark.read.format("rdf_xml")
    return (reader.option("base", base) if base else reader).load(path)
