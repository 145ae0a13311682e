"""RDF/XML against hand-written triples; Turtle by splits against the whole document at once."""

import re

import pytest

from arborix.sources import rdf, rdfxml

RDF = rdfxml.RDF
DOC = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://e/" xmlns:dc="http://d/" xml:base="http://base/doc" xml:lang="EN">
  <rdf:Description rdf:about="a" dc:title="A &amp; B" rdf:type="http://e/T">
    <ex:p rdf:resource="#b"/>
    <ex:q rdf:datatype="http://www.w3.org/2001/XMLSchema#int">5</ex:q>
    <ex:r xml:lang="fr">été</ex:r>
    <ex:none xml:lang=""></ex:none>
    <ex:s rdf:parseType="Resource"><ex:t>inner</ex:t></ex:s>
    <ex:u><ex:Kind rdf:ID="k" xml:base="http://other/"><rdf:value>v</rdf:value></ex:Kind></ex:u>
    <ex:w rdf:nodeID="n1"/>
    <ex:x dc:title="on a blank"/>
    <ex:list rdf:parseType="Collection"><rdf:Description rdf:about="http://l/1"/><rdf:Description rdf:nodeID="n1"/></ex:list>
    <ex:empty rdf:parseType="Collection"/>
    <ex:lit rdf:parseType="Literal">x <b>y</b> &lt;</ex:lit>
    <ex:said rdf:ID="st" rdf:resource="http://z/"/>
  </rdf:Description>
  <rdf:Bag rdf:nodeID="bag"><rdf:li>one</rdf:li><rdf:li rdf:resource="http://two/"/></rdf:Bag>
</rdf:RDF>"""


def plain(rows):
    """Generated blank nodes as one sign each, by their order."""
    names = {}
    sign = lambda x: names.setdefault(x, f"?{len(names)}") if isinstance(x, str) and re.fullmatch(r"_:(f\d+x|x|b|s\d+b|e\d+b)\d+", x) else x
    return [tuple(sign(v) for v in r) for r in rows]


def test_rdfxml(spark, tmp_path):
    (tmp_path / "g.rdf").write_text(DOC, encoding="utf-8")
    got = plain(map(tuple, rdfxml.read_rdfxml(spark, f"file://{tmp_path}/g.rdf").collect()))
    lit = lambda x, lang="en", kind=None: (x, "literal", lang, kind)
    iri, blank = lambda x: (x, "iri", None, None), lambda x: (x, "bnode", None, None)
    a = "http://base/a"
    expected = {
        (a, "http://d/title", *lit("A & B")), (a, RDF + "type", *iri("http://e/T")), (a, "http://e/p", *iri("http://base/doc#b")),
        (a, "http://e/q", *lit("5", None, "http://www.w3.org/2001/XMLSchema#int")), (a, "http://e/r", *lit("été", "fr")), (a, "http://e/none", *lit("", None)),
        (a, "http://e/s", *blank("?0")), ("?0", "http://e/t", *lit("inner")),
        ("http://other/#k", RDF + "type", *iri("http://e/Kind")), ("http://other/#k", RDF + "value", *lit("v")), (a, "http://e/u", *iri("http://other/#k")),
        (a, "http://e/w", *blank("_:n1")), ("?1", "http://d/title", *lit("on a blank")), (a, "http://e/x", *blank("?1")),
        ("?2", RDF + "first", *iri("http://l/1")), ("?2", RDF + "rest", *blank("?3")), ("?3", RDF + "first", *blank("_:n1")), ("?3", RDF + "rest", *iri(RDF + "nil")), (a, "http://e/list", *blank("?2")),
        (a, "http://e/empty", *iri(RDF + "nil")), (a, "http://e/lit", *lit("x <b>y</b> &lt;", None, RDF + "XMLLiteral")),
        (a, "http://e/said", *iri("http://z/")), ("http://base/doc#st", RDF + "type", *iri(RDF + "Statement")), ("http://base/doc#st", RDF + "subject", *iri(a)), ("http://base/doc#st", RDF + "predicate", *iri("http://e/said")), ("http://base/doc#st", RDF + "object", *iri("http://z/")),
        ("_:bag", RDF + "type", *iri(RDF + "Bag")), ("_:bag", RDF + "_1", *lit("one")), ("_:bag", RDF + "_2", *iri("http://two/")),
    }
    assert set(got) == expected and len(got) == len(expected)
    (tmp_path / "h.rdf").write_text(DOC.replace("http://base/doc", "http://base/other"), encoding="utf-8")
    both = rdfxml.read_rdfxml(spark, f"file://{tmp_path}")
    assert both.rdd.getNumPartitions() == 2 and both.count() == 2 * len(expected)


@pytest.mark.parametrize("wrong, words", [("<rdf:Description>text</rdf:Description>", "text where none"), ("<rdf:Description rdf:about='a' rdf:nodeID='b'/>", "more than one name"), ("<rdf:li/>", "can't be a node"), ("<rdf:Description>", "not well-formed"), ("<ex:a><ex:p>t<ex:b/></ex:p></ex:a>", "more than one value"), ("<ex:a rdf:ID='x'/><ex:a rdf:ID='x'/>", "twice"), ("<none/>", "no namespace"), ("<ex:a><ex:p rdf:resource='x' rdf:datatype='y'/></ex:a>", "contradict")])
def test_faulty_rdfxml(wrong, words):
    import io

    text = f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:ex="http://e/">{wrong}</rdf:RDF>'
    with pytest.raises(ValueError, match=words):
        list(rdfxml.triples(io.BytesIO(text.encode()), "http://b/"))


TURTLE = '''@prefix ex: <http://e/> .
# a comment. with a dot
ex:a ex:p ex:b, "x. y"@en ;
  ex:q """long
. not an end .
ex:no ex:no ex:no .
""" .
ex:c ex:list ( ex:1 "two" ( ) ex:3 ) .
[] ex:r [ ex:s 4.5 ;
   ex:t true ] .
PREFIX ex: <http://other/>
ex:d ex:p <rel> .
BASE <http://base/>
<x> ex:p <y#z>,
  \'\'\'a "quoted" ' one
.
\'\'\' .
@prefix more: <http://m/> .
more:z a ex:T .
''' + "".join(f'more:n{i} ex:p "v{i}. w", more:n{i + 1} .\n' for i in range(40))


@pytest.mark.parametrize("size", [60, 333, 1 << 20])
def test_turtle_by_splits(spark, tmp_path, size):
    (tmp_path / "t.ttl").write_text(TURTLE)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 1)
        found = rdf.read_turtle(spark, f"file://{tmp_path}/t.ttl").collect()
    finally:
        for n, v in zip(names, old, strict=True):
            spark.conf.set(n, v)
    whole = rdf.parse_turtle(TURTLE)
    key = lambda rows: sorted(map(repr, [tuple("?" if isinstance(v, str) and v.startswith("_:") else v for v in r) for r in map(tuple, rows)]))
    assert key(found) == key(whole) and len(whole) > 90
    assert len({x for r in found for x in (r.s, r.o) if x.startswith("_:")}) == len({x for r in whole for x in (r[0], r[2]) if x.startswith("_:")})
