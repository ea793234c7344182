"""Text codecs: Prolog facts, OWL individuals and classes, ring documents in XML and JSON. Text is data both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixlattice.functions.dims import CONDITIONAL_VERBS, COOLING, DIMENSIONS, LADDER, RITES, dimension, nth

BOOLEAN = "http://www.w3.org/2001/XMLSchema#boolean"
# Predicate names of the vocabularies.
PREDICATES = {"ladder": "ladder", "architecture": "architecture_stage", "cooling": "cooling_step", "loop": "loop_verb", "pipeline": "pipeline_stage", "rites": "agent_rite", "node_fields": "node_field"}
RINGS = "array<struct<name:string,adds:array<string>,requires:array<string>,verbs:array<struct<name:string,source:string,slots:array<string>>>>>"


def prolog_facts(spark: SparkSession) -> DataFrame:
    """(predicate, idx, line): every vocabulary as indexed facts, the conditional verbs as plain ones."""
    parts = [dimension(spark, d).select(F.lit(p).alias("predicate"), "idx", F.format_string("%s(%d, %s).", F.lit(p), "idx", "name").alias("line")) for d, p in PREDICATES.items()]
    verbs = spark.createDataFrame(list(enumerate(CONDITIONAL_VERBS)), "idx int, name string")
    parts.append(verbs.select(F.lit("conditional_verb").alias("predicate"), "idx", F.format_string("conditional_verb(%s).", "name").alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def indexed_facts(rows: DataFrame) -> DataFrame:
    """(predicate, idx, line) of rows (predicate, idx, name): ``predicate(idx, name).``"""
    return rows.select("predicate", "idx", F.format_string("%s(%d, %s).", "predicate", "idx", "name").alias("line"))


def parse_prolog(lines: DataFrame, line: str = "value") -> DataFrame:
    """(predicate, atoms): facts of lower-case atoms in index order; all other lines are passed over."""
    fact = r"^(\w+)\((?:(\d+),\s*)?([a-z_]+)\)\.$"
    t = F.trim(F.col(line))
    got = lines.where(t.rlike(fact)).select(F.regexp_extract(t, fact, 1).alias("predicate"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(t, fact, 2), F.lit("")), F.lit("999999")), F.lit(0)).cast("int").alias("idx"), F.regexp_extract(t, fact, 3).alias("atom"))
    g = got.groupBy("predicate").agg(F.array_sort(F.collect_list(F.struct("idx", "atom"))).alias("l"))
    return g.select("predicate", F.transform("l", lambda x: x["atom"]).alias("atoms"))


def escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def owl_individual(name: Column, level: Column, w: Column, r: Column) -> Column:
    """A state as an individual: its rung and all thirteen booleans."""

    def flag(prop: str, mask: Column, i: int) -> Column:
        value = F.when(mask.bitwiseAND(1 << i) != 0, "true").otherwise("false")
        return F.concat(F.lit(f'    <{prop} rdf:datatype="{BOOLEAN}">'), value, F.lit(f"</{prop}>"))

    lines = [F.concat(F.lit('  <owl:NamedIndividual rdf:about="#'), escape(name), F.lit('">')), F.concat(F.lit('    <rdf:type rdf:resource="#AtLeast_'), nth(LADDER, level), F.lit('"/>'))]
    lines += [flag(f"witnessed_{s}", w, i) for i, s in enumerate(COOLING)] + [flag(f"rite_{s}", r, i) for i, s in enumerate(RITES)]
    return F.concat_ws("\n", *lines, F.lit("  </owl:NamedIndividual>"))


def owl_classes(spark: SparkSession) -> DataFrame:
    """(pos, fragment): the rungs as a chain of subclasses, booleans as properties of nodes."""
    rungs = [f'  <owl:Class rdf:about="#AtLeast_{a}">\n    <rdfs:subClassOf rdf:resource="#{b}"/>\n  </owl:Class>' for a, b in zip(LADDER, ["Node", *(f"AtLeast_{x}" for x in LADDER)])]
    flags = [f'  <owl:DatatypeProperty rdf:about="#{p}">\n    <rdfs:domain rdf:resource="#Node"/>\n    <rdfs:range rdf:resource="{BOOLEAN}"/>\n  </owl:DatatypeProperty>' for p in (*(f"witnessed_{s}" for s in COOLING), *(f"rite_{r}" for r in RITES))]
    return spark.createDataFrame(list(enumerate(rungs + flags)), "pos int, fragment string")


def document(fragments: DataFrame, iri: str) -> DataFrame:
    """(text): fragments in order of pos as one document. A document is one text by nature; its parts are few."""
    head = f'<?xml version="1.0"?>\n<rdf:RDF xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xml:base="{iri}" xmlns="{iri}#">\n'
    return fragments.agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fragment"))), lambda x: x["fragment"]), "\n"), F.lit("\n</rdf:RDF>\n")).alias("text"))


def rings_to_xml(stack: Column) -> Column:
    """A struct (name, ring: array of rings with attribute-free children) as XML."""
    return F.to_xml(stack, {"rowTag": "onion"})


def rings_from_xml(text: Column) -> Column:
    """<onion name><ring name><adds/>..<requires/>..<verb name><source/><slot/>..</verb></ring></onion>."""
    schema = "_name string, ring array<struct<_name:string,adds:array<string>,requires:array<string>,verb:array<struct<_name:string,source:string,slot:array<string>>>>>"
    return F.from_xml(text, schema)


def rings_to_json(rings: Column) -> Column:
    return F.to_json(rings)


def rings_from_json(text: Column) -> Column:
    return F.from_json(text, RINGS)


STRING = "http://www.w3.org/2001/XMLSchema#string"


def owl_ring(ring: Column) -> Column:
    """A ring struct (name, adds, requires, verbs) as text: its verbs as individuals, then its class with one restriction for each capability and verb."""
    name = escape(ring["name"])

    def restriction(prop: str, target: Column) -> Column:
        return F.concat(F.lit(f'    <rdfs:subClassOf><owl:Restriction>\n      <owl:onProperty rdf:resource="#{prop}"/>\n      <owl:hasValue rdf:resource="#'), target, F.lit('"/>\n    </owl:Restriction></rdfs:subClassOf>'))

    def verb_id(v: Column) -> Column:
        return F.concat(F.lit("verb_"), name, F.lit("_"), escape(v["name"]))

    def field(prop: str, value: Column) -> Column:
        return F.concat(F.lit(f'    <{prop} rdf:datatype="{STRING}">'), escape(value), F.lit(f"</{prop}>\n"))

    def individual(v: Column) -> Column:
        return F.concat(F.lit('  <owl:NamedIndividual rdf:about="#'), verb_id(v), F.lit('">\n    <rdf:type rdf:resource="#Verb"/>\n'), field("verb_name", v["name"]), field("verb_source", v["source"]), field("verb_slots", F.array_join(v["slots"], ",")), F.lit("  </owl:NamedIndividual>"))

    subs = F.concat(
        F.transform(ring["adds"], lambda c: restriction("adds", F.concat(F.lit("cap_"), escape(c)))),
        F.transform(ring["requires"], lambda c: restriction("requires", F.concat(F.lit("cap_"), escape(c)))),
        F.transform(ring["verbs"], lambda v: restriction("has_verb", verb_id(v))),
    )
    own = F.concat(F.lit('  <owl:Class rdf:about="#'), name, F.lit('">\n    <rdfs:subClassOf rdf:resource="#Ring"/>\n'), F.array_join(subs, "\n"), F.lit("\n  </owl:Class>"))
    return F.array_join(F.concat(F.transform(ring["verbs"], individual), F.array(own)), "\n")


@F.udtf(returnType="name string, adds array<string>, requires array<string>, verbs array<struct<name:string,source:string,slots:array<string>>>")
class RingsFromOwl:
    """One row for each ring class of an OWL document; verb names come from the individuals, not from their ids."""

    def eval(self, text: str):
        import xml.etree.ElementTree as ET

        rdf = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
        owl = "{http://www.w3.org/2002/07/owl#}"
        rdfs = "{http://www.w3.org/2000/01/rdf-schema#}"
        try:
            root = ET.fromstring(text or "")
        except ET.ParseError:
            return  # ``ring_files.read_owl_rings`` reads what is broken element by element, with reasons
        found = {}
        for e in root.iter(f"{owl}NamedIndividual"):
            values = {c.tag.rpartition("}")[2]: c.text or "" for c in e}
            if "verb_name" in values:
                found[e.get(f"{rdf}about")] = (values["verb_name"], values.get("verb_source", ""), [s for s in values.get("verb_slots", "").split(",") if s])
        for c in root.iter(f"{owl}Class"):
            subs = c.findall(f"{rdfs}subClassOf")
            if not any(s.get(f"{rdf}resource") == "#Ring" for s in subs):
                continue
            links = [(r.find(f"{owl}onProperty").get(f"{rdf}resource"), r.find(f"{owl}hasValue").get(f"{rdf}resource")) for s in subs for r in s.findall(f"{owl}Restriction")]
            of = lambda prop: [v for p, v in links if p == prop]
            yield (c.get(f"{rdf}about")[1:], [v.removeprefix("#cap_") for v in of("#adds")], [v.removeprefix("#cap_") for v in of("#requires")], [found[v] for v in of("#has_verb") if v in found])


def render_verb(verb: Column) -> Column:
    """A verb struct as the text of its source form; text alone."""
    return F.concat(F.lit("def "), verb["name"], F.lit("(self, *args, **kwargs):\n    "), F.regexp_replace(verb["source"], "\n", "\n    "))


def render_ring(ring: Column) -> Column:
    """A ring struct as the text of a class: what it adds and requires, then its verbs."""
    body = F.array_join(F.transform(ring["verbs"], lambda v: F.concat(F.lit("    "), F.regexp_replace(render_verb(v), "\n", "\n    "))), "\n")
    return F.concat(F.lit("class "), ring["name"], F.lit(":\n    # adds "), F.array_join(ring["adds"], ", "), F.lit("\n    # requires "), F.array_join(ring["requires"], ", "), F.lit("\n"), body)


def write_text(lines: DataFrame, path: str) -> None:
    """A one-column table of text as a text file sink."""
    lines.write.mode("overwrite").text(path)
