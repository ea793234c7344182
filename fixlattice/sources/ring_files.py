"""Rings in files of XML or OWL, read element by element: no document is parsed or held whole. A file is read by one task, as Spark's XML source doesn't split files, so what is written here is many small ones
(``FILE_RINGS`` rings a file at most), and a large document from elsewhere is best cut before.

Elements that don't parse (they have no fields then), or lack what a ring needs, are rows with status ``refused`` and a reason, and cost no job. Rings of one name stay rows of their own in XML; in OWL
a class is what its name says, so classes of one name are one ring if they are equal. No files: an error of the source; an empty folder: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rings of a written file at most.
FILE_RINGS = 50_000
_CORRUPT = "_corrupt"
_RING = f"_name string, adds array<string>, requires array<string>, verb array<struct<_name:string,source:string,slot:array<string>>>, {_CORRUPT} string"
_RESOURCE = "struct<`_rdf:resource`:string>"
_CLASS = f"`_rdf:about` string, `rdfs:subClassOf` array<struct<`_rdf:resource`:string,`owl:Restriction`:struct<`owl:onProperty`:{_RESOURCE},`owl:hasValue`:{_RESOURCE}>>>, {_CORRUPT} string"
_INDIVIDUAL = f"`_rdf:about` string, verb_name struct<_VALUE:string>, verb_source struct<_VALUE:string>, verb_slots struct<_VALUE:string>, {_CORRUPT} string"


def _elements(spark: SparkSession, paths: str | list[str], tag: str, schema: str) -> DataFrame:
    # the element-wise parser: the other reads a file as one stream, which an element that doesn't parse ends
    return spark.read.format("xml").option("useLegacyXMLParser", "true").option("rowTag", tag).option("columnNameOfCorruptRecord", _CORRUPT).option("mode", "PERMISSIVE").option("ignoreSurroundingSpaces", "false").schema(schema).load(paths)


def write_rings(rings: DataFrame, path: str) -> None:
    """Rings (name, adds, requires, verbs) as ``<onion><ring name=..>`` files, one or more a partition."""
    verb = F.transform("verbs", lambda v: F.struct(v["name"].alias("_name"), v["source"].alias("source"), v["slots"].alias("slot")))
    rows = rings.select(F.col("name").alias("_name"), "adds", "requires", verb.alias("verb"))
    rows.write.mode("overwrite").format("xml").option("maxRecordsPerFile", FILE_RINGS).option("rootTag", "onion").option("rowTag", "ring").save(path)


def _judged(rows: DataFrame, reason: Column) -> DataFrame:
    none = F.array().cast("array<string>")
    verbs = F.coalesce("verbs", F.array().cast("array<struct<name:string,source:string,slots:array<string>>>"))
    return rows.select("name", F.coalesce("adds", none).alias("adds"), F.coalesce("requires", none).alias("requires"), verbs.alias("verbs"), F.when(reason.isNull(), "ok").otherwise("refused").alias("status"), reason.alias("reason"))


def read_rings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, adds, requires, verbs, status, reason) of every ring element in files of XML."""
    slots = lambda v: F.coalesce(v["slot"], F.array().cast("array<string>")).alias("slots")
    verbs = F.transform("verb", lambda v: F.struct(v["_name"].alias("name"), v["source"].alias("source"), slots(v)))
    rows = _elements(spark, paths, "ring", _RING).select(F.col("_name").alias("name"), "adds", "requires", verbs.alias("verbs"), _CORRUPT)
    bad_verb = F.exists(F.coalesce("verbs", F.array().cast("array<struct<name:string,source:string,slots:array<string>>>")), lambda v: v["name"].isNull() | v["source"].isNull())
    rows = rows.withColumns({c: F.when(F.col(_CORRUPT).isNull(), F.col(c)) for c in ("name", "adds", "requires", "verbs")})
    return _judged(rows, F.when(F.col(_CORRUPT).isNotNull(), "malformed").when(F.coalesce("name", F.lit("")) == "", "no_name").when(bad_verb, "bad_verb"))


def read_owl_rings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, adds, requires, verbs, status, reason) of every ring class in files of OWL; classes and individuals are two readings, joined by id."""
    classes = _elements(spark, paths, "owl:Class", _CLASS).select(F.col("`_rdf:about`").alias("about"), F.col("`rdfs:subClassOf`").alias("subs"), _CORRUPT)
    broken = classes.where(F.col(_CORRUPT).isNotNull())
    rings = classes.where(F.col(_CORRUPT).isNull() & F.exists("subs", lambda s: s["_rdf:resource"] == "#Ring")).select("about", "subs").distinct()
    links = rings.select("about", F.posexplode("subs").alias("at", "s")).select("about", "at", F.col("s.`owl:Restriction`.`owl:onProperty`.`_rdf:resource`").alias("property"), F.col("s.`owl:Restriction`.`owl:hasValue`.`_rdf:resource`").alias("target"))
    individuals = _elements(spark, paths, "owl:NamedIndividual", _INDIVIDUAL)
    found = individuals.where("verb_name IS NOT NULL").select(
        F.col("`_rdf:about`").alias("target"),
        F.struct(F.col("verb_name._VALUE").alias("name"), F.coalesce("verb_source._VALUE", F.lit("")).alias("source"), F.filter(F.split(F.coalesce("verb_slots._VALUE", F.lit("")), ","), lambda s: s != "").alias("slots")).alias("verb"),
    )
    found = found.groupBy("target").agg(F.min("verb").alias("verb"))
    told = links.join(found, "target", "left")

    def listed(prop: str, value: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("property") == prop, F.struct("at", value.alias("x"))))), lambda p: p["x"])

    cap = F.regexp_replace("target", "^#cap_", "")
    missing = F.bool_or((F.col("property") == "#has_verb") & F.col("verb").isNull())
    made = told.groupBy("about").agg(listed("#adds", cap).alias("adds"), listed("#requires", cap).alias("requires"), listed("#has_verb", F.col("verb")).alias("verbs"), missing.alias("missing"))
    whole = rings.select("about").distinct().join(made, "about", "left").withColumn(_CORRUPT, F.lit(None).cast("string"))
    rows = whole.unionByName(broken.select("about", _CORRUPT), allowMissingColumns=True).withColumn("name", F.substring("about", 2, 1 << 20))
    return _judged(rows, F.when(F.col(_CORRUPT).isNotNull(), "malformed").when(F.coalesce("name", F.lit("")) == "", "no_name").when(F.col("missing"), "no_such_verb"))
