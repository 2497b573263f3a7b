"""The quad table: one narrow row per statement.

``g`` is null in the default graph.  Kinds: 0 IRI, 1 blank node, 2 literal.  A
blank node's value is ``<document>|<label>``: it names one node in one document
only, and merging tables never renames it.
"""

from __future__ import annotations

from pyspark.sql import types as T

IRI, BLANK, LITERAL = 0, 1, 2
QUAD = T.StructType([
    T.StructField("g_kind", T.ByteType()), T.StructField("g", T.StringType()),
    T.StructField("s_kind", T.ByteType()), T.StructField("s", T.StringType()),
    T.StructField("p", T.StringType()),
    T.StructField("o_kind", T.ByteType()), T.StructField("o", T.StringType()),
    T.StructField("o_dt", T.StringType()), T.StructField("o_lang", T.StringType()),
])
COLUMNS = QUAD.fieldNames()
GRAPH, SUBJECT, OBJECT = ["g_kind", "g"], ["s_kind", "s"], ["o_kind", "o", "o_dt", "o_lang"]

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE, FIRST, REST, NIL, LANG_STRING = (RDF + x for x in ("type", "first", "rest", "nil", "langString"))
STRING, INTEGER, DECIMAL, DOUBLE, BOOLEAN, DATE, DATE_TIME = (XSD + x for x in ("string", "integer", "decimal", "double", "boolean", "date", "dateTime"))
