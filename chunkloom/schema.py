"""The chunk record, the one row type that all stages share."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("mimeType", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("total", T.IntegerType()),
        T.StructField("fromLine", T.StringType()),
        T.StructField("toLine", T.StringType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("overlap", T.IntegerType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("content", T.StringType()),
    ]
)
CHUNK_COLUMNS = CHUNK_SCHEMA.fieldNames()
EDGE_SCHEMA = "source string, target string"
SYMBOL_SCHEMA = "name string, fqn string"

# Names of the code sections and the weight of a hit in each.
SECTION_KEY = "java_code_section"
SECTIONS = ("unknown", "imports", "methodDoc", "method", "classFrame", "dependenciesInfo")
SECTION_WEIGHTS = {"classFrame": 2, "method": 5, "methodDoc": 5, "imports": 1, "dependenciesInfo": 0, "unknown": 0}

# Suffixes of the known file types, tried in this order.
FILE_TYPES = (("JAVA_CODE", ".java"), ("JSP", ".jsp"), ("XML", ".xml"), ("PDF", ".pdf"), ("JAVA_SCRIPT", ".js"), ("HTML", ".html"))
