"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

#: The query log, one JSON object a line.
LOG_ENTRY = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("session_id", T.LongType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("database", T.StringType()),
    T.StructField("query_type", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("args", T.ArrayType(T.StringType())),
    T.StructField("response_time_ms", T.DoubleType()),
    T.StructField("rows_affected", T.LongType()),
    T.StructField("rows_returned", T.LongType()),
    T.StructField("error", T.StringType()),
])

#: One difference between two results.
DIFFERENCE = "struct<type:string,row:int,column:string,original:string,replay:string>"
