"""Column layouts of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

FILE_INFO = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("bytes", T.LongType())]
)

ITEMS = T.StructType(
    [
        T.StructField("image_id", T.LongType(), False),
        T.StructField("source", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("file_info", FILE_INFO),
        T.StructField("ts", T.TimestampType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

LEXICON = T.StructType(
    [
        T.StructField("phrase", T.StringType()),
        T.StructField("slot", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

QUERIES = T.StructType(
    [
        T.StructField("query_id", T.StringType(), False),
        T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("query_vec", T.ArrayType(T.FloatType())),
        T.StructField("filters", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "clues",
            T.ArrayType(
                T.StructType(
                    [T.StructField("slot", T.StringType()), T.StructField("value", T.StringType())]
                )
            ),
        ),
    ]
)

# The seven kinds of memory clue, and the five ranking signals.
SLOTS = ("topic", "appearance", "type", "visual", "context", "text", "source")
SIGNALS = ("text", "semantic", "visual", "metadata", "clue")
