"""Fixed schemas of the keyed-group documents and flat records."""

from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("dup_id", T.StringType()),
        T.StructField("raw", T.StringType()),
        # a string or a list of pieces
        T.StructField("template", T.VariantType()),
    ]
)

GROUP = T.StructType(
    [
        T.StructField("metadata", T.StringType()),
        T.StructField("group", T.ArrayType(EVENT)),
    ]
)

KEYED_GROUPS = T.MapType(T.StringType(), GROUP)
