"""Table schemas and domain constants."""

from __future__ import annotations

from pyspark.sql import types as T

SPEECHES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("protocol_id", T.StringType()),
        T.StructField("protocol_date", T.DateType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("party", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("file_url", T.StringType()),
    ]
)
TWEETS = T.StructType(
    [
        T.StructField("tweet_id", T.StringType(), False),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("username", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)
PARTIES = ("C", "KD", "L", "M", "MP", "S", "SD", "V")
PARTY_RENAMES = {"FP": "L"}
UNKNOWN_SPEAKER = "Okänd"
