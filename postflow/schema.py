"""Schemas of the tables that pass between the steps."""

from pyspark.sql import types as T

POST = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("retweet_count", T.LongType()),
    T.StructField("geo", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.ArrayType(T.DoubleType())),
    ])),
    T.StructField("entities", T.StructType([
        T.StructField("hashtags", T.ArrayType(T.StructType([
            T.StructField("text", T.StringType()),
            T.StructField("indices", T.ArrayType(T.LongType())),
        ]))),
    ])),
])

# What travels through the topic. `id` comes first so that the sink keeps a key.
ENVELOPE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("coordinates", T.ArrayType(T.DoubleType())),
    T.StructField("hashtags", T.ArrayType(T.StringType())),
    T.StructField("cleaned_text", T.StringType()),
])

PROCESSED = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("coordinates", T.ArrayType(T.DoubleType())),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("hashtags", T.ArrayType(T.StringType())),
    T.StructField("text", T.StringType()),
    T.StructField("sentiment_score", T.IntegerType()),
])
