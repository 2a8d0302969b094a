"""A generic event log (event_id, ts, user_id, event_type, value, props) seen as page edits.

Used to run the engine on tables that hold no page edits. ``timestamp`` keeps
the type of ``ts``, so predicates on it still reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def edits_from_log(log: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    wiki = F.when(F.col("event_id") % 3 == 0, "dewiki").otherwise("enwiki")
    return log.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("page_"), k.cast("string")).alias("title"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user"),
        (F.col("user_id") % 7 == 0).alias("anonymous"),
        (F.col("user_id") % 10 == 0).alias("bot"),
        F.concat_ws(" ", kind, F.col("props")).alias("comment"),
        F.when(kind == "signup", "new").when(kind == "error", "log").otherwise("edit").alias("event_type"),
        (k % 4).cast("int").alias("namespace"),
        wiki.alias("wiki"),
        F.concat(wiki, F.lit(".example.org")).alias("server_name"),
    )


def raw_changes(edits: DataFrame) -> DataFrame:
    """(event_id, value): each edit as raw change JSON, in the spellings producers use.

    By ``event_id`` the timestamp is a number, numeric text or ISO text, the
    namespace a number or text, the domain nested or flat, and some records are
    broken: no title, a null user, or cut short.
    """
    i = F.col("event_id")
    whole_second = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    epoch = F.unix_seconds(F.col("timestamp").cast("timestamp")).cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    stamp = (
        F.when(i % 4 == 0, epoch)
        .when(i % 4 == 1, quoted(epoch))
        .when(i % 4 == 2, quoted(F.concat(whole_second, F.lit("Z"))))
        .otherwise(quoted(whole_second))
    )
    title = F.when(i % 17 == 0, F.lit("")).otherwise(F.concat(F.lit(',"title":'), quoted(F.col("title"))))
    user = (
        F.when(i % 19 == 0, F.lit(',"user":null'))
        .when(i % 5 == 0, F.lit(""))
        .when(i % 5 == 1, F.concat(F.lit(',"user":"10.0.0.'), (i % 300).cast("string"), F.lit('"')))
        .otherwise(F.concat(F.lit(',"user":'), quoted(F.col("user"))))
    )
    namespace = F.when(i % 2 == 0, F.col("namespace").cast("string")).otherwise(quoted(F.col("namespace").cast("string")))
    domain = F.when(i % 3 == 1, F.concat(F.lit(',"meta":{"domain":'), quoted(F.col("server_name")), F.lit("}"))).otherwise(
        F.concat(F.lit(',"server_name":'), quoted(F.col("server_name")))
    )
    text = F.concat(
        F.lit('{"timestamp":'), stamp, title, user,
        F.lit(',"type":'), quoted(F.col("event_type")),
        F.lit(',"namespace":'), namespace,
        F.lit(',"wiki":'), quoted(F.col("wiki")),
        F.lit(',"bot":'), F.col("bot").cast("string"),
        domain, F.lit("}"),
    )
    cut = F.substring(text, 1, 40)
    return edits.select("event_id", F.when(i % 23 == 0, cut).otherwise(text).alias("value"))
