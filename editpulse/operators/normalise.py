"""Raw change JSON to normalised events, with a reason for every rejected record.

Each record is parsed once into one VARIANT per known field, so unknown fields
are skipped by the JSON reader and every field keeps its JSON type: the rules
tell a missing key from an explicit null and a number from numeric text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULTS, Settings
from ..functions import looks_anonymous, share, strip
from ..functions.times import epoch_to_timestamp, iso_to_timestamp, numeric_text
from .filters import ingest_condition

TYPED_FIELDS = ("timestamp", "title", "user", "comment", "type", "namespace", "wiki", "server_name", "meta")
FLAG_FIELDS = ("anonymous", "bot")

# Quotes must be double quotes, as in JSON proper.
JSON_OPTIONS = {"allowSingleQuotes": "false"}

# JSON texts of the values that count as false.
_FALSY = r'\A(?:null|false|""|\[\]|\{\}|-?0(?:\.0*)?(?:[eE].*)?)\z'

_INTEGER = r"\A[+-]?[0-9]+(?:_[0-9]+)*\z"


def json_fields(value: Column, names: tuple[str, ...]) -> Column:
    """The text as an array holding one struct of variants; any other shape is no single object.

    Reading the text as the inside of an array makes trailing data, empty text
    and several values in one record visible.
    """
    ddl = ", ".join(f"`{name}`: variant" for name in names)
    wrapped = F.concat(F.lit("["), value, F.lit("]"))
    return F.from_json(wrapped, f"array<struct<{ddl}>>", JSON_OPTIONS)


def single_object(parsed: Column) -> Column:
    return F.coalesce((F.size(parsed) == 1) & F.get(parsed, F.lit(0)).isNotNull(), F.lit(False))


@dataclass(frozen=True)
class JsonValue:
    """A parsed JSON value in three columns: the variant, its type name and its text.

    ``kind`` is null when the key is absent, ``text`` unless the value is a JSON
    string. Both are computed once per record, since nearly every rule asks for
    them and reading a variant is dear.
    """

    name: str

    @property
    def variant(self) -> Column:
        return F.col(f"_v_{self.name}")

    @property
    def kind(self) -> Column:
        return F.col(f"_k_{self.name}")

    @property
    def text(self) -> Column:
        return F.col(f"_t_{self.name}")

    @property
    def absent(self) -> Column:
        return self.kind.isNull()

    @property
    def is_object(self) -> Column:
        return F.startswith(self.kind, F.lit("OBJECT"))

    def number(self) -> Column:
        """Numbers as they are and flags as 0 or 1; null for text and anything else."""
        return F.when(self.kind != "STRING", F.try_variant_get(self.variant, "$", "double"))

    def text_or(self, default: str) -> Column:
        """A fixed value for an absent key, null for anything that is not a string."""
        return F.when(self.absent, F.lit(default)).otherwise(self.text)

    def truthy(self) -> Column:
        """Whether the value counts as true: empty, zero, null and absent do not."""
        return F.coalesce(~F.to_json(self.variant).rlike(_FALSY), F.lit(False))


def _with_kind_and_text(df: DataFrame, values: list[JsonValue]) -> DataFrame:
    kinds = df.select("*", *[F.schema_of_variant(v.variant).alias(f"_k_{v.name}") for v in values])
    texts = [F.when(v.kind == "STRING", F.try_variant_get(v.variant, "$", "string")) for v in values]
    return kinds.select("*", *[t.alias(f"_t_{v.name}") for t, v in zip(texts, values)])


def with_json_values(df: DataFrame, value: Column, names: tuple[str, ...], flags: tuple[str, ...] = ()) -> DataFrame:
    """Parse ``value`` once; adds ``_ok`` (one JSON object) and the columns of each :class:`JsonValue`.

    Values named in ``flags`` are only asked for their truth and get no type and text.
    """
    parsed = df.select("*", json_fields(value, names + flags).alias("_json"))
    fields = parsed.select(
        *df.columns,
        single_object(F.col("_json")).alias("_ok"),
        *[F.get("_json", F.lit(0))[name].alias(f"_v_{name}") for name in names + flags],
    )
    return _with_kind_and_text(fields, [JsonValue(name) for name in names])


def epoch_seconds_of(v: JsonValue) -> Column:
    return F.coalesce(v.number(), numeric_text(v.text))


def namespace_of(v: JsonValue) -> Column:
    digits = F.regexp_extract(strip(v.text), _INTEGER, 0)
    from_text = F.translate(digits, "_", "").try_cast("int")
    return F.when(v.absent, F.lit(0)).otherwise(F.coalesce(v.number().try_cast("int"), from_text))


def normalise(raw: DataFrame, value: str = "value") -> DataFrame:
    """Add ``event`` (the normalised struct) and ``reject_reason`` (null when the record is good)."""
    parsed = with_json_values(raw, F.col(value), TYPED_FIELDS, FLAG_FIELDS)
    field = {name: JsonValue(name) for name in TYPED_FIELDS + FLAG_FIELDS}
    meta, server = field["meta"], field["server_name"]
    domain = JsonValue("domain")
    nested = parsed.select(
        "*", F.when(meta.is_object, F.try_variant_get(meta.variant, "$.domain", "variant")).alias("_v_domain")
    )
    nested = _with_kind_and_text(nested, [domain])
    nested = nested.select("*", epoch_seconds_of(field["timestamp"]).alias("_seconds"))
    timestamp = F.coalesce(epoch_to_timestamp(F.col("_seconds")), iso_to_timestamp(field["timestamp"].text))
    typed = nested.select(
        *raw.columns,
        "_ok",
        (F.coalesce(meta.is_object, F.lit(False)) | ~meta.truthy()).alias("_meta_ok"),
        timestamp.alias("_timestamp"),
        field["title"].text_or("").alias("_title"),
        field["user"].text_or("unknown").alias("_user"),
        field["user"].text.alias("_given_user"),
        field["anonymous"].truthy().alias("_anonymous"),
        field["bot"].truthy().alias("_bot"),
        F.coalesce(field["comment"].text, F.lit("")).alias("_comment"),
        field["type"].text_or("edit").alias("_event_type"),
        namespace_of(field["namespace"]).alias("_namespace"),
        field["wiki"].text_or("").alias("_wiki"),
        F.when(domain.absent, server.text_or("")).otherwise(domain.text).alias("_server_name"),
    )

    reason = (
        F.when(~F.col("_ok"), F.lit("not_a_json_object"))
        .when(~F.col("_meta_ok"), F.lit("meta"))
        .when(F.col("_namespace").isNull(), F.lit("namespace"))
        .when(F.col("_timestamp").isNull(), F.lit("timestamp"))
        .when(F.coalesce(F.col("_title"), F.lit("")) == "", F.lit("title"))
        .when(F.col("_user").isNull(), F.lit("user"))
        .when(F.col("_event_type").isNull(), F.lit("event_type"))
        .when(F.col("_wiki").isNull(), F.lit("wiki"))
        .when(F.col("_server_name").isNull(), F.lit("server_name"))
    )
    event = F.struct(
        F.col("_timestamp").alias("timestamp"),
        F.col("_title").alias("title"),
        F.col("_user").alias("user"),
        (F.col("_anonymous") | looks_anonymous(F.col("_given_user"))).alias("anonymous"),
        F.col("_bot").alias("bot"),
        F.col("_comment").alias("comment"),
        F.col("_event_type").alias("event_type"),
        F.col("_namespace").alias("namespace"),
        F.col("_wiki").alias("wiki"),
        F.col("_server_name").alias("server_name"),
    )
    return typed.select(*raw.columns, event.alias("event"), reason.alias("reject_reason"))


def accepted(normalised: DataFrame) -> DataFrame:
    return normalised.where("reject_reason is null").select("event.*")


def rejected(normalised: DataFrame) -> DataFrame:
    return normalised.where("reject_reason is not null").drop("event")


def counter_columns(settings: Settings = DEFAULTS) -> list[Column]:
    """The four pipeline counters over a normalised frame; usable in ``agg`` and in ``observe``."""
    good = F.col("reject_reason").isNull()
    passes = ingest_condition(settings, prefix="event.")
    return [
        F.count_if(good).alias("total_received"),
        F.count_if(good & passes).alias("total_accepted"),
        F.count_if(good & ~passes).alias("total_filtered"),
        F.count_if(~good).alias("total_parse_errors"),
    ]


def with_drop_rate(counters: DataFrame) -> DataFrame:
    """``drop_rate`` is relative to parsed records, so it may pass 1; ``reject_share`` never does."""
    lost = F.col("total_filtered") + F.col("total_parse_errors")
    return counters.select(
        "*",
        share(lost, F.col("total_received")).alias("drop_rate"),
        share(lost, F.col("total_received") + F.col("total_parse_errors")).alias("reject_share"),
    )


def ingest_counters(normalised: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return with_drop_rate(normalised.agg(*counter_columns(settings)))


def extract_titles(
    records: DataFrame,
    column: str = "data",
    fallback_key: str | None = None,
    replace_bad_bytes: bool = True,
) -> DataFrame:
    """Title of each bus record (bytes or text); records without a usable title are dropped.

    ``fallback_key`` names a second key to try. Bad UTF-8 is either replaced or
    makes the record unusable.
    """
    text = F.col(column).cast("string")
    names = ("title",) + ((fallback_key,) if fallback_key else ())
    text = F.make_valid_utf8(text) if replace_bad_bytes else F.when(F.is_valid_utf8(text), text)
    parsed = with_json_values(records, text, names)
    values = [JsonValue(name) for name in names]
    usable = [F.when(v.truthy(), F.coalesce(v.text, F.to_json(v.variant))) for v in values]
    title = F.when(F.col("_ok"), F.coalesce(*usable))
    return parsed.select(*records.columns, title.alias("title")).where("title is not null")
