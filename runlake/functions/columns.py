"""Scalar functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beginnings of model names and who makes them; the first that fits counts.
MODEL_PROVIDERS = [
    ("gemini", "Google"),
    ("gpt-", "OpenAI"),
    ("o1", "OpenAI"),
    ("o3", "OpenAI"),
    ("o4", "OpenAI"),
    ("llama", "Meta"),
    ("meta-llama", "Meta"),
    ("sonar", "Perplexity"),
    ("qwen", "Alibaba"),
    ("grok", "xAI"),
    ("x-ai/", "xAI"),
    ("claude", "Anthropic"),
    ("mistral", "Mistral"),
    ("deepseek", "DeepSeek"),
    ("command", "Cohere"),
]
UNKNOWN = "unknown"
#: Texts of so many signs are inline media if they begin like base64.
MEDIA_LENGTH = 10_000
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_sum(c: Column | str) -> Column:
    """A sum of money in decimals: exact, so it does not depend on the order of adding up."""
    return F.sum(_col(c).cast("decimal(38,12)"))


def or_unknown(c: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(UNKNOWN))


def as_utc(c: Column | str) -> Column:
    """A timestamp; one without a zone is taken as UTC (with the session zone UTC)."""
    return _col(c).cast("timestamp")


def latency_seconds(start: Column | str = "start_time", end: Column | str = "end_time") -> Column:
    """Seconds from start to end; null if the run has not ended."""
    return (F.unix_micros(as_utc(end)) - F.unix_micros(as_utc(start))) / F.lit(1e6)


def display_model(invocation_model_name: Column, metadata_model_name: Column, max_length: int = 20) -> Column:
    """The model name for people: the invocation's, else the metadata's, else '-', cut to `max_length`."""
    name = F.coalesce(F.nullif(invocation_model_name, F.lit("")), F.nullif(metadata_model_name, F.lit("")), F.lit("-"))
    return F.when(F.length(name) > max_length, F.concat(F.left(name, F.lit(max_length - 3)), F.lit("..."))).otherwise(name)


def full_model(metadata_model_name: Column, invocation_model: Column, invocation_model_name: Column) -> Column:
    """The model name for accounts: the metadata's, else the invocation's; an empty `model` there hides `model_name`."""
    return F.coalesce(F.nullif(metadata_model_name, F.lit("")), F.nullif(F.coalesce(invocation_model, invocation_model_name), F.lit("")), F.lit(UNKNOWN))


def title_case(c: Column) -> Column:
    """Capitals after every sign that is no letter."""
    return F.array_join(F.transform(F.split(F.lower(c), "(?<=[^a-z])"), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2)))), "")


def provider(model: Column | str, gateway: Column | str) -> Column:
    """Who makes a model: by the beginning of its name, or of a part after a slash; else the gateway."""
    name, out = F.lower(_col(model)), None
    for prefix, who in MODEL_PROVIDERS:
        fits = name.startswith(prefix) | name.contains(f"/{prefix}")
        out = F.when(fits, who) if out is None else out.when(fits, who)
    return out.when(_col(gateway) != UNKNOWN, title_case(_col(gateway))).otherwise(UNKNOWN)


def tag_value(tags: Column | str, field: str) -> Column:
    """What follows `field:` in the first tag that begins so; null if there is none."""
    hit = F.get(F.filter(_col(tags), lambda t: t.startswith(f"{field}:")), F.lit(0))
    return F.substr(hit, F.lit(len(field) + 2))


def group_value(kind: str, field: str, tags: Column | str = "tags", metadata: Column | str = "metadata") -> Column:
    """The value that groups a run by a tag prefix ('tag') or a metadata key ('metadata')."""
    if kind not in ("tag", "metadata"):
        raise ValueError(f"cannot group by {kind!r}: use 'tag' or 'metadata'")
    return tag_value(tags, field) if kind == "tag" else _col(metadata)[field]


def tag_key(tag: Column | str) -> Column:
    return F.substring_index(_col(tag), ":", 1)


def tag_rest(tag: Column | str) -> Column:
    """What follows the first colon of a tag; null for a tag without one."""
    at = F.instr(_col(tag), ":")
    return F.when(at > 0, F.substr(_col(tag), at + 1))


def input_context(inputs: Column | str) -> Column:
    """community_name, channel_id, channel_name of `channel_info`, which is an object or JSON text."""
    info = F.get_json_object(_col(inputs), "$.channel_info")
    return F.struct(*(F.get_json_object(info, f"$.{k}").alias(k) for k in ("community_name", "channel_id", "channel_name")))


def time_bucket(start: Column | str, interval: str) -> Column:
    """Label of the UTC hour (2024-01-31T07:00Z) or day (2024-01-31); 'unknown' without a time."""
    t = as_utc(start)
    if interval == "hour":
        label = F.date_format(F.date_trunc("HOUR", t), "yyyy-MM-dd'T'HH:00'Z'")
    elif interval == "day":
        label = F.date_format(t, "yyyy-MM-dd")
    else:
        raise ValueError(f"no such interval: {interval!r}")
    return F.coalesce(label, F.lit(UNKNOWN))


def _placeholder(t: Column) -> Column:
    """What stands for one text that is inline media; null for any other text."""
    n = F.length(t).cast("string")
    kind = F.regexp_extract(F.left(t, F.lit(100)), "^data:([^;]*);base64,", 1)
    uri = t.startswith("data:") & F.left(t, F.lit(100)).contains(";base64,")
    plain = (F.length(t) >= MEDIA_LENGTH) & F.left(t, F.lit(200)).rlike("^[A-Za-z0-9+/=\\n\\r ]*$")
    return F.when(uri, F.concat(F.lit("[binary:"), kind, F.lit(":"), n, F.lit("bytes:...]"))).when(plain, F.concat(F.lit("[binary:base64:"), n, F.lit("bytes:...]")))


def _quoted(t: Column) -> Column:
    """A text, not null, as the inside of a JSON string."""
    json = F.to_json(F.array(t))
    return F.substr(json, F.lit(3), F.length(json) - 4)


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of `c`, which is worked out once however often `f` names it; in lambdas Spark shares no expressions."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _strip_inside(json: Column) -> Column:
    """JSON text whose string values, at any depth, are placeholders where they are inline media; keys stay.

    With pairs of backslashes and escaped quotes out of the way (control characters never occur in JSON text)
    quotes part it into what is outside and inside of strings, in turn. One pass over the text.
    """
    pair, quote = "\x01", "\x02"
    hidden = F.replace(F.replace(json, F.lit("\\\\"), F.lit(pair)), F.lit('\\"'), F.lit(quote))

    def replaced(raw: Column) -> Column:
        """The inside of a string, replaced where it is media; only one with escapes is parsed."""
        escaped = F.get(F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>"), F.lit(0))
        value = F.when(F.contains(raw, F.lit("\\")), escaped).otherwise(raw)
        return _bound(_bound(value, _placeholder), lambda p: F.when(p.isNotNull(), _quoted(p)).otherwise(raw))

    def shown(parts: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            raw = F.replace(F.replace(part, F.lit(quote), F.lit('\\"')), F.lit(pair), F.lit("\\\\"))
            inside = (i % 2 == 1) & ~F.ltrim(F.get(parts, i + 1)).startswith(":") & (part.startswith("data:") | (F.length(part) >= MEDIA_LENGTH))
            return F.when(inside, _bound(raw, replaced)).otherwise(raw)

        return F.array_join(F.transform(parts, one), '"')

    return _bound(F.split(hidden, '"'), shown)


def strip_binary(text: Column | str) -> Column:
    """Inline media as a placeholder: data URIs, and long texts that begin with 200 signs of base64. In JSON objects and lists every string value is looked at."""
    t = _col(text)
    media = F.contains(t, F.lit(";base64,")) | (F.length(t) >= MEDIA_LENGTH)
    nested = media & F.ltrim(t).rlike("^[{\\[]") & F.try_parse_json(t).isNotNull()
    return F.when(F.coalesce(nested, F.lit(False)), _strip_inside(t)).otherwise(F.coalesce(_placeholder(t), t))


def looks_like_uuid(c: Column | str) -> Column:
    return _col(c).rlike(UUID_PATTERN)


def name_tokens(c: Column | str) -> Column:
    """Parts of a name between / - _ and dots, in small letters."""
    return F.array_remove(F.split(F.lower(_col(c)), "[/\\-_.]"), "")


def json_text(*columns: Column | str) -> Column:
    """Canonical JSON text of a row: nulls kept, no spaces after separators."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def value_type(v: Column | str) -> Column:
    """Label of a VARIANT value: str, int, float, bool, dict, list or null."""
    kind = F.schema_of_variant(_col(v))
    return (
        F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "bool").when(kind == "STRING", "str").when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "float").when(kind.startswith("OBJECT"), "dict").when(kind.startswith("ARRAY"), "list").otherwise(F.lower(kind))
    )
