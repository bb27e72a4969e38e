"""Single-value functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline import schemas as S
from driftline.functions.compare import once

# The state a kind falls back to when none is declared.
DEFAULT_STATES = {
    "Processor": "STOPPED",
    "ProcessGroup": "STOPPED",
    "RegistryFlow": "STOPPED",
    "ControllerService": "DISABLED",
}

NOT_FOUND = "NOT_FOUND"
API_ERROR = "API_ERROR"

_SPACE = r"[\s\x0B\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def default_state(state: Column, kind: str) -> Column:
    """Null or ``''`` becomes the default state of ``kind``."""
    return F.coalesce(F.nullif(state, F.lit("")), F.lit(DEFAULT_STATES[kind]))


def drop_null_props(properties: Column) -> Column:
    """Remove null-valued keys; a null map stays null, an empty one empty."""
    return F.map_filter(properties, lambda k, v: v.isNotNull())


def classify_error(
    status: Column, text: Column, status_text: Column | None = None
) -> Column:
    """``NOT_FOUND`` or ``API_ERROR`` of a failed lookup.

    HTTP status 404 decides first. A typed API error (``status_text`` present) is
    then judged by its status text alone, anything else by its raw text, where
    "404" anywhere counts, even inside an id.
    """
    judged = text if status_text is None else F.coalesce(status_text, text)
    missing = F.coalesce(status == 404, F.lit(False)) | F.coalesce(
        F.contains(judged, F.lit("404")), F.lit(False)
    )
    return F.when(missing, F.lit(NOT_FOUND)).otherwise(F.lit(API_ERROR))


def error_context(
    operation: Column,
    key: Column,
    status: Column,
    text: Column,
    status_text: Column | None = None,
    body: Column | None = None,
    system: str = "",
) -> Column:
    """The message of a failed lookup, with the operation it belongs to.

    Only a typed API error carries its response body. ``system`` names the remote
    system at the front of the message.
    """
    head = f"{system} " if system else ""
    what = F.format_string("%s %s", operation, key.cast("string"))
    cause = text if status_text is None else F.coalesce(status_text, text)
    detail = F.lit("")
    if status_text is not None and body is not None:
        detail = F.when(
            status_text.isNotNull(),
            F.format_string(" (body: %s)", F.coalesce(body, F.lit(""))),
        ).otherwise(F.lit(""))
    return F.when(
        classify_error(status, text, status_text) == NOT_FOUND,
        F.concat(F.lit(f"{head}resource not found: "), what),
    ).otherwise(F.concat(F.lit(f"{head}API error: "), what, detail, F.lit(": "), cause))


def auth_mode(has_token: Column, has_user: Column, has_password: Column) -> Column:
    """How a config authenticates, from presence flags only; secrets stay outside."""
    return (
        F.when(has_token, F.lit("TOKEN"))
        .when(has_user & has_password, F.lit("TOKEN_EXCHANGE"))
        .otherwise(F.lit("NONE"))
    )


# Why a credential document cannot be used.
CONFIG_UNREADABLE = "cannot parse credentials"
CONFIG_WITHOUT_URL = "url is required"


def config_problem(credentials: Column) -> Column:
    """Why a credential document cannot be used, null where it can.

    It must be a JSON object whose known fields have their types, with a ``url``.
    Field names match in any case, the exact one first.
    """
    parsed = F.try_parse_json(credentials)
    kinds = (
        ("url", "STRING"),
        ("username", "STRING"),
        ("password", "STRING"),
        ("token", "STRING"),
        ("tlsSkipVerify", "BOOLEAN"),
    )

    def problem(fields: Column) -> Column:
        def value(name: str) -> Column:
            alike = F.map_filter(fields, lambda k, v: F.lower(k) == name.lower())
            return F.coalesce(
                F.try_element_at(fields, F.lit(name)),
                F.try_element_at(F.map_values(alike), F.lit(1)),
            )

        odd = F.lit(False)
        for name, wanted in kinds:
            shape = F.schema_of_variant(value(name))
            odd |= ~F.coalesce(shape.isin(wanted, "VOID"), F.lit(True))
        url = F.coalesce(F.try_variant_get(value("url"), "$", "string"), F.lit(""))
        return F.when(fields.isNull() | odd, F.lit(CONFIG_UNREADABLE)).when(
            url == "", F.lit(CONFIG_WITHOUT_URL)
        )

    # JSON null is a document without fields; anything else but an object has no map.
    read = F.try_variant_get(parsed, "$", "map<string,variant>")
    nothing = F.create_map().cast("map<string,variant>")
    is_null = F.schema_of_variant(parsed) == "VOID"
    return once(F.when(is_null, nothing).otherwise(read), problem)


def config_valid(credentials: Column) -> Column:
    return config_problem(credentials).isNull()


def is_stale(state: Column) -> Column:
    """Version-control states that are behind the registry; null is not stale."""
    return F.coalesce(state.isin(*S.STALE_STATES), F.lit(False))


def policy_allows(policies: Column, action: Column) -> Column:
    """Whether the management policies permit an action; none declared means all."""
    declared = F.coalesce(policies, F.array(*[F.lit(p) for p in S.DEFAULT_POLICIES]))
    return F.arrays_overlap(declared, F.array(F.lit("*"), action))


def token_url(url: Column) -> Column:
    """The token endpoint below a base URL; one trailing slash is dropped."""
    return F.concat(F.regexp_replace(url, "/$", ""), F.lit("/access/token"))


def token_text(body: Column) -> Column:
    """A token response without surrounding white space, null where nothing is left."""
    return F.nullif(F.regexp_replace(body, f"^{_SPACE}|{_SPACE}$", ""), F.lit(""))


def number_to_int(value: Column, prior: Column) -> Column:
    """A version that arrives as untyped JSON, cut to an integer.

    Only a JSON number counts; text, null or a value beyond 32 bits leaves ``prior``.
    """
    shape = F.schema_of_variant(value)
    numeric = (shape == "BIGINT") | (shape == "DOUBLE") | F.startswith(shape, F.lit("DECIMAL"))
    return F.coalesce(
        F.when(numeric, F.try_variant_get(value, "$", "double").try_cast("int")), prior
    )


def int_text(value: Column) -> Column:
    return value.cast("string")


# Unit names of the duration and size texts.
DURATION_UNITS_NS = {
    "ns|nano|nanos|nanosecond|nanoseconds": 1,
    "us|micro|micros|microsecond|microseconds": 1_000,
    "ms|milli|millis|millisecond|milliseconds": 1_000_000,
    "s|sec|secs|second|seconds": 1_000_000_000,
    "m|min|mins|minute|minutes": 60_000_000_000,
    "h|hr|hrs|hour|hours": 3_600_000_000_000,
    "d|day|days": 86_400_000_000_000,
    "w|wk|wks|week|weeks": 604_800_000_000_000,
}
SIZE_UNITS = {"B": 0, "KB": 1, "MB": 2, "GB": 3, "TB": 4}


def duration_ns(text: Column) -> Column:
    """``"30 sec"`` as nanoseconds; null for cron and other texts and unknown units. An
    extension: drift compares these fields as text."""
    pattern = r"^\s*(\d+(?:\.\d+)?)\s*([A-Za-z]+)\s*$"
    amount = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    factor = F.lit(None).cast("double")
    for names, ns in DURATION_UNITS_NS.items():
        factor = F.when(unit.isin(*names.split("|")), F.lit(float(ns))).otherwise(factor)
    return F.round(amount * factor).cast("bigint")


def duration_ms(text: Column) -> Column:
    """``duration_ns`` in whole milliseconds, rounded."""
    return F.round(duration_ns(text) / 1_000_000).cast("bigint")


def size_bytes(text: Column) -> Column:
    """``"1 GB"`` as bytes, null for other texts. An extension, as ``duration_ms``."""
    pattern = r"^\s*(\d+(?:\.\d+)?)\s*([KMGTkmgt]?[Bb])\s*$"
    amount = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")
    unit = F.upper(F.regexp_extract(text, pattern, 2))
    factor = F.lit(None).cast("double")
    for name, power in SIZE_UNITS.items():
        factor = F.when(unit == name, F.lit(float(1024**power))).otherwise(factor)
    return F.round(amount * factor).cast("bigint")
