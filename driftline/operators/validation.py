"""Admission rules of the kinds, as a list of violations per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline import schemas as S
from driftline.functions import compare as C
from driftline.kinds import KINDS, dig


def required_violations(kind: str, desired: Column) -> Column:
    """Fields that are absent. Present is not the same as non-empty: ``''`` passes.

    A field of an optional or absent record is not asked for; ``list[].field`` asks
    every entry of a list.
    """
    found = []
    for path in KINDS[kind].required:
        label = f"{path} required"
        if "[]." in path:
            items, name = path.split("[].")
            hollow = F.exists(dig(desired, items), lambda e: e[name].isNull())  # noqa: B023
            found.append(C.reason(hollow, label))
            continue
        absent = dig(desired, path).isNull()
        if "." in path:
            absent &= dig(desired, path.rsplit(".", 1)[0]).isNotNull()
        found.append(C.reason(absent, label))
    return F.when(desired.isNull(), F.array(F.lit("forProvider required"))).otherwise(
        F.concat(*found)
    )


def reference_violations(reference: Column) -> Column:
    """A stated config reference needs its kind and its name."""
    return F.concat(
        *[
            C.reason(
                reference.isNotNull() & reference[n].isNull(), f"providerConfigRef.{n} required"
            )
            for n in ("kind", "name")
        ]
    )


def enum_violation(value: Column, allowed: tuple, path: str) -> Column:
    """``["<path> unsupported"]`` for a stated value outside its set; null passes."""
    return C.reason(value.isNotNull() & ~value.isin(*allowed), f"{path} unsupported")


def enum_violations(kind: str, desired: Column) -> Column:
    return F.concat(
        C.no_reasons(),
        *[enum_violation(dig(desired, p), allowed, p) for p, allowed in KINDS[kind].enums.items()],
    )


def policy_violations(policies: Column) -> Column:
    """Management actions outside the known set."""
    unknown = F.exists(policies, lambda p: ~p.isin(*S.MANAGEMENT_ACTIONS))
    return C.reason(unknown, "managementPolicies unsupported")


def config_violations(source: Column, version: Column) -> Column:
    """Rules of a configuration record: credential source and system version."""
    return F.concat(
        C.reason(source.isNull(), "credentials.source required"),
        enum_violation(source, S.CREDENTIAL_SOURCES, "credentials.source"),
        enum_violation(version, S.SYSTEM_VERSIONS, "systemVersion"),
    )


def validate(df: DataFrame, kind: str, desired: str = "desired") -> DataFrame:
    """Add ``violations``: absent required fields, then values outside their sets.

    ``managementPolicies`` and ``providerConfigRef`` are checked where they are columns.
    """
    d = F.col(desired)
    found = [required_violations(kind, d), enum_violations(kind, d)]
    if "providerConfigRef" in df.columns:
        found.append(reference_violations(F.col("providerConfigRef")))
    if "managementPolicies" in df.columns:
        found.append(policy_violations(F.col("managementPolicies")))
    return df.withColumn("violations", F.concat(*found))


#: Variant shapes that satisfy a declared type.
_SHAPES = {
    "string": lambda s: s == "STRING",
    "integer": lambda s: (s == "BIGINT") | F.startswith(s, F.lit("DECIMAL")) & F.endswith(s, F.lit(",0)")),
    "number": lambda s: s.isin("BIGINT", "DOUBLE") | F.startswith(s, F.lit("DECIMAL")),
    "boolean": lambda s: s == "BOOLEAN",
}


def typed_violations(parsed: Column, types: dict[str, str]) -> Column:
    """Fields of a parsed JSON document whose values do not have their declared type."""
    found = []
    for path, wanted in types.items():
        value = F.try_variant_get(parsed, f"$.{path}", "variant")
        shape = F.schema_of_variant(value)
        stated = value.isNotNull() & (shape != "VOID")
        if wanted == "string_map":
            entries = F.try_variant_get(value, "$", "map<string,variant>")
            odd = F.exists(
                F.map_values(entries),
                lambda v: ~F.schema_of_variant(v).isin("STRING", "VOID"),
            )
            bad = stated & (entries.isNull() | odd)
        else:
            bad = stated & ~_SHAPES[wanted](shape)
        found.append(C.reason(bad, f"{path} not {wanted}"))
    return F.concat(C.no_reasons(), *found)


def validate_typed(df: DataFrame, document: str, types: dict[str, str]) -> DataFrame:
    """Add ``violations`` of a JSON text column against declared field types.

    ``types`` maps JSON paths (``config.labelIndex``) to ``string``, ``integer``,
    ``number``, ``boolean`` or ``string_map``. Absent fields and JSON nulls pass; text
    that is no JSON at all is one violation of its own.
    """
    parsed = F.col("_parsed")
    unreadable = F.col(document).isNotNull() & parsed.isNull()
    found = F.when(unreadable, F.array(F.lit("not JSON"))).otherwise(typed_violations(parsed, types))
    return (
        df.withColumn("_parsed", F.try_parse_json(document))
        .withColumn("violations", found)
        .drop("_parsed")
    )
