"""Scalar functions over JSON, keys, retries and deadlines."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = 2**63 - 1
# Schemas of JSON values by kind.
_KINDS = {"string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DOUBLE|DECIMAL)", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY"}


def escape_pointer(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _diff(old: object, new: object, path: str, out: list[dict]) -> None:
    if isinstance(old, dict) and isinstance(new, dict):
        for key in sorted(old.keys() | new.keys()):
            at = path + "/" + key.replace("~", "~0").replace("/", "~1")
            if key not in new:
                out.append({"op": "remove", "path": at, "value": None})
            elif key not in old:
                out.append({"op": "add", "path": at, "value": json.dumps(new[key])})
            else:
                _diff(old[key], new[key], at, out)
    elif isinstance(old, list) and isinstance(new, list) and len(old) == len(new):
        for i, (a, b) in enumerate(zip(old, new, strict=True)):
            _diff(a, b, f"{path}/{i}", out)
    elif type(old) is not type(new) or old != new:
        out.append({"op": "replace", "path": path, "value": json.dumps(new)})


def diff_state(old: Column | str, new: Column | str) -> Column:
    """The RFC 6902 operations that turn one JSON text into another; values are JSON texts; null counts as JSON null.

    Trees have any depth, which expressions cannot walk; each row is worked out alone, in Arrow batches. The result is null
    where either text is no JSON.
    """

    @F.pandas_udf("array<struct<op: string, path: string, value: string>>")
    def diff(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for olds, news in batches:
            rows = []
            for a, b in zip(olds, news, strict=True):
                out: list[dict] | None = []
                try:
                    _diff(json.loads("null" if a is None else a), json.loads("null" if b is None else b), "", out)
                except ValueError:
                    out = None
                rows.append(out)
            yield pd.Series(rows, dtype=object)

    return diff(old, new)


def merged(old: Column, new: Column) -> Column:
    """A shallow merge of maps; the right side wins."""
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))), F.map_entries(new)))


def is_json_null(text: Column, path: str) -> Column:
    """Whether the value is there and null; null where there is no such key."""
    return F.is_variant_null(F.variant_get(F.parse_json(text), path, "variant"))


def field(text: Column, path: str, kind: str) -> Column:
    """A typed field of a JSON text, null where it is missing or of another kind."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def typed(text: Column, schema: str) -> Column:
    """The JSON text as a struct; text that does not fit is an error."""
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def payload_faults(text: Column, fields: dict[str, tuple[str, bool]]) -> Column:
    """What keeps a JSON text from having a shape, as an array: not_json, not_object, missing:name, type:name.

    fields: name -> (kind, required); kinds are string, integer, number, boolean, object, array. A field that is
    not required may also be null; fields that are not named are ignored.
    """
    value = F.try_parse_json(text)
    shape = F.schema_of_variant(value)

    def fault(name: str, kind: str, required: bool) -> Column:
        got = F.schema_of_variant(F.try_variant_get(value, f"$['{name}']", "variant"))
        absent = got.isNull() | (got == "VOID") if not required else got.isNull()
        wrong = F.when(absent, F.concat(F.lit("missing:"), F.lit(name)) if required else F.lit(None).cast("string"))
        return wrong.when(~F.coalesce(got.rlike(_KINDS[kind]), F.lit(False)), F.concat(F.lit("type:"), F.lit(name)))

    found = F.array_compact(F.array(*[fault(n, k, r) for n, (k, r) in fields.items()])) if fields else F.array().cast("array<string>")
    return F.when(value.isNull(), F.array(F.lit("not_json"))).when(~shape.startswith("OBJECT"), F.array(F.lit("not_object"))).otherwise(found)


def first_fault(stages: dict[str, Column]) -> Column:
    """stage:fault of the first stage (input, state, output) that has a fault; null where all are valid."""
    return F.coalesce(*[F.when(F.size(faults) > 0, F.concat(F.lit(f"{stage}:"), F.get(faults, F.lit(0)))) for stage, faults in stages.items()])


def backoff_ms(attempt: Column, base_ms: int, most_ms: int = LONG_MAX) -> Column:
    """base * 2^(attempt - 1), no more than most_ms, without overflow."""
    n = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(62))
    doubled = F.lit(base_ms).cast("decimal(19,0)") * F.pow(F.lit(2), n).cast("decimal(19,0)")
    return F.least(doubled, F.lit(most_ms).cast("decimal(38,0)")).cast("long")


def deadline(explicit: Column, started: Column, max_ms: Column) -> Column:
    """The earlier of an explicit deadline and the start plus the longest duration; null if neither is set."""
    return F.least(explicit, started + max_ms)


def should_stop(deadline_ms: Column, now: Column, least_ms: int = 1000) -> Column:
    return F.coalesce(deadline_ms - now <= least_ms, F.lit(False))


def should_yield(deadline_ms: Column, now: Column, least_ms: int = 1000) -> Column:
    return F.coalesce(deadline_ms - now < least_ms, F.lit(False))


def events_truncated(event_count: Column, max_events: Column) -> Column:
    """True or null, never false."""
    return F.when(event_count > max_events, True)


def kept_events(ordinal: Column, max_events: int, include: bool = True) -> Column:
    return (ordinal < max_events) & F.lit(include)


def key(*parts: str | Column) -> Column:
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])
