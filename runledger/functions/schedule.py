"""Calendar functions: intervals and five-field cron expressions, all in UTC milliseconds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE, DAY = 60_000, 86_400_000
#: How far back a cron schedule looks for its last fire.
LOOKBACK_MS = 32 * 24 * 60 * MINUTE
# Fields of an expression with their least and greatest values.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))


@dataclass(frozen=True)
class Field:
    values: tuple[int, ...]
    any: bool


def parse_field(text: str, low: int, high: int) -> Field:
    """Values of one field: `*`, N, N-M, each with /S, in lists. N/S is just N."""
    found: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if step and (not step.isdigit() or int(step) == 0) or part.endswith("/"):
            raise ValueError(f"bad step in {part!r}")
        a, dash, b = span.partition("-")
        ends = (low, high) if span == "*" else (int(a), int(b) if dash else int(a)) if a.isdigit() and (not dash or b.isdigit()) else None
        if ends is None or not low <= ends[0] <= ends[1] <= high:
            raise ValueError(f"bad values in {part!r}")
        found.update(range(ends[0], ends[1] + 1, int(step or 1)))
    return Field(tuple(sorted(found)), text == "*")


def parse_cron(expression: str) -> dict[str, Field]:
    parts = expression.split()
    if len(parts) != len(FIELDS):
        raise ValueError("a cron expression has five fields")
    out = {name: parse_field(p, low, high) for p, (name, low, high) in zip(parts, FIELDS, strict=True)}
    w = out["weekday"]
    out["weekday"] = Field(tuple(sorted({v % 7 for v in w.values})), w.any)
    return out


def every(n: int, unit: str = "minutes") -> int:
    """An interval in milliseconds."""
    if n <= 0:
        raise ValueError("an interval must be positive")
    return n * {"milliseconds": 1, "seconds": 1000, "minutes": MINUTE, "hours": 60 * MINUTE}[unit]


def floor_to_minute(ms: Column) -> Column:
    return ms - F.pmod(ms, F.lit(MINUTE))


def utc_parts(ms: Column) -> dict[str, Column]:
    """minute, hour, day, month, weekday (0 is Sunday); the session's time zone must be UTC."""
    t = F.timestamp_millis(ms)
    return {"minute": F.minute(t), "hour": F.hour(t), "day": F.dayofmonth(t), "month": F.month(t), "weekday": F.dayofweek(t) - 1, "year": F.year(t)}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once a row, however often use names it: a column expression has no variables but those of lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cron_values(field: Column, low: int, high: int) -> Column:
    """The values of one field of an expression in a column, as parse_field has them; null for a bad field."""
    form = r"^(?:([*])|([0-9]+)(?:-([0-9]+))?)(?:/([0-9]+))?$"

    def read(part: Column) -> Column:
        groups = [F.regexp_extract(part, form, i) for i in range(1, 5)]  # all empty where the part has another form
        return F.struct(*[g.alias(n) for g, n in zip(groups, ("star", "first", "last", "step"), strict=True)])

    def ends(g: Column) -> Column:
        star = g["star"] == "*"
        first = F.when(star, F.lit(low)).otherwise(g["first"].try_cast("int"))
        last = F.when(star, F.lit(high)).otherwise(F.when(g["last"] == "", g["first"]).otherwise(g["last"]).try_cast("int"))
        return F.struct(first.alias("first"), last.alias("last"), F.when(g["step"] == "", F.lit(1)).otherwise(g["step"].try_cast("int")).alias("step"))

    def values(e: Column) -> Column:
        good = (e["first"] >= low) & (e["first"] <= e["last"]) & (e["last"] <= high) & (e["step"] > 0)
        return F.when(good, F.sequence(e["first"], e["last"], e["step"]))

    return F.array_distinct(F.flatten(F.transform(F.transform(F.transform(F.split(field, ","), read), ends), values)))


def cron_fields(expression: Column | str) -> Column:
    """A struct of the fields' values and of whether day and weekday are `*`; null for an expression that is not valid.

    7 as a weekday is Sunday, like 0. An expression in a column is read once a row, one given as text once in all.
    """
    if isinstance(expression, str):
        return _cron_literal(expression)

    def fields(texts: Column) -> Column:
        values = [cron_values(F.get(texts, F.lit(i)), low, high).alias(name) for i, (name, low, high) in enumerate(FIELDS)]
        stars = [(F.get(texts, F.lit(i)) == "*").alias(name) for i, name in ((2, "any_day"), (4, "any_weekday"))]
        return F.when(F.size(texts) == len(FIELDS), F.struct(*values, *stars))

    def checked(c: Column) -> Column:
        names = [name for name, _, _ in FIELDS[:4]]
        weekday = F.array_distinct(F.transform(c["weekday"], lambda v: v % 7)).alias("weekday")
        valid = c.isNotNull() & c["weekday"].isNotNull()
        for name in names:
            valid &= c[name].isNotNull()
        return F.when(valid, F.struct(*[c[n].alias(n) for n in names], weekday, c["any_day"].alias("any_day"), c["any_weekday"].alias("any_weekday")))

    return bound(bound(F.split(F.trim(expression), r"\s+"), fields), checked)


def _cron_literal(expression: str) -> Column:
    """cron_fields of one expression for all rows, as literals."""
    try:
        cron = parse_cron(expression)
    except ValueError:
        arrays = ", ".join(f"{name}: array<int>" for name, _, _ in FIELDS)
        return F.lit(None).cast(f"struct<{arrays}, any_day: boolean, any_weekday: boolean>")
    values = [F.array(*map(F.lit, f.values)).alias(name) for name, f in cron.items()]
    return F.struct(*values, F.lit(cron["day"].any).alias("any_day"), F.lit(cron["weekday"].any).alias("any_weekday"))


def _day_matches(cron: Column, day: Column, month: Column, weekday: Column) -> Column:
    """By either field if day and weekday are both restricted, else by both."""
    on_day, on_weekday = F.array_contains(cron["day"], day), F.array_contains(cron["weekday"], weekday)
    either = ~cron["any_day"] & ~cron["any_weekday"]
    return F.array_contains(cron["month"], month) & F.when(either, on_day | on_weekday).otherwise(on_day & on_weekday)


def cron_matches(ms: Column, cron: Column) -> Column:
    """Whether an instant's minute is one of cron_fields; null where the expression is not valid."""
    at = utc_parts(ms)
    return F.array_contains(cron["minute"], at["minute"]) & F.array_contains(cron["hour"], at["hour"]) & _day_matches(cron, at["day"], at["month"], at["weekday"])


def interval_fire(now: Column, every_ms: Column) -> Column:
    """The last multiple of the interval; null for one that is not positive."""
    return F.when(every_ms > 0, now - F.pmod(now, every_ms))


def previous_cron_fire(now: Column, cron: Column, lookback_ms: int = LOOKBACK_MS) -> Column:
    """The last minute of cron_fields from now's minute back to that less the look-back, both included, or null.

    Days are tried, not minutes: of each day in reach, its last fire is the largest hour and minute, and of the
    first day the largest that is not after now.
    """
    if lookback_ms < 0:
        raise ValueError("a look-back cannot be negative")
    top = floor_to_minute(now)
    today = F.floor(top / DAY).cast("int")
    at = F.pmod(top, F.lit(DAY)) / MINUTE
    hour, minute = F.floor(at / 60).cast("int"), (at % 60).cast("int")
    latest = F.array_max(cron["hour"]) * 60 + F.array_max(cron["minute"])
    this_hour = F.when(F.array_contains(cron["hour"], hour), hour * 60 + F.array_max(F.filter(cron["minute"], lambda m: m <= minute)))
    earlier = F.array_max(F.filter(cron["hour"], lambda h: h < hour)) * 60 + F.array_max(cron["minute"])
    of_days = F.struct(today.alias("today"), F.greatest(this_hour, earlier).alias("first"), latest.alias("other"))
    days = F.sequence(F.lit(0), F.lit(lookback_ms // DAY + 1))

    def fire(of: Column, back: Column) -> Column:
        day = of["today"] - back
        date = F.date_from_unix_date(day)
        of_day = F.when(back == 0, of["first"]).otherwise(of["other"])
        return F.when(_day_matches(cron, F.dayofmonth(date), F.month(date), F.pmod(day + 4, F.lit(7))), (day.cast("long") * (DAY // MINUTE) + of_day) * MINUTE)

    last = bound(of_days, lambda of: F.array_max(F.transform(days, lambda back: fire(of, back))))
    return bound(last, lambda at: F.when(at >= top - lookback_ms, at))


def materialize(schedules: DataFrame, now: int, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    """schedule_id, verdict, fire_at of schedules (schedule_id, every_ms or cron, enabled): disabled; error, for an interval
    that is not positive, an expression that is not valid, or neither; not_due; materialized. One pass, no shuffle."""
    at = F.lit(now).cast("long")
    rows = schedules.withColumn("_cron", cron_fields(F.col("cron"))) if "cron" in schedules.columns else schedules.withColumn("_cron", cron_fields(F.lit(None).cast("string")))
    by_interval = F.col("every_ms").isNotNull()
    fire = F.when(by_interval, interval_fire(at, F.col("every_ms"))).otherwise(previous_cron_fire(at, F.col("_cron"), lookback_ms))
    bad = F.when(by_interval, F.col("every_ms") <= 0).otherwise(F.col("_cron").isNull())
    rows = rows.withColumn("_fire", fire)
    verdict = F.when(~F.col("enabled"), "disabled").when(bad, "error").when(F.col("_fire").isNull(), "not_due").otherwise("materialized")
    return rows.select("schedule_id", verdict.alias("verdict"), F.when(verdict == "materialized", F.col("_fire")).alias("fire_at"))
