"""Data-quality rules. Every rule is a column: the first violated rule's message, or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fences
from tessera.functions.text import blank, trim_option, utrim
from tessera.limits import (
    BUDGET_MAX,
    BUDGET_MIN,
    GLOBAL_SCOPE,
    KINDS,
    MAX_BODY_BYTES,
    MAX_ITEMS,
    MAX_LABEL_IDS,
    MAX_LABEL_PART_BYTES,
    MAX_NAME_BYTES,
    MAX_PAGE,
    MAX_PROVENANCE_BYTES,
    MAX_QUERY_BYTES,
    MAX_SOURCES,
    MAX_TITLE_BYTES,
)

# Wording of the messages.
SINGLE_LINE = "{} must be a non-empty single line of at most {} bytes"
TOO_LONG = "{} exceeds {} bytes"
EMPTY = "{} must not be empty"
POSITIVE = "{} must be positive"
TOO_MANY = "{} cannot contain more than {} items"
NEEDS_SOURCE = "{} requires at least one source"
NEEDS_LABEL = "record requires at least one active label"
NEEDS_IMPORT_SOURCE = "imported snippet requires a source with locator and content_hash"
NOT_FINITE = "metric value must be finite"
BOTH_TIMES = "metric cannot have both observed_at and interval"
INTERVAL_ORDER = "metric interval end must not precede start"
NOT_RFC3339 = "{} must be an RFC 3339 timestamp"
LABEL_PART = "{} must contain only lowercase ASCII letters, digits, underscore, or hyphen"
QUERY_TOO_LONG = "search query exceeds {} bytes"
LIMIT_RANGE = "limit must be between 1 and {}"
BUDGET_RANGE = "max_bytes must be between {} and {}"
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def first_error(*errors: Column) -> Column:
    return F.coalesce(*errors)


def error_if(bad: Column, message: str) -> Column:
    return F.when(bad, F.lit(message))


def single_line(name: str, value: Column, max_bytes: int, required: bool = True) -> Column:
    trimmed = utrim(value)
    bad = (trimmed == "") | (F.octet_length(trimmed) > max_bytes) | trimmed.rlike(r"[\r\n]")
    if required:
        bad = value.isNull() | bad
    return error_if(bad, SINGLE_LINE.format(name, max_bytes))


def text(
    name: str, value: Column, required: bool = True, nonempty: bool = True, fenced: bool = True
) -> Column:
    errors = [error_if(F.octet_length(value) > MAX_BODY_BYTES, TOO_LONG.format(name, MAX_BODY_BYTES))]
    if nonempty:
        empty = blank(value)
        errors.append(error_if(value.isNull() | empty if required else empty, EMPTY.format(name)))
    if fenced:
        errors.append(fences.fence_error(value))
    return first_error(*errors)


def timestamp(value: Column) -> Column:
    """The instant of an RFC 3339 text, or null. The pattern comes first because Spark's own
    parser also takes dates and words such as ``yesterday``."""
    plain = F.regexp_replace(F.upper(value), r"^(.{10}) ", "$1T")
    return F.when(value.rlike(RFC3339), F.try_to_timestamp(plain))


def timestamp_error(name: str, value: Column) -> Column:
    return error_if(value.isNotNull() & timestamp(value).isNull(), NOT_RFC3339.format(name))


def positive(name: str, value: Column) -> Column:
    return error_if(value.isNull() | (value <= 0), POSITIVE.format(name))


def at_most(name: str, items: Column, limit: int) -> Column:
    return error_if(F.size(items) > limit, TOO_MANY.format(name, limit))


def first_in(items: Column, rule) -> Column:
    """First error that ``rule`` finds in an array."""
    return F.get(F.filter(F.transform(items, rule), lambda e: e.isNotNull()), F.lit(0))


def source(s: Column) -> Column:
    optional = [("locator", "source locator"), ("version", "source version"),
                ("content_hash", "source content_hash"), ("anchor", "source anchor")]
    return first_error(
        single_line("source identity", s["identity"], MAX_NAME_BYTES),
        *[single_line(name, s[f], MAX_NAME_BYTES, required=False) for f, name in optional],
        text("source quote", s["quote"], required=False, nonempty=False),
    )


def _metric(p: Column) -> Column:
    value = p["value"]
    start, end = timestamp(p["interval"]["start"]), timestamp(p["interval"]["end"])
    has_interval = p["interval"].isNotNull()
    infinite = F.lit(float("inf"))
    return first_error(
        single_line("name", p["name"], MAX_NAME_BYTES),
        single_line("unit", p["unit"], MAX_NAME_BYTES),
        error_if(value.isNull() | F.isnan(value) | (F.abs(value) == infinite), NOT_FINITE),
        error_if(p["observed_at"].isNotNull() & has_interval, BOTH_TIMES),
        timestamp_error("observed_at", p["observed_at"]),
        error_if(has_interval & start.isNull(), NOT_RFC3339.format("interval.start")),
        error_if(has_interval & end.isNull(), NOT_RFC3339.format("interval.end")),
        error_if(has_interval & (end < start), INTERVAL_ORDER),
        at_most("dimensions", p["dimensions"], MAX_ITEMS),
        first_in(
            F.array_sort(F.map_entries(p["dimensions"])),
            lambda e: first_error(
                single_line("dimension key", e["key"], MAX_NAME_BYTES),
                single_line("dimension value", e["value"], MAX_NAME_BYTES),
            ),
        ),
    )


def _after_snippet(p: Column, sources: Column) -> Column:
    usable = F.exists(
        sources,
        lambda s: trim_option(s["locator"]).isNotNull() & trim_option(s["content_hash"]).isNotNull(),
    )
    return first_error(
        single_line("runtime", p["runtime"], MAX_NAME_BYTES, required=False),
        at_most("dependencies", p["dependencies"], MAX_ITEMS),
        first_in(p["dependencies"], lambda d: single_line("dependency", d, MAX_NAME_BYTES)),
        error_if(
            (p["origin"] == "imported") & ~F.coalesce(usable, F.lit(False)), NEEDS_IMPORT_SOURCE
        ),
    )


# The long texts of each kind in declared order; the first one is required.
TEXTS = {
    "note": ["body"],
    "observation": ["statement"],
    "decision": ["choice", "question", "rationale"],
    "idea": ["proposal"],
    "snippet": ["code"],
    "metric": ["method"],
    "evidence": ["claim", "action", "outcome", "impact"],
}


def _long_texts(p: Column) -> Column:
    """Rules of the long texts, as one expression for all kinds. Code may hold open blocks, and
    the method of a metric may be absent."""
    listed = None
    for kind, names in TEXTS.items():
        fields = F.array(
            *[
                F.struct(
                    F.lit(name).alias("name"),
                    p[name].alias("value"),
                    F.lit(i == 0 and kind != "metric").alias("required"),
                    F.lit(name != "code").alias("fenced"),
                )
                for i, name in enumerate(names)
            ]
        )
        test = p["kind"] == kind
        listed = F.when(test, fields) if listed is None else listed.when(test, fields)

    def rule(field: Column) -> Column:
        value = field["value"]
        long = F.octet_length(value) > MAX_BODY_BYTES
        missing = F.when(value.isNull(), field["required"]).otherwise(blank(value))
        before_long, after_long = TOO_LONG.split("{}", 1)
        return (
            F.when(long, F.concat(F.lit(before_long), field["name"], F.lit(after_long.format(MAX_BODY_BYTES))))
            .when(missing, F.concat(field["name"], F.lit(EMPTY.format(""))))
            .when(field["fenced"], fences.fence_error(value))
        )

    return first_in(listed, rule)


def payload(p: Column, sources: Column) -> Column:
    """Rules of the payload's kind, after those of its sources."""
    kind = p["kind"]
    needs = F.when(
        kind.isin("observation", "metric", "evidence")
        & (F.coalesce(F.size(sources), F.lit(0)) < 1),
        F.format_string(NEEDS_SOURCE.replace("{}", "%s"), kind),
    )
    before = F.when(
        kind == "snippet", single_line("language", p["language"], MAX_NAME_BYTES)
    ).when(kind == "metric", _metric(p))
    after = (
        F.when(kind == "observation", timestamp_error("observed_at", p["observed_at"]))
        .when(kind == "decision", timestamp_error("decided_at", p["decided_at"]))
        .when(kind == "snippet", _after_snippet(p, sources))
    )
    return first_error(
        at_most("sources", sources, MAX_SOURCES),
        first_in(sources, source),
        error_if(kind.isNull() | ~kind.isin(*KINDS), "payload kind is not known"),
        before,
        _long_texts(p),
        after,
        needs,
    )


def ids(name: str, values: Column, limit: int = MAX_LABEL_IDS) -> Column:
    return first_error(
        at_most(name, values, limit),
        error_if(F.exists(values, lambda v: v <= 0), POSITIVE.format(name)),
    )


def title(value: Column) -> Column:
    return single_line("title", value, MAX_TITLE_BYTES)


def reason(value: Column) -> Column:
    return single_line("reason", value, MAX_NAME_BYTES)


def record(scope_id: Column, title_: Column, label_ids: Column, p: Column, sources: Column) -> Column:
    return first_error(
        positive("scope_id", scope_id),
        title(title_),
        error_if(F.coalesce(F.size(label_ids), F.lit(0)) < 1, NEEDS_LABEL),
        ids("label_ids", label_ids),
        payload(p, sources),
    )


def context(key: Column, actor: Column, thread: Column, client: Column) -> Column:
    return first_error(
        single_line("idempotency_key", key, MAX_NAME_BYTES),
        single_line("actor", actor, MAX_PROVENANCE_BYTES),
        single_line("thread", thread, MAX_PROVENANCE_BYTES),
        single_line("client", client, MAX_PROVENANCE_BYTES),
    )


def label_part(name: str, value: Column) -> Column:
    return first_error(
        single_line(name, value, MAX_LABEL_PART_BYTES),
        error_if(~utrim(value).rlike(r"\A[a-z0-9_-]+\z"), LABEL_PART.format(name)),
    )


def scope_name(value: Column) -> Column:
    """Canonical scope name: trimmed, and ``global`` in any case is ``global``."""
    trimmed = utrim(value)
    return F.when(F.lower(trimmed) == GLOBAL_SCOPE, GLOBAL_SCOPE).otherwise(trimmed)


def aliases_error(values: Column) -> Column:
    return first_error(
        at_most("aliases", values, MAX_ITEMS),
        first_in(values, lambda a: single_line("alias", a, MAX_NAME_BYTES)),
    )


def canonical_aliases(values: Column) -> Column:
    """Trimmed, lower-cased, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(values, lambda a: F.lower(utrim(a)))))


def page_limit(limit: Column) -> Column:
    return error_if(~limit.between(1, MAX_PAGE), LIMIT_RANGE.format(MAX_PAGE))


def query_text(value: Column) -> Column:
    return error_if(F.octet_length(value) > MAX_QUERY_BYTES, QUERY_TOO_LONG.format(MAX_QUERY_BYTES))


def recall_budget(budget: Column) -> Column:
    return error_if(
        ~budget.between(BUDGET_MIN, BUDGET_MAX), BUDGET_RANGE.format(BUDGET_MIN, BUDGET_MAX)
    )


def query(text_: Column, limit: Column, scope_id: Column, budget: Column) -> Column:
    return first_error(
        positive("scope_id", scope_id), page_limit(limit), query_text(text_), recall_budget(budget)
    )


def split(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with their reason)."""
    judged = rows.withColumn("reject_reason", error)
    return (
        judged.filter("reject_reason IS NULL").drop("reject_reason"),
        judged.filter("reject_reason IS NOT NULL"),
    )
