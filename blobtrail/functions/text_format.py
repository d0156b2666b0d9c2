"""Formatting expressions: B13 repository URL parsing, B14 human durations,
B15 timestamp / millisecond formats. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's formats) ----------------------
# Owner/repo of a GitHub URL: https, http, scp-like and ssh forms, any case,
# optional ".git", optional "#..." or "?..." tail.
GITHUB_URL = r"(?i)github\.com[:/]+([^/]+)/([^/]+?)(?:\.git)?(?:[#?].*)?$"
# Characters allowed in a remote name; others become "_". Names are cut at 200.
REMOTE_NAME_BAD = r"[^A-Za-z0-9_.-]"
REMOTE_NAME_MAX = 200
# Text for a duration that is zero or negative.
NOT_RUN = "wasn't applied or run"
TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"
# ----------------------------------------------------------------------------


def github_owner(url: Column) -> Column:
    t = F.trim(url)
    return F.when(t.rlike(GITHUB_URL), F.regexp_extract(t, GITHUB_URL, 1))


def github_repo(url: Column) -> Column:
    t = F.trim(url)
    return F.when(t.rlike(GITHUB_URL), F.regexp_extract(t, GITHUB_URL, 2))


def repo_basename(url: Column) -> Column:
    """Last segment after '/' or ':' (trailing '/' removed), one '.git'
    suffix cut, 'repo' when nothing is left."""
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "[/:]"), -1)
    name = F.regexp_replace(last, r"\.git$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("repo"))


def sanitize_remote_name(s: Column) -> Column:
    """Only [A-Za-z0-9_.-]; a leading '.' becomes '_'; at most 200 chars."""
    clean = F.regexp_replace(s, REMOTE_NAME_BAD, "_")
    clean = F.regexp_replace(clean, r"^\.", "_")
    return F.substring(clean, 1, REMOTE_NAME_MAX)


def _unit(n: Column, word: str, plural_always: bool = False) -> Column:
    if plural_always:
        return F.concat(n.cast("string"), F.lit(f" {word}s"))
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n != 1, F.lit("s")).otherwise(F.lit("")))


def _join_parts(parts: list[Column]) -> Column:
    """'A and B' for two present parts, 'A, B, and C' for more; absent
    parts are null. A single part reads ', and A' (the reference's output
    for whole minutes or hours; kept as is)."""
    arr = F.filter(F.array(*parts), lambda x: x.isNotNull())
    n = F.size(arr)
    head = F.array_join(F.slice(arr, 1, n - 1), ", ")
    return (
        F.when(n == 1, F.concat(F.lit(", and "), arr[0]))
        .when(n == 2, F.concat(arr[0], F.lit(" and "), arr[1]))
        .otherwise(F.concat(head, F.lit(", and "), F.element_at(arr, -1)))
    )


def humanize_ms(ms: Column) -> Column:
    """B14: 'Took ...' text of a millisecond duration."""
    sec = F.floor(ms / 1000)
    rem_ms = ms - sec * 1000
    mins = F.floor(sec / 60)
    rem_s = sec - mins * 60
    hours = F.floor(mins / 60)
    rem_m = mins - hours * 60
    under_min = F.when(
        rem_ms == 0, F.concat(F.lit("Took "), sec.cast("string"), F.lit(" seconds"))
    ).otherwise(F.concat(F.lit("Took "), sec.cast("string"), F.lit(" seconds and "), rem_ms.cast("string"), F.lit(" milliseconds")))
    under_hour = _join_parts([
        F.concat(F.lit("Took "), _unit(mins, "minute")),
        F.when(rem_s > 0, _unit(rem_s, "second")),
        F.when(rem_ms > 0, _unit(rem_ms, "millisecond")),
    ])
    longer = _join_parts([
        F.concat(F.lit("Took "), _unit(hours, "hour")),
        F.when(rem_m > 0, _unit(rem_m, "minute")),
        F.when(rem_s > 0, _unit(rem_s, "second")),
        F.when(rem_ms > 0, _unit(rem_ms, "millisecond")),
    ])
    return (
        F.when(ms <= 0, F.lit(NOT_RUN))
        .when(ms < 1000, F.concat(F.lit("Took "), ms.cast("string"), F.lit(" milliseconds")))
        .when(sec < 60, under_min)
        .when(mins < 60, under_hour)
        .otherwise(longer)
    )


def format_ts_ms(ts: Column) -> Column:
    """B15: 'yyyy-MM-dd HH:mm:ss.SSS' (microseconds truncated)."""
    return F.date_format(ts, TS_FORMAT)


def format_ms(seconds: Column) -> Column:
    """Seconds -> 'N ms', rounding half to even."""
    return F.concat(F.bround(seconds * 1000.0, 0).cast("long").cast("string"), F.lit(" ms"))
