"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = r"\[marker:.*?\]"
TRANSACTION = r"\[(#tid_[A-Za-z0-9_]*)\]"
#: Names of result codes.
STATUS_NAMES = ("success", "application_error", "action_developer_error", "whisk_internal_error")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nth_match(c: str | Column, pattern: str, n: int = 1, group: int = 0) -> Column:
    """n-th match of a pattern (from 1), or its group; null if there are fewer."""
    return F.get(F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(group)), n - 1)


def marker(line: str | Column) -> Column:
    return nth_match(line, MARKER)


def transaction_id(line: str | Column, n: int = 2) -> Column:
    """n-th transaction id of a log line: the second in lines with root and own id, the first in lines with one."""
    return nth_match(line, TRANSACTION, n, 1)


def marker_stage(mark: str | Column) -> Column:
    return F.regexp_replace(F.get(F.split(_col(mark), ":"), 1), r"\]$", "")


def marker_millis(mark: str | Column) -> Column:
    """Third colon-separated part without its closing bracket, as a number; null if it is none."""
    return F.regexp_replace(F.get(F.split(_col(mark), ":"), 2), r"\]$", "").try_cast("bigint")


def contains_any(c: str | Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | _col(c).contains(p)
    return out


def parse_date(c: str | Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Date of a text, null if it is none."""
    return F.try_to_timestamp(_col(c), F.lit(fmt)).cast("date")


def status_name(code: str | Column) -> Column:
    """Name of a result code 0 to 3; other codes as text."""
    c = _col(code)
    out = c.cast("string")
    for k, name in enumerate(STATUS_NAMES):
        out = F.when(c == k, name).otherwise(out)
    return out


def namespace_of(path: str | Column) -> Column:
    return F.split_part(_col(path), F.lit("/"), F.lit(1))


def action_of(path: str | Column) -> Column:
    """What follows the first segment."""
    return F.regexp_replace(_col(path), r"^[^/]*/?", "")


def root_namespace(ns: str | Column) -> Column:
    return F.split_part(_col(ns), F.lit("/"), F.lit(1))


def is_cold_start(init_time: str | Column) -> Column:
    return F.coalesce(_col(init_time), F.lit(0)) != 0


def result_status_code(result: str | Column) -> Column:
    """Status code inside a JSON result: of its error, else its own; 400 if that is no whole number, null if absent."""
    r = _col(result)
    found = F.coalesce(F.get_json_object(r, "$.error.statusCode"), F.get_json_object(r, "$.statusCode"))
    return F.when(found.isNotNull(), F.coalesce(F.when(found.rlike(r"^-?\d+$"), found.try_cast("int")), F.lit(400)))


def duration(start: str | Column, end: str | Column, given: str | Column | None = None) -> Column:
    """Given duration, else end - start; null while running (end 0 or null)."""
    own = _col(end) - _col(start)
    return F.when(_col(end) != 0, own if given is None else F.coalesce(_col(given), own))


def annotation(annotations: str | Column, key: str) -> Column:
    """Value of the last annotation of a key."""
    found = F.filter(_col(annotations), lambda a: a["key"] == key)
    return F.get(found, F.size(found) - 1)["value"]


def filter_path(namespace: str | Column, name: str | Column, annotations: str | Column) -> Column:
    """namespace/pkg/name by the binding annotation or a three-part path annotation, else namespace/name."""
    binding, path = annotation(annotations, "binding"), annotation(annotations, "path")
    in_package = F.when(F.coalesce(binding, F.lit("")) != "", F.get(F.split(binding, "/"), 1)).when(F.size(F.split(path, "/")) == 3, F.get(F.split(path, "/"), 1))
    return F.concat_ws("/", _col(namespace), in_package, _col(name))


def pairs_to_map(pairs: str | Column) -> Column:
    """Array of (key, value) to a map, the last value of a key winning."""
    p = _col(pairs)
    last = F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def map_to_pairs(m: str | Column) -> Column:
    return F.array_sort(F.map_entries(_col(m)))


def log_line(time: str | Column, stream: str | Column, message: str | Column) -> Column:
    return F.format_string("%-30s %s: %s", _col(time), _col(stream), F.trim(_col(message)))


def min_max(x: str | Column, low: Column, high: Column) -> Column:
    """Scaled to 0-1; null for a constant column."""
    return F.try_divide(_col(x) - low, high - low)


def sigmoid_dot(x: str | Column, coefficients: Column) -> Column:
    """Sigmoid of intercept (first coefficient) plus dot product."""
    rest = F.slice(coefficients, 2, F.size(coefficients))
    dot = F.aggregate(F.zip_with(_col(x), rest, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
    return 1 / (1 + F.exp(-(F.element_at(coefficients, 1) + dot)))


def hash_bucket(n: int, *keys: str | Column) -> Column:
    return F.pmod(F.xxhash64(*[_col(k) for k in keys]), F.lit(n))


def portable_bucket(n: int, *keys: str | Column) -> Column:
    """Bucket of keys that other engines find as well: the first 60 bits of an md5 of the keys as texts, modulo n. A missing key is empty."""
    said = F.concat_ws("|", *[F.coalesce(_col(k).cast("string"), F.lit("")) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def seconds(millis: str | Column) -> Column:
    return _col(millis) / 1000.0


def percent_change(new: str | Column, old: str | Column) -> Column:
    return F.round(F.try_divide((_col(new) - _col(old)) * 100.0, _col(new)), 3)


def percent_of(part: str | Column, whole: str | Column) -> Column:
    return F.round(F.try_divide(_col(part) * 100.0, _col(whole)), 3)


def session_lsn(token: str | Column) -> Column:
    """Sequence number of a change token ``range:lsn`` or ``range:version#lsn``."""
    return F.regexp_extract(_col(token), r"^[^:]*:(?:[^#]*#)?(\d+)", 1).try_cast("bigint")


def change_lag(token: str | Column, doc_lsn: str | Column) -> Column:
    return session_lsn(token) - _col(doc_lsn)


def split_lines(c: str | Column, separator: str | None = None) -> Column:
    return F.split(_col(c), r"\r?\n" if separator is None else rf"\Q{separator}\E", -1)


def sort_lines(lines: str | Column) -> Column:
    return F.array_sort(_col(lines))


def head_lines(lines: str | Column, n: int = 1) -> Column:
    return F.slice(_col(lines), 1, n)


def join_lines(lines: str | Column) -> Column:
    return F.array_join(_col(lines), "\n")


def word_count(c: str | Column) -> Column:
    """Parts between single spaces; an empty text counts 1."""
    return F.size(F.split(_col(c), " ", -1))


def json_eq(c: str | Column, path: str, value: str) -> Column:
    """True if the path holds this string; other types never match."""
    raw = F.get_json_object(_col(c), path)
    return F.coalesce((raw == value) & _is_json_string(_col(c), path), F.lit(False))


def _is_json_string(c: Column, path: str) -> Column:
    """Tells strings from numbers and booleans that look alike: a string's variant type is STRING."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), path, "variant")) == "STRING"


def json_true(c: str | Column, path: str) -> Column:
    """True if the path holds the boolean true; the text "true" doesn't match."""
    v = F.try_variant_get(F.try_parse_json(_col(c)), path, "variant")
    return F.coalesce((F.schema_of_variant(v) == "BOOLEAN") & F.try_variant_get(v, "$", "boolean"), F.lit(False))


def any_match(arr: str | Column, predicate) -> Column:  # noqa: ANN001
    """Some element of an array satisfies the predicate; null arrays have none."""
    return F.coalesce(F.exists(_col(arr), predicate), F.lit(False))


def in_time_range(c: str | Column, since: float | None = None, upto: float | None = None) -> Column:
    """Inclusive bounds, each optional; what isn't a number (null) matches no bound."""
    out = F.lit(True)
    if since is not None:
        out = out & F.coalesce(_col(c) >= since, F.lit(False))
    if upto is not None:
        out = out & F.coalesce(_col(c) <= upto, F.lit(False))
    return out


def between_exclusive(c: str | Column, low: str, high: str) -> Column:
    """Strictly between two dates, for dates, timestamps and texts."""
    d = F.to_date(_col(c))
    return (d > F.lit(low).cast("date")) & (d < F.lit(high).cast("date"))


def should_store(success: Column, blocking: Column, debug: Column, disabled: Column, user_flag: Column) -> Column:
    """A record is stored unless it is a blocking success with storing disabled and no debugging; the user's flag (default true) must hold too."""
    keep = ~success | ~blocking | debug | ~disabled
    return keep & F.coalesce(user_flag, F.lit(True))
