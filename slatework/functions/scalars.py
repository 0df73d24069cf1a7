"""Scalar and validation functions (X1-X15) as Column expressions.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; no Python runs per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import enums as E

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# X5 ------------------------------------------------------------------------
def empty_to_null(col: ColumnOrName) -> Column:
    """'' -> null, everything else unchanged."""
    return F.nullif(_c(col), F.lit(""))


# X1 ------------------------------------------------------------------------
def _ymd(c: Column, y_at: int, m_at: int, d_at: int | None) -> tuple[Column, Column, Column | None]:
    y = F.substring(c, y_at, 4).try_cast("int")
    m = F.substring(c, m_at, 2).try_cast("int")
    d = F.substring(c, d_at, 2).try_cast("int") if d_at else None
    return y, m, d


def parse_strict_date(col: ColumnOrName) -> Column:
    """Date of a strict YYYY-MM-DD text that names a real day, else null.

    Shape first (four, two and two digits), then month 1-12, then day
    1..last day of that month; only then is the date built. No parser runs
    and nothing throws, so bad input costs no more than good input.
    """
    c = _c(col)
    y, m, d = _ymd(c, 1, 6, 9)
    last = F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1))))
    return F.when(_digits_shape(c, 10, (5, 8)),
                  F.when((m >= 1) & (m <= 12),
                         F.when((d >= 1) & (d <= last), F.make_date(y, m, d))))


def _digits_shape(c: Column, length: int, dashes: tuple[int, ...]) -> Column:
    """Text of ``length`` characters: digits, with '-' exactly at ``dashes``."""
    ok = (F.length(c) == length) & (F.translate(c, "0123456789", "") == F.lit("-" * len(dashes)))
    for pos in dashes:
        ok = ok & (F.substring(c, pos, 1) == "-")
    return ok


def strict_date_ok(col: ColumnOrName) -> Column:
    """True when the text is null, '' or a strict real YYYY-MM-DD date."""
    c = _c(col)
    return c.isNull() | (c == "") | parse_strict_date(c).isNotNull()


# X2 / X3 -------------------------------------------------------------------
def month_start(month: ColumnOrName, as_of: ColumnOrName) -> Column:
    """First day of a YYYY-MM month; '' means the month of ``as_of``;
    anything that is not a real YYYY-MM month gives null (the error case)."""
    m = _c(month)
    y, mm, _ = _ymd(m, 1, 6, None)
    parsed = F.when(_digits_shape(m, 7, (5,)), F.when((mm >= 1) & (mm <= 12), F.make_date(y, mm, F.lit(1))))
    return F.when(m == "", F.trunc(_c(as_of).cast("date"), "month")).otherwise(parsed)


def next_month_start(start: ColumnOrName) -> Column:
    return F.add_months(_c(start), 1)


def shift_month(start: ColumnOrName, months: int) -> Column:
    """Previous (-1) or next (+1) month start, across year ends."""
    return F.add_months(_c(start), months)


# X4 ------------------------------------------------------------------------
def enum_ok(col: ColumnOrName, field: str) -> Column:
    return _c(col).isin(*E.ENUMS[field])


def allowed_text(field: str) -> str:
    return ", ".join(E.ENUMS[field])


# X6 ------------------------------------------------------------------------
def handles_map(col: ColumnOrName) -> Column:
    """JSON text -> map<string,string>; null, JSON null and non-objects -> {}."""
    c = _c(col)
    parsed = F.from_json(c, "map<string,string>")
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


# X7 / X8 -------------------------------------------------------------------
def allowed_transitions(status: ColumnOrName) -> Column:
    """List of next statuses; unknown status -> null; archived -> []."""
    s = _c(status)
    expr = None
    for src, dsts in E.TRANSITIONS.items():
        arr = F.array(*[F.lit(d) for d in dsts]) if dsts else F.array().cast("array<string>")
        expr = F.when(s == src, arr) if expr is None else expr.when(s == src, arr)
    return expr


def is_valid_transition(from_status: ColumnOrName, to_status: ColumnOrName) -> Column:
    """Is (from, to) an edge of the workflow machine; unknown -> false."""
    pred = E.predecessor()
    f, t = _c(from_status), _c(to_status)
    expr = F.lit(False)
    for dst, src in pred.items():
        expr = F.when((t == dst) & (f == src), F.lit(True)).otherwise(expr)
    return F.coalesce(expr, F.lit(False))


# X9 ------------------------------------------------------------------------
def invite_expired(expires_at: ColumnOrName, at: ColumnOrName) -> Column:
    """Expired only strictly after expires_at (a claim at that instant is valid)."""
    return _c(at) > _c(expires_at)


def invite_exhausted(use_count: ColumnOrName, max_uses: ColumnOrName) -> Column:
    return _c(use_count) >= _c(max_uses)


# X10 -----------------------------------------------------------------------
def user_display_name(name: ColumnOrName, email: ColumnOrName) -> Column:
    return F.coalesce(empty_to_null(name), _c(email))


def personal_workspace_name(user_name: ColumnOrName) -> Column:
    return F.concat(_c(user_name), F.lit(E.WORKSPACE_NAME_SUFFIX))


# X11 -----------------------------------------------------------------------
def invite_max_uses(max_uses: ColumnOrName) -> Column:
    m = _c(max_uses)
    return F.when(m.isNull() | (m <= 0), F.lit(E.DEFAULT_INVITE_MAX_USES)).otherwise(m).cast("int")


def invite_expires_at(requested_at: ColumnOrName, hours: ColumnOrName) -> Column:
    h = _c(hours)
    eff = F.when(h.isNull() | (h <= 0), F.lit(E.DEFAULT_INVITE_HOURS)).otherwise(h)
    return _c(requested_at) + F.make_dt_interval(F.lit(0), eff.cast("int"))


# X12 -----------------------------------------------------------------------
def label_of(col: ColumnOrName, labels: dict[str, str]) -> Column:
    c = _c(col)
    expr = None
    for k, v in labels.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr


def capitalised(col: ColumnOrName) -> Column:
    """First letter upper-cased, rest unchanged (not ``initcap``, which lowers)."""
    c = _c(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


# X13 -----------------------------------------------------------------------
def date_text(col: ColumnOrName) -> Column:
    return F.date_format(_c(col), E.DATE_FORMAT)


# X15 -----------------------------------------------------------------------
def author_label(name: ColumnOrName, email: ColumnOrName, author_id: ColumnOrName) -> Column:
    return F.coalesce(empty_to_null(name), empty_to_null(email), _c(author_id).cast("string"))


# X14 -----------------------------------------------------------------------
def error_message(code: ColumnOrName, field: ColumnOrName, value: ColumnOrName, from_status: ColumnOrName | None = None) -> Column:
    """Message of a verdict row (null for accepted rows): the code's text with its
    places filled in. ``value`` is the rejected value, for a transition the target."""
    filled = {"field": _c(field), "value": _c(value).cast("string"), "to": _c(value).cast("string"),
              "from": F.lit(None).cast("string") if from_status is None else _c(from_status)}
    out = F.lit(None).cast("string")
    for known, text in E.ERROR_MESSAGES.items():
        parts = re.split(r"\{(\w+)\}", text)
        said = F.concat(*[filled[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if i % 2 or x])
        out = F.when(_c(code) == known, said).otherwise(out)
    return out


def error_allowed(code: ColumnOrName, field: ColumnOrName, from_status: ColumnOrName | None = None) -> Column:
    """The values that would have passed: of the field's enum, or the statuses that
    ``from_status`` may move to; null for other codes."""
    def listed(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    enum = move = F.lit(None).cast("array<string>")
    for name, values in E.ENUMS.items():
        enum = F.when(_c(field) == name, listed(values)).otherwise(enum)
    if from_status is not None:
        for src, targets in E.TRANSITIONS.items():
            move = F.when(_c(from_status) == src, listed(targets)).otherwise(move)
    return F.when(_c(code) == "invalid_enum", enum).when(_c(code) == "invalid_transition", move)


def error_expected(code: ColumnOrName) -> Column:
    """The format an ``invalid_format`` value should have had."""
    return F.when(_c(code) == "invalid_format", F.lit(E.EXPECTED_DATE))
