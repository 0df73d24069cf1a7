"""Small SQL snippets for the oracle texts, generated from the fixed values."""

from __future__ import annotations

from ..functions import enums as E


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def valid_transition(src: str, dst: str) -> str:
    """SQL predicate: (src, dst) is an edge of the workflow machine."""
    parts = [f"({src} = '{a}' and {dst} = '{b}')" for a, bs in E.TRANSITIONS.items() for b in bs]
    return "(" + " or ".join(parts) + ")"


def strict_date_ok(col: str) -> str:
    """SQL: text is null, '' or a real zero-padded YYYY-MM-DD date."""
    return (f"({col} is null or {col} = '' or ({col} similar to '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}' "
            f"and try_strptime({col}, '%Y-%m-%d') is not null))")
