"""SQL text of the cell rules, written for the checking engine."""

from __future__ import annotations

_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def strip(x: str) -> str:
    return f"trim({x}, {_WS})"


def clean(x: str) -> str:
    return f"translate({strip(x)}, ',$€¥', '')"


def number(x: str) -> str:
    d = "[0-9]+(_[0-9]+)*"
    t = strip(x)
    return (
        f"(CASE WHEN regexp_matches({t}, '^[+-]?({d}[.]?({d})?|[.]{d})([eE][+-]?{d})?$') "
        f"THEN try_cast(replace({t}, '_', '') AS DOUBLE) "
        f"WHEN regexp_matches(lower({t}), '^[+-]?(inf|infinity|nan)$') THEN try_cast({t} AS DOUBLE) END)"
    )


def empty(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


def near(x: str, y: str, tol: str = "0.001") -> str:
    return (
        f"coalesce(CASE WHEN isnan({x}) OR isnan({y}) THEN false WHEN abs({x}) < 1e-10 THEN abs({y}) < 1e-10 "
        f"ELSE abs({x} - {y}) / greatest(abs({x}), abs({y})) < {tol} END, false)"
    )


def match_text(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {a} IS NULL AND {b} IS NULL THEN true WHEN {a} IS NULL OR {b} IS NULL THEN false "
        f"WHEN {strip(a)} = {strip(b)} THEN true WHEN {clean(a)} = {clean(b)} THEN true "
        f"ELSE {near(number(clean(a)), number(clean(b)))} END)"
    )


def match_number(a: str, b: str) -> str:
    """``a`` is a number, ``b`` text."""
    n = number(clean(b))
    return (
        f"(CASE WHEN {a} IS NULL AND {b} IS NULL THEN true WHEN {a} IS NULL OR {b} IS NULL THEN false "
        f"ELSE coalesce({a} = {n}, false) OR {near(a, n)} END)"
    )


def match_exact(a: str, b: str) -> str:
    return f"({a} IS NOT DISTINCT FROM {b})"


def match_numbers(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {a} IS NULL AND {b} IS NULL THEN true WHEN {a} IS NULL OR {b} IS NULL THEN false "
        f"ELSE {a} = {b} OR {near(f'CAST({a} AS DOUBLE)', f'CAST({b} AS DOUBLE)')} END)"
    )
