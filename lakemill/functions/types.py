"""Types of the dialect, implicit coercion, and the text of casts in Spark SQL."""

from __future__ import annotations

import re

BOOLEAN, BIGINT, DOUBLE, VARCHAR, DATE, INTERVAL, NULL, TIMESTAMP = "BOOLEAN", "BIGINT", "DOUBLE", "VARCHAR", "DATE", "INTERVAL", "NULL", "TIMESTAMP"
NUMERIC = (BIGINT, DOUBLE)
SPARK = {BOOLEAN: "BOOLEAN", BIGINT: "BIGINT", DOUBLE: "DOUBLE", VARCHAR: "STRING", DATE: "DATE", TIMESTAMP: "TIMESTAMP_NTZ", NULL: "STRING"}
#: Names in CAST -> type.
NAMED = {"INTEGER": BIGINT, "BIGINT": BIGINT, "DOUBLE": DOUBLE, "DECIMAL": DOUBLE, "VARCHAR": VARCHAR, "BOOLEAN": BOOLEAN, "DATE": DATE}


def coerces(a: str, b: str) -> bool:
    """Whether a turns into b by itself. TIMESTAMP exists only in loaded tables; a DATE compares with it."""
    return a == b or a == NULL or (a, b) in ((BIGINT, DOUBLE), (DATE, TIMESTAMP))


def common(a: str, b: str) -> str | None:
    return b if coerces(a, b) else a if coerces(b, a) else None


def castable(a: str, b: str) -> bool:
    if a == b or a == NULL:
        return True
    if b == VARCHAR:
        return a != INTERVAL
    if a == VARCHAR:
        return b not in (INTERVAL, NULL, TIMESTAMP)
    return {a, b} in ({BIGINT, DOUBLE}, {BOOLEAN, BIGINT}) or (a, b) == (TIMESTAMP, DATE)


def text(s: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Expressions whose text is longer than this are bound to a name instead of being repeated.
LONG_TEXT = 300


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def double_text(x: str) -> str:
    """Shortest positional text of a double: 3, 10000000000, 0.0000001, inf, NaN."""
    part = lambda i: f"regexp_extract(s_, '^-?([0-9]+)[.]([0-9]+)E(-?[0-9]+)$', {i})"
    exact = f"""CASE WHEN e_ < 0 THEN concat('0.', repeat('0', -e_ - 1), {part(1)}, f_)
        WHEN length(f_) <= e_ THEN concat({part(1)}, rpad(f_, e_, '0'))
        ELSE concat({part(1)}, substring(f_, 1, e_), '.', substring(f_, e_ + 1)) END"""
    science = let("f_", f"regexp_replace({part(2)}, '0+$', '')", let("e_", f"CAST({part(3)} AS INT)", exact))
    body = f"""CASE WHEN s_ = 'NaN' THEN s_ WHEN instr(s_, 'Infinity') > 0 THEN replace(s_, 'Infinity', 'inf')
        WHEN instr(s_, 'E') = 0 THEN regexp_replace(s_, '[.]0$', '') ELSE concat(CASE WHEN s_ LIKE '-%' THEN '-' ELSE '' END, {science}) END"""
    # Java may print a 17th digit that is not needed to tell the number apart.
    sixteen = f"replace(upper(format_string('%.15e', {x})), 'E+', 'E')"
    digits = "length(regexp_replace(regexp_replace(r_, 'E.*', ''), '[^0-9]', ''))"
    shortest = let("r_", f"CAST({x} AS STRING)", f"CASE WHEN {digits} > 16 AND try_cast({sixteen} AS DOUBLE) = {x} THEN {sixteen} ELSE r_ END")
    return let("s_", shortest, body)


def repeated(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` for ``name``: written out where it is short, so the whole stays in generated code."""
    return let(name, value, body) if len(value) > LONG_TEXT else re.sub(rf"\b{name}(?!\w)", lambda _: value, body)


def checked(x: str, kind: str, pattern: str, to: str) -> str:
    """Text -> type, strictly by a pattern, with Postgres' message."""
    value = f"CASE WHEN trim(v_) RLIKE {text(pattern)} THEN try_cast(trim(v_) AS {to}) END"
    fail = f"""CAST(raise_error(concat('invalid input syntax for type {kind}: "', v_, '"')) AS {to})"""
    return repeated("v_", x, f"CASE WHEN v_ IS NULL THEN NULL ELSE coalesce({value}, {fail}) END")


def cast(x: str, a: str, b: str) -> str:
    """Text of a cast that ``castable`` allows."""
    if a == b:
        return x
    if a == NULL:
        return f"CAST(NULL AS {SPARK[b]})"
    if a == VARCHAR:
        if b == BIGINT:
            return checked(x, "bigint", r"^[+-]?[0-9]+$", "BIGINT")
        if b == DOUBLE:
            return checked(x, "double", r"^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$", "DOUBLE")
        if b == DATE:
            return checked(x, "date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "DATE")
        words = repeated("b_", f"lower(trim({x}))", """CASE WHEN b_ IS NULL THEN NULL WHEN b_ IN ('t', 'true', 'yes', 'y', 'on', '1') THEN TRUE
            WHEN b_ IN ('f', 'false', 'no', 'n', 'off', '0') THEN FALSE ELSE CAST(raise_error(concat('invalid input syntax for type boolean: "', b_, '"')) AS BOOLEAN) END""")  # fmt: skip
        return words
    if b == VARCHAR:
        return double_text(x) if a == DOUBLE else f"CAST({x} AS STRING)"
    if (a, b) == (DOUBLE, BIGINT):
        return f"CAST(round({x}) AS BIGINT)"
    if (a, b) == (BIGINT, BOOLEAN):
        return f"({x} <> 0L)"
    return f"CAST({x} AS {SPARK[b]})"


def compensated(x: str, name: str, distinct: bool) -> str:
    """Sum or average of a group's doubles with the lost low parts kept apart and added at the end. Where the sum isn't finite
    the plain one is right already."""
    values = f"collect_{'set' if distinct else 'list'}({x})"
    step = """(a, v) -> named_struct('s', a.s + v, 'c', a.c + CASE WHEN abs(a.s) >= abs(v) THEN (a.s - (a.s + v)) + v ELSE (v - (a.s + v)) + a.s END)"""
    total = f"aggregate({values}, named_struct('s', 0D, 'c', 0D), {step}, a -> CASE WHEN isnan(a.c) OR abs(a.s) = double('Infinity') THEN a.s ELSE a.s + a.c END)"
    return f"(CASE WHEN size({values}) > 0 THEN {total}{f' / size({values})' if name == 'avg' else ''} END)"
