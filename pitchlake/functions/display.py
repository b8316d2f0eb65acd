"""Numbers as people read them. Rounding is half to even; texts are made of integers, so engines agree on them.

The functions give SQL that Spark and DuckDB evaluate alike but for the names of two functions, which `to_duck` changes.
"""

from __future__ import annotations


def hundredths(x: str) -> str:
    """100 times x as an integer, half to even."""
    return f"cast(rint(({x}) * 100) as bigint)"


def rounded(x: str, digits: int) -> str:
    """x with so many decimals, half to even."""
    return f"(rint(({x}) * {10**digits}) / {10**digits})"


def decimals(x: str, digits: int) -> str:
    """x as text with so many decimals."""
    scale = 10**digits
    n = f"cast(rint(abs({x}) * {scale}) as bigint)"
    sign = f"case when {x} < 0 and {n} > 0 then '-' else '' end"
    whole = f"cast(cast(floor({n} / {scale}) as bigint) as string)"
    return f"concat({sign}, {whole}, '.', lpad(cast({n} % {scale} as string), {digits}, '0'))"


def fraction(a: str, b: str) -> str:
    return f"concat(cast({a} as string), '/', cast({b} as string))"


def clock(seconds: str) -> str:
    """mm:ss of the hour that has begun; 00:00 for null."""
    s = f"cast(floor(coalesce({seconds}, 0)) as bigint)"
    return f"concat(lpad(cast(cast(floor({s} % 3600 / 60) as bigint) as string), 2, '0'), ':', lpad(cast({s} % 60 as string), 2, '0'))"


def minute(x: str) -> str:
    return f"concat(cast({x} as string), chr(39))"


def ordinal(n: str) -> str:
    """1st, 2nd, 3rd, 4th, ..., 11th, ..."""
    return f"case when {n} % 100 between 10 and 20 then 'th' when {n} % 10 = 1 then 'st' when {n} % 10 = 2 then 'nd' when {n} % 10 = 3 then 'rd' else 'th' end"


def to_duck(sql: str) -> str:
    """rint in DuckDB's words."""
    out, at = "", 0
    while (i := sql.find("rint(", at)) >= 0:
        depth, j = 1, i + 5
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out += sql[at:i] + f"round_even({to_duck(sql[i + 5 : j - 1])}, 0)"
        at = j
    return out + sql[at:]
