"""Placeholders ``${key}`` and ``${key:default}`` in texts.

Flat ones are a regular pattern and stay in the JVM.  Balanced matching of nested ones is not regular: a small helper
finds them, one Arrow batch at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_placeholders(text: Column) -> Column:
    """Array of ``{key, default_value}`` of placeholders that hold no other."""
    bodies = F.regexp_extract_all(text, F.lit(r"\$\{([^${}]*)\}"), 1)
    at = lambda b: F.instr(b, ":")
    return F.transform(bodies, lambda b: F.struct(
        F.when(at(b) > 0, F.substring(b, F.lit(1), at(b) - 1)).otherwise(b).alias("key"),
        F.when(at(b) > 0, F.regexp_replace(F.substring(b, at(b) + 1, F.length(b)), "^-", "")).alias("default_value")))


def scan(text: str | None, deep: bool = True, keys: bool = True) -> list[dict]:
    """Placeholders of a text in order, nested ones (unless not ``deep``, and unless they stand in a key and not ``keys``)
    after the one that holds them; an unclosed one is no placeholder.

    The default begins after the first colon outside inner braces; ``:-`` counts as one separator.
    """
    out: list[dict] = []
    todo = [text or ""]
    while todo:
        t = todo.pop(0)
        at = t.find("${")
        while at >= 0:
            depth, end, colon = 1, at + 2, -1
            while end < len(t) and depth:
                if t.startswith("${", end):
                    depth, end = depth + 1, end + 2
                    continue
                if t[end] == "}":
                    depth -= 1
                elif t[end] == ":" and depth == 1 and colon < 0:
                    colon = end
                end += 1
            if depth:
                break
            stop = end - 1
            default = None
            if colon >= 0:
                default = t[colon + (2 if t.startswith(":-", colon) else 1):stop]
            key = t[at + 2:colon if colon >= 0 else stop].strip()
            if key:
                out.append({"key": key, "default_value": default, "raw": t[at:end]})
            if deep and keys and "${" in key:
                todo.append(key)
            if deep and default and "${" in default:
                todo.append(default)
            at = t.find("${", end)
    return out


_FOUND = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("key", "default_value", "raw")]))


@F.pandas_udf(_FOUND)
def _scanned(text: pd.Series, deep: pd.Series, keys: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else scan(t, d, k) for t, d, k in zip(text, deep, keys)], index=text.index)


def nested_placeholders(text: Column | str, deep: bool = True, keys: bool = True) -> Column:
    """Array of ``{key, default_value, raw}`` of all placeholders, as ``scan`` finds them.

    Only texts in which one placeholder opens inside another leave the JVM; the others are a pattern.
    """
    t = F.col(text) if isinstance(text, str) else text
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    bodies = F.regexp_extract_all(t, F.lit(r"\$\{([^}]*)\}"), 1)
    at = lambda b: F.instr(b, ":")
    flat = F.transform(bodies, lambda b: F.struct(
        trimmed(F.when(at(b) > 0, F.substring(b, F.lit(1), at(b) - 1)).otherwise(b)).alias("key"),
        F.when(at(b) > 0, F.regexp_replace(F.substring(b, at(b) + 1, F.length(b)), "^-", "")).alias("default_value"),
        F.concat(F.lit("${"), b, F.lit("}")).alias("raw")))
    nested = F.when(t.rlike(r"\$\{[^}]*\$\{"), t)
    return F.coalesce(_scanned(nested, F.lit(deep), F.lit(keys)), F.filter(flat, lambda x: x["key"] != ""))
