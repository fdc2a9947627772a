"""Operators on JSON documents: ``kv_json (key, doc)`` with the document's text.

Paths are ``$``, names after dots and indexes in brackets. Reads and
arithmetic are built-in expressions on VARIANT; edits inside a document need
Python, which gets rows in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship


def steps(path: str) -> list[str | int]:
    """Names and indexes of a path."""
    out: list[str | int] = []
    for name, quoted, index in re.findall(r"""([^.\[\]$"']+)|\[["']([^"']*)["']\]|\[(\d+)\]""", path):
        out.append(int(index) if index else quoted or name)
    return out


def dollar(path: str) -> str:
    """The path as VARIANT functions take it."""
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f'["{s}"]' for s in steps(path))


def at(doc: Column, path: str, kind: str = "string") -> Column:
    """Value at a path, null where there is none or it is not of the type."""
    return F.try_variant_get(F.try_parse_json(doc), dollar(path), kind)


def get(table: DataFrame, path: str) -> DataFrame:
    """JSON text of the value at a path."""
    return table.select("key", F.to_json(F.try_variant_get(F.try_parse_json("doc"), dollar(path), "variant")).alias("value"))


def type_of(table: DataFrame, path: str) -> DataFrame:
    """object, array, string, number, boolean or null at a path."""
    s = F.schema_of_variant(F.try_variant_get(F.try_parse_json("doc"), dollar(path), "variant"))
    kind = F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(s.isNotNull(), "number")
    return table.select("key", kind.alias("type"))


def number_at(table: DataFrame, path: str, add: float = 0.0, times: float = 1.0) -> DataFrame:
    """The number at a path, multiplied and increased."""
    return table.select("key", (at(F.col("doc"), path, "double") * times + add).alias("value"))


def strlen(table: DataFrame, path: str) -> DataFrame:
    return table.select("key", F.octet_length(at(F.col("doc"), path)).cast("long").alias("length"))


def _array(path: str) -> Column:
    return F.try_variant_get(F.try_parse_json("doc"), dollar(path), "array<variant>")


def arrlen(table: DataFrame, path: str) -> DataFrame:
    return table.select("key", F.size(_array(path)).cast("long").alias("n"))


def arrindex(table: DataFrame, path: str, value: str) -> DataFrame:
    """First index of an element whose text is the value, -1 without one."""
    texts = F.transform(_array(path), lambda x: F.try_variant_get(x, "$", "string"))
    return table.select("key", (F.array_position(texts, value) - 1).alias("index"))


def objkeys(table: DataFrame, path: str) -> DataFrame:
    """Sorted names of the object at a path."""
    text = F.to_json(F.try_variant_get(F.try_parse_json("doc"), dollar(path), "variant"))
    return table.select("key", F.array_sort(F.json_object_keys(text)).alias("names"))


def objlen(table: DataFrame, path: str) -> DataFrame:
    return objkeys(table, path).select("key", F.size("names").cast("long").alias("n"))


def edit(table: DataFrame, change: Callable[[Any], Any]) -> DataFrame:
    """Documents passed through a function on their parsed value; null and broken ones stay as they are."""

    ship(table.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(text: str | None) -> str | None:
            try:
                return text if text is None else json.dumps(change(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return text

        for p in batches:
            yield p.assign(doc=[one(x) for x in p["doc"]])

    return table.mapInPandas(run, table.schema)


def _put(doc: Any, way: list[str | int], value: Any) -> Any:
    if not way:
        return value
    name, rest = way[0], way[1:]
    if isinstance(name, int):
        if isinstance(doc, list) and name < len(doc):
            doc[name] = _put(doc[name], rest, value)
        return doc
    doc = doc if isinstance(doc, dict) else {}
    doc[name] = _put(doc.get(name), rest, value)
    return doc


def _see(doc: Any, way: list[str | int]) -> Any:
    for name in way:
        if isinstance(name, int):
            doc = doc[name] if isinstance(doc, list) and name < len(doc) else None
        else:
            doc = doc.get(name) if isinstance(doc, dict) else None
    return doc


def set_path(table: DataFrame, path: str, value: Any, only_new: bool = False, only_old: bool = False) -> DataFrame:
    """Value put at a path, missing objects made (NX: only where absent, XX: only where there)."""
    way = steps(path)

    def change(doc: Any) -> Any:
        there = _see(doc, way) is not None
        return doc if there and only_new or not there and only_old else _put(doc, way, value)

    return edit(table, change)


def delete(table: DataFrame, path: str) -> DataFrame:
    way = steps(path)

    def change(doc: Any) -> Any:
        if not way:
            return None
        holder, last = _see(doc, way[:-1]), way[-1]
        if isinstance(holder, dict):
            holder.pop(last, None)
        elif isinstance(holder, list) and isinstance(last, int) and last < len(holder):
            del holder[last]
        return doc

    return edit(table, change)


def _changed(table: DataFrame, path: str, of: Callable[[Any], Any]) -> DataFrame:
    way = steps(path)

    def change(doc: Any) -> Any:
        now = _see(doc, way)
        return doc if now is None else _put(doc, way, of(now))

    return edit(table, change)


def num_incr(table: DataFrame, path: str, by: float) -> DataFrame:
    return _changed(table, path, lambda x: x + by if isinstance(x, (int, float)) else x)


def num_mult(table: DataFrame, path: str, by: float) -> DataFrame:
    return _changed(table, path, lambda x: x * by if isinstance(x, (int, float)) else x)


def str_append(table: DataFrame, path: str, text: str) -> DataFrame:
    return _changed(table, path, lambda x: x + text if isinstance(x, str) else x)


def arr_append(table: DataFrame, path: str, *values: Any) -> DataFrame:
    return _changed(table, path, lambda x: [*x, *values] if isinstance(x, list) else x)


def arr_insert(table: DataFrame, path: str, index: int, *values: Any) -> DataFrame:
    return _changed(table, path, lambda x: [*x[:index], *values, *x[index:]] if isinstance(x, list) else x)


def arr_pop(table: DataFrame, path: str, index: int = -1) -> DataFrame:
    return _changed(table, path, lambda x: [y for i, y in enumerate(x) if i != index % len(x)] if isinstance(x, list) and x and -len(x) <= index < len(x) else x)


def arr_popped(table: DataFrame, path: str, index: int = -1) -> DataFrame:
    """``key`` and ``value``, the element (as JSON) that ``arr_pop`` takes; null where there is none."""
    items = _array(path)
    at = F.lit(index) if index >= 0 else F.size(items) + index
    return table.select("key", F.to_json(F.when(at >= 0, F.get(items, at))).alias("value"))


def arr_trim(table: DataFrame, path: str, start: int, stop: int) -> DataFrame:
    """Elements start..stop kept; a negative start counts as 0, a negative stop as the end."""
    return _changed(table, path, lambda x: x[max(start, 0) : stop + 1 if stop >= 0 else None] if isinstance(x, list) else x)
