"""Records carried inside server-rendered pages.

The page text and its script fragments are read by built-in functions.  Only the
search for balanced braces, which no expression can state, runs as a small Arrow
batch function over the pages.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a streamed fragment.
FRAGMENT = r'(?s)self\.__next_f\.push\(\[\d+,\s*(".*?")\]\)'

_STRUCTURE = re.compile(r'\\.|["{}]', re.DOTALL)


def page_text(content: Column) -> Column:
    """Text of downloaded bytes; bad sequences become the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def extract_payload(html: Column) -> Column:
    """All decodable fragments joined in page order; an undecodable one is skipped."""
    raw = F.regexp_extract_all(html, F.lit(FRAGMENT), F.lit(1))
    decoded = F.transform(raw, lambda x: F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>")[0])
    return F.array_join(F.array_compact(decoded), "")


def _pairs_of_braces(payload: str, quoted: bool) -> dict[int, int]:
    """End of every object, by its start, if the page begins inside or outside a string; braces in strings do not count."""
    open_braces: list[int] = []
    ends: dict[int, int] = {}
    for token in _STRUCTURE.finditer(payload):
        mark = token.group()
        if mark == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif mark == "{":
            open_braces.append(token.start())
        elif mark == "}" and open_braces:
            ends[open_braces.pop()] = token.start()
    return ends


def objects_by_key(payload: str, keys: Sequence[str]) -> dict[str, list[tuple[str, dict]]]:
    """Per key, (text, record) of each JSON object that directly encloses ``"key"``, in order.

    One forward pass for all keys keeps the stack of open braces, where braces inside strings count too, and one
    more pairs braces outside strings.  Page text before an object may leave a quote open, so an object that the
    pairing misses is looked for as if the page had begun inside a string.  All is linear in the page, however
    large its objects are and however often a key occurs.
    """
    open_braces: list[int] = []
    starts: dict[str, dict[int, None]] = {key: {} for key in keys}
    wanted = re.compile("[{}]|" + "|".join(f'"{re.escape(key)}"' for key in keys))
    for token in wanted.finditer(payload):
        mark = token.group()
        if mark == "{":
            open_braces.append(token.start())
        elif mark == "}":
            if open_braces:
                open_braces.pop()
        elif open_braces:
            starts[mark[1:-1]][open_braces[-1]] = None

    pairings: list[dict[int, int]] = []
    records: dict[int, tuple[str, dict] | None] = {}

    def record_at(start: int) -> tuple[str, dict] | None:
        for quoted in (False, True):
            if len(pairings) == quoted:
                pairings.append(_pairs_of_braces(payload, quoted))
            if start in pairings[quoted]:
                text = payload[start : pairings[quoted][start] + 1]
                try:
                    record = json.loads(text)
                except json.JSONDecodeError:
                    return None
                return (text, record) if isinstance(record, dict) else None
        return None

    found: dict[str, list[tuple[str, dict]]] = {}
    for key in keys:
        for start in starts[key]:
            if start not in records:
                records[start] = record_at(start)
        objects = [records[start] for start in starts[key]]
        found[key] = [o for o in objects if o is not None and key in o[1]]
    return found


def find_objects(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(url, key, position, object_json, n_fields) for every object of every page; needs ``url, payload``."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (url, key, position, text, len(record))
                for url, payload in zip(batch["url"], batch["payload"], strict=True)
                for key, objects in objects_by_key(payload or "", keys).items()
                for position, (text, record) in enumerate(objects)
            ]
            yield pd.DataFrame(rows, columns=["url", "key", "position", "object_json", "n_fields"])

    schema = "url string, key string, position long, object_json string, n_fields long"
    return pages.select("url", "payload").mapInPandas(scan, schema)


def largest_object(objects: DataFrame) -> DataFrame:
    """The object with most fields per (url, key), the first of equals."""
    best = F.max_by("object_json", F.struct("n_fields", -F.col("position")))
    return objects.groupBy("url", "key").agg(best.alias("object_json"), F.max("n_fields").alias("n_fields"))


def with_records(pages: DataFrame, keys: Sequence[str], without: Sequence[str] = ()) -> DataFrame:
    """Pages with one JSON text column ``record_<key>`` per key: its largest object, null when absent.

    The choice is made inside the page, so nothing is shuffled; the page body is dropped.
    Top-level fields named in ``without`` are removed before the text leaves the page.
    """
    kept = [f for f in pages.schema.fields if f.name not in ("payload", "content", "html")]
    names = [f"record_{key}" for key in keys]
    dropped = frozenset(without)

    def best(objects: list[tuple[str, dict]]) -> str | None:
        text, record = max(objects, key=lambda found: len(found[1]), default=(None, {}))
        if dropped.isdisjoint(record):
            return text
        return json.dumps({name: value for name, value in record.items() if name not in dropped}, ensure_ascii=False)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[f.name for f in kept]].copy()
            objects = [objects_by_key(payload or "", keys) for payload in batch["payload"]]
            for key, name in zip(keys, names, strict=True):
                out[name] = [best(found[key]) for found in objects]
            yield out

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{n}` string" for n in names])
    return pages.select(*[f.name for f in kept], "payload").mapInPandas(scan, schema)
