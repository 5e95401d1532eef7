"""Verdict objects in prose, by a scanner that knows strings and depth."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Objects nested deeper than this are no verdicts.
DEEPEST = 200
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)
_START = re.compile(r'\{(?=\s*(?:\}|"(?:[^"\\]|\\.)*"\s*:))', re.S)
_DECODER = json.JSONDecoder()


def _hopeless(text: str, start: int) -> set[int]:
    """Of the opening braces outside strings, as read from start on: those that nothing closes, and those that hold more than DEEPEST levels."""
    open_, out = [], set()
    for m in _TOKEN.finditer(text, start):
        if m[0] == "{":
            open_.append([m.start(), 1])
        elif m[0] == "}" and open_:
            at, depth = open_.pop()
            if depth > DEEPEST:
                out.add(at)
            if open_:
                open_[-1][1] = max(open_[-1][1], depth + 1)
    return out | {at for at, _ in open_}


def _read(text: str, at: int) -> tuple[dict | None, int]:
    """The object that starts at a brace, or how far behind it reading failed. Pieces that grow keep a failure's cost to what was read."""
    size = 4096
    while True:
        piece = text[at : at + size]
        try:
            return _DECODER.raw_decode(piece)[0], 0
        except RecursionError:
            return None, len(piece)
        except ValueError as e:
            far = getattr(e, "pos", 0)
            # what the piece's end cut off isn't a failure
            cut = far > len(piece) - 16 or str(e).startswith("Unterminated string")
            if not cut or at + size >= len(text):
                return None, far
        size *= 4


def first_object(text: str) -> dict | None:
    """The object that starts at the first opening brace from which one can be read: it ends with its own closing brace.

    Only braces before a key and a colon, or before a closing one, are tried. A failure far behind its brace also tells which other braces are hopeless,
    so long unclosed nests are read twice and not once for each brace.
    """
    skip: set[int] = set()
    for m in _START.finditer(text):
        at = m.start()
        if at in skip:
            continue
        found, far = _read(text, at)
        if found is not None:
            return found
        if far > 1000:
            skip |= _hopeless(text, at)
    return None


def scores_of(found: dict | None) -> str | None:
    """The finite numbers of an object (true and false, and numbers in strings, are numbers), as JSON; null without an object."""
    if found is None:
        return None
    out = {}
    for k, v in found.items():
        try:
            number = float(v) if isinstance(v, (bool, int, float, str)) else math.nan
        except (ValueError, OverflowError):
            continue
        if math.isfinite(number):
            out[k] = number
    return json.dumps(out)


@F.pandas_udf(T.StringType())
def object_scores(text: pd.Series) -> pd.Series:
    """scores_of the first object of each text, in Arrow batches."""
    return pd.Series([None if t is None else scores_of(first_object(t)) for t in text], index=text.index, dtype=object)
