"""What the two span finders share: the map over whole texts and the digest columns of a contract."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumigate.llm.base import slices

#: (kind, start, end), code points, end exclusive.
Span = tuple[str, int, int]

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def lowered(text: str) -> str:
    """A-Z lowered and nothing else, so that positions stay."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find_spans(docs: DataFrame, finder: Callable[[], Callable[[str], list[Span]]], text: str = "text") -> DataFrame:
    """docs with a column `found`, array of (kind, start, end). One narrow pass over whole texts; a null text is empty.

    finder is called once in each task and gives the function that scans a text.
    """
    rest = [c for c in docs.columns if c != "found"]
    keep = docs.select(*rest)
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = finder()
        for b in slices(batches):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t or "")] for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(item))], [*b.schema.names, "found"])

    return keep.mapInArrow(run, T.StructType([*keep.schema.fields, T.StructField("found", SPANS)]))


def ordered(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
