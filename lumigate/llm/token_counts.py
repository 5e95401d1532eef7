"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table of the tokenizer's own vocabulary as pre-token text -> number of tokens: the
pre-tokens that its training corpus had most often, at most one entry for each vocabulary id. Tier two is
a bounded cache in each Python worker; only a pre-token in neither is encoded. No pre-token is ever
shuffled: the job is one narrow pass over the texts.

Texts with a special token's string, or with characters outside the alphabet whose classes are spelled
out below, go through the library whole, so the counts equal the library's for every text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigate.llm.base import slices, table, texts_of

#: Entries of a worker's cache, after which it starts anew; longer pre-tokens are encoded each time, so it has a bound in bytes.
CACHE_ENTRIES = 400_000
CACHE_LENGTH = 64
LIMIT = 512
#: Code points up to here have their classes spelled out for the standard library's engine.
KNOWN = 0x250


def _class(test) -> str:
    return "".join(re.escape(chr(c)) for c in range(KNOWN) if test(chr(c)))


LETTERS = _class(lambda c: unicodedata.category(c)[0] == "L")
NUMBERS = _class(lambda c: unicodedata.category(c)[0] == "N")
SPACES = " \\t\\n\\r\\x0b\\x0c\\x85\\xa0"
#: The byte-level pre-tokenizer's pattern with its classes spelled out.
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: General punctuation is neither letter, number nor space from U+2010 to U+2027.
UNKNOWN = re.compile(f"[^\\x00-\\x1b{re.escape(chr(0x20))}-{chr(KNOWN - 1)}‐-‧]")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_pattern(tok) -> re.Pattern | None:
    """The strings that the library takes out of a text before pre-tokenizing it."""
    found = [a.content for a in tok.get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, found))) if found else None


def frequent_lengths(path: str) -> dict[str, int]:
    """Tier one: the vocabulary's entries that are one pre-token, with their number of tokens."""
    tok = load(path)
    texts = [t for t in tok.decode_batch([[i] for i in range(tok.get_vocab_size(with_added_tokens=False))], skip_special_tokens=False) if "�" not in t]
    texts = [t for t in texts if PRE_TOKEN.fullmatch(t) and not UNKNOWN.search(t) and PRE_TOKEN.findall(t) == [t]]
    return dict(zip(texts, (len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)), strict=True))


class Lengths(dict):
    """Pre-token -> number of tokens: the broadcast entries and this worker's cache."""

    def __init__(self, tok, frequent: dict[str, int], entries: int = CACHE_ENTRIES):
        super().__init__(frequent)
        self.tok, self.frequent, self.most = tok, frequent, len(frequent) + entries

    def __missing__(self, pre: str) -> int:
        n = len(self.tok.encode(pre, add_special_tokens=False).ids)
        if len(pre) <= CACHE_LENGTH:
            if len(self) >= self.most:
                self.clear()
                self.update(self.frequent)
            self[pre] = n
        return n


def counter(path: str, frequent: dict[str, int]):
    tok = load(path)
    special, lengths = special_pattern(tok), Lengths(tok, frequent)

    def count(text: str) -> int:
        if UNKNOWN.search(text) or special and special.search(text):
            return len(tok.encode(text, add_special_tokens=False).ids)
        return sum(map(lengths.__getitem__, PRE_TOKEN.findall(text)))

    return count


def token_counts(docs: DataFrame, path: str | None = None, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) added.

    A null or empty text has 0 bytes and 0 tokens; texts are never cut; every row is kept, repeated ones
    too; columns of docs with the new names are replaced.
    """
    spark, path = docs.sparkSession, path or tokenizer_path()
    frequent = spark.sparkContext.broadcast(frequent_lengths(path))
    rest = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    keep = docs.select(*rest) if text in rest else docs.select(*rest, F.col(text))
    schema = T.StructType([*keep.schema.fields, T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, frequent.value)
        for b in slices(batches):
            n = pa.array([count(t) for t in texts_of(b, text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n], [*b.schema.names, "n_tokens"])

    return keep.mapInArrow(run, schema).withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
