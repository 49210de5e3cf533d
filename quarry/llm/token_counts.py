"""Token counts: Arrow batches are encoded, only lengths come back.

A text is cut at safe boundaries, single spaces between two characters that
are not white space. The tokenizers' pre-tokenisation always starts a new
piece there and never looks back, so a text's count is the sum over its
parts. Parts repeat very often; each worker keeps the counts of short parts
in a bounded table and encodes only parts that it has not seen, in batches of
a bounded number of bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import ship_package

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of text handled at once; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20
#: Parts up to this many characters are remembered, so many of them at most.
SHORT, REMEMBERED = 64, 1_000_000
#: Parts above this many characters are cut at single line ends too.
LONG = 1 << 16

_SPACE = re.compile(r" (?<=\S )(?=\S)")
_LINE = re.compile(r"(?<=\S)(?=\n\S)")


class Counter:
    """Token counts of texts under one tokenizer file."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(
            vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def _encode(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        run, size = [], 0
        for p in parts:
            run.append(p)
            size += len(p)
            if size >= BATCH_BYTES // 4:
                out += map(len, self.tokenizer.encode_batch_fast(run, add_special_tokens=False))
                run, size = [], 0
        if run:
            out += map(len, self.tokenizer.encode_batch_fast(run, add_special_tokens=False))
        return out

    def _whole(self, part: str) -> int:
        return sum(self._encode(_LINE.split(part) if len(part) > LONG else [part]))

    def counts(self, texts: list[str | None]) -> list[int]:
        # the first part has no space before it; all others do
        cut = [_SPACE.split(t) if t else [] for t in texts]
        seen = set()
        for parts in cut:
            seen.update(parts[1:])
        if len(self.known) + len(seen) > REMEMBERED:
            self.known.clear()
        fresh = [p for p in seen.difference(self.known) if len(p) <= SHORT]
        known = self.known
        known.update(zip(fresh, self._encode([" " + p for p in fresh])))
        extra: dict[str, int] = {p: self._whole(" " + p) for p in seen if len(p) > SHORT}
        heads = self._encode([p[0] if p and len(p[0]) <= LONG else "" for p in cut])
        out = []
        for parts, n in zip(cut, heads):
            if parts:
                if len(parts[0]) > LONG:
                    n = self._whole(parts[0])
                if extra:
                    n += sum(known[p] if len(p) <= SHORT else extra[p] for p in parts[1:])
                else:
                    n += sum(map(known.__getitem__, parts[1:]))
            out.append(n)
        return out


@lru_cache(maxsize=4)
def _counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)


def _batches(column: pa.Array) -> Iterator[list[str | None]]:
    run, size = [], 0
    for value in column:
        text = value.as_py()
        run.append(text)
        size += len(text or "")
        if size >= BATCH_BYTES:
            yield run
            run, size = [], 0
    if run:
        yield run


def token_count_udf(vocabulary: str = VOCABULARY):
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(vocabulary)
        for column in batches:
            out: list[int] = []
            for texts in _batches(column):
                out += counter.counts(texts)
            yield pa.array(out, pa.int64())
    return F.arrow_udf(count, LongType())


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY,
                 limit: int = 1024) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` of every whole text.

    ``vocabulary`` is a file name of the public tokenizers or a path that
    every executor can read. No special tokens are added, nothing is cut or
    padded; special strings inside a text are handled as the library does by
    default. A null or empty text has 0 bytes and 0 tokens. Rows are
    independent, so repeated rows repeat their result; columns of the three
    names are replaced, all others stay.
    """
    ship_package(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    return (docs.withColumn("n_bytes", F.octet_length(whole).cast("long"))
            .withColumn("n_tokens", token_count_udf(vocabulary)(whole))
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
