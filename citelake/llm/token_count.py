"""SentencePiece token counts with a whole-token shortcut.

White space is written U+2581 and no piece holds it after another character, so a text falls into segments (white space,
then other characters) that encode independently. ``whole_tokens`` proves once per worker which vocabulary strings
encode alone as one token; segments equal to one of these count 1. Only the other segments are merged, each distinct
one once per batch.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows and extra columns pass through unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece as spm
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelake.llm.bpe import _renamed
from citelake.llm.common import chunks, column, fresh_name, mapped, text_buffer

#: Fixed value: the mark that stands for a space.
MARK = "▁"
#: Segments that a worker remembers besides the proven ones before it starts afresh.
CACHE_SEGMENTS = 500_000
_SEGMENT = re.compile(" +[^ ]*")


class PieceCounter:
    def __init__(self, path: str):
        self.model = spm.SentencePieceProcessor(model_file=path)
        self.proven = self.whole_tokens()
        self.known = dict(self.proven)

    def whole_tokens(self) -> dict[str, int]:
        """Segments (their first mark left off) that a piece spells and that encode to that piece alone."""
        m = self.model
        strings = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        if any(MARK in s.lstrip(MARK) for s in strings):
            raise ValueError("a piece holds white space after another character")
        if m.encode(" a") != m.encode(MARK + "a") or len(m.encode("  ")) == len(m.encode("")):
            raise ValueError("the model drops white space")
        asked = [s[1:].replace(MARK, " ") for s in strings if s[0] == MARK and len(s) > 1]
        return {s: 1 for s, ids in zip(asked, m.encode(asked, num_threads=1), strict=True) if len(ids) == 1}

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        text = " " + text.replace(MARK, " ")
        if "  " not in text and text[-1] != " ":
            return text.split(" ")[1:]
        return [s[1:] for s in _SEGMENT.findall(text)]

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.segments(t) for t in texts]
        if len(self.known) > CACHE_SEGMENTS + len(self.proven):
            self.known = dict(self.proven)
        rest = list(set().union(*split).difference(self.known)) if split else []
        if rest:
            # a lone mark is a segment with nothing after it: the library adds its mark only to a text that isn't empty
            known = self.known
            for s, ids in zip(rest, self.model.encode(rest, num_threads=1), strict=True):
                known[s] = len(ids) if s else 1
        get = self.known.__getitem__
        return [sum(map(get, s)) for s in split]


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with a long column of token counts; narrow."""
    tmp = fresh_name("n")
    k = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(path)
        for batch in batches:
            texts = batch.column(k)
            _, offsets = text_buffer(texts)
            n = np.zeros(len(texts), np.int64)
            for i, j in chunks(offsets):
                n[i:j] = pieces.counts([t or "" for t in texts.slice(i, j - i).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], names=[*batch.schema.names, tmp])

    return _renamed(mapped(docs, run, [T.StructField(tmp, T.LongType(), False)]), docs, tmp, out)


def budgeted(docs: DataFrame, path: str, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    return count_tokens(docs, path, text_col).withColumn("n_bytes", F.coalesce(F.octet_length(column(text_col)), F.lit(0)).cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)
