"""Byte-level BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of a pre-token. A proposal is the true encoding exactly when every adjacent
pair of its tokens is compatible, that is when the pair's bytes encode to that pair; all pairs of a batch are looked up
at once in a table of judged pairs. Only pre-tokens with a failing pair go through exact merging.

Defined results: a null text counts as empty and gives no ids; an empty id list decodes to the empty text; ids outside
the vocabulary are skipped in decoding; byte sequences that are not UTF-8 decode with U+FFFD; rows, repeated ones too,
and extra columns pass through unchanged, but a column of an output's name gives way; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from citelake.llm.common import chunks, fresh_name, mapped, text_buffer

# Fixed value: the pre-token pattern of the ByteLevel pre-tokenizer.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space before white space or at the end, where a text can't simply be cut at its spaces.
_UNCUT = re.compile(r" (?=\s|$)")
_BETWEEN = "\u0100"
#: Pieces of text between spaces that a worker remembers before it starts afresh.
CACHE_PIECES = 200_000
#: Judged pairs that a worker remembers before it starts afresh.
CACHE_PAIRS = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else code points from 256 up in byte order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normalizer or prefix space is supported")
        of = byte_alphabet()
        self.tokens: dict[int, bytes] = {i: bytes(of[c] for c in t) for t, i in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        if any(vocab[a + b] <= max(vocab[a], vocab[b]) for a, b in merges) or [vocab[a + b] for a, b in merges] != sorted(vocab[a + b] for a, b in merges):
            raise ValueError("ids must follow the order of merges")
        ranks = {t: i for i, t in self.tokens.items()}
        self.exact = tiktoken.Encoding("own", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.byte_id = [vocab[c] for c, _ in sorted(of.items(), key=lambda x: x[1])]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need word bounds are not supported")
        self.tokens |= {i: s.encode() for s, i in self.special.items()}
        added = set(self.special.values())
        # only tokens that their own bytes encode to can stand in an encoding
        self.ids = {b: i for i, b in self.tokens.items() if i not in added and self.exact(b) == [i]}
        self.matcher = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.matcher.add_word(t.decode("latin-1"), i)
        self.matcher.add_word(_BETWEEN, -1)
        self.matcher.make_automaton()
        self.pattern = regex.compile(PRETOKEN)
        self.parts = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.shift = max(self.tokens).bit_length()
        size = max(self.tokens) + 1
        self.length = np.zeros(size, np.int64)
        for i, b in self.tokens.items():
            self.length[i] = len(b)
        self.start = np.zeros(size + 1, np.int64)
        np.cumsum(self.length, out=self.start[1:])
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)
        self._fresh_pairs()
        self._fresh_pieces()

    def _fresh_pairs(self) -> None:
        self.judged, self.good = np.zeros(0, np.int64), np.zeros(0, bool)

    def _fresh_pieces(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.begin = array("i"), array("q", [0])

    def greedy(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from the left of all pieces in a row, and the piece of each; every byte is a token, so none is
        left over. The automaton works on Latin-1 text, with a sign between pieces that no token has."""
        text = "".join(p.decode("latin-1") + _BETWEEN for p in pieces)
        found = np.fromiter((t for _, t in self.matcher.iter_long(text)), np.int64)
        between = found < 0
        return found[~between], np.cumsum(between)[~between]

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For each key (left << shift | right): does the pair's text encode to this pair?"""
        keys, where = np.unique(pairs, return_inverse=True)
        new = keys[~np.isin(keys, self.judged, assume_unique=True)]
        if len(new):
            low = (1 << self.shift) - 1
            split = [(k >> self.shift, k & low) for k in new.tolist()]
            good = np.fromiter((self.exact(self.tokens[a] + self.tokens[b]) == [a, b] for a, b in split), bool, len(new))
            if len(self.judged) > CACHE_PAIRS:
                self._fresh_pairs()
                return self.compatible(pairs)
            order = np.argsort(both := np.concatenate([self.judged, new]))
            self.judged, self.good = both[order], np.concatenate([self.good, good])[order]
        return self.good[np.searchsorted(self.judged, keys)][where]

    def propose(self, words: list[str]) -> dict[str, list[int]]:
        """The encoding of each distinct pre-token: greedy where all adjacent pairs are compatible, else exact."""
        pieces = [w.encode("utf-8", "surrogatepass") for w in words]
        flat, owner = self.greedy(pieces)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
        ids, at = flat.tolist(), np.searchsorted(owner, np.arange(len(pieces) + 1)).tolist()
        proposed = [ids[i:j] for i, j in zip(at, at[1:], strict=False)]
        if len(inner):
            ok = self.compatible(flat[inner] << self.shift | flat[inner + 1])
            for k in np.unique(owner[inner[~ok]]).tolist():
                proposed[k] = self.exact(pieces[k])
        return dict(zip(words, proposed, strict=True))

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces of text and remember them."""
        # a run of letters, with or without a space before it, is one pre-token
        plain = lambda p: p.isalpha() or p[:1] == " " and p[1:].isalpha()
        split = [[p] if p in self.special or plain(p) else self.pattern.findall(p) for p in pieces]
        of = self.propose(list(set().union(*split).difference(self.special))) | {s: [i] for s, i in self.special.items()}
        flat, begin, code = self.flat, self.begin, self.code
        for piece, pretokens in zip(pieces, split, strict=True):
            for w in pretokens:
                flat.extend(of[w])
            code[piece] = len(begin) - 1
            begin.append(len(flat))

    def pieces(self, text: str) -> list[str]:
        """Pieces of text that encode independently.

        A space followed by other than white space begins a pre-token, so most texts can be cut at their spaces.
        """
        if self.parts is not None and any(s in text for s in self.special):
            return [q for p in self.parts.split(text) for q in ([p] if p in self.special else self.pieces(p))]
        if not text:
            return []
        if _UNCUT.search(text):
            return self.pattern.findall(text)
        return text.replace(" ", "\0 ").split("\0") if "\0" not in text else self.pattern.findall(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text."""
        split = [self.pieces(t) for t in texts]
        if len(self.code) > CACHE_PIECES:
            self._fresh_pieces()
        new = list(set().union(*split).difference(self.code)) if split else []
        if new:
            self.learn(new)
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        begin, flat = np.array(self.begin, dtype=np.int64), np.array(self.flat, dtype=np.int32)
        ids, piece_at = _ranges(flat, begin[codes], begin[codes + 1] - begin[codes])
        text_at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(w) for w in split], out=text_at[1:])
        return ids, piece_at[text_at]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        keep = (ids >= 0) & (ids < len(self.length))
        ids = np.where(keep, ids, 0)
        data, at = _ranges(self.bytes, self.start[ids], np.where(keep, self.length[ids], 0))
        at = np.ascontiguousarray(at[offsets])
        out = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            raw = data.tobytes()
            out = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)], pa.large_string())
        return out


def _ranges(source: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """source[start:start + size] of all entries in a row, and the offsets (length entries + 1)."""
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return source[np.repeat(start - at[:-1], size) + np.arange(at[-1])], at


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """docs with an array<int> column of token ids, and, where it is named, a column of what the ids decode to; narrow,
    one batch in memory at a time."""
    names = [fresh_name("ids"), *([fresh_name("text")] if decoded else [])]
    kinds = [T.ArrayType(T.IntegerType(), False), T.StringType()]
    fields = [T.StructField(c, kind, False) for c, kind in zip(names, kinds, strict=False)]
    k = docs.columns.index(text_col)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = batch.column(k)
            _, offsets = text_buffer(texts)
            for i, j in chunks(offsets):
                ids, at = bpe.encode([t or "" for t in texts.slice(i, j - i).to_pylist()])
                made = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded:
                    made.append(bpe.decode(ids, at).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *made], names=[*batch.schema.names, *names])

    made = mapped(docs, encoded, fields)
    for tmp, name in zip(names, (out, decoded), strict=False):
        made = _renamed(made, docs, tmp, name)
    return made


def decode(docs: DataFrame, path: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """docs with the text that the ids stand for."""
    tmp = fresh_name("text")
    k = docs.columns.index(ids_col)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            lists = batch.column(k)
            sizes = np.array(lists.value_lengths().fill_null(0), np.int64)
            offsets = np.zeros(len(sizes) + 1, np.int64)
            np.cumsum(sizes, out=offsets[1:])
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            for i, j in chunks(offsets, 1 << 19):
                made = bpe.decode(ids[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                columns = [*batch.slice(i, j - i).columns, made.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, tmp])

    return _renamed(mapped(docs, restored, [T.StructField(tmp, T.StringType(), False)]), docs, tmp, out)


def _renamed(made: DataFrame, docs: DataFrame, tmp: str, out: str) -> DataFrame:
    """An existing column of the output's name gives way."""
    return made.drop(*[c for c in docs.columns if c == out]).withColumnRenamed(tmp, out)
