"""SentencePiece encoding and decoding with a merge-type prefix table.

A BPE model merges the neighbouring symbols whose concatenation is the best-scored piece, leftmost first. For every
prefix of a text the encoding ends in one token, and that token is unique: it is the only piece that ends there, is its
own encoding, and is compatible with the last token of the prefix before it (the pair is the encoding of its own
concatenation). So a table with one token per prefix, filled from the matches of an Aho-Corasick automaton over the
pieces, holds the whole encoding; ids are recovered backwards from the end. Pair tests are memoised.

No piece holds the blank mark behind another character, nor a letter beside a character of another kind, so texts are cut
there (what the vocabulary allows is worked out when it is loaded), and segments met before are taken from a bounded cache.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, pick

MARK = "▁"
#: Segments kept in a worker's cache, and the longest that is kept; both bound memory, neither changes results.
CACHE_SEGMENTS, CACHE_CHARS = 250_000, 48


class PrefixTableCodec:
    """Encoder and decoder for a BPE .model with byte fallback, identity normalisation and an added leading blank."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.score = {self.piece[i]: sp.get_score(i) for i in range(n) if not special[i]}
        self.id = {self.piece[i]: i for i in range(n) if not special[i]}
        self.bytes_of = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                self.bytes_of[i] = bytes([int(self.piece[i][3:5], 16)])
            elif not special[i]:
                self.bytes_of[i] = self.piece[i].replace(MARK, " ").encode()
        byte_ids = {self.bytes_of[i]: i for i in range(n) if sp.is_byte(i)}
        self.byte_ids = [byte_ids[bytes([b])] for b in range(256)]
        self.eos = sp.eos_id()
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if len(self.merged(p)) == 1:  # others are never a token
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        if any(MARK in p.lstrip(MARK) for p in self.id):
            self.segments = lambda s: [s]
        else:
            apart = "".join(c for c in "\n\t\r" if not any(c in p for p in self.id))
            cut, odd = re.escape(apart), re.escape("".join(sorted(self._odd_letters())))
            letters, others = rf"[^\W_{odd}]+", rf"(?:(?![{MARK}{cut}])[\W_{odd}])+"
            self.segments = re.compile(f"{MARK}*(?:{letters}|{others})|{MARK}+" + (f"|[{cut}]" if cut else "")).findall
        self.pairs: dict[int, bool] = {}
        self.odd: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _odd_letters(self) -> set[str]:
        """Letters and digits to be taken with the other characters, so that no piece holds a letter beside one of these
        (but for leading blank marks): texts may be cut between the two kinds."""
        odd: set[str] = set()
        while True:
            kind = lambda c: c.isalnum() and c not in odd
            mixed = {c for p in self.id for a, b in zip(p, p[1:], strict=False) if a != MARK and kind(a) != kind(b) for c in (a, b) if kind(c)}
            if not mixed:
                return odd
            odd |= mixed

    def merged(self, s: str) -> list[str]:
        """The encoding of a short string by plain merging: the definition that pair tests rest on."""
        sym = list(s)
        while len(sym) > 1:
            best, at = None, -1
            for k in range(len(sym) - 1):
                v = self.score.get(sym[k] + sym[k + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, k
            if at < 0:
                break
            sym[at : at + 2] = [sym[at] + sym[at + 1]]
        return sym

    def _fits(self, left: int, right: int) -> bool:
        """Is the pair the encoding of its concatenation? Negative numbers stand for characters outside the vocabulary."""
        if left >= 0 and right >= 0:
            key = left << 20 | right
            ok = self.pairs.get(key)
            if ok is None:
                if len(self.pairs) > 400_000:
                    self.pairs.clear()
                a, b = self.piece[left], self.piece[right]
                ok = self.pairs[key] = self.merged(a + b) == [a, b]
            return ok
        a = self.piece[left] if left >= 0 else chr(-left - 1)
        b = self.piece[right] if right >= 0 else chr(-right - 1)
        ok = self.odd.get((a, b))
        if ok is None:
            if len(self.odd) > 200_000:
                self.odd.clear()
            ok = self.odd[a, b] = self.merged(a + b) == [a, b]
        return ok

    def table(self, s: str) -> tuple[list[int], list[int]]:
        """The last token and its length for each non-empty prefix of s."""
        last, width = [0] * len(s), [0] * len(s)
        done = -1
        known = self.pairs.get

        def unknown(upto: int) -> None:  # characters that are no piece themselves
            for k in range(done + 1, upto):
                last[k], width[k] = -ord(s[k]) - 1, 1

        for end, (i, size) in self.automaton.iter(s):
            if end == done:  # one token ends here, and it is found
                continue
            if end > done + 1:
                unknown(end)
            start = end - size
            if start >= 0:
                prev = last[start]
                ok = known(prev << 20 | i) if prev >= 0 else None
                if ok is None:
                    ok = self._fits(prev, i)
                if not ok:
                    continue
            last[end], width[end], done = i, size, end
        unknown(len(s))
        return last, width

    def _segment(self, s: str) -> tuple[int, ...]:
        last, width = self.table(s)
        ids: list[int] = []
        k = len(s) - 1
        while k >= 0:
            if last[k] >= 0:
                ids.append(last[k])
            else:
                ids.extend(self.byte_ids[b] for b in reversed(s[k].encode()))
            k -= width[k]
        ids.reverse()
        return tuple(ids)

    def encode(self, text: str, end: bool = True) -> list[int]:
        if not text:
            return [self.eos] if end else []
        cache = self.cache
        parts = self.segments(MARK + text.replace(" ", MARK))
        found = list(map(cache.get, parts))
        for k in [k for k, ids in enumerate(found) if ids is None]:
            s = parts[k]
            found[k] = ids = cache.get(s) or self.older.get(s) or self._segment(s)
            if len(s) <= CACHE_CHARS:
                if len(cache) >= CACHE_SEGMENTS // 2:  # two generations: what is met again stays
                    self.older, cache = cache, {}
                    self.cache = cache
                cache[s] = ids
        out = list(chain.from_iterable(found))
        if end:
            out.append(self.eos)
        return out

    def decode(self, ids: list[int]) -> str:
        """Pieces and bytes joined, blank marks turned to blanks, the added leading blank taken away; control ids vanish."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_loaded: dict[bytes, PrefixTableCodec] = {}


def codec(model: bytes) -> PrefixTableCodec:
    """One codec for each worker process, so that its caches serve task after task."""
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = PrefixTableCodec(model)
    return _loaded[model]


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """Per row: the id, ids array<int> (the library's ids, with the end id if asked), decoded string.

    Null text counts as empty: only the end id, decoded ''. Ids of rows pass through, nulls and repeats included, one row
    out per row in. Empty tables give empty results; further columns, of whatever name, are not read.
    """
    with open(model_path, "rb") as f:
        model = f.read()

    def make():
        c = codec(model)

        def run(texts: list[str | None]) -> dict[str, list]:
            ids = [c.encode(t or "", end) for t in texts]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
            return {"ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)), "decoded": [c.decode(x) for x in ids]}

        return run

    return map_texts(pick(df, {"doc_id": id_col, "text": text_col}), make, [("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())]).withColumnRenamed("doc_id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from encode_decode()'s output."""
    return encoded.select(id_col, F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
