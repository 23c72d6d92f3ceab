"""Token counts of whole texts by overlap resynchronisation.

Short texts go to the sentencepiece library as they are. Long ones are encoded in overlapping chunks with offsets and
spliced where both encodings hold the same whole token at the same place. Such a boundary is proven stable: a sequence
of pieces is the greedy encoding of its text exactly if every two neighbours are the encoding of their own
concatenation (merges inside one piece never depend on pieces that are not its neighbour), and after a splice at a
shared token each pair of neighbours stands side by side in one of the two encodings. Where an overlap has no such
token it is widened, at last to the whole rest of the text, so results are always those of the whole text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, pick

#: Texts beyond this many code points are encoded in chunks of this size.
CHUNK_CHARS, OVERLAP_CHARS = 16_384, 128
LIMIT = 4096


class ChunkedEncoder:
    """encode() in chunks with the exact ids of the whole text, for BPE models with byte fallback and no normalisation."""

    def __init__(self, model: bytes, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.sp.get_piece_size()
        self.chunk, self.overlap = max(chunk, 4), max(1, min(overlap, max(chunk, 4) // 2))
        self.byte = {i: int(self.sp.id_to_piece(i)[3:5], 16) for i in range(n) if self.sp.is_byte(i)}
        self.width = [len(self.sp.id_to_piece(i)) for i in range(n)]
        self.widened = 0  # how often an overlap had to grow, for tests and monitoring

    def _tail(self, ids: list[int], end: int, low: int) -> dict[tuple[int, int], int]:
        """Tokens that begin at or after `low`, walking back from `end`: {(begin, end): ids up to and with it}."""
        found, k = {}, len(ids)
        while k and end > low:
            first = k - 1
            if ids[first] in self.byte:  # the bytes of one character form one token
                while self.byte[ids[first]] & 0xC0 == 0x80:
                    first -= 1
                begin = end - 1
            else:
                begin = end - self.width[ids[first]]
            if begin < low:
                break
            found[begin, end] = k
            k, end = first, begin
        return found

    def _meet(self, left: dict[tuple[int, int], int], ids: list[int], begin: int, top: int) -> tuple[int, int, int] | None:
        """The first token of `ids` (which start at `begin`) that is also in `left`: (ids left, ids right, its end)."""
        k = 0
        while k < len(ids) and begin < top:
            if ids[k] in self.byte:
                lead = self.byte[ids[k]]
                size, end = (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4), begin + 1
            else:
                size, end = 1, begin + self.width[ids[k]]
            k += size
            if (begin, end) in left:
                return left[begin, end], k, end
            begin = end
        return None

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.chunk:
            return self.sp.encode(text)
        out: list[int] = []
        start, stop = 0, self.chunk
        ids, skip, fixed = self.sp.encode(text[:stop]), 0, 0  # skip: ids of this chunk that the splice before replaced
        while stop < len(text):
            overlap, met = self.overlap, None
            while not met and stop - overlap > max(fixed, start):
                b0 = stop - overlap
                b1 = min(len(text), stop - overlap + self.chunk + overlap)
                more = self.sp.encode(text[b0:b1])
                met = self._meet(self._tail(ids, stop, b0), more, b0 - 1, stop)  # a chunk's first token holds the added blank
                if not met:
                    overlap *= 2
                    self.widened += 1
            if met and met[0] >= skip:
                out += ids[skip : met[0]]
                ids, skip, fixed, start, stop = more, met[1], met[2], b0, b1
            else:  # nothing in common back to the last splice: this chunk itself grows
                self.widened += 1
                stop = min(len(text), stop + max(self.chunk, stop - start))
                ids = self.sp.encode(text[start:stop])
                if start:  # find the last splice again: the token that ends there is stable
                    hit = self._ends(ids, start - 1, fixed)
                    if hit is None:
                        return self.sp.encode(text)
                    skip = hit
        return out + ids[skip:]

    def _ends(self, ids: list[int], begin: int, at: int) -> int | None:
        k = 0
        while k < len(ids) and begin < at:
            if ids[k] in self.byte:
                lead = self.byte[ids[k]]
                k += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                begin += 1
            else:
                begin += self.width[ids[k]]
                k += 1
        return k if begin == at else None

    def count(self, text: str) -> int:
        return len(self.encode(text))


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit); no begin, end or added special tokens.

    Null text counts as empty (0 bytes, 0 tokens, not over the limit). Ids pass through, nulls and repeats included: one
    row out per row in, so ties and repeated rows need no rule. Empty tables give empty results; further columns, of
    whatever name, are not read. The model (0.5 MB, fixed) travels with the tasks.
    """
    with open(model_path, "rb") as f:
        model = f.read()

    def make():
        enc = ChunkedEncoder(model, chunk_chars, overlap_chars)

        def run(texts: list[str | None]) -> dict[str, list]:
            texts = [t or "" for t in texts]
            counts = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= enc.chunk]
            for lo in range(0, len(short), 64):
                part = short[lo : lo + 64]
                for i, ids in zip(part, enc.sp.encode([texts[i] for i in part], num_threads=1), strict=True):
                    counts[i] = len(ids)
            for i, t in enumerate(texts):
                if len(t) > enc.chunk:
                    counts[i] = enc.count(t)
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [c > limit for c in counts]}

        return run

    return map_texts(pick(df, {"doc_id": id_col, "text": text_col}), make, [("n_bytes", "bigint", pa.int64()), ("n_tokens", "bigint", pa.int64()), ("over_limit", "boolean", pa.bool_())]).withColumnRenamed("doc_id", id_col)
