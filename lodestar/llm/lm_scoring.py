"""Cross-entropy difference scoring with matched target and background bigram models that stay distributed.

Both models share one vocabulary, every word of either side, and are smoothed alike. With c the counts of a side, N its
tokens and V the words of the vocabulary, a text being its words between two boundaries (a token as any other):

    p(w) = (c(w) + 1) / (N + V + 1)        p(w | before) = (c(before, w) + MU * p(w)) / (c(before) + MU)

No word or pair is left out, at any corpus size, and no count reaches the driver. Tasks count chunks of texts: each
distinct word and pair of a chunk is a 64-bit code with its counts, sorted and packed, and codes are dealt over blocks by
their leading bits. A block's counts are summed over all chunks and handed back, in the order in which they came. Where
a chunk's sums meet its tokens again, its texts are scored. Beyond FAN chunks this takes levels: a team of chunks is merged
block by block, its sums are dealt over finer blocks and meet those of other teams there, and the totals come back by the
same way. Each level has as many rows as chunks times the blocks of one, so what is shuffled grows with the corpus, a few
bytes a token and level (two up to 100 TB); memory is that of a chunk or of a block of one team, which are as large.

Texts are read twice, for counts and for tokens, and chunks are named alike in both reads, by their place and a digest of
their texts: a task that runs again makes the same ones, and tokens without their own sums are an error, not a score.

A document's score is the mean over its tokens (its end is one) of the target's loss less the background's, in nats: the
lower, the more it reads like the target.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut, pick, small_batches

#: Weight, in tokens, that the single words' share has in each pair's estimate.
MU = 1.0
#: Tokens of a chunk, at least, where a task has as many; bytes of text for each block of codes, and the least blocks.
CHUNK_TOKENS, BLOCK_BYTES, MIN_BLOCKS = 1_500_000, 8 << 20, 256
#: Chunks whose counts are summed at one level, and blocks that one level deals codes over, at most.
FAN = 4096
#: Tokens whose losses are worked out at once.
STEP = 1 << 18
#: Up to so many ids (8 bytes each) the target's ids are broadcast; beyond, the texts are shuffled to meet them.
BROADCAST_IDS = 1 << 20
BOUNDARY, SEED = b"\n", 0x10AD


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, with A-Z lower-cased."""
    return (text or "").encode().lower().split()


class Vocabulary(dict):
    """word -> number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def planes(*columns: np.ndarray) -> bytes:
    """Unsigned columns, byte planes apart, compressed: small numbers take little."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns))


def from_planes(raw: bytes, *kinds: str) -> list[np.ndarray]:
    """The columns that planes() packed, of these types."""
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n = len(data) // sum(widths)
    ends = np.cumsum([w * n for w in widths])
    return [np.ascontiguousarray(data[e - w * n : e].reshape(w, n).T).view(k)[:, 0] for e, w, k in zip(ends, widths, kinds, strict=True)]


def pair_codes(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """64-bit codes of pairs from those of their words."""
    z = (before ^ (before >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + now
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def block_of(codes: np.ndarray, blocks: int) -> np.ndarray:
    """0 .. blocks - 1, ascending with the codes."""
    return ((codes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def steps(now: np.ndarray, sizes: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """Words before, and words, of all tokens; `now` holds the words of texts of these sizes, texts without any left out."""
    ends = np.cumsum(sizes)
    after = np.insert(now, ends, boundary)
    return np.insert(now, ends - sizes, boundary), after


def distinct_pairs(before: np.ndarray, now: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the distinct pairs, ascending, and which of them each token's pair is. codes: of the words."""
    key = before.astype(np.int64) * len(codes) + now
    by = np.argsort(key, kind="stable").astype(np.int32 if len(key) < 1 << 31 else np.int64)
    key = key[by]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=bool)
    pairs = key[new]
    del key
    code = pair_codes(codes[pairs // len(codes)], codes[pairs % len(codes)])
    order = np.argsort(code, kind="stable")
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    at = np.empty(len(by), dtype=np.int32)
    at[by] = place[np.cumsum(new, dtype=np.int32) - 1]
    return code[order], at


class Chunk:
    """Texts that are counted together: their word numbers, ids, and the sides that count them."""

    def __init__(self):
        self.words = Vocabulary({BOUNDARY: 0})
        self.numbers: list[np.ndarray] = []
        self.ids, self.sizes, self.sides = [], [], []
        self.digest = hashlib.blake2b(digest_size=12)
        self.n = 0

    def add(self, doc_id, text: str | None, target: bool, background: bool) -> None:
        raw = (text or "").encode()
        self.digest.update(len(raw).to_bytes(8, "little") + raw)
        ws = tokens(text)
        self.numbers.append(np.fromiter(map(self.words.__getitem__, ws), dtype=np.uint32, count=len(ws)))
        self.ids.append(doc_id)
        self.sizes.append(len(ws))
        self.sides.append((bool(background), bool(target)))
        self.n += len(ws) + 1

    def sorted(self) -> tuple[np.ndarray, np.ndarray, int]:
        """The codes of the words, ascending; the words of all texts as places among these; the boundary's place."""
        from xxhash import xxh64_intdigest

        code = np.fromiter((xxh64_intdigest(w, SEED) for w in self.words), dtype=np.uint64, count=len(self.words))
        order = np.argsort(code, kind="stable")
        place = np.empty(len(order), dtype=np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        return code[order], place[np.concatenate(self.numbers)], int(place[0])

    def whole(self) -> Iterator[tuple]:
        """What puts the texts together again, as block -1: (block, words, pairs, ids, sizes)."""
        code, flat, boundary = self.sorted()
        yield -1, planes(np.diff(code, prepend=np.uint64(0))) + boundary.to_bytes(8, "little"), planes(flat), self.ids, self.sizes

    def counts(self, blocks: int) -> Iterator[tuple]:
        """The same columns with the counts of each block's codes."""
        code, flat, boundary = self.sorted()
        sizes = np.array(self.sizes, dtype=np.int64)
        some = sizes > 0
        before, now = steps(flat, sizes[some], boundary)
        sides = np.repeat(np.array(self.sides, dtype=bool).reshape(-1, 2)[some], sizes[some] + 1, axis=0)
        pair, at = distinct_pairs(before, now, code)
        del before, flat
        packed = []
        for codes, of in ((code, now), (pair, at)):
            n = [np.bincount(of[sides[:, s]], minlength=len(codes)).astype(np.uint32) for s in (0, 1)]
            edges = np.searchsorted(block_of(codes, blocks), np.arange(blocks + 1))
            packed.append([planes(np.diff(codes[a:b], prepend=np.uint64(0)), n[0][a:b], n[1][a:b]) if b > a else None for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)])
        for b, (w, p) in enumerate(zip(*packed, strict=True)):
            if w or p:
                yield b, w, p, None, None


def chunks(d: DataFrame, describe: Callable[[Chunk], Iterator[tuple]]) -> DataFrame:
    """Rows (chunk, block, words, pairs, ids, sizes) that describe each chunk of rows (doc_id, text, target, background)."""
    id_type = d.schema["doc_id"].dataType.simpleString()
    ids = arrow_schema(d, ["doc_id"], []).field(0).type
    schema = pa.schema([("chunk", pa.string()), ("block", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary()), ("ids", pa.list_(ids)), ("sizes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0

        def packed(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        def done(c: Chunk) -> Iterator[pa.RecordBatch]:
            name, held = f"{part}-{n}-{c.digest.hexdigest()}", []
            for row in describe(c):
                held.append((name, *row))
                if len(held) == 256:
                    yield packed(held)
                    held = []
            if held:
                yield packed(held)

        chunk = Chunk()
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                chunk.add(*row)
                if chunk.n >= CHUNK_TOKENS:
                    yield from done(chunk)
                    chunk, n = Chunk(), n + 1
        if chunk.ids:
            yield from done(chunk)

    return d.select("doc_id", "text", "target", "background").mapInArrow(run, f"chunk string, block bigint, words binary, pairs binary, ids array<{id_type}>, sizes array<bigint>")


def rows_by(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """The rows that follow each other with equal values in their first columns."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[:width] != held[0][:width]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def merged(raws: list[bytes | None], kind: str) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray | None]]:
    """The distinct codes of packed counts (of this type), their sums on both sides, and where each one's codes are among them."""
    each = [from_planes(r, "u8", kind, kind) if r else None for r in raws]
    there = [x for x in each if x is not None]
    if not there:
        return np.zeros(0, dtype=np.uint64), [np.zeros(0, dtype=np.uint64)] * 2, each
    codes, at = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in there]), return_inverse=True)
    n = [np.bincount(at, weights=np.concatenate([x[s] for x in there])).astype(np.uint64) for s in (1, 2)]
    own, lo = [], 0
    for x in each:
        own.append(at[lo : lo + len(x[0])] if x is not None else None)
        lo += len(x[0]) if x is not None else 0
    return codes, n, own


def sum_blocks(parts: DataFrame, kind: str = "u4") -> DataFrame:
    """chunk, block, words, pairs: the sums over all chunks of a block's counts, in the order in which the chunk has the
    codes. Rows without a chunk have the number of words (v) and the tokens of both sides (n0, n1) of a block."""
    schema = pa.schema([("chunk", pa.string()), ("block", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary()), ("v", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in rows_by(batches, 1):
            block, chunks, words, pairs = held[0][0], *([r[i] for r in held] for i in (1, 2, 3))
            _, n, of_words = merged(words, kind)
            _, m, of_pairs = merged(pairs, kind)
            total = (int(np.count_nonzero(n[0] + n[1])), *(int(x.sum()) for x in n))
            for a in range(0, len(held), 256):
                some = slice(a, a + 256)
                packed = [[planes(x[0][o], x[1][o]) if o is not None else None for o in own[some]] for x, own in ((n, of_words), (m, of_pairs))]
                k = len(chunks[some])
                yield pa.RecordBatch.from_arrays([pa.array(chunks[some], pa.string()), pa.array([block] * k), *(pa.array(x, pa.binary()) for x in packed), *[pa.nulls(k, pa.int64())] * 3], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((None, block, None, None, *total), schema, strict=True)], schema=schema)

    parts = parts.select("block", "chunk", "words", "pairs").repartition("block").sortWithinPartitions("block")
    return parts.mapInArrow(run, "chunk string, block bigint, words binary, pairs binary, v bigint, n0 bigint, n1 bigint")


PACKED = pa.schema([("chunk", pa.string()), ("block", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary())])


def merge_teams(parts: DataFrame, kind: str, blocks: int) -> DataFrame:
    """Rows like those of chunks, for each (team, block): its chunks' counts as one, dealt over so many (finer) blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in rows_by(batches, 2):
            split: dict[int, list[bytes | None]] = {}
            for side in (0, 1):
                codes, n, _ = merged([r[2 + side] for r in held], kind)
                of = block_of(codes, blocks)
                begins = np.flatnonzero(np.diff(of, prepend=-1))
                for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(of)], strict=True):
                    split.setdefault(int(of[a]), [None, None])[side] = planes(np.diff(codes[a:b], prepend=np.uint64(0)), n[0][a:b], n[1][a:b])
            name, found = f"{held[0][0]}.{held[0][1]}", sorted(split.items())
            for a in range(0, len(found), 256):
                yield pa.RecordBatch.from_pylist([{"chunk": name, "block": b, "words": w, "pairs": p} for b, (w, p) in found[a : a + 256]], schema=PACKED)

    parts = parts.select("team", "block", "words", "pairs").repartition("team", "block").sortWithinPartitions("team", "block")
    return parts.mapInArrow(run, "chunk string, block bigint, words binary, pairs binary")


def hand_back(parts: DataFrame, kind: str, sums: DataFrame) -> DataFrame:
    """chunk, block, words, pairs: each chunk's sums, from those of the teams that merge_teams() made of the same parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in rows_by(batches, 1):
            tops, own = [r for r in held if r[2] is None], [r for r in held if r[2] is not None]
            block, out = int(held[0][0].split(".")[1]), []
            for side in (3, 4):
                codes, _, at = merged([r[side] for r in own], kind)
                each = [from_planes(r[side], "u8", "u8") for r in tops if r[side]]
                n = [np.concatenate([x[s] for x in each]) if each else codes for s in (0, 1)]
                if len(n[0]) != len(codes):
                    raise ValueError("a team's sums are not those of its chunks")
                out.append([(n, o) for o in at])
            for a in range(0, len(own), 256):
                packed = [[planes(n[0][o], n[1][o]) if o is not None else None for n, o in x[a : a + 256]] for x in out]
                k = len(packed[0])
                yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in own[a : a + 256]], pa.string()), pa.array([block] * k), *(pa.array(x, pa.binary()) for x in packed)], schema=PACKED)

    below = parts.select(F.concat_ws(".", "team", "block").alias("name"), F.lit(-1).cast("bigint").alias("place"), "chunk", "words", "pairs")
    above = sums.select(F.col("chunk").alias("name"), F.col("block").alias("place"), F.lit(None).cast("string").alias("chunk"), "words", "pairs")
    both = above.unionByName(below).repartition("name").sortWithinPartitions("name", "place")
    return both.mapInArrow(run, "chunk string, block bigint, words binary, pairs binary")


def fan_of(chunks: int) -> int:
    """Chunks that meet at a level: all, up to FAN; else alike at each of as few levels as do."""
    levels = 1
    while FAN**levels < chunks:
        levels += 1
    fan = round(chunks ** (1 / levels))
    return fan if fan**levels >= chunks else fan + 1


def corpus_sums(parts: DataFrame, chunks: int, blocks: int, fan: int, kind: str = "u4") -> tuple[DataFrame, list[int]]:
    """What sum_blocks() says of each chunk, and its three numbers of the corpus, by levels of `fan`. parts: the rows of some
    `chunks` chunks (an estimate sizes the teams, no more) by so many blocks. They are written once, as they are read twice."""
    if chunks <= fan:
        sums = cut(sum_blocks(parts, kind))
        total = sums.where("chunk is null").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("v", "n0", "n1")]).first()
        return sums.where("chunk is not null").select("chunk", "block", "words", "pairs"), list(total)
    teams = -(-chunks // fan)
    parts = cut(parts.select("chunk", "block", "words", "pairs", F.expr(f"pmod(xxhash64(chunk), {teams})").alias("team")))
    sums, total = corpus_sums(merge_teams(parts, kind, blocks * fan), teams, blocks * fan, fan, "u8")
    return hand_back(parts, kind, sums), total


def losses(sizes: np.ndarray, flat: np.ndarray, code: np.ndarray, boundary: int, word_n: list[np.ndarray], pair_n: list[np.ndarray], v: int, n: list[int]) -> np.ndarray:
    """[2, texts]: the mean loss a token of each text under the background and the target model; texts have words."""
    before, now = steps(flat, sizes, boundary)
    pairs, at = distinct_pairs(before, now, code)
    if len(pair_n[0]) != len(pairs) or len(word_n[0]) != len(code):
        raise ValueError("a chunk's sums are not those of its tokens: its input changed between two reads")
    ends = np.cumsum(sizes + 1)
    out, lo = np.empty((2, len(sizes))), 0
    while lo < len(sizes):
        begin = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, begin + STEP)))
        part = slice(begin, int(ends[hi - 1]))
        for s in (0, 1):
            share = (word_n[s][now[part]] + 1.0) / (n[s] + v + 1)
            p = (pair_n[s][at[part]] + MU * share) / (word_n[s][before[part]] + MU)
            out[s, lo:hi] = np.add.reduceat(-np.log(p), ends[lo:hi] - (sizes[lo:hi] + 1) - begin) / (sizes[lo:hi] + 1)
        lo = hi
    return out


def cross_entropy_difference(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "target", background_col: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, ce_target, ce_background (nats a token), ce_diff = ce_target - ce_background.

    Rows whose boolean target_col is true make the target model, those whose background_col is (all, where it is None) the
    background model; null is false. All rows are scored. Texts without words (null ones too) have n_tokens 0 and null
    scores. Ids pass through, nulls and repeats included, one row out per row in, each counting by itself. Empty tables
    give empty results; further columns are not read. A text longer than a chunk is a chunk of its own.
    """
    spark = df.sparkSession
    small_batches(spark)
    flag = lambda c: F.coalesce(F.col(f"`{c}`").cast("boolean"), F.lit(False))
    d = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), flag(target_col).alias("target"), (flag(background_col) if background_col else F.lit(True)).alias("background"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    some = max(1, -(-size // BLOCK_BYTES))
    fan = fan_of(some)
    blocks = max(MIN_BLOCKS, fan) if some <= fan else fan
    sums, (v, *n) = corpus_sums(chunks(d, lambda c: c.counts(blocks)), some, blocks, fan)
    both = chunks(d, Chunk.whole).unionByName(sums, allowMissingColumns=True)
    out = score_chunks(both.repartition("chunk").sortWithinPartitions("chunk", "block"), arrow_schema(d, ["doc_id"], []).field(0).type, d.schema["doc_id"].dataType.simpleString(), v, n)
    return out.withColumnRenamed("doc_id", id_col)


def score_chunks(rows: DataFrame, id_arrow: pa.DataType, id_type: str, v: int, n: list[int]) -> DataFrame:
    """The scores of the texts of each chunk, from its tokens (block -1) and the sums of its codes, in order of blocks."""
    schema = pa.schema([("doc_id", id_arrow), ("n_tokens", pa.int64()), ("ce_target", pa.float64()), ("ce_background", pa.float64()), ("ce_diff", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(raws: list[bytes | None]) -> list[np.ndarray]:
            each = [from_planes(r, "u8", "u8") for r in raws if r]
            return [np.concatenate([x[s] for x in each]) if each else np.zeros(0, dtype=np.uint64) for s in (0, 1)]

        def done(held: list[tuple]) -> pa.RecordBatch:
            _, block, words, pairs, ids, sizes = held[0]
            if block != -1:
                raise ValueError("a chunk's sums without its tokens: its input changed between two reads")
            code = np.cumsum(from_planes(words[:-8], "u8")[0], dtype=np.uint64)
            sizes = np.array(sizes, dtype=np.int64)
            some = sizes > 0
            ce = np.zeros((2, len(sizes)))
            if some.any():
                flat = from_planes(pairs, "u4")[0]
                ce[:, some] = losses(sizes[some], flat, code, int.from_bytes(words[-8:], "little"), joined([h[2] for h in held[1:]]), joined([h[3] for h in held[1:]]), v, n)
            cols = [pa.array(x, pa.float64(), mask=~some) for x in (ce[1], ce[0], ce[1] - ce[0])]
            return pa.RecordBatch.from_arrays([pa.array(ids, id_arrow), pa.array(sizes), *cols], schema=schema)

        for held in rows_by(batches, 1):
            yield done(held)

    return rows.mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, ce_target double, ce_background double, ce_diff double")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and target: true where a row of labels calls the document good and not toxic (a null toxic is not).
    Ids of labels may repeat; documents with null ids are no target. Texts are shuffled only if the ids are too many, and then
    written once: a shuffle brings rows of one id in any order, and scoring reads its texts twice."""
    good = pick(labels, {"doc_id": "doc_id", "quality": "quality", "toxic": "toxic"}).where("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    good = cut(good).withColumn("target", F.lit(True))
    d = pick(docs, {"doc_id": "doc_id", "text": "text"})
    if good.count() <= BROADCAST_IDS:
        return d.join(F.broadcast(good), "doc_id", "left").select("doc_id", "text", "target")
    named = d.where("doc_id is not null").join(good.hint("merge"), "doc_id", "left").select("doc_id", "text", "target")
    return cut(named.unionByName(d.where("doc_id is null").withColumn("target", F.lit(False))))  # null ids, all of one key, stay where they are


def score_against_labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return cross_entropy_difference(labelled(docs, labels))
