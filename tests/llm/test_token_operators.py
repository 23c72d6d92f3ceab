"""Token counts and piece encoding against the sentencepiece library."""

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from lodestar.llm import pieces, queries, token_counts

ALPHABET = [" ", "  ", "▁", "\n", "a", "e", "t", "th", "ing", "&", "#", "##", "1", "23", "é", "ß", "日", "本", "😀", "ﬁ", "<s>", "</s>", "<0x41>", "\0", "\t", "A", "aa", "aaa"]


@pytest.fixture(scope="module")
def model():
    with open(queries.piece_model(), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def texts(n, most, seed, alphabet=ALPHABET):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_prefix_table_is_the_library(model, library):
    c = pieces.PrefixTableCodec(model)
    for t in texts(3000, 50, 1):
        ids = library.encode(t, add_eos=True)
        assert c.encode(t) == ids and c.decode(ids) == library.decode(ids), t


@pytest.mark.parametrize("chunk,overlap", [(24, 4), (8, 1), (64, 16)])
def test_chunks_are_spliced_exactly(model, library, chunk, overlap):
    e = token_counts.ChunkedEncoder(model, chunk, overlap)
    for t in texts(400, 200, 2) + texts(200, 200, 3, ["a", "aa", "ab", " "]):
        assert e.encode(t) == library.encode(t), t
    assert e.widened


def test_very_long_text(model, library):
    t = "word and more words, " * 20_000 + "a" * 40_000
    assert token_counts.ChunkedEncoder(model).encode(t) == library.encode(t)


EDGE = [(1, "one two"), (1, "one two"), (None, "x"), (2, None), (3, ""), (4, "z" * 30_000)]


def test_edge_rows(spark, library):
    d = spark.createDataFrame(EDGE, "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash")).withColumn("ids", F.lit(1))
    got = token_counts.count_tokens(d, queries.piece_model(), limit=100).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 100) for i, t in EDGE]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    got = pieces.digests(pieces.encode_decode(d, queries.piece_model())).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = [library.encode(t or "", add_eos=True) for _, t in EDGE]
    want = [(i, len(x), sha(" ".join(map(str, x))), sha(library.decode(x))) for (i, _), x in zip(EDGE, ids, strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.count_tokens(d.limit(0), queries.piece_model()).count() == 0 and pieces.encode_decode(d.limit(0), queries.piece_model()).count() == 0


def test_queries_on_documents(spark, sf, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op10_token_counts(spark, sf).collect():
        assert r["n_tokens"] == len(library.encode(docs[r["doc_id"]]))
    for r in queries.op6_piece_codec(spark, sf).collect():
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, library.encode(docs[r["doc_id"]], add_eos=True))).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
