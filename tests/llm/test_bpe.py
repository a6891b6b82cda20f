import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

from ledgerline.llm import bpe
from ledgerline.llm.queries import QUERIES

VOCABULARY = bpe.Vocabulary.read(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
WHOLE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
ODD = [
    None, "", " ", "   ", "a", " a", "a  b", "a \n b", "\n\n  x", "it's we'll 'll l", "x y  z", "\x1c\x1d a\x1f b",
    "é ß 日本語 😀 x²⅓", "<|endoftext|> a", "a" * 3000, " " * 3000 + "b", "a" + " \n" * 1500 + "b", "12345 6.7,8", "\t \t a",
]


def ids(text):
    return WHOLE.encode_ordinary(text or "")


def test_pieces_encode_like_the_library():
    encoder = bpe.PieceEncoder(VOCABULARY)
    for text in ODD:
        assert encoder.text(text or "") == struct.pack(f"<{len(ids(text))}I", *ids(text)), text


def test_very_long_runs_end():
    encoder = bpe.PieceEncoder(VOCABULARY)
    for text in (" " * 300_000 + "x", "ab" * 150_000, "\n" * 200_000):
        got = encoder.text(text)
        tokens = {i: b for b, i in VOCABULARY.ranks.items()}
        assert b"".join(tokens[i] for i in struct.unpack(f"<{len(got) // 4}I", got)) == text.encode()


@pytest.mark.parametrize("chunk,overlap", [(7, 3), (16, 8), (40, 5), (50, 0)])
def test_chunks_stitch_to_the_whole(spark, chunk, overlap):
    rng = random.Random(chunk)
    texts = ODD[:-6] + ["".join(rng.choices(" ab'\n\té1.l s", k=300)) for _ in range(25)] + ["a" * 100 + " " * 100 + "b c"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, _row string")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, VOCABULARY, chunk=chunk, overlap=overlap), VOCABULARY).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert list(struct.unpack(f"<{got[i].n_tokens}I", got[i].ids)) == ids(t), (t, chunk)
        assert bytes(got[i].decoded) == (t or "").encode() and got[i]["_row"] == "z"


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, VOCABULARY), VOCABULARY).count() == 0


def test_query_matches_the_library(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op3_byte_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = ids(docs[r.doc_id])
        assert r.n_tokens == len(own)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(own)}I", *own)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_ranks_file_is_read():
    line = next(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))
    assert VOCABULARY.ranks[base64.b64decode(line.split()[0])] == int(line.split()[1])
