"""Token ids against a tokenizer of their own, as the library reads it from the file."""

import zlib

import numpy as np
import pytest

from rowlens.llm import packing, token_files, tokens
from rowlens.session import scratch_path

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

TEXTS = [
    "end of one <|endoftext|> start of next", "plain words\nin two lines", "<|endoftext|>", "glued<|endoftext|>on",
    "<|endoftext|><|endoftext|>", "almost <|endoftext| >", "two  blanks <|endoftext|>\n", "after all of them",
]


@pytest.fixture(scope="module")
def expected():
    plain = Tokenizer.from_file(tokens.vocabulary_path())
    return [plain.encode(text, add_special_tokens=False).ids for text in TEXTS]


def test_added_tokens_keep_their_id(expected):
    assert 50256 in expected[0] and len(expected[0]) == 8
    found = tokens.Encoder().encode(TEXTS)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == expected


def test_added_tokens_in_files_and_pieces(spark, expected):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ids = [[*own, tokens.END_ID] for own in expected]
    crc = [zlib.crc32(np.array(own, "<u4").tobytes()) for own in ids]
    path = token_files.write_token_files(docs, scratch_path(spark, "tokens"), files=2)
    found = token_files.read_checksums(spark, path).orderBy("doc_id").collect()
    starts = np.cumsum([0, *map(len, ids)]).tolist()
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in found] == list(zip(starts, map(len, ids), crc))
    pieces = packing.pack_documents(docs).orderBy("doc_id").collect()
    assert [(r.length, r.ids_crc32) for r in pieces] == list(zip(map(len, ids), crc))
