"""Token ids of the packing operator against the library with its default settings."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gradelake.llm.packing import encoder, pack, public_vocabulary


def test_added_tokens_as_in_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    mine = encoder(open(path, "rb").read(), added=True)
    rng = random.Random(5)
    parts = ["a", " the", "<|endoftext|>", "<|endoftext", "|>", "\n\n", "é", "漢字", "123", "'ll", "  "]
    for _ in range(2000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert mine(x) == tok.encode(x, add_special_tokens=False).ids
    text = "x <|endoftext|> y"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
    (row,) = pack(df, public_vocabulary(), with_ids=False).collect()
    assert len(ids) == 5 and (row.length, row.ids_crc32) == (5, zlib.crc32(ids.tobytes()))
