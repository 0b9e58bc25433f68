"""Packing holds the ids the tokenizer's file gives, special strings in a text included."""
import os
import random
import sys
import zlib

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from tablelens.llm import packing  # noqa: E402
from tablelens.llm.queries import tokenizer_path  # noqa: E402

TEXTS = ["end of page <|endoftext|> next page", "<|startoftext|>a page<|endoftext|>", "<|endoftext|><|endoftext|>\n<|startoftext|>",
         "a<|ENDOFTEXT|> <|end oftext|> <|endoftext|", "x\t<|endoftext|>\r\ńy it's<|startoftext|>'s", "<|endoftext|>" * 40 + "z" * 70]


def test_special_strings_give_their_ids(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rnd = random.Random(2)
    parts = ["<|endoftext|>", "<|startoftext|>", " ", "\n", "\t", "a", "river", "Über", "é", "'s", "<|", "|>", "12"]
    texts = TEXTS + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 60))) for _ in range(300)]
    want = []
    for i, t in enumerate(texts):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 16)):
            part = ids[at:at + 16]
            want.append((i, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack(df, path, packing.Capacity(tokens=16), with_ids=True).collect()
    assert sorted(want) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    first = next(np.frombuffer(r["ids"], "<u4").tolist() for r in got if r["doc_id"] == 0)
    assert 49407 in first and len(first) == 7     # six tokens and the end
