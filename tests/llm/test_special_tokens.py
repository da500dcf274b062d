import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from parchment.llm import queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x <|endoftext|>\n<|endoftext", "é<|endoftext|>é  <|endoftext|>  \n c", "plain text", "", None]


def test_query_encodes_as_the_unmodified_library(spark, tmp_path):
    spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in queries.op4_tokens(spark, str(tmp_path)).collect()}
    tokenizer, start = Tokenizer.from_file(PATH), 0
    for i, t in enumerate(TEXTS):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (out[i]["start"], out[i]["n_tokens"], out[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes())), t
        start += len(ids)
    assert len(out) == len(TEXTS) and tokenizer.encode(TEXTS[0], add_special_tokens=False).ids[2] == 50256
