"""Of the texts that are encoded at a time each distinct piece is looked up once, and the ids are the library's."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from parchment.llm.rans import Table, decode, encode, normalized
from parchment.llm.tokens import FEW, Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a", " b", "a b", "the cat's  mat", "x\ny z", "déjà vu 中文 字", "don't 12,5 <|endoftext|> end", "tail ", "  q", "a\tb c", "word word. word,\nword 7%"]


class Counted(Encoder):
    asked = 0

    def __getitem__(self, piece):
        Counted.asked += 1
        return super().__getitem__(piece)


def test_pieces_are_asked_for_once():
    code = Counted(PATH, True)
    code.encode([b"one two three one two three"] * FEW * 10)
    assert Counted.asked < 10


def test_ids_are_the_librarys():
    told, code = Tokenizer.from_file(PATH), Encoder(PATH, True)
    texts = TEXTS * FEW
    want = [told.encode(t, add_special_tokens=False).ids for t in TEXTS] * FEW
    assert [np.frombuffer(x, code.kind).tolist() for x in code.encode([t.encode() for t in texts])] == want


def test_a_symbol_that_is_alone_and_rare_ones_are_decoded():
    for symbols in (np.full(5000, 3, np.uint16), np.arange(5000, dtype=np.uint16) % 4096):
        table = Table(normalized(np.bincount(symbols)))
        assert (decode(encode(symbols, table), table) == symbols).all()
