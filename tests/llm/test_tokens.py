"""Words with marks behind them and after line ends take few bytes through the tokenizers library."""

import random

import pyarrow as pa
from skyframe.llm.queries import byte_bpe
from skyframe.llm.tokens import Encoder


class Counted:
    def __init__(self, tok):
        self.tok, self.given = tok, 0

    def encode_batch_fast(self, texts, **how):
        self.given += sum(map(len, texts))
        return self.tok.encode_batch_fast(texts, **how)


def test_words_with_marks_and_line_ends():
    enc = Encoder(byte_bpe())
    raw, enc.tok = enc.tok, Counted(enc.tok)
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghé", k=9)) for _ in range(500)]
    texts = [" ".join(w + end for w, end in zip(draw.sample(words, 500), draw.choices(["", ",", ".", "###", "'", "$$$", "\nx"], k=500))) for _ in range(20)]
    ids, ends = enc.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [e.ids for e in raw.encode_batch(texts, add_special_tokens=False)]
    assert enc.tok.given < 10_000  # 500 words of 10 characters and beginnings; 30,000 if every word with its marks is learnt


def test_odd_ends():
    enc = Encoder(byte_bpe(), keep=300)
    draw = random.Random(4)
    signs = [*"ab,.'#é×Ǆɐ0 \n\n\t\x1c\x85\xa0 ", "'s", "  ", "\r\n", "<|endoftext|>"]
    for _ in range(20):
        texts = ["".join(draw.choices(signs, k=draw.randint(0, 20))) for _ in range(300)]
        ids, ends = enc.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
