import public_tokenizers
from tokenizers import Tokenizer

from sparkprep.llm import token_counts

from .helpers import prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "a", "it's  we'll\n\n\t x", prose(1, 500), "<|endoftext|> and <|endoftext|>", "été ñandú Straße ü", "日本語のテキスト", "𝒳 emoji 😀😀 \u200d",
    "x" * 5000, "1234567 ٣٤٥ ²³", "\x00\x01\x1c\x1d\x85\xa0 \u2028 ", "naïve\u0301 a\u030a", prose(2, 20_000), "don't DON'T ’s", "\r\n\r\n  \r\n",
]


def test_counts_equal_the_library(spark, monkeypatch):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, None, 0), (4, TEXTS[4], 1)]
    out = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n int"), PATH)
    assert out.columns == ["doc_id", "text", "n", "n_tokens"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_tokens"] == len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids), r["text"]
    assert out.where("false").count() == 0


def test_proof():
    alone, doubtful, special = token_counts.prove(PATH)
    tokenizer = Tokenizer.from_file(PATH)
    assert len(alone) > 45_000 and special == ("<|endoftext|>",)
    assert all(len(tokenizer.encode(s, add_special_tokens=False).ids) == 1 for s in list(alone)[:2000])
