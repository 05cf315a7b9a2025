import hashlib
import random
from bisect import bisect_left
from collections import Counter

import public_tokenizers
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sparkprep.llm import token_alignment as ta

from .helpers import prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pairs string, row int, `a.b` string"
TEXTS = [
    "", " ", "a", "it's  we'll\n\n\t x", prose(1, 500), "<|endoftext|> and <s> </s> <0x41>", "été ñandú Straße ü", "日本語のテキスト",
    "𝒳 emoji 😀😀 ‍", "x" * 5000, "1234567 ٣٤٥ ²³", "\x00\x01\x1c\x85\xa0   ", "naïvé å", "don't DON'T ’s",
    "\r\n\r\n  \r\n", "a ▁ b", " leading", "trailing ", "ﬁne ｆｕｌｌ",
]


def plain(texts):
    """n_a, n_b, n_groups, groups text and linked pairs of each text by sets of ends and all pairs of tokens."""
    tokenizer, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    of = ta.byte_of()
    out = []
    for text in texts:
        want = (" " + (text or "")).encode()
        ids = [tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids, model.encode(text or "")]
        a = [bytes(of[c] for c in tokenizer.id_to_token(x)) for x in ids[0]]
        b = [
            bytes([int(model.id_to_piece(x)[3:5], 16)]) if model.is_byte(x) else model.id_to_piece(x).replace("▁", " ").encode()
            for x in ids[1]
        ]
        if not text or b"".join(a) != want or b"".join(b) != want:
            out.append((0, 0, 0, "", []))
            continue
        spans = []
        for tokens in (a, b):
            at, own = 0, []
            for t in tokens:
                own.append((at, at + len(t)))
                at += len(t)
            spans.append(own)
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        told = []
        for x, sp in zip(ids, spans):
            told.append({})
            for i, (_, e) in zip(x, sp):
                told[-1].setdefault(common[bisect_left(common, e)], []).append(str(i))
        groups = [",".join(told[0][c]) + "|" + ",".join(told[1][c]) for c in common]
        links, first = [], 0
        for x, (s, e) in zip(ids[0], spans[0]):
            while spans[1][first][1] <= s:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((x, ids[1][k]))
                k += 1
        out.append((len(a), len(b), len(groups), ";".join(groups), links))
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = ta.aligned(docs, A, B)
    assert found.columns == ["doc_id", "text", "pairs", "row", "a.b", "_alignment"]
    out = ta.scored(found)
    assert out.columns == ["doc_id", "text", "pairs", "row", "a.b", "_alignment", "_links"]
    want = plain([r[1] for r in rows])
    count = Counter(p for *_, links in want for p in set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    expected = [
        (r[0], n_a, n_b, n, len(links), groups, sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links))
        for r, (n_a, n_b, n, groups, links) in zip(rows, want)
    ]
    got = [
        (r["doc_id"], x["n_a"], x["n_b"], x["n_groups"], x["n_links"], x["groups"], r["_links"]["n_best"], r["_links"]["count_sum"])
        for r in out.collect() for x in [r["_alignment"]]
    ]
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(got, key=order) == sorted(expected, key=order)
    return got


def test_against_sets_of_ends(spark):
    rows = [(i, t, "p", 1, "k") for i, t in enumerate(TEXTS)] + [(None, None, None, None, None), (4, TEXTS[4], "p", 1, "k")]
    rows += [(100 + i, prose(i, 30, vocabulary=3000), "", 0, "") for i in range(60)]
    got = check(spark, rows)
    assert sum(g[4] == 0 for g in got) >= 3  # without tokens: null, empty, a piece mark


def test_rare_pairs_are_joined(spark, monkeypatch):
    monkeypatch.setattr(ta, "HOT", 20)
    check(spark, [(i, prose(i, 40), "", 0, "") for i in range(40)])
    monkeypatch.setattr(ta, "HOT", 1)  # no pair has all links
    check(spark, [(i, prose(i, 40), "", 0, "") for i in range(10)])


def test_very_long_text_and_empty_table(spark):
    rows = [(1, prose(9, 60_000), "", 0, "")]
    check(spark, rows)
    empty = spark.createDataFrame(rows, SCHEMA).where("false")
    assert ta.scored(ta.aligned(empty, A, B)).count() == 0
    check(spark, [(1, None, "", 0, ""), (2, "", "", 0, "")])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), max_size=60), st.lists(st.booleans(), max_size=60))
def test_align_any_ends(x, y):
    n = max(len(x), len(y)) + 1
    a, b = ([k for k, cut in enumerate(z, 1) if cut] + [n] for z in (x, y))
    stretches, at_a, at_b = ta.align(a, b)
    ends = [a[i] for s, to, _, _, alike in stretches for i in (range(s, to) if alike else [to - 1])]
    assert ends == sorted(set(a) & set(b))
    overlaps = [(i, j) for i in range(len(a)) for j in range(len(b)) if max([0, *a][i], [0, *b][j]) < min(a[i], b[j])]
    alike = [(i + k, j + k) for i, to, j, _, alike in stretches if alike for k in range(to - i)]
    assert sorted([*zip(at_a, at_b), *alike]) == overlaps


def test_encoder_equals_the_library():
    fast, by_id = ta.ranked_merges(A)
    slow = ta.library(A)
    rng = random.Random(3)
    letters = [chr(p) for p in range(0x2100) if not 0xD800 <= p < 0xE000]
    import re

    doubt = re.compile(ta.doubtful(A))
    for k in range(3000):
        text = "".join(rng.choice(letters[:128] if k % 2 else letters) for _ in range(rng.randrange(40)))
        if not doubt.search(text):
            assert fast.encode_ordinary(text) == slow.encode(text, add_special_tokens=False).ids
    assert hashlib.sha256(b"".join(by_id[x] for x in fast.encode_ordinary(" été"))).digest() == hashlib.sha256(" été".encode()).digest()
