"""Token counts: most pre-tokens are whole vocabulary entries and are counted without merging.

``prove`` finds, once and before any text is read, which vocabulary strings the tokenizer encodes alone as one
token; it also proves, code point by code point, where the splitting pattern used here cuts as the tokenizer
does. ``count_tokens`` then splits texts into pre-tokens, counts the proven ones as one each and lets the
tokenizer merge only the rest. Texts with a special string, or with a code point outside the proven ones, go
to the tokenizer whole. The proof is broadcast: its size is that of the vocabulary, not of the data.

Work runs in Arrow batches without any shuffle. Each worker remembers the counts of rest pre-tokens up to
``MEMORY`` entries; that changes speed only.

Defined results: a null or empty text has 0 tokens; repeated rows are counted each; an empty table gives an
empty result; other columns stay as they are, and the count's name is a parameter. Very long texts are counted
whole; memory grows with the longest text of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from .text import column, whole

#: Remembered rest pre-tokens per worker.
MEMORY = 200_000

#: Code points that are compared with the tokenizer one by one; others are left to the tokenizer.
PROVEN = (0x0000, 0x2100)


def pattern() -> str:
    """How the byte-level tokenizer cuts a text, as its vocabulary files describe it."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def prove(path: str) -> tuple[frozenset[str], str, tuple[str, ...]]:
    """Strings that are one token alone, a class of the code points not proven, and the special strings."""
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    cut = regex.compile(pattern())
    special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    strings = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
    strings = [s for s in set(strings) if s and "�" not in s and s not in special and cut.findall(s) == [s]]
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    alone = frozenset(s for s, e in zip(strings, encoded) if len(e.ids) == 1)

    doubtful = [(PROVEN[1], 0xD7FF), (0xE000, 0x10FFFF)]
    for point in range(*PROVEN):
        probe = f"a{chr(point)} {chr(point)}1{chr(point)}{chr(point)}- {chr(point)} "
        pieces = [probe[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
        if pieces != cut.findall(probe):
            doubtful.append((point, point))
    ranges = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in doubtful)
    return alone, f"[{ranges}]", special


def count_tokens(docs: DataFrame, path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of every whole text in the column ``into``."""
    proof = docs.sparkSession.sparkContext.broadcast(prove(path))
    cut_by = pattern()

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        alone, doubtful, special = proof.value
        tokenizer, cut, doubt = Tokenizer.from_file(path), regex.compile(cut_by), re.compile(doubtful)
        known = dict.fromkeys(alone, 1)

        def whole_text(value: str) -> int:
            return len(tokenizer.encode(value, add_special_tokens=False).ids)

        def one(value: str) -> int:
            if doubt.search(value) or any(s in value for s in special):
                return whole_text(value)
            pieces = cut.findall(value)
            counts = list(map(known.get, pieces))
            if None not in counts:
                return sum(counts)
            rest = list({p for p, n in zip(pieces, counts) if n is None})
            own = {p: len(e.ids) for p, e in zip(rest, tokenizer.encode_batch(rest, add_special_tokens=False))}
            if len(known) > len(alone) + MEMORY:
                known.clear()
                known.update(dict.fromkeys(alone, 1))
            known.update(own)
            return sum(own[p] if n is None else n for p, n in zip(pieces, counts))

        for batch in batches:
            yield pd.Series([one(v) for v in batch], dtype="int64")

    return docs.withColumn(into, count(whole(column(text))))
