"""Token counts by the whole-token shortcut.

A fixed tokenizer with word ends splits a text into pre-tokens and merges each on its own, so a text's
count is the sum of its pre-tokens' counts. ``prove`` finds, once and offline, the vocabulary strings
that the tokenizer encodes alone as one token; pre-tokens among them count one without any merging.
All other pre-tokens are merged by the tokenizer itself, each once while it is remembered.

The shortcut splits texts by the tokenizer's published pattern, but only texts whose normal form is
plain: characters of ``PLAIN``, for which Python and the tokenizer agree on lower case, composition,
letters, digits and spaces. Any other text, or one that holds a special token's string, goes to the
tokenizer whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: the tokenizer's published pre-token pattern (its punctuation, letters, digits, and English endings)
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# ASCII without controls other than tab, line feed and carriage return; Latin letters that compose with nothing and lower to one letter
NOT_PLAIN = regex.compile("[^\t\n\r -~¡-įĲ-ňŊ-ž]")
WORD_END = "</w>"


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _byte_letters() -> dict[str, int]:
    """The inverse of the byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove(tokenizer) -> frozenset[str]:
    """Strings that are one pre-token and that the tokenizer encodes alone as one token.

    Candidates are the vocabulary entries that end a word; each is decoded and encoded to prove it.
    """
    letters = _byte_letters()
    found = []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        if entry.endswith(WORD_END):
            try:
                s = bytes(letters[c] for c in entry[: -len(WORD_END)]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if s and PRETOKEN.fullmatch(s) and PRETOKEN.findall(s) == [s]:
                found.append(s)
    encoded = tokenizer.encode_batch_fast(found, add_special_tokens=False)
    return frozenset(s for s, e in zip(found, encoded) if len(e.ids) == 1)


class Counter:
    """Counts tokens; keeps at most ``keep`` merged pre-tokens in mind."""

    def __init__(self, path: str, proved: frozenset[str] | None = None, keep: int = 500_000):
        self.tokenizer = load(path)
        self.proved = prove(self.tokenizer) if proved is None else proved
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.keep = keep
        self.known: dict[str, int] = dict.fromkeys(self.proved, 1)

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        split, odd = [], []
        for i, t in enumerate(texts):
            if NOT_PLAIN.search(t) or any(s in t for s in self.special):
                odd.append(i)
            else:
                split.append((i, PRETOKEN.findall(t.lower())))
        for i, n in zip(odd, self.whole([texts[i] for i in odd])):
            out[i] = n
        if len(self.known) > self.keep + len(self.proved):
            self.known = dict.fromkeys(self.proved, 1)
        new = list({w for _, words in split for w in words if w not in self.known})
        self.known.update(zip(new, self.whole(new)))
        get = self.known.__getitem__
        for i, words in split:
            out[i] = sum(map(get, words))
        return out


def count_column(text: Column, path: str) -> Column:
    proved = prove(load(path))  # once, on the driver; no larger than the vocabulary

    @F.pandas_udf("long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(path, proved)
        for texts in parts:
            texts = [t or "" for t in texts]
            yield pd.Series([n for i in range(0, len(texts), 256) for n in counter.count(texts[i : i + 256])], dtype="int64")

    return counted(text)


def token_counts(docs: DataFrame, path: str, *, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of ``docs``.

    path: the tokenizer's file, at the same place on every machine. Null text counts as empty, which has
    no byte and no token. Ids may be null or repeated; extra columns are ignored.
    """
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = t.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), count_column(F.col("text"), path).alias("n_tokens"))
    return n.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
