"""Token counts and ids with public tokenizers, whole texts, one pass over Arrow batches.

Counting takes a whole-token shortcut: offline, every vocabulary string that ends a word is encoded alone, and those
that give exactly one token form a proven set. A text's pre-tokens found in that set count 1 without any merging;
only the rest are merged by the library, once per distinct pre-token and bounded memo. Characters outside a range where
our pre-tokenizer is proven equal to the library's send only the piece around them, up to the next white space, to the
library; texts with special strings go there whole.

Defined results: a null text counts as empty (0 tokens, 0 bytes); repeated rows are counted alike; an empty table
gives an empty table; columns of the input that carry an output column's name are replaced.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from surety.llm.common import map_batches

#: Below this code point, without combining marks, NFC changes nothing and lower-casing is one character to one.
LATIN = 0x250
#: White space inside the fast path; other controls and spaces go to the library.
SPACES = " \t\n\r"
#: Distinct pre-tokens remembered by a worker before it starts anew.
MEMO = 400_000
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _class(kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LATIN) if unicodedata.category(chr(c))[0] in kinds)


def _plain() -> str:
    """Characters of the fast path as the inside of a character class."""
    ok = [chr(c) for c in range(LATIN) if (chr(c) in SPACES or unicodedata.category(chr(c))[0] not in "CZ") and chr(c) != "İ"]
    return "".join(re.escape(c) for c in ok)


ODD = re.compile(f"[^{_plain()}]")
#: The piece around an odd character: no token reaches across white space, which no mark composes with.
PIECE = re.compile(f"[^{SPACES}]*[^{_plain()}][^{SPACES}]*")
#: Fixed pattern of the word tokenizer, spelt out for the fast path's characters.
WORDS = re.compile(f"{CONTRACTIONS}|[{_class('L')}]+|[{_class('N')}]|[^{SPACES}{_class('LN')}]+")


@lru_cache(maxsize=4)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in library(path).get_added_tokens_decoder().values())


def _bytes_of() -> dict[str, int]:
    """The byte that each printable stand-in of byte-level vocabularies means."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def whole_tokens(path: str, end="</w>") -> frozenset[str]:
    """The pre-tokens proven, by encoding each alone, to be one token: at most as many as the vocabulary has."""
    tok, back = library(path), _bytes_of()
    found = {}
    for piece, number in tok.get_vocab(with_added_tokens=False).items():
        if piece.endswith(end) and all(c in back for c in piece[: -len(end)]):
            try:
                word = bytes(back[c] for c in piece[: -len(end)]).decode()
            except UnicodeDecodeError:
                continue
            if word and WORDS.fullmatch(word) and not ODD.search(word) and word == word.lower():
                found[word] = number
    words = sorted(found)
    return frozenset(w for w, e in zip(words, tok.encode_batch(words, add_special_tokens=False), strict=True) if e.ids == [found[w]])


class WordCounter:
    def __init__(self, path: str, proven: frozenset[str]):
        self.tok, self.special, self.proven = library(path), specials(path), proven
        self.memo = dict.fromkeys(proven, 1)

    def _merge(self, words: list[str]) -> None:
        for word, e in zip(words, self.tok.encode_batch(words, add_special_tokens=False), strict=True):
            self.memo[word] = len(e.ids)

    def counts(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            if any(x in text for x in self.special):
                out.append(len(self.tok.encode(text, add_special_tokens=False).ids))
                continue
            words = []
            if ODD.search(text):
                words, text = PIECE.findall(text), PIECE.sub(" ", text)
            words += WORDS.findall(text.lower())
            if len(self.memo) > MEMO + len(self.proven):
                self.memo = dict.fromkeys(self.proven, 1)
            new = set(words).difference(self.memo)
            if new:
                self._merge(list(new))
            out.append(sum(map(self.memo.__getitem__, words)))
        return out


def count_tokens(df: DataFrame, tokenizer: str, text="text", keep=None, limit=2048) -> DataFrame:
    """The kept columns (all by default) with n_bytes, n_tokens and over_limit."""
    added = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in (df.columns if keep is None else keep) if c not in added]
    proven = df.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer))  # bounded by the vocabulary
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        counter = None
        for batch in batches:
            counter = counter or WordCounter(tokenizer, proven.value)
            texts = [t or "" for t in batch.column(text).to_pylist()]
            n = counter.counts(texts)
            columns = [batch.column(c) for c in keep]
            columns += [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *added])

    return map_batches(df.select(*dict.fromkeys([*keep, text])), run, schema)


class ByteEncoder:
    """Ids of a byte-level vocabulary; the rank file's encoder, which is faster, where both are known to agree."""

    #: Texts beyond these go to the library, whose splitting doesn't backtrack.
    LONGEST = 2_000_000
    BLANKS = re.compile(f"[{SPACES}]{{2000}}")

    def __init__(self, path: str, ranks: str | None):
        self.tok, self.special, self.fast = library(path), specials(path), None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or ODD.search(text) or len(text) > self.LONGEST or any(s in text for s in self.special) or self.BLANKS.search(text):
            return self.tok.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)
