"""Exact byte-pair token counts of every prefix of a text.

Within a pre-token, the last token of the encoding of each prefix follows from
shorter prefixes: token t ends prefix i if t is a vocabulary entry that fits
there and the last token of the prefix before it may stand beside t, that is,
no merge would have joined parts of both across their border. One such token
exists, so ``count[i] = count[i - len(t)] + 1`` is a dynamic program over
prefixes. A text's counts chain those of its pre-tokens and are corrected where
a shorter text would be cut into other pre-tokens (runs of white space, half a
contraction, half a special token). With the counts stored, "how many tokens up
to here" and "how much fits a budget" need no further encoding.

Edge cases: null and empty texts have no tokens; special strings count as the
one token the library makes of them; repeated rows are counted each.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from math import inf

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.llm.columns import whole_text


HEAD = 8
#: Bytes of the longest pre-token whose counts are remembered.
LONGEST_KNOWN = 100
#: Where Python's classes agree with the vocabulary's pattern, its own engine is faster. They
#: differ for numbers that are no digits and for the four separators that count as space.
LIKE_PATTERN = re.compile(public_tokenizers.PATTERN.replace(r"\p{L}", r"[^\W\d_]")
                          .replace(r"\p{N}", r"\d").replace(r"[^\s[^\W\d_]\d]", r"(?:[^\s\w]|_)"))
DIFFERENT = frozenset(
    c for c in map(chr, range(0x110000)) if "\x1c" <= c <= "\x1f" or c.isalnum()
    and not c.isalpha() and not c.isdecimal() or c.isalpha() and unicodedata.category(c)[0] != "L")


@dataclass(frozen=True)
class Counting:
    """``budget``: tokens a document may have; ``remembered``: pre-tokens kept per worker."""

    tokenizer: str = "byte_bpe_50k.json"
    budget: int = 1024
    remembered: int = 800_000


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for
    themselves, the others are numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts of all prefixes of texts under one byte-level BPE file."""

    def __init__(self, path: str, remembered: int = 800_000) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        #: Tokens are numbered: bytes first, then merges in the order of their ranks.
        self.number = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.rank: dict[int, int] = {}
        for left, right in spec["model"]["merges"]:
            a, b = (bytes(letters[c] for c in x) for x in (left, right))
            pair = (self.number[a], self.number[b])
            self.rank[pair[0] << 20 | pair[1]] = len(self.parts)
            self.number[a + b] = len(self.parts)
            self.parts.append(pair)
        self.longest = max(map(len, self.number))
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"])
                                  or r"(?!)")
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.runs = regex.compile(r"\s{2,}")
        self.limit = remembered
        self.known: dict[str, bytes] = {}
        self.beside: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        #: The program's state after the first bytes, which many words share.
        self.heads: dict[bytes, tuple[list[int], list[int]]] = {}
        self.nothing: tuple[list[int], list[int]] = ([0], [0])
        self.edges: dict[tuple[int, bool], list[tuple[int, float]]] = {}

    def edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """Pieces that stand at an end of the token while it is built, each with the rank
        of the merge that absorbs it."""
        found = self.edges.get((token, right))
        if found is None:
            found, absorbed, piece = [], inf, token
            while True:
                found.append((piece, absorbed))
                if self.parts[piece] is None:
                    break
                absorbed, piece = piece, self.parts[piece][right]
            self.edges[token, right] = found
        return found

    def crossing(self, left: int, right: int, below: float = inf) -> bool:
        """Whether a merge of rank under ``below`` joins parts of both; of equal ranks the
        leftmost place is merged first."""
        rank = self.rank.get
        ends = self.edge(right, False)
        for a, up_a in self.edge(left, True):
            for b, up_b in ends:
                merged = rank(a << 20 | b)
                if merged is not None and merged < below and merged < up_a and merged <= up_b:
                    return True
        return False

    def stands_alone(self, token: int) -> bool:
        """Whether the token's bytes are encoded as this one token."""
        found = self.alone.get(token)
        if found is None:
            pair = self.parts[token]
            found = pair is None or (all(map(self.stands_alone, pair))
                                     and not self.crossing(*pair, token))
            self.alone[token] = found
        return found

    def may_follow(self, left: int, right: int) -> bool:
        found = self.stands_alone(right) and not self.crossing(left, right)
        if len(self.beside) > 4 * self.limit:
            self.beside.clear()
        self.beside[left << 20 | right] = found
        return found

    def counts(self, data: bytes) -> list[int]:
        """Tokens of every prefix of one pre-token, by bytes; entry 0 is the empty prefix."""
        number, longest, beside, may_follow = self.number.get, self.longest, self.beside, self.may_follow
        head = data[:HEAD]
        count, last = self.heads.get(head, self.nothing)
        count, last = count.copy(), last.copy()
        for end in range(len(count), len(data) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = number(data[start:end])
                if token is None:
                    continue
                if start:
                    fits = beside.get(last[start] << 20 | token)
                    if fits is None:
                        fits = may_follow(last[start], token)
                else:
                    fits = self.stands_alone(token)
                if fits:
                    count.append(count[start] + 1)
                    last.append(token)
                    break
            if end == HEAD:
                if len(self.heads) >= self.limit:
                    self.heads.clear()
                self.heads[head] = (count.copy(), last.copy())
        return count

    def steps(self, word: str) -> bytes:
        """Change of the count at every character of a pre-token, one signed byte each."""
        found = self.known.get(word)
        if found is None:
            count = self.counts(data := word.encode("utf-8", "surrogatepass"))
            if len(data) != len(word):
                count = [c for i, c in enumerate(count) if i == len(data) or data[i] & 0xC0 != 0x80]
            if word in ("'re", "'ve", "'ll"):  # half of it is a quote and a letter
                count[2] = 2
            found = bytes([b - a & 255 for a, b in zip(count, count[1:])])
            if len(data) > LONGEST_KNOWN:  # rarely met again, and memory is bounded by bytes
                return found
            if len(self.known) >= self.limit:
                self.known.clear()
            self.known[word] = found
        return found

    @staticmethod
    def alike(text: str) -> bool:
        if text.isascii():
            return not any(c in text for c in "\x1c\x1d\x1e\x1f")
        return DIFFERENT.isdisjoint(text)

    def total(self, text: str) -> int:
        return int(self.prefixes(text)[-1])

    def ordinary(self, text: str) -> np.ndarray:
        """Counts of all prefixes of a text without special strings."""
        words = (LIKE_PATTERN if self.alike(text) else self.words).findall(text)
        steps, known = self.steps, self.known
        parts = [known.get(w) or steps(w) for w in words]
        out = np.zeros(len(text) + 1, dtype=np.int64)
        np.cumsum(np.frombuffer(b"".join(parts), dtype=np.int8), out=out[1:])
        # A prefix that ends with white space has all of that run in one pre-token.
        for run in self.runs.finditer(text) if re.search(r"\s\s", text) else ():
            start, end = run.span()
            if end == len(text):  # it ends the text, so it is one pre-token there, too
                break
            whole = np.frombuffer(steps(run[0]), dtype=np.int8)
            out[start + 1:end + 1] = out[start] + np.cumsum(whole)
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """Entry k: tokens of the first k characters, as the library counts them."""
        out, before, at = [np.zeros(1, dtype=np.int64)], 0, 0
        for special in self.special.finditer(text):
            segment = text[at:special.start()]
            counts = self.ordinary(segment)
            out.append(counts[1:] + before)
            mark = special[0]
            partial = [self.ordinary(segment + mark[:k])[-1] + before for k in range(1, len(mark))]
            before += int(counts[-1]) + 1
            out.append(np.array([*partial, before]))
            at = special.end()
        out.append(self.ordinary(text[at:])[1:] + before)
        return np.concatenate(out)


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def token_counts(docs: DataFrame, config: Counting = Counting(), text: str = "text",
                 into: str = "tokens", with_prefixes: bool = False) -> DataFrame:
    """``docs`` with the struct ``into``: n_bytes, n_tokens, over_limit and fit_chars (the
    longest prefix within the budget); with ``with_prefixes`` also the count of every prefix."""
    stored = ", prefixes: array<int>" if with_prefixes else ""

    @F.pandas_udf(f"n_bytes long, n_tokens long, over_limit boolean, fit_chars long{stored}")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = PrefixCounter(public_tokenizers.path(config.tokenizer), config.remembered)
        for batch in batches:
            rows = []
            for whole in batch:
                counts = counter.prefixes(whole)
                n = int(counts[-1])
                over = n > config.budget
                rows.append((len(whole.encode("utf-8", "surrogatepass")), n, over,
                             longest_prefix(counts, config.budget) if over else len(whole),
                             *([counts.astype(np.int32)] if with_prefixes else [])))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_tokens", "over_limit", "fit_chars",
                                              *(["prefixes"] if with_prefixes else [])])

    return docs.withColumn(into, counted(whole_text(text)))


def tokens_until(into: str, chars: int) -> Column:
    """Tokens of the first ``chars`` characters, from the stored counts."""
    return F.get(F.col(into)["prefixes"], F.least(F.lit(chars), F.size(F.col(into)["prefixes"]) - 1))
