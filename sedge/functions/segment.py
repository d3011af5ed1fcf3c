"""Dictionary segmentation of scripts without spaces: the cheapest path through a word lattice."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sedge.functions.tokens import PROTECTED
from sedge.workspace import small_batches

#: Words of a dictionary; it is broadcast, so there is a bound, and a larger one is refused.
MOST_WORDS = 2_000_000
#: Costs are whole millionths, so that equal paths are equal.
SCALE = 1_000_000


class Lattice:
    """A trie of words with costs: the negative logarithm of each word's share of all occurrences.

    A character that no word begins with, or that no path of words leads over, stands alone at the cost of one occurrence.
    """

    def __init__(self, words: Sequence[tuple[str, int]]):
        self.total = sum(n for _, n in words)
        self.alone = self._cost(1)
        self.root: dict = {}
        for word, n in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = self._cost(n)

    def _cost(self, n: int) -> int:
        return math.floor(SCALE * math.log(max(self.total, 1) / n) + 0.5)

    def cut(self, text: str) -> list[str]:
        """The words of the cheapest path, worked out from the right; of equal ones that with the longest first word."""
        n = len(text)
        best, ends = [0] * (n + 1), [0] * n
        for at in range(n - 1, -1, -1):
            node, end = self.root, at
            least, to = self.alone + best[at + 1], at + 1
            while end < n and (node := node.get(text[end])) is not None:
                end += 1
                if (cost := node.get("")) is not None and cost + best[end] <= least:
                    least, to = cost + best[end], end
            best[at], ends[at] = least, to
        out, at = [], 0
        while at < n:
            out.append(text[at : ends[at]])
            at = ends[at]
        return out


def pattern(protected: Sequence[str] = PROTECTED) -> str:
    """Protected terms, Latin letters and digits, runs of Han characters, every other character alone."""
    return "|".join([*protected, r"[\p{IsLatin}\p{N}]+", r"\p{IsHan}+", r"[^\s\p{IsLatin}\p{N}\p{IsHan}]"])


def dictionary_tokenizer(words: DataFrame, protected: Sequence[str] = PROTECTED, most: int = MOST_WORDS) -> Callable[[Column], Column]:
    """A tokenizer (a function of a text column) over a dictionary (word, freq); words that repeat add up.

    Words without characters and those that occur less than once are left out. The dictionary is sent to every worker once. One of
    more than `most` words is refused. Protected terms are found first and never cut; only runs of Han
    characters are segmented, in Python, the rest is cut by one pattern.
    """
    small_batches(words.sparkSession)
    known = words.where("word is not null and word <> '' and freq > 0").groupBy("word").agg(F.sum("freq").cast("long").alias("freq"))
    rows = known.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a dictionary of more than {most} words cannot be broadcast")
    shared = words.sparkSession.sparkContext.broadcast([(r.word, r.freq) for r in rows])
    held: list[Lattice] = []

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(pieces: pd.Series) -> pd.Series:
        if not held:
            held.append(Lattice(shared.value))
        lattice, terms = held[0], frozenset(protected)

        def one(parts) -> list[str]:
            out: list[str] = []
            for p in parts:
                out += lattice.cut(p) if "⺀" <= p[0] and p not in terms else [p]
            return out

        return pieces.map(one)

    return lambda text: cut(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern(protected)), F.lit(0)))
