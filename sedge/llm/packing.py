"""Hierarchical multi-length packing.

Documents are routed to context tiers (powers of two up to the window). Every partition packs its own documents:
a long document first fills whole windows, and what remains of it goes to the tier that just holds it. Each tier
collects pieces until one of its own sequences can be filled without padding; a long window that a document
leaves open is filled from the shorter tiers, longest piece first, cutting the last one. What a partition has
left at its end is cut into sequences of powers of two, which need no padding. Sequences are dealt to step
groups of equal token counts within a partition only: each partition may leave one short group a tier and size.

Ids never leave the task that made them: only lengths, places and checksums are returned, so nothing is shuffled.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from sedge.llm.sampling import id_and_text
from sedge.workspace import small_batches

WINDOW, SHORTEST_TIER, STEP_TOKENS, END_ID = 2048, 128, 16 * 2048, 1
#: Words with rare characters kept by a worker; when full the store starts anew.
KEPT = 100_000


#: Fixed values of the tokenizer's file: how it prepares text and cuts it into pieces.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = {
    "type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True,
}
END_OF_WORD = "</w>"

# The same pieces in lower-cased text up to U+012F: letters, numbers, white space and signs of that range by name.
_space = "\t-\r \x85\xa0"
_letter, _number = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u012f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_piece = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_letter}]+|[{_number}]|[^{_space}{_letter}{_number}]+")
_odd = re.compile("[^\x00-\u012f]")
_odd_word = re.compile(f"[^{_space}]*[^\x00-\u012f][^{_space}]*")


def merge_engine(file: dict) -> tiktoken.Encoding | None:
    """The file's merges for text whose pieces are each followed by one space; None if its rules are others than these."""
    model, cutter = file["model"], file["pre_tokenizer"]
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    known = (model["type"], model["end_of_word_suffix"], file["normalizer"]) == ("BPE", END_OF_WORD, NORMALIZER)
    if not known or (cutter["type"], cutter.get("pretokenizers")) != ("Sequence", [PIECES, byte_level]):
        return None
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = {pair: k for k, pair in enumerate(pairs)}
    byte_of = {c: bytes([b]) for b, c in byte_characters().items()}
    ranks = {}
    for token, at in model["vocab"].items():
        ends = token.endswith(END_OF_WORD)
        letters = list(token.removesuffix(END_OF_WORD))
        if any(c not in byte_of for c in letters):
            return None
        if merged_alone([*letters[:-1], letters[-1] + END_OF_WORD] if ends else letters, order) == [token]:
            ranks[b"".join(byte_of[c] for c in letters) + b" " * ends] = at
    first = [ranks.get(bytes([b])) for b in range(256)] + [ranks.get(bytes([b, 32])) for b in range(256)]
    merged = [model["vocab"][a + b] for a, b in pairs]
    # Ids serve as ranks: bytes, then bytes that end a word, then merges in their order. A lone space is in no piece.
    if None in first or max(first[:256]) > min(first[256:]) or max(first[256:]) > min(merged) or merged != sorted(merged):
        return None
    return tiktoken.Encoding("pieces", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})


def byte_characters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: visible Latin-1 signs as they are, the rest from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


def merged_alone(parts: list[str], order: dict[tuple[str, str], int]) -> list[str]:
    """What the merges make of a list of symbols: always the first listed pair, leftmost first."""
    while len(parts) > 1:
        rank, k = min((order.get(pair, len(order)), k) for k, pair in enumerate(zip(parts, parts[1:])))
        if rank == len(order):
            break
        parts = [*parts[:k], parts[k] + parts[k + 1], *parts[k + 2 :]]
    return parts


class WordIds:
    """Ids of a text as little-endian 32-bit bytes, equal to those of the tokenizer's own encode().

    Text in characters whose case, class and normal form have long been fixed is cut into pieces here and merged by
    tiktoken's engine over the same vocabulary; white-space words with other characters go to the tokenizer itself, as
    does everything if the file's rules are not those that this class knows.

    The engine joins two neighbours whenever their concatenation is in its table, the tokenizer only by the merge that
    the file lists. Both do the same when the table holds just the tokens that merging their own characters arrives
    at: as long as no merge crosses a stretch's ends, it passes through the states it would pass through alone.
    A space never lies in a piece, so it stands for the end of a word, and joining it to the last byte ranks first.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.engine = merge_engine(file)
        #: Strings that the tokenizer takes out of a text before all else: a text with one is left to it.
        self.added = [t["content"] for t in file.get("added_tokens", ())]
        self.kept: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def odd(self, word: str) -> bytes:
        if word not in self.kept:
            if len(self.kept) >= KEPT:
                self.kept = {}
            self.kept[word] = self.whole(word)
        return self.kept[word]

    def plain(self, text: str) -> bytes:
        pieces = _piece.findall(text.lower())
        return self.engine.encode_to_numpy(" ".join(pieces) + " ").astype("<u4", copy=False).tobytes() if pieces else b""

    def encode(self, text: str | None) -> bytes:
        """Null is empty."""
        if not text:
            return b""
        if self.engine is None or any(t in text for t in self.added):
            return self.whole(text)
        if not _odd.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in _odd_word.finditer(text):
            out += [self.plain(text[at : m.start()]), self.odd(m[0])]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


_words: dict[str, WordIds] = {}


def words(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


class Packer:
    """Packs one partition. Pieces wait as (doc, start, ids, doc_tokens); at most one window's worth waits in a tier."""

    def __init__(self, first_sequence: int, window: int, shortest: int, step_tokens: int):
        self.window, self.step_tokens = window, step_tokens
        self.tiers: dict[int, deque] = {}
        self.waiting: dict[int, int] = {}
        tier = shortest
        while tier <= window:
            self.tiers[tier], self.waiting[tier] = deque(), 0
            tier *= 2
        self.order = sorted(self.tiers)
        self.next_sequence = first_sequence
        self.group = first_sequence
        self.group_tokens = {t: 0 for t in self.order}
        self.group_of = {}
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple], tier: int) -> None:
        """One sequence of the given pieces. Sequences of one tier share a step group until it holds its tokens."""
        if tier not in self.group_of or self.group_tokens[tier] + tier > self.step_tokens:
            self.group_of[tier], self.group_tokens[tier] = self.group, 0
            self.group += 1
        self.group_tokens[tier] += tier
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_sequence, offset, tier, self.group_of[tier]))
            offset += n
        self.next_sequence += 1

    def add(self, doc, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.window:
            self.emit([(doc, at, ids[4 * at : 4 * (at + self.window)], total)], self.window)
            at += self.window
        left = total - at
        if not left:
            return
        piece = (doc, at, ids[4 * at :], total)
        tier = next(t for t in self.order if t >= left)
        if tier == self.window:
            self.fill(piece)
            return
        self.tiers[tier].append(piece)
        self.waiting[tier] += left
        if self.waiting[tier] >= 2 * tier:
            self.drain(tier, tier)

    def take(self, tier: int, n: int) -> list[tuple]:
        """n tokens from the front of a tier; the last piece is cut and its rest stays in front."""
        taken = []
        while n:
            doc, start, ids, total = self.tiers[tier].popleft()
            size = min(n, len(ids) // 4)
            taken.append((doc, start, ids[: 4 * size], total))
            if 4 * size < len(ids):
                self.tiers[tier].appendleft((doc, start + size, ids[4 * size :], total))
            n -= size
            self.waiting[tier] -= size
        return taken

    def drain(self, tier: int, size: int) -> None:
        while self.waiting[tier] >= size:
            self.emit(self.take(tier, size), size)

    def fill(self, piece: tuple) -> None:
        """A document that nearly fills a window: its gap takes whole short pieces first, the longest that fit,
        then cut ones; if too little waits, the document waits itself."""
        gap = self.window - len(piece[2]) // 4
        if sum(self.waiting.values()) < gap:
            self.tiers[self.window].append(piece)
            self.waiting[self.window] += len(piece[2]) // 4
            self.drain(self.window, self.window)
            return
        pieces = [piece]
        for tier in reversed(self.order):
            while gap and self.tiers[tier] and len(self.tiers[tier][0][2]) // 4 <= gap:
                size = len(self.tiers[tier][0][2]) // 4
                pieces += self.take(tier, size)
                gap -= size
        for tier in self.order:
            size = min(gap, self.waiting[tier])
            if size:
                pieces += self.take(tier, size)
                gap -= size
        self.emit(pieces, self.window)

    def finish(self) -> None:
        """Sequences of falling powers of two for all that waits, longest pieces first."""
        rest: deque = deque(p for t in reversed(self.order) for p in self.tiers[t])
        self.tiers = {0: rest}
        self.waiting = {0: sum(len(p[2]) // 4 for p in rest)}
        while self.waiting[0]:
            size = min(self.window, 1 << (self.waiting[0].bit_length() - 1))
            self.group_tokens.setdefault(size, 0)
            self.emit(self.take(0, size), size)


COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, shortest_tier: int = SHORTEST_TIER, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    Every id of every document, and the closing id after it, lies in exactly one piece. A null or empty text is its
    closing id alone. sequence_id and step_group are unique across partitions (2**32 a partition). Sequences have
    no padding: tiers are powers of two, and a partition's rest is cut into powers of two. Repeated rows are packed
    again; other columns are ignored; an empty table gives no row.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, end = words(tokenizer_path), np.asarray([END_ID], dtype="<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 32, window, shortest_tier, step_tokens)
        names = [id_col, *(c.split()[0] for c in COLUMNS.split(", "))]
        for batch in batches:
            for doc, text in zip(batch["_id"], batch["_text"], strict=True):
                packer.add(doc, own.encode(text) + end)
            yield pd.DataFrame(packer.rows, columns=names)
            packer.rows = []
        packer.finish()
        yield pd.DataFrame(packer.rows, columns=names)

    return id_and_text(docs, id_col, text_col).mapInPandas(pack, f"{id_col} {kind}, {COLUMNS}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))

