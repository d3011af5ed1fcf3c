"""SentencePiece BPE encoding by a prefix table, and decoding.

For every prefix of a text the encoding has one last token. The tokens that end at a position come from an
automaton over all pieces; the right one is the one that may follow the last token of the prefix before it,
which a pair test decides by undoing both tokens' merges. Ids are then read backwards from the full prefix.

Merges by concatenation: any two neighbours whose joined text is a piece may merge, the lowest rank first,
the leftmost of equals first. No piece holds a word mark after another character, and no piece holds a line
feed (both are checked when a model is loaded), so a text falls apart before each run of word marks and around
line feeds, and the table of a segment can be kept for the next time it occurs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sedge.llm.sampling import id_and_text
from sedge.workspace import small_batches

MARK = "▁"
#: Segments kept by a worker; when full the store starts anew.
KEPT = 600_000


class PieceCodec:
    """Encodes and decodes like the library's default call: no begin or end ids, no sampling."""

    def __init__(self, model_path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.text: list[str] = []
        self.rank: list[float] = []
        self.id_of: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.byte_of: dict[int, int] = {}
        automaton = ahocorasick.Automaton()
        for i in range(library.vocab_size()):
            piece = library.id_to_piece(i)
            self.text.append(piece)
            # One character is where merging starts, so it can never be undone.
            self.rank.append(-library.get_score(i) if len(piece) > 1 else -1e9)
            if library.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                self.id_of[piece] = i
                automaton.add_word(piece, (len(piece), i))
        automaton.make_automaton()
        self.automaton = automaton
        whole = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id_of)
        lines = not any("\n" in p for p in self.id_of)
        pattern = f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if lines else f"{MARK}*[^{MARK}]+|{MARK}+"
        self.segments = re.compile(pattern if whole else r"(?s).+").findall
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, tuple[int, str, str]] = {}

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one."""
        found = self.halves.get(token)
        if found is None:
            symbols = [self.id_of[c] for c in self.text[token]]
            while len(symbols) > 2:
                rank, at, merged = min(
                    (self.rank[m], k, m) for k in range(len(symbols) - 1) if (m := self.id_of.get(self.text[symbols[k]] + self.text[symbols[k + 1]])) is not None
                )
                symbols[at : at + 2] = [merged]
            found = self.halves[token] = (symbols[0], symbols[1])
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand side by side in an encoding: no merge across them comes first."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        rank, text = self.rank, self.text
        a, b, limit, left_first = left, right, float("inf"), False
        while True:
            across = self.id_of.get(text[a] + text[b])
            # A merge across wins against an undone right token of equal rank, as it lies further left.
            if across is not None and (rank[across] < limit or (left_first and rank[across] == limit)):
                good = False
                break
            if len(text[a]) == 1 and len(text[b]) == 1:
                good = True
                break
            if rank[a] > rank[b]:
                limit, left_first = rank[a], False
                a = self.split(a)[1]
            else:
                limit, left_first = rank[b], True
                b = self.split(b)[0]
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def tokens(self, segment: str) -> list[int]:
        """Ids of one segment; a character without a piece becomes its bytes."""
        n = len(segment)
        last: list[tuple[int, int] | None] = [None] * n
        fits = self.fits
        for end, (length, token) in self.automaton.iter(segment):
            if last[end] is None:
                start = end - length
                if start < 0:
                    last[end] = (length, token)
                elif (before := last[start]) is None or fits(before[1], token):
                    # A position without a token is a character that no piece holds: anything may follow it.
                    last[end] = (length, token)
        ids: list[int] = []
        end = n - 1
        while end >= 0:
            found = last[end]
            if found is None:
                ids += [self.byte_id[x] for x in reversed(segment[end].encode())]
                end -= 1
            else:
                ids.append(found[1])
                end -= found[0]
        ids.reverse()
        return ids

    def decode_segment(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            out.append(self.text[i])
        if raw:
            out.append(raw.decode(errors="replace"))
        return "".join(out).replace(MARK, " ")

    def lookup(self, segment: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, decoded text) of a segment."""
        found = self.kept.get(segment)
        if found is None:
            ids = self.tokens(segment)
            found = (len(ids), ",".join(map(str, ids)), self.decode_segment(ids))
            if len(segment) <= 64:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[segment] = found
        return found

    def run(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, decoded text) of a text; null is empty."""
        if not text:
            return 0, "", ""
        get, look = self.kept.get, self.lookup
        parts = [get(s) or look(s) for s in self.segments(MARK + text.replace(" ", MARK))]
        decoded = "".join([p[2] for p in parts])
        return sum([p[0] for p in parts]), ",".join([p[1] for p in parts]), decoded[1:] if decoded[:1] == " " else decoded

    def encode(self, text: str | None) -> list[int]:
        joined = self.run(text)[1]
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> str:
        decoded = self.decode_segment(ids)
        return decoded[1:] if decoded[:1] == " " else decoded


_codecs: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """One codec per worker and model."""
    if model_path not in _codecs:
        _codecs[model_path] = PieceCodec(model_path)
    return _codecs[model_path]


#: What encode_texts() can return for a text.
OUTPUTS = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def encode_texts(docs: DataFrame, model_path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again; one row per input row with the id and the named outputs.

    Null and empty texts give no ids and an empty decoded text. Digests are taken in the task that made the ids,
    so that ids need not leave it. Repeated rows are treated alike; other columns are ignored; rows without an id are left out.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(o, OUTPUTS[o]) for o in outputs)])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model_path)
        make = {
            "n_tokens": lambda n, ids, text: n,
            "ids": lambda n, ids, text: [int(x) for x in ids.split(",")] if ids else [],
            "decoded": lambda n, ids, text: text,
            "ids_sha256": lambda n, ids, text: hashlib.sha256(ids.encode()).hexdigest(),
            "decoded_sha256": lambda n, ids, text: hashlib.sha256(text.encode()).hexdigest(),
        }
        for batch in batches:
            columns = {o: [] for o in outputs}
            for text in batch["_text"]:
                done = own.run(text)
                for o in outputs:
                    columns[o].append(make[o](*done))
            yield pd.DataFrame({id_col: batch["_id"], **columns})

    return id_and_text(docs, id_col, text_col).mapInPandas(encode, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256"))
