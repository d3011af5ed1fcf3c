"""Benchmark decontamination: Wu-Manber search of documents for the word windows of test items.

A word is a run of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. Every ten consecutive words
of an item are a pattern; an item of fewer words is one pattern as a whole. Patterns of one length are searched
together, with words for symbols: the block under the window's end (two words) names how far the window may move on;
where it may not move, the block's bucket holds the patterns that end in it, those that begin as the window does
are compared word by word.

Pairs of item and pattern are dealt into blocks of bounded size, so that what a task holds has a bound, however many
items there are: every block is broadcast and searched for in all documents, and what the blocks found is merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sedge.workspace import Scratch

#: Words of a window, and bytes of the patterns and item names that one block holds.
WINDOW, BLOCK_BYTES = 10, 16 << 20
#: What every byte becomes before a text is cut at spaces: A-Z small letters, ASCII other than letters and digits a space.
_FOLDED = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLDED).split()


@dataclass
class Length:
    """The patterns of one length: shifts by block, buckets by last block and first."""

    words: int
    block: int
    shift: dict[int, int] = field(default_factory=dict)
    buckets: dict[int, dict[int, list[tuple[list[int], int]]]] = field(default_factory=dict)

    @property
    def farthest(self) -> int:
        return self.words - self.block + 1


class Patterns:
    """A block of patterns. Words are numbered from 1; words that no pattern holds are 0."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.items = sorted({item for item, _ in pairs})
        number = {item: k for k, item in enumerate(self.items)}
        owners: dict[bytes, set[int]] = {}
        for item, pattern in pairs:
            owners.setdefault(pattern.encode("utf-8", "surrogatepass"), set()).add(number[item])
        self.owners = [sorted(found) for found in owners.values()]
        self.vocabulary: dict[bytes, int] = {}
        self.lengths: dict[int, Length] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in p.split(b" ")] for p in owners]
        self.base = len(self.vocabulary) + 1
        for no, ids in enumerate(coded):
            m = len(ids)
            own = self.lengths.setdefault(m, Length(m, min(2, m)))
            for end in range(own.block, m + 1):
                code = self._code(ids, end - 1, own.block)
                own.shift[code] = min(own.shift.get(code, own.farthest), m - end)
            first, last = self._code(ids, own.block - 1, own.block), self._code(ids, m - 1, own.block)
            own.buckets.setdefault(last, {}).setdefault(first, []).append((ids, no))

    def _code(self, ids: list[int], at: int, block: int) -> int:
        """The block of words that ends at a place, as a number."""
        return ids[at] if block == 1 else ids[at - 1] * self.base + ids[at]

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(first word, words, pattern) of every occurrence of every pattern."""
        known, base = self.vocabulary.get, self.base
        ids = [known(w, 0) for w in words]
        n = len(ids)
        for own in self.lengths.values():
            m, block, shift, farthest = own.words, own.block, own.shift.get, own.farthest
            at = m - 1
            while at < n:
                code = ids[at] if block == 1 else ids[at - 1] * base + ids[at]
                step = shift(code, farthest)
                if step:
                    at += step
                    continue
                start = at - m + 1
                for pattern, no in own.buckets[code].get(self._code(ids, start + block - 1, block), ()):
                    if ids[start : at + 1] == pattern:
                        yield start, m, no
                at += 1

    def hits(self, words: list[bytes]) -> tuple[list[dict], list[str]]:
        """Stretches of words inside occurrences, disjoint and in order, and the items that occur."""
        found = sorted(self.occurrences(words))
        out: list[dict] = []
        for start, m, _ in found:
            if out and start <= out[-1]["end"]:
                out[-1]["end"] = max(out[-1]["end"], start + m)
            else:
                out.append({"start": start, "end": start + m})
        return out, [self.items[k] for k in sorted({k for no in {no for *_, no in found} for k in self.owners[no]})]


def windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item, pattern) of every item: its windows, once each, or all its words where they are fewer; none without words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = [w.decode("utf-8", "surrogatepass") for w in words_of(text)]
                some = list(dict.fromkeys(" ".join(words[k : k + window]) for k in range(max(len(words) - window, 0) + 1))) if words else []
                for at in range(0, len(some), 4096):
                    yield pa.RecordBatch.from_pydict({"item": [item] * len(some[at : at + 4096]), "pattern": some[at : at + 4096]})

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "item string, pattern string").distinct()


_FOUND = "n_words long, hits array<struct<start:long,end:long>>, items array<string>"


def _search(docs: DataFrame, patterns: Patterns, hit_only: bool) -> DataFrame:
    """docs: (_id, _text). The columns of _FOUND, and the id; hit_only: of rows with a hit."""
    shared = docs.sparkSession.sparkContext.broadcast(patterns)
    kind = docs.schema["_id"].dataType.simpleString()
    as_arrow = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths = [], []
            for text in batch.column("_text").to_pylist():
                words = words_of(text)
                rows.append(shared.value.hits(words))
                lengths.append(len(words))
            hits, items = pa.array([h for h, _ in rows], pa.list_(as_arrow)), pa.array([i for _, i in rows], pa.list_(pa.string()))
            out = pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_print"), pa.array(lengths, pa.int64()), hits, items], ["_id", "_print", "n_words", "hits", "items"])
            yield out.filter(pa.array([bool(h) for h, _ in rows], pa.bool_())) if hit_only else out

    return docs.mapInArrow(look, f"_id {kind}, _print string, {_FOUND}")


def merged(ranges: Column) -> Column:
    """Overlapping or touching stretches as one, in order."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (x["start"] <= F.get(done, F.size(done) - 1)["end"]), grown).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(ranges), F.array().cast(kind), add)


def contaminated_documents(
    spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """id, n_words, hits (stretches of words, disjoint, in order) and items (as strings, sorted) of every document.

    Null and empty texts have no words and no hits; items without words never occur. Rows without an id are left out
    on both sides; a repeated row is answered again, repeated items count once. Other columns are ignored, whatever
    their names. Without items, or with an empty table of documents, nothing is hit.
    """
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.lit("").alias("_print"))
    scratch = Scratch(spark, "contamination")
    pairs = scratch.keep(windows(items, window, item_col, item_text), "pairs")
    total = pairs.agg(F.sum(F.octet_length("item") + F.octet_length("pattern") + 16)).first()[0] or 0
    blocks = max(-(-total // block_bytes), 1)
    if blocks == 1:
        # One block is all: nothing to merge, and no row moves.
        found = _search(base, Patterns([tuple(r) for r in pairs.collect()]), False)
        scratch.drop(pairs)
        return found.select(F.col("_id").alias(id_col), "n_words", "hits", "items")
    base = base.withColumn("_print", F.sha2(F.coalesce("_text", F.lit("")), 256))
    parts = []
    for k in range(blocks):
        # A block's pairs are bounded by block_bytes.
        own = pairs.where(F.pmod(F.xxhash64("item", "pattern"), F.lit(blocks)) == k).collect()
        parts.append(scratch.keep(_search(base, Patterns([tuple(r) for r in own]), k > 0).withColumn("first", F.lit(int(k == 0))), f"block{k}"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    one = every.groupBy("_id", "_print").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sum("first").alias("rows")
    )
    again = one.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return scratch.answer(again.select(F.col("_id").alias(id_col), "n_words", merged(F.col("hits")).alias("hits"), "items"))


def digest(found: DataFrame) -> DataFrame:
    """The counts and the digest of the items of every document."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    ids = F.sha2(F.array_join("items", ","), 256)
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return digest(contaminated_documents(spark, docs, items))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS MATERIALIZED (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS m, array_to_string(w[k:k + 9], ' ') AS pattern
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
g AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS gram
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM p))),
o AS MATERIALIZED (SELECT doc_id, k, g.m, item FROM g JOIN p ON p.m = g.m AND p.pattern = g.gram),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS place FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
