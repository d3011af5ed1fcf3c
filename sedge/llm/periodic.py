"""Runs of periodic words by descending-LCP Kruskal over suffix classes.

A run is a stretch of words with smallest period q that reaches the given length and exponent (six words, four times
its period) and that no neighbouring word extends. Per batch of documents:

1. Words become numbers. Suffixes are ordered by prefix doubling, a document apart from the others; suffixes whose
   first four words stand nowhere else in their document are settled and drop out of the doubling.
2. Longest common prefixes of neighbouring suffixes come from the doubling's own ranks.
3. Neighbours are united in order of decreasing LCP; a class keeps its positions in order. When classes meet at LCP l,
   pairs of positions that become adjacent, one from each class, have exactly l words in common. If their distance q is
   small enough for l (l + q reaches the least length and exponent), the earlier one lies in a run of period q that ends
   q + l words on. The first position of a run meets the one q behind it in this way, so the run begins at the
   smallest position that seeds its period and end; a multiple of q is never seeded, as the position between is in
   the class already.

Classes whose closest positions are too far apart for their longest LCP cannot seed anything and are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Least words and least exponent of a run.
LEAST, TIMES = 6, 4
#: Words that are searched at once, but for a longer document.
AT_ONCE = 1 << 17


def words_of(text: str | None) -> list[bytes]:
    """Runs between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _behind(rank: np.ndarray, doc: np.ndarray, step: int) -> np.ndarray:
    """The rank `step` words on, from 1; 0 where the document ends before."""
    out = np.zeros(len(rank), np.int64)
    if step < len(rank):
        out[:-step] = np.where(doc[step:] == doc[:-step], rank[step:] + 1, 0)
    return out


def _bucketed(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and where in it each key's bucket begins, by place of the order."""
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[1:] = np.diff(key[order]) != 0
    return order, np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))


def suffix_ranks(ids: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, 8, ... words within their document, until all differ."""
    levels, n = [], len(ids)
    key = doc * (int(ids.max()) + 1) + ids
    while len(levels) < 3:
        order, start = _bucketed(key)
        rank = np.empty(n, np.int64)
        rank[order] = start
        levels.append(rank)
        key = rank * (n + 1) + _behind(rank, doc, 1 << (len(levels) - 1))
    while True:
        rank = levels[-1]
        size = np.bincount(rank, minlength=n)
        active = np.flatnonzero(size[rank] > 1)
        if not len(active):
            return levels
        # A bucket's members are active together, so a new bucket's place within the old one is its rank's growth.
        behind = _behind(rank, doc, 1 << (len(levels) - 1))[active]
        order, start = _bucketed(rank[active] * (n + 1) + behind)
        old = rank[active][order]
        fresh = np.ones(len(old), bool)
        fresh[1:] = np.diff(old) != 0
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(old)), 0))
        rank = rank.copy()
        rank[active[order]] = old + start - first
        levels.append(rank)


def neighbours(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, lcp) of suffixes that are neighbours in the order and share at least four words."""
    levels = suffix_ranks(ids, doc)
    four, last = levels[2], levels[-1]
    some = np.flatnonzero(np.bincount(four, minlength=len(ids))[four] > 1)
    some = some[np.argsort(last[some], kind="stable")]
    a, b = some[:-1], some[1:]
    same = four[a] == four[b]
    a, b = a[same], b[same]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + lcp, len(ids) - 1), np.minimum(b + lcp, len(ids) - 1)
        inside = (np.maximum(a, b) + lcp < len(ids)) & (doc[x] == doc[a]) & (doc[y] == doc[b])
        lcp += np.where(inside & (levels[k][x] == levels[k][y]), 1 << k, 0)
    return a, b, lcp


def least_common(least: int, times: int) -> int:
    """Words that the first position of any run has in common with the one a period behind it, at least."""
    return min(max((times - 1) * q, least - q) for q in range(1, least + 1))


def _worth(a: np.ndarray, b: np.ndarray, lcp: np.ndarray, least: int, times: int) -> np.ndarray:
    """Of neighbours in order, those of classes that can seed: the closest positions are near enough for the longest LCP."""
    if not len(a):
        return np.zeros(0, bool)
    # Pairs follow each other along a class: a pair begins a new one where it does not start at the last one's end.
    fresh = np.ones(len(a), bool)
    fresh[1:] = a[1:] != b[:-1]
    group = np.cumsum(fresh) - 1
    firsts = np.flatnonzero(fresh)
    where = np.concatenate([a[firsts], b])
    whose = np.concatenate([group[firsts], group])
    order = np.lexsort((where, whose))
    where, whose = where[order], whose[order]
    gap = np.where(whose[1:] == whose[:-1], np.diff(where), len(where) + where.max())
    nearest = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(nearest, whose[1:], gap)
    longest = np.maximum.reduceat(lcp, firsts)
    good = (longest >= (times - 1) * nearest) & (longest + np.maximum(nearest, longest // max(times - 1, 1)) >= least)
    return good[group]


def runs_of(ids: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run; positions are those of the batch."""
    if not len(ids):
        return []
    a, b, lcp = neighbours(ids, doc)
    enough = lcp >= least_common(least, times)
    a, b, lcp = a[enough], b[enough], lcp[enough]
    worth = _worth(a, b, lcp, least, times)
    a, b, lcp = a[worth], b[worth], lcp[worth]
    order = np.argsort(-lcp, kind="stable")
    found: dict[tuple[int, int], int] = {}
    owner: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    for x, y, l in zip(a[order].tolist(), b[order].tolist(), lcp[order].tolist(), strict=True):
        p, q = owner.setdefault(x, x), owner.setdefault(y, y)
        few, many = members.pop(p, None) or [x], members.pop(q, None) or [y]
        if len(few) > len(many):
            few, many, p, q = many, few, q, p
        for at in few:
            insort(many, at)
        top = len(many) - 1
        for at in few:
            k = bisect_left(many, at)
            # Adjacent now, and from the other class: their LCP is l.
            for i, j in ((many[k - 1] if k else -1, at), (at, many[k + 1] if k < top else -1)):
                other = i if j == at else j
                if other >= 0 and owner[other] == q:
                    d = j - i
                    if l >= (times - 1) * d and l + d >= least:
                        key = (j + l, d)
                        found[key] = min(found.get(key, i), i)
        for at in few:
            owner[at] = q
        members[q] = many
    return sorted((start, end, d) for (end, d), start in found.items())


def made_periodic(doc_id: int, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a document of n words that is made periodic; None: it stays as it is.

    With h the CRC-32 of the id and g a tenth of it, every tenth document repeats, from word a = g mod n on, the next
    p = 1 + (n - a) / (3 + g mod 8) words.
    """
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    place = np.arange(n)
    p = 1 + (n - a) // (3 + g % 8)
    place[a:] = a + (place[a:] - a) % p
    return place


Arrange = Callable[[int, int], np.ndarray | None]


def _batches(batch: pa.RecordBatch, arrange: Arrange | None) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(ids, words) of documents of about AT_ONCE words together."""
    ids, rows, size = [], [], 0
    for doc, text in zip(batch.column("_id").to_pylist(), batch.column("_text"), strict=True):
        words = words_of(text.as_py())
        place = arrange(doc, len(words)) if arrange else None
        ids.append(doc)
        rows.append(words if place is None else [words[k] for k in place.tolist()])
        size += len(words)
        if size >= AT_ONCE:
            yield ids, rows
            ids, rows, size = [], [], 0
    if ids:
        yield ids, rows


def repeating(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Documents (numbers) where n consecutive words may come twice, by a hash: no other has a run."""
    if len(ids) <= n:
        return np.unique(doc)
    h = doc[: len(ids) - n + 1].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ ids[k : len(ids) - n + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    inside = doc[: len(ids) - n + 1] == doc[n - 1 :]
    h, own = h[inside], doc[: len(ids) - n + 1][inside]
    order = np.argsort(h)
    twice = h[order][1:] == h[order][:-1]
    return np.unique(own[order][1:][twice])


def runs_of_documents(rows: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of every document, by start, then period.

    Suffixes are told apart from four common words on, so the least length and exponent must ask for as many.
    """
    if times < 3 or least_common(least, times) < 4:
        raise ValueError("runs must be longer, or of a higher exponent, to share four words with themselves")
    out: list[list[tuple[int, int, int]]] = [[] for _ in rows]
    sizes = np.array([len(r) for r in rows], np.int64)
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter((number[w] for r in rows for w in r), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(rows)), sizes)
    keep = np.isin(doc, repeating(ids, doc, least_common(least, times)))
    ids, doc = ids[keep], doc[keep]
    if len(ids):
        begins = np.searchsorted(doc, np.arange(len(rows)))
        for start, end, period in runs_of(ids, doc, least, times):
            k = int(doc[start])
            out[k].append((start - int(begins[k]), end - start, period))
    return out


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stay when every run keeps its first period only, joined by one space."""
    if not runs:
        return b" ".join(words)
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(stays).tolist()])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, arrange: Arrange | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id, n_words, runs (start, length, period; by start, then period) and the collapsed text of every document.

    arrange: which original word stands at each place of a document (id, number of words); None: the text as it is.
    digests: the collapsed text's SHA-256 instead of the text. Null and empty texts have no words and no runs. Rows
    without an id are left out, a repeated row is answered again, other columns are ignored, whatever their names. An
    empty table gives an empty result. Documents never meet: nothing is shuffled.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    last = "collapsed_sha256" if digests else "collapsed"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("_id").type
            for ids, words in _batches(batch, arrange):
                runs = runs_of_documents(words, least, times)
                left = (collapsed(w, r) for w, r in zip(words, runs, strict=True))
                texts = [hashlib.sha256(t).hexdigest() for t in left] if digests else [t.decode("utf-8", "surrogatepass") for t in left]
                as_rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([len(w) for w in words], pa.int64()), pa.array(as_rows, _RUNS), pa.array(texts, pa.string())], [id_col, "n_words", "runs", last])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(search, f"{id_col} {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, {last} string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), arrange=made_periodic, digests=True)
    # The longest run; of equal ones the earliest, then the one of least period: runs come in that order.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, x: F.when(x["length"] > a["length"], x).otherwise(a))
    line = F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n")))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), "collapsed_sha256",
    )
