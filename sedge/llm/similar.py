"""Exact n-gram Jaccard join by grouped prefixes, as classes and their components.

1. One pass makes every document's set of word shingles (64-bit hashes). Equal sets are one class.
2. Shingles are ordered by how often they occur, the rarest first. Frequencies come from a sketch of fixed size, so
   that it can be broadcast at any scale; a coarse order costs candidates, never results.
3. Two sets can only reach the similarity if their prefixes under that order meet (a fifth of a set and one more at
   0.8). Classes with the same prefix and size are one group; groups, not documents, are posted under the prefix's
   shingles, and filters on size, place and role apply where postings meet.
4. Postings of a shingle meet pivots first: a few members drawn by hash. What is verified to be linked becomes one
   component, and pairs inside a component need no test any more. Rounds with more pivots follow, and the last one
   meets every remaining pair of different components. So a large group of near copies costs its size times a few
   pivots, not its square, and yet no link between components is lost.
5. Shingles that the sketch gives to more than a thousandth of all documents are hot. Their postings are dealt by
   shingle, size band and a salt; what they are to meet is repeated for the salts and the neighbouring bands.

Verification compares whole sets. Links are shingle-exact up to chance collisions of 64-bit hashes within one pair (for
10,000 shingles on a side about one in 10**11); words are hashed as wholes, so that none collide by their structure.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sedge.llm.sampling import id_and_text
from sedge.workspace import HOT_SHARE, Scratch, join_hot, small_batches

WORDS, PERCENT = 5, 80
#: Counters of the sketch; 2**20 single bytes are broadcast, whatever the input.
SKETCH_BITS = 20
#: Pivots a shingle meets in each round; None: every remaining pair.
ROUNDS = (2, 32, None)
#: Tasks over which one size band of a hot shingle is dealt.
SALTS = 16

_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at once, but for a longer text; and words whose hashes a worker remembers.
_AT_ONCE, _REMEMBERED = 1 << 19, 1 << 20


class _Hashes(dict):
    """64-bit hashes of words. No arithmetic of their letters is kept, so no two words are bound to collide, whatever they repeat."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word, seed=0x5ED9E)
        return found


_hashes = _Hashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _PRIME
    return h ^ (h >> np.uint64(29))


def _sets(raw: list[bytes], n: int) -> list[np.ndarray]:
    """Shingle sets of lower-cased texts."""
    if len(_hashes) > _REMEMBERED:
        _hashes.clear()
    split = [r.split() for r in raw]
    edges = np.cumsum([0, *map(len, split)])
    words = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(split)), np.uint64, int(edges[-1]))
    with np.errstate(over="ignore"):
        whole = np.full(max(len(words) - n + 1, 0), np.uint64(n))
        for k in range(n if len(whole) else 0):
            whole = _mixed(whole ^ words[k : k + len(whole)])
        found = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo >= n:
                found.append(np.unique(whole[lo : hi - n + 1]))
            elif hi == lo:
                found.append(np.zeros(0, np.uint64))
            else:
                one = np.full(1, np.uint64(hi - lo))
                for w in words[lo:hi]:
                    one = _mixed(one ^ w)
                found.append(one)
    return found


def shingle_sets_of(texts: list[str | None], n: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word n-grams; of the whole sequence if it has fewer words; none
    without words. Words are runs between ASCII white space, A-Z lower-cased."""
    some, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
        if some and size + len(raw) > _AT_ONCE:
            yield from _sets(some, n)
            some, size = [], 0
        some.append(raw)
        size += len(raw)
    if some:
        yield from _sets(some, n)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    return next(shingle_sets_of([text], n))


#: A prefix's shingles are known by 56 bits of their hash; two that share them only make a candidate more.
_TOKEN = np.uint64((1 << 56) - 1)


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n - -(-percent * n // 100) + 1


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def frequencies(docs: DataFrame, bits: int, words: int) -> np.ndarray:
    """Rounded logarithms of how many documents' shingles fall on each counter of the sketch: one byte each."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for found in shingle_sets_of(batch["_text"].tolist(), words):
                total[(found >> np.uint64(64 - bits)).astype(np.int64)] += 1  # a document counts once on a counter
        step = 1 << 12
        parts = [(k, total[k * step : (k + 1) * step]) for k in range(len(total) // step)]
        parts = [(k, p) for k, p in parts if p.any()]
        for at in range(0, len(parts), 64):
            yield pd.DataFrame({"part": [k for k, _ in parts[at : at + 64]], "counts": [np.minimum(p, 0xFFFF).astype("<u2").tobytes() for _, p in parts[at : at + 64]]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, "<u2").astype(np.uint64) for c in pdf["counts"]], axis=0)
        level = np.minimum(np.round(8 * np.log2(total + 1)), 255).astype(np.uint8)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "levels": [level.tobytes()]})

    parts = docs.select("_text").mapInPandas(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, levels binary")
    levels = np.zeros(1 << bits, np.uint8)
    for part, level in parts.collect():  # one byte a counter: a fixed size
        levels[part << 12 : (part + 1) << 12] = np.frombuffer(level, np.uint8)
    return levels


def level_of(count: float) -> int:
    return int(min(round(8 * np.log2(count + 1)), 255))


def shingle_sets(docs: DataFrame, levels: np.ndarray, percent: int, words: int, hot_level: int = 255) -> DataFrame:
    """(id, n, set_key, prefix, hot_from) of every document; the prefix's shingles come rarest first, as 64-bit integers,
    and those from place hot_from on are above hot_level."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    shift = np.uint64(64 - int(len(levels)).bit_length() + 1)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            rows = []
            for s in shingle_sets_of(batch["_text"].tolist(), words):
                p = prefix_length(len(s), percent) if len(s) else 0
                # Level first, then the hash: one order for all documents.
                rank = own[(s >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8)
                if p < len(s):
                    rank = np.partition(rank, p)[:p]
                rank.sort()
                hot_from = int(np.searchsorted(rank, np.uint64(hot_level + 1) << np.uint64(56))) if hot_level < 255 else len(rank)
                rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), (rank & _TOKEN).astype(np.int64), hot_from))
            out = pd.DataFrame(rows, columns=["n", "set_key", "prefix", "hot_from"])
            out.insert(0, "id", batch["_id"].to_numpy())
            yield out

    return docs.mapInPandas(make, "id long, n int, set_key binary, prefix array<bigint>, hot_from int")


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the links (a, b): the smallest node reachable. Large-star and small-star in turns;
    a hub's neighbours are only ever reduced to their minimum, and every turn is written out."""
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # Large-star: a node's larger neighbours point to its smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small-star: a node and its smaller neighbours point to the smallest of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        starred = (
            large.join(small_least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small_least.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        after = scratch.keep(starred, "stars")
        scratch.drop(edges)
        edges = after
        # Done when every node points to one other, and that one to none: a turn that changes nothing need not be taken.
        ends = after.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(after.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        open_ = ends.groupBy("x").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out > 1 or (out = 1 and into > 0)")
        if open_.isEmpty():
            stars = edges.toDF("node", "root")
            stars._sedge_path, stars._sedge_table = edges._sedge_path, None
            return stars


def similar_documents(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, words: int = WORDS, rounds: tuple = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (smallest id reachable over links, itself included) of every row.

    Two documents link when 100 * intersection >= percent * union of their shingle sets. Null and empty texts and
    texts without words have no shingles and link with nothing. Ids are integers; rows without one are left out, a
    repeated row is answered again; other columns are ignored.
    An empty table gives an empty result.
    """
    scratch = Scratch(spark, "similar")
    small_batches(spark, 256)
    base = id_and_text(docs, id_col, text_col).withColumn("_id", F.col("_id").cast("long"))
    many = docs.count() / HOT_SHARE
    levels = frequencies(base, SKETCH_BITS, words)
    made = scratch.keep(shingle_sets(base, levels, percent, words, level_of(many)), "made")
    # A class: the documents of one set, named by the smallest id.
    own_prefix = F.min_by(F.struct("prefix", "hot_from"), "id")
    classes = made.where("n > 0").groupBy("set_key", "n").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("docs"), own_prefix.alias("p"))
    classes = scratch.keep(classes.select("cls", "set_key", "n", "docs", "p.prefix", "p.hot_from"), "classes", sweep=True)
    sets = scratch.keep(made.drop("prefix", "hot_from"), "sets")
    named = scratch.keep(classes.select("cls", "set_key", "docs"), "named")
    scratch.drop(made)
    # A group: the classes of one prefix and size.
    keyed = classes.select("cls", "n", F.sha2(F.concat_ws(",", F.col("prefix").cast("array<string>"), F.col("n").cast("string")), 256).alias("g"))
    grouped = scratch.keep(keyed.groupBy("g").agg(F.min("cls").alias("grp"), F.count(F.lit(1)).alias("k")).where("k > 1"), "grouped")
    alone = grouped.isEmpty()
    heads, members = classes.select(F.col("cls").alias("grp"), "n"), None
    if not alone:
        members = scratch.keep(join_hot(keyed, grouped, "g", F.col("k") > many).select("cls", "n", "grp", "k"), "members")
        heads = heads.join(members.where("cls <> grp").select(F.col("cls").alias("grp")).hint("merge"), "grp", "left_anti")
    posted = classes.select(F.col("cls").alias("grp"), "hot_from", F.posexplode("prefix").alias("pos", "token"))
    # Shingles that only one group holds in its prefix lead nowhere; both sides read one shuffle. Hot ones stay as they are.
    cold = posted.where("pos < hot_from").select("token", "grp", "pos").repartition("token")
    shared = cold.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("token")
    met = scratch.keep(cold.join(shared.hint("merge"), "token", "left_semi"), "met", sweep=True)
    postings = scratch.keep(met.join(heads.hint("merge"), "grp").select("token", "grp", "n", "pos"), "postings", sweep=True)
    hot = scratch.keep(posted.where("pos >= hot_from").join(heads.hint("merge"), "grp").select("token", "grp", "n", "pos"), "hot", sweep=True)
    # Prefixes have done their work; names of classes stay.
    scratch.drop(classes, met, grouped)
    # Whole sets are needed of groups that meet one of a size near their own, and of groups with several classes.
    by_size = W.partitionBy("token").orderBy("n", "grp")
    near = postings.select("grp", "n", F.lag("n").over(by_size).alias("less"), F.lead("n").over(by_size).alias("more"))
    near = near.where((100 * F.col("less") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("more"))).select("grp")
    near = near.unionByName(hot.select("grp"))
    if alone:
        wanted = near.distinct().select(F.col("grp").alias("cls"))
    else:
        wanted = near.unionByName(members.select(F.col("cls").alias("grp"))).distinct().select(F.col("grp").alias("cls"))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"cls": batch["_id"], "s": [s.tobytes() for s in shingle_sets_of(batch["_text"].tolist(), words)]})

    full = scratch.keep_joined(base, "_id", wanted, "cls", lambda f: f.select("_id", "_text").mapInPandas(whole, "cls long, s binary"), "whole")
    found = None if postings.isEmpty() and hot.isEmpty() else _search(scratch, postings, hot, full, members, percent, rounds)
    scratch.drop(postings, hot)
    if not alone:
        # Classes of one group meet each other, each group being a posting of its own.
        inside = members.select(F.col("grp").alias("token"), F.col("cls").alias("grp"), "n", F.lit(0).alias("pos"), (F.col("k") > many).alias("hot"))
        inside = scratch.keep(inside, "inside")
        within = _search(scratch, inside.where("not hot").drop("hot"), inside.where("hot").drop("hot"), full, None, percent, rounds)
        found = within if found is None else found.unionByName(within)
    scratch.drop(full)
    by_class = named.select("set_key", F.col("cls").alias("component_id"), "docs")
    if found is not None and not found.isEmpty():
        stars = connected(found, scratch)
        by_class = named.join(stars.select(F.col("node").alias("cls"), "root").hint("merge"), "cls", "left").select("set_key", F.coalesce("root", "cls").alias("component_id"), "docs")
    by_class = scratch.keep(by_class, "components")
    none = sets.where("n = 0").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    some = join_hot(sets.where("n > 0"), by_class, "set_key", F.col("docs") > many).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")
    return scratch.answer(some.unionByName(none))


def _search(scratch: Scratch, cold: DataFrame, hot: DataFrame, full: DataFrame, groups: DataFrame | None, percent: int, rounds: tuple) -> DataFrame:
    """Links (a, b) between classes that join all whose groups' postings meet: pivots first, then what is still apart.

    cold, hot: postings of shingles that few or many documents hold. groups: (cls, grp, k) of the groups with several
    classes; every other group is one class of the same name. None: all are.
    """
    any_hot = not hot.isEmpty()
    nodes = scratch.keep((cold.select("grp").unionByName(hot.select("grp")) if any_hot else cold.select("grp")).distinct().select(F.col("grp").alias("node")), "nodes")
    roots = scratch.keep(nodes.select("node", F.col("node").alias("root")), "roots")
    found, tested = [], []
    for k, pivots in enumerate(rounds):
        pairs = _pairs(cold, roots, pivots, percent, k)
        if any_hot:
            pairs = pairs.unionByName(_pairs(hot, roots, pivots, percent, k, SALTS))
        pairs = pairs.distinct()
        if tested:
            pairs = pairs.join(reduce(DataFrame.unionByName, tested).hint("merge"), ["x", "y"], "left_anti")
        pairs = scratch.keep(pairs, "pairs", sweep=True)
        if pairs.isEmpty():
            continue
        fresh = scratch.keep(_verified(pairs, full, groups, percent), "links", sweep=True)
        found.append(fresh.select("a", "b"))
        tested.append(pairs)
        if pivots is None or fresh.isEmpty():
            continue
        # A pair of groups is skipped later only when each holds one class: else a link joins some of their classes only.
        single = fresh.select(F.col("ga").alias("a"), F.col("gb").alias("b"))
        if groups is not None:
            plural = groups.where("cls = grp").select("grp")
            for end in ("a", "b"):
                single = single.join(plural.select(F.col("grp").alias(end)).hint("merge"), end, "left_anti")
        merged = single.unionByName(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        stars = connected(merged, scratch)
        before = roots
        roots = scratch.keep(nodes.join(stars.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
        scratch.drop(before, stars)
    scratch.drop(nodes, roots, *tested)
    return reduce(DataFrame.unionByName, found) if found else scratch.spark.createDataFrame([], "a long, b long")


def _pairs(postings: DataFrame, roots: DataFrame, pivots: int | None, percent: int, draw: int, salts: int = 0) -> DataFrame:
    """Pairs of groups (x < y) of different components whose postings meet and pass the filters on size, role and place.

    salts: deal the postings of a shingle by size band and so many salts.
    """
    own = postings.join(roots.select(F.col("node").alias("grp"), "root").hint("merge"), "grp")
    side = own
    if pivots is not None:
        # Pivots by hash, a new draw each round; the partial aggregate keeps a few rows of a hot shingle, not all.
        first = lambda f, *keys: f.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("draw", "grp"))).where(F.col("r") <= pivots)
        side = own.withColumn("draw", F.xxhash64("token", "grp", F.lit(draw)))
        if salts:
            side = first(side.withColumn("s", F.pmod(F.xxhash64("grp"), F.lit(salts))), "token", "s").drop("s")
        side = first(side, "token").drop("r", "draw")
    # Shingles whose groups are all of one component have nothing left to test.
    open_ = own.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
    left = own.select("token", F.col("grp").alias("a"), F.col("n").alias("an"), F.col("pos").alias("ap"), F.col("root").alias("ar"))
    right = side.select("token", F.col("grp").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bp"), F.col("root").alias("br"))
    if salts:
        # Sets that may link differ by less than one band, so they are of the same or of neighbouring bands.
        width = float(np.log(100 / percent)) + 1e-9
        band = lambda n: F.floor(F.log(F.col(n)) / F.lit(width)).cast("int")
        left = left.withColumn("band", band("an")).withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int"))
        right = right.join(open_.hint("merge"), "token", "left_semi") if pivots is not None else _open_postings(right, open_, salts)
        right = right.withColumn("band", F.explode(F.array(*(band("bn") + F.lit(d) for d in (-1, 0, 1))))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = left.join(right.hint("merge"), ["token", "band", "salt"])
    else:
        met = left.join(open_.hint("merge"), "token", "left_semi").join(right.hint("merge"), "token")
    meet = (F.col("ar") != F.col("br")) & _may_link(percent)
    if pivots is None:
        meet = meet & (F.col("a") < F.col("b"))
    return met.where(meet).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))


def _open_postings(right: DataFrame, open_: DataFrame, salts: int) -> DataFrame:
    """Postings of open shingles, a shingle's rows being dealt by a salt."""
    spread = open_.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return right.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int")).join(spread.hint("merge"), ["token", "s"], "left_semi").drop("s")


def _may_link(percent: int) -> Column:
    """Filters that every linked pair passes at its first common shingle.

    Size: the smaller set has at least percent of the larger. Role: in the smaller set the shingle lies in the shorter
    prefix that suffices when the partner is no smaller. Place: what can follow the shingle suffices for the overlap.
    """
    small, large = F.least("an", "bn"), F.greatest("an", "bn")
    small_pos = F.when(F.col("an") < F.col("bn"), F.col("ap")).when(F.col("an") > F.col("bn"), F.col("bp")).otherwise(F.least("ap", "bp"))
    need = F.ceil(F.lit(percent) * (F.col("an") + F.col("bn")) / F.lit(100 + percent) - 1e-9)
    role = small_pos <= small - F.ceil(F.lit(2 * percent) * small / F.lit(100 + percent) - 1e-9)
    place = 1 + F.least(F.col("an") - F.col("ap") - 1, F.col("bn") - F.col("bp") - 1) >= need
    return (100 * small >= percent * large) & role & place


def _verified(pairs: DataFrame, full: DataFrame, groups: DataFrame | None, percent: int) -> DataFrame:
    """Links (a, b) between the classes of paired groups, with their groups."""
    expanded = pairs.select("x", "y", F.col("x").alias("a"), F.col("y").alias("b"))
    if groups is not None:
        for group, cls in (("x", "a"), ("y", "b")):
            several = groups.select(F.col("grp").alias(group), F.col("cls").alias("_c"))
            expanded = expanded.join(several.hint("merge"), group, "left").withColumn(cls, F.coalesce("_c", cls)).drop("_c")
    left = full.select(F.col("cls").alias("a"), F.col("s").alias("sa"))
    right = full.select(F.col("cls").alias("b"), F.col("s").alias("sb"))
    met = expanded.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("x", "y", "a", "b", "sa", "sb")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(batch["sa"], batch["sb"], strict=True)]
            kept = batch[good] if len(batch) else batch
            yield pd.DataFrame({"a": kept["a"], "b": kept["b"], "ga": kept["x"], "gb": kept["y"]})

    return met.mapInPandas(verify, "a long, b long, ga long, gb long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, both_.b FROM r JOIN both_ ON both_.a = r.reach)
SELECT n.doc_id, n.n AS n_shingles, min(r.reach) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY ALL
"""
