"""Toxicity scores over text restored by a noisy-channel decoder.

Writers hide words by look-alike signs (``1d10t``), repeated letters (``stuuupid``) and spacing (``s t u p i d``).
Suspicious tokens become character lattices: every sign offers the letters it may stand for, a repeated letter may
be read once or twice, and between letters that are written one by one a word may end. Viterbi decoding finds the
reading that a character language model and the channel's costs make likeliest; a long lattice is decoded with a
bounded lag, so no length is cut. The restored words, and the words as they stand, are then scored by the evidence
of words and word beginnings that label toxic documents.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sedge.llm.sampling import id_and_text
from sedge.workspace import Scratch, small_batches

#: What a word counts in a clean and in a toxic document.
WEIGHT = {0: 1, 1: 3}
CUT = 0.7
KEPT = 400_000
#: Different sets of telling clues that the driver covers by itself; more are covered by Spark, a clue a job, with the same result.
SETS = 20_000
#: Letters that a sign may stand for; keeping the sign is always possible.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou"}
#: Costs in nats of reading a sign as a letter, of a letter as itself, of dropping a repeated letter, and of ending a word between spaced letters.
SWAP, STAY, DROP, BREAK = 1.0, 0.0, 0.3, 1.0
SPACERS = " .-_*~"
#: Readings kept at a place, and letters behind it that may still change.
BEAM, LAG = 64, 32

_signs = "".join(re.escape(c) for c in LOOKS)
_odd = re.compile(rf"[^\W\d_][{_signs}]|[{_signs}][^\W\d_]|([^\W\d_])\1", re.IGNORECASE).search
_single = rf"[\w{''.join(re.escape(c) for c in LOOKS if c not in SPACERS)}]"
_spaced = re.compile(rf"(?<![\w{_signs}])(?:{_single}[ .\-_*~]){{2,}}{_single}(?![\w@$])")
_edge = re.compile(r"^[^\w@$]+|[^\w]+$")
_wide_edge = re.compile(rf"^[^\w{_signs}]+|[^\w{_signs}]+$")
_run = re.compile(r"(.)\1+", re.DOTALL)


#: A sign for any vowel links too many letters to tell anything.
ANY = "*"


def _alike() -> dict[int, str]:
    """Each sign but ANY, and each letter that it may stand for, to one of those that are linked so."""
    kinds: list[set[str]] = []
    for sign, letters in ((k, v) for k, v in LOOKS.items() if k != ANY):
        near = [k for k in kinds if k & {sign, *letters}]
        kinds = [k for k in kinds if k not in near] + [set().union({sign, *letters}, *near)]
    return {ord(c): min(k) for k in kinds for c in k}


_ALIKE = _alike()
#: By ASCII code, and for all other characters at 128: may part the letters of a spaced word, may be such a letter, may stand before its first one.
_sep, _letter, _open = (np.array([t(chr(c)) for c in range(128)] + [other]) for t, other in (
    (lambda c: c in SPACERS, False), (lambda c: re.match(_single, c) is not None, True), (lambda c: not re.match(rf"[\w{_signs}]", c), True),
))


def skeleton(word: str) -> str:
    """What all readings of a word without ANY share: linked signs and letters are one, runs are single."""
    return _run.sub(r"\1", word.translate(_ALIKE))


def spaced_runs(text: str) -> Iterator[re.Match]:
    """Words written letter by letter, as _spaced finds them; it is tried only where three letters stand parted."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < 5:
        return
    codes = np.minimum(codes, 128)
    sep, letter = _sep[codes], _letter[codes]
    some = np.flatnonzero(sep[1:-3] & sep[3:-1] & letter[:-4] & letter[2:-2] & letter[4:])
    end = 0
    for i in some[(some == 0) | _open[codes[some - 1]]].tolist():
        if i >= end and (m := _spaced.match(text, i)):
            end = m.end()
            yield m


def bare_words(token: str) -> tuple[str, str]:
    """A token in lower case without what stands around it, and with the look-alike signs at its ends."""
    if token.isalpha():
        return (low := token.lower()), low
    return _edge.sub("", token).lower(), _wide_edge.sub("", token).lower()


class CharModel:
    """Interpolated character trigrams over words between ends."""

    def __init__(self, words: Counter):
        threes: Counter = Counter()
        for word, n in words.items():
            n = 1 + math.log(n)  # types matter more than how often a few of them occur
            marked = "^^" + word + "$"
            for i in range(2, len(marked)):
                threes[marked[i - 2 : i + 1]] += n
        self._sum(threes)

    @classmethod
    def of(cls, threes: dict[str, float]) -> CharModel:
        """The model of trigrams that are summed already."""
        model = cls.__new__(cls)
        model._sum(threes)
        return model

    def _sum(self, threes: dict[str, float]) -> None:
        self.tri: dict[str, Counter] = defaultdict(Counter)
        self.bi: dict[str, Counter] = defaultdict(Counter)
        self.uni: Counter = Counter()
        for (a, b, c), n in threes.items():
            self.tri[a + b][c] += n
            self.bi[b][c] += n
            self.uni[c] += n
        self.total = sum(self.uni.values()) + 1
        self.memo: dict[str, float] = {}
        self.sums = {k: sum(v.values()) for k, v in self.tri.items()}, {k: sum(v.values()) for k, v in self.bi.items()}

    def cost(self, before: str, c: str) -> float:
        """Negative log probability of c after the two characters before it."""
        key = before + c
        found = self.memo.get(key)
        if found is None:
            three, two = self.sums[0].get(before, 0), self.sums[1].get(before[1], 0)
            p = 0.001 * (self.uni[c] + 0.01) / self.total
            p += 0.199 * (self.bi[before[1]][c] / two if two else self.uni[c] / self.total)
            p += 0.8 * (self.tri[before][c] / three if three else self.bi[before[1]][c] / two if two else self.uni[c] / self.total)
            found = self.memo[key] = -math.log(p + 1e-9)
        return found


def decode(token: str, model: CharModel, spaced: bool = False) -> str:
    """Likeliest reading of a token: Viterbi over (last two characters) along its lattice. spaced: words may end between
    letters and come back parted by spaces. Of a run of one sign two are read: more can only be dropped."""
    beams: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
    done: list[str] = []
    before = previous = ""
    steps = 0
    memo = model.memo
    for sign in token:
        repeated = sign == previous
        if repeated and before == sign:
            continue
        before, previous = previous, sign
        if not repeated and not spaced and len(beams) == 1 and sign not in LOOKS:
            # One reading so far, and one way on.
            [(state, (cost, out))] = beams.items()
            known = memo.get(state + sign)
            beams = {state[1] + sign: (cost + STAY + (model.cost(state, sign) if known is None else known), out + sign)}
            steps += 1
            if steps % LAG == 0:
                beams = _settle(beams, done)
            continue
        step: dict[str, tuple[float, str]] = {}
        options = [(sign, STAY)] + [(c, SWAP) for c in LOOKS.get(sign, "")]
        for state, (cost, out) in beams.items():
            if repeated:
                _offer(step, state, cost + DROP, out)
            for c, extra in options:
                known = memo.get(state + c)
                total = cost + extra + (model.cost(state, c) if known is None else known)
                if (there := step.get(new := state[1] + c)) is None or (total, out + c) < there:
                    step[new] = (total, out + c)
                if spaced and state != "^^":
                    _offer(step, "^" + c, cost + extra + BREAK + model.cost(state, "$") + model.cost("^^", c), out + " " + c)
        beams = step if len(step) <= BEAM else dict(sorted(step.items(), key=lambda kv: kv[1])[:BEAM])
        steps += 1
        if steps % LAG == 0:
            beams = _settle(beams, done)
    return "".join(done) + min((cost + model.cost(state, "$"), out) for state, (cost, out) in beams.items())[1]


def _settle(beams: dict[str, tuple[float, str]], done: list[str]) -> dict[str, tuple[float, str]]:
    """What lies further back than the lag is settled by the best reading; those that differ there are given up."""
    settled = min(beams.values())[1][:-LAG]
    if not settled:
        return beams
    done.append(settled)
    return {k: (c, o[len(settled) :]) for k, (c, o) in beams.items() if o.startswith(settled)}


def _offer(step: dict, state: str, cost: float, out: str) -> None:
    if state not in step or (cost, out) < step[state]:
        step[state] = (cost, out)


@dataclass
class ToxicityModel:
    chars: CharModel
    evidence: dict[str, float] = field(default_factory=dict)  # word or beginning (ending in *) -> log odds
    slope: float = 1.0
    bias: float = -5.0


BEGINNINGS = (4, 5, 6, 7, 8, 9)


def clues(word: str) -> list[str]:
    """A restored word and its beginnings."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


class Restorer:
    """Restored words of a text; each token is decoded once and kept."""

    def __init__(self, chars: CharModel):
        self.chars = chars
        self.kept: dict[str, tuple[str, ...]] = {}

    def readings(self, token: str) -> tuple[str, ...]:
        """A token restored; where they differ also as it stands, and with the look-alike signs at its ends read too."""
        found = self.kept.get(token)
        if found is None:
            if len(self.kept) > KEPT:
                self.kept.clear()
            found = self.kept[token] = self.read(*bare_words(token))
        return found

    def read(self, bare: str, wide: str) -> tuple[str, ...]:
        found = (decode(bare, self.chars), bare) if _odd(bare) else (bare,)
        if wide != bare and _odd(wide):
            found += (decode(wide, self.chars),)
        return tuple(dict.fromkeys(found))

    def word(self, token: str) -> str:
        return self.readings(token)[0]

    def spaced(self, text: str) -> list[str]:
        """Words written letter by letter: the whole run as words and as one, and what may begin at each of its letters."""
        found = []
        for m in spaced_runs(text):
            joined = "".join(c for c in m[0].lower() if c not in SPACERS)
            one = decode(joined, self.chars)
            found += [*decode(joined, self.chars, spaced=True).split(), one, *(one[i : i + BEGINNINGS[-1]] for i in range(len(one)))]
        return found

    def words(self, text: str | None) -> list[str]:
        """All readings of a text's words."""
        if not text:
            return []
        return [w for t in text.split() for w in self.readings(t)] + self.spaced(text)

    def text(self, text: str | None) -> str:
        """The restored text: its words, then the runs that were spaced out, parted into words."""
        runs = ["".join(c for c in m[0].lower() if c not in SPACERS) for m in spaced_runs(text or "")]
        return " ".join([self.word(t) for t in (text or "").split()] + [decode(r, self.chars, spaced=True) for r in runs])


class Telling:
    """Distinct readings of a text that hold any of the wanted clues, or (as_clues) those clues. Each token is looked at once and kept.

    A reading has its token's skeleton, so a token that is no plain word is decoded only if its skeleton begins like a clue's.
    """

    def __init__(self, restorer: Restorer, wanted: Iterable[str], as_clues: bool = False):
        self.restorer, self.as_clues = restorer, as_clues
        self.wanted = {c: c for c in wanted}
        begins = [c[:-1] for c in self.wanted if c.endswith("*")]
        self.heads = {b[: BEGINNINGS[0]] for b in begins}
        self.whole = {skeleton(c) for c in self.wanted if not c.endswith("*")}
        by_two: dict[str, set[str]] = defaultdict(set)
        for b in begins:
            by_two[skeleton(b)[:2]].add(skeleton(b))
        self.begins = {k: (k,) if k in v else tuple(v) for k, v in by_two.items()}
        self.silent: set[str] = set()
        self.told: dict[str, tuple[str, ...]] = {}

    def may_tell(self, word: str) -> bool:
        """Whether any reading of a word that is not plain may hold a clue."""
        if ANY in word:
            return True
        bones = skeleton(word)
        return bones in self.whole or bones.startswith(self.begins.get(bones[:2], ())) or bones[:1] in self.begins

    def held(self, words: Iterable[str]) -> Iterator[str]:
        wanted = self.wanted
        for w in words:
            if w and (w in wanted or w[: BEGINNINGS[0]] in self.heads) and (found := [wanted[c] for c in clues(w) if c in wanted]):
                yield from found if self.as_clues else (w,)

    def _look(self, token: str) -> tuple[str, ...]:
        bare, wide = bare_words(token)
        odd = _odd(bare), wide != bare and _odd(wide)
        may = odd[0] and self.may_tell(bare), odd[1] and self.may_tell(wide)
        found = tuple(self.held(self.restorer.read(bare, wide) if any(may) else (bare,)))
        if found:
            if len(self.told) > KEPT // 4 * 3:
                self.told.clear()
            self.told[token] = found
            return found
        if len(self.silent) > KEPT:
            self.silent.clear()
        self.silent.add(token)
        return ()

    def __call__(self, text: str | None) -> set[str]:
        if not text:
            return set()
        told = self.told
        found = set().union(*[told[t] if t in told else self._look(t) for t in set(text.split()) - self.silent])
        found.update(self.held(set(self.restorer.spaced(text))))
        return found


def learn_evidence(bags: list[set[str]], y: list[int]) -> dict[str, float]:
    """Clues that cover the toxic documents among some bags of clues; see cover."""
    toxic = [b for b, t in zip(bags, y, strict=True) if t]
    clean = Counter(c for b, t in zip(bags, y, strict=True) if not t for c in b)
    seen = Counter(c for b in toxic for c in b)

    return cover({c: (n, clean[c]) for c, n in seen.items()}, len(toxic), len(y) - len(toxic), gains_in([(b, 1) for b in toxic]))


def gains_in(sets: list[tuple[set[str], int]]) -> Callable[[list[str]], dict[str, int]]:
    """gains for cover, of sets of clues in hand with their numbers; one more clue is taken at each call."""
    left = list(sets)

    def gains(taken: list[str]) -> dict[str, int]:
        if taken:
            left[:] = [(b, n) for b, n in left if taken[-1] not in b]
        new: Counter = Counter()
        for b, n in left:
            for c in b:
                new[c] += n
        return new

    return gains


def bounds(n_toxic: int, n_clean: int) -> tuple[int, float]:
    """Toxic documents that a clue must stand in, and clean ones that it may: so many shares of them leave few clues, however many documents there are."""
    return max(2, math.ceil(0.003 * n_toxic)), 0.002 * max(1, n_clean)


def cover(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, gains: Callable[[list[str]], dict[str, int]]) -> dict[str, float]:
    """Clues with their odds that cover the toxic documents, the best first: each is taken for documents that none before
    explains, so a word that only keeps company with toxic ones in copied texts earns no place.

    counts: toxic and clean documents of each clue. gains: toxic documents of each clue in which none of those taken stands.
    Each clue taken explains a share of the documents of its own, so there are at most as many turns as shares.
    """
    least, most = bounds(n_toxic, n_clean)
    full = {c: n for c, (n, bad) in counts.items() if n >= least and bad <= most}
    odds = {c: math.log((n + 0.1) / (n_toxic + 1)) - math.log((counts[c][1] + 0.1) / (max(1, n_clean) + 1)) for c, n in full.items()}
    by_gain = sorted(full, key=lambda c: (-full[c] * max(odds[c], 0), -len(c), c))
    place = {c: k for k, c in enumerate(by_gain) if odds[c] > 2}
    evidence: dict[str, float] = {}
    while len(evidence) < len(place):
        # Of clues that explain as many, the one with the fewest clean documents, then the longer.
        new = [(-n, place[c], c) for c, n in gains(list(evidence)).items() if c in place and c not in evidence and n >= least]
        if not new:
            break
        best = min(new)[2]
        evidence[best] = odds[best]
    # Companions of equal strength: clues as telling as the chosen ones that stand with them in many unlike documents.
    for c in by_gain:
        if full[c] >= max(least, 0.02 * n_toxic) and odds[c] > 3:
            evidence.setdefault(c, odds[c])
    return evidence


def evidence_of(words: Iterable[str], evidence: dict[str, float]) -> float:
    """Strength of the distinct toxic words of a text: each counts by its best clue, the first most, and the sum by its logarithm."""
    strengths = sorted((max((evidence.get(c, 0.0) for c in clues(w)), default=0.0) for w in set(words)), reverse=True)
    return math.log1p(sum(s / (1 + k) for k, s in enumerate(strengths)))


def plain_words(text: str) -> set[str]:
    """Words of a text that hide nothing."""
    return {w for w in {_edge.sub("", w).lower() for w in text.split()} if w.isalpha() and not _odd(w)}


def plain_finder() -> Callable[[str], set[str]]:
    """plain_words; each token is looked at once and kept."""
    kept: dict[str, str] = {}

    def look(token: str) -> str:
        if len(kept) > KEPT:
            kept.clear()
        w = bare_words(token)[0]
        found = kept[token] = w if w.isalpha() and not _odd(w) else ""
        return found

    return lambda text: {kept[t] if t in kept else look(t) for t in set(text.split())} - {""}


def in_fit(text: str) -> bool:
    """Whether a text is one of the three in four that evidence is first learnt from."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % 4 != 1


def scaled(x: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope and bias of evidence x, label t of n documents each."""
    a, b = 3.0, -4.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = n * (p - t), n * (p * (1 - p) + 1e-4)
        grad = np.array([(g * x).sum() + 0.01 * a, g.sum() + 0.01 * b])
        hess = np.array([[(h * x**2).sum() + 0.01, (h * x).sum()], [(h * x).sum(), h.sum() + 0.01]])
        move = np.linalg.solve(hess, grad)
        a, b = a - np.clip(move[0], -0.5, 0.5), b - np.clip(move[1], -0.5, 0.5)
    return float(max(a, 0.1)), float(b)


def train(texts: list[str], y: list[int]) -> ToxicityModel:
    """Fit on a few labelled texts in hand; fit_toxicity learns the same from a table of any size."""
    plain: Counter = Counter()
    for t, label in zip(texts, y, strict=True):
        for w in plain_words(t):
            plain[w] += WEIGHT[label]
    model = ToxicityModel(CharModel(plain))
    if not any(y):
        return model
    restorer = Restorer(model.chars)
    words = [sorted(set(restorer.words(t))) for t in texts]  # evidence counts distinct words
    fit = [in_fit(t) for t in texts]
    bags = [{sys.intern(c) for w in ws if w for c in clues(w)} for ws in words]
    model.evidence = learn_evidence([b for b, f in zip(bags, fit, strict=True) if f], [t for t, f in zip(y, fit, strict=True) if f])
    x = np.array([round(evidence_of(ws, model.evidence), 3) for ws in words])
    t, on = np.array(y), ~np.array(fit)
    # On the documents that gave no evidence; on all where they are too few.
    on = on if (t[on] == 1).sum() > 20 else np.ones(len(t), bool)
    model.slope, model.bias = scaled(x[on], t[on], np.ones(on.sum()))
    model.evidence = learn_evidence(bags, y)
    return model


def tallied(rows: DataFrame, make: Callable[[], Callable[[str], Iterable[str]]]) -> DataFrame:
    """key, toxic, fit, n: documents of each key and class. make() gives, once a task, the function from a text to its distinct keys."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, sums = make(), defaultdict(Counter)

        def told() -> Iterator[pd.DataFrame]:
            for (toxic, fit), c in sums.items():
                yield pd.DataFrame({"key": list(c.keys()), "toxic": toxic, "fit": fit, "n": list(c.values())}).astype({"toxic": "int32", "n": "int64"})
            sums.clear()

        for batch in batches:
            for text, toxic, fit in zip(batch["text"], batch["toxic"], batch["fit"], strict=True):
                sums[toxic, fit].update(keys(text))
            if sum(map(len, sums.values())) > KEPT:
                yield from told()
        yield from told()

    return rows.mapInPandas(tally, "key string, toxic int, fit boolean, n long").groupBy("key", "toxic", "fit").agg(F.sum("n").alias("n"))


def learnt_texts(docs: DataFrame, labels: DataFrame, may_learn: Column) -> DataFrame:
    """text, toxic, fit of every document with a label that may_learn allows; equal texts count once a label."""
    known = labels.where(may_learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    # Which rows stay is settled by hashes, so texts move once.
    hashed = texts.select("doc_id", F.sha2("text", 256).alias("h")).join(known.hint("merge"), "doc_id")
    once = hashed.groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic")
    # Texts of these ids are dear to read, so they are dealt over as many tasks as the documents are.
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, texts.rdd.getNumPartitions())
    chosen = texts.repartition(parts, "doc_id").join(once.repartition(parts, "doc_id").hint("merge"), "doc_id")
    fit = F.crc32(F.col("text").cast("binary")) % 4 != 1
    return chosen.select("text", "toxic", fit.alias("fit"))


def char_model(words: DataFrame) -> CharModel:
    """The character model of words (key, n). Their trigrams are summed in Spark: the driver sees as many as the alphabets make."""
    weight = F.round(1 + F.log("n"), 6).cast("decimal(20,6)")  # exact sums in any order
    marked = words.select(weight.alias("n"), F.concat(F.lit("^^"), "key", F.lit("$")).alias("w"))
    threes = marked.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring("w", i, F.lit(3)))).alias("three"))
    return CharModel.of({r[0]: float(r[1]) for r in threes.groupBy("three").agg(F.sum("n")).orderBy("three").collect()})


def fit_toxicity(docs: DataFrame, labels: DataFrame, may_learn: Column, sets_in_hand: int = SETS) -> ToxicityModel:
    """Learn from every label that may_learn allows.

    Words, clues and trigrams are counted in Spark. What comes to the driver are clues that stand in a share of the
    toxic documents, a histogram of the evidence in thousandths and trigrams, so its size does not follow the table's.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "toxicity")
    rows = scratch.keep(learnt_texts(docs, labels, may_learn), "texts")
    size = {(r[0], r[1]): r[2] for r in rows.groupBy("toxic", "fit").count().collect()}
    count = lambda toxic, *fit: sum(size.get((toxic, f), 0) for f in fit)
    plain = tallied(rows, plain_finder)
    model = ToxicityModel(char_model(plain.groupBy("key").agg(F.sum(F.col("n") * F.when(F.col("toxic") == 1, WEIGHT[1]).otherwise(WEIGHT[0])).alias("n"))))
    if not count(1, True, False):
        scratch.drop(rows)
        return model
    shared = spark.sparkContext.broadcast(model.chars)

    def bag_of() -> Callable[[str], set[str]]:
        restorer = Restorer(shared.value)
        return lambda text: {c for w in set(restorer.words(text)) if w for c in clues(w)}

    def counted(toxic: int, make: Callable[[], Callable[[str], set[str]]]) -> DataFrame:
        number = lambda of: F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0))
        return tallied(rows.where(F.col("toxic") == toxic), make).groupBy("key").agg(number(F.lit(True)).alias("_all"), number(F.col("fit")).alias("_fit"))

    def telling_of(some: Broadcast, as_clues: bool = False) -> Telling:
        return Telling(Restorer(shared.value), some.value, as_clues)

    turns = {"_fit": (count(1, True), count(0, True)), "_all": (count(1, True, False), count(0, True, False))}
    limits = {k: bounds(*n) for k, n in turns.items()}
    # Only clues of enough toxic documents are counted in clean ones: an average text's number of clues over the share, at most.
    often = {r["key"]: r for r in counted(1, bag_of).where(" or ".join(f"{k} >= {least}" for k, (least, _) in limits.items())).collect()}
    asked = spark.sparkContext.broadcast(frozenset(often))

    clean = {r["key"]: r for r in counted(0, lambda: telling_of(asked, as_clues=True)).collect()}
    told = {c: {k: (r[k], clean[c][k] if c in clean else 0) for k in turns} for c, r in often.items()}
    told = {c: n for c, n in told.items() if any(n[k][0] >= least and n[k][1] <= most for k, (least, most) in limits.items())}
    few = spark.sparkContext.broadcast(frozenset(told))

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        telling = telling_of(few, as_clues=True)
        for batch in batches:
            yield pd.DataFrame({"clues": [sorted(telling(t)) for t in batch["text"]], "fit": batch["fit"]})

    # Toxic documents with the same telling clues are one row with their number.
    sets = rows.where("toxic = 1").select("text", "fit").mapInPandas(held, "clues array<string>, fit boolean").groupBy("clues", "fit").agg(F.count(F.lit(1)).alias("n"))
    sets = scratch.keep(sets.where(F.size("clues") > 0).coalesce(spark.sparkContext.defaultParallelism), "sets")

    def evidence(k: str) -> dict[str, float]:
        mine = sets.where("fit") if k == "_fit" else sets

        def gains(taken: list[str]) -> dict[str, int]:
            # Where the sets are many, a turn is a job.
            left = mine.where(~F.arrays_overlap("clues", F.array(*map(F.lit, taken)))) if taken else mine
            return {r[0]: r[1] for r in left.select("n", F.explode("clues").alias("clue")).groupBy("clue").agg(F.sum("n")).collect()}

        some = mine.select("clues", "n").limit(sets_in_hand + 1).collect()
        turn = gains if len(some) > sets_in_hand else gains_in([(set(r[0]), r[1]) for r in some])
        return cover({c: n[k] for c, n in told.items()}, *turns[k], turn)

    model.evidence = evidence("_fit")
    first = spark.sparkContext.broadcast(model.evidence)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        telling = telling_of(first)
        for batch in batches:
            yield pd.DataFrame({"x": [round(evidence_of(telling(t), first.value), 3) for t in batch["text"]], "toxic": batch["toxic"]})

    # Platt scaling on the documents that gave no evidence; on all where they are too few.
    on = rows.where("not fit") if count(1, False) > 20 else rows
    steps = on.select("text", "toxic").mapInPandas(weigh, "x double, toxic int").groupBy("x", "toxic").count().orderBy("x", "toxic").collect()
    model.slope, model.bias = scaled(*(np.array([float(r[k]) for r in steps]) for k in range(3)))
    model.evidence = evidence("_all")
    scratch.drop(rows, sets)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", restored: bool = False) -> DataFrame:
    """id, score (0 to 1), predicted (1 if score >= 0.7) and, if asked for, the restored text, of every whole text.

    Null and empty texts hold no evidence and get the lowest score. Other columns are ignored; rows without an id are left out.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was learnt from
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        restorer = Restorer(own.chars)
        telling = Telling(restorer, own.evidence)
        for batch in batches:
            scores, texts = [], []
            for text in batch["_text"]:
                x = evidence_of(telling(text), own.evidence)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, own.slope * x + own.bias)))))
                texts.append(restorer.text(text) if restored else "")
            s = np.array(scores, dtype=float)
            out = pd.DataFrame({id_col: batch["_id"], "score": s, "predicted": (s >= CUT).astype("int32")})
            yield out.assign(restored=texts) if restored else out

    return id_and_text(docs, id_col, text_col).mapInPandas(score, f"{id_col} {kind}, score double, predicted int" + ", restored string" * restored)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
