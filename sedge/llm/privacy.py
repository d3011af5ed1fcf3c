"""Personal data by candidate gradient boosting.

High-recall generators propose spans that may overlap: the four base formats (passing or not), parts of those that
fail as a whole, numbers written without a plus sign, spelt-out addresses, account and identity numbers, and tokens
that look like keys. Boosted trees score each proposal from its format and its context. A threshold for each kind,
calibrated on held-out proposals, selects what is added; base spans that pass their own checks always stay.

Labels come from the data and from planted spans. A proposal is positive where a checksum, a range or a naming key
proves it, negative where the check fails; one that nothing can prove (most spelt addresses, numbers without a plus
sign, unnamed tokens) does not teach. Positives are also shown rewritten (no plus sign, spelt-out signs) and with their
proof hidden. Besides, each document that teaches gets one made-up personal span and one look-alike that is none
(year ranges, serial numbers, failed checksums, long words), of all kinds in turn, so that kinds which a corpus
hardly holds are learnt in its own surroundings. Thresholds are set on documents that the trees did not see.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sedge.llm.boosting import BoostedTrees
from sedge.llm.sampling import bounded_sample, id_and_text
from sedge.workspace import small_batches

#: Documents whose proposals teach at most, and proposals used of them at most.
SAMPLE, PROPOSALS, SEED = 4000, 20_000, 7
PRECISION = 0.98
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "id")

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A part is matched whole: after a shorter one the next character is a digit, never the dot that must follow.
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digits = re.compile(r"[0-9]")
_bare_phone = re.compile(r"(?<![\w+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])")
_plus_phone = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")
_card_part = re.compile(r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])")
_spelt = re.compile(r"[A-Za-z0-9._%+-]{2,40}\s?(?:\(at\)|\[at\]|\{at\}|\sat\s)\s?[A-Za-z0-9-]{2,40}(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\.|\sdot\s)\s?[A-Za-z0-9-]{2,20}){1,3}")
_number = re.compile(r"(?<![\w-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![\w-])")
_named = re.compile(r"(?i)\b(pass(?:word|wd)?|pwd|token|secret|api[_-]?key|access[_-]?key|key)\b\s?[=:]\s?[\"']?([A-Za-z0-9+/_-]{8,})")
_key = re.compile(r"(?<![A-Za-z0-9+/_-])(?:AKIA[A-Z0-9]{16}|[A-Za-z0-9+/_-]{20,}+)(?![A-Za-z0-9+/_-])")
_named_by_form = re.compile(r"(?<![A-Za-z0-9+/_-])AKIA[A-Z0-9]{16}(?![A-Za-z0-9+/_-])")
_names = re.compile(r"(?i)(pass|pwd|token|secret|key|card|tel|phone|call|mail|contact|ssn|iban|account|ip|host|addr)")

_named_mail = re.compile(r"(?i)\b(?:e-?mail|mail(?: ?to)?|contact)\W{1,3}$")
_named_phone = re.compile(r"(?i)\b(?:tel(?:ephone)?|phone|mobile|fax|call)\W{1,3}$")
_named_id = re.compile(r"(?i)\b(?:ssn|social security(?: number)?|iban|account|id)\W{1,3}$")
_country = re.compile(r"\+[0-9]{1,3}[ .-]?$")
_at_signs = (" at ", "(at)", "[at]", "{at}", "at\n", "\nat", "at\t", "\tat", "at\r", "\rat")


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[-1::-2]]
    even = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the base pattern: around each sign, the longest run before it that no match has taken."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def proves(kind: str, span: str) -> bool:
    """Whether a span of a base kind passes its check."""
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split(".") if len(p) < 20) and all(len(p.lstrip("0")) <= 3 for p in span.split("."))
    if kind == "card":
        d = _only_digits(span)
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(_only_digits(span)) <= 15
    return True


def base_matches(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, passes) of every leftmost match of the four base patterns."""
    found = [(s, e, "email", True) for s, e in _emails(text)] if "@" in text else []
    if _digits.search(text):
        for kind, pattern in (("ip", _ip), ("card", _card)) if "." in text else (("card", _card),):
            found += [(m.start(), m.end(), kind, proves(kind, m[0])) for m in pattern.finditer(text)]
        if "+" in text:
            found += [(m.start(), m.end(), "phone", proves("phone", m[0])) for m in _phone.finditer(text)]
    return found


def ordered(spans: list[tuple]) -> str:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(((s, e, k) for s, e, k, *_ in spans), key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def proposals(text: str, base: list[tuple[int, int, str, bool]]) -> list[tuple[int, int, str]]:
    """Spans that the trees are to judge: (start, end, kind), possibly overlapping."""
    out: set[tuple[int, int, str]] = set()
    for s, e, kind, ok in base:
        if kind == "card" and not ok and e - s < 7:
            continue
        out.add((s, e, kind))
        if not ok and kind in ("card", "phone"):
            near, until = max(0, s - 1), min(len(text), e + 1)
            for pattern, of in ((_card_part, "card"), (_plus_phone, "phone")):
                out |= {(m.start(), m.end(), of) for m in pattern.finditer(text, near, until)}
    if any(sign in text for sign in _at_signs):
        out |= {(m.start(), m.end(), "email") for m in _spelt.finditer(text) if re.search(r"dot|\.", m[0])}
    if any(e - s >= 2 for s, e, k, _ in base if k == "card"):
        out |= {(m.start(), m.end(), "phone") for m in _bare_phone.finditer(text)}
        out |= {(m.start(), m.end(), "id") for m in _number.finditer(text)}
    if "=" in text or ":" in text:
        out |= {(*m.span(2), "secret") for m in _named.finditer(text)}
    if "AKIA" in text:
        out |= {(k.start(), k.end(), "secret") for k in _named_by_form.finditer(text)}
    if _digits.search(text):
        # Tokens around digits only: another key without a digit is a word.
        at = 0
        while m := _digits.search(text, at):
            start = max(text.rfind(" ", 0, m.start()), text.rfind("\n", 0, m.start())) + 1
            ends = [x for x in (text.find(" ", m.start()), text.find("\n", m.start())) if x >= 0]
            end = min(ends, default=len(text))
            at = end + 1
            if end - start >= 16:
                out |= {(k.start(), k.end(), "secret") for k in _key.finditer(text, start, end)}
    return sorted(out)


FEATURES = 24
_lettered = str.maketrans("0123456789", "abcdefghij")


def _sign(span: str) -> float:
    """How an address is written: 1 with its sign, 0 as a sentence that ends, else 2 plain or 4 bracketed, 1 more with spelt dots."""
    if "@" in span:
        return 1.0
    if re.search(r"\.\s|\s\.", span):
        return 0.0
    return (4.0 if re.search(r"[(\[{]at[)\]}]", span) else 2.0) + bool(re.search(r"[(\[{]dot[)\]}]|\sdot\s", span))


def describe(text: str, start: int, end: int, kind: str, hide: bool = False) -> list[float]:
    """Format and context of a proposal. hide: without its proof (checksum, range, naming key, plus sign)."""
    span = text[start:end]
    n = len(span)
    digits = _only_digits(span)
    counts = Counter(span).values()
    before, after = text[max(0, start - 24) : start], text[end : end + 12]
    letters = sum(c.isalpha() for c in span)
    edge = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in "=:\"'" else 5
    parts = [p for p in re.split(r"[^0-9]+", span) if p]
    proof = [
        float(proves(kind, span)) if kind == "card" else float(proves_id(span)) if kind == "id" else -1.0,
        float(all(len(p) <= 3 and int(p) <= 255 for p in parts)) if kind == "ip" else -1.0,
        float(bool(re.search(r"[=:]\s?[\"']?$", before))),
        float(span[0] == "+"),
    ]
    return [
        float(KINDS.index(kind)), float(n), float(len(digits)), len(digits) / n, letters / n, sum(c.isupper() for c in span) / n,
        float(sum(not c.isalnum() for c in span)), float(len(parts)), float(max(map(len, parts), default=0)), float(min(map(len, parts), default=0)),
        -sum(c / n * math.log2(c / n) for c in counts), _sign(span) if kind == "email" else 0.0, float(span.count(".")), float("(" in span), float(span.count("-")), float(" " in span),
        float(edge(before[-1:])), float(edge(after[:1])), float(bool(_names.search(before))), float(sum(c.isdigit() for c in before)),
        *([-1.0, -1.0, 0.0, 0.0] if hide else proof),
    ]


def iban(span: str) -> bool:
    """Whether an account number's check digits fit (mod 97)."""
    plain = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def proves_id(span: str) -> bool:
    """Check digits of an account number; areas, groups and serials that identity numbers are given out with."""
    if span[0].isalpha():
        return iban(span)
    area, group, serial = span.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def label(text: str, start: int, end: int, kind: str) -> int | None:
    """1 where a check or a naming key proves a proposal, 0 where the check fails, None where nothing can tell."""
    span, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 2]
    if kind == "email" and "@" not in span:
        if _named_mail.search(before):
            return 1
        # White space beside a plain dot ends a sentence, not a label of an address.
        return 0 if re.search(r"\.\s|\s\.", span) else None
    if kind == "phone" and span[0] != "+":
        if _country.search(before):
            return None  # the rest of a number with its plus sign
        if re.match(r"[ .-]?[0-9]", after) or re.search(r"[0-9][ .-]?$", before):
            return 0  # a part of a longer number
        return 1 if _named_phone.search(before) else None
    if kind in BASE:
        return int(proves(kind, span))
    if kind == "id":
        return int(proves_id(span) or bool(_named_id.search(before)))
    return 1 if span.startswith("AKIA") and len(span) == 20 or re.search(r"(?i)(pass\w*|pwd|token|secret|key)\s?[=:]\s?[\"']?$", before) else None


_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_UPPER = _LOWER.upper()


def made_up(rng: random.Random, personal: bool) -> tuple[str, str, str]:
    """(what stands before it, span, kind) of a personal span, or of a look-alike that is none."""
    some = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    digits = lambda *sizes: [some(_DIGITS, n, n) for n in sizes]
    kind = rng.choice(("email", "card", "phone", "secret", "secret", "id"))
    if kind == "email" and personal:
        at, dot = rng.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("{at}", "{dot}"), (" (at) ", "."), ("[at]", ".")))
        name = some(_LOWER, 3, 9) + rng.choice(("", "." + some(_LOWER, 3, 8), some(_DIGITS, 1, 3)))
        return rng.choice(("", "mail ", "write to ")), f"{name}{at}{some(_LOWER, 4, 10)}{dot}{rng.choice(('com', 'org', 'net', 'de', 'fr'))}", kind
    if kind == "email":
        return "", f"{some(_LOWER, 3, 8)} at {some(_LOWER, 3, 9)}. {some(_LOWER, 3, 8)}", kind
    if kind == "card":
        body = rng.choice("3456") + some(_DIGITS, 14, 14)
        last = next(c for c in _DIGITS if luhn(body + c) == personal)
        d = body + last
        return rng.choice(("", "card ", f"{some(_DIGITS, 4, 7)} ")), rng.choice(("", " ", "-")).join(d[i : i + 4] for i in range(0, 16, 4)) if rng.random() < 0.5 else d, kind
    if kind == "phone" and personal:
        a, b, c = f"{rng.randint(200, 999)}", *digits(3, 4)
        return rng.choice(("", "tel ", "call ", "phone: ")), rng.choice((f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}")), kind
    if kind == "phone":
        year = rng.randint(1900, 2030)
        return rng.choice(("", "in ", "years ")), rng.choice((f"{year}-{year + 1} {some(_DIGITS, 4, 4)}", f"{year} {year + 1} {year + 2}", f"{some(_DIGITS, 2, 2)} {some(_DIGITS, 3, 3)} {some(_DIGITS, 3, 3)}")), kind
    if kind == "secret" and personal:
        if rng.random() < 0.25:
            return rng.choice(("", "id ", "key ")), "AKIA" + some(rng.choice((_UPPER, _UPPER + _DIGITS)), 16, 16), kind
        name = rng.choice(("password", "passwd", "pwd", "token", "secret", "api_key", "api-key", "access_key", "Password", "TOKEN"))
        return name + rng.choice(("=", ": ", " = ", ' = "', "='", ":")), some(rng.choice((_LOWER + _DIGITS, _LOWER + _UPPER + _DIGITS, "abcdef" + _DIGITS, _LOWER)), 8, 40), kind
    if kind == "secret":
        word = lambda: some(_LOWER, 3, 9)
        return rng.choice(("", "see ", "file ")), rng.choice((f"{word()}-{word()}-{word()}-{rng.randint(1, 99)}-{word()}", f"/{word()}/{word()}/{rng.randint(1990, 2030)}/{word()}/{word()}", some(_LOWER, 20, 40) + "2", f"{word()}_{rng.randint(2000, 2030)}_{word()}_{word()}_{word()}")), kind
    if rng.random() < 0.5:
        area = f"{rng.randint(1, 665):03d}" if personal else rng.choice(("000", "666", f"{rng.randint(900, 999)}"))
        area = "123" if area == "000" and personal else area
        return rng.choice(("", "ssn ", "number ")), f"{area}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", kind
    country, body = rng.choice(("DE", "GB", "FR", "ES", "NL")), some(_DIGITS, 18, 18)
    good = next(c for c in range(2, 99) if iban(f"{country}{c:02d}{body}"))
    plain = f"{country}{good if personal else (good + rng.randint(1, 50) - 2) % 97 + 2:02d}{body}"
    return rng.choice(("", "iban ", "account ")), plain if rng.random() < 0.5 else " ".join(plain[i : i + 4] for i in range(0, len(plain), 4)), kind


def planted(text: str, rng: random.Random, personal: bool) -> tuple[str, int, int, str]:
    """A text with a made-up span between two of its words, and the span."""
    gaps = [m.start() for m in re.finditer(r"\s", text)]
    at = rng.choice(gaps) if gaps else len(text)
    before, span, kind = made_up(rng, personal)
    start = at + 1 + len(before)
    return f"{text[:at]} {before}{span}{rng.choice((' ', '. ', ', ', chr(10)))}{text[at:]}", start, start + len(span), kind


def rewritten(text: str, start: int, end: int, kind: str, turn: int) -> tuple[str, int, int] | None:
    """The same span written another way in its surroundings, for the trees to learn from."""
    span = text[start:end]
    if kind == "email":
        # A plain "at" with a plain dot is also how prose names a site, so it is not taught.
        span = span.replace("@", (" (at) ", "[at]", " at ", "{at}")[turn % 4])
        span = span.replace(".", (" (dot) ", "[dot]", " dot ", "{dot}")[turn % 4]) if turn % 4 == 2 or turn // 4 % 2 else span
        span = span.translate(_lettered) if turn // 8 % 2 else span  # names without digits, as prose has them
    elif kind == "phone" and span[0] == "+":
        span = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", span)
        span = span.replace("(", "").replace(")", "").replace(" ", "-") if turn % 2 else span
    elif kind == "card":
        d = _only_digits(span)
        span = (" " if turn % 2 else "-").join(d[i : i + 4] for i in range(0, len(d), 4))
    else:
        return None
    return text[:start] + span + text[end:], start, start + len(span)


class Taken:
    """Places that spans cover, as intervals that lie apart; a line may hold thousands."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, start: int, end: int) -> bool:
        at = bisect_right(self.ends, start)
        return at == len(self.ends) or self.starts[at] >= end

    def add(self, start: int, end: int) -> None:
        at = bisect_right(self.ends, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


@dataclass
class PrivacyModel:
    trees: BoostedTrees | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def added(self, text: str, base: list[tuple[int, int, str, bool]]) -> list[tuple[int, int, str]]:
        """Proposals over their kind's threshold that touch no passing base span, the surest first."""
        taken = Taken([(s, e) for s, e, _, ok in base if ok])
        passing = {(s, e, k) for s, e, k, ok in base if ok}
        if self.trees is None:
            return []
        asked = [p for p in proposals(text, base) if p not in passing and taken.free(*p[:2])]
        if not asked:
            return []
        scores = self.trees.predict(np.array([describe(text, *p) for p in asked]))
        out = []
        for score, p in sorted(zip(scores, asked, strict=True), key=lambda x: (-x[0], x[1])):
            if score >= self.thresholds.get(p[2], 2.0) and taken.free(*p[:2]):
                out.append(p)
                taken.add(*p[:2])
        return out

    def spans(self, text: str | None) -> tuple[list[tuple], list[tuple]]:
        """(passing base spans, added spans) of a whole text; null is empty."""
        if not text:
            return [], []
        base = base_matches(text)
        return [b for b in base if b[3]], self.added(text, base)


def bar(scores: np.ndarray, y: np.ndarray) -> float:
    """Halfway between the lowest score from which on proposals are precise enough and the next lower one: 0.5 at least."""
    good = [c for c in np.unique(np.floor(scores * 1000) / 1000) if c >= 0.5 and y[scores >= c].mean() >= PRECISION]
    if not good:
        return 0.98
    return float(max(0.5, (good[0] + max(scores[scores < good[0]], default=0.0)) / 2))


def train(examples: list[tuple[str, list[float], int, int]]) -> PrivacyModel:
    """examples: (kind, features, label, document) in a fixed order; three documents in ten only set thresholds."""
    y = np.array([e[2] for e in examples])
    if len(y) < 40 or y.min() == y.max():
        return PrivacyModel()
    x = np.array([e[1] for e in examples])
    docs, place = np.unique([e[3] for e in examples], return_inverse=True)
    fit = (np.random.default_rng(SEED).random(len(docs)) < 0.7)[place]
    if y[fit].min() == y[fit].max() or not (~fit).any():
        return PrivacyModel()
    trees = BoostedTrees().fit(x[fit], y[fit])
    scores = trees.predict(x[~fit])
    thresholds = {}
    for kind in KINDS:
        own = np.array([e[0] == kind for e in examples])[~fit]
        s, t = scores[own], y[~fit][own]
        # Where a kind has too few examples of its own, the bar is what all kinds need.
        thresholds[kind] = bar(s, t) if t.sum() >= 5 else bar(scores, y[~fit])
    return PrivacyModel(trees, thresholds)


def fit_privacy(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> PrivacyModel:
    """Learn from the proposals of a bounded sample of documents; they are described where the texts lie.

    Ids are integers. Null texts and rows without an id do not teach; a repeated row may teach twice; with too few
    proposals (an empty table) the model adds nothing to the base spans. Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def teach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["_id"], batch["_text"], strict=True):
                turn = int(doc)
                for s, e, kind in proposals(text, base_matches(text)):
                    y = label(text, s, e, kind)
                    if y is None:
                        continue
                    rows.append((turn, kind, describe(text, s, e, kind), y))
                    if y or kind in ("card", "ip"):
                        rows.append((turn, kind, describe(text, s, e, kind, True), y))
                    if y and (other := rewritten(text, s, e, kind, turn)):
                        rows.append((turn, kind, describe(*other, kind), y))
                for personal in (True, False):
                    other, s, e, kind = planted(text, random.Random(2 * turn + personal), personal)
                    near = other[max(0, s - 200) : e + 200]  # what describe() looks at
                    shift = max(0, s - 200)
                    # A look-alike teaches by what the generators make of it, a personal span by itself.
                    seen = [p for p in proposals(near, base_matches(near)) if p[0] < e - shift and s - shift < p[1]]
                    for p in seen if not personal else [p for p in seen if p == (s - shift, e - shift, kind)]:
                        rows.append((turn, p[2], describe(near, *p), int(personal)))
            yield pd.DataFrame([(t, k, *r) for k, (t, *r) in enumerate(rows)], columns=["turn", "place", "kind", "x", "y"])

    chosen = bounded_sample(docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()), sample, id_col)
    told = chosen.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInPandas(teach, "turn long, place int, kind string, x array<double>, y int")
    rows = sorted(told.orderBy(F.xxhash64("turn", "place"), "turn", "place").limit(PROPOSALS).collect())
    return train([(r[2], list(r[3]), r[4], r[0]) for r in rows])


def find_personal_data(docs: DataFrame, model: PrivacyModel, redact: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, all spans, and the redacted text if asked for.

    Positions count code points, the end is exclusive. Redacted spans become [KIND]; where spans overlap, all that they
    cover goes. A null text is empty. Other columns are ignored, whatever their names; rows without an id are left out, a
    repeated row is answered again, an empty table gives no row.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few dozen small trees
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string" + ", redacted string" * redact

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            rows = []
            for text in batch["_text"]:
                base, added = own.spans(text)
                row = [sum(b[2] == k for b in base) for k in BASE]
                row += [hashlib.sha256(ordered(base).encode()).hexdigest(), ordered([*base, *added])]
                rows.append([*row, redacted(text, [*base, *added])] if redact else row)
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in BASE), "base_sha256", "spans", *["redacted"] * redact])
            out.insert(0, id_col, batch["_id"].to_numpy())
            yield out

    return id_and_text(docs, id_col, text_col).mapInPandas(find, schema)


def redact_documents(docs: DataFrame, model: PrivacyModel, text_col: str = "text") -> DataFrame:
    """The documents with every span found replaced by [KIND], and all their other columns; null texts stay null."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in batches:
            yield pd.Series([redacted(t, [s for part in own.spans(t) for s in part]) for t in batch], dtype=object)

    return docs.withColumn(text_col, redact(F.col(text_col)))


def redacted(text: str | None, spans: list[tuple]) -> str | None:
    if not text or not spans:
        return text
    out, at = [], 0
    for s, e, kind, *_ in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_personal_data(docs, fit_privacy(docs))
