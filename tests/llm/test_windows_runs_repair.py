"""Operators 11 to 13 against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib

import pytest

from sedge.llm import contamination, periodic, repair

ODD = ("1 as lang", "'x' as _id", "'y' as _text", "'z' as pattern", "'p' as _print", "1 as n_words")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- contamination ---------------------------------------------------------------------------------------------------


def slow_hits(text, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    words, hit, found = cut(text), set(), set()
    for item, body in items:
        own = cut(body)
        size = min(len(own), window)
        for k in range(len(own) - size + 1 if own else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[k : k + size]:
                    hit |= set(range(at, at + size))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination(spark, block_bytes):
    rng = random.Random(11)
    word = lambda: rng.choice(["a", "B", "cé", "d9", "Ünd", "e"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 11, 14])))) for k in range(8, 30)]
    items += [(100, None), (101, ""), (102, "-- !"), (103, items[0][1]), (104, "A-B,cé"), (None, "e e")]
    some = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(40)]
    docs = [(k, t + rng.choice(["", ".\n" + rng.choice(items[:22])[1].upper()]) + " Ä") for k, t in enumerate(some)]
    docs += [(500, None), (501, ""), (502, " \x00 -"), (3, docs[3][1]), (3, "e"), (None, "e e e"), (503, "e " * 3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *ODD)
    tests = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", *ODD)
    got = contamination.digest(contamination.contaminated_documents(spark, frame, tests, block_bytes=block_bytes)).collect()
    known = [(i, t) for i, t in items if i is not None]
    want = []
    for doc, text in docs:
        if doc is not None:
            n, hit, found = slow_hits(text, known)
            want.append((doc, n, hit, len(found), sha(",".join(found)), hit > 0))
    assert sorted(map(tuple, got)) == sorted(want)


def test_contamination_of_empty_tables(spark):
    docs, items = (spark.createDataFrame([(1, "a b")], f"{c} long, text string") for c in ("doc_id", "item_id"))
    assert contamination.contaminated_documents(spark, docs.where("false"), items).count() == 0
    (row,) = contamination.contaminated_documents(spark, docs, items.where("false")).collect()
    assert (row.n_words, row.hits, row["items"]) == (2, [], [])


# --- periodic runs ---------------------------------------------------------------------------------------------------


def slow_runs(words, least=6, times=4):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - at + q if end > at else 0
            smaller = any(all(words[k] == words[k + d] for k in range(at, at + length - d)) for d in range(1, q))
            if length >= max(least, times * q) and not smaller:
                out.append((at, length, q))
            at = end + 1
    return sorted(out)


def repetitive(rng, letters):
    words = []
    for _ in range(rng.randint(0, 6)):
        base = [rng.choice(letters) for _ in range(rng.randint(1, 7))]
        words += base * rng.randint(1, 7) + base[: rng.randint(0, len(base))]
    return words


@pytest.mark.parametrize(("least", "times"), [(6, 4), (20, 4), (5, 5), (9, 3)])
def test_runs(least, times):
    rng = random.Random(7)
    for k in range(400):
        docs = [[w.encode() for w in repetitive(rng, "abcd"[: 1 + k % 4])] for _ in range(rng.randint(1, 4))]
        assert periodic.runs_of_documents(docs, least, times) == [slow_runs(d, least, times) for d in docs]


def test_periodic_query(spark, tmp_path):
    rng = random.Random(8)
    docs = [(k, "  ".join(repetitive(rng, ["x", "y z", "Q"])) + "\n") for k in range(120)]
    docs += [(200, None), (201, ""), (202, " \t"), (5, docs[5][1]), (None, "a a a a a a a"), (203, "w " * 30000)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *ODD).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text in docs:
        if doc is None:
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = [(0, n, 1)] if doc == 203 else slow_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc, len(runs), *numbers, sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    got = periodic.query(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(empty).count() == 0


# --- conversation repair ---------------------------------------------------------------------------------------------


def all_repairs(rows):
    """(cost, audit, turns) of the cheapest repair, ties to the least audit: all ways over rows and grammar states, from the left."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {}
    heap = [(0, "", 0, "", ())]
    done = []
    # Costs over that of deleting all are never needed.
    most = 4 * len(rows)
    while heap:
        cost, audit, k, shape, turns = heap.pop()
        if cost > most or best.get((k, shape[-1:], bool(shape), cost, audit)):
            continue
        best[(k, shape[-1:], bool(shape), cost, audit)] = True
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", shape):
            done.append((cost, audit, turns))
        after = "a" if shape[-1:] == "u" else "u"
        name = {"u": "user", "a": "assistant"}[after]
        heap.append((cost + 3, audit + "I", k, shape + after, (*turns, f"{name}:")))
        if k < len(rows):
            _, role, text = rows[k]
            heap.append((cost + 4, audit + "D", k + 1, shape, turns))
            if faults[k] in ("", "truncated"):
                more = 3 if faults[k] else 0
                heap.append((cost + 3 + more, audit + "R", k + 1, shape + after, (*turns, f"{name}:{text}")))
                if role[:1] == after or (role[:1] == "s" and not shape):
                    heap.append((cost + more, audit + "K", k + 1, shape + role[:1], (*turns, f"{role}:{text}")))
    cost, audit, turns = min(done)
    pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(rows, rows[1:], strict=False)]
    given = [t for t, *_ in rows if t is not None]
    gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(turns)))


def conversations(rng, n):
    rows = []
    for conv in range(n):
        for _ in range(rng.randint(0, 7)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 5, 8]), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", ""]), rng.choice(["Yes.", "no", "Go!", " \n", "Why? ", "a b", "c"])))
    return rows


@pytest.mark.parametrize("chunk_rows", [1, 2, 3, 1 << 15])
def test_repair(spark, chunk_rows):
    rows = conversations(random.Random(21), 60) + [(None, 1, "user", "Hm."), (None, 2, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n", "'k' as key", "'p' as print")
    want = {}
    for conv in {r[0] for r in rows}:
        own = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        want[conv] = all_repairs(own)
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r.conv_id: tuple(r[c] for c in columns) for r in repair.repair_conversations(spark, frame, chunk_rows=chunk_rows).collect()}
    assert got == want


def test_repair_of_odd_tables(spark):
    shape = "conv_id long, turn long, role string, text string, n long"
    none = repair.repair_conversations(spark, spark.createDataFrame([], shape), n="n")
    assert none.count() == 0
    rows = [(1, None, "", "", 0), (2, 0, "user", "Same.", 5), (2, 1, "assistant", "x" * 200_000 + ".", 1), (3, 4, "assistant", "Alone.", 1)]
    got = {r.conv_id: r for r in repair.repair_conversations(spark, spark.createDataFrame(rows, shape), chunk_rows=2, n="n").collect()}
    assert (got[1].cost, got[1].audit, got[1].repaired_sha256) == (0, "", sha(""))
    assert (got[2].duplicate, got[2].audit, got[2].cost) == (4, "KDDDDK", 16)
    assert (got[3].audit, got[3].repaired_sha256) == ("IK", sha("user:\nassistant:Alone."))


def test_passes_meet_only_constants():
    """A chunk's vectors from any two ends agree, up to a constant, once they agree at one row; the true ones come out."""
    rng = random.Random(3)
    steps = repair.Steps()
    codes = bytes(rng.choice([0, 3, 4, 7, 8, 11, 12, 1, 5, 6]) for _ in range(200))
    whole = repair.vectors(steps, codes, repair.END)
    for cut in range(1, 199, 7):
        part = repair.vectors(steps, codes[:cut], tuple(whole[cut]))
        assert part == whole[: cut + 1]


# --- similar documents: words that differ everywhere -------------------------------------------------------------------


def test_words_of_structure_do_not_collide(spark):
    """A word along the Thue-Morse sequence and its complement agree under any sum of powers modulo 2**64."""
    from sedge.llm import similar

    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [f"one two three four {w} six" for w in (word, other, word)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts, 1)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar.similar_documents(spark, frame).collect()} == {1: 1, 2: 2, 3: 1}
    assert similar.similar_documents(spark, frame.where("false")).count() == 0
