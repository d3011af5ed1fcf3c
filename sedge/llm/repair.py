"""Repair of the order of conversations: rank-convergence Viterbi over chunks, least audits from stitched backward costs.

A conversation is to read as an optional system turn followed by pairs of user and assistant turns. Rows may be kept,
given another role or deleted, and empty turns inserted, at costs; the cheapest edits are wanted, and of equally cheap
ones those whose initials come first.

Rows are range-partitioned by conversation and turn and read in order, so a long conversation lies over many
partitions. It is cut into chunks of bounded size. The costs of finishing from each of the four states of the grammar
are a vector; a chunk runs backward from the vector at its end:

1. Every chunk starts from a speculative vector: that of a conversation's end.
2. Fix-up passes: a chunk is run again from the vector that its successor now begins with, until, row for row, the
   vector differs from the earlier run's by a constant only; from there on back the two runs agree, and so does the
   chunk's own beginning. Passes go on until no beginning changes; mostly one is enough.
3. The stitched backward costs tell which edits lie on cheapest ways. A forward trace takes the least initial
   among them at every step; an edit's initial determines the state it leads to, so no tie is left. Chunks are traced
   from each possible state, which is chained by chunk, then from the one that is right.

What a row means to the grammar is one byte, so passes read no texts. Conversations that lie within one partition and
one chunk are finished where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sedge.workspace import HOT_SHARE, Scratch

#: Costs (fixed values of the task).
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and characters of a chunk, but for a longer row.
CHUNK_ROWS, CHUNK_CHARS = 1 << 15, 1 << 22
#: States: nothing yet, after system, after user, after assistant; and what an inserted or renamed turn leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
_TURN_AFTER = (USER, USER, ASSISTANT, USER)
_NAME = {USER: "user", ASSISTANT: "assistant"}
#: Vectors at the end of a conversation: finished in the first and last state, else turns are inserted.
END = (0, 2 * INSERT, INSERT, 0)
#: Faults of a row, in the order in which they count; kinds of roles.
SOUND, BLANK, DUPLICATE, CUT = range(4)
_KIND = {"s": 0, "u": 1, "a": 2}
_KEEPS = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
SPACE = " \t\n\x0b\x0c\r"


def _moves(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, next state, cost) of what may become of a row, in order of initials."""
    kind, fault = divmod(code, 4)
    extra = TRUNCATED if fault == CUT else 0
    yield "D", state, DELETE
    if fault in (SOUND, CUT):
        if state in _KEEPS[kind]:
            yield "K", _KEEPS[kind][state], extra
        yield "R", _TURN_AFTER[state], REROLE + extra


class Steps:
    """One row's effect on vectors and traces; vectors are few up to constants, so each case is worked out once."""

    def __init__(self):
        self.back: dict[tuple, tuple[tuple, int]] = {}
        self.forth: dict[tuple, tuple[str, int, int]] = {}

    def full(self, after: tuple, code: int) -> tuple:
        rows = [min(cost + after[to] for _, to, cost in _moves(code, state)) for state in range(4)]
        return tuple(min(rows[state], INSERT + rows[_TURN_AFTER[state]]) for state in range(4))

    def before(self, after: tuple, code: int) -> tuple:
        """The vector before a row, without its constant."""
        if (key := (after, code)) not in self.back:
            v = self.full(after, code)
            self.back[key] = tuple(x - min(v) for x in v)
        return self.back[key]

    def edits(self, after: tuple, code: int, state: int) -> tuple[str, int, int]:
        """(initials, next state, cost): the least edits of a row among the cheapest, inserted turns before it included."""
        if (key := (after, code, state)) not in self.forth:
            v, said, cost = self.full(after, code), "", 0
            while True:
                # D comes before I, and I before K and R.
                ways = [(name, to, c) for name, to, c in _moves(code, state) if c + after[to] == v[state]]
                if INSERT + v[_TURN_AFTER[state]] == v[state] and not (ways and ways[0][0] == "D"):
                    said, cost, state = said + "I", cost + INSERT, _TURN_AFTER[state]
                    continue
                name, to, c = ways[0]
                self.forth[key] = said + name, to, cost + c
                break
        return self.forth[key]


def vectors(steps: Steps, codes: bytes, end: tuple) -> list[tuple]:
    """The vector after each row, from the first to the last, and at place -1 the one given; all without constants."""
    out, v = [], end
    for code in reversed(codes):
        out.append(v)
        v = steps.before(v, code)
    out.append(v)
    return out[::-1]


def traced(steps: Steps, codes: bytes, after: list[tuple], state: int, last: bool) -> tuple[list[str], list[int], int]:
    """(initials of each row and of the end, states before each edit's turn, cost) from a state on. after: vectors()."""
    said, states, total = [], [state], 0
    for k, code in enumerate(codes):
        name, state, cost = steps.edits(after[k + 1], code, state)
        said.append(name)
        states.append(state)
        total += cost
    if last:
        n = END[state] // INSERT
        said.append("I" * n)
        total += END[state]
    return said, states, total


def repaired_turns(roles: list[str], texts: list[str], said: list[str], state: int) -> list[str]:
    """role:text of the turns that the edits leave, inserted ones with empty texts."""
    out: list[str] = []
    for k, names in enumerate(said):
        for name in names:
            if name == "I":
                state = _TURN_AFTER[state]
                out.append(f"{_NAME[state]}:")
            elif name == "R":
                state = _TURN_AFTER[state]
                out.append(f"{_NAME[state]}:{texts[k]}")
            elif name == "K":
                state = _KEEPS[_KIND[roles[k][:1]]][state]
                out.append(f"{roles[k]}:{texts[k]}")
    return out


#: key: the conversation as text; seq: order of chunks. whole: finished where it was read. start: the vector that a chunk begins with.
#: low, high, turns: least, greatest and number of different turns.
_CHUNK = """key string, seq long, whole boolean, codes binary, start array<int>, rows long, blank long, duplicate long, truncated long, illegal long,
first string, last string, low long, high long, turns long, audit string, cost long, repaired string, n_kept long, roles array<string>, texts array<string>"""


def _legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


class _Chunk:
    """Rows of one conversation as they come."""

    def __init__(self, key: str, first: bool):
        self.key, self.first, self.chars = key, first, 0
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.codes = bytearray()
        self.given: list[int | None] = []  # distinct turns in order

    def add(self, role: str, text: str, turn: int | None, copies: int, seen: bool) -> None:
        body = text.strip(SPACE)
        fault = BLANK if not body else DUPLICATE if seen else SOUND if body[-1] in ".!?" else CUT
        kind = 4 * _KIND.get(role[:1], 3)
        again = BLANK if fault == BLANK else DUPLICATE
        self.codes += bytes([kind + fault]) + bytes([kind + again]) * (copies - 1)
        # A copy is deleted in any case; its text is not needed.
        self.roles += [role] * copies
        self.texts += [text] + [""] * (copies - 1)
        self.chars += len(text)
        if not self.given or self.given[-1] != turn:
            self.given.append(turn)

    def row(self, seq: int, steps: Steps, whole: bool) -> dict:
        codes, turns = bytes(self.codes), [t for t in self.given if t is not None]
        initials = [r[:1] for r in self.roles]
        faults = [c % 4 for c in codes]
        after = vectors(steps, codes, END)
        out = {
            "key": self.key, "seq": seq, "whole": whole, "codes": codes, "start": list(after[0]), "rows": len(codes), "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
            "illegal": sum(not _legal(x + y) for x, y in zip(initials, initials[1:], strict=False)), "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(turns), "audit": None, "cost": None, "repaired": None, "n_kept": None, "roles": None, "texts": None,
        }
        if whole:
            return out | _finished(steps, codes, self.roles, self.texts, after, START, True)
        return out | {"roles": self.roles, "texts": self.texts}


def _finished(steps: Steps, codes: bytes, roles: list[str], texts: list[str], after: list[tuple], state: int, last: bool) -> dict:
    said, _, cost = traced(steps, codes, after, state, last)
    left = repaired_turns(roles, texts, said, state)
    return {"audit": "".join(said), "cost": cost, "repaired": "\n".join(left), "n_kept": len(left), "roles": None, "texts": None}


def _as_batches(rows: Iterator[dict], schema: pa.Schema, chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += 200 + len(row.get("repaired") or "") + sum(map(len, row.get("texts") or ()))
        if size > chars:
            yield pa.RecordBatch.from_pylist(some, schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def chunks_of(rows: DataFrame, chunk_rows: int, chunk_chars: int) -> DataFrame:
    """rows: (key, turn, role, text, n, seen), sorted within range partitions. A row for each chunk."""
    schema = _arrow(_CHUNK)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, steps = TaskContext.get().partitionId() << 40, Steps()

        def made() -> Iterator[dict]:
            n, here = 0, None
            for batch in batches:
                for key, turn, role, text, copies, seen in zip(*(batch.column(c).to_pylist() for c in ("key", "turn", "role", "text", "n", "seen")), strict=True):
                    if here is not None and (key != here.key or len(here.codes) >= chunk_rows or here.chars >= chunk_chars):
                        fresh = key != here.key
                        # The partition's first conversation may have begun in an earlier one.
                        yield here.row(base + n, steps, fresh and here.first and n > 0)
                        n, here = n + 1, _Chunk(key, fresh)
                    here = here or _Chunk(key, True)
                    while copies > chunk_rows:  # many copies of a row
                        here.add(role, text, turn, chunk_rows, seen)
                        yield here.row(base + n, steps, False)
                        n, here, copies, seen = n + 1, _Chunk(key, False), copies - chunk_rows, True
                    if copies:
                        here.add(role, text, turn, copies, seen)
            if here is not None:  # may go on in the next partition
                yield here.row(base + n, steps, False)

        yield from _as_batches(made(), schema)

    return rows.mapInArrow(cut, _CHUNK)


def _key(conv: Column) -> Column:
    """The conversation as text; null is one of its own."""
    return F.coalesce(F.concat(F.lit("c"), conv.cast("string")), F.lit(""))


def repaired_chunks(spark: SparkSession, rows: DataFrame, scratch: Scratch, chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Chunks of conversations with their counts, audits, costs and repaired turns, in order of seq within a key.

    rows: conv_id, turn (long), role, text (not null), n: how often the row stands there; rows with n = 0 only name a
    conversation. Rows of one turn are taken in order of role, then text.
    """
    print_ = F.sha2(F.concat_ws("\x01", "key", F.length("role").cast("string"), "role", "text"), 256)
    told = rows.select(_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"), "role", "text", F.col("n").cast("long").alias("n"))
    # Equal rows of one turn become one, with their number, where they lie.
    copies = scratch.keep(told.groupBy("key", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("print", print_), "copies")
    # The first turn of what is said more than once in a conversation; nulls come first.
    when = F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"))
    seen = copies.where("n > 0").groupBy("print").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    seen = scratch.keep(seen, "seen")
    # Fewer than a thousand texts are hot: they are broadcast, and their rows spread over the other join, where nothing meets them.
    hot = F.col("times") > copies.count() / HOT_SHARE
    half = copies.join(F.broadcast(seen.where(hot).select("print", F.col("first").alias("hot_first"))), "print", "left")
    half = half.withColumn("mark", F.when(F.col("hot_first").isNull(), F.col("print")).otherwise(F.sha2(F.concat_ws(",", "print", "turn"), 256)))
    met = half.join(seen.where(~hot).select(F.col("print").alias("mark"), "first").hint("merge"), "mark", "left")
    marked = met.select("key", "turn", "role", "text", "n", F.coalesce(when > F.coalesce("hot_first", "first"), F.lit(False)).alias("seen"))
    order = ["key", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = scratch.keep(chunks_of(dealt, chunk_rows, chunk_chars), "chunks", sweep=True)
    return chunks.where("whole").unionByName(stitched(chunks.where("not whole"), scratch))


def stitched(open_: DataFrame, scratch: Scratch) -> DataFrame:
    """Chunks of conversations that lie in several: fix-up passes, chained states, traces. Vectors and states have a row a chunk."""
    order = W.partitionBy("key").orderBy("seq")
    bound = open_.select("key", "seq", "codes", F.array(*map(F.lit, END)).cast("array<int>").alias("end"), "start", F.lit(False).alias("moved"))
    state = scratch.keep(bound, "vectors")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                given = tuple(row.pop("next"))
                new, old = given, tuple(row["end"])
                for code in reversed(row["codes"]):
                    if new == old:
                        break  # equal but for a constant, so the earlier run holds from here on back
                    new, old = steps.before(new, code), steps.before(old, code)
                begin = row["start"] if new == old else list(new)
                row |= {"end": list(given), "moved": begin != row["start"], "start": begin}
            yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "key string, seq long, codes binary, end array<int>, start array<int>, moved boolean"
    schema = _arrow(ddl)
    while True:
        # Only what a chunk begins with goes to its neighbour.
        begins = state.select("key", "seq", F.coalesce(F.lead("start").over(order), F.array(*map(F.lit, END)).cast("array<int>")).alias("next"))
        run = state.join(begins.hint("merge"), ["key", "seq"])
        after = scratch.keep(run.select("key", "seq", "codes", "end", "start", "moved", "next").mapInArrow(again, ddl), "vectors")
        scratch.drop(state)
        state = after
        if state.where("moved").isEmpty():
            break

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        for batch in batches:
            out = []
            for key, seq, codes, end in zip(*(batch.column(c).to_pylist() for c in ("key", "seq", "codes", "end")), strict=True):
                after = vectors(steps, codes, tuple(end))
                now = list(range(4))
                for k, code in enumerate(codes):
                    now = [steps.edits(after[k + 1], code, s)[1] for s in now]
                out.append({"key": key, "seq": seq, "to": now})
            yield pa.RecordBatch.from_pylist(out, to_schema)

    to_schema = _arrow("key string, seq long, to array<int>")
    led = state.select("key", "seq", "codes", "end").mapInArrow(ends, "key string, seq long, to array<int>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        state, out = START, []
        for to in pdf["to"]:
            out.append(state)
            state = int(to[state])
        return pd.DataFrame({"key": pdf["key"], "seq": pdf["seq"], "state": out, "is_last": [k == len(out) - 1 for k in range(len(out))]})

    states = led.groupBy("key").applyInPandas(chain, "key string, seq long, state int, is_last boolean")
    known = state.select("key", "seq", "end").join(states.hint("merge"), ["key", "seq"])
    told = open_.join(known.hint("merge"), ["key", "seq"])
    full = _arrow(_CHUNK)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()

        def made() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_pylist():
                    end, state, last = tuple(row.pop("end")), row.pop("state"), row.pop("is_last")
                    after = vectors(steps, row["codes"], end)
                    yield row | _finished(steps, row["codes"], row["roles"], row["texts"], after, state, last)

        yield from _as_batches(made(), full)

    columns = [f.name for f in full]
    return told.select(*columns, "end", "state", "is_last").mapInArrow(finish, _CHUNK)


_DIGEST = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digest(chunks: DataFrame) -> DataFrame:
    """One row a conversation. Chunks of those that lie in several are read in order, one at a time: their digest goes over all turns."""
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    one = chunks.where("whole").select("key", gaps.alias("gaps"), *counts, F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"))
    wanted = ["key", "seq", *(c for c in counts), "first", "last", "low", "high", "turns", "repaired", "n_kept"]
    schema = _arrow(_DIGEST)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def closed() -> pa.RecordBatch:
            gap = now["high"] - now["low"] + 1 - now["turns"] if now["low"] is not None else 0
            row = {"key": now["key"], "gaps": gap, "audit": "".join(now["audit"]), "repaired_sha256": now["sha"].hexdigest()}
            return pa.RecordBatch.from_pylist([row | {c: now[c] for c in counts if c != "audit"}], schema)

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now["key"] != row["key"]:
                    if now is not None:
                        yield closed()
                    now = {"key": row["key"], "sha": hashlib.sha256(), "any": False, "audit": [], "last": None, "low": None, "high": None, "turns": 0} | {c: 0 for c in counts if c != "audit"}
                for c in counts[:-1]:
                    now[c] += row[c]
                now["audit"].append(row["audit"])
                if now["last"] is not None and row["first"] is not None:
                    now["illegal"] += not _legal(now["last"] + row["first"])
                now["last"] = row["last"] if row["last"] is not None else now["last"]
                if row["low"] is not None:
                    now["turns"] += row["turns"] - (now["high"] == row["low"])
                    now["low"] = row["low"] if now["low"] is None else now["low"]
                    now["high"] = row["high"]
                if row["n_kept"]:
                    now["sha"].update((("\n" if now["any"] else "") + row["repaired"]).encode("utf-8", "surrogatepass"))
                    now["any"] = True
        if now is not None:
            yield closed()

    several = chunks.where("not whole").select(*wanted).repartition("key").sortWithinPartitions("key", "seq").mapInArrow(read, _DIGEST)
    return one.unionByName(several)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, n of conversations with faults planted by a hash of conversation and turn; nulls are one space.

    A dropped row stays as one that only names its conversation (n = 0).
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("_h", F.crc32(F.concat(some(conv), F.lit(":"), some(turn))) % 20)
    gone = F.col("_h") == 0
    new_text = F.when(gone | (F.col("_h") == 1), "").when(F.col("_h") == 2, F.regexp_replace(some(text), "[.!?]", "")).otherwise(some(text))
    new_role = F.when(gone, "").when(F.col("_h") == 4, "user").otherwise(some(role))
    n = F.when(gone, 0).when(F.col("_h") == 3, 2).otherwise(1)
    return rows.select(F.col(conv).alias("conv_id"), F.when(~gone, F.col(turn)).cast("long").alias("turn"), new_role.alias("role"), new_text.alias("text"), n.alias("n"))


def repair_conversations(spark: SparkSession, rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", n: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    Rows are taken by turn, nulls first, those of one turn by role, then text; n: a column that says how often a row
    stands there. Null roles and texts count as one space. The rows of a null id are one conversation. One without rows
    that stand gets zeros, an empty audit and the digest of the empty text. Repeated rows are duplicates. Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "repair")
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), some(role).alias("role"), some(text).alias("text"), (F.col(n) if n else F.lit(1)).alias("n"))
    kind = given.schema["conv_id"].dataType
    told = digest(repaired_chunks(spark, given, scratch, chunk_rows, chunk_chars))
    own = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(kind)
    return scratch.answer(told.select(own.alias("conv_id"), *(c for c in told.columns if c != "key")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(spark, damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), n="n")


#: CRC-32 of a text of ASCII characters.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""
_LEAST = "list_sort(list_filter([{0}], lambda x: x IS NOT NULL))[1]"


def _after(state: str, cost: str, initial: str, turn: str | None = None) -> str:
    turns = f"list_prepend({turn}, r.{state}.t)" if turn else f"r.{state}.t"
    return f"{{'c': r.{state}.c + {cost}, 'a': '{initial}' || r.{state}.a, 't': {turns}}}"


def _inserted(state: str, name: str) -> str:
    return f"{{'c': {state}.c + {INSERT}, 'a': 'I' || {state}.a, 't': list_prepend('{name}:', {state}.t)}}"


def _row_best(state: str, kept: dict[str, str], to: str, name: str) -> str:
    """SQL of a row's best way on from a state. kept: where a kept row of a kind leads; to, name: where a renamed one does."""
    fine, extra = "f.fault IN (0, 3)", f"(CASE f.fault WHEN 3 THEN {TRUNCATED} ELSE 0 END)"
    ways = [_after(state, str(DELETE), "D")]
    ways += [f"CASE WHEN {fine} AND f.kind = '{k}' THEN {_after(x, extra, 'K', chr(39).join(('f.role || ', ':', ' || f.text')))} END" for k, x in kept.items()]
    ways.append(f"CASE WHEN {fine} THEN {_after(to, f'{REROLE} + {extra}', 'R', f'{chr(39)}{name}:{chr(39)} || f.text')} END")
    return _LEAST.format(", ".join(ways))


SQL = rf"""
WITH RECURSIVE c AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE h WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, regexp_replace(text, '[ 	-
]+$', '') AS body FROM d),
f AS MATERIALIZED (SELECT *, CASE WHEN body = '' THEN 1 WHEN seen THEN 2 WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault, left(role, 1) AS kind,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM o),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
             count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (earlier || kind NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows FROM f GROUP BY conv_id),
r AS (
    SELECT conv_id, rows + 1 AS i, {{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}} AS b, {{'c': 6, 'a': 'II', 't': ['user:', 'assistant:']}} AS s,
           {{'c': 3, 'a': 'I', 't': ['assistant:']}} AS u, {{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}} AS a FROM n
    UNION ALL
    SELECT conv_id, i, {_LEAST.format(f"b0, {_inserted('u', 'user')}")}, {_LEAST.format(f"s0, {_inserted('u', 'user')}")}, u, a
    FROM (SELECT *, {_LEAST.format(f"u0, {_inserted('a0', 'assistant')}")} AS u, {_LEAST.format(f"a0, {_inserted('u0', 'user')}")} AS a
          FROM (SELECT r.conv_id, f.i, {_row_best("b", {"s": "s", "u": "u"}, "u", "user")} AS b0, {_row_best("s", {"u": "u"}, "u", "user")} AS s0,
                       {_row_best("u", {"a": "a"}, "a", "assistant")} AS u0, {_row_best("a", {"u": "u"}, "u", "user")} AS a0
                FROM r JOIN f ON f.conv_id = r.conv_id AND f.i = r.i - 1)))
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(r.b.c, 0) AS BIGINT) AS cost, coalesce(r.b.a, '') AS audit, sha256(coalesce(array_to_string(r.b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN n USING (conv_id) LEFT JOIN r ON r.conv_id = k.conv_id AND r.i = 1
"""
