"""Repair of conversation structure: faults of turns and the cheapest edits to alternating roles."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialize

#: Prices of edits by their initial; a kept or reroled turn that is truncated costs TRUNCATED more.
PRICES, TRUNCATED = {"K": 0, "R": 3, "D": 4, "I": 3}, 3
#: Turns and characters that a task holds of one conversation; longer ones are cut into pieces.
PIECE_TURNS, PIECE_CHARS = 4096, 8 << 20
SOME = re.compile(r"[^\x20\x09-\x0D]")
SPACE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after the system turn, after a user's, after an assistant's. Roles of initial s, u and a lead from these states to that one.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
_BASE, _PRIME = 1_000_003, (1 << 61) - 1
#: (cost, node of the audit) of a state; None where no edits lead to it.
Best = tuple[int, int] | None


class Audits:
    """Edit strings as nodes that share their prefixes; node 0 is the empty string.

    A node knows its parent, its last letter, a rolling hash of the whole string and its ancestors
    1, 2, 4, … letters up. A letter after a prefix is one node, however often it is asked for,
    so that equal strings are the same node.
    """

    def __init__(self) -> None:
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.up: list[tuple[int, ...]] = [()]
        self.next: dict[tuple[int, str], int] = {}

    def add(self, node: int, letter: str) -> int:
        found = self.next.get((node, letter))
        if found is None:
            found = self.next[node, letter] = len(self.letter)
            self.letter.append(letter)
            self.depth.append(self.depth[node] + 1)
            self.hash.append((self.hash[node] * _BASE + ord(letter)) % _PRIME)
            up, k = [node], 0
            while k < len(self.up[up[k]]):
                up.append(self.up[up[k]][k])
                k += 1
            self.up.append(tuple(up))
        return found

    def ancestor(self, node: int, steps: int) -> int:
        while steps:
            k = steps.bit_length() - 1
            node, steps = self.up[node][k], steps - (1 << k)
        return node

    def differ(self, a: int, b: int) -> bool:
        """Whether two strings differ: by their hashes, and where these agree, by what they are."""
        return self.hash[a] != self.hash[b] or a != b

    def less(self, a: int, b: int) -> bool:
        """Whether string a comes before b: the longest common prefix is searched for, and the letters after it decide."""
        least = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, self.depth[a] - least), self.ancestor(b, self.depth[b] - least)
        if not self.differ(x, y):
            return self.depth[a] < self.depth[b]
        for k in reversed(range(least.bit_length())):
            if k < len(self.up[x]) and self.differ(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def _offer(states: list[Best], to: int, cost: int, node: int, audits: Audits) -> None:
    now = states[to]
    if now is None or cost < now[0] or cost == now[0] and audits.less(node, now[1]):
        states[to] = (cost, node)


def _inserted(states: list[Best], audits: Audits) -> list[Best]:
    """states with the turns that can be inserted here; after two of them a state comes again."""
    for _ in range(2):
        out = list(states)
        for s, best in enumerate(states):
            if best:
                _offer(out, NEXT[s], best[0] + PRICES["I"], audits.add(best[1], "I"), audits)
        states = out
    return states


def edited(turns: list[tuple[str, str]], start: int, audits: Audits) -> list[Best]:
    """The cheapest edits of turns (initial of the role, fault) from a state to each state, of equal ones the least string."""
    states: list[Best] = [None] * 4
    states[start] = (0, 0)
    for initial, fault in turns:
        before, states = _inserted(states, audits), [None] * 4
        more = TRUNCATED if fault == "truncated" else 0
        for s, best in enumerate(before):
            if best is None:
                continue
            _offer(states, s, best[0] + PRICES["D"], audits.add(best[1], "D"), audits)
            if fault in ("blank", "duplicate"):
                continue
            _offer(states, NEXT[s], best[0] + PRICES["R"] + more, audits.add(best[1], "R"), audits)
            for a, b in STEPS.get(initial, ()):
                if a == s:
                    _offer(states, b, best[0] + PRICES["K"] + more, audits.add(best[1], "K"), audits)
    return states


def ending(states: list[Best], audits: Audits) -> tuple[int, str]:
    """(cost, audit) of the best whole conversation: empty, or ending with an assistant."""
    states = _inserted(states, audits)
    last: list[Best] = [None]
    for s in (START, ASSISTANT):
        if states[s]:
            _offer(last, 0, *states[s], audits)
    cost, node = last[0]
    return cost, audits.text(node)


def fault_of(text: str, repeated: bool) -> str:
    if not SOME.search(text):
        return "blank"
    if repeated:
        return "duplicate"
    return "" if text.rstrip(SPACE)[-1] in ".!?" else "truncated"


def repaired(turns: list[tuple[str, str]], audit: str, state: int = START) -> Iterator[str]:
    """The lines `role:text` that edits make of turns (role, text)."""
    at = 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            yield f"{NAMES[state]}:"
            continue
        role, text = turns[at]
        at += 1
        if letter == "R":
            state = NEXT[state]
            yield f"{NAMES[state]}:{text}"
        elif letter == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
            yield f"{role}:{text}"


class Facts:
    """What is counted of successive turns: (turn, initial, fault) in order. Facts of pieces add up."""

    FIELDS = "low long, high long, distinct long, first long, last long, head string, tail string, turns long, blank long, duplicate long, truncated long, illegal long"

    def __init__(self, turns: list[int | None], initials: list[str], faults: list[str]) -> None:
        told = [t for t in turns if t is not None]
        self.low, self.high, self.distinct = (told[0], told[-1], len(set(told))) if told else (None, None, 0)
        self.first, self.last = self.low, self.high
        self.head, self.tail, self.turns = initials[0] if initials else None, initials[-1] if initials else None, len(turns)
        self.blank, self.duplicate, self.truncated = (faults.count(x) for x in ("blank", "duplicate", "truncated"))
        self.illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))

    def values(self) -> tuple:
        return (self.low, self.high, self.distinct, self.first, self.last, self.head, self.tail, self.turns, self.blank, self.duplicate, self.truncated, self.illegal)

    @classmethod
    def of(cls, values: tuple) -> Facts:
        new = cls([], [], [])
        new.low, new.high, new.distinct, new.first, new.last, new.head, new.tail, new.turns, new.blank, new.duplicate, new.truncated, new.illegal = values
        return new

    def then(self, other: Facts) -> Facts:
        """Facts of these turns and those that follow, which start with the same turn number or a higher one."""
        if not other.turns:
            return self
        if not self.turns:
            return other
        low = other.low if self.low is None else self.low
        high = self.high if other.high is None else other.high
        distinct = self.distinct + other.distinct - (self.high is not None and self.high == other.low)
        illegal = self.illegal + other.illegal + (self.tail + other.head not in LEGAL)
        return Facts.of((low, high, distinct, low, high, self.head, other.tail, self.turns + other.turns, self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated, illegal))

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _result(facts: Facts, cost: int, audit: str, digest: str) -> dict:
    return dict(zip(RESULT, (facts.gaps(), facts.blank, facts.duplicate, facts.truncated, facts.illegal, cost, audit, digest), strict=True))


def whole(turns: list[tuple[int | None, str, str]]) -> dict:
    """The result for one conversation's turns (number, role, text) in order."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for _, role, text in turns:
        faults.append(fault_of(text, (role, text) in seen))
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in turns]
    audits = Audits()
    cost, audit = ending(edited(list(zip(initials, faults, strict=True)), START, audits), audits)
    digest = hashlib.sha256("\n".join(repaired([(r, t) for _, r, t in turns], audit)).encode()).hexdigest()
    return _result(Facts([n for n, _, _ in turns], initials, faults), cost, audit, digest)


PIECE = "seq long, turns array<long>, roles array<string>, texts array<string>"
TOLD = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in RESULT)


def _cut(conv: str):
    """Sorted turns (conv_id, turn, role, text, gone) of a range of conversations to results, and to pieces where one may go on in another range or is long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema: pa.Schema | None = None
        seq, key, held, chars, cut = 0, None, [], 0, True  # the first conversation may have begun before
        begun = False
        out: list[dict] = []

        def piece() -> None:
            nonlocal seq, held, chars
            out.append({"conv_id": key, "seq": seq, "turns": [t for t, _, _ in held], "roles": [r for _, r, _ in held], "texts": [x for _, _, x in held]})
            seq, held, chars = seq + 1, [], 0

        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), ("seq", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), *((c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in RESULT)])
            for conv_id, turn, role, text, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv_id != key:
                    if begun:
                        if cut:
                            piece()
                        else:
                            out.append({"conv_id": key} | whole(held))
                            held, chars = [], 0
                        cut = False
                    begun, key = True, conv_id
                if gone:
                    continue
                if held and (len(held) >= PIECE_TURNS or chars + len(text) > PIECE_CHARS):
                    piece()
                    cut = True
                held.append((turn, role, text))
                chars += len(text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if begun:
            piece()  # the last one may go on in the next range
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run, f"conv_id {conv}, {PIECE}, {TOLD}"


MEASURED = f"conv_id {{conv}}, part int, seq long, {Facts.FIELDS}, starts array<int>, ends array<int>, costs array<long>, audits array<string>"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (conv_id, part, seq, turns, roles, texts, repeats) to their facts and the cheapest edits from each state to each."""
    names = [f.split()[0] for f in Facts.FIELDS.split(", ")]
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            again = set(row["repeats"] or ())
            faults = [fault_of(text, i in again) for i, text in enumerate(row["texts"])]
            initials = [r[:1] for r in row["roles"]]
            found = []
            for s in range(4):
                audits = Audits()  # one at a time, so that a task holds the nodes of one run only
                found += [(s, e, best[0], audits.text(best[1])) for e, best in enumerate(edited(list(zip(initials, faults, strict=True)), s, audits)) if best]
            starts, ends, costs, texts = (list(x) for x in zip(*found, strict=True))
            rows.append({"conv_id": row["conv_id"], "part": row["part"], "seq": row["seq"]} | dict(zip(names, Facts(row["turns"], initials, faults).values(), strict=True)) | {"starts": starts, "ends": ends, "costs": costs, "audits": texts})
        kinds = [batch.schema.field(0), pa.field("part", pa.int32()), pa.field("seq", pa.int64()), *(pa.field(n, pa.string() if n in ("head", "tail") else pa.int64()) for n in names)]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*kinds, ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]))


class _Path:
    """Edits up to a piece's end: those before, and the state that the piece starts from with its own edits."""

    __slots__ = ("audit", "before", "start")

    def __init__(self, before: _Path | None, start: int, audit: str):
        self.before, self.start, self.audit = before, start, audit

    def pieces(self) -> list[_Path]:
        out, at = [], self
        while at is not None:
            out.append(at)
            at = at.before
        return out[::-1]


def _earlier(a: tuple[_Path | None, str], b: tuple[_Path | None, str]) -> bool:
    """Whether path a with its last letters comes before b; both are over the same pieces."""
    own = []
    p, q = a[0], b[0]
    while p is not q:
        own.append((p.audit, q.audit))
        p, q = p.before, q.before
    for x, y in reversed(own):
        if x != y:
            return x < y
    return a[1] < b[1]


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Measured pieces, sorted, to (part, seq, start, letters) and, with a conversation's last piece, its facts and cost.

    What a task holds of a conversation are its edit strings, a few letters a turn.
    """
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("start", pa.int32()), ("letters", pa.string()), *((c, pa.int64()) for c in RESULT[:6])])
    begun, key = False, None
    places: list[tuple[int, int]] = []
    states: list[tuple[int, _Path | None] | None] = [None] * 4
    facts = Facts([], [], [])

    def ended() -> pa.RecordBatch:
        best = None
        for s, suffix in ((START, ""), (ASSISTANT, ""), (USER, "I"), (SYSTEM, "II")):
            if states[s] is not None:
                offer = (states[s][0] + PRICES["I"] * len(suffix), states[s][1], suffix)
                if best is None or offer[0] < best[0] or offer[0] == best[0] and _earlier(offer[1:], best[1:]):
                    best = offer
        cost, path, suffix = best
        rows = [{"part": p, "seq": q, "start": x.start, "letters": x.audit} for (p, q), x in zip(places, path.pieces(), strict=True)]
        rows[-1]["letters"] += suffix
        rows[-1] |= {k: v for k, v in _result(facts, cost, "", "").items() if k in RESULT[:6]}
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    names = [f.split()[0] for f in Facts.FIELDS.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            if not begun or row["conv_id"] != key:
                if begun:
                    yield ended()
                begun, key, places, states, facts = True, row["conv_id"], [], [(0, None), None, None, None], Facts([], [], [])
            places.append((row["part"], row["seq"]))
            facts = facts.then(Facts.of(tuple(row[n] for n in names)))
            after: list[tuple[int, _Path | None] | None] = [None] * 4
            for s, e, cost, audit in zip(row["starts"], row["ends"], row["costs"], row["audits"], strict=True):
                if states[s] is None:
                    continue
                offer = (states[s][0] + cost, _Path(states[s][1], s, audit))
                if after[e] is None or offer[0] < after[e][0] or offer[0] == after[e][0] and _earlier((offer[1], ""), (after[e][1], "")):
                    after[e] = offer
            states = after
    if begun:
        yield ended()


def _hash(conv: str):
    """Pieces with their edits, sorted, to results; the texts of a conversation stream through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, key, digest, lines, audit, last = False, None, hashlib.sha256(), 0, [], None
        schema: pa.Schema | None = None

        def ended() -> pa.RecordBatch:
            row = {"conv_id": key} | {c: last[c] for c in RESULT[:6]} | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), *((c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in RESULT)])
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if not begun or row["conv_id"] != key:
                    if begun:
                        yield ended()
                    begun, key, digest, lines, audit = True, row["conv_id"], hashlib.sha256(), 0, []
                for line in repaired(list(zip(row["roles"], row["texts"], strict=True)), row["letters"], row["start"]):
                    digest.update((("\n" if lines else "") + line).encode())
                    lines += 1
                audit.append(row["letters"])
                last = row
        if begun:
            yield ended()

    return run, f"conv_id {conv}, {TOLD}"


def repair(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, gone boolean) to one row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation's turns count in the order of turn (nulls first), role and text, except those
    that are gone, which only say that the conversation exists: one without turns has zeros, an
    empty audit and the empty string's hash. Null roles and texts count as one space; a null
    conv_id is a conversation of its own; turns that repeat in all columns are all there. An empty
    table gives no rows. Other columns are not read.

    The sorted turns are dealt by ranges of (conv_id, turn, role), so that a long conversation lies
    in several. Those that one range surely holds whole, and are not long, are done there. The
    others are cut into pieces: repeated turns are found by an aggregation, the cheapest edits of
    each piece from every state to every state are put together in order, and texts are hashed
    in a stream, so no task holds a conversation's texts.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "gone")
    conv = dict(rows.dtypes)["conv_id"]
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role")]
    run, schema = _cut(conv)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    found = materialize(arrow_batches(dealt, run, schema).withColumn("part", F.spark_partition_id()), "conversations")
    pieces = found.where("seq IS NOT NULL").select("conv_id", "part", "seq", "turns", "roles", "texts")
    said = pieces.select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "x")).select("conv_id", F.struct("part", "seq", "at").alias("place"), F.col("x.roles").alias("role"), F.sha2("x.texts", 256).alias("digest"))
    firsts = materialize(said.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first-turns")
    same = said["conv_id"].eqNullSafe(firsts["conv_id"]) & (said["role"] == firsts["role"]) & (said["digest"] == firsts["digest"])
    repeats = said.join(firsts, same).where("place > first").groupBy(F.col("place.part").alias("part"), F.col("place.seq").alias("seq")).agg(F.collect_list("place.at").alias("repeats"))  # at most PIECE_TURNS
    measured = arrow_batches(pieces.join(repeats, ["part", "seq"], "left").select("conv_id", "part", "seq", "turns", "roles", "texts", "repeats"), _measure, MEASURED.format(conv=conv), rows=16)
    edits = measured.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_compose, "part int, seq long, start int, letters string, " + ", ".join(f"{c} long" for c in RESULT[:6]))
    edits = materialize(edits, "edits", firsts)
    run, schema = _hash(conv)
    sides = pieces.join(edits, ["part", "seq"]).select("conv_id", "part", "seq", "roles", "texts", "start", "letters", *RESULT[:6])
    long_ones = arrow_batches(sides.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq"), run, schema, rows=16)
    return found.where("seq IS NULL").select("conv_id", *RESULT).unionByName(long_ones)


def damaged(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults by the CRC-32 of `conv_id:turn` modulo 20: 0 gone, 1 emptied, 2 without `.!?`, 3 twice, 4 said by the user. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    twice = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), F.when(kind != 0, text).alias("text"), (kind == 0).alias("gone"), F.explode(twice).alias("copy"))
    return out.drop("copy")
