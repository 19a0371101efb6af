import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from scriptorium.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, audit string"


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        own = out.setdefault(conv, [])
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(initials, faults):
    """(cost, string) by looking from the end, over whole strings."""
    n = len(initials)
    grammar = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "")] if i == n and state in ("", "a") else []
        if inserts < 3:
            for r in "ua":
                if r in grammar[state]:
                    c, s = best(i, r, inserts + 1)
                    found.append((c + 3, "I" + s))
        if i < n:
            c, s = best(i + 1, state, 0)
            found.append((c + 4, "D" + s))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                for letter, cost, roles in (("K", 0, [initials[i]]), ("R", 3, ["u", "a"])):
                    for r in roles:
                        if r in grammar[state]:
                            c, s = best(i + 1, grammar[state][r], 0)
                            found.append((c + cost + more, letter + s))
        return min(found, default=(10**9, ""))

    for i in range(n, 0, -1):
        for state in grammar:
            best(i, state, 0)
    return best(0, "", 0)


def brute(rows):
    out = []
    for conv, own in damage(rows).items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in own]
        cost, audit = cheapest(tuple(initials), tuple(faults))
        lines, i, last = [], 0, ""
        for letter in audit:
            to = "assistant" if last == "u" else "user"
            if letter == "I":
                lines.append(f"{to}:")
                last = to[0]
                continue
            _, role, text = own[i]
            i += 1
            if letter == "K":
                lines.append(f"{role}:{text}")
                last = role[0]
            elif letter == "R":
                lines.append(f"{to}:{text}")
                last = to[0]
        told = [t for t, _, _ in own if t is not None]
        gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def rows(n=60, seed=1):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rng.choice([0, 1, 2, 5, 9, 16])):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ("system" if turn == 0 and rng.random() < 0.4 else ["user", "assistant"][turn % 2])
            out.append((conv, turn * rng.choice([1, 1, 1, 2]), role, rng.choice(["Yes.", "No!", "so on", "What? \n", "", " \t", f"text {turn}.", f"text {turn}"])))
    out += [(900, None, None, None), (900, None, "user", "a."), (900, 3, "", "b."), (901, None, "user", None), (None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (902, 5, "user", "x." * 50000), (902, 5, "assistant", "é\x0b"), (902, 5, "tool", "t.")]
    out += [(903, 1, "user", "same.")] * 5 + [(903, t, "assistant", "same.") for t in range(2, 6)]
    return out


def run(spark, given, parts=3):
    df = spark.createDataFrame([(*r, "clash") for r in given], SCHEMA)
    return sorted((tuple(r) for r in C.repair(C.damaged(df.repartition(parts))).collect()), key=str)


@pytest.mark.parametrize("piece", [4096, 3])
def test_matches_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(C, "PIECE_TURNS", piece)
    given = rows()
    assert run(spark, given) == brute(given)


def test_one_conversation_holds_most_turns(spark, monkeypatch):
    monkeypatch.setattr(C, "PIECE_TURNS", 20)
    rng = random.Random(4)
    given = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["Fine.", f"Turn {t}.", "cut off"])) for t in range(400)] + rows(5)
    assert run(spark, given) == brute(given)


def test_empty_table_and_dropped_conversations(spark):
    assert run(spark, []) == []
    gone = [(c, 0, "user", "Hi.") for c in range(60) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone and run(spark, gone) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone]


def test_ties_take_the_least_string_and_survive_collisions(monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(C, "_PRIME", 3)  # nearly all hashes collide
    for _ in range(400):
        n = rng.randrange(0, 9)
        turns = [(rng.choice("suax"), rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(n)]
        audits = C.Audits()
        assert C.ending(C.edited(turns, C.START, audits), audits) == cheapest(tuple(i for i, _ in turns), tuple(f for _, f in turns))


def test_nodes_compare_like_strings():
    rng, audits = random.Random(2), C.Audits()
    nodes = []
    for _ in range(300):
        node = 0
        for c in (rng.choice("DIKR") for _ in range(rng.randrange(12))):
            node = audits.add(node, c)
        nodes.append(node)
    for a in nodes[:60]:
        for b in nodes:
            assert audits.less(a, b) == (audits.text(a) < audits.text(b))
