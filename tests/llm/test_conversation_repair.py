import hashlib
import random
import zlib

import pytest

from citeflow.llm import conversation_repair as cr
from citeflow.llm import queries

SMALL = "/root/testdata/sf0.001"
C = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_s, turn_s = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        if h == 1:
            text = ""
        if h == 2:
            text = "".join(c for c in text if c not in ".!?")
        if h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(h, 1)
    return out


def solve(rows):
    """All ways by place and automaton state, each the least (cost, audit, messages)."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "", ())}

    def put(into, state, way):
        if state not in into or way < into[state]:
            into[state] = way

    def inserted(states):
        for _ in range(3):
            for state, (cost, audit, made) in list(states.items()):
                for letter, role in (("u", "user"), ("a", "assistant")):
                    if letter in step[state]:
                        put(states, step[state][letter], (cost + 3, audit + "I", (*made, (role, ""))))
        return states

    for fault, role, text in rows:
        after = {}
        for state, (cost, audit, made) in inserted(best).items():
            put(after, state, (cost + 4, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if role[:1] in step[state] and role:
                put(after, step[state][role[:1]], (cost + more, audit + "K", (*made, (role, text))))
            for letter, new in (("u", "user"), ("a", "assistant")):
                if letter in step[state]:
                    put(after, step[state][letter], (cost + 3 + more, audit + "R", (*made, (new, text))))
        best = after
    return min(way for state, way in inserted(best).items() if state in ("", "a"))


def plain(original):
    """The contract, conversation by conversation."""
    convs = {}
    for row in original:
        convs.setdefault(row[0], [])
    for row in harmed(original):
        convs[row[0]].append(row[1:])
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, made = solve([(f, r[1], r[2]) for f, r in zip(faults, rows)])
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"),
                    faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain(rows)
    assert got(queries.op11_conversation_repair(spark, SMALL)) == want
    assert {c for w in want for c in w[7]} == set("DIKR")


def odd_rows(rng, n, convs):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No", "Why?", " ", "", None, "cut", "End!  \n", "e ", "long one."]
    return [(rng.choice(convs), rng.choice([None, *range(40)]), rng.choice(roles), rng.choice(texts) if rng.random() < .5
             else f"{rng.random()}{rng.choice(['.', ''])}") for _ in range(n)]


@pytest.mark.parametrize("block", [1, 2, 8, 4096])
def test_any_chunking(frame, monkeypatch, block):
    """Nulls, odd roles, ties, repeats; one conversation holds half of the rows and is cut into many chunks."""
    monkeypatch.setattr(cr, "BLOCK", block)
    rng = random.Random(block)
    rows = odd_rows(rng, 160, [1, 1, 1, 2, 3, 4, 5, 6, None])
    rows += rows[:20]
    df = frame([(*r, i) for i, r in enumerate(rows)], C + ", place int")
    assert got(cr.report(df, cr.damaged(df))) == plain(rows)


def test_vectors_that_never_converge(frame, monkeypatch):
    """Rows of another role with a cut text: every state deletes, so a speculative vector is carried to the front."""
    monkeypatch.setattr(cr, "BLOCK", 2)
    rows = [(1, i, "tool", f"no end {i}") for i in range(120)] + [(1, 200, "user", "Well?")] + [(2, 0, "assistant", "Odd.")]
    df = frame(rows, C)
    assert got(cr.report(df, cr.damaged(df))) == plain(rows)


def test_messages_are_the_repaired_conversation(frame):
    df = frame([(1, 0, "assistant", "Hello.", 1), (1, 1, "assistant", "Again.", 1)], C + ", n int")
    repaired, _, _ = cr.repair(df)
    made = [(r.role, r.text) for r in cr.messages(repaired).orderBy("place", "nth").collect()]
    assert made in ([("user", ""), ("assistant", "Hello."), ("user", ""), ("assistant", "Again.")], [("user", "Hello."), ("assistant", "Again.")])
    assert made == list(solve([("", "assistant", "Hello."), ("", "assistant", "Again.")])[2])


def test_empty(frame):
    df = frame([], C)
    assert got(cr.report(df, cr.damaged(df))) == []
