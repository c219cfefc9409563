"""Conversation repair against a shortest-path search over whole audit strings."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from conftest import SF
from test_oracles import tidy

from citeweave.llm import conversation_repair as cr
from citeweave.llm.registry import ORACLE_SQL, QUERIES

PATTERN = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def faults_of(turns):
    seen, out = set(), []
    for role, text in turns:
        found = BLANK.findall(text)
        out.append("b" if not found else "d" if (role, text) in seen else "t" if found[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def search(turns, faults):
    """(cost, audit, repaired turns): Dijkstra over (turns read, roles' state), audits compared as text."""
    state = lambda s, c: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((s, c))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, s, out = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(turns) and s in ("", "a"):
            return cost, audit, list(out)
        for role in ("user", "assistant"):
            if state(s, role[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", i, state(s, role[0]), (*out, (role, ""))))
        if i < len(turns):
            (own, text), fault = turns[i], faults[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, s, out))
            if fault not in "bd":
                more = fault == "t"
                if own and state(s, own[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, state(s, own[0]), (*out, (own, text))))
                for role in ("user", "assistant"):
                    if state(s, role[0]):
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, state(s, role[0]), (*out, (role, text))))
    raise AssertionError


def by_definition(rows):
    """Of turns (conv_id, turn, role, text), judged and repaired conversation by conversation."""
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r, x) for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        turns = [(r, x) for _, r, x in own]
        faults = faults_of(turns)
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, repaired = search(turns, faults)
        assert PATTERN.fullmatch("".join(r[:1] for r, _ in repaired))
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest()
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def random_rows(seed, n=60, longest=9):
    rng = random.Random(seed)
    texts = ["Fine.", "Fine!", "Really? \n", "cut off", "é…", " ", "", "\t\n", "A.", "B?", "x" * 50 + "."]
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", " ", "ai", ""])
            turn = rng.choice([None, t, t, t + 3, 2 * t])
            rows.append((c if c % 17 else None, turn, role, rng.choice(texts)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, fault string, id int")


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize(("seed", "piece_rows"), [(1, 4096), (2, 1), (3, 2), (4, 5)])
def test_equals_the_search(spark, seed, piece_rows):
    rows = random_rows(seed)
    got = cr.summarise(frame(spark, rows), piece_rows).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == by_definition(rows)


def test_programme_equals_the_search():
    """The programme alone, over many short sequences, whole and cut in two."""
    rng = random.Random(7)
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "system", "x"]), "a.") for _ in range(rng.randrange(8))]
        faults = "".join(rng.choice("bdt---") for _ in turns)
        total, layer, parents = cr.sweep([r[:1] for r, _ in turns], faults, 0)
        cost, end = cr.best_end(total, layer)
        audit, out = cr.apply_edits(turns, parents, 0, end, cr.TAIL[end])
        assert (cost, audit, [(t["role"], t["text"]) for t in out]) == search(turns, faults)


def test_codes():
    """No code begins another, and their order is that of their letters."""
    assert cr.CODES == sorted(cr.CODES) and len(set(cr.CODES)) == 9
    assert not any(a != b and b.startswith(a) for a in cr.CODES for b in cr.CODES)


def test_long_conversation(spark):
    """One conversation of nearly all turns, in many pieces."""
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"text {t}.", f"text {t}", "again.", ""])) for t in range(700)]
    rows += [(c, t, "user", "x.") for c in (0, 2, 3) for t in range(2)]
    got = cr.summarise(frame(spark, rows), 64).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == by_definition(rows)


def test_repaired_turns(spark):
    """The pieces hold the repaired turns in order."""
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Yes."), (1, 2, "user", "So?"), (1, 2, "user", "So?"), (2, 0, "tool", "")]
    got = {}
    for r in sorted(cr.repair(frame(spark, rows), 2).collect(), key=lambda r: (r.conv_id, r.piece)):
        own = got.setdefault(r.conv_id, ["", []])
        own[0] += r.audit
        own[1] += [(t.role, t.text) for t in r.turns]
    expected = search([(r, x) for _, _, r, x in rows[:4]], faults_of([(r, x) for _, _, r, x in rows[:4]]))
    assert got[1] == [expected[1], expected[2]] and got[2] == ["D", []]


def test_damage(spark):
    """Every kind of damage by its hash; conversations left without turns stay in the result."""
    rows = [(c, t, "assistant", f"Turn. {t}!") for c in range(40) for t in range(3)] + [(None, None, None, None), (500, 1, "user", None)]
    left = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        left += [(c, t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    got = sorted(map(tuple, cr.summarise(cr.damaged(frame(spark, rows))).select(COLUMNS).collect()), key=repr)
    empty = {r[0] for r in rows} - {r[0] for r in left}
    none = [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in empty]
    assert got == sorted(by_definition(left) + none, key=repr)
    assert cr.summarise(frame(spark, [])).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    found = con.execute(ORACLE_SQL["op12_conversation_repair"])
    got = QUERIES["op12_conversation_repair"](spark, SF).select([d[0] for d in found.description])
    assert tidy(map(tuple, got.collect())) == tidy(found.fetchall())
