"""Conversation structure repair: cheapest edits by a rank-compressed dynamic programme.

Every turn is kept, given another role or deleted, after a run of inserted
empty turns; together that is one *macro edit*.  The codes of macro edits are
their letters ("IIK": two inserts, keep).  No code is the beginning of another,
so two audits compare as the sequences of their codes do, and the programme
need not carry audits: after each turn it holds, for each state of the role
pattern, the least cost and the *rank* of that state's best audit among the
others'.  The next layer's ranks follow from (rank before, code); parent
pointers are kept per layer, and the audit is read off backwards at the end.

A run of three inserts is never cheapest: the pattern is in the same state two
inserts earlier.  So runs have two inserts at most.

Conversations are not gathered.  Turns are range-partitioned and sorted, and
streamed in pieces of bounded size.  A conversation that lies inside one piece
is repaired there.  For the others each piece yields a table (first state, last
state) of costs and ranks; tables are chained per conversation, and the pieces
are then repaired side by side from the states so found.  Only the hash of a
whole conversation is a sequence by definition: it is folded over its pieces in
order, holding one piece at a time.

Nulls: a null role or text is one space; null turns come first; a null
conversation is one conversation.  Turns that share their number are ordered by
role, then text digest.  A role that starts with none of s, u, a cannot be
kept, nor can an empty one.  Repeated rows are duplicates.  Texts of any length
are read whole.  An empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Store
from .resampling import SQL_CRC, SQL_CRC_OF
from .tables import read_table

# White space, ends of sentences, costs, and the role pattern (s?(ua)+)? as a table of states.
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LEGAL = {"su", "ua", "au"}
#: The state after an inserted (or reroled) turn, and that turn's role.
ONWARD, ONWARD_ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: Inserts that end the pattern.
TAIL = (0, 2, 1, 0)
CODES = sorted("I" * j + e for j in range(3) for e in "DKR")
#: A piece has at most so many turns, and ends once it has so many characters.
PIECE_ROWS, PIECE_CHARS = 4096, 1 << 22

Layer = tuple[tuple[int, int] | None, ...]


@cache
def moves(initial: str, fault: str) -> list[tuple[int, int, int, int]]:
    """(state, code, next state, cost) of every macro edit of a turn with this role initial and fault."""
    out = []
    for p in range(4):
        for number, code in enumerate(CODES):
            q, cost = p, INSERT * (len(code) - 1)
            for _ in code[1:]:
                q = ONWARD[q]
            if code[-1] == "D":
                out.append((p, number, q, cost + DELETE))
            elif fault not in ("b", "d"):
                cost += TRUNCATED * (fault == "t")
                if code[-1] == "R":
                    out.append((p, number, ONWARD[q], cost + REROLE))
                elif (q, initial) in STEP:
                    out.append((p, number, STEP[q, initial], cost + KEEP))
    return out


def ranked(found: dict[int, tuple]) -> tuple[int, Layer, tuple]:
    """(least cost, layer, parents) from the best (cost, rank, code, state) of each next state."""
    least = min(c[0] for c in found.values())
    rank = {q: r for r, q in enumerate(sorted(found, key=lambda q: found[q][1:3]))}
    layer = tuple((found[q][0] - least, rank[q]) if q in found else None for q in range(4))
    return least, layer, tuple((found[q][3], found[q][2]) if q in found else None for q in range(4))


@lru_cache(1 << 16)
def advance(layer: Layer, initial: str, fault: str) -> tuple[int, Layer, tuple]:
    """One turn: (cost common to all states, next layer, per state its parent and code)."""
    found: dict[int, tuple] = {}
    for p, code, q, cost in moves(initial, fault):
        if layer[p] is not None:
            own = (layer[p][0] + cost, layer[p][1], code, p)
            if q not in found or own < found[q]:
                found[q] = own
    return ranked(found)


def only(state: int) -> Layer:
    """The layer before the first turn."""
    return tuple((0, 0) if q == state else None for q in range(4))


def sweep(initials: list[str], faults: str, start: int) -> tuple[int, Layer, list[tuple]]:
    """(common cost, last layer, parents of every layer) of turns entered in state ``start``."""
    layer, total, parents = only(start), 0, []
    for initial, fault in zip(initials, faults, strict=True):
        cost, layer, back = advance(layer, initial if initial in ("s", "u", "a") else "", fault)
        total += cost
        parents.append(back)
    return total, layer, parents


def best_end(total: int, layer: Layer) -> tuple[int, int]:
    """(cost, last state) of the cheapest audit, ties by rank; the pattern is completed by inserts."""
    cost, _, state = min((total + layer[q][0] + INSERT * TAIL[q], layer[q][1], q) for q in range(4) if layer[q] is not None)
    return cost, state


def apply_edits(turns: list[tuple[str, str]], parents: list[tuple], start: int, end: int, tail: int) -> tuple[str, list[dict]]:
    """(audit, repaired turns) read off the parent pointers, with ``tail`` inserts after the last turn."""
    codes, state = [], end
    for back in reversed(parents):
        state, code = back[state]
        codes.append(CODES[code])
    codes.reverse()
    out, state = [], start

    def put(role: str | None, text: str) -> int:
        out.append({"role": ONWARD_ROLE[state] if role is None else role, "text": text})
        return ONWARD[state] if role is None else STEP[state, role[:1]]

    for code, (role, text) in zip(codes, turns, strict=True):
        for _ in code[1:]:
            state = put(None, "")
        if code[-1] != "D":
            state = put(role if code[-1] == "K" else None, text)
    for _ in range(tail):
        state = put(None, "")
    return "".join(codes) + "I" * tail, out


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_TURNS = "array<struct<role:string,text:string>>"
_TURN = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_PIECE = {
    "conv_id": ("long", pa.int64()), "piece": ("long", pa.int64()), "whole": ("boolean", pa.bool_()), "least": ("long", pa.int64()), "greatest": ("long", pa.int64()), "numbers": ("long", pa.int64()),
    **{c: ("long", pa.int64()) for c in _COUNTS}, "first": ("string", pa.string()), "last": ("string", pa.string()), "costs": ("array<long>", pa.list_(pa.int64())), "ranks": ("array<int>", pa.list_(pa.int32())),
    "cost": ("long", pa.int64()), "audit": ("string", pa.string()), "faults": ("string", pa.string()), "turns": (_TURNS, _TURN),
}


class _Piece:
    """Turns of one conversation that one task has in a row."""

    def __init__(self, conv_id: int | None, opens: bool):
        self.conv_id, self.opens, self.turns, self.faults, self.numbers, self.chars = conv_id, opens, [], [], [], 0

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        self.turns.append((role, text))
        self.faults.append(fault)
        self.chars += len(text) + len(role)
        if turn is not None and (not self.numbers or self.numbers[-1] != turn):
            self.numbers.append(turn)

    def full(self, most: int) -> bool:
        return len(self.turns) >= most or self.chars >= PIECE_CHARS

    def row(self, number: int, closes: bool) -> dict:
        """The piece, repaired if it is a whole conversation, else with its table of costs and ranks."""
        initials, faults = [r[:1] for r, _ in self.turns], "".join(self.faults)
        out = {
            "conv_id": self.conv_id, "piece": number, "whole": self.opens and closes, "least": self.numbers[0] if self.numbers else None, "greatest": self.numbers[-1] if self.numbers else None, "numbers": len(self.numbers),
            "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"), "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
            "first": initials[0] if initials else None, "last": initials[-1] if initials else None, "costs": None, "ranks": None, "cost": None, "audit": None, "faults": None,
        }
        if out["whole"]:
            total, layer, parents = sweep(initials, faults, 0)
            out["cost"], end = best_end(total, layer)
            out["audit"], out["turns"] = apply_edits(self.turns, parents, 0, end, TAIL[end])
        else:
            costs, ranks = [], []
            for start in range(4):
                total, layer, _ = sweep(initials, faults, start)
                costs += [None if x is None else total + x[0] for x in layer]
                ranks += [None if x is None else x[1] for x in layer]
            out |= {"costs": costs, "ranks": ranks, "faults": faults, "turns": [{"role": r, "text": t} for r, t in self.turns]}
        return out


def _batches_of(rows: Iterable[dict], kinds: dict[str, tuple], most: int = 256, most_turns: int = 8192) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size."""
    schema, held, turns = pa.schema([(c, t) for c, (_, t) in kinds.items()]), [], 0
    for r in rows:
        held.append(r)
        turns += len(r.get("turns") or ())
        if len(held) >= most or turns >= most_turns:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, turns = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _ddl(kinds: dict[str, tuple]) -> str:
    return ", ".join(f"{c} {t}" for c, (t, _) in kinds.items())


def faulty_turns(turns: DataFrame, store: Store) -> DataFrame:
    """(conv_id, turn, role, text, id, gone, fault): each turn's first fault as one letter, "-" for none.

    ``turns`` may have a column ``gone``: such turns count for nothing but leave
    their conversation in the result.
    """
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    tidy = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    local = F.when(end == "", "b").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    rows = tidy.withColumn("local", local).withColumn("digest", F.md5(F.col("text").cast("binary"))).withColumn("id", F.monotonically_increasing_id())
    rows = store.put(rows, "turns")
    # The first turn of each role and text is named by its id; the minimum is combined before the shuffle.
    said = rows.filter("not gone and local <> 'b'").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "id")).alias("at"))
    fresh = said.select(F.col("at.id").alias("id"), F.lit(True).alias("fresh"))
    again = ~F.col("gone") & (F.col("local") != "b") & F.col("fresh").isNull()
    return rows.join(fresh, "id", "left").withColumn("fault", F.when(again, "d").otherwise(F.col("local"))).drop("local", "fresh")


def _pieces(rows: DataFrame, piece_rows: int) -> DataFrame:
    """Sorted turns cut into pieces; conversations that end where they began are repaired."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32

        def pieces() -> Iterator[dict]:
            now, number = None, base
            for b in batches:
                for conv_id, turn, role, text, gone, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault")), strict=True):
                    if now is None or now.conv_id != conv_id:
                        if now is not None:  # the next conversation has begun, so this one is complete
                            yield now.row(number, True)
                            number += 1
                        # What came before the task's first turn is not known.
                        now = _Piece(conv_id, now is not None)
                    elif now.full(piece_rows):
                        yield now.row(number, False)
                        number += 1
                        now = _Piece(conv_id, False)
                    if not gone:
                        now.add(turn, role, text, fault)
            if now is not None:
                yield now.row(number, False)

        yield from _batches_of(pieces(), _PIECE)

    order = ["conv_id", "turn", "role", "digest", "id"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select("conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(run, _ddl(_PIECE))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Consecutive rows of one conversation, streamed."""
    from itertools import groupby

    rows = (r for b in batches for lo in range(0, b.num_rows, 16) for r in b.slice(lo, 16).to_pylist())
    return groupby(rows, key=lambda r: r["conv_id"])


_CHOICE = {c: ("long", pa.int64()) for c in ("conv_id", "piece", "start", "end", "tail", "gaps", *_COUNTS, "cost")}


def _chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chain the tables of each conversation's pieces: the states in which each is entered and left."""

    def choices() -> Iterator[dict]:
        for conv_id, pieces in _runs(batches):
            layer, total, parents, ids = only(0), 0, [], []
            counts, least, greatest, numbers, last = dict.fromkeys(_COUNTS, 0), None, None, 0, None
            for x in pieces:
                found: dict[int, tuple] = {}
                for p in range(4):
                    for q in range(4):
                        if layer[p] is not None and x["costs"][4 * p + q] is not None:
                            own = (layer[p][0] + x["costs"][4 * p + q], layer[p][1], x["ranks"][4 * p + q], p)
                            if q not in found or own < found[q]:
                                found[q] = own
                cost, layer, back = ranked(found)
                total += cost
                parents.append(tuple(b and b[0] for b in back))
                ids.append(x["piece"])
                for c in _COUNTS:
                    counts[c] += x[c]
                if x["least"] is not None:
                    numbers += x["numbers"] - (x["least"] == greatest)
                    least, greatest = x["least"] if least is None else least, x["greatest"]
                if x["first"] is not None:
                    counts["illegal"] += last is not None and last + x["first"] not in LEGAL
                    last = x["last"]
            cost, end = best_end(total, layer)
            facts = {"gaps": 0 if least is None else greatest - least + 1 - numbers, **counts, "cost": cost}
            tail = TAIL[end]
            for at in range(len(ids) - 1, -1, -1):
                start = parents[at][end]
                yield {"conv_id": conv_id, "piece": ids[at], "start": start, "end": end, "tail": tail, **facts}
                end, tail, facts = start, 0, {}

    yield from _batches_of(choices(), _CHOICE)


_REPAIRED = {"conv_id": _PIECE["conv_id"], "piece": _PIECE["piece"], "whole": _PIECE["whole"], "gaps": ("long", pa.int64()), **{c: _PIECE[c] for c in (*_COUNTS, "cost", "audit", "turns")}}


def _decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repair each piece between the states chosen for it."""

    def repaired() -> Iterator[dict]:
        for _, pieces in _runs(batches):
            for x in pieces:
                turns = [(t["role"], t["text"]) for t in x["turns"]]
                _, _, parents = sweep([r[:1] for r, _ in turns], x["faults"], x["start"])
                audit, edited = apply_edits(turns, parents, x["start"], x["end"], x["tail"])
                yield {**{c: x[c] for c in ("conv_id", "piece", "gaps", *_COUNTS, "cost")}, "whole": False, "audit": audit, "turns": edited}

    yield from _batches_of(repaired(), _REPAIRED)


def repair(turns: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Repaired conversations of (conv_id, turn, role, text), in pieces of at most ``piece_rows`` turns each.

    One row a piece: conv_id, piece (their order), whole (the conversation's
    only piece), audit, turns (role, text) and, on a conversation's last piece,
    gaps, blank, duplicate, truncated, illegal and cost; null on the others.
    """
    store = Store(turns.sparkSession, "conversations")
    pieces = store.put(_pieces(faulty_turns(turns, store), piece_rows), "pieces")
    gaps = F.coalesce(F.col("greatest") - F.col("least") + 1 - F.col("numbers"), F.lit(0))
    done = pieces.filter("whole").withColumn("gaps", gaps).select(*_REPAIRED)
    open_ = pieces.filter("not whole")
    narrow = open_.select("conv_id", "piece", "least", "greatest", "numbers", *_COUNTS, "first", "last", "costs", "ranks")
    chosen = store.put(narrow.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_chain, _ddl(_CHOICE)), "chosen")
    decoded = open_.select("piece", "faults", "turns").join(chosen, "piece").mapInArrow(_decode, _ddl(_REPAIRED))
    return done.unionByName(decoded)


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each conversation over its pieces in order, one piece at a time."""

    def folded() -> Iterator[dict]:
        for conv_id, pieces in _runs(batches):
            sha, audit, lines, last = hashlib.sha256(), [], 0, {}
            for last in pieces:
                audit.append(last["audit"])
                for t in last["turns"]:
                    sha.update((f"\n{t['role']}:{t['text']}" if lines else f"{t['role']}:{t['text']}").encode("utf-8", "surrogatepass"))
                    lines += 1
            yield {"conv_id": conv_id, **{c: last[c] for c in ("gaps", *_COUNTS, "cost")}, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

    yield from _batches_of(folded(), _SUMMARY)


_SUMMARY = {"conv_id": _PIECE["conv_id"], "gaps": ("long", pa.int64()), **{c: _PIECE[c] for c in (*_COUNTS, "cost", "audit")}, "repaired_sha256": ("string", pa.string())}


def summarise(turns: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row a conversation: its faults, and the audit and hash of its repair."""
    pieces = Store(turns.sparkSession, "repaired").put(repair(turns, piece_rows), "pieces")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = pieces.filter("whole").withColumn("repaired_sha256", F.sha2(lines.cast("binary"), 256)).select(*_SUMMARY)
    parts = pieces.filter("not whole").drop("whole").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return whole.unionByName(parts.mapInArrow(_fold, _ddl(_SUMMARY)))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults by a hash of their keys: turns dropped (``gone``), emptied, cut, repeated or given to the user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    rows = conversations.select(
        "conv_id", "turn", (kind == 0).alias("gone"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("_copy"),
    )
    return rows.drop("_copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged, judged and repaired."""
    return summarise(damaged(read_table(spark, sf_dir, "conversations")))


#: The same result by definition, for DuckDB: per turn the cheapest and least audit, as text, of every state; one turn a round.
ORACLE = f"""
WITH RECURSIVE {SQL_CRC.strip()},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS x FROM conversations),
coded AS (SELECT c.* EXCLUDE (x), {SQL_CRC_OF.format(x="x")} % 20 AS kind FROM c, bits),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE kind <> 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM hurt),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '-' END AS fault FROM placed
),
step(p, r, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
onward(p, q, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
inserted AS (
  SELECT p, p AS q, '' AS letters, '' AS lines, 0 AS cost FROM onward UNION ALL SELECT p, q, 'I', role || ':' || chr(10), 2 FROM onward
  UNION ALL SELECT a.p, b.q, 'II', a.role || ':' || chr(10) || b.role || ':' || chr(10), 4 FROM onward a JOIN onward b ON b.p = a.q
),
options AS (
  SELECT j.conv_id, j.i, n.p, n.q, n.letters || 'D' AS letters, n.lines, n.cost + 3 AS cost FROM judged j, inserted n
  UNION ALL SELECT j.conv_id, j.i, n.p, s.q, n.letters || 'K', n.lines || j.role || ':' || j.text || chr(10), n.cost + CAST(fault = 't' AS INT) FROM judged j, inserted n, step s WHERE fault IN ('t', '-') AND s.p = n.q AND s.r = substr(j.role, 1, 1)
  UNION ALL SELECT j.conv_id, j.i, n.p, o.q, n.letters || 'R', n.lines || o.role || ':' || j.text || chr(10), n.cost + 2 + CAST(fault = 't' AS INT) FROM judged j, inserted n, onward o WHERE fault IN ('t', '-') AND o.p = n.q
),
walk(conv_id, i, q, cost, letters, lines) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, 0, '', '' FROM judged
  UNION ALL
  SELECT conv_id, i, q, best.cost, best.letters, best.lines FROM (
    SELECT o.conv_id, o.i, o.q, min({{'cost': w.cost + o.cost, 'letters': w.letters || o.letters, 'lines': w.lines || o.lines}}) AS best
    FROM walk w JOIN options o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.i = w.i + 1 AND o.p = w.q GROUP BY ALL
  )
),
sizes AS (SELECT conv_id, max(i) AS n FROM judged GROUP BY conv_id),
ends AS (
  SELECT w.conv_id, min({{'cost': w.cost + n.cost, 'letters': w.letters || n.letters, 'lines': w.lines || n.lines}}) AS e
  FROM walk w JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.n = w.i JOIN inserted n ON n.p = w.q WHERE n.q IN (0, 3) GROUP BY w.conv_id
),
pairs AS (SELECT conv_id, substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) || substr(role, 1, 1) AS two, fault, turn FROM judged),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(e.cost, 0) AS BIGINT) AS cost, coalesce(e.letters, '') AS audit, sha256(coalesce(substr(e.lines, 1, length(e.lines) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends x ON x.conv_id IS NOT DISTINCT FROM o.conv_id
"""
