"""Repair of conversation structure: the cheapest edits that make the turns follow a grammar.

The roles' initials shall be `(s?(ua)+)?`. Four states know where in it a conversation stands. A backward pass over the turns
gives, for each turn and state, the least cost to go and the ASCII-least edit on a way of that cost: Delete, Insert, Keep or
Rerole. The forward walk then follows these edits from the start, and the turns are rebuilt along it. As a state allows one
role of user and assistant only, the edits' initials tell the whole repair.

Rows lie in ranges of conversation, turn, role and text. A conversation that lies within one range and fits a block is repaired
where it lies. All others, two for each range at most and the long ones, go in blocks of bounded size: the costs of a range's
share are a 4 x 4 min-plus matrix, so that the costs to go at its end follow from the matrices after it; each share is walked
from every state it may be entered in, and the shares' ways are put together. Rows that repeat an earlier range's row are
found by a group-by of their digests. Nothing but an audit (a character an edit) is gathered by conversation.

A null conv_id is a conversation of its own; null roles and texts are one space. Turns go by turn (nulls first), then role,
then text. Repeated rows are duplicates. Roles of other names than system, user and assistant can only be reroled or
deleted, unless they share an initial. Other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import map_lists, read, written
from assayer.llm.ordered import chained_sha256, in_ranges

SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
#: Rows, and bytes of text, beyond which a block is given out.
BLOCK_ROWS, BLOCK_BYTES = 256, 1 << 16
#: Costs of the edits, and what a truncated turn that stays costs more.
DELETE, INSERT, KEEP, REROLE, TRUNCATED_COST = 4, 3, 0, 3, 3
#: A turn's code: its fault times four, and its role's initial.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: States: at the start, after a system turn, after a user's, after an assistant's. Where a kept role leads to, and which may be put in.
GO = ({SYSTEM: 1, USER: 2}, {USER: 2}, {ASSISTANT: 3}, {USER: 2})
PUT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
FAR = 1 << 40
#: Costs to go after the last turn, and the edits there.
CLOSED, CLOSING = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")


def fault(text: str) -> int:
    """Blank, truncated or none."""
    shown = text.rstrip(SPACE)
    return BLANK if not shown else NONE if shown.endswith(ENDS) else TRUNCATED


def role_class(role: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], OTHER)


def _relaxed(after: tuple, code: int) -> tuple[tuple, str]:
    """Costs to go before a turn from those after it, and the ASCII-least edit of that cost in each state."""
    kind, role = divmod(code, 4)
    more = TRUNCATED_COST if kind == TRUNCATED else 0
    ways = []
    for state in range(4):
        way = {"D": DELETE + after[state]}
        if kind in (NONE, TRUNCATED):
            if role in GO[state]:
                way["K"] = KEEP + more + after[GO[state][role]]
            way["R"] = REROLE + more + after[PUT[state][1]]
        ways.append(way)
    least = [min(w.values()) for w in ways]
    least[2], least[3] = min(least[2], INSERT + least[3]), min(least[3], INSERT + least[2])
    for state in (0, 1):
        least[state] = min(least[state], INSERT + least[2])
    for state in range(4):
        ways[state]["I"] = INSERT + least[PUT[state][1]]
    edits = "".join(min(e for e, cost in ways[state].items() if cost == least[state]) for state in range(4))
    return tuple(least), edits


_STEPS: dict[tuple, tuple] = {}


def _step(after: tuple, code: int) -> tuple[tuple, int, str]:
    """As _relaxed, with the least cost taken out: so scaled, there are few different costs, and each step is worked out once."""
    key = (after, code)
    if key not in _STEPS:
        costs, edits = _relaxed(after, code)
        low = min(costs)
        _STEPS[key] = (tuple(FAR if c >= FAR else c - low for c in costs), low, edits)
    return _STEPS[key]


def backward(codes: bytes, end: tuple) -> tuple[list[str], tuple]:
    """The edit of each turn and state, and the costs to go at the start, from those at the end."""
    low = min(end)
    now, total = tuple(FAR if c >= FAR else c - low for c in end), low
    edits = [""] * len(codes)
    for k in range(len(codes) - 1, -1, -1):
        now, more, edits[k] = _step(now, codes[k])
        total += more
    return edits, tuple(FAR if c >= FAR else c + total for c in now)


def matrix(codes: bytes) -> list[int]:
    """By row: the state before the turns; by column: the one after them; the least cost between."""
    columns = [backward(codes, tuple(0 if s == t else FAR for s in range(4)))[1] for t in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)]


def walk(codes: bytes, edits: list[str], state: int) -> tuple[str, int]:
    """The audit from a state on, and the state after it."""
    audit = []
    for code, way in zip(codes, edits, strict=True):
        while (edit := way[state]) == "I":
            audit.append(edit)
            state = PUT[state][1]
        audit.append(edit)
        if edit != "D":
            state = GO[state][code % 4] if edit == "K" else PUT[state][1]
    return "".join(audit), state


def rebuilt(audit: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """The repaired turns as role:text."""
    rows, out = iter(zip(roles, texts, strict=True)), []
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = GO[state][role_class(role)]
        else:
            role, state = PUT[state]
        out.append(f"{role}:{text}")
    return out


def counted(codes: bytes) -> dict[str, int]:
    faults = [c >> 2 for c in codes]
    roles = [c & 3 for c in codes]
    return {
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
        "illegal": sum(pair not in LEGAL for pair in zip(roles, roles[1:])),
    }


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
BLOCK = "run long, seq int, codes binary, digests array<binary>, spots array<int>, roles array<string>, texts array<string>, low long, high long, turns long"
_NAMES = [f.split()[0] for f in f"{RESULT}, {BLOCK}".split(", ")]


class _Run:
    """A conversation's rows in one range, as they come."""

    def __init__(self, conv: int | None, number: int):
        self.conv, self.number, self.seq = conv, number, 0
        self.seen: set[bytes] = set()
        self.last: int | None = None
        self.clear()

    def clear(self) -> None:
        self.codes, self.roles, self.texts, self.digests, self.spots = bytearray(), [], [], [], []
        self.low = self.high = None
        self.turns = self.size = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        kind = fault(text)
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        if kind != BLANK:
            if digest in self.seen:
                kind = DUPLICATE
            else:
                self.seen.add(digest)
                self.digests.append(digest)
                self.spots.append(len(self.codes))
        self.codes.append(kind * 4 + role_class(role))
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text) + len(role)
        if turn is not None:
            self.turns += turn != self.last
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn

    def block(self) -> dict:
        out = {
            "conv_id": self.conv, "run": self.number, "seq": self.seq, "codes": bytes(self.codes), "digests": self.digests, "spots": self.spots,
            "roles": self.roles, "texts": self.texts, "low": self.low, "high": self.high, "turns": self.turns,
        }
        self.seq += 1
        self.clear()
        return out

    def whole(self) -> dict:
        codes = bytes(self.codes)
        edits, costs = backward(codes, CLOSED)
        audit, state = walk(codes, edits, 0)
        audit += CLOSING[state]
        lines = rebuilt(audit, 0, self.roles, self.texts)
        return {
            "conv_id": self.conv, **counted(codes), "cost": costs[0], "audit": audit,
            "gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        }


def _placed(batches: Iterator[dict]) -> Iterator[dict]:
    """Conversations within a range as results, others as blocks."""
    run: _Run | None = None
    number = 0
    for rows in batches:
        out = []
        for conv, turn, role, text, present, part in zip(*(rows[c] for c in ("conv_id", "turn", "role", "text", "present", "part")), strict=True):
            if run is None or conv != run.conv:
                if run is not None:
                    out.append(run.block() if run.seq or not number else run.whole())
                    number += 1
                run = _Run(conv, (part << 32) + number)
            elif len(run.codes) >= BLOCK_ROWS or run.size >= BLOCK_BYTES:
                out.append(run.block())
            if present:
                run.add(turn, role, text)
        yield _columns(out, _NAMES)
    if run is not None:
        yield _columns([run.block()], _NAMES)


def _columns(rows: list[dict], names: list[str]) -> dict[str, list]:
    return {name: [r.get(name) for r in rows] for name in names}


SHARE = "run long, conv_id long, sizes array<int>, codes binary, matrix array<long>, opens int, closes int, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long"
WAY = "run long, conv_id long, ends array<long>, first boolean, last boolean, illegal long, turns long"
WALKED = "run long, conv_id long, exits array<int>, audits array<array<string>>, states array<array<int>>, cost long"


def _shares(batches: Iterator[dict]) -> Iterator[dict]:
    """Each range's share of a conversation with all its duplicates marked, its counts and its matrix."""
    names = [f.split()[0] for f in SHARE.split(", ")]
    for rows in batches:
        out = []
        for run, conv, blocks, fixes, low, high, turns in zip(*(rows[c] for c in ("run", "conv_id", "blocks", "fixes", "low", "high", "turns")), strict=True):
            parts = [bytearray(b["codes"]) for b in blocks]
            for x in fixes or ():
                parts[x["seq"]][x["spot"]] = DUPLICATE * 4 + parts[x["seq"]][x["spot"]] % 4
            codes = bytes(b"".join(parts))
            out.append({
                "run": run, "conv_id": conv, "sizes": [*map(len, parts)], "codes": codes, "matrix": matrix(codes), "low": low, "high": high, "turns": turns,
                "opens": codes[0] & 3 if codes else None, "closes": codes[-1] & 3 if codes else None, **counted(codes),
            })
        yield _columns(out, names)


def _ways(batches: Iterator[dict]) -> Iterator[dict]:
    """From a conversation's shares in order: the costs to go at each one's end, and what adds up between neighbours."""
    names = [f.split()[0] for f in WAY.split(", ")]
    for rows in batches:
        out = []
        for conv, shares in zip(rows["conv_id"], rows["shares"], strict=True):
            end, mine = CLOSED, []
            for x in reversed(shares):
                mine.append({"run": x["run"], "conv_id": conv, "ends": [*end], "first": x is shares[0], "last": x is shares[-1], "illegal": 0, "turns": 0})
                end = tuple(min(x["matrix"][4 * s + t] + end[t] for t in range(4)) for s in range(4))
            closes = high = None
            for x, way in zip(shares, reversed(mine), strict=True):
                if x["opens"] is not None:
                    way["illegal"] = int(closes is not None and (closes, x["opens"]) not in LEGAL)
                    closes = x["closes"]
                if x["low"] is not None:
                    way["turns"] = -int(x["low"] == high)
                    high = x["high"]
            out += mine
        yield _columns(out, names)


def _walked(batches: Iterator[dict]) -> Iterator[dict]:
    """Each share's audit by block, from every state it may be entered in."""
    names = [f.split()[0] for f in WALKED.split(", ")]
    for rows in batches:
        out = []
        for run, conv, sizes, codes, ends, first, last in zip(*(rows[c] for c in ("run", "conv_id", "sizes", "codes", "ends", "first", "last")), strict=True):
            edits, costs = backward(codes, tuple(ends))
            exits, audits, states = [], [], []
            for state in (0,) if first else range(4):
                at, mine, entered = 0, [], []
                for size in sizes:
                    entered.append(state)
                    audit, state = walk(codes[at : at + size], edits[at : at + size], state)
                    mine.append(audit)
                    at += size
                if last:
                    mine[-1] += CLOSING[state]
                exits.append(state)
                audits.append(mine)
                states.append(entered)
            out.append({"run": run, "conv_id": conv, "exits": exits, "audits": audits, "states": states, "cost": costs[0] if first else 0})
        yield _columns(out, names)


def _entries(batches: Iterator[dict]) -> Iterator[dict]:
    """The state in which each share is entered, from the shares' exits in order."""
    for rows in batches:
        out = []
        for shares in rows["shares"]:
            state = 0
            for x in shares:
                out.append({"run": x["run"], "entry": state})
                state = x["exits"][state]
        yield _columns(out, ["run", "entry"])


def _lines(batches: Iterator[dict]) -> Iterator[dict]:
    for rows in batches:
        chunks = ["\n".join(rebuilt(*x)).encode() for x in zip(rows["audit"], rows["state"], rows["roles"], rows["texts"], strict=True)]
        yield {"conv_id": rows["conv_id"], "run": rows["run"], "seq": rows["seq"], "audit": rows["audit"], "chunk": chunks}


def _by_conversation(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each conversation with its shares in order: one for each range at most."""
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("shares"))


def _joined(blocks: DataFrame) -> DataFrame:
    """The results of the conversations that lie in blocks."""
    each = blocks.select("conv_id", "run", "seq", F.explode(F.arrays_zip("digests", "spots")).alias("x")).select("conv_id", "run", "seq", "x.digests", "x.spots")
    firsts = each.groupBy("conv_id", "digests").agg(F.min("run").alias("first_run"))
    again = each.alias("e").join(firsts.alias("f"), F.expr("e.conv_id <=> f.conv_id AND e.digests = f.digests AND run > first_run"))
    fixes = again.groupBy("run").agg(F.collect_list(F.struct("seq", F.col("spots").alias("spot"))).alias("fixes"))
    runs = blocks.groupBy("run").agg(
        F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("seq", "codes"))).alias("blocks"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns"),
    )
    shares = written(map_lists(runs.join(fixes, "run", "left"), _shares, SHARE))
    ways = written(map_lists(_by_conversation(shares, "run", "matrix", "opens", "closes", "low", "high"), _ways, WAY))
    walked = written(map_lists(shares.select("run", "conv_id", "sizes", "codes").join(ways.select("run", "ends", "first", "last"), "run"), _walked, WALKED))
    entries = map_lists(_by_conversation(walked, "run", "exits"), _entries, "run long, entry int")
    portions = walked.join(entries, "run").select("run", F.posexplode(F.arrays_zip(F.expr("audits[entry]").alias("audit"), F.expr("states[entry]").alias("state"))).alias("seq", "x"))
    lines = blocks.select("conv_id", "run", "seq", "roles", "texts").join(portions.select("run", "seq", "x.audit", "x.state"), ["run", "seq"])
    built = written(map_lists(lines, _lines, "conv_id long, run long, seq int, audit string, chunk binary"))

    # by the number of a conversation's first run, which is never null
    led = ways.groupBy("conv_id").agg(F.min("run").alias("key")).alias("l")
    same = F.expr("l.conv_id <=> r.conv_id")
    hashes = chained_sha256(built.alias("r").join(led, same).select("key", F.struct("run", "seq").alias("at"), "chunk"), b"\n")
    audits = built.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "seq", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    sums = {c: F.sum(c).alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal", "cost")}
    told = shares.select("conv_id", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", F.lit(0).cast("long").alias("cost"))
    zero = F.lit(0).cast("long")
    told = told.unionByName(ways.select("conv_id", "turns", "illegal", *[zero.alias(c) for c in ("blank", "duplicate", "truncated", "cost")]), allowMissingColumns=True)
    told = told.unionByName(walked.select("conv_id", "cost", *[zero.alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal")]), allowMissingColumns=True)
    totals = told.groupBy("conv_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), *sums.values()).alias("r")
    return (
        totals.join(led, same).join(hashes, "key").join(audits.alias("a"), F.expr("a.conv_id <=> r.conv_id"))
        .select("r.conv_id", F.coalesce(F.expr("high - low + 1 - turns"), zero).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "a.audit", F.col("sha256").alias("repaired_sha256"))
    )


def repair(turns: DataFrame) -> DataFrame:
    """RESULT for each conv_id of turns (conv_id, turn, role, text, present); rows that are not present only name their conversation."""
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "present"
    )
    placed = written(map_lists(in_ranges(rows, ["conv_id", "turn", "role", "text"]), _placed, f"{RESULT}, {BLOCK}"))
    names = [f.split()[0] for f in RESULT.split(", ")]
    return placed.where("run IS NULL").select(*names).unionByName(_joined(placed.where("run IS NOT NULL")))


def damaged(turns: DataFrame) -> DataFrame:
    """turns with what crc32(conv_id:turn) modulo 20 does to a row: dropped, emptied, unpunctuated, repeated, given to the user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    m, text, role = F.pmod(F.crc32(key), F.lit(20)), F.coalesce("text", space), F.coalesce("role", space)
    return turns.select(
        "conv_id", "turn",
        F.when(m == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(m == 1, F.lit("")).when(m == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (m != 0).alias("present"),
        F.explode(F.when(m == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(read(spark, sf_dir, "conversations")))


def _edit(way: str, edit: str, cost: str) -> str:
    """SQL for a way (six digits of cost, then its audit) with an edit more; null stays null."""
    return f"lpad((left({way}, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({way}, 7) || '{edit}'"


CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({key}, ''), lambda x: ascii(x)::BIGINT), lambda c, b:
  list_reduce([xor(c, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


def _stays(when: str, *ways: str) -> list[str]:
    """Ways that need the turn not to be blank or a duplicate."""
    return [f"CASE WHEN kind IN (0, 3) AND ({when}) THEN {way} END" for way in ways]


_KEPT, _REROLED = "IF(kind = 3, 3, 0)", "IF(kind = 3, 6, 3)"
ORACLE = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {CRC32.format(key="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS m
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, IF(m = 4, 'user', role) AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE m WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM src)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS time
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)),
coded AS (
  SELECT *, left(role, 1) AS r, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS follows,
         CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN time > 1 THEN 2
              WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS kind
  FROM ranked),
convs AS (SELECT DISTINCT conv_id FROM conversations),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, '000000' AS w0, NULL::VARCHAR AS w1, NULL::VARCHAR AS w2, NULL::VARCHAR AS w3 FROM convs
  UNION ALL
  SELECT conv_id, i,
    {_edit("c0", "D", "4")},
    least({_edit("c1", "D", "4")}, {_stays("r = 's'", _edit("c0", "K", _KEPT))[0]}),
    least({_edit("c2", "D", "4")}, {", ".join(_stays("r = 'u'", *[_edit(c, "K", _KEPT) for c in ("c0", "c1", "c3")]) + _stays("true", *[_edit(c, "R", _REROLED) for c in ("c0", "c1", "c3")]))}),
    least({_edit("c3", "D", "4")}, {", ".join(_stays("r = 'a'", _edit("c2", "K", _KEPT)) + _stays("true", _edit("c2", "R", _REROLED)))})
  FROM (
    SELECT *, least(w3, {_edit("c2", "I", "3")}) AS c3 FROM (
      SELECT w.conv_id, c.i, c.kind, c.r, w0 AS c0, w1 AS c1, w3,
             least(w2, {_edit("w0", "I", "3")}, {_edit("w1", "I", "3")}, {_edit("w3", "I", "3")}) AS c2
      FROM ways w JOIN coded c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i + 1))),
ended AS (
  SELECT conv_id, arg_max(least(w0, w3, {_edit("least(w2, " + _edit("w0", "I", "3") + ", " + _edit("w1", "I", "3") + ")", "I", "3")}), i) AS way FROM ways GROUP BY conv_id),
edits AS (
  SELECT conv_id, p, substr(way, p + 6, 1) AS e, sum((substr(way, p + 6, 1) <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS i,
         sum((substr(way, p + 6, 1) <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS j
  FROM (SELECT *, unnest(range(1, length(way) - 5)) AS p FROM ended)),
put AS (
  SELECT e.conv_id, p, e, j, c.role, c.text, bool_or(e = 'K' AND j = 1 AND r = 's') OVER (PARTITION BY e.conv_id) AS s
  FROM edits e LEFT JOIN coded c ON e.e <> 'I' AND c.conv_id IS NOT DISTINCT FROM e.conv_id AND c.i = e.i),
lines AS (
  SELECT conv_id, string_agg(CASE e WHEN 'K' THEN role ELSE IF((j - s::INT) % 2 = 1, 'user', 'assistant') END || ':' || IF(e = 'I', '', text), chr(10) ORDER BY p) AS repaired
  FROM put WHERE e <> 'D' GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 1) AS blank, count(*) FILTER (kind = 2) AS duplicate,
         count(*) FILTER (kind = 3) AS truncated, count(*) FILTER (follows IS NOT NULL AND r || follows NOT IN ('su', 'ua', 'au')) AS illegal
  FROM coded GROUP BY conv_id)
SELECT e.conv_id::BIGINT AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, left(way, 6)::BIGINT AS cost, substr(way, 7) AS audit,
       sha256(coalesce(repaired, '')) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM e.conv_id
"""
