"""Structure repair against a search over all edits, conversation by conversation."""

import hashlib
import heapq
import random
import re
from collections import defaultdict

import pytest

from assayer.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, present boolean, cost string, run int"
WORDS = ["Yes.", "no", "well? ", "", " \n", "so!\t", "and then", "Yes."]
ROLES = ["user", "assistant", "system", "tool", "user", "assistant", "umpire", ""]


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def _search(rows, faults):
    """The cheapest, ASCII-least edits by a search that carries whole audits; returns cost, audit and lines."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, k, state, lines = heapq.heappop(heap)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(rows) and state in ("", "a"):
            return cost, audit, list(lines)
        put = [c for c in follows[state] if c != "s"][0]
        heapq.heappush(heap, (cost + 3, audit + "I", k, put, (*lines, f"{names[put]}:")))
        if k < len(rows):
            _, role, text = rows[k]
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, state, lines))
            if faults[k] in ("", "truncated"):
                more = 3 * (faults[k] == "truncated")
                if role[:1] and role[:1] in follows[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, role[0], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 3 + more, audit + "R", k + 1, put, (*lines, f"{names[put]}:{text}")))


def _plain(table):
    """What repair returns, by conversation."""
    convs = defaultdict(list)
    for conv, turn, role, text, present, *_ in table:
        convs[conv]
        if present:
            convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults = _faults(rows)
        cost, audit, lines = _search(rows, faults)
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _table(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, 2**53 + 1, *range(30)]:
        for turn in range(rng.randint(0, 9)):
            rows.append((conv, rng.choice((turn, turn, turn, None, 3)), rng.choice([*ROLES, None]), rng.choice([*WORDS, None]), rng.random() < 0.9, "x", 1))
    return rows + rows[:5]


def _got(spark, rows):
    out = repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len({r["conv_id"] for r in out}) == len(out)
    return {r["conv_id"]: tuple(r)[1:] for r in out}


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_the_search(spark, seed):
    rows = _table(seed)
    assert _got(spark, rows) == _plain(rows)


def test_long_conversations_over_blocks_and_ranges(spark):
    rng = random.Random(7)
    rows = [(5, rng.choice((k, k // 2)), rng.choice(ROLES[:4]), rng.choice((f"turn {rng.randint(0, 900)}.", f"cut {k}", " ")), True, "x", 1) for k in range(2500)]
    rows += [(5, None, "user", f"first {k}.", True, "x", 1) for k in range(300)]
    rows += [(6, 1, "user", "the same.", True, "x", 1)] * 1500  # one row that fills a range of its own
    rows += [(7, 0, "user", "x" * 200_000 + ".", True, "x", 1), (7, 1, "assistant", "y" * 70_000, True, "x", 1), (8, 0, "user", "gone", False, "x", 1)]
    want = _plain(rows)
    assert _got(spark, rows) == want
    assert want[8] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_all_edits_of_small_conversations():
    """Every sequence of up to four codes, through the matrices of its halves as well."""
    codes = [kind * 4 + role for kind in range(4) for role in range(4) if kind in (0, 3) or role == 1]
    names = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
    kinds = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
    rng = random.Random(2)
    for _ in range(600):
        row = bytes(rng.choice(codes) for _ in range(rng.randint(0, 6)))
        edits, costs = repair.backward(row, repair.CLOSED)
        audit, state = repair.walk(row, edits, 0)
        cost, want, _ = _search([(0, names[c % 4], "t") for c in row], [kinds[c // 4] for c in row])
        assert (costs[0], audit + repair.CLOSING[state]) == (cost, want)
        left, right = repair.matrix(row[:3]), repair.matrix(row[3:])
        end = [min(right[4 * s + t] + repair.CLOSED[t] for t in range(4)) for s in range(4)]
        assert min(left[t] + end[t] for t in range(4)) == cost


def test_damage(spark):
    rows = [(c, t, None if t == 2 else "assistant", None if t == 3 else "A. b! c?") for c in range(40) for t in (None, 0, 1, 2, 3)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = defaultdict(list)
    for r in repair.damaged(turns).collect():
        got[(r["conv_id"], r["turn"])].append((r["role"], r["text"], r["present"]))
    import zlib

    for c, t, role, text in rows:
        m = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if m == 4 else " " if role is None else role, " " if text is None else text
        text = "" if m == 1 else re.sub("[.!?]", "", text) if m == 2 else text
        assert got[(c, t)] == [(role, text, m != 0)] * (2 if m == 3 else 1)


def test_empty_table(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
