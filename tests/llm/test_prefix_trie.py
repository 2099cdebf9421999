"""The prefix trie against a plain version that holds every prefix."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from assayer.llm import ordered, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos string, size int"


def _rebuilt(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def _plain(rows):
    members = defaultdict(list)
    convs = _rebuilt(rows)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].decode()) if p else 0) + sum(saved[k] for k in children[p])
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()
    )


def _got(spark, rows):
    turns, sizes = prefix_trie.with_family_starts(prefix_trie.positions(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    out = prefix_trie.trie(turns, sizes)
    assert out.columns == prefix_trie.NODE
    return sorted(tuple(-1 if x is None else x for x in r) for r in out.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_equal_the_plain_version(spark, seed):
    rng = random.Random(seed)
    ids = [0, 1, 2, 3, 5, 99, 100, 101, 150, 199, 205, 207, 2**53 + 1, 7100, 7101, 7199]
    rows = [(c, rng.choice((t, None, 1)), rng.choice(("user", None, "a")), rng.choice(("x", "yy", None, "ü😀")), "p", 1) for c in ids for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "of nobody", "p", 1)] * 3 + rows[:4]
    assert _got(spark, rows) == _plain(rows)


def test_long_copies_and_a_common_start(spark):
    rows = [(c, t, "user", f"turn {t}", "p", 1) for c in (300, 301, 302) for t in range(2300)]  # chains over several buckets and ranges
    rows += [(c, t, "user", f"turn {t}" if t < 7 else f"own {c}", "p", 1) for c in range(310, 330) for t in range(9)]
    rows += [(c, 0, "user", "common", "p", 1) for c in range(1000, 1800)]
    assert _got(spark, rows) == _plain(rows)


def test_awkward_tables(spark):
    assert _got(spark, []) == []
    assert _got(spark, [(None, 0, "user", "of nobody", "p", 1)]) == []
    alone = [(4, 0, "user", "x" * 100_000, "p", 1)]
    assert _got(spark, alone) == _plain(alone)


def test_a_hash_over_ranges_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_BYTES", 50)
    rows = [(k % 3, (k * 7919) % 5000) for k in range(4000)]
    chunks = ordered.chunked(spark.createDataFrame(rows, "rep long, conv long"), "rep", "conv")
    assert chunks.count() > 100
    got = {r["key"]: r["sha256"] for r in ordered.chained_sha256(chunks, b",").collect()}
    assert got == {k: hashlib.sha256(",".join(str(v) for v in sorted(v for r, v in rows if r == k)).encode()).hexdigest() for k in range(3)}
