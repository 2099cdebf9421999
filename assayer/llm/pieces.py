"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units (a run of spaces with the letters or the other characters after it) at places that no piece spans;
units longer than FOLDED characters are cut further wherever two neighbours stand in no piece together. Each distinct unit of
the corpus is encoded once: its substrings of at most the longest piece's length are exploded and joined with the piece table,
the edges are grouped by unit, and a fold makes a path of them. For a unigram model that fold is Viterbi, in a Spark higher-order
aggregate: the path of the largest sum of scores. For a BPE model it merges, step by step, the neighbours whose joint edge has
the best score, the leftmost among equals, because the largest sum of scores is not what such a model means; its state is the
set of borders that are left, as bits, of all units of a batch at once. A character that no piece covers becomes its UTF-8
bytes' pieces, or the unknown piece if there are none. Units that are still longer than FOLDED (a run of letters without any
break) are folded where they stand, by the same rules with a heap or a table, in time that grows with their length.

Units go back to the documents in two exact ways. The units that occur most (FREQUENT at most, so of bounded size) are sent
to all tasks and looked up while the texts are cut again; the others meet their ids in a join on the unit. Each row of the
input has a number, so that rows with equal doc_id, or none, stay apart; `whole` puts a row's stretches together in order.
Decoding gives the pieces' bytes for the ids, from a table that is as large as the vocabulary.

Null and empty texts have no ids: a row with n_ids 0. Repeated rows are encoded each on its own; other columns are ignored;
an empty table gives no row.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from assayer.llm.common import map_lists, read, release, ship, tokenizer_path, written

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
FREQUENT = 250_000
#: Characters up to which a unit is folded by Spark: its borders are bits of a number.
FOLDED = 62
#: Distinct units that a task counts before it passes the counts on.
LOCAL_UNITS = 200_000
#: Pieces up to which the piece table is broadcast; a row takes about 40 bytes.
BROADCAST_PIECES = 1_000_000
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
SIGNS = r"\x00-@\[-`{-\x7f"
#: A run of Latin letters or of ASCII's other characters, if no further kind follows; else all up to the next space.
FINE = rf"{SPACE}*(?:[{LATIN}]++(?![^\x00-\x7f{LATIN}{SPACE}])|[{SIGNS}]++(?![^\x00-\x7f{LATIN}{SPACE}])|[^{SPACE}]+)|{SPACE}+"
BORDER = re.compile(rf"[{LATIN}][{SIGNS}]|[{SIGNS}][{LATIN}]")
COARSE = rf"{SPACE}*[^{SPACE}]+|{SPACE}+"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with ids and scores; what the model does to a text before the lattice."""

    pieces: tuple[tuple[str, int, float], ...]
    first_byte: int | None
    unknown: int
    dummy_prefix: bool
    bpe: bool
    all_pieces: tuple[str, ...]
    byte_ids: frozenset

    @cached_property
    def pattern(self) -> str:
        """Where texts may be cut: between letters and signs if no piece has such a border inside, else before spaces only."""
        inside = [p.lstrip(SPACE) for p, _, _ in self.pieces]
        if any(SPACE in p for p in inside):
            raise ValueError("a piece has a space after another character")
        return COARSE if any(BORDER.search(p) for p in inside) else FINE

    @cached_property
    def joined(self) -> frozenset[str]:
        """All pairs of neighbours inside of pieces: nothing spans a border between two other characters."""
        return frozenset(p[k : k + 2] for p, _, _ in self.pieces for k in range(len(p) - 1))

    @cached_property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    @cached_property
    def cutter(self) -> Cutter:
        return Cutter(self.pattern, self.dummy_prefix, self.joined)


@dataclass(frozen=True)
class Cutter:
    """Cuts texts into units."""

    pattern: str
    dummy_prefix: bool
    joined: frozenset[str]

    def units(self, text: str | None) -> list[str]:
        if not text:
            return []
        found = re.findall(self.pattern, (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE))
        if max(map(len, found)) <= FOLDED:
            return found
        return [part for unit in found for part in (self.parts(unit) if len(unit) > FOLDED else (unit,))]

    def parts(self, unit: str) -> list[str]:
        at = [0, *(k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in self.joined), len(unit)]
        return [unit[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def vocabulary(path: str | None = None) -> Vocabulary:
    """Reads a model file. Only identity normalisation is supported; others raise."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path or tokenizer_path(VOCABULARY), "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
        raise ValueError("only models with identity normalisation are supported")
    normal, unknown, byte = 1, 2, 6
    kinds = [p.type for p in m.pieces]
    return Vocabulary(
        tuple((p.piece, k, p.score) for k, p in enumerate(m.pieces) if p.type == normal),
        next((k for k, x in enumerate(kinds) if x == byte), None),
        kinds.index(unknown), n.add_dummy_prefix, m.trainer_spec.model_type == 2,
        tuple(p.piece for p in m.pieces), frozenset(k for k, x in enumerate(kinds) if x == byte),
    )


def unigram_reading(voc: Vocabulary) -> Vocabulary:
    """The same pieces as a unigram model: the k-th best gets the score -2 - k ** 0.25, single characters without a rank -40."""
    scored = [(p, k, -2.0 - (-s) ** 0.25 if s > -1e8 else -40.0) for p, k, s in voc.pieces]
    return replace(voc, pieces=tuple(scored), bpe=False)


def distinct_units(docs: DataFrame, voc: Vocabulary) -> DataFrame:
    """unit, n of all texts' units of up to FOLDED characters: counted in each task first."""
    cutter = voc.cutter

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        seen: Counter = Counter()
        for x in batches:
            for t in x["text"]:
                seen.update(cutter.units(t))
            if len(seen) > LOCAL_UNITS:
                yield counted(seen)
                seen.clear()
        yield counted(seen)

    def counted(seen: Counter) -> dict:
        short = [u for u in seen if len(u) <= FOLDED]
        return {"unit": short, "n": [seen[u] for u in short]}

    return map_lists(docs.select("text"), run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def piece_table(spark: SparkSession, voc: Vocabulary) -> DataFrame:
    """piece, id, cost and rank (by cost); the empty piece stands for the unit itself, so that a unit without any piece keeps its row."""
    costs = {c: k for k, c in enumerate(sorted({-s for _, _, s in voc.pieces}))}
    rows = [("", 0, 0.0, 0), *((p, k, -s, costs[-s]) for p, k, s in voc.pieces)]
    table = spark.createDataFrame(pd.DataFrame(rows, columns=["piece", "id", "cost", "rank"]), "piece string, id int, cost double, rank int")
    return F.broadcast(table) if len(rows) <= BROADCAST_PIECES else table


def lattice(found: DataFrame, voc: Vocabulary) -> DataFrame:
    """unit, n, edges of every unit: its pieces, from character s to before e.

    For BPE an edge is a number in the order of merging (rank, then s, length and id), for Viterbi it is cost, s, e and id. The
    place after a unit's last character stands for the empty piece.
    """
    spark, size, start = found.sparkSession, F.length("unit"), F.col("s")
    places = found.select("unit", "n", F.explode(F.sequence(F.lit(0), size)).alias("s"))
    places = places.withColumn("tail", F.substr(F.col("unit"), start + 1, F.lit(voc.longest)))
    places = places.withColumn("head", F.substr(F.col("tail"), F.lit(1), F.lit(_HEAD))).join(head_table(spark, voc), "head", "left")
    last = F.least(F.length("tail"), F.coalesce("longest", F.lit(_HEAD - 1)))
    lengths = F.sequence(F.when(start < size, F.lit(1)).otherwise(F.lit(0)), last)
    cut = places.select("unit", "n", "s", "tail", F.explode(lengths).alias("k"))
    met = cut.select("unit", "n", "s", "k", F.substr(F.col("tail"), F.lit(1), F.col("k")).alias("piece")).join(piece_table(spark, voc), "piece")
    if not voc.bpe:
        edge = F.struct("cost", "s", (start + F.col("k")).alias("e"), "id")
        return met.groupBy("unit").agg(F.first("n").alias("n"), F.collect_list(edge).alias("edges"))
    # an edge as one number, the best and leftmost first: rank, s, k and id
    edge = F.shiftleft(F.shiftleft(F.shiftleft(F.col("rank").cast("long"), 6).bitwiseOR(start), 6).bitwiseOR(F.col("k")), _ID_BITS).bitwiseOR(F.col("id"))
    return met.groupBy("unit", "n").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


#: Bits of a piece's id in the number of an edge.
_ID_BITS = 26


def head_table(spark: SparkSession, voc: Vocabulary) -> DataFrame:
    """head, longest: the length of the longest piece that starts with so many characters; others have no piece of that length."""
    longest: dict[str, int] = {}
    for p, _, _ in voc.pieces:
        if len(p) >= _HEAD:
            longest[p[:_HEAD]] = max(len(p), longest.get(p[:_HEAD], 0))
    table = spark.createDataFrame(list(longest.items()), "head string, longest int")
    return F.broadcast(table) if len(longest) <= BROADCAST_PIECES else table


#: Characters by which substrings that cannot be pieces are left out before they are made.
_HEAD = 3


def merged(edges: pa.ListArray, units: list[str], voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units that BPE leaves, one unit's after the other's, and their numbers by unit, from a batch of a BPE lattice.

    All units of the batch are folded at once over their borders, as bits: an edge of which both ends and one border inside are
    left joins two segments; the best such edge of a unit takes that border away, and edges that cannot join any more go, until
    no unit has one.
    """
    one, rows = np.uint64(1), len(units)
    code, unit = edges.flatten().to_numpy(), np.repeat(np.arange(rows), edges.value_lengths().to_numpy())
    s, k = (code >> (_ID_BITS + 6) & 63).astype(np.uint64), (code >> _ID_BITS & 63).astype(np.uint64)
    ends, borders = one << s | one << (s + k), ((np.uint64(2) << k) - one) << s
    left = np.zeros(rows, np.uint64)
    left[unit[k == 0]] = (np.uint64(2) << s[k == 0]) - one  # the empty piece stands at a unit's end
    wide = np.flatnonzero(k > 1)
    at, sides, inside = unit[wide], ends[wide], borders[wide] & ~ends[wide]
    while len(at):
        now = left[at]
        alive = (inside & now != 0) & (sides & ~now == 0)
        at, sides, inside = at[alive], sides[alive], inside[alive]
        border = inside & left[at]
        ready = np.flatnonzero(border & (border - one) == 0)
        best = ready[np.append(True, at[ready][1:] != at[ready][:-1])] if len(ready) else ready
        left[at[best]] ^= border[best]
        goes_on = np.zeros(rows, bool)
        goes_on[at[best]] = True
        at, sides, inside = at[goes_on[at]], sides[goes_on[at]], inside[goes_on[at]]
    chosen = np.flatnonzero((k > 0) & (borders & left[unit] == ends))
    chosen = chosen[np.lexsort((s[chosen], unit[chosen]))]
    ids, n = (code[chosen] & ((1 << _ID_BITS) - 1)).astype("<u4"), np.bincount(unit[chosen], minlength=rows)
    bare = np.flatnonzero(n != np.bitwise_count(left).astype(np.int64) - 1)
    if not len(bare):
        return ids, n
    parts = np.split(ids, np.cumsum(n)[:-1])  # characters that no piece covers
    starts = np.split(s[chosen].astype(np.int64), np.cumsum(n)[:-1])
    for row in bare.tolist():
        hit = dict(zip(starts[row].tolist(), parts[row].tolist(), strict=True))
        out: list[int] = []
        for f in [b for b in range(len(units[row])) if int(left[row]) >> b & 1]:
            if f in hit:
                out.append(hit[f])
            elif voc.first_byte is None:
                out.append(voc.unknown)
            else:
                out += [voc.first_byte + x for x in units[row][f].encode()]
        parts[row] = np.array(out, "<u4")
    return np.concatenate(parts), np.array([len(x) for x in parts])


def path_ids(voc: Vocabulary, path: Column, is_edge) -> Column:
    """The ids of the segments between borders, with byte or unknown pieces where no edge is."""

    def ids(start: Column, k: Column) -> Column:
        end = path[k + 1]
        char = F.hex(F.encode(F.substr(F.col("unit"), start + 1, end - start), "UTF-8"))
        if voc.first_byte is None:
            rest = F.array(F.lit(voc.unknown))
        else:
            rest = F.transform(
                F.sequence(F.lit(1), F.length(char), F.lit(2)),
                lambda i: F.conv(F.substr(char, i, F.lit(2)), 16, 10).cast("int") + voc.first_byte,
            )
        hit = F.transform(F.filter("edges", lambda x: is_edge(x, start, end)), lambda x: F.array(x["id"]))
        return F.coalesce(F.get(hit, 0), rest)

    return F.flatten(F.transform(F.slice(path, F.lit(1), F.size(path) - 1), ids))


def viterbi_table(least_score: float) -> Column:
    """total and from of the best path to each border; a character without a piece costs 10 more than the worst piece."""

    def step(best: Column, end: Column) -> Column:
        ending = F.filter("edges", lambda x: (x["e"] == end) & (x["s"] < end))
        ways = F.transform(ending, lambda x: F.struct((best[x["s"]]["total"] - x["cost"]).alias("total"), x["s"].alias("from")))
        own = F.struct((best[end - 1]["total"] + least_score - 10.0).alias("total"), (end - 1).alias("from"))
        covered = lambda w: F.exists(w, lambda x: x["from"] == end - 1)
        last = F.transform(F.array(ways), lambda w: F.array_max(F.when(covered(w), w).otherwise(F.concat(w, F.array(own)))))
        return F.concat(best, last)

    first = F.array(F.struct(F.lit(0.0).alias("total"), F.lit(-1).alias("from")))
    return F.aggregate(F.sequence(F.lit(1), F.length("unit")), first, step)


def viterbi_path(table: Column) -> Column:
    """Borders of the segments of the largest sum of scores. The table is to be a lambda's argument: as a column of its own Spark would make it anew for each segment."""

    def back(path: Column, _: Column) -> Column:
        return F.when(path[0] == 0, path).otherwise(F.concat(F.array(table[path[0]]["from"]), path))

    return F.aggregate(F.sequence(F.lit(1), F.length("unit")), F.array(F.length("unit")), back)


def folded(edges: DataFrame, voc: Vocabulary) -> DataFrame:
    """unit, n, ids of every unit of a Viterbi lattice."""
    path = F.transform(F.array(viterbi_table(min(s for _, _, s in voc.pieces))), viterbi_path)[0]
    ids = F.transform(F.array(path), lambda p: path_ids(voc, p, lambda x, s, e: (x["s"] == s) & (x["e"] == e)))[0]
    return edges.select("unit", "n", ids.alias("ids"))


class LongUnits:
    """The ids of one unit of any length, by the same rules as the folds."""

    def __init__(self, voc: Vocabulary):
        self.voc, self.pieces = voc, {p: (-s, k) for p, k, s in voc.pieces}
        self.least = min(s for _, _, s in voc.pieces)

    def ids(self, unit: str) -> list[int]:
        path = self.merged(unit) if self.voc.bpe else self.best(unit)
        out: list[int] = []
        for a, b in zip(path[:-1], path[1:], strict=True):
            hit = self.pieces.get(unit[a:b])
            if hit:
                out.append(hit[1])
            elif self.voc.first_byte is None:
                out.append(self.voc.unknown)
            else:
                out += [self.voc.first_byte + x for x in unit[a:b].encode()]
        return out

    def merged(self, unit: str) -> list[int]:
        """Borders that merging leaves: neighbours wait in a heap, the best and leftmost first."""
        n, heap = len(unit), []
        after, before, gone = list(range(1, n + 2)), list(range(-1, n + 1)), [False] * (n + 1)

        def push(a: int, b: int) -> None:
            if 0 <= a and b <= n and b - a <= self.voc.longest and (hit := self.pieces.get(unit[a:b])):
                heapq.heappush(heap, (hit[0], a, b))

        for k in range(n - 1):
            push(k, k + 2)
        while heap:
            _, s, e = heapq.heappop(heap)
            m = after[s]
            if gone[s] or gone[e] or m >= e or after[m] != e:
                continue
            gone[m], after[s], before[e] = True, e, s
            push(before[s], e)
            push(s, after[e])
        return [k for k in range(n + 1) if not gone[k]]

    def best(self, unit: str) -> list[int]:
        """Borders of the path of the largest sum of scores."""
        n, table = len(unit), [(0.0, -1)]
        for end in range(1, n + 1):
            hits = [(s, self.pieces.get(unit[s:end])) for s in range(max(0, end - self.voc.longest), end)]
            ways = [(table[s][0] - hit[0], s) for s, hit in hits if hit]
            if not hits[-1][1]:
                ways.append((table[end - 1][0] + self.least - 10.0, end - 1))
            table.append(max(ways))
        path = [n]
        while path[-1]:
            path.append(table[path[-1]][1])
        return path[::-1]


def least_count(encoded: DataFrame, most: int) -> int:
    """The least count such that at most `most` units occur so often; from a histogram of counts by powers of 2^(1/8)."""
    level = F.floor(F.log2("n") * 8)
    rows = encoded.groupBy(level.alias("level")).agg(F.count("*").alias("many"), F.min("n").alias("n")).orderBy(F.desc("level")).collect()
    total, least = 0, 1 << 62
    for r in rows:
        total += r["many"]
        if total > most:
            break
        least = r["n"]
    return least


class Shown:
    """The bytes of each id, SPACE as a space; ids outside of the vocabulary count for nothing."""

    def __init__(self, voc: Vocabulary):
        self.raw = [bytes([int(p[3:5], 16)]) if k in voc.byte_ids else p.replace(SPACE, " ").encode() for k, p in enumerate(voc.all_pieces)]

    def of(self, ids: Iterable[int]) -> bytes:
        try:
            return b"".join(map(self.raw.__getitem__, ids))
        except IndexError:
            return b"".join([self.raw[i] for i in ids if i < len(self.raw)])


#: What a row of docs has: a row with its stretches of units whose ids are at hand, as lists, and one for each other unit (one_*).
ENCODED = (
    "row long, doc_id long, n_units long, round_trip boolean, at array<int>, n_ids array<int>, ids_crc32 array<long>, ids array<binary>, "
    "one_at int, one_n_ids int, one_ids_crc32 long, one_ids binary"
)
_KNOWN = ENCODED[: ENCODED.index(", one_at")]
TOLD = "unit string, n long, n_ids int, ids_crc32 long, good boolean, ids binary"


def told(edges: DataFrame, voc: Vocabulary) -> DataFrame:
    """TOLD rows of a lattice's units: little-endian 32-bit ids with their number and crc32, and whether they decode to the unit."""
    ship(edges.sparkSession)
    shown, target = Shown(voc), to_arrow_schema(StructType.fromDDL(TOLD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, found = batch.column(0).to_pylist(), batch.column(2)
            if voc.bpe:
                flat, sizes = merged(found, units, voc)
            else:
                flat, sizes = found.flatten().to_numpy().astype("<u4"), found.value_lengths().to_numpy()
            raw, listed, ends = flat.tobytes(), flat.tolist(), np.cumsum(sizes).tolist()
            starts = [0, *ends[:-1]]
            binary = [raw[4 * f : 4 * t] for f, t in zip(starts, ends, strict=True)]
            good = [shown.of(listed[f:t]) == u.replace(SPACE, " ").encode() for f, t, u in zip(starts, ends, units, strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)), pa.array(list(map(zlib.crc32, binary)), pa.int64()), pa.array(good, pa.bool_()), pa.array(binary, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=target)
        release()

    ready = edges.select("unit", "n", "edges") if voc.bpe else folded(edges, voc)
    return ready.mapInArrow(run, TOLD)


def encode(docs: DataFrame, voc: Vocabulary | None = None, frequent: int = FREQUENT, with_ids: bool = True) -> DataFrame:
    """ENCODED rows, to be put together by `whole`. row is a number for each row of docs; at: the number of a stretch's first unit.

    ids are little-endian 32-bit ones, null unless with_ids; round_trip tells whether they decode to the text (texts that hold
    the mark for spaces do not).
    """
    spark = docs.sparkSession
    voc = voc or vocabulary()
    encoded = written(told(lattice(distinct_units(docs, voc), voc), voc))
    least = least_count(encoded, frequent)
    common: dict[str, bytes] = {}
    odd = set()
    for r in encoded.where(F.col("n") >= least).select("unit", "ids", "good").toLocalIterator():  # at most `frequent` rows
        common[r["unit"]] = bytes(r["ids"])
        if not r["good"]:
            odd.add(r["unit"])
    shown, cutter, long = Shown(voc), voc.cutter, LongUnits(voc)
    sent = spark.sparkContext.broadcast((common, odd))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        common, odd = sent.value
        names = [c.split()[0] for c in f"{_KNOWN}, rare_at array<int>, rare array<string>".split(", ")]
        for x in batches:
            out = []
            for row, doc, text in zip(x["row"], x["doc_id"], x["text"], strict=True):
                units = cutter.units(text)
                values = list(map(common.get, units))
                good = (not text or SPACE not in text) and (not odd or odd.isdisjoint(units))
                at, firsts, stretches, rare_at, rare = 0, [], [], [], []  # at: the first unit of the stretch that is open
                for k in [k for k, v in enumerate(values) if v is None]:
                    unit = units[k]
                    if len(unit) > FOLDED:
                        found = long.ids(unit)
                        values[k] = array("I", found).tobytes()
                        good = good and shown.of(found) == unit.replace(SPACE, " ").encode()
                        continue
                    if at < k:
                        firsts.append(at)
                        stretches.append(b"".join(values[at:k]))
                    rare_at.append(k)
                    rare.append(unit)
                    at = k + 1
                if at < len(units):
                    firsts.append(at)
                    stretches.append(b"".join(values[at:]))
                sizes, crcs = [len(b) // 4 for b in stretches], list(map(zlib.crc32, stretches))
                out.append((row, doc, len(units), good, firsts, sizes, crcs, stretches if with_ids else None, rare_at, rare))
            yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True))

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    cut = written(map_lists(numbered, run, f"{_KNOWN}, rare_at array<int>, rare array<string>"))
    others = cut.select("row", F.explode(F.arrays_zip("rare_at", "rare")).alias("one")).select("row", F.col("one.rare_at").alias("one_at"), F.col("one.rare").alias("unit"))
    rest = encoded.where(F.col("n") < least).select("unit", "n_ids", "ids_crc32", "good", *(["ids"] if with_ids else []))
    met = others.join(rest, "unit").drop("unit").withColumnsRenamed({"n_ids": "one_n_ids", "ids_crc32": "one_ids_crc32", "good": "round_trip", "ids": "one_ids"})
    both = cut.drop("rare_at", "rare").unionByName(met, allowMissingColumns=True)
    return both if with_ids else both.withColumn("one_ids", F.lit(None).cast("binary"))


def _shift_tables() -> np.ndarray:
    """Tables, by power of two and by byte of a crc32, of what so many zero bytes after the data make of it."""
    one = [int(zlib.crc32(b"\0", 1 << k ^ 0xFFFFFFFF) ^ zlib.crc32(b"\0", 0xFFFFFFFF)) for k in range(32)]
    out = np.zeros((48, 4, 256), np.uint32)
    now = np.array(one, np.uint32)
    for power in range(48):
        for byte in range(4):
            for value in range(256):
                for bit in range(8):
                    if value >> bit & 1:
                        out[power, byte, value] ^= now[8 * byte + bit]
        now = _shifted(out[power], now)
    return out


def _shifted(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def joined_crc32(crc: np.ndarray, size: np.ndarray, n: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The crc32 of byte strings one after another, from those of each and their sizes in bytes: a number for each n of them."""
    out, n = np.zeros(len(n), np.int64), n.astype(np.int64)
    some = n > 0
    ends = np.cumsum(n)[some] - 1
    total = np.cumsum(size)
    after, crc = np.repeat(total[ends], n[some]) - total, crc.astype(np.uint32)
    for power in range(int(after.max(initial=0)).bit_length()):
        hit = after >> power & 1 == 1
        crc[hit] = _shifted(tables[power], crc[hit])
    if some.any():
        out[some] = np.bitwise_xor.reduceat(crc, ends - n[some] + 1)
    return out


def whole(stretches: DataFrame) -> DataFrame:
    """row, doc_id, n_units, n_ids, ids_crc32, round_trip and ids of each row of docs, from the rows of encode."""
    ship(stretches.sparkSession)
    schema = "row long, doc_id long, n_units long, n_ids long, ids_crc32 long, round_trip boolean, ids binary"
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("doc_id", "n_units", "at", "n_ids", "ids_crc32", "ids")]
    one = F.struct("one_at", "one_n_ids", "one_ids_crc32", "one_ids")
    parts = stretches.groupBy("row").agg(*first, F.bool_and("round_trip").alias("round_trip"), F.collect_list(F.when(F.col("one_at").isNotNull(), one)).alias("one"))
    # columns by place, so that Python gets arrays, not structs
    lists = [*(F.col(c) for c in ("at", "n_ids", "ids_crc32", "ids")), *(F.col(f"one.one_{c}").alias(f"one_{c}") for c in ("at", "n_ids", "ids_crc32", "ids"))]
    by_place = parts.select("row", "doc_id", "n_units", "round_trip", *lists)
    tables, target = _shift_tables(), to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            n = [column[c].value_lengths().to_numpy() for c in ("at", "one_at")]
            row = np.concatenate([np.repeat(np.arange(batch.num_rows), k) for k in n])
            at, size, crc = (np.concatenate([column[f"{one}{c}"].flatten().to_numpy() for one in ("", "one_")]) for c in ("at", "n_ids", "ids_crc32"))
            order = np.lexsort((at, row))
            size = size.astype(np.int64)
            n_ids = np.bincount(row, weights=size, minlength=batch.num_rows).astype(np.int64)
            ids = None
            if column["ids"].null_count < batch.num_rows:
                raw = column["ids"].flatten().to_pylist() + column["one_ids"].flatten().to_pylist()
                ends = np.cumsum(n[0] + n[1]).tolist()
                ids = [b"".join([raw[k] for k in order[f:t]]) for f, t in zip([0, *ends[:-1]], ends, strict=True)]
            crcs = joined_crc32(crc[order], 4 * size[order], n[0] + n[1], tables)
            columns = [column["row"], column["doc_id"], column["n_units"], pa.array(n_ids), pa.array(crcs), column["round_trip"], pa.array(ids, pa.binary()) if ids else pa.nulls(batch.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=target)
        release()

    return by_place.mapInArrow(run, schema)


def decode(tokens: DataFrame, voc: Vocabulary | None = None) -> DataFrame:
    """From key, ids (array): key, text of each row. Ids outside of the vocabulary count for nothing; null ids give the empty text."""
    voc = voc or vocabulary()
    shown, prefix = Shown(voc), voc.dummy_prefix

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for x in batches:
            raw = [shown.of([i for i in ids or [] if i >= 0]) for ids in x["ids"]]
            yield {"key": x["key"], "text": [r[prefix and r.startswith(b" ") :].decode("utf-8", "replace") for r in raw]}

    kind = tokens.schema["key"].dataType.simpleString()
    return map_lists(tokens.select("key", "ids"), run, f"key {kind}, text string")


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Per row of documents: its units, ids, the crc32 of its ids (little-endian 32-bit) and whether they decode to its text."""
    return whole(encode(read(spark, sf_dir, "documents"), with_ids=False)).select("doc_id", "n_units", "n_ids", "ids_crc32", "round_trip")


def unigram_pieces(spark, sf_dir: str) -> DataFrame:
    """The same with Viterbi, over the pieces read as a unigram model."""
    rows = whole(encode(read(spark, sf_dir, "documents"), unigram_reading(vocabulary()), with_ids=False))
    return rows.select("doc_id", "n_units", "n_ids", "ids_crc32", "round_trip")
