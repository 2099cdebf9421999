"""Best-fit packing of tokenized documents into sequences of bounded length.

Planning works on counts: the histogram of piece lengths (at most one row per possible length) comes to the driver, where
best-fit decreasing places all pieces of one length at a time into groups of equally filled sequences. The plan says, for
each length, which ranks go to which sequences; pieces then take their planned slots by joining on their rank within their
length. Ranks are dealt in sub-buckets of bounded size, so a length that a third of all pieces share is ranked by many tasks.

A null text is an empty one and yields its end token alone. Documents longer than a sequence are cut, whole, into full
pieces and a rest. Repeated rows are packed each on its own; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import held, map_lists, read, tokenizer_path, written

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Parts in each of the two generations of an encoder's cache; an entry takes about 200 bytes.
CACHE_ENTRIES = 500_000
#: Pieces of one length that one window partition ranks.
RANK_ROWS = 5_000
#: Rows of the plan up to which it is broadcast; a row takes 48 bytes.
BROADCAST_ROWS = 250_000


class Encoder:
    """Encodes texts with a tokenizer, each distinct white-space-separated part once while it stays in the cache.

    The tokenizer drops white space and no merge crosses it, so a text's ids are its parts' ids. Texts that hold the start
    of a special token are given to the tokenizer whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        raw = [t.encode("utf-8") for t in texts]
        parts = [None if b"<|" in r else r.split() for r in raw]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        missing = {p for x in parts if x is not None for p in x if p not in cache}
        cache.update((p, older[p]) for p in missing if p in older)
        new = [p for p in missing if p not in cache]
        cache.update(zip(new, self._ids([p.decode("utf-8") for p in new]), strict=True))
        whole = iter(self._ids([t for t, x in zip(texts, parts, strict=True) if x is None]))
        return [next(whole) if x is None else b"".join(map(cache.__getitem__, x)) for x in parts]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encoder(path: str) -> Encoder:
    """The worker's encoder; its cache lasts until another operator runs there."""
    return held(("encoder", path), lambda: Encoder(path))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ids (binary) if asked for."""
    path = path or tokenizer_path(VOCABULARY)
    end = END_ID.to_bytes(4, "little")

    schema = PIECES + (", ids binary" if with_ids else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        e = encoder(path)
        for part in batches:
            rows = []
            for doc, ids in zip(part["doc_id"], e.encode(part["text"]), strict=True):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    x = ids[k : k + 4 * capacity]
                    rows.append((doc, k // (4 * capacity), k // 4, len(x) // 4, zlib.crc32(x), *([x] if with_ids else [])))
            yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    picked = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return map_lists(picked, run, schema, holds=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts by length.

    Rows: (length, first rank, rank after the last, first sequence, pieces for each sequence, offset of the first of them).
    """
    rows = []
    groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, sequences)
    opened = 0
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left, room = 0, counts[length], length
        while left:
            while room <= capacity and not groups[room]:
                room += 1
            if room <= capacity:
                first, many = groups[room].pop()
                space = room
            else:
                first, space = opened, capacity
                many = -(-left // (capacity // length))
                opened += many
            each = space // length
            full = min(many, left // each)
            rest = min(left - full * each, each - 1) if full < many else 0
            for at, sequences, pieces in ((first, full, each), (first + full, 1, rest)):
                if sequences and pieces:
                    rows.append((length, rank, rank + sequences * pieces, at, pieces, capacity - space))
                    groups[space - pieces * length].append((at, sequences))
                    rank += sequences * pieces
                    left -= sequences * pieces
            used = full + bool(rest)
            if used < many:
                groups[space].append((first + used, many - used))
    return rows


def ranked(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds rank, from 0, among the pieces of the same length, in an order fixed by their values."""
    buckets = F.ceil(F.col("n") / RANK_ROWS)
    dealt = pieces.join(F.broadcast(counts), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), buckets))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("size"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    local = dealt.withColumn("local", F.row_number().over(within) - 1)
    return local.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("local"))


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    pieces = written(tokenized(docs, capacity, path))
    found = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # a row per length, capacity at most
    counts = spark.createDataFrame([(r["length"], r["n"]) for r in found], "length long, n long")
    slots = plan({r["length"]: r["n"] for r in found}, capacity)
    planned = spark.createDataFrame(slots, "length long, low long, high long, first long, each long, base_offset long")
    if len(slots) <= BROADCAST_ROWS:
        planned = F.broadcast(planned)
    rows, slot = ranked(pieces, counts).alias("p"), planned.alias("s")
    met = (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    place = F.col("rank") - F.col("low")
    return rows.join(slot, met).select(
        "p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32",
        (F.col("first") + F.floor(place / F.col("each"))).alias("sequence_id"),
        (F.col("base_offset") + F.pmod(place, F.col("each")) * F.col("p.length")).alias("offset"),
    )


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
