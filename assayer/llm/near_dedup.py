"""MinHash near-duplicate detection with exact verification and connected components.

A document's set holds its distinct word shingles (hashed to 64 bits). Documents with equal sets form a class; the rest
works on one representative for each class, so exact copies never multiply. Representatives get many universal-hash minima,
banded; the members of a band's bucket are linked to the bucket's least member. Links are verified on the sets of the whole
texts, and connected components follow from the verified links. Members of a bucket that are then still in different
components are compared as well, all with all, in blocks of bounded size that give out links only: a bucket's size never
limits what is compared, and a group of near copies costs rows in proportion to its size.

With 32 bands of 4 minima a pair at similarity 0.8 shares no bucket with probability 5e-8.

Documents without a word, empty or null, have an empty set and are linked with nothing. A text of fewer words than a
shingle is one shingle. Rows without a doc_id get no component; keep_one leaves them as they are. Rows that repeat a doc_id
are the same document: each is returned with the component of its own text, and keep_one keeps or drops them together.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import lower_ascii, read, release, ship, written
from assayer.llm.components import components

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 32, 4
#: Documents in a block of a family of components; a task compares two blocks.
BLOCK = 1500
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of width words; all words as one window if there are fewer."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = mixed(out * MIX + words[k : n - width + 1 + k] + np.uint64(k + 1))
    return out


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(rolled(word_hashes(lower_ascii(text or "").split()), width))


def signer(bands: int, rows: int, seed: int = 20):
    """Band keys of a set: minima of universal (multiply-add) hash functions of 32 bits, hashed band by band."""
    rng = np.random.default_rng(seed)
    n = bands * rows
    a = rng.integers(0, 2**31, (n, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, (n, 1), dtype=np.uint32)
    salt = mixed(np.arange(1, bands + 1, dtype=np.uint64) * MIX)
    room = np.empty((n, 1024), np.uint32)

    def sign(items: np.ndarray) -> np.ndarray:
        low = np.full(n, ~np.uint32(0), np.uint32)
        short = (mixed(items) >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), room.shape[1]):
            part = short[at : at + room.shape[1]]
            values = room[:, : len(part)]
            np.multiply(a, part, out=values)
            np.add(values, b, out=values)
            np.minimum(low, values.min(axis=1), out=low)
        low = low.astype(np.uint64).reshape(bands, rows)
        key = salt.copy()
        for k in range(rows):
            key = mixed(key * MIX + low[:, k])
        return key.view(np.int64)

    return sign


SIGNED = "doc_id long, n_shingles long, set_hash binary, bands array<long>"


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """SIGNED of each row of docs (doc_id, text): the set's size, a 128-bit hash of the set and its band keys."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sign = signer(bands, rows)
        for pdf in batches:
            sets = [shingle_set(t, width) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"],
                "n_shingles": [len(s) for s in sets],
                "set_hash": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "bands": [sign(s) if len(s) else [] for s in sets],
            })
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL").mapInPandas(run, SIGNED)


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents whose whole texts' sets reach the similarity."""
    # sort-merge at every size: texts outgrow a broadcast, and both joins then share one exchange of them
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL").hint("merge")
    with_a = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
    both = with_a.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, None
        for pdf in batches:
            ok = []
            for one, two in zip(pdf["text_a"], pdf["text_b"], strict=True):
                if two != last:
                    last, kept = two, shingle_set(two, width)
                x = shingle_set(one, width)
                both = len(np.intersect1d(x, kept, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(kept) - both))
            yield pdf.loc[ok, ["a", "b"]]
        release()

    return both.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def between_components(labelled: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between documents that share a bucket but are in different components. labelled: key, a, label.

    Components that meet in buckets form families, and each family has a main component, the one with most documents in it.
    A family's documents, each once, are dealt into blocks of bounded size, those of the main component apart from the
    others. A task compares a block of others with a block of the main component or of others on inverted lists of shingles;
    blocks of the main component never meet each other, so a family with few others costs rows in proportion to its size.
    Only links leave the task, not the pairs that were compared.
    """
    ends = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key", "low")
    apart = labelled.join(ends, "key").select("a", "label", "low").distinct()
    families = components(apart.select(F.col("label").alias("a"), F.col("low").alias("b")))
    members = written(apart.select("a", "label").distinct().join(families.withColumnsRenamed({"node": "label", "component": "family"}), "label"))
    counted = members.groupBy("family", "label").agg(F.count("*").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = counted.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"))
    sizes = sizes.select("family", "main", blocks(F.col("most")).alias("mains"), blocks(F.col("all") - F.col("most")).alias("others"))
    dealt = members.join(sizes, "family").withColumn("is_main", F.col("label") == F.col("main"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("a"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    task = lambda with_main, i, k: F.struct(with_main.alias("with_main"), i.alias("i"), k.alias("k"))
    yes, no, block = F.lit(True), F.lit(False), F.col("block")
    of_main = F.transform(upto(F.col("others")), lambda i: task(yes, i, block))
    of_other = F.concat(
        F.transform(upto(F.col("mains")), lambda k: task(yes, block, k)),
        F.transform(upto(F.col("others")), lambda k: task(no, F.least(block, k), F.greatest(block, k))),
    )
    tasks = dealt.select("family", "a", "label", "is_main", "block", F.explode(F.when(F.col("is_main"), of_main).otherwise(of_other)).alias("t"))
    texts = docs.select(F.col("doc_id").cast("long").alias("a"), "text").where("doc_id IS NOT NULL").hint("merge")
    met = tasks.join(texts, "a").select("family", "t.with_main", "t.i", "t.k", "block", "is_main", "a", "label", "text")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("a")
        asks = ~pdf["is_main"].to_numpy(bool)
        ids, block, two = pdf["a"].to_numpy(), pdf["block"].to_numpy(), not pdf["with_main"].iloc[0] and pdf["i"].iloc[0] != pdf["k"].iloc[0]
        if two:
            asks = block == pdf["i"].iloc[0]
        found = links_across([shingle_set(t, width) for t in pdf["text"]], pdf["label"].to_numpy(), asks, percent)
        rows = [(ids[x], ids[y]) for x, y in found if not two or block[x] != block[y]]
        return pd.DataFrame(rows, columns=["a", "b"], dtype="int64")

    return met.groupBy("family", "with_main", "i", "k").applyInPandas(run, "a long, b long")


def links_across(sets: list[np.ndarray], labels: np.ndarray, asks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (x, y) of places of sets, x among those that ask, with different labels, that reach the similarity, from the sizes of their intersections."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    lists = np.split(owner[order], np.cumsum(np.bincount(ids, minlength=len(values)))[:-1])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for x in np.flatnonzero(asks):
        mine = ids[starts[x] : starts[x + 1]]
        both = np.bincount(np.concatenate([lists[i] for i in mine]), minlength=len(sets))
        hit = (100 * both >= percent * (sizes + sizes[x] - both)) & (labels != labels[x])
        out += [(int(x), int(y)) for y in np.flatnonzero(hit)]
    return out


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text)."""
    texts = docs.select("doc_id", "text")
    signed = written(signatures(texts, width, bands, rows))
    some = signed.where("n_shingles > 0")
    classes = written(some.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"), F.first("n_shingles").alias("size")))
    keyed = classes.select(F.col("node").alias("a"), "size", F.explode("bands").alias("key"))
    least = keyed.groupBy("key").agg(F.min("a").alias("b"), F.count("*").alias("many")).where("many > 1").select("key", "b")
    shared = written(keyed.join(least, "key"))  # members of buckets that hold more than one
    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    sizes = classes.select(F.col("node").alias("b"), F.col("size").alias("size_b"))
    star = shared.where("a != b").select("a", "b", "size").distinct().join(sizes, "b").where(fits(F.col("size"), F.col("size_b")))
    links = written(verified(written(star.select("a", "b")), texts, width, percent))
    found = components(links)
    labelled = shared.select("key", "a").join(found.withColumnRenamed("node", "a"), "a", "left")
    labelled = written(labelled.select("key", "a", F.coalesce("component", "a").alias("label")))
    extra = written(between_components(labelled, texts, width, percent))
    if not extra.isEmpty():
        found = components(links.union(extra))
    of = classes.select("set_hash", "node").join(found, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component_id"))
    full = some.select("doc_id", "n_shingles", "set_hash").join(of, "set_hash").select("doc_id", "n_shingles", "component_id")
    empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.union(empty)


def keep_one(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs with one document of each group of near duplicates, the one with the least doc_id."""
    groups = written(near_duplicates(docs, width, percent))
    gone = groups.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = near_duplicates(docs, width=2)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM both_have JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.d WHERE r.m < u.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(m) AS m FROM r GROUP BY d) c ON c.d = d.doc_id
"""
