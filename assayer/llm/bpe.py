"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon of frequent words.

Words are what the tokenizer's merges never cross: matches of its pattern in the composed, lower-cased text. Spark counts the
words of all texts; the most frequent ones (a documented bound) are merged by executors and compiled into a minimal acyclic
transducer: words that start alike share states, states with equal futures are one, and ids are given out as early as the
common start of all words behind an edge allows. The transducer is one flat file of 32-bit numbers that every executor gets
once and every worker maps into memory; a batch's new words walk it all at once, a byte a step. Words that it does not hold
are merged exactly, by rank, with a heap where they are long.

A null text is an empty one, without ids. Texts of any length are whole, words without a break as well. Repeated rows are
encoded each on its own; rows without a doc_id stay; other columns are ignored; an empty table gives no row. Strings of
special tokens in a text are those tokens, as in the library.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import json
import tempfile
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import held, map_lists, read, tokenizer_path, written

VOCABULARY = "word_bpe_49k.json"
#: Words of the lexicon, the most frequent ones, and the bytes of the longest that may enter. They bound what the driver compiles.
LEXICON_WORDS, WORD_BYTES = 250_000, 64
#: Steps between a frequency and its double: words are taken from the most frequent step downwards, while whole steps fit.
LEVELS = 32
#: Distinct parts, and bytes of text, that a counting task takes up before it gives its counts out.
COUNTED_PARTS, COUNTED_BYTES = 300_000, 1 << 27
#: Parts in each of the two generations of an encoder's cache (an entry takes about 200 bytes), and bytes of the longest kept.
CACHE_ENTRIES, CACHED_BYTES = 150_000, 256
#: Code points of text that are taken up at once.
TEXT_CHARS = 1 << 23
#: What ends a part in a row of ids: no id reaches it, nor do the bytes of two neighbours.
PART_END = b"\xff" * 4
#: Bytes up to which words are merged many at once, and how many.
SHORT, TOGETHER = 48, 4096
NEVER = 1 << 40


class Vocabulary:
    """Ids, merges and patterns of a vocabulary file of the tokenizers library: byte-level BPE with word ends."""

    def __init__(self, path: str):
        self.path, self.library, self.known = path, None, set()
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, self.end = whole["model"], whole["model"]["end_of_word_suffix"]
        ids = model["vocab"]
        chars = _byte_chars()
        self.inner = np.array([ids[c] for c in chars])
        self.last = np.array([ids[c + self.end] for c in chars])
        self.pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        made = sorted((a * (1 << 20) + b, rank) for (a, b), (rank, _) in self.pairs.items())
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*made, strict=True))
        self.pair_made = np.array([x for _, x in sorted(self.pairs.values())])
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.tokens = {k: t.encode("utf-8") for t, k in {**ids, **self.special}.items()}
        pattern = next(p["pattern"]["Regex"] for p in whole["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern + r"|\n").findall  # a line feed is a word here: it tells where a stretch ends
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split

    def plain(self, text: str) -> bool:
        """Whether a text's normal form, cut at white space, tells all: no special tokens, no characters that Python does not know."""
        return "<|" not in text and self._knows(text)

    def odd_parts(self, text: str) -> list[bytes]:
        """Any text as stretches of its normal form without white space; after a line feed: special tokens, and words as they are."""
        out: list[bytes] = []
        for x in self.cut(text):
            if x in self.special:
                out.append(b"\n" + x.encode("utf-8"))
            else:
                out += normal(x).encode("utf-8").split() if self._knows(x) else [b"\n" + w for w in self._newer(x)]
        return out

    def parts(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct parts of texts, the number of each part among these, in order, and how many parts each text has."""
        texts = [t or "" for t in texts]
        odd = {k: self.odd_parts(t) for k, t in enumerate(texts) if not self.plain(t)}
        forms = pa.array([b"" if k in odd else normal(t).encode("utf-8") for k, t in enumerate(texts)], pa.large_binary())
        cut = pc.ascii_split_whitespace(forms.cast(pa.large_string()))
        found = cut.flatten().cast(pa.large_binary()).dictionary_encode()
        names, numbers = found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False)
        sizes = np.diff(cut.offsets.to_numpy())
        if odd:
            place = {p: k for k, p in enumerate(names)}
            rows = np.split(numbers, np.cumsum(sizes)[:-1])
            for k, parts in odd.items():
                rows[k] = np.array([place.setdefault(p, len(place)) for p in parts], np.int64)
            names, numbers, sizes = [*place], np.concatenate(rows), np.array([*map(len, rows)])
        return names, numbers, sizes

    def pieces(self, parts: list[bytes]) -> list[str]:
        """The words of stretches, in one list, with a line feed after each stretch."""
        return self.words(b"\n".join((*parts, b"")).decode("utf-8"))

    def _knows(self, text: str) -> bool:
        """Whether Python's Unicode tables know all characters."""
        if text.isascii():
            return True
        new = set(text) - self.known
        if any(unicodedata.category(c) == "Cn" for c in new):
            return False
        self.known |= new
        return True

    def _newer(self, text: str) -> list[bytes]:
        """The words of a text with characters that Python's Unicode tables do not know, by the library's own tables."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        byte_of = {c: b for b, c in enumerate(_byte_chars())}
        return [bytes(map(byte_of.__getitem__, w)) for w, _ in cut]

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of words, merged exactly: in each, the pair of the least rank first, the leftmost of equal ones."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        short = bisect.bisect_right(order, SHORT, key=lambda k: len(words[k]))
        for at in range(0, short, TOGETHER):
            rows = order[at : min(at + TOGETHER, short)]
            for k, ids in zip(rows, self._by_table([words[k] for k in rows]), strict=True):
                out[k] = ids
        for k in order[short:]:
            out[k] = np.array(self._by_heap([*map(int, self.inner[np.frombuffer(words[k][:-1], np.uint8)]), int(self.last[words[k][-1]])]), "<u4").tobytes()
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; NEVER where two are not merged or one is missing (-1)."""
        key = left * (1 << 20) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (right >= 0), self.pair_ranks[at], NEVER)

    def _by_table(self, words: list[bytes]) -> list[bytes]:
        """Many words at once, a merge in each of them a step."""
        sizes = np.array([*map(len, words)])
        width = int(sizes.max())
        columns = np.arange(width)
        ids = np.full((len(words), width + 1), -1, np.int64)
        inside = columns < sizes[:, None]
        ids[:, :-1][inside] = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        ids[np.arange(len(words)), sizes - 1] = self.last[[w[-1] for w in words]]
        ranks = np.full((len(words), width + 1), NEVER, np.int64)
        ranks[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(words))
        while True:
            at = ranks[rows].argmin(1)
            best = ranks[rows, at]
            going = best < NEVER
            rows, at, best = rows[going], at[going], best[going]
            if not len(rows):
                break
            moved = np.minimum(columns + (columns > at[:, None]), width)  # what stands behind the pair moves up by one
            ids[rows, :-1] = np.take_along_axis(ids[rows], moved, 1)
            ids[rows, at] = self.pair_made[best]
            moved = np.minimum(columns + (columns >= at[:, None]), width)
            ranks[rows, :-1] = np.take_along_axis(ranks[rows], moved, 1)
            ranks[rows, at] = self._ranks(ids[rows, at], ids[rows, at + 1])
            second = at > 0
            row, left = rows[second], at[second] - 1
            ranks[row, left] = self._ranks(ids[row, left], ids[row, left + 1])
        held = ids >= 0
        raw = ids[held].astype("<u4").tobytes()
        stops = [0, *(4 * np.cumsum(held.sum(1))).tolist()]
        return [raw[a:b] for a, b in zip(stops, stops[1:])]

    def _by_heap(self, symbols: list[int]) -> list[int]:
        pairs, n = self.pairs, len(symbols)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(*hit, k, symbols[k], symbols[k + 1]) for k in range(n - 1) if (hit := pairs.get((symbols[k], symbols[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, made, k, a, b = heapq.heappop(heap)
            j = after[k]
            if symbols[k] != a or j < 0 or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[k], symbols[j], after[k] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right >= 0 and (hit := pairs.get((symbols[left], symbols[right]))):
                    heapq.heappush(heap, (*hit, left, symbols[left], symbols[right]))
        return [x for x in symbols if x >= 0]


def _byte_chars() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it is seen, else the next free one from 256."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in seen else next(free)) for b in range(256)]


def normal(text: str) -> str:
    """Composed and lower-cased, each character by itself: no final sigma."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def vocabulary(path: str) -> Vocabulary:
    return held(("vocabulary", path), lambda: Vocabulary(path))


def _common(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _State:
    __slots__ = ("edges", "final", "rest")

    def __init__(self):
        self.edges: list[list] = []  # byte, ids given out, target
        self.final, self.rest = False, ()


def compiled(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> np.ndarray:
    """The minimal acyclic transducer of words and their ids, as 32-bit numbers; words come sorted and differ.

    A word's states are settled once the next word leaves them: equal ones (same edges, outputs and end) become one. What an
    edge gives out is the common start of all that lies behind it; the rest moves down when a new word joins.

    Layout: states, edges, outputs, ids, root; then per edge state * 256 + byte (ascending), target, output; per state 1 +
    the output at a word's end, 0 where no word ends; per output its start, and the end of the last; the ids.
    """
    register: dict[tuple, int] = {}
    outputs: dict[tuple[int, ...], int] = {(): 0}
    settled: list[tuple] = []

    def settle(state: _State) -> int:
        edges = tuple((b, outputs.setdefault(tuple(out), len(outputs)), target) for b, out, target in state.edges)
        key = (edges, outputs.setdefault(tuple(state.rest), len(outputs)) + 1 if state.final else 0)
        number = register.setdefault(key, len(settled))
        if number == len(settled):
            settled.append(key)
        return number

    path, last = [_State()], b""
    for word, ids in entries:
        shared = _common(word, last)
        for k in range(len(last), shared, -1):
            path[k - 1].edges[-1][2] = settle(path.pop())
        for k in range(shared):
            edge = path[k].edges[-1]
            same = _common(edge[1], ids)
            moved, edge[1], ids = edge[1][same:], ids[:same], ids[same:]
            if moved:
                below = path[k + 1]
                below.rest = moved + below.rest if below.final else ()
                for e in below.edges:
                    e[1] = moved + e[1]
        for b in word[shared:]:
            path[-1].edges.append([b, ids, None])
            path.append(_State())
            ids = ()
        path[-1].final, path[-1].rest = True, ids
        last = word
    while len(path) > 1:
        done = settle(path.pop())
        path[-1].edges[-1][2] = done
    root = settle(path.pop())
    edges = [(number * 256 + b, target, out) for number, (es, _) in enumerate(settled) for b, out, target in es]
    starts = np.cumsum([0, *map(len, outputs)])
    pool = [x for out in outputs for x in out]
    head = [len(settled), len(edges), len(outputs), len(pool), root]
    columns = [*zip(*edges)] or [(), (), ()]
    return np.concatenate([np.asarray(x, np.uint32) for x in (head, *columns, [end for _, end in settled], starts, pool)])


class Transducer:
    """Looks words up in a compiled transducer, mapped into memory."""

    def __init__(self, flat: np.ndarray):
        states, edges, outputs, pool, self.root = map(int, flat[:5])
        parts = np.split(flat[5:], np.cumsum([edges, edges, edges, states, outputs + 1]))
        self.keys, self.targets, self.given, self.ends, self.starts, self.ids = parts
        self.size = (states, edges)

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        return cls(np.memmap(path, np.uint32, "r"))

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """Little-endian 32-bit ids of each word, None for words that are not held."""
        out: list[bytes | None] = [None] * len(words)
        kept = [k for k, w in enumerate(words) if 0 < len(w) <= WORD_BYTES]
        if not kept or not len(self.keys):
            return out
        sizes = np.array([len(words[k]) for k in kept])
        order = np.argsort(-sizes, kind="stable")  # the words that still walk stand first
        sizes, longest = sizes[order], int(sizes.max())
        grid = np.zeros((len(kept), longest), np.uint8)
        grid[np.arange(longest) < sizes[:, None]] = np.frombuffer(b"".join([words[kept[k]] for k in order.tolist()]), np.uint8)
        state = np.full(len(kept), self.root, np.uint32)
        alive = np.ones(len(kept), bool)
        taken = np.zeros((len(kept), longest + 1), np.uint32)
        for step in range(longest):
            n = int(np.searchsorted(-sizes, -step, "left"))  # words longer than step
            walking = np.flatnonzero(alive[:n])
            key = state[walking] * np.uint32(256) + grid[walking, step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            met = self.keys[at] == key
            alive[walking[~met]] = False
            walking, at = walking[met], at[met]
            state[walking], taken[walking, step] = self.targets[at], self.given[at]
        end = self.ends[state]
        found = np.flatnonzero(alive & (end > 0))
        taken[found, longest] = end[found] - 1
        given = taken[found].ravel()
        lengths = self.starts[given + 1] - self.starts[given]
        ends = np.cumsum(lengths, dtype=np.int64)
        spots = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(self.starts[given], lengths)
        raw = self.ids[spots].astype("<u4").tobytes()
        stops = [0, *(4 * ends.reshape(len(found), longest + 1)[:, -1]).tolist()]
        for row, a, b in zip(found.tolist(), stops, stops[1:]):
            out[kept[order[row]]] = raw[a:b]
        return out


class Encoder:
    """Encodes texts, each distinct part once while it stays in the cache: two generations, of which a full one becomes the older."""

    def __init__(self, voc: Vocabulary, lexicon: Transducer | None):
        self.voc, self.lexicon = voc, lexicon
        self.now: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.special = {b"\n" + t.encode("utf-8"): k.to_bytes(4, "little") for t, k in voc.special.items()}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if not texts:
            return []
        if len(self.now) > CACHE_ENTRIES:
            self.now, self.older = {}, self.now
        known, older = self.now, self.older
        known.update(self.special)
        names, numbers, sizes = self.voc.parts(texts)
        missing = {p for p in names if p not in known}
        known.update((p, older[p]) for p in missing & older.keys())
        new = [*(missing - older.keys())]
        known.update(self._parts(new))
        raw = [*map(known.__getitem__, names)]
        ids, lengths = np.frombuffer(b"".join(raw), "<u4"), np.array([*map(len, raw)], np.int64) // 4
        for p in new:
            if len(p) > CACHED_BYTES:
                del known[p]
        ends = np.concatenate([[0], np.cumsum(lengths[numbers])])
        spots = np.arange(ends[-1]) + np.repeat((np.cumsum(lengths) - lengths)[numbers] - ends[:-1], lengths[numbers])
        return np.split(ids[spots], ends[np.cumsum(sizes)[:-1]])

    def _parts(self, parts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        single = [p for p in parts if p.isalpha()]  # ASCII letters alone are one word
        given = [p for p in parts if p[:1] == b"\n"]
        mixed = [p for p in parts if not p.isalpha() and p[:1] != b"\n"]
        pieces = self.voc.pieces(mixed)
        words = {w: w.encode("utf-8") for w in set(pieces) - {"\n"}}
        raw = [*{*single, *words.values(), *(p[1:] for p in given)}]
        ids = self.lexicon.find(raw) if self.lexicon else [None] * len(raw)
        unseen = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(unseen, self.voc.merged([raw[k] for k in unseen]), strict=True):
            ids[k] = x
        of = dict(zip(raw, ids, strict=True))
        yield from zip(single, map(of.__getitem__, single))
        by_word = {"\n": PART_END, **{w: of[r] for w, r in words.items()}}
        yield from zip(mixed, b"".join(map(by_word.__getitem__, pieces)).split(PART_END))
        yield from ((p, of[p[1:]]) for p in given)


def bunched(batches: Iterator[dict]) -> Iterator[dict]:
    """Neighbouring lists by column as one, while they hold no more than TEXT_CHARS of text."""
    held: dict[str, list] = {}
    size = 0
    for part in batches:
        more = sum(len(t) for t in part["text"] if t)
        if held and size + more > TEXT_CHARS:
            yield held
            held, size = {}, 0
        held = {k: held.get(k, []) + v for k, v in part.items()}
        size += more
    if held:
        yield held


def word_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """word (UTF-8, of at most WORD_BYTES), n: how often each word stands in the texts of docs."""
    path = path or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        voc, parts, taken = vocabulary(path), Counter(), 0
        special = {b"\n" + t.encode("utf-8") for t in voc.special}

        def given() -> dict:
            words: Counter = Counter()
            mixed = {p: n for p, n in parts.items() if not p.isalpha() and p[:1] != b"\n"}
            times = iter(mixed.values())
            n = next(times, 0)
            for w in voc.pieces([*mixed]):
                if w == "\n":
                    n = next(times, 0)
                else:
                    words[w] += n
            rows = Counter({p[p[:1] == b"\n" :]: n for p, n in parts.items() if p not in mixed and p not in special and len(p) <= WORD_BYTES})
            rows.update({raw: n for w, n in words.items() if len(raw := w.encode("utf-8")) <= WORD_BYTES})
            parts.clear()
            return {"word": [*rows], "n": [*rows.values()]}

        for part in bunched(batches):
            names, numbers, _ = voc.parts(part["text"])
            parts.update(dict(zip(names, np.bincount(numbers, minlength=len(names)).tolist(), strict=True)))
            taken += sum(len(t) for t in part["text"] if t)
            if len(parts) > COUNTED_PARTS or taken > COUNTED_BYTES:
                yield given()
                taken = 0
        yield given()

    return map_lists(docs.select("text"), run, "word binary, n long", holds=True).groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, words: int = LEXICON_WORDS, path: str | None = None) -> str:
    """Compiles the most frequent words of docs, words of them at most, and sends the file to all executors; returns its name there."""
    spark, path = docs.sparkSession, path or tokenizer_path(VOCABULARY)
    level = F.floor(F.log2("n") * LEVELS).cast("int")
    counts = written(word_counts(docs, path).select("word", level.alias("level")))
    at_level = counts.groupBy("level").agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()  # LEVELS rows for each power of two
    total = list(itertools.accumulate(r["words"] for r in at_level))
    least = next((r["level"] + 1 for r, n in zip(at_level, total, strict=True) if n > words), 0)
    top = counts.where(F.col("level") >= least).select("word")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        voc = vocabulary(path)
        for part in batches:
            yield {"word": part["word"], "ids": voc.merged(part["word"])}

    merged = map_lists(top, run, "word binary, ids binary", holds=True).collect()  # words rows at most
    flat = compiled((w, tuple(array("I", ids))) for w, ids in sorted((bytes(r["word"]), bytes(r["ids"])) for r in merged))
    target = Path(tempfile.mkdtemp()) / f"lexicon-{uuid.uuid4().hex}"  # on the driver alone: addFile takes it from here
    flat.astype("<u4").tofile(target)
    spark.sparkContext.addFile(str(target))
    return target.name


def encoder(path: str, name: str | None) -> Encoder:
    """The worker's encoder; its cache lasts until another operator runs there."""
    return held(("bpe", path, name), lambda: Encoder(Vocabulary(path), Transducer.mapped(SparkFiles.get(name)) if name else None))


def encode(docs: DataFrame, name: str | None, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) of each row of docs (doc_id, text); name: of a lexicon, or None to merge all words."""
    path = path or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        e = encoder(path, name)
        for part in bunched(batches):
            ids = e.encode(part["text"])
            yield {"doc_id": part["doc_id"], "n_tokens": [*map(len, ids)], "ids": ids}

    return map_lists(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids array<int>", holds=True)


def decoded(ids: Iterable[int], tokens: dict[int, bytes]) -> bytes:
    """The tokens joined by spaces, as a vocabulary without a decoder is read; ids that are no token are left out."""
    try:
        return b" ".join(map(tokens.__getitem__, ids))
    except KeyError:
        return b" ".join(t for t in map(tokens.get, ids) if t is not None)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """key, text of rows (key, ids array<int>); null ids are none."""
    path = path or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        tokens = vocabulary(path).tokens
        for part in batches:
            yield {"key": part["key"], "text": [decoded(x or (), tokens).decode("utf-8") for x in part["ids"]]}

    return map_lists(rows.select("key", "ids"), run, f"key {rows.schema['key'].dataType.simpleString()}, text string", holds=True)


def digests(docs: DataFrame, name: str | None, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode and decode give, told in the task that makes it."""
    path = path or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        e = encoder(path, name)
        tokens = e.voc.tokens
        numbers = {k: b"%d" % k for k in tokens}
        for part in bunched(batches):
            told: tuple[list, list, list] = ([], [], [])
            for ids in map(np.ndarray.tolist, e.encode(part["text"])):
                told[0].append(len(ids))
                told[1].append(hashlib.sha256(b" ".join(map(numbers.__getitem__, ids))).hexdigest())
                told[2].append(hashlib.sha256(decoded(ids, tokens)).hexdigest())
            yield {"doc_id": part["doc_id"], "n_tokens": told[0], "ids_sha256": told[1], "decoded_sha256": told[2]}

    return map_lists(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", holds=True)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return digests(docs, lexicon(docs))
