"""Each operator against a brute-force version on a small table with awkward rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import chat, language, licenses, matroska, near_dedup, packing, pieces, quality_classifier, quality_rules, substring_dedup
from assayer.llm.common import crc_mod, lower_ascii, tokenizer_path
from assayer.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, score string"
LONG = " ".join(f"word{k} of the {k % 7}" for k in range(1500))
PASSAGE = " ".join(f"passage{k}" for k in range(60))


def _texts():
    base = " ".join(f"alpha{k} beta{k % 13}" for k in range(80))
    near = base.replace("alpha7 ", "gamma7 ")
    return [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one"), (9, LONG), (9, LONG),
        (10, f"before it {PASSAGE} after it"), (11, f"quite other words {PASSAGE} and a tail"), (12, "Straße ÉCOLE größer 漢字 \U0001f600 Ünï"),
        (13, "a b c d a b c a b c\na b c d a b c a b c\nx"), (14, "the ### $$$ %%% &&&"), (15, "Released under the MIT License.\nApache License cc-by CC BY"),
        (16, "<|im_end|><|endoftext|> text"), (17, base.upper()),
    ]


def _table(spark, rows):
    full = [(d, t, None if d % 5 == 0 else "en", None if d % 3 == 0 else f"src{d % 4}", len(t or ""), "x", 1, "y") for d, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return _table(spark, _texts()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _library(voc=None):
    """The library's processor; of a unigram reading of the pieces if asked for."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(tokenizer_path(pieces.VOCABULARY), "rb") as f:
        m.ParseFromString(f.read())
    if voc:
        m.trainer_spec.model_type = 1
        for _, k, score in voc.pieces:
            m.pieces[k].score = score
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


#: Texts that are hard to cut: no break at all, other scripts without spaces, marks that stand for spaces, runs of spaces.
HARD = [
    (None, "twice"), (None, "twice"), (2**53 + 1, "big id"), (30, "".join(chr(97 + k * k % 26) for k in range(3000))), (31, "a" * 500), (32, "漢字かな" * 200 + " Ünï " + "😀" * 90),
    (33, "  lead and trail  "), (34, "a▁b ▁ c"), (35, "x1y2z3" * 40), (36, "\t\n tab\x00nul"),
]


def test_pieces_equal_the_library(spark, docs):
    lib = _library()
    rows = _texts() + HARD
    table = docs.select("doc_id", "text").union(spark.createDataFrame(HARD, "doc_id long, text string"))
    want = Counter((d, len(ids := lib.encode(t or "")), np.array(ids, "<u4").tobytes()) for d, t in rows)
    for frequent in (10, 10_000):
        got = pieces.whole(pieces.encode(table, frequent=frequent)).collect()
        assert Counter((r["doc_id"], r["n_ids"], bytes(r["ids"])) for r in got) == want
        assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in got)
        assert {r["doc_id"] for r in got if not r["round_trip"]} == {34}  # its own marks come back as spaces
    digest = pieces.whole(pieces.encode(table, frequent=10, with_ids=False)).collect()
    assert Counter((r["doc_id"], r["n_ids"], r["ids_crc32"]) for r in digest) == Counter((r["doc_id"], r["n_ids"], r["ids_crc32"]) for r in got)
    ids = spark.createDataFrame([(k, lib.encode(t or "")) for k, (_, t) in enumerate(rows)] + [(-1, None)], "key long, ids array<int>")
    back = {r["key"]: r["text"] for r in pieces.decode(ids).collect()}
    assert back == {-1: "", **{k: lib.decode(lib.encode(t or "")) for k, (_, t) in enumerate(rows)}}


def test_units_of_a_batch_are_merged_at_once_and_texts_keep_one_row(spark):
    voc, rng = pieces.vocabulary(), np.random.default_rng(41)
    units = sorted({"▁" + "".join(rng.choice(list("aeinrst"), n)) for n in rng.integers(0, 40, 200)} | {"", "▁", "漢😀a", "1" * 62})
    long = pieces.LongUnits(voc)
    table = pieces.told(pieces.lattice(spark.createDataFrame([(u, 1) for u in units], "unit string, n long"), voc), voc)
    assert {r["unit"]: np.frombuffer(r["ids"], "<u4").tolist() for r in table.collect()} == {u: long.ids(u) for u in units}
    docs = spark.createDataFrame([(1, "once thntst xqzt and more of it"), (2, None)], "doc_id long, text string")
    rows = pieces.encode(docs, frequent=0, with_ids=False).collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"]) == [1, 2] and sum(r["one_at"] is not None for r in rows) == 7


def test_viterbi_equals_the_library_on_a_unigram_reading(spark):
    uni = pieces.unigram_reading(pieces.vocabulary())
    lib, scores = _library(uni), {k: s for _, k, s in uni.pieces}
    words = ["international", "thntst", "understanding of the matter", "Straße", "q" * 90 + "the" * 20]
    total = lambda ids: sum(scores[i] for i in ids)
    got = pieces.whole(pieces.encode(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), uni)).collect()
    for r in got:
        ids, want = np.frombuffer(r["ids"], "<u4").tolist(), lib.encode(words[r["doc_id"]])
        assert total(ids) == pytest.approx(total(want), abs=1e-3) and lib.decode(ids) == words[r["doc_id"]]


def test_packing_places_every_piece_without_gaps(docs):
    from tokenizers import Tokenizer

    rows = packing.pack(docs, capacity=64).toPandas()
    tok = Tokenizer.from_file(tokenizer_path(packing.VOCABULARY))
    want = Counter()
    for d, t in _texts():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            x = ids[k : k + 64]
            want[(d, k // 64, k, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))] += 1
    assert Counter(zip(rows.doc_id, rows.piece, rows.start, rows.length, rows.ids_crc32)) == want
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == np.concatenate([[0], np.cumsum(s.length)])[:-1].tolist() and s.length.sum() <= 64
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 64) + 1


def test_plan_is_best_fit():
    rng = np.random.default_rng(3)
    counts = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 101, 900), return_counts=True), strict=True)}
    room, opened = [], 0  # one piece at a time
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in room if r >= length]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - length)
            else:
                opened += 1
                room.append(100 - length)
    rows = packing.plan(counts, 100)
    assert max(r[3] + -(-(r[2] - r[1]) // r[4]) for r in rows) == opened
    assert sum(r[2] - r[1] for r in rows) == 900


def _base_counts(text):
    words = (text or "").encode().split()
    win = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if win[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    return len(words), sum(len(w.decode()) for w in words), sum(map((text or "").count, "#*$%&|<>")), len(lines), len(lines) - len(set(lines)), len(marked)


def test_quality_rules_counts_and_verdicts(docs):
    for d, t in _texts():
        assert quality_rules.measure(t) == _base_counts(t), d
    rows = quality_rules.judge(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if r["kept"])


def test_bad_hosts_lose_soft_failures_only(spark):
    words = " ".join(f"word{k}" for k in range(60))
    junk = " ".join(f"word{k}###" for k in range(60))
    rows = [(k, junk if k % 10 else words, "bad.example") for k in range(100)] + [(k, words, "good.example") for k in range(100, 300)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"] for r in got if not r["kept"]} == {k for k in range(100) if k % 10}


def test_beta_prior():
    a, b = quality_rules.beta_prior(2, 200, 100, 90 * 90 / 100 + 10 * 10 / 100)
    assert a == pytest.approx(b) and 0.5 < a + b < 20
    assert quality_rules.beta_prior(3, 30, 0, 0.0)[0] < 1e-2


def _sets(width):
    out = []
    for d, t in _texts():
        w = lower_ascii(t or "").split()
        k = min(width, len(w))
        out.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_all_pairs(docs, width):
    sets = _sets(width)
    label = {d: d for d, _ in sets}
    for _ in range(len(sets)):
        for a, x in sets:
            for b, y in sets:
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    got = near_dedup.near_duplicates(docs, width=width).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((d, len(s), label[d]) for d, s in sets)
    kept = near_dedup.keep_one(docs, width=width)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d in label if label[d] == d}


def test_links_across_components():
    rng = np.random.default_rng(1)
    base = np.arange(200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 180, replace=False), rng.integers(1000, 2000, 12).astype(np.uint64)])) for _ in range(40)]
    labels = np.array([k % 3 for k in range(40)])
    want = set()
    for x in range(40):
        for y in range(40):
            both = len(np.intersect1d(sets[x], sets[y]))
            if labels[x] != labels[y] and 100 * both >= 72 * (len(sets[x]) + len(sets[y]) - both):
                want.add(frozenset((x, y)))
    assert {frozenset(p) for p in near_dedup.links_across(sets, labels, labels != 1, 72)} == want and want


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(100, k) for k in range(101, 140)] + [(201, 202), (202, 203), (203, 201), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 1 for k in range(1, 31)}, **{k: 100 for k in range(100, 140)}, 201: 201, 202: 201, 203: 201}


def test_compact_windows_cover_each_subsequence_once():
    rng = np.random.default_rng(5)
    for h in (rng.integers(0, 50, 60).astype(np.uint64), np.zeros(40, np.uint64)):
        seen = Counter()
        for lo, c, hi in substring_dedup.compact_windows(h, 10):
            for i in range(lo, c + 1):
                for j in range(c, hi + 1):
                    if j - i + 1 >= 10:
                        seen[(i, j)] += 1
                        assert h[i : j + 1].min() == h[c]
        assert seen == Counter((i, j) for i in range(len(h)) for j in range(i + 9, len(h)))


def test_substring_dedup_equals_brute_force(docs):
    words = {d: lower_ascii(t or "").split() for d, t in _texts()}
    need, first = set(), {}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            key = tuple(words[d][i : i + 50])
            if first.setdefault(key, d) != d:
                need |= {(d, x) for x in range(i, i + 50)}
    rows = substring_dedup.duplicate_passages(docs).collect()
    got = {(r["doc_id"], x) for r in rows for x in range(r["first_word"], r["last_word"] + 1)}
    assert need <= got
    assert {r["doc_id"] for r in rows} == {2, 3, 11, 17}
    cut = substring_dedup.cut_duplicates(docs)
    left = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == docs.columns
    assert left[11]["text"] == "quite other words and a tail" and left[11]["n_chars"] == len(left[11]["text"])
    assert left[10]["text"] == dict(_texts())[10] and left[4]["text"] is None and 2 not in left


def test_near_copies_of_a_passage_are_found():
    rng = np.random.default_rng(9)
    a = rng.integers(0, 2**60, 300).astype(np.uint64)
    b = np.concatenate([rng.integers(0, 2**60, 40).astype(np.uint64), a[100:220], rng.integers(0, 2**60, 40).astype(np.uint64)])
    b[100] = 1
    found = substring_dedup.passages(substring_dedup.Side(a), substring_dedup.Side(b), [(110, 50)], 50, 80)
    assert [x[:4] for x in found] == [(100, 220, 40, 160)] and 0.8 <= found[0][4] < 1


def test_good_passages_next_to_loosely_similar_text_and_around_long_edits():
    rng = np.random.default_rng(14)
    own = lambda n: rng.integers(0, 2**60, n).astype(np.uint64)
    side, join = substring_dedup.Side, np.concatenate
    a = join([own(40), own(121), own(40)])
    b = a.copy()
    b[:40], b[161:], b[70] = own(40), own(40), 1
    b[101:161:6] = own(10)  # every sixth word differs after 61 with one edit
    for seed in ((45, 45), (80, 80)):
        f, t, g, u, s = substring_dedup.passages(side(a), side(b), [seed], 50, 80)[0]
        assert (f, g) == (40, 40) and t == u >= 101 and s >= 0.8
    left, right = own(40), own(40)
    a, b = join([own(30), left, right, own(30)]), join([own(20), left, own(7), right, own(20)])
    for seed in ((35, 25), (75, 72)):
        found = substring_dedup.passages(side(a), side(b), [seed], 50, 80)
        assert [x[:4] for x in found] == [(30, 110, 20, 107)] and found[0][4] >= 0.8


def test_every_place_of_a_key_gets_a_seed_against_another_batch(spark):
    one, two = (1, np.array([7]), np.array([3])), (2, np.array([7] * 4), np.array([10, 90, 150, 300]))
    for batches in ([[one], [two]], [[one, two]]):
        met = [r for found in batches for r in substring_dedup._met(found).to_pylist()]
        pairs = substring_dedup.linked(spark.createDataFrame(met, substring_dedup.MET)).collect()
        assert [(r["a"], r["b"], sorted(x >> 32 for x in r["seeds"])) for r in pairs] == [(2, 1, [10, 90, 150, 300])]


def test_no_near_copy_is_missed(spark):
    rng = np.random.default_rng(16)
    other = lambda n: [f"o{k}" for k in rng.integers(0, 2**40, n)]
    rows = []
    for _ in range(600):
        one = other(51)
        rows += [other(40) + one + other(40), other(40) + one[:25] + other(1) + one[26:] + other(40)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    found = {(r["doc_id"], r["of_doc_id"]) for r in substring_dedup.duplicate_passages(docs).collect()}
    assert found == {(k + 1, k) for k in range(0, 1200, 2)}


def test_passages_beside_a_hot_line_are_found(spark):
    rng = np.random.default_rng(12)
    hot = [f"hot{k}" for k in range(45)]
    other = lambda n: [f"o{k}" for k in rng.integers(0, 2**40, n)]
    rows = [other(60) + hot + other(60) for _ in range(12)]
    for _ in range(40):
        own = other(5)
        rows += [other(60) + hot + own + other(60) for _ in range(2)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    found = {(r["doc_id"], r["of_doc_id"]) for r in substring_dedup.duplicate_passages(docs).collect() if r["first_word"] == 60 and r["last_word"] == 109}
    assert found == {(k + 1, k) for k in range(12, 92, 2)}


def test_near_copies_with_an_edit_in_each_window_are_found_beside_a_line_of_many(spark):
    rng = np.random.default_rng(21)
    other = lambda n: [f"o{k}" for k in rng.integers(0, 2**40, n)]
    line, before, after = other(30), other(22), other(22)
    rows = [other(40) + line + other(40) for _ in range(20)]
    rows += [other(60) + before + other(1) + line + other(60), other(9) + line + other(1) + after + other(40)]
    rows += [other(40) + line + other(40) for _ in range(20)]
    rows += [other(30) + before + other(1) + line + other(30), other(20) + line + other(1) + after + other(30), other(40) + line + other(40)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    found = {(r["doc_id"], r["first_word"], r["last_word"], r["of_doc_id"]) for r in substring_dedup.duplicate_passages(docs).collect()}
    assert found == {(42, 30, 82, 20), (43, 20, 72, 21)}


def test_places_of_a_key_meet_across_blocks_as_within_one(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_ROWS", 7)
    test_near_copies_with_an_edit_in_each_window_are_found_beside_a_line_of_many(spark)


def test_places_of_a_run_meet_by_its_ends(spark):
    rng = np.random.default_rng(23)
    other = lambda n: [f"o{k}" for k in rng.integers(0, 2**40, n)]
    before, after = other(30), other(30)
    docs = [other(20) + before + ["the"] * n + after + other(20) for n in (40, 43, 60, 45)] + [other(30) + ["the"] * n + other(30) for n in (48, 300, 400, 44)]
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    seeds = substring_dedup.judged(frame, substring_dedup.linked(substring_dedup.windows(frame, 50, 80)), 50, 80, True).where("gram IS NOT NULL").collect()
    places = {}
    for r in seeds:
        for doc, at in ((r["a"], r["i"]), (r["b"], r["j"])):
            places.setdefault((r["gram"], doc), set()).add(at)
    assert max(map(len, places.values())) == 2  # before: each place of a run by itself
    pairs, reached = {(r["doc_id"], r["of_doc_id"]) for r in substring_dedup.duplicate_passages(frame).collect()}, {0}
    for _ in docs:
        reached |= {x for p in pairs for x in p if set(p) & reached}
    assert reached == {0, 1, 2, 3, 5, 6}


def test_rows_of_one_doc_id_with_other_texts(spark):
    words = [f"w{k}" for k in range(200)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words)), (1, " ".join(words[:20]))], "doc_id long, text string")
    assert {(r["doc_id"], r["of_doc_id"], r["last_word"]) for r in substring_dedup.duplicate_passages(docs).collect()} == {(1, 0, 199)}


def test_only_pairs_without_a_passage_are_left_unverified(monkeypatch):
    rng = np.random.default_rng(29)
    line, told = rng.integers(1, 2**60, 26), []
    base = rng.integers(1, 2**60, 240)
    base[100:126] = line
    for _ in range(60):
        row = base.copy()
        edited = np.flatnonzero(rng.random(240) < rng.choice([0.02, 0.04, 0.08]))
        row[edited] = rng.integers(1, 2**60, len(edited))
        row[100:126] = line
        if rng.random() < 0.5:  # shingles that repeat
            row[140:170] = row[140]
        told.append(row[: rng.integers(150, 240)].astype(np.uint64))
    nodes, n = np.arange(60), 60
    links = lambda: substring_dedup.class_links(np.arange(n), nodes, nodes, told, np.full(n, 100), np.ones(n, bool), 50, 80)
    here = links()
    seen, possible = [], substring_dedup.Contexts.possible
    monkeypatch.setattr(substring_dedup.Contexts, "possible", lambda self, x, ys, percent: seen.append((len(ys), len(possible(self, x, ys, percent)))) or ys)
    assert here and links() == here
    assert sum(b for _, b in seen) < sum(a for a, _ in seen)


def test_seeds_without_a_passage_are_not_followed(monkeypatch):
    rng = np.random.default_rng(31)
    a, b = (rng.integers(1, 2**60, 400).astype(np.uint64) for _ in range(2))
    a[100:120], a[300:320] = b[50:70], b[200:220]  # alike for 20 words, nothing beside them
    followed, stops = [], substring_dedup._stops
    monkeypatch.setattr(substring_dedup, "_stops", lambda *args: followed.append(args[2:4]) or stops(*args))
    assert not substring_dedup.passages(substring_dedup.Side(a), substring_dedup.Side(b), [(100, 50), (300, 200)], 50, 80) and not followed
    for _ in range(100):
        x, y = (substring_dedup.Side(rng.integers(0, 4, n).astype(np.uint64)) for n in rng.integers(5, 60, 2))
        least, percent, grams = int(rng.integers(5, 30)), int(rng.choice([60, 80, 90])), x.grams[0].tolist()
        worth = [100 - percent if g in y.grams[0] else 0 if g in grams[:k] else -2 * percent for k, g in enumerate(grams)]
        sums, n = np.append(0, np.cumsum(worth)), len(grams)
        hope = x.hope(y, np.arange(n), least, percent)
        for at in range(n):
            every = [sums[t] - sums[f] for f in range(at + 1) for t in range(max(at + 1, f + least - 4), n + 1)]
            assert hope[at] == max(every) if every else hope[at] < -(1 << 50)


def test_fewest_and_inside_count_distinct_shingles():
    rng = np.random.default_rng(37)
    words = [rng.integers(1, 2**60, n).astype(np.uint64) for n in (216, 170, 216, 130)]
    words[1][120:150], words[2][60:80] = words[1][120], words[2][40:60]
    at = np.array([100, 100, 100, 60])
    found = substring_dedup.Contexts(words, at, 50, 16)
    assert found.again.tolist() == [1, 2]
    shingles = lambda w, f, t: len({tuple(w[k : k + 5]) for k in range(f, t - 4)})
    for left, right in ((0, 0), (3, 1), (3, 2), (0, 49), (40, 16), (49, 49)):
        got = found.inside(np.arange(4), np.full((4, 4), left), np.full((4, 4), right))
        assert got.tolist() == [[shingles(w, a - left, a + right)] * 4 for w, a in zip(words, at, strict=True)]
    assert found.fewest.tolist() == [min(shingles(w, a - k, a - k + 50) for k in range(35)) for w, a in zip(words, at, strict=True)]


def test_what_was_shuffled_for_a_written_table_goes_at_once(spark):
    from assayer.llm.common import written

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    before = shuffled()
    table = written(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert not shuffled() - before and table.count() == 7


def test_risk_and_prior_against_brute_force(spark):
    rng = np.random.default_rng(11)
    n, d = 4000, 6
    good = rng.random(n) < 0.7
    x = np.hstack([np.ones((n, 1)), rng.normal(size=(n, d)) + good[:, None] * 1.2])
    known = np.flatnonzero(good)[:900]
    u, p = x.T @ x / n, x[known].T @ x[known] / len(known)

    def risk(w, prior):  # row by row
        g = x @ w
        negative = ((1 + g) ** 2).mean() / 4 - prior * ((1 + g[known]) ** 2).mean() / 4
        return prior * ((1 - g[known]) ** 2).mean() / 4 + max(0.0, negative) + quality_classifier.RIDGE * (w @ w), negative

    for prior in (0.3, 0.7, 0.95):
        w = quality_classifier.minimise(u, p, prior)
        least, negative = risk(w, prior)
        assert negative > -1e-4
        for size in (1e-3, 1e-2, 0.1):
            assert all(risk(w + size * rng.normal(size=d + 1), prior)[0] >= least - 1e-5 for _ in range(200))
    assert quality_classifier.weighted(u, p, 0.95, 1.0)[1] < 0 < quality_classifier.weighted(u, p, 0.3, 1.0)[1]  # the clamp acts on one of them
    g = x @ quality_classifier.weighted(u, p, 0.5, 1.0)[0]
    counts = Counter()
    for kind, rows in ((0, range(n)), (1, np.flatnonzero(good)[900:])):
        counts.update((kind, int(k)) for k in np.searchsorted(quality_classifier.GRID, g[rows]))
    prior = quality_classifier.class_prior(counts)
    assert abs(prior - good.mean()) < 0.08
    above = g > quality_classifier.threshold(counts, prior)
    assert (above == good).mean() > 0.9


def test_moments_equal_sums_over_rows(spark):
    rng = np.random.default_rng(12)
    width = len(quality_classifier.MEASURES) + 2 * quality_classifier.BUCKETS
    x = rng.random((50, width)).astype(np.float32).astype(float)
    y = [None, 1, 2, 1, None] * 10
    rows = spark.createDataFrame([(list(map(float, a)), b) for a, b in zip(x, y, strict=True)], "x array<float>, y int").repartition(3)
    edges = [[0.3, 0.6]] * len(quality_classifier.MEASURES)
    mean, n = quality_classifier.moments(rows, edges)
    c = quality_classifier.columns_of(x, edges)
    assert n == {"u": 50, "p": 20, "q": 10} and np.allclose(mean["u"], c.T @ c / 50)
    good = c[[k for k in range(50) if y[k] == 1]]
    assert np.allclose(mean["p"], good.T @ good / 20)


def test_quality_classifier_on_held_out_rows(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for k in range(600):
        n = int(rng.integers(60, 200))
        picked = list(rng.choice(words, n))
        bad = k % 5 == 0
        rows.append((k, " ".join(f"{w}###" if bad else w for w in picked)))
        if k % 2:
            labels.append((k, int(not bad)))
    rows += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality_classifier.scored(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    held = [k for k in range(0, 600, 2)]
    assert np.mean([(got[k] >= 0.5) == bool(k % 5) for k in held]) > 0.97
    assert len(got) == 602 and all(0 <= s <= 1 for s in got.values())
    none = quality_classifier.scored(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(none) == 602


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    t, lengths = rng.normal(size=(3, 3)), [1, 5, 0, 6]
    s = rng.normal(size=(12, 3))
    got, at = language.forward_backward(s, t, lengths), 0
    for n in lengths:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(sum(s[at + k, y] for k, y in enumerate(path)) + sum(t[a, b] for a, b in itertools.pairwise(path)))
            for k, y in enumerate(path):
                want[k, y] += w
        if n:
            assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n
    long = rng.normal(size=(300, 3))  # across blocks: against the plain recursion
    alpha, beta = np.zeros((300, 3)), np.ones((300, 3))
    alpha[0] = np.exp(long[0])
    for k in range(1, 300):
        alpha[k] = alpha[k - 1] @ np.exp(t) * np.exp(long[k])
        alpha[k] /= alpha[k].sum()
    for k in range(298, -1, -1):
        beta[k] = np.exp(t) @ (np.exp(long[k + 1]) * beta[k + 1])
        beta[k] /= beta[k].sum()
    want = alpha * beta
    assert np.allclose(language.forward_backward(long, t, [300]), want / want.sum(axis=1, keepdims=True))


def test_language_of_held_out_and_awkward_rows(spark):
    rng = np.random.default_rng(4)
    stems = {"aa": ["the", "and", "thing", "with"], "bb": ["der", "und", "nicht", "über"]}
    rows = [(k, " ".join(rng.choice(stems[x], 30)), x) for k in range(120) for x in [("aa", "bb")[k % 2]]]
    rows += [(500, None, "aa"), (501, "", None), (502, "123 !!", "aa"), (503, "der und the and " * 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    may = crc_mod(F.col("doc_id"), 4) != 2
    got = {r["doc_id"]: r for r in language.identify(docs, may).collect()}
    assert all(got[k]["lang_pred"] == ("aa", "bb")[k % 2] for k in range(120))
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (500, 501, 502))
    kept = language.keep_known(docs, may)
    assert {r["doc_id"] for r in kept.collect()} >= set(range(120)) and not {500, 501, 502} & {r["doc_id"] for r in kept.collect()}
    assert language.identify(docs.where("lang IS NULL"), may).where("lang_pred != 'und'").count() == 0


def test_matroska_round_trip_and_lacing():
    for n in (0, 1, 63, 64, 65, 511, 512, 2048, 2049, 70_000):
        text = "x" * n
        payload, size = matroska.payload_of(text)
        assert size == n and len(payload) % 64 == 0 and payload
        data = matroska.mux(payload)
        table = matroska.packets(data)
        assert b"".join(data[a : a + k] for _, _, _, a, k in table) == payload
        assert [t for _, t, _, _, _ in table] == [k * 512 * 125_000 for k in range(len(table))]
        segment = next(at for ident, at, _, _ in matroska.elements(data) if ident == matroska.SEGMENT)
        for _, at in matroska.cue_points(data):
            assert data[segment + at : segment + at + 4] == matroska.CLUSTER.to_bytes(4, "big")
    frames = [b"a" * 300, b"b" * 255, b"c" * 7, b"d" * 9]
    xiph = bytes([3, 255, 45, 255, 0, 7]) + b"".join(frames)
    assert matroska.frame_sizes(xiph, 0, len(xiph), 1)[0] == [300, 255, 7, 9]
    ebml = matroska.laced(frames)
    assert matroska.frame_sizes(ebml, 0, len(ebml), 3)[0] == [300, 255, 7, 9]
    assert matroska.frame_sizes(bytes([1]) + b"x" * 8, 0, 9, 2)[0] == [4, 4]
    with pytest.raises(ValueError):
        matroska.packets(b"\x00\x00")
    cluster = lambda k: matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + matroska.element(matroska.CLUSTER_TIME, k) + matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00\x00\x80" + b"x")
    live = matroska.element(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + b"".join(map(cluster, range(3000)))
    assert [t for _, t, _, _, _ in matroska.packets(live)] == [k * 1_000_000 for k in range(3000)]
    assert max(depth for *_, depth in matroska.elements(live)) == 2


def test_media_of_documents(docs):
    files = matroska.media(docs)
    rows = matroska.digests(files).collect()
    texts = Counter()
    for d, t in _texts():
        raw = (t or "").encode()
        raw += bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        texts[(d, len((t or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == texts
    assert matroska.with_packets(files).where(F.size("packets") == 0).count() == 0


def test_license_scan(docs):
    rows = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    hit = rows[15]
    assert (hit["n_base"], hit["first_word"], hit["last_word"]) == (4, 3, 9)
    assert hit["base_labels"] == "apache,cc-by,mit" and "mit-notice" in hit["labels"].split(",")
    assert rows[4]["n_words"] == 0 and rows[4]["first_word"] is None and rows[4]["labels"] == "" and rows[4]["score"] == 0
    assert licenses.tokens("A-b É1\x00Z") == ["a".encode(), b"b", "É1".encode(), b"z"]


def test_wrapped_notices_are_found(spark):
    text = licenses.TEMPLATES["mit-grant"].split()
    wrapped = "Some words before\n" + "\n".join(" ".join(text[k : k + 9]) for k in range(0, len(text), 9)) + "\nand after"
    apart = "\n\n\n\n\n".join(text)
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame([(1, wrapped), (2, apart)], "doc_id long, text string")).collect()}
    assert "mit-grant" in got[1].split(",") and "mit-grant" not in got[2].split(",")


def test_turns_of_one_number_are_ordered_by_their_raw_texts(spark):
    rows = [(1, 0, "user", "<a"), (1, 0, "user", "<|x"), (1, 0, "user", "<a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(df.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    turns = chats.select(chat.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [t["text"] for t in turns] == sorted(r[3] for r in rows)


def test_chat_round_trip_and_mask(spark):
    rows = [(1, 0, "user", "hi <|im_end|> <\\|x <| <\\\\|"), (1, 1, "assistant", "<|im_start|>assistant\nno"), (1, 2, "assistant", None), (1, 3, "we%ird<\n", "x"), (2, 0, None, ""), (None, 0, "assistant", "é\U0001f600")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(df.select("conv_id", "turn", "role", chat.text_parts(F.coalesce("text", F.lit(""))).alias("parts")))
    got = {r["conv_id"]: r for r in chats.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [(r[2] or "", r[3] or "") for r in rows[:4]]
    assert got[1]["loss"] == ["<|im_start|>assistant\nno", ""] and got[None]["loss"] == ["é\U0001f600"] and got[2]["loss"] == []


def test_chat_parts(spark):
    content = '[{"type":"text","text":"see"},{"type":"image","ref":"a.png","units":2},{"type":"audio","ref":"b.wav","units":1.5},{"text":"end"}]'
    df = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", "[not json")], "conv_id long, turn long, role string, content string")
    r = chat.format_chats(df.select("conv_id", "turn", "role", chat.json_parts(F.col("content")).alias("parts"))).first()
    assert "see<|image|><|audio|>end" in r["formatted"] and "[not json" in r["formatted"]
    assert [(x["type"], x["ref"], x["tokens"]) for x in r["attachments"]] == [("image", "a.png", 512), ("audio", "b.wav", 38)]
    assert r["expanded_tokens"] == 550


def test_empty_tables(spark, empty):
    assert packing.pack(empty).count() == 0
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert substring_dedup.cut_duplicates(empty).count() == 0
    assert matroska.digests(matroska.media(empty)).count() == 0
    assert licenses.scan(empty).count() == 0
    assert pieces.encode(empty).count() == 0
    assert language.identify(empty, F.lit(True)).count() == 0
    assert quality_classifier.scored(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_large_ids_beside_nulls_stay_exact(spark):
    text = " ".join(f"w{k}" for k in range(60))
    ids = [2**53 + 1, None, 2**53 + 3, None]
    docs = spark.createDataFrame([(d, f"{text} {k}", "en", "s", 1) for k, d in enumerate(ids)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    labels = spark.createDataFrame([(2**53 + 1, 1)], "doc_id long, quality int")
    given = [
        pieces.whole(pieces.encode(docs)), packing.pack(docs), quality_rules.judge(docs), quality_classifier.scored(docs, labels),
        language.identify(docs, F.lit(True)), matroska.digests(matroska.media(docs)), licenses.scan(docs),
    ]
    for out in given:
        assert Counter(r["doc_id"] for r in out.collect()) == Counter(ids)
    for out in (near_dedup.near_duplicates(docs), near_dedup.keep_one(docs).where("doc_id IS NOT NULL"), substring_dedup.cut_duplicates(docs).where("doc_id IS NOT NULL")):
        assert {r["doc_id"] for r in out.collect()} <= {2**53 + 1, 2**53 + 3}
    chats = chat.format_chats(spark.createDataFrame([(d, 0, "user", "x") for d in ids[:3]], "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    assert {r["conv_id"] for r in chats.collect()} == set(ids)


def test_columns_that_clash_with_ours_come_back(spark, docs):
    odd = docs.withColumns({c: F.lit("mine") for c in ("_host", "_failed", "_rejected", "_id", "_spans", "component_id", "key")})
    for out in (quality_rules.keep(odd), near_dedup.keep_one(odd), substring_dedup.cut_duplicates(odd), language.keep_known(odd, F.lit(True))):
        assert out.columns == odd.columns and all(r["_host"] == r["_spans"] == r["_id"] == "mine" for r in out.collect())


def test_rows_without_an_id(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(None, text), (1, text), (2, text)], "doc_id long, text string")
    assert {r["doc_id"] for r in near_dedup.keep_one(docs).collect()} == {None, 1}
    left = {r["doc_id"]: r["text"] for r in substring_dedup.cut_duplicates(docs).collect()}
    assert left == {None: text, 1: text}
    assert packing.pack(docs).where("doc_id IS NULL").count() == 1
    assert licenses.scan(docs).where("doc_id IS NULL").count() == 1
    assert matroska.digests(matroska.media(docs)).where("doc_id IS NULL").count() == 1


def test_the_viterbi_table_is_not_made_again_for_each_segment(spark):
    uni = pieces.unigram_reading(pieces.vocabulary())
    found = pieces.folded(pieces.lattice(spark.createDataFrame([("▁the", 1), ("", 1)], "unit string, n long"), uni), uni)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("array_max(") < plan.index("array(length(")  # made outside of the fold that goes back along it


def test_a_workers_cache_of_ids_holds_half_a_million_words():
    e, asked = packing.Encoder(packing.tokenizer_path(packing.VOCABULARY)), []
    e._ids = lambda texts: asked.append(len(texts)) or [b""] * len(texts)
    texts = [" ".join(f"w{k}" for k in range(at, at + 100_000)) for at in (*range(0, 500_000, 100_000), 0)]
    for t in texts:
        e.encode([t])
    assert sum(asked) == 500_000
