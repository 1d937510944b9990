"""Operators that compare or count across documents, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from floorlens.llm import bm25_search, bwt, class_lm, near_dedup, suffix_dedup

DOC = "doc_id long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = r"[^\x20\x09-\x0D]+"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def clashing(df):
    names = ["row_id", "text_key", "runs", "kept", "n_bytes", "label", "node", "id", "score", "query", "rank"]
    return df.withColumns({n: F.lit("x") for n in names})


def words(rng, n, letters="abcdefghij"):
    return ["".join(rng.choice(list(letters), 3)) for _ in range(n)]


def test_prefix_classes():
    rng = np.random.default_rng(3)
    for _ in range(80):
        alphabet, least = int(rng.integers(1, 5)), int(rng.integers(1, 12))
        strings = [rng.integers(1, alphabet + 1, rng.integers(0, 40)) for _ in range(rng.integers(1, 8))]
        if rng.random() < 0.5:
            strings.append(strings[0].copy())
        cls, owner, offset = bwt.common_prefix_classes(np.concatenate(strings), np.array([len(s) for s in strings]), least)
        got, want = {}, {}
        for c, o, p in zip(cls.tolist(), owner.tolist(), offset.tolist(), strict=True):
            got.setdefault(c, []).append((o, p))
        for i, s in enumerate(strings):
            for j in range(len(s) - least + 1):
                want.setdefault(tuple(s[j : j + least]), []).append((i, j))
        assert sorted(map(sorted, got.values())) == sorted(want.values())


def brute_removed(rows, width):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = True
        gone = gone[:-1]
        spans = int((np.diff(gone.astype(int), prepend=0) > 0).sum())
        out.append((len(d), int(gone.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("crowd", [1000, 2])
def test_suffix_dedup_is_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = np.random.default_rng(8)
    width = suffix_dedup.WIDTH
    passage = " ".join(words(rng, 130, "abcdé"))
    rows = [(i, " ".join(words(rng, int(rng.integers(0, 60)))) + passage[int(rng.integers(0, 40)) : 440 + 6 * i] + " ".join(words(rng, 30))) for i in range(12)]
    rows += [(20, None), (21, ""), (22, passage[:390]), (23, "a" * 1500), (24, "ab" * 300), (25, passage * 3), (None, passage)]
    rows += [(26, rows[0][1]), (26, rows[0][1]), (27, "x" * (width - 1)), (28, passage[:width]), (28, "other text")]
    got = suffix_dedup.without_repeats(clashing(docs(spark, rows))).collect()
    want = Counter((k, *x) for (k, _), x in zip(rows, brute_removed(rows, width), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert suffix_dedup.digests(docs(spark, rows).where("false")).collect() == []
    kept = {r.doc_id: r.text for r in suffix_dedup.cut(docs(spark, rows)).where("doc_id < 26").collect()}
    assert kept[20] is None and kept[21] == "" and 23 not in kept and 25 not in kept


def test_anchors_of_long_texts(monkeypatch):
    """Texts beyond one stretch, or with one byte only, keep every window."""
    monkeypatch.setattr(suffix_dedup, "STRETCH", 500)
    data = np.frombuffer(b"a" * 900 + bytes(np.random.default_rng(0).integers(97, 123, 2000).astype(np.uint8)), np.uint8)
    place, _, first, last = suffix_dedup.anchors(data, np.array([0, 700, len(data)]), 400)
    covered = sorted(s for a, b in zip(first, last, strict=True) for s in range(a, b + 1))
    assert covered == [*range(301), *range(700, len(data) - 399)]
    assert ((place >= first) & (place + suffix_dedup.GRAM <= last + 400) & (place - first <= 384)).all()


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(SPACED, (t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = of[i], of[j]
                of = [b if x == a else x for x in of]
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(of[i], []).append(k)
    return Counter((k, len(s), c := min((x for x in least[o] if x is not None), default=None), k == c) for (k, _), s, o in zip(rows, sets, of, strict=True))


@pytest.mark.parametrize("more", [64, 2])
def test_near_duplicates_are_brute_force(spark, monkeypatch, more):
    monkeypatch.setattr(near_dedup, "MORE_PIVOTS", more)
    rng = np.random.default_rng(6)
    rows, key = [], 100
    for size in (40, 80, 160):
        base = words(rng, size)
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9, 12):
            copy = list(base)
            for at in rng.integers(0, size, edits):
                copy[at] = "zz" + str(rng.integers(1000))
            rows.append((key := key - 1, " ".join(copy)))
    chain = words(rng, 120)
    rows += [(200 + i, " ".join(chain[4 * i : 4 * i + 60])) for i in range(12)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one two"), (304, "ONE  two"), (305, "one"), (306, "w " * 20_000)]
    rows += [(307, rows[0][1].upper()), (307, rows[0][1].upper()), (None, rows[5][1]), (None, "lonely words in a row here")]
    got = near_dedup.near_duplicates(clashing(docs(spark, rows))).collect()
    want = brute_components(rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert near_dedup.near_duplicates(docs(spark, rows).where("false")).collect() == []
    left = [r.doc_id for r in near_dedup.one_of_each(docs(spark, rows)).collect()]
    assert sorted(x for x in left if x is not None) == sorted({k for k, _, _, kept in want if kept and k is not None})


def test_sketch_keeps_linked_pairs():
    """Pairs at similarity 0.75 agree on enough bits and share a band."""
    rng = np.random.default_rng(9)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 800).astype(np.uint64)
        one, other = near_dedup.min_max(pool[:700]), near_dedup.min_max(pool[100:])
        agreed = 192 - sum(int(x).bit_count() for x in (near_dedup.sketch(one) ^ near_dedup.sketch(other)).view(np.uint64))
        assert agreed >= near_dedup.AGREED
        assert (near_dedup.bands(one) == near_dedup.bands(other)).any()
        apart = sum(int(x).bit_count() for x in (near_dedup.parities(pool[:700]) ^ near_dedup.parities(pool[100:])).view(np.uint64))
        assert 0 < apart <= 200


def test_bands_of_small_sets_agree_like_those_of_large_ones():
    """Texts of 7 and 8 words at similarity 0.75: a band agrees with (3/4)^4."""
    rng = np.random.default_rng(4)
    agreed = []
    for _ in range(2000):
        pool = rng.integers(0, 1 << 63, 4).astype(np.uint64) << np.uint64(1)
        agreed.append((near_dedup.bands(near_dedup.min_max(pool[:3])) == near_dedup.bands(near_dedup.min_max(pool))).mean())
    assert abs(np.mean(agreed) - 0.75**4) < 0.01


def test_class_lm_base_scores(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(rng.choice(words(np.random.default_rng(i % 3), 30), 25))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "A  a\tB"), (73, "only here " * 3000), (7, rows[7][1]), (None, "the null one")]
    held = [k is not None and zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in rows]
    tokens = [[*re.findall(SPACED, (t or "").translate(LOW)), None] for _, t in rows]
    counts = Counter(w for h, t in zip(held, tokens, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for (k, _), h, t in zip(rows, held, tokens, strict=True):
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        want[k, h, len(t), sum(counts[w] > 0 for w in t), n, round(base, 4)] += 1
    got = class_lm.score(clashing(docs(spark, rows))).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and np.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens)) for r in got)
    unseen = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 60]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert class_lm.score(docs(spark, rows).where("false")).collect() == []
    alone = class_lm.score(docs(spark, rows).where("doc_id = 71" if held[61] else "doc_id = 70")).collect()
    assert len(alone) == 1


@pytest.mark.parametrize("near", [1 << 16, 40, 1])
def test_class_lm_scores_are_those_of_its_classes(spark, monkeypatch, near):
    """All words have a class; counts, bigrams and sums are those of a plain
    model with these classes, wherever the table of frequent words ends."""
    monkeypatch.setattr(class_lm, "NEAR", near)
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(words(rng, 40, "abcd") + words(rng, 3))) for i in range(40)] + [(50, None), (51, "new " * 700), (52, "abc"), (52, "abc"), (None, "abc abd")]
    training = [(k, t) for k, t in rows if k is None or zlib.crc32(str(k).encode()) % 5 != 1]
    model, classes = class_lm.fit(docs(spark, training).select("text"))
    batch = lambda t: pa.RecordBatch.from_arrays([pa.array([t], pa.string())], ["text"])
    own = dict(zip(model.near.code.tolist(), model.of.tolist(), strict=False))
    other = {r.word % (1 << 64): r.cls for r in classes.collect()}
    counts, step, into, prev = Counter(), Counter(), Counter(), Counter()

    def tokens(t):
        _, code, group, _ = class_lm._tokens(batch(t))
        code = code.tolist()
        rest = model.of[len(model.near.code) + np.maximum(group, 0)].tolist()
        before = [own.get(c, r) for c, r in zip(code, rest, strict=True)]
        return [(c, b, own.get(c, other.get(c, r))) for c, b, r in zip(code, before[-1:] + before[:-1], rest, strict=True)]

    for _, t in training:
        for c, b, k in tokens(t):
            counts[c] += 1
            step[b, k] += 1
            into[k] += 1
            prev[b] += 1
    assert set(counts) == set(own) | set(other) and len(own) == min(near, len(counts))
    members = Counter((own | other)[c] for c in counts)
    share = {k: (into[k] + 1) / (sum(into.values()) + class_lm.CLASSES) for k in range(class_lm.CLASSES)}
    want = Counter()
    for key, t in rows:
        total = 0
        for c, b, k in tokens(t):
            total += math.log10((step[b, k] + class_lm.PULL * share[k]) / (prev[b] + class_lm.PULL))
            total += math.log10((counts[c] + 0.5) / (into[k] + 0.5 * (members[k] + 1)))
        want[key, round(total, 4)] += 1
    assert Counter((r.doc_id, round(r.score, 4)) for r in class_lm.score(docs(spark, rows)).collect()) == want


def test_gains_are_likelihoods():
    rng = np.random.default_rng(5)
    table = rng.integers(0, 60, (class_lm.CLASSES, class_lm.CLASSES))
    for most in (3, 60):
        left, right = (np.bincount(rng.integers(0, 20, 5), rng.integers(1, most, 5), class_lm.CLASSES).astype(np.int64) for _ in range(2))
        with_word = table.copy()
        with_word[:, 30] += left
        with_word[30] += right
        moved = table.copy()
        moved[:, 40] += left
        moved[40] += right
        slot = np.flatnonzero(np.concatenate((left, right)))
        row, v = np.zeros(len(slot), np.int64), np.concatenate((left, right))[slot]
        change = class_lm._likelihood(moved) - class_lm._likelihood(with_word)
        enter = class_lm.Gains(table)(1, row, slot, v)[0]
        move = class_lm.Gains(with_word)(1, row, slot, v, np.array([30]))[0]
        assert np.isclose(enter[40] - enter[30], change) and np.isclose(move[40] - move[30], change)


def test_rounds_raise_the_likelihood_over_all_words(spark, monkeypatch):
    """Two kinds of words that follow each other: no class mixes them, though
    the start knows but eight words."""
    monkeypatch.setattr(class_lm, "UNITS", class_lm.SUFFIXES + 8)
    rng = np.random.default_rng(2)
    kinds = [words(rng, 60, "abcdefgh"), words(rng, 60, "stuvwxyz")]
    text = lambda: " ".join(str(rng.choice(kinds[i % 2])) for i in range(400))
    model, _ = class_lm.fit(docs(spark, [(i, text()) for i in range(30)]).select("text"))
    of = dict(zip(model.near.code.tolist(), model.of.tolist(), strict=False))
    code = [{of[class_lm._tokens(pa.RecordBatch.from_arrays([pa.array([w])], ["text"]))[1].tolist()[0]] for w in k} for k in kinds]
    assert not code[0] & code[1]


def test_exchange_finds_classes():
    """Units that follow each other in two groups land in two classes."""
    pairs = np.zeros((8, 8))
    pairs[:4, 4:] = pairs[4:, :4] = 10
    of = class_lm.exchange(pairs + 0.0, 2, 5)
    assert len(set(of[:4])) == len(set(of[4:])) == 1 and of[0] != of[4]


@pytest.mark.parametrize("size", [24 << 20, 3000])
def test_search_is_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(bm25_search, "SHARD_BYTES", size)
    monkeypatch.setattr(bm25_search, "BLOCK", 4)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words(np.random.default_rng(0), 40, "abc"), rng.integers(1, 30)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "??"), (203, "never seen"), (5, rows[5][1]), (204, rows[9][1] * 300)]
    asked = [rows[0], rows[50], rows[100], (200, None), (9, "never seen words aaa"), (10, "nowhere")]
    bag = [Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))) for _, t in rows]
    df = Counter(w for b in bag for w in b)
    n, mean = len(rows), sum(sum(b.values()) for b in bag) / len(rows)
    want = {}
    for q, text in asked:
        scored = []
        for (k, _), b in zip(rows, bag, strict=True):
            s = sum(
                math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean))
                for w in set(re.findall(r"\w+", text or "")) if w in b
            )
            if s:
                scored.append((-round(s, 8), k))
        if scored:
            want[q] = [(k, -s) for s, k in sorted(scored)[:10]]
    got = {}
    for r in bm25_search.top_k(clashing(docs(spark, rows)), docs(spark, asked)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 8)))
    assert got == want
    assert bm25_search.top_k(docs(spark, rows).where("false"), docs(spark, asked)).collect() == []


def test_blocks_share_their_most_used_word(monkeypatch):
    """Documents of two languages and like lengths fall into blocks of their own, so a word of one bounds half of the blocks."""
    monkeypatch.setattr(bm25_search, "BLOCK", 4)

    def bag(i):
        words = np.array([1 + i % 2, 100 + i], np.uint64)
        return i, 4, words.tobytes(), np.array([3, 1], np.int32).tobytes()

    shard = bm25_search.Shard([bag(i) for i in range(32)], 4.0)
    assert shard.blocks == 8 and [int(shard.entry[t + 1] - shard.entry[t]) for t in (0, 1)] == [4, 4]
    found = shard.search(np.array([1, 106], np.uint64), np.array([0.5, 3.0]), 40)
    assert shard.ids[found[0][0]] == 6 and sorted(shard.ids[p] for p, _ in found) == list(range(0, 32, 2))


def test_search_in_passes_shuffles_no_documents(spark, monkeypatch):
    """Many lots of queries and shards give what one of each gives, and no document is dealt anew for them."""
    rng = np.random.default_rng(4)
    some = words(rng, 60, "abcd")
    rows = [(i, " ".join(rng.choice(some, rng.integers(1, 40)))) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(None, rows[7][1]), (7, rows[7][1])]
    all_, asked = docs(spark, rows).repartition(5), docs(spark, rows[:40])
    whole = bm25_search.top_k(all_, asked).orderBy("query_id", "rank").collect()
    assert [r.doc_id for r in whole if r.query_id == 7] == [7, 7, *range(1000, 1008)]
    plans, keep = [], bm25_search.stored
    monkeypatch.setattr(bm25_search, "stored", lambda df, name: (plans.append(df), keep(df, name))[1])
    monkeypatch.setattr(bm25_search, "SHARD_BYTES", 3000)
    monkeypatch.setattr(bm25_search, "LOT_BYTES", 2000, raising=False)
    got = bm25_search.top_k(all_, asked)
    near = lambda found: [(r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in found]
    assert near(got.orderBy("query_id", "rank").collect()) == near(whole)
    for df in [*plans, got]:
        lines = df._jdf.queryExecution().sparkPlan().toString().split("\n") + df._jdf.queryExecution().executedPlan().toString().split("\n")
        for n, line in enumerate(lines):
            at = line.find("Exchange hashpartitioning")
            for x in lines[n + 1 :] if at >= 0 else []:
                if len(x) - len(x.lstrip(" :+-")) <= at or "MapInArrow" in x:
                    break
                assert "counts#" not in x, line


def test_digest_of_kept_bytes(spark):
    row = suffix_dedup.digests(docs(spark, [(1, "héllo")])).first()
    assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (6, 0, 0, hashlib.sha256("héllo".encode()).hexdigest())
