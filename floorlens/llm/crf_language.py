"""Language identification by a linear-chain conditional random field.

Every word of a text is a position of the chain. Its features are the word,
its prefixes and suffixes of one to three bytes, its 2- and 3-grams, and the
set of languages in whose lexicon it is; label transitions are learned with
them. Forward-backward gives each word's label distribution, and a document
takes the language with the largest expected share of words.

Chains are cut into blocks: the product of a block's step matrices carries
messages across it, so all blocks of a slice run side by side in numpy and a
long text needs no long loop.

Training reads at most ``SAMPLE`` labelled documents, drawn by a hash of the
id. Their words are spliced into chains of alternating languages, which teaches
the transitions what a switch costs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .batches import add_columns, give_back, raw
from .words import Words, mix

SAMPLE = 1000
#: Bytes of text that it learns from, at most (one text at least).
SAMPLE_BYTES = 16 << 20
BUCKETS = 1 << 17
LEXICON = 300
BLOCK = 32
EPOCHS, BATCHES, RATE, PENALTY = 6, 8, 0.3, 1e-6
PIECE, CHAIN = 20, 240  # mean words of a spliced piece, words of a chain
UNKNOWN = "und"

#: Letters, the apostrophe and every byte of a non-ASCII character.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = LETTERS[39] = True


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def lowered(texts: pa.Array) -> Words:
    return Words(*raw(pc.utf8_lower(pc.fill_null(texts, ""))), LETTERS)


def features(w: Words, pick: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the picked words, one after another, and where each
    word's begin."""
    first, size = w.first[pick], w.last[pick] - w.first[pick]
    word = np.repeat(np.arange(len(pick)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    byte = w.data[first[word] + at].astype(np.uint64) + np.uint64(1)
    left = size[word] - at
    pair = np.where(left > 1, np.append(byte[1:], np.uint64(0)), np.uint64(0))
    third = np.where(left > 2, np.append(byte[2:], np.zeros(min(2, len(byte)), np.uint64)), np.uint64(0))
    grams2, grams3 = byte | pair << np.uint64(9), byte | pair << np.uint64(9) | third << np.uint64(18)
    known, masks = lexicon
    place = np.minimum(np.searchsorted(known, w.hash[pick]), max(len(known) - 1, 0))
    mask = np.where(known[place] == w.hash[pick], masks[place], 0) if len(known) else np.zeros(len(pick), np.int64)

    def kind(number, value, keep=None, of=word):
        code = mix(value + np.uint64(number << 40)) % np.uint64(BUCKETS)
        return (code, of) if keep is None else (code[keep], of[keep])

    every = np.arange(len(pick))
    sets = [
        kind(1, w.hash[pick], of=every), kind(2, mask.astype(np.uint64), of=every),
        kind(3, byte, at == 0), kind(4, grams2, at == 0), kind(5, grams3, at == 0),
        kind(6, byte, left == 1), kind(7, grams2, left == 2), kind(8, grams3, left == 3),
        kind(9, grams2, left > 1), kind(10, grams3, left > 2),
    ]
    code, of = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets])
    order = np.argsort(of, kind="stable")
    return code[order].astype(np.int64), np.searchsorted(of[order], np.arange(len(pick)))


def emissions(weights: np.ndarray, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    if not len(begins):
        return np.zeros((0, weights.shape[1]))
    return np.add.reduceat(weights[codes], begins, axis=0)


def marginals(emit: np.ndarray, bounds: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label distributions of each position of the chains between ``bounds``,
    and the expected transitions. ``emit``: log weights; ``turn``: log weights
    of label after label. A chain starts with any label alike."""
    n, k = emit.shape
    size = np.diff(bounds)
    blocks = -(-size // BLOCK)
    first = np.repeat(bounds[:-1], blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    length = np.minimum(BLOCK, np.repeat(bounds[1:], blocks) - first)
    order = np.argsort(-length, kind="stable")  # full blocks first: the live ones are always a prefix
    first, length = first[order], length[order]
    live = [int(np.searchsorted(-length, -i, side="left")) for i in range(BLOCK)]
    step = np.exp(turn - turn.max())
    weight = np.exp(emit - emit.max(1, keepdims=True))
    across = np.broadcast_to(np.eye(k), (len(first), k, k)).copy()
    for i in range(BLOCK):
        m = live[i]
        part = across[:m] @ step * weight[first[:m] + i][:, None, :]
        across[:m] = part / part.sum((1, 2), keepdims=True)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))  # block of the text order to its row here
    begin = np.cumsum(blocks) - blocks
    entering, leaving = np.full((len(first), k), 1.0 / k), np.ones((len(first), k))
    by_blocks = np.argsort(-blocks, kind="stable")
    counts = blocks[by_blocks]
    for j in range(1, int(blocks.max(initial=0))):
        live_chains = by_blocks[: int(np.searchsorted(-counts, -j, side="left"))]
        here = place[begin[live_chains] + j]
        ago = place[begin[live_chains] + j - 1]
        moved = np.einsum("nk,nkl->nl", entering[ago], across[ago])
        entering[here] = moved / moved.sum(1, keepdims=True)
        here = place[begin[live_chains] + blocks[live_chains] - 1 - j]
        after = place[begin[live_chains] + blocks[live_chains] - j]
        moved = np.einsum("nkl,nl->nk", across[after], leaving[after])
        leaving[here] = moved / moved.sum(1, keepdims=True)
    forward, backward = np.empty((n, k)), np.empty((n, k))
    alpha = entering
    before = np.empty((n, k))
    for i in range(BLOCK):
        m = live[i]
        at = first[:m] + i
        before[at] = alpha[:m]
        alpha = alpha[:m] @ step * weight[at]
        alpha /= alpha.sum(1, keepdims=True)
        forward[at] = alpha
    beta = leaving.copy()
    for i in reversed(range(BLOCK)):
        m = live[i]
        at = first[:m] + i
        backward[at] = beta[:m]
        moved = (beta[:m] * weight[at]) @ step.T
        beta[:m] = moved / moved.sum(1, keepdims=True)
    both = forward * backward
    total = both.sum(1, keepdims=True)
    ends = weight * backward
    norm = np.einsum("nk,kl,nl->n", before, step, ends)
    turns = np.einsum("nk,nl->kl", before / norm[:, None], ends) * step
    return both / total, turns


class Model:
    def __init__(self, labels: list[str], lexicon, weights: np.ndarray, turn: np.ndarray):
        self.labels, self.lexicon, self.weights, self.turn = labels, lexicon, weights, turn

    def label(self, w: Words) -> np.ndarray:
        """The label distribution of each word."""
        _, pick, back = np.unique(w.hash, return_index=True, return_inverse=True)
        emit = emissions(self.weights, *features(w, pick, self.lexicon))[back]
        full = w.bounds[np.concatenate(([True], np.diff(w.bounds) > 0))]
        return marginals(emit, full, self.turn)[0]


def train(texts: list[str], langs: list[str]) -> Model | None:
    """Fits the field to labelled texts; every word has its text's label."""
    w = lowered(pa.array(texts, pa.string()))
    labels = sorted(set(langs))
    if not len(w):
        return None
    of_text = np.searchsorted(labels, langs)
    of = of_text[w.row]
    rng = np.random.default_rng(7)
    known: dict[int, int] = {}
    for k in range(len(labels)):
        word, count = np.unique(w.hash[of == k], return_counts=True)
        for x in word[np.argsort(-count, kind="stable")[:LEXICON]].tolist():
            known[x] = known.get(x, 0) | 1 << k
    code = np.array(sorted(known), np.uint64)
    lexicon = code, np.array([known[x] % (1 << 40) for x in code.tolist()], np.int64)
    # splice: cut all texts into pieces, shuffle them, and join them into chains
    cut = rng.random(len(w)) < 1 / PIECE
    cut[w.bounds[:-1][np.diff(w.bounds) > 0]] = True
    starts = np.flatnonzero(cut)
    sizes = np.diff(starts, append=len(w))
    turn_to = rng.permutation(len(starts))
    sizes, starts = sizes[turn_to], starts[turn_to]
    chain = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(w))
    truth = of[chain]
    _, pick, back = np.unique(w.hash, return_index=True, return_inverse=True)
    codes, begins = features(w, pick, lexicon)
    owner = np.repeat(np.arange(len(pick)), np.diff(begins, append=len(codes)))
    word = back[chain]
    k = len(labels)
    weights, turn = np.zeros((BUCKETS, k)), np.zeros((k, k))
    seen_w, seen_t = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6)
    edges = np.arange(0, len(w), CHAIN)
    for _ in range(EPOCHS):
        for lot in np.array_split(rng.permutation(len(edges)), BATCHES):
            size = np.minimum(CHAIN, len(w) - edges[lot])
            bounds = np.concatenate(([0], np.cumsum(size)))
            if not bounds[-1]:
                continue
            at = np.repeat(edges[lot] - bounds[:-1], size) + np.arange(bounds[-1])
            types, local = np.unique(word[at], return_inverse=True)
            use = np.isin(owner, types)
            use_codes, use_owner = codes[use], np.searchsorted(types, owner[use])
            emit = emissions(weights, use_codes, np.searchsorted(use_owner, np.arange(len(types))))[local]
            share, turns = marginals(emit, bounds, turn)
            gold = np.eye(k)[truth[at]]
            inner = np.ones(len(at), bool)
            inner[bounds[:-1]] = False
            here = np.flatnonzero(inner)
            # a chain's first label has no label before it: its expected step is the start's, of no weight
            want = np.zeros((k, k))
            np.add.at(want, (truth[at[here - 1]], truth[at[here]]), 1)
            begin = share[bounds[:-1]].sum(0)
            slope_t = (turns - np.outer(np.full(k, 1 / k), begin) - want) / len(at)
            error = (share - gold) / len(at)
            by_type = np.stack([np.bincount(local, error[:, j], len(types)) for j in range(k)], 1)
            slope = np.stack([np.bincount(use_codes, by_type[use_owner, j], BUCKETS) for j in range(k)], 1) + PENALTY * weights
            seen_w += slope**2
            seen_t += slope_t**2
            weights -= RATE * slope / np.sqrt(seen_w)
            turn -= RATE * slope_t / np.sqrt(seen_t)
    return Model(labels, lexicon, weights.astype(np.float32), turn)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from ``text`` and non-null ``lang`` of the rows of ``docs`` that
    are not held out; None if there is no such row. ``sample`` rows are drawn at
    most, by a hash of their ids and in its order, and of these the first whose
    texts hold ``SAMPLE_BYTES`` together: the same ones however ``docs`` is dealt."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1e6 * sample / n) + 1))
    key = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("lang"), F.xxhash64("text")]
    few = rows.select("doc_id", "text", "lang").orderBy(*key).limit(sample)
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(*key))
    drawn = few.withColumn("upto", upto).where(F.col("upto") <= F.greatest(F.lit(SAMPLE_BYTES), F.octet_length("text"))).orderBy(*key).select("text", "lang").collect()
    model = train([r["text"] for r in drawn], [r["lang"] for r in drawn]) if drawn else None
    del drawn
    give_back()  # the driver lives on, through all later stages
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (expected share of the text's words in that
    language, 0 to 1) and ``lang_runs`` (runs of words of one label). A text
    that is null or has no letter is ``und`` with score 0, as all are without a
    model. Ties go to the first label. Columns of the same names are replaced."""
    run = T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.LongType())])
    fields = [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("lang_runs", T.ArrayType(run)),
    ]
    given = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(part):
            m, texts = given.value, part.column("text")
            w = lowered(texts)
            plain = np.concatenate(([0], np.cumsum((w.data >= 97) & (w.data <= 122))))
            offsets = raw(pc.utf8_lower(pc.fill_null(texts, "")))[1]
            letters = np.diff(plain[offsets]) > 0
            for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
                letters[i] = any(c.isalpha() for c in texts[i].as_py() or "")
            n = part.num_rows
            if m is None or not len(w):
                return [pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.array([[]] * n, pa.list_(RUN))]
            share = m.label(w)
            total = np.stack([np.bincount(w.row, share[:, j], n) for j in range(share.shape[1])], 1)
            best = total.argmax(1)
            score = total[np.arange(n), best] / np.maximum(1, np.diff(w.bounds))
            letters &= np.diff(w.bounds) > 0
            top = share.argmax(1)
            fresh = np.flatnonzero(np.concatenate(([True], (top[1:] != top[:-1]) | (w.row[1:] != w.row[:-1]))))
            size = np.diff(fresh, append=len(w))
            spans = np.searchsorted(fresh, w.bounds)
            names = np.array(m.labels, object)
            runs = pa.StructArray.from_arrays([pa.array(names[top[fresh]], pa.string()), pa.array(size)], fields=list(RUN))
            return [
                pa.array(np.where(letters, names[best], UNKNOWN), pa.string()), pa.array(np.where(letters, np.minimum(score, 1.0), 0.0)),
                pa.ListArray.from_arrays(pa.array(spans, pa.int32()), runs),
            ]

        return work

    return add_columns(docs, "text", fields, make)


RUN = pa.struct([("lang", pa.string()), ("words", pa.int64())])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""
    read = docs.select("doc_id", "text")
    return predict(read, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
