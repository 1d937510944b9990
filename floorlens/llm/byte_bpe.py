"""Byte-level BPE encoding and decoding with DuckDB inside each partition.

Words (matches of the split pattern) that a task has not met yet go to DuckDB
as token-position rows. A recursive query joins neighbouring tokens with the
merge table and contracts each word's leftmost pair of minimum rank, until no
word has a mergeable pair. Decoding joins ids with the vocabulary and
concatenates the pieces by ordered aggregation.

Ids travel packed: little-endian unsigned 32-bit integers in a binary column.
The vocabulary is a fixed file, so its broadcast is bounded by its own size.
"""

from __future__ import annotations

import base64

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import add_columns

WORDS_AT_ONCE = 20_000
#: Words whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 200_000

MERGE = """
WITH RECURSIVE t(spot, tok, done) AS (
  SELECT spot, tok, false FROM start
  UNION ALL
  (WITH p AS (SELECT spot, tok, lead(spot) OVER (ORDER BY spot) AS next_spot, lead(tok) OVER (ORDER BY spot) AS next_tok
              FROM t WHERE NOT done),
        k AS (SELECT p.*, (m.rank::{int} << {two}) | ((spot & {mask}) << {bits}) | (next_spot & {mask}) AS pair
              FROM p LEFT JOIN merges m ON m.tokens = ((p.tok::BIGINT << 32) | p.next_tok)
                                       AND p.spot >> {bits} = p.next_spot >> {bits}),
        b AS (SELECT spot >> {bits} AS word, min(pair) AS best FROM k GROUP BY 1)
   SELECT k.spot, CASE WHEN k.pair = best THEN (best >> {two})::INT ELSE k.tok END, best IS NULL
   FROM k JOIN b ON b.word = k.spot >> {bits}
   WHERE best IS NULL OR (k.spot & {mask}) <> (best & {mask}))
)
SELECT (spot >> {bits})::BIGINT AS word, tok FROM t WHERE done ORDER BY spot
"""

DECODE = """
SELECT text_row, string_agg(piece, '' ORDER BY place) AS pieces
FROM ids JOIN vocabulary ON vocabulary.id = ids.id GROUP BY text_row
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in f if x.strip())}


def merge_table(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left id, right id, merged id) of each token longer than a byte: the
    pair that merges of lower rank leave of it. In a trained vocabulary each
    token has exactly one such pair; anything else raises."""
    table = []
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            found = [(ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            best, i = min(found)
            if best >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(token) > 1:
            if len(parts) != 2:
                raise ValueError(f"token of rank {rank} is not made of one pair")
            table.append((ranks[parts[0]], ranks[parts[1]], rank))
    return table


def connected() -> duckdb.DuckDBPyConnection:
    """One thread, bounded memory and no file: beyond the bound it fails."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "150MB", "temp_directory": ""})


class Encoder:
    """A memory of words per Python worker, and a DuckDB connection per task."""

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[int, int, int]], pattern: str):
        white = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.split = regex.compile(white).findall
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, rank = np.array(merges, np.int64).reshape(-1, 3).T
        self.pairs = pa.table({"tokens": left << 32 | right, "rank": rank.astype(np.int32)})
        self.known: dict[str, bytes] = {}

    def open(self) -> None:
        self.db = connected()
        self.db.register("pairs", self.pairs)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM pairs")

    def close(self) -> None:
        self.db.close()

    def learn(self, words: list[str]) -> None:
        for i in range(0, len(words), WORDS_AT_ONCE):
            some = words[i : i + WORDS_AT_ONCE]
            coded = [w.encode() for w in some]
            size = np.array([len(x) for x in coded])
            bits = max(22, int(size.max()).bit_length() + 1)
            word = np.repeat(np.arange(len(some)), size)
            place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
            start = pa.table({"spot": word << bits | place, "tok": self.bytes[np.frombuffer(b"".join(coded), np.uint8)]})
            self.db.register("start", start)
            sql = MERGE.format(
                bits=bits, two=2 * bits, mask=(1 << bits) - 1, int="BIGINT" if bits == 22 else "HUGEINT"
            )
            done = self.db.sql(sql).to_arrow_table()
            ids = done["tok"].to_numpy().astype("<u4")
            ends = np.searchsorted(done["word"].to_numpy(), np.arange(len(some) + 1)) * 4
            packed = ids.tobytes()
            for w, a, b in zip(some, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                self.known[w] = packed[a:b]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        words = [self.split(x or "") for x in texts]
        fresh = set().union(*words) - self.known.keys()
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = set().union(*words)
        self.learn(sorted(fresh))
        return [b"".join(map(self.known.__getitem__, x)) for x in words]


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.pieces = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "piece": [t.hex() for t in ranks]})

    def open(self) -> None:
        self.db = connected()
        self.db.register("pieces", self.pieces)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM pieces")

    def close(self) -> None:
        self.db.close()

    def decode(self, packed: list[bytes | None]) -> list[bytes]:
        size = np.array([len(x or b"") // 4 for x in packed])
        ids = pa.table({
            "text_row": np.repeat(np.arange(len(packed), dtype=np.int32), size),
            "place": np.arange(size.sum(), dtype=np.int32),
            "id": np.frombuffer(b"".join(x or b"" for x in packed), "<u4").astype(np.int32),
        })
        self.db.register("ids", ids)
        out = [b""] * len(packed)
        for row, pieces in self.db.sql(DECODE).fetchall():
            out[row] = bytes.fromhex(pieces)
        return out


_WORKERS: dict = {}


def _once(key, make):
    """Workers live on between tasks; what they learned of words stays true, the
    connection is the task's own."""
    if key not in _WORKERS:
        _WORKERS[key] = make()
    _WORKERS[key].open()
    return _WORKERS[key]


def encode(
    df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens",
    drop_text: bool = False,
) -> DataFrame:
    """Adds ``ids`` (packed) and ``n_tokens`` of each whole text, by the ranks
    in ``path``; each match of ``pattern`` is encoded alone. Null and empty
    texts have no ids. Columns named like the new ones are replaced; every
    row gives one row, repeated rows too."""
    ranks = read_ranks(path)
    given = df.sparkSession.sparkContext.broadcast((ranks, merge_table(ranks), pattern))

    def make():
        worker = _once(("encode", path, pattern), lambda: Encoder(*given.value))

        def work(part):
            coded = worker.encode(part.column(text).to_pylist())
            return [pa.array(coded, pa.binary()), pa.array([len(x) // 4 for x in coded], pa.int64())]

        work.close = worker.close
        return work

    fields = [T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType())]
    return add_columns(df, text, fields, make, (text,) if drop_text else ())


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the bytes of packed ids. Null has no bytes; an id
    outside the vocabulary raises."""
    given = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    top = max(given.value.values())

    def make():
        worker = _once(("decode", path), lambda: Decoder(given.value))

        def work(part):
            packed = part.column(ids).to_pylist()
            whole = np.frombuffer(b"".join(x or b"" for x in packed), "<u4")
            if len(whole) and whole.max() > top:
                raise ValueError("an id is outside the vocabulary")
            return [pa.array(worker.decode(packed), pa.binary())]

        work.close = worker.close
        return work

    return add_columns(df, ids, [T.StructField(decoded, T.BinaryType())], make)


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Round trip of each text: count of tokens, digests of ids and bytes."""
    coded = decode(encode(df.select(key, "text"), path, pattern, drop_text=True), path)
    return coded.select(
        key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
