"""Byte-level BPE encoding and decoding by a file of ranks, as recursive DuckDB queries per batch.

The JVM splits texts into words by the vocabulary's pattern. In a task a batch's distinct
words start as their bytes. A round of a recursive query turns each word into rows (word,
position, token, next token), joins them with the merge table and contracts the word's
leftmost pair of lowest rank; words that have no pair left are done. Decoding joins the tokens with the vocabulary
and puts their bytes together by an aggregation ordered by position.

Cases: NULL counts as the empty text: no tokens, decoded to no bytes. Repeated rows are
encoded one by one. A word of more than ``LONG_WORD`` bytes (a run without a space) would
need a round of the query per merge, each over the whole word; it is merged in
n log n with a heap, with the same result. Extra columns are kept.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import bounded_batches, free_name
from assay.llm.token_counts import merges_left, words

LONG_WORD = 256
WORDS_AT_ONCE = 20_000
TOKENS_AT_ONCE = 250_000
WORDS_PER_PART = 100_000
REMEMBERED = 250_000
#: Rows of an Arrow batch: Spark holds a batch's words as rows besides, and a worker its tokens and bytes.
ROWS = 500

ENCODE = """
WITH RECURSIVE parts(word, tokens, done) AS (
    SELECT word, tokens, false FROM start
  UNION ALL
    SELECT word, CASE WHEN best IS NULL THEN tokens ELSE
        tokens[:(best % 4294967296) - 1] || [CAST(best // 4294967296 AS INTEGER)] || tokens[(best % 4294967296) + 2:] END, best IS NULL
    FROM (
        SELECT word, any_value(tokens) AS tokens, min(merged * 4294967296 + pos) AS best
        FROM (
            SELECT word, tokens, unnest(tokens[:-2]) AS token, unnest(tokens[2:]) AS right_token, unnest(range(1, len(tokens))) AS pos
            FROM parts WHERE NOT done AND len(tokens) > 1
        ) LEFT JOIN merges ON pair = CAST(token AS BIGINT) * 4294967296 + right_token
        GROUP BY word
    )
)
SELECT word, tokens FROM parts WHERE done OR len(tokens) = 1
"""
DECODE = """
SELECT tokens.text AS text, unhex(string_agg(piece, '' ORDER BY pos)) AS bytes
FROM tokens JOIN vocabulary USING (token) GROUP BY tokens.text ORDER BY tokens.text
"""


class Codec:
    """A vocabulary as tables of an in-memory database of this worker."""

    def __init__(self, ranks: bytes):
        lines = [line.split() for line in ranks.splitlines() if line]
        self.ids = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self._pairs = None
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "150MB", "temp_directory": ""})
        left, right, merged = (np.array(v, np.int64) for v in zip(*self._splits(), strict=True))
        tables = {
            "merges": {"pair": left * 2**32 + right, "merged": merged},
            "vocabulary": {"token": pa.array(list(self.ids.values()), pa.int32()), "piece": [t.hex() for t in self.ids]},
        }
        for name, columns in tables.items():
            self.db.register("given", pa.table(columns))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")

    def _splits(self):
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                if (a := self.ids.get(token[:cut])) is not None and (b := self.ids.get(token[cut:])) is not None:
                    yield a, b, rank

    def _long(self, word: str) -> list[int]:
        if self._pairs is None:
            self._pairs = {(a, b): (rank, rank) for a, b, rank in self._splits()}
        return merges_left([int(self.byte_ids[b]) for b in word.encode()], self._pairs)

    def _contracted(self, new: list[str]) -> list[bytes]:
        raw = [w.encode() for w in new]
        ends = np.cumsum([0, *map(len, raw)])
        tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]))
        self.db.register("start", pa.table({"word": np.arange(len(raw), dtype=np.int32), "tokens": tokens}))
        found = self.db.sql(ENCODE).to_arrow_table().combine_chunks()
        lists = found["tokens"].combine_chunks()
        flat, ends = lists.flatten().to_numpy().tobytes(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]) * 4
        out = [b""] * len(raw)
        for word, begin, end in zip(found["word"].to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[word] = flat[begin:end]
        return out

    def encode(self, distinct: list[str]) -> list[bytes]:
        """Token ids, as 32-bit numbers, of each of the distinct words; short words are remembered."""
        new = [w for w in distinct if w not in self.known]
        found = {w: np.array(self._long(w), np.int32).tobytes() for w in new if len(w.encode()) > LONG_WORD}
        short = [w for w in new if w not in found]
        for start in range(0, len(short), WORDS_AT_ONCE):
            part = short[start : start + WORDS_AT_ONCE]
            found.update(zip(part, self._contracted(part), strict=True))
        known = self.known
        out = [found[w] if w in found else known[w] for w in distinct]
        again = [w for w in short if len(w) <= 32]
        if len(known) + len(again) > REMEMBERED:
            known.clear()
        known.update((w, found[w]) for w in again[:REMEMBERED])
        return out

    def decode(self, text: np.ndarray, pos: np.ndarray, token: pa.Array) -> pa.Table:
        """(text, its bytes) of rows (text, position, token)."""
        self.db.register("tokens", pa.table({"text": text, "pos": pos, "token": token}))
        return self.db.sql(DECODE).to_arrow_table()


@lru_cache(maxsize=2)
def _codec(ranks: bytes) -> Codec:
    return Codec(ranks)


def _ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _parts(lists: pa.Array, most: int) -> Iterator[pa.Array]:
    """Slices of ``lists`` with about ``most`` values, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), dtype=np.int64)
    first = 0
    while first < len(lists):
        begun = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begun + most, side="right")))
        yield lists.slice(first, last - first)
        first = last


def _encoded(codec: Codec, lists: pa.Array) -> pa.Array:
    """Token ids of rows of words."""
    coded = lists.flatten().dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    tokens = pa.array(codec.encode(coded.dictionary.to_pylist()), pa.binary()).take(coded.indices)
    # from the take on, the words' ids lie one after another
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(tokens).to_numpy(), dtype=np.int64)])[ends] // 4
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.Array.from_buffers(pa.int32(), int(bounds[-1]), [None, tokens.buffers()[2]]))


def _decoded(codec: Codec, lists: pa.Array) -> pa.Array:
    """The bytes of rows of token ids, so many tokens at a time, wherever texts end."""
    ends, flat = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), dtype=np.int64), lists.flatten()
    out: list[list[bytes]] = [[] for _ in range(len(lists))]
    for start in range(0, len(flat), TOKENS_AT_ONCE):
        pos = np.arange(start, min(start + TOKENS_AT_ONCE, len(flat)))
        got = codec.decode(np.searchsorted(ends, pos, side="right"), pos, flat.slice(start, len(pos)))
        for i, value in zip(got["text"].to_pylist(), got["bytes"].to_pylist(), strict=True):
            out[i].append(value)
    return pa.array([b"".join(parts) for parts in out], pa.binary())


def encode(docs: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", decoded_as: str | None = None) -> DataFrame:
    """``docs`` with the token ids of each text and, if a name is given, the bytes that the ids decode to.

    The rank file, of fixed size, is read by the driver and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_ranks(ranks_path))
    bounded_batches(docs.sparkSession, ROWS)

    @F.arrow_udf("struct<ids:array<int>,bytes:binary>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared.value)
        for lists in batches:
            found = [_encoded(codec, part) for part in _parts(lists, WORDS_PER_PART)]
            back = [_decoded(codec, part) if decoded_as else pa.nulls(len(part), pa.binary()) for part in found]
            tokens = pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.int32()))
            yield pa.StructArray.from_arrays([tokens, pa.concat_arrays(back) if back else pa.array([], pa.binary())], ["ids", "bytes"])

    new = {ids.lower()} | ({decoded_as.lower()} if decoded_as else set())
    columns = [c for c in docs.columns if c.lower() not in new]
    both = free_name("_encoded", docs)
    done = docs.select(*columns, encoded(words(text)).alias(both))
    extra = [F.col(f"{both}.bytes").alias(decoded_as)] if decoded_as else []
    return done.select(*columns, F.col(f"{both}.ids").alias(ids), *extra)


def decoded(docs: DataFrame, ranks_path: str, ids: str | Column = "ids") -> Column:
    """The bytes that a column of token ids stands for."""
    shared = docs.sparkSession.sparkContext.broadcast(_ranks(ranks_path))

    @F.arrow_udf("binary")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared.value)
        for lists in batches:
            yield _decoded(codec, lists)

    return joined(ids)
