"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Tokens and bytes of a text make an incidence matrix per vocabulary, kept as hand-built CSR
arrays: A has a row per token of the byte-level vocabulary, B one per piece. The rows of
``A Bᵀ``, built one after another from the rows of ``Bᵀ`` that they name (Gustavson), are
the overlap links, with the number of shared bytes as value; those whose two tokens end at
the same byte cut the text into groups. Tokens and groups make an incidence matrix again,
and the same product of those two gives the links of tokens that share a group.

How often an id pair is linked in the whole corpus is counted in shards of the pairs. A
task puts the pairs of many documents into one packed row per shard; shards are summed,
the counts packed again, and every shard meets its counts in one streamed pass. Neither
pairs nor counts are ever in one place as a whole.

Texts are encoded by the libraries, long ones in pieces: neither vocabulary has a token
that goes on behind a single space between two words, so texts are cut there. A single
word is never cut.

Cases: NULL and empty texts, and texts whose tokens don't spell " " + text again (U+2581
in a text is one), have no tokens: zeros and an empty digest. Special strings are plain
text. Repeated rows, and rows without an id, are documents of their own and are counted
each. Ties: every pair with the highest count of its piece is a best one. Other columns of
the input are not read, so their names can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.quality import _packed, _unpacked
from assay.llm.token_counts import WORDS, byte_letters
from assay.plans.storing import store

CHARS = 1 << 18
#: Links of finished documents that a task holds before it packs them.
HELD = 1 << 20
SHARDS = 16
SLOT_BYTES = 256 << 20
#: Pairs of tokens that are made at once where links themselves are asked for.
PAIRS_AT_ONCE = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")


class Csr(NamedTuple):
    """Rows of (column, value); row ``i`` lies at ``starts[i]:starts[i + 1]``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def between(self, first: int, last: int) -> Csr:
        """Rows ``first`` to ``last``, without the last."""
        low, high = self.starts[first], self.starts[last]
        return Csr(self.starts[first : last + 1] - low, self.columns[low:high], self.values[low:high], self.width)


def product(left: Csr, right: Csr) -> Csr:
    """``left`` times ``right``: each row adds up the rows of ``right`` that it names, scaled."""
    sizes = np.diff(right.starts)[left.columns]
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(right.starts[left.columns] - (ends - sizes), sizes)
    cells = np.repeat(left.rows(), sizes) * right.width + right.columns[place]
    values = np.repeat(left.values, sizes) * right.values[place]
    if (cells[1:] < cells[:-1]).any():
        order = np.argsort(cells, kind="stable")
        cells, values = cells[order], values[order]
    heads = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
    filled = cells[heads]
    starts = np.searchsorted(filled, np.arange(len(left.starts)) * right.width)
    return Csr(starts, filled % right.width, np.add.reduceat(values, heads) if len(heads) else values, right.width)


def byte_rows(ends: np.ndarray) -> Csr:
    """Tokens by bytes, from where each token ends."""
    n = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([[0], ends]), np.arange(n), np.ones(n, np.int64), n)


def by_owner(owner: np.ndarray, owners: int) -> Csr:
    """Things by the one owner (token, group) that each has."""
    return Csr(np.arange(len(owner) + 1), owner, np.ones(len(owner), np.int64), owners)


def transposed(matrix: Csr) -> Csr:
    order = np.argsort(matrix.columns, kind="stable")
    starts = np.searchsorted(matrix.columns[order], np.arange(matrix.width + 1))
    return Csr(starts, matrix.rows()[order], matrix.values[order], len(matrix.starts) - 1)


class Aligned(NamedTuple):
    """Overlap links of two token sequences over the same bytes, and the groups they form."""

    overlaps: Csr
    #: Of the overlap links, those whose tokens end together: positions in A and in B.
    left: np.ndarray
    right: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray

    def group_links(self, first: int, last: int) -> Csr:
        """Links of the tokens ``first`` to ``last`` of A with all tokens of B in the same group."""
        groups = len(self.left)
        return product(by_owner(self.group_a, groups).between(first, last), transposed(by_owner(self.group_b, groups)))


def align_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> Aligned:
    """Both sequences have to end at the same byte."""
    of_byte = np.repeat(np.arange(len(ends_b)), np.diff(ends_b, prepend=0))
    overlaps = product(byte_rows(ends_a), by_owner(of_byte, len(ends_b)))
    rows = overlaps.rows()
    together = ends_a[rows] == ends_b[overlaps.columns]
    left, right = rows[together], overlaps.columns[together]
    group_a = np.searchsorted(left, np.arange(len(ends_a)))
    group_b = np.searchsorted(right, np.arange(len(ends_b)))
    return Aligned(overlaps, left, right, group_a, group_b)


def pieces(text: str, size: int = CHARS) -> Iterator[str]:
    """The text in pieces of about ``size`` characters; the space at each cut is left out."""
    start = 0
    while found := _BETWEEN_WORDS.search(text, start + size):
        yield text[start : found.start()]
        start = found.end()
    yield text[start:]


class _Bytes(NamedTuple):
    """The bytes of each id, one after another."""

    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, spelled: list[bytes]) -> _Bytes:
        sizes = np.array([len(s) for s in spelled], np.int64)
        return cls(np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(sizes) - sizes, sizes)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - sizes), sizes)]


class Vocabularies:
    """Both vocabularies, their encoders, and the text of each id with its separators."""

    def __init__(self, vocabulary: str, model: bytes):
        import sentencepiece
        import tiktoken

        known = json.loads(vocabulary)
        code = {letter: byte for byte, letter in enumerate(byte_letters())}
        special = {t["content"] for t in known.get("added_tokens", ())}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in known["model"]["merges"]]
        ids = known["model"]["vocab"]
        ranks = {letter: n for n, letter in enumerate(sorted(code, key=lambda x: ids[x]))}
        for left, right in merges:
            ranks.setdefault(left + right, len(ranks))
        #: ids by merge order; the library wants them in that order
        self.id_of_rank = np.array([ids[token] for token in ranks], np.int64)
        mergeable = {bytes(code[c] for c in token): rank for token, rank in ranks.items()}
        pattern = WORDS.replace(r"\p{IsWhite_Space}", r"\s").replace(r"\P{IsWhite_Space}", r"\S")
        self.encoder = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=mergeable, special_tokens={})
        spelled = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            if token not in special:
                spelled[i] = bytes(code[c] for c in token)
        self.a = _Bytes.of(spelled)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.b = _Bytes.of([self._piece(i) for i in range(self.model.get_piece_size())])
        self.width = len(self.b.sizes)
        texts = [f"{i}{sep}".encode() for n, seps in ((len(spelled), ",|"), (self.width, ",;")) for i in range(n) for sep in seps]
        self.text_sizes = np.array([len(t) for t in texts], np.uint8)
        room = int(self.text_sizes.max())
        self.texts = np.frombuffer(b"".join(t.ljust(room, b"\0") for t in texts), np.uint8).reshape(-1, room)
        self.written = self.texts > 0

    def _piece(self, i: int) -> bytes:
        if self.model.is_byte(i):
            return bytes([int(self.model.id_to_piece(i)[3:5], 16)])
        return b"" if self.model.is_control(i) else self.model.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        left = [self.id_of_rank[np.array(self.encoder.encode_ordinary(" " + t), np.int64)] for t in texts]
        return left, [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]

    def group_text(self, ids_a: np.ndarray, ids_b: np.ndarray, found: Aligned) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;...`` of all groups, and where the text of each group ends."""
        groups = len(found.left)
        in_a, in_b = np.bincount(found.group_a, minlength=groups), np.bincount(found.group_b, minlength=groups)
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        last = np.zeros(len(ids_a), np.int64)
        last[found.left] = 1
        codes[np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[found.group_a]] = 2 * ids_a + last
        last = np.zeros(len(ids_b), np.int64)
        last[found.right] = 1
        codes[np.arange(len(ids_b)) + np.cumsum(in_a)[found.group_b]] = 2 * len(self.a.sizes) + 2 * ids_b + last
        ends = np.cumsum(self.text_sizes[codes], dtype=np.int64)
        return self.texts[codes][self.written[codes]], ends[np.cumsum(in_a + in_b) - 1]


@lru_cache(maxsize=1)
def _vocabularies(vocabulary: str, model: bytes) -> Vocabularies:
    return Vocabularies(vocabulary, model)


class Piece(NamedTuple):
    n_a: int
    n_b: int
    #: ``a_id * width + b_id`` of every link whose tokens end together, in order
    pairs: np.ndarray
    groups: bytes


def align_texts(words: Vocabularies, texts: list[str]) -> list[Piece | None]:
    """The alignment of each text; None where its tokens don't spell " " + text."""
    ids_a, ids_b = words.encode(texts)
    wanted = [(" " + t).encode() for t in texts]
    sizes = np.array([len(w) for w in wanted])
    n_a, n_b = (np.array([len(i) for i in ids]) for ids in (ids_a, ids_b))
    spelled = np.ones(len(texts), bool)
    for ids, counts, table in ((ids_a, n_a, words.a), (ids_b, n_b, words.b)):
        of = np.repeat(np.arange(len(texts)), counts)
        spelled &= np.bincount(of, table.sizes[np.concatenate(ids)], len(texts)).astype(np.int64) == sizes
    for ids, table in ((ids_a, words.a), (ids_b, words.b)):
        kept = np.flatnonzero(spelled)
        if len(kept):
            same = table.spell(np.concatenate([ids[k] for k in kept])) == np.frombuffer(b"".join(wanted[k] for k in kept), np.uint8)
            spelled[kept[~np.logical_and.reduceat(same, np.cumsum(sizes[kept]) - sizes[kept])]] = False
    out: list[Piece | None] = [None] * len(texts)
    kept = np.flatnonzero(spelled)
    if not len(kept):
        return out
    flat_a, flat_b = (np.concatenate([ids[k] for k in kept]) for ids in (ids_a, ids_b))
    found = align_ends(np.cumsum(words.a.sizes[flat_a]), np.cumsum(words.b.sizes[flat_b]))
    pairs = flat_a[found.left] * words.width + flat_b[found.right]
    text, ends = words.group_text(flat_a, flat_b, found)
    through = np.searchsorted(found.left, np.cumsum(n_a[kept]))  # groups up to the end of each text
    first = 0
    for k, last in zip(kept, through, strict=True):
        low, high = ends[first - 1] if first else 0, ends[last - 1]
        out[k] = Piece(int(n_a[k]), int(n_b[k]), pairs[first:last], text[low:high].tobytes())
        first = last
    return out


class _Document:
    def __init__(self, doc_id, row: int):
        self.doc_id, self.row = doc_id, row
        self.n_a = self.n_b = 0
        self.pairs: list[np.ndarray] = []
        self.digest, self.fits = sha256(), True

    def add(self, piece: Piece | None) -> None:
        if piece is None:
            self.fits = False
        if not self.fits:
            self.pairs = []
            return
        if self.n_a:
            self.digest.update(b";")
        self.n_a, self.n_b = self.n_a + piece.n_a, self.n_b + piece.n_b
        self.pairs.append(piece.pairs)
        self.digest.update(piece.groups[:-1])  # the last group's separator goes before the next piece

    def record(self) -> dict:
        pairs = np.concatenate(self.pairs) if self.pairs else np.zeros(0, np.int64)
        if not self.fits or not self.n_a:
            return {"row": self.row, "doc_id": self.doc_id, "n_a": 0, "n_b": 0, "n_links": 0, "groups_sha256": "", "pairs": pairs}
        return {"row": self.row, "doc_id": self.doc_id, "n_a": self.n_a, "n_b": self.n_b, "n_links": len(pairs), "groups_sha256": self.digest.hexdigest(), "pairs": pairs}


def _lots(rows: Iterable[tuple[_Document, str | None]]) -> Iterator[list[tuple[_Document, str, bool]]]:
    """Lists of (document, piece, whether it is the document's last) of about ``CHARS`` characters."""
    held, room = [], CHARS
    for document, text in rows:
        cut = list(pieces(text)) if text else [""]
        for n, piece in enumerate(cut):
            held.append((document, piece, n + 1 == len(cut)))
            room -= len(piece) + 16
            if room <= 0:
                yield held
                held, room = [], CHARS
    if held:
        yield held


def _shard_of(pairs: np.ndarray) -> np.ndarray:
    return ((pairs.astype(np.uint64) * _MIX) >> np.uint64(40)).astype(np.int64) % SHARDS


_ALIGNED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
    + [("shard", pa.int32()), ("rows", pa.binary()), ("pairs", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary())]
)
_ALIGNED_DDL = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_links bigint, groups_sha256 string, shard int, rows binary, pairs binary, owners binary, counts binary"


def _packs(records: list[dict]) -> Iterator[dict]:
    """The distinct pairs of each document with their number, one packed row per shard."""
    pairs = np.concatenate([r["pairs"] for r in records])
    owner = np.repeat(np.arange(len(records)), [len(r["pairs"]) for r in records])
    cells, counts = np.unique(pairs * len(records) + owner, return_counts=True)
    pairs, owner = cells // len(records), cells % len(records)
    shard = _shard_of(pairs)
    rows = np.array([r["row"] for r in records], np.int64).tobytes()
    for s in range(SHARDS):
        mine = shard == s
        if mine.any():
            steps = np.diff(pairs[mine], prepend=0)
            yield {"shard": s, "rows": rows, "pairs": _packed(steps, np.uint64), "owners": _packed(owner[mine], np.uint32), "counts": _packed(counts[mine], np.uint32)}


def _aligner(vocabulary, model):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = _vocabularies(vocabulary.value, model.value)
        base = TaskContext.get().partitionId() << 40
        done: list[dict] = []
        links = seen = 0

        def documents():
            nonlocal seen
            for batch in batches:
                for i in range(batch.num_rows):
                    yield _Document(batch.column(0)[i].as_py(), base + seen), batch.column(1)[i].as_py()
                    seen += 1

        def out():
            rows = [{k: v for k, v in r.items() if k != "pairs"} for r in done] + list(_packs(done))
            return pa.RecordBatch.from_pylist(rows, _ALIGNED)

        for lot in _lots(documents()):
            chosen = [n for n, (_, piece, _) in enumerate(lot) if piece]
            found = dict(zip(chosen, align_texts(words, [lot[n][1] for n in chosen]), strict=True)) if chosen else {}
            for n, (document, piece, last) in enumerate(lot):
                if piece:
                    document.add(found[n])
                if last:
                    done.append(document.record())
                    links += done[-1]["n_links"]
                    if links >= HELD or len(done) >= 1 << 14:
                        yield out()
                        done, links = [], 0
        if done:
            yield out()

    return run


def _opened(pack: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    pairs = np.cumsum(_unpacked(pack["pairs"], np.uint64).astype(np.int64))
    return np.frombuffer(pack["rows"], np.int64), pairs, _unpacked(pack["owners"], np.uint32), _unpacked(pack["counts"], np.uint32).astype(np.int64)


def _grouped(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    return pairs[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _sum_pairs(batches):
    """Counts of the pairs of a task's packs; what is held is bounded by the distinct pairs of a shard."""
    pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting, size = [], 0

    def folded():
        return _grouped(*(np.concatenate(v) for v in zip((pairs, counts), *waiting, strict=True)))

    for batch in batches:
        for pack in batch.to_pylist():
            _, keys, _, n = _opened(pack)
            waiting.append(_grouped(keys, n))
            size += len(keys)
            if size > max(4 * HELD, len(pairs)):
                pairs, counts = folded()
                waiting, size = [], 0
    pairs, counts = folded()
    for start in range(0, len(pairs), HELD):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[start : start + HELD]), pa.array(counts[start : start + HELD])], ["pair", "n"])


def _pack_counts(group: pa.Table) -> pa.Table:
    order = np.argsort(group["pair"].to_numpy())
    steps = np.diff(group["pair"].to_numpy()[order], prepend=0)
    n, best = group["n"].to_numpy()[order], group["best"].to_numpy(zero_copy_only=False)[order]
    return pa.table(
        {"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "pairs": [_packed(steps, np.uint64)], "owners": [_packed(best.astype(np.uint32), np.uint32)], "counts": [_packed(n, np.uint64)]}
    )


def _look_up(batches):
    """Each shard's counts come first, then its packs: per document what they add up to."""
    shard, known = None, None
    for batch in batches:
        for pack in batch.to_pylist():
            if pack["rows"] is None:
                shard = pack["shard"]
                known = np.cumsum(_unpacked(pack["pairs"], np.uint64).astype(np.int64)), _unpacked(pack["counts"], np.uint64).astype(np.int64), _unpacked(pack["owners"], np.uint32) > 0
                continue
            if shard != pack["shard"]:
                raise ValueError("links without counts")
            rows, pairs, owner, n = _opened(pack)
            at = np.searchsorted(known[0], pairs)
            sums, best = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            np.add.at(sums, owner, n * known[1][at])
            np.add.at(best, owner, n * known[2][at])
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(rows[used]), pa.array(best[used]), pa.array(sums[used])], ["row", "n_best", "count_sum"])


def align(docs: DataFrame, vocabulary: str, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    ``vocabulary`` (JSON) and ``model`` are files of fixed size that the driver reads and broadcasts.
    """
    spark = docs.sparkSession
    width, shared = _share(spark, vocabulary, model)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    packed_bytes = F.sum(F.octet_length("pairs") + F.octet_length("owners") + F.octet_length("counts"))
    table, seen = store(texts.mapInArrow(_aligner(*shared), _ALIGNED_DDL), "aligned", bytes=packed_bytes)
    packs = table.filter("shard IS NOT NULL").select("shard", "rows", "pairs", "owners", "counts")
    shares = max(1, -(-(seen["bytes"] or 0) // (SHARDS * SLOT_BYTES)))
    slots = SHARDS * shares
    share = F.pmod(F.xxhash64("rows"), F.lit(shares)).cast("int")
    dealt = packs.withColumn("slot", F.col("shard") * shares + share)
    counted = dealt.repartitionById(slots, "slot").drop("slot").mapInArrow(_sum_pairs, "pair bigint, n bigint")
    counts, _ = store(counted.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    piece = F.col("pair") % width
    highest = counts.groupBy(piece.alias("piece")).agg(F.max("n").alias("most"))
    marked = counts.join(highest, piece == F.col("piece")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"), _shard_column("pair").alias("shard"))
    lookups = marked.groupBy("shard").applyInArrow(_pack_counts, "shard int, pairs binary, owners binary, counts binary")
    lookups = lookups.withColumn("rows", F.lit(None).cast("binary")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    columns = ["slot", "shard", "rows", "pairs", "owners", "counts"]
    both = dealt.select(columns).unionByName(lookups.withColumn("slot", F.col("shard") * shares + F.col("share")).select(columns))
    both = both.repartitionById(slots, "slot").sortWithinPartitions("slot", F.col("rows").isNotNull())
    sums = both.drop("slot").mapInArrow(_look_up, "row bigint, n_best bigint, count_sum bigint")
    sums = sums.groupBy(F.col("row").alias("of")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = table.filter("row IS NOT NULL").join(sums, F.col("row") == F.col("of"), "left")
    none = F.lit(0)
    return rows.select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links",
        F.coalesce("n_best", none).cast("long").alias("n_best"), F.coalesce("count_sum", none).cast("long").alias("count_sum"), "groups_sha256",
    )


def _shard_column(pair: str):
    """As ``_shard_of``, on a column."""

    @F.arrow_udf("int")
    def shard(pairs: pa.Array) -> pa.Array:
        return pa.array(_shard_of(pairs.to_numpy()).astype(np.int32))

    return shard(F.col(pair))


def _share(spark, vocabulary: str, model: str):
    import sentencepiece

    with open(vocabulary, encoding="utf-8") as file:
        words = file.read()
    with open(model, "rb") as file:
        proto = file.read()
    width = sentencepiece.SentencePieceProcessor(model_proto=proto).get_piece_size()
    return width, (spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(proto))


_LINKS = "doc_id bigint, kind string, a_at bigint, b_at bigint, a_id bigint, b_id bigint, shared bigint"


def links(docs: DataFrame, vocabulary: str, model: str, kinds: tuple[str, ...] = ("overlap", "end", "group"), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The links themselves: positions and ids of two tokens and the bytes they share (``group``: 1).

    ``overlap``: tokens with a byte in common; ``end``: those that end together; ``group``:
    tokens of the same group, which may be many where the vocabularies never meet, so they
    are made in blocks of A's tokens.
    """
    _, (words, proto) = _share(docs.sparkSession, vocabulary, model)

    def run(batches):
        known = _vocabularies(words.value, proto.value)
        for batch in batches:
            for i in range(batch.num_rows):
                name, value = (batch.column(c)[i].as_py() for c in (0, 1))
                yield from _links_of(known, name, value or "", kinds)

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return texts.mapInArrow(run, _LINKS)


def _links_of(known: Vocabularies, name, text: str, kinds: tuple[str, ...]):
    cut = list(pieces(text)) if text else []
    if any(found is None for piece in cut for found in align_texts(known, [piece])):
        return
    before_a = before_b = 0
    for piece in cut:
        (ids_a,), (ids_b,) = known.encode([piece])
        found = align_ends(np.cumsum(known.a.sizes[ids_a]), np.cumsum(known.b.sizes[ids_b]))
        rows = found.overlaps.rows()
        ends = np.isin(rows * len(ids_b) + found.overlaps.columns, found.left * len(ids_b) + found.right)
        made = []
        if "overlap" in kinds:
            made.append(("overlap", rows, found.overlaps.columns, found.overlaps.values))
        if "end" in kinds:
            made.append(("end", found.left, found.right, found.overlaps.values[ends]))
        for kind, left, right, shared in made:
            for start in range(0, len(left), PAIRS_AT_ONCE):
                some = slice(start, start + PAIRS_AT_ONCE)
                yield _link_rows(name, kind, left[some], right[some], shared[some], ids_a, ids_b, before_a, before_b)
        if "group" in kinds:
            per_token = np.bincount(found.group_b, minlength=len(found.left))[found.group_a]
            block = np.cumsum(per_token) // PAIRS_AT_ONCE
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                shared = found.group_links(int(low), int(high))
                yield _link_rows(name, "group", shared.rows() + low, shared.columns, shared.values, ids_a, ids_b, before_a, before_b)
        before_a, before_b = before_a + len(ids_a), before_b + len(ids_b)


def _link_rows(name, kind, left, right, shared, ids_a, ids_b, before_a, before_b):
    n = len(left)
    columns = [pa.array([name] * n, pa.int64()), pa.array([kind] * n, pa.string()), pa.array(left + before_a), pa.array(right + before_b)]
    columns += [pa.array(ids_a[left]), pa.array(ids_b[right]), pa.array(shared)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "kind", "a_at", "b_at", "a_id", "b_id", "shared"])
