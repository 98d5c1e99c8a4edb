"""Token alignment, cover-tree search and prefix trie against brute force."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assay.llm import alignment, byte_bpe, cover_tree, decontamination, language_id, prefix_trie, simhash, substring_dedup, toxicity
from assay.llm.queries import QUERIES
from assay.llm.token_counts import byte_letters
from assay.plans import storing

FOLDER = "/root/testdata/sf0.001"
VOCABULARY, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [None, "", " ", "   \n\t ", "a", "▁a", "Hello  world\n\n\tfoo's 123 <|endoftext|><s></s>x é日本語 " + "z" * 700, "a\0b c　d ﬁ", "aa bb aa bb " * 3]


def plain_alignment(texts):
    """The contract, one link at a time, with the libraries themselves."""
    a, b = Tokenizer.from_file(VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    code = {letter: byte for byte, letter in enumerate(byte_letters())}

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    known, counts = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a, bytes_b = [bytes(code[c] for c in a.id_to_token(i)) for i in ids_a], [piece(i) for i in ids_b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            known.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links = [(i, ends_b.index(e)) for i, e in enumerate(ends_a) if e in set(ends_b)]
        pairs = [(ids_a[i], ids_b[j]) for i, j in links]
        counts.update(pairs)
        groups, at_a, at_b = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, ids_a[at_a : i + 1])) + "|" + ",".join(map(str, ids_b[at_b : j + 1])))
            at_a, at_b = i + 1, j + 1
        known.append((len(ids_a), len(ids_b), len(groups), pairs, sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, right), n in counts.items():
        most[right] = max(most[right], n)
    rows = []
    for found in known:
        if found is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, pairs, digest = found
        rows.append((n_a, n_b, n_groups, len(pairs), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), digest))
    return rows


def aligned(frame):
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return {r.doc_id: tuple(r[c] for c in columns) for r in frame.collect()}


def test_alignment_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = aligned(QUERIES["op11_token_alignment"](spark, FOLDER))
    assert got == dict(zip([d.doc_id for d in docs], plain_alignment([d.text for d in docs]), strict=True))


@pytest.mark.parametrize("chars", [7, alignment.CHARS])
def test_alignment_of_odd_texts_and_pieces(spark, monkeypatch, chars):
    rng = random.Random(4)
    texts = [*ODD, *["".join(rng.choice("ab  \n'sé日▁.") for _ in range(rng.randrange(40))) for _ in range(60)]]
    whole = [alignment.align_texts(words := alignment._vocabularies(open(VOCABULARY, encoding="utf-8").read(), open(MODEL, "rb").read()), [t])[0] for t in texts if t]
    for text, found in zip([t for t in texts if t], whole, strict=True):
        parts = alignment.align_texts(words, list(alignment.pieces(text, chars)))
        assert (found is None) == any(p is None for p in parts)
        if found:
            assert b"".join(p.groups for p in parts) == found.groups
            assert np.concatenate([p.pairs for p in parts]).tolist() == found.pairs.tolist()
    rows = [(i, t, 1, "x", b"") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `row` int, shard string, pairs binary")
    assert aligned(alignment.align(docs, VOCABULARY, MODEL)) == dict(enumerate(plain_alignment(texts)))


def test_alignment_counts_repeated_rows_and_rows_without_an_id(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "two"), (None, None)], "doc_id bigint, text string")
    rows = sorted(tuple(r) for r in alignment.align(docs, VOCABULARY, MODEL).drop("doc_id").collect())
    expected = plain_alignment(["one two", "one two", "two", None])
    assert rows == sorted(expected)
    assert alignment.align(docs.limit(0), VOCABULARY, MODEL).count() == 0


def test_alignment_of_a_long_text(spark):
    text = "alpha beta, gamma délta " * 60_000
    docs = spark.createDataFrame([(1, text), (2, "b" * 300_000)], "doc_id bigint, text string")
    got = aligned(alignment.align(docs, VOCABULARY, MODEL))
    a, b = Tokenizer.from_file(VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert got[1][:2] == (len(a.encode(" " + text, add_special_tokens=False).ids), len(b.encode(text)))
    assert got[2][0] == len(a.encode(" " + "b" * 300_000, add_special_tokens=False).ids)


def test_products_and_links(spark, monkeypatch):
    rng = np.random.default_rng(2)
    for _ in range(20):
        left, right = rng.integers(0, 3, (5, 7)), rng.integers(0, 3, (7, 4))

        def csr(dense):
            rows, columns = np.nonzero(dense)
            return alignment.Csr(np.searchsorted(rows, np.arange(len(dense) + 1)), columns, dense[rows, columns], dense.shape[1])

        made = alignment.product(csr(left), csr(right))
        dense = np.zeros((5, 4), int)
        dense[made.rows(), made.columns] = made.values
        assert (dense == left @ right).all()
        turned = alignment.transposed(csr(left))
        dense = np.zeros((7, 5), int)
        dense[turned.rows(), turned.columns] = turned.values
        assert (dense == left.T).all()
    monkeypatch.setattr(alignment, "PAIRS_AT_ONCE", 3)
    docs = spark.createDataFrame([(1, "Étion dans, çouelle un 日本"), (2, ""), (3, "▁")], "doc_id bigint, text string")
    rows = alignment.links(docs, VOCABULARY, MODEL).collect()
    assert {r.doc_id for r in rows} == {1}
    overlap = [(r.a_at, r.b_at, r.shared) for r in rows if r.kind == "overlap"]
    assert sum(n for *_, n in overlap) == len(" Étion dans, çouelle un 日本".encode())
    ends = [(r.a_at, r.b_at) for r in rows if r.kind == "end"]
    assert set(ends) <= {(a, b) for a, b, _ in overlap}
    group = {(r.a_at, r.b_at) for r in rows if r.kind == "group"}
    cuts = [(-1, -1), *ends]
    assert group == {(a, b) for (a0, b0), (a1, b1) in zip(cuts, ends) for a in range(a0 + 1, a1 + 1) for b in range(b0 + 1, b1 + 1)}


def plain_top(ids, vectors, k=10):
    rows = []
    for q, (query, a) in enumerate(zip(ids, vectors, strict=True)):
        if query is None or query % 100 or a is None:
            continue
        scores = [(-sum(x * y for x, y in zip(a, b)), (other is None, other or 0)) for n, (other, b) in enumerate(zip(ids, vectors, strict=True)) if n != q and b is not None]
        rows += [(query, rank, None if other[0] else other[1], -score) for rank, (score, other) in enumerate(sorted(scores)[:k], 1)]
    return sorted(rows, key=str)


def usable(v):
    return None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(1024 * float(x))) for x in v]


def test_top_k_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    got = QUERIES["op12_top_k_search"](spark, "/root/testdata/sf0.01")
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()), key=str) == plain_top([r.vec_id for r in rows], [usable(r.embedding) for r in rows])


@pytest.mark.parametrize("case", ["ties", "many groups", "huge", "odd"])
def test_top_k_of_odd_vectors(spark, monkeypatch, case):
    rng = np.random.default_rng(3)
    if case == "ties":  # a hot vector and few values
        vectors = [[0.5, 0.5, 0.0]] * 400 + rng.integers(0, 3, (500, 3)).tolist()
    elif case == "many groups":
        monkeypatch.setattr(cover_tree, "GROUP_BYTES", 4000)
        monkeypatch.setattr(cover_tree, "HOMES", 2)
        vectors = (rng.standard_normal((12, 8))[rng.integers(0, 12, 900)] + 0.05 * rng.standard_normal((900, 8))).tolist()
    elif case == "huge":
        vectors = (rng.standard_normal((300, 4)) * 10.0 ** rng.integers(-3, 6, (300, 1))).tolist()
    else:
        vectors = [None, [], [None, 1.0], [float("nan")], [float("inf"), 0.0], [1.0], [1.0, 2.0], [-1.0, 2.0, 3.0], [0.0], [-0.0]] * 30
    ids = [n if n % 7 else 7 * (n // 70) for n in range(len(vectors))]
    ids[-3:] = [None] * 3
    vectors = [None if v is None else [None if x is None else float(x) for x in v] for v in vectors]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in zip(ids, vectors, strict=True)], "vec_id bigint, embedding array<double>, vector string, query int")
    got = cover_tree.top_k(cover_tree.stepped(frame), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == plain_top(ids, [usable(v) for v in vectors])
    assert cover_tree.top_k(cover_tree.stepped(frame.limit(0)), F.col("vec_id") % 100 == 0).count() == 0


def test_cover_tree_covers():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-50, 50, (700, 5)), np.full((200, 5), 7)]).astype(float)
    open_nodes, seen = [cover_tree.cover_tree(points, 8)], 0
    while open_nodes:
        node = open_nodes.pop()
        assert np.linalg.norm(points[node.members] - points[node.centre], axis=1).max() <= node.radius
        assert not node.children or sorted(np.concatenate([c.members for c in node.children])) == sorted(node.members)
        seen += 0 if node.children else len(node.members)
        open_nodes += node.children
    assert seen == len(points)


def plain_trie(turns):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0, role or "", text or ""), (role or "", text or "")))
    own = {c: [t for _, t in sorted(rows)] for c, rows in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - c % 5 if c >= 0 else c + -c % 5  # the remainder has the sign of c
        whole = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children, leaves, saved = Counter(node[:-1] for node in members if node), Counter(), Counter()
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (held[0], len(node), members[node[:-1]][0] if node else None, len(held), children[node], leaves[node], saved[node], sha256(",".join(map(str, ends[node])).encode()).hexdigest())
        for node, held in members.items()
    )


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(frame):
    return sorted(tuple(r[c] for c in NODE) for r in frame.select(NODE).collect())


def test_trie_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert nodes(QUERIES["op13_prefix_trie"](spark, folder)) == plain_trie(rows)


@pytest.mark.parametrize("slices", [1, 2, 7, 40])
def test_trie_of_many_slices(spark, slices):
    rng = random.Random(slices)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["é", "b", "cc"])) for c in range(220) for t in range(rng.randrange(12))]
    rows += [(c, t, "user", "same") for c in range(1000, 1100) for t in range(3)]  # a hot conversation
    rows += [(5000, t, None, str(t % 2)) for t in range(300)] + [(5001, t, None, str(t % 2)) for t in range(290)]
    rows += [(7, None, "user", None), (7, None, None, "x"), (None, 1, "user", "x"), (9, 3, "user", "twice"), (9, 3, "user", "twice"), (-3, 1, "a", "b"), (2**62, 1, "a", "b")]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, size string, depth int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", slices)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert nodes(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(frame)))) == plain_trie(rows)
        assert nodes(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(frame.limit(0))))) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_member_intervals():
    rng = random.Random(8)
    sequences = sorted("".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(90))
    lcp = np.array([-1] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(sequences, sequences[1:])])
    levels = prefix_trie.sparse_table(lcp)
    for row, sequence in enumerate(sequences):
        for d in range(len(sequence) + 1):
            sharing = [i for i, s in enumerate(sequences) if s[:d] == sequence[:d]]
            found = [int(prefix_trie.extents(levels, np.array([row]), np.array([d]), left)[0]) for left in (True, False)]
            assert found == [sharing[0], sharing[-1]]


def test_a_long_row_of_starred_words_is_scored(spark):
    docs = spark.createDataFrame([(1, "a*" * 1_000_000), (2, "a$b c*d")], "doc_id bigint, text string")
    assert [r.n for r in docs.select(F.size(toxicity.words_of("text")).alias("n")).collect()] == [1, 2]
    model = toxicity.fit([["good", "fine"], ["bad*word", "vile"]] * 6, np.array([0, 1] * 6))
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())


def test_long_texts_are_encoded_and_decoded(spark):
    text = "alpha béta, " * 4_000_000
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id bigint").withColumn("text", F.when(F.col("doc_id") == 1, F.repeat(F.lit("alpha béta, "), 4_000_000)).otherwise("x"))
    rows = byte_bpe.encode(docs, ranks, decoded_as="back").select(F.size("ids").alias("n"), F.sha2("back", 256).alias("back")).collect()
    assert rows[0].back == sha256(text.encode()).hexdigest() and rows[0].n > 12_000_000 and rows[1].n == 1


def test_names_of_the_input_never_clash(spark):
    text = " ".join(f"w{i}" for i in range(80))
    names = ["_id", "_spans", "_encoded", "_scored", "_bits", "_row"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate([text, f"before {text} after", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "item_id bigint, text string")
    cut = substring_dedup.remove_passages(docs, substring_dedup.repeated_passages(docs))
    assert {r.doc_id: (r.text, r._id, r._spans) for r in cut.collect()}[1] == ("before after", "_id1", "_spans1")
    assert sorted((r.doc_id, r._id) for r in decontamination.without_contaminated(docs, items).collect()) == [(2, "_id2"), (3, "_id3")]
    encoded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), decoded_as="back")
    assert {r.doc_id: r._encoded for r in encoded.collect()} == {i: f"_encoded{i}" for i in range(4)}
    model = language_id.train(spark.createDataFrame([("the cat", "en"), ("der Hund", "de")], "text string, lang string"))
    assert {r.doc_id: r._scored for r in language_id.predict(docs, model).collect()} == {i: f"_scored{i}" for i in range(4)}
    assert {r.doc_id: (r._bits, r._row) for r in simhash.one_of_each_group(docs).collect()} == {0: ("_bits0", "_row0"), 2: ("_bits2", "_row2")}


def test_one_row_of_each_group_stays(spark):
    texts = ["one two three four five", "six seven eight nine ten", "clean words that nobody else has", "another text that stands alone"]
    rows = [(5, texts[0]), (5, texts[1]), (None, texts[2]), (None, texts[3]), (1, texts[0]), (None, texts[1]), (7, texts[2].upper()), (8, texts[3]), (8, texts[3])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, component string")
    got = sorted(map(tuple, simhash.one_of_each_group(docs).collect()), key=str)
    assert got == sorted([(1, texts[0], "x"), (5, texts[1], "x"), (7, texts[2].upper(), "x"), (8, texts[3], "x")], key=str)
    assert simhash.one_of_each_group(docs.limit(0)).count() == 0


def test_texts_are_not_stored_to_find_one_row_of_each_group(spark, tmp_path, monkeypatch):
    drawn = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{w}" for w in drawn.integers(0, 10**6, 400))) for i in range(300)]
    docs = spark.createDataFrame([*rows, rows[5], rows[5]], "doc_id bigint, text string")
    monkeypatch.setattr("assay.plans.storing.scratch_dir", lambda spark, label: str(tmp_path / f"{label}-{len(list(tmp_path.iterdir()))}"))
    assert sorted(map(tuple, simhash.one_of_each_group(docs).collect())) == rows
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < sum(len(t) for _, t in rows) / 5


def test_the_pipeline_keeps_rows_that_share_an_id(spark):
    import corpus_pipeline

    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = given.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("doc_id") % 50)).withColumn("_id", F.lit(1))
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, FOLDER).select(simhash.fingerprint("text").alias("bits")).collect()
    groups = simhash.near_duplicates(given).select("component_id").distinct().count()
    assert len(kept) == groups
    for name in ("substring_dedup", "benchmark_decontamination"):
        assert dict(corpus_pipeline.STAGES)[name](spark, docs, FOLDER).columns == docs.columns


def plain_extended(a, b, cost):
    """The end of the alignment of beginnings with the highest score, from the whole table of edit distances."""
    best = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = [best[i - 1, j] + 1] if i else []
            ways += [best[i, j - 1] + 1] if j else []
            ways += [best[i - 1, j - 1] + (a[i - 1] != b[j - 1])] if i and j else []
            best[i, j] = min(ways, default=0)
    return best, lambda i, j: (i + j) // 2 - (1 + cost) * best[i, j]


def test_extended_finds_the_best_ends(monkeypatch):
    monkeypatch.setattr(substring_dedup, "DROP", 1000)  # nothing is given up
    drawn = np.random.default_rng(4)
    sides = []
    for _ in range(40):
        a = drawn.integers(0, 5, drawn.integers(0, 14)).tolist()
        b = [w for w in a if drawn.random() > 0.15] + drawn.integers(0, 5, drawn.integers(0, 3)).tolist()
        sides.append((a, b))
    flat = [np.array(sum((pair[k] for pair in sides), [0]), np.uint32) for k in (0, 1)]
    sizes = [np.array([len(pair[k]) for pair in sides]) for k in (0, 1)]
    starts = [np.cumsum(n) - n + 1 for n in sizes]
    for cost in (1, 3):
        for step in (1, -1):
            at = starts if step == 1 else [s + n - 1 for s, n in zip(starts, sizes, strict=True)]
            found = substring_dedup.extended(*flat, *at, *sizes, np.full(len(sides), step), cost)
            for (a, b), i, j in zip(sides, *found, strict=True):
                best, score = plain_extended(a[::step], b[::step], cost)
                assert score(i, j) == max(score(*ends) for ends in best)


def test_reachable_bounds_reached_from_above():
    drawn = np.random.default_rng(6)
    shape = (300, substring_dedup.REACH + substring_dedup.K + 1)
    a = drawn.integers(0, 20, shape).astype(np.int16)
    b = np.where(drawn.random(shape) < 0.2, 21, np.roll(a, 1, 1)).astype(np.int16)
    n_a, n_b = (drawn.integers(0, shape[1], shape[0]) for _ in range(2))
    for i in range(shape[0]):
        a[i, n_a[i] :], b[i, n_b[i] :] = -1, -2
    exact = substring_dedup.reached(a, b, n_a, n_b, 9)
    assert (substring_dedup.reachable(a, b, n_a, 9) >= exact).all()
    assert exact.max() > 9


def test_outranked_counts_within_stretches():
    drawn = np.random.default_rng(7)
    sizes = drawn.integers(1, 120, 20)
    place = np.repeat(np.arange(20), sizes)
    offset = np.concatenate([np.sort(drawn.choice(2 * substring_dedup.REACH + substring_dedup.K, n, replace=False)) for n in sizes])
    rank, wanted = drawn.permutation(len(place)) + 1, drawn.choice(len(place), 150, replace=False)
    for size in (49, 64):
        got = substring_dedup.outranked(place, offset, rank, size, wanted)
        for i, most in zip(wanted, got, strict=True):
            higher = offset[(place == place[i]) & (rank > rank[i])]
            assert most == max(((higher >= s) & (higher < s + size)).sum() for s in range(offset[i] - size + 1, offset[i] + 1))


def test_places_that_share_frequent_words_alone_make_no_pairs():
    import pyarrow as pa

    # one place has 24 pairs that many others have, spread over it, and a rare one: no stretch has enough of them beside it
    offset = np.append(np.arange(0, 120, 5), 61)
    n = np.append(np.full(24, 1000), 2)
    columns = [np.zeros(25, np.int64), offset, np.arange(25), n]
    kept = substring_dedup._rare_pairs(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["at", "offset", "token", "n"]))
    assert len(kept[0]) == 0
    # two places with a passage in common keep one of its pairs, however frequent the others are
    drawn = np.random.default_rng(3)
    for _ in range(50):
        n, shared = drawn.integers(2, 2000, 200), np.arange(substring_dedup.SHARED)
        sides = []
        for first, size in ((0, 49), (100, 64)):  # (number of the first pair of its own, length of the stretch)
            within = np.sort(drawn.choice(size, len(shared), replace=False)) + 30
            rest = np.setdiff1d(np.arange(130), within)
            rest = rest[drawn.random(len(rest)) < 0.5]
            at, token = np.append(within, rest), np.append(shared, first + 20 + np.arange(len(rest)) % 80)
            order = np.argsort(at)
            sides.append([np.ones(len(at), np.int64), at[order], token[order], n[token[order]]])
        mine, other = (substring_dedup._rare_pairs(pa.RecordBatch.from_arrays([pa.array(c) for c in side], ["at", "offset", "token", "n"])) for side in sides)
        assert set(mine[0].filter(mine[2]).to_pylist()) & set(other[0].to_pylist()) & set(shared.tolist())


def test_word_hashes_depend_on_the_words_alone():
    import pyarrow as pa

    words = ["", "a", "b", "ab", "ba", "aa", "wörter", "x" * 3000, "x" * 2999]
    whole = substring_dedup._hashes(pa.array(words))
    assert len(set(whole.tolist())) == len(words)
    assert substring_dedup._hashes(pa.array(["zz", *words]).slice(1)).tolist() == whole.tolist()
    assert len(substring_dedup._hashes(pa.array([], pa.string()))) == 0
    many = pa.array([f"{i:x}" for i in range(200_000)])
    assert len(set(substring_dedup._hashes(many).tolist())) == len(many)


def test_short_words_are_contracted_once_and_batches_are_small(spark, monkeypatch):
    import pyarrow as pa

    codec = byte_bpe.Codec(byte_bpe._ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    words, seen = [f" kwrtz{i}" for i in range(50)], []
    contracted = codec._contracted
    monkeypatch.setattr(codec, "_contracted", lambda new: seen.extend(new) or contracted(new))
    first, again = (byte_bpe._encoded(codec, pa.array([words, words[:5]])).to_pylist() for _ in range(2))
    assert first == again and seen == words
    byte_bpe.encode(spark.createDataFrame([("a",)], "text string"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= byte_bpe.ROWS


def test_texts_that_share_an_id_are_cut_one_by_one(spark):
    drawn = np.random.default_rng(9)
    noise = lambda n: [f"w{i}" for i in drawn.integers(0, 10**6, n)]
    passage, other = noise(70), noise(60)
    texts = [(1, passage), (2, other), (5, noise(40) + passage), (5, noise(300) + other + noise(5)), (5, noise(8)), (2**40, passage[:55]), (None, passage)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id bigint, text string")
    rows = substring_dedup.repeated_passages(docs).collect()
    assert sorted((r.doc_id, r.begin, r.end, r.ref_id, r.ref_begin, r.ref_end) for r in rows) == [(5, 40, 110, 1, 0, 70), (5, 300, 360, 2, 0, 60), (2**40, 0, 55, 1, 0, 55)]
    cut = substring_dedup.remove_passages(docs, substring_dedup.repeated_passages(docs, by_text=True)).collect()
    left = [(1, passage), (2, other), (5, texts[2][1][:40]), (5, texts[3][1][:300] + texts[3][1][360:]), (5, texts[4][1]), (2**40, []), (None, passage)]
    assert sorted((str(r.doc_id), r.text.split()) for r in cut) == sorted((str(i), t) for i, t in left)


def test_runs_of_seeds_that_several_documents_have():
    import pyarrow as pa

    drawn = np.random.default_rng(3)
    run = drawn.integers(0, 2**63, 58, dtype=np.uint64)
    texts = [np.concatenate([drawn.integers(0, 2**63, n, dtype=np.uint64), part, drawn.integers(0, 2**63, 90, dtype=np.uint64)]) for n, part in ((33, run), (0, run), (70, run[:49]))]
    text, pos, value = substring_dedup.seeds(np.concatenate(texts), np.array([len(t) for t in texts]))
    held = [{v for t, v in zip(text, value, strict=True) if t == i} for i in range(3)]
    shared = np.array([sum(v in h for h in held) > 1 for v in value])
    columns = [text[shared], pos[shared], np.array([len(t) for t in texts])[text[shared]]]
    rows = pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["doc_id", "pos", "size"])
    found = {d: (b, n) for d, b, n in zip(*(c.to_pylist() for c in substring_dedup._spans(rows)), strict=True)}
    # all runs of the repeat, and few beside it
    assert found[0][0] <= 33 and found[0][0] + found[0][1] >= 91 and found[0][1] <= 58 + 2 * substring_dedup.W
    assert found[1][0] == 0 and 58 <= found[1][1] <= 58 + substring_dedup.W


def test_long_tables_are_worked_off_in_parts_with_equal_results(spark, monkeypatch):
    drawn = np.random.default_rng(11)
    noise = lambda n: [f"w{i}" for i in drawn.integers(0, 10**6, n)]
    phrase, tail, verbatim = noise(20), noise(50), noise(60)
    changed = [w if i % 12 else f"x{i}" for i, w in enumerate(tail)]
    texts = {i: noise(30) + phrase + noise(30) for i in range(60)}
    # a passage around the phrase that the phrase's first document lacks, with changes, and a verbatim one
    texts[40], texts[50] = noise(70) + phrase + tail + noise(10), noise(90) + phrase + changed
    texts[51], texts[52] = noise(40) + verbatim, verbatim + noise(40)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string")
    for module in (storing, substring_dedup):  # the files may stay
        monkeypatch.setattr(module, "release", lambda spark: None)
    by_task = sorted(substring_dedup.repeated_passages(docs).collect())
    assert {(50, 40), (52, 51)} <= {(r.doc_id, r.ref_id) for r in by_task}
    halves = lambda key, rows, at_once: [F.pmod(F.xxhash64(key), F.lit(2)) == i for i in range(2)]
    monkeypatch.setattr(substring_dedup, "_parts", halves)
    monkeypatch.setattr(substring_dedup, "MANY", substring_dedup.FEW)
    assert sorted(substring_dedup.repeated_passages(docs).collect()) == by_task


def test_parts_hold_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LEAST_AT_ONCE", 10)
    rows = spark.range(100).toDF("key")
    for count, at_once, n in ((0, 0, 1), (100, 100, 1), (100, 30, 4), (100, 0, 10)):
        parts = substring_dedup._parts("key", count, at_once)
        assert len(parts) == n and sorted(r.key for part in parts for r in rows.filter(part).collect()) == list(range(100))


@pytest.mark.parametrize("at_once", [1, 300, 1 << 21])
def test_one_task_finds_the_places_that_joins_find(monkeypatch, at_once):
    import pyarrow as pa

    monkeypatch.setattr(substring_dedup, "PAIRS_AT_ONCE", at_once)
    drawn, rows = np.random.default_rng(13), []
    for seed, n in ((-5, 50), (7, 40), (9, 1)):
        shared = drawn.integers(0, 2**32, (5, 133), np.uint32)
        for i in range(n):
            words = drawn.integers(0, 2**32, 133, np.uint32)
            begin = int(drawn.integers(0, 60))
            words[begin : begin + 70] = shared[drawn.integers(0, 5), begin : begin + 70]
            lead = int(drawn.integers(0, 30)) if i % 3 == 0 else 0
            rows.append((seed, i // 2, 100 + i, bool(drawn.random() < 0.7), 900 + i, lead, words[lead:].tobytes()))
    types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f"c{i}" for i in range(7)])
    place, nth, value = substring_dedup._pairs_around(batch.column(0), batch.column(6))
    counts = {v: int(n) for v, n in zip(*np.unique(value, return_counts=True), strict=True)}
    pairs = [(2 * p + rows[p][3], rows[p][5] + k, v, counts[v]) for p, k, v in zip(place.tolist(), nth.tolist(), value.tolist(), strict=True) if counts[v] > 1]
    kept = substring_dedup._rare_pairs(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pairs, strict=True)], ["at", "offset", "token", "n"]))
    by_token = {}
    for token, at, own in zip(*(c.to_pylist() for c in kept), strict=True):
        by_token.setdefault(token, []).append((at, own))
    tied = {(a // 2, b // 2) for group in by_token.values() for a, own in group if own for b, _ in group if a > b}
    expected = sorted((rows[a][1], rows[a][2], rows[b][1], rows[b][2], rows[a][4]) for a, b in tied if rows[a][1] > rows[b][1])
    got = [list(zip(*(c.to_pylist() for c in columns), strict=True)) for columns in substring_dedup._alike_places(batch)]
    assert sorted(row for some in got for row in some) == expected and len(expected) > 50
    assert len(got) > 1 or at_once > 300


def test_ends_are_moved_at_several_costs_at_once():
    drawn = np.random.default_rng(17)
    a = drawn.integers(0, 50, 900).astype(np.uint32)
    b = np.where(drawn.random(900) < 0.2, 99, a).astype(np.uint32)
    at, step = np.array([0, 450, 899, 300, 0]), np.array([1, 1, -1, -1, 1])
    room = np.where(step > 0, 900 - at, at + 1) * np.array([1, 1, 1, 1, 0])
    costs = np.array([3, 1, 2, 4, 1])
    together = substring_dedup.extended(a, b, at, at, room, room, step, costs)
    for i in range(5):
        alone = substring_dedup.extended(a, b, at[i : i + 1], at[i : i + 1], room[i : i + 1], room[i : i + 1], step[i : i + 1], int(costs[i]))
        assert (together[0][i], together[1][i]) == (alone[0][0], alone[1][0])
    assert together[0][1] > 300 and together[0][4] == 0
