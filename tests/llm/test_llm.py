"""The training-text operators against brute force, round trips and held-out rows."""

import base64
import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from assay.llm import byte_bpe, decontamination, embedding_dedup, language_id, licences, quality, simhash, substring_dedup, token_counts, toxicity
from assay.llm.common import components, held_out, in_pieces
from assay.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
ODD = [None, "", "   \n\t ", "a", "Hello  world\n\n\tfoo's 123 <|endoftext|>x é日本語 " + "z" * 700, "!" * 300 + " " * 40 + "a"]


def docs_of(spark, texts, **more):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, words string")


def no_rows(spark):
    return docs_of(spark, [])


def union_find(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)
    return [find(i) for i in range(n)]


def test_pieces_cover_texts_with_overlap():
    texts = ["abcdefghij", "", "kl"]
    for size in (1, 3, 100):
        back = [""] * 3
        for pieces in in_pieces(texts, size, 2):
            for n, piece, lead, _ in pieces:
                back[n] += piece[lead:]
        assert back == texts


def test_components_reach_the_smallest_node(spark):
    drawn = random.Random(5)
    pairs = [(drawn.randrange(300), drawn.randrange(300)) for _ in range(170)] + [(500 + i, 501 + i) for i in range(40)]
    got = dict(components(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b").collect())
    expected = union_find(600, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: expected[x] for x in linked}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_language_is_learned_from_other_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (rows.lang_pred == rows.lang)[rows.held_out].mean() > 0.97
    assert rows.score.between(0, 1).all() and 0.1 < rows.held_out.mean() < 0.3


def test_language_of_odd_texts(spark):
    known = spark.createDataFrame([("the cat", "en"), ("der Hund", "de"), ("nothing", None), (None, "fr")], "text string, lang string")
    model = language_id.train(known)
    assert model.languages == ("de", "en")
    rows = language_id.predict(docs_of(spark, [*ODD, "12 34", "THE CAT", "the cat"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and rows[6].lang_pred == "und" and rows[0].score == 0
    assert rows[7].lang_pred == rows[8].lang_pred == "en" and rows[7].score == rows[8].score
    assert language_id.predict(no_rows(spark), model).count() == 0
    empty = language_id.train(known.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs_of(spark, ["the cat"]), empty).collect()} == {"und"}


def test_language_features_do_not_depend_on_the_cut(monkeypatch):
    text = "some words of a text that is cut in pieces " * 5
    model = language_id.LanguageModel(("a", "b"), np.random.default_rng(1).normal(size=(1 << language_id.BUCKET_BITS, 2)), np.zeros(2))
    sums = []
    for piece in (1 << 19, 7):
        monkeypatch.setattr(language_id, "PIECE", piece)
        total = np.zeros(2)
        for _, bucket in language_id.gram_buckets([text.strip()]):
            total += model.weights[bucket].sum(0)
        sums.append(total)
    assert np.allclose(*sums)


def test_token_counts_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD, *[r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()], "x" * 5000, "　 \xa0 a  b"]
    rows = token_counts.count_tokens(docs_of(spark, texts), path).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r.n_bytes for r in rows] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in rows] == [r.n_tokens > 512 for r in rows] and rows[0].score == "x"
    assert token_counts.count_tokens(no_rows(spark), path).count() == 0


def test_ids_are_those_of_the_library_and_decode(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, *[r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()], "ab" * 2000]
    coded = byte_bpe.encode(docs_of(spark, texts), path, decoded_as="back")
    rows = coded.withColumn("again", byte_bpe.decoded(coded, path)).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == [library.encode_ordinary(t or "") for t in texts]
    assert [bytes(r.back) for r in rows] == [bytes(r.again) for r in rows] == [(t or "").encode() for t in texts]
    assert byte_bpe.encode(no_rows(spark), path).count() == 0


def test_bpe_query_has_digests_of_ids_and_bytes(spark):
    texts = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = {r.doc_id: r.ids for r in byte_bpe.encode(spark.read.parquet(f"{FOLDER}/documents.parquet"), path).collect()}
    for row in QUERIES["op4_byte_bpe"](spark, FOLDER).collect():
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids[row.doc_id])).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((texts[row.doc_id] or "").encode()).hexdigest()
        assert row.n_tokens == len(ids[row.doc_id])


def test_trie_finds_all_close_codes():
    drawn = np.random.default_rng(3)
    codes = [np.unique(drawn.integers(0, 1 << 16, n)) for n in (400, 1, 2, 50)]
    ends = np.cumsum([len(c) for c in codes])
    left, right = simhash.close_pairs(np.concatenate(codes), ends - [len(c) for c in codes], ends)
    expected = set()
    for c, end in zip(codes, ends, strict=True):
        expected |= {(end - len(c) + i, end - len(c) + j) for i, j in combinations(range(len(c)), 2) if bin(c[i] ^ c[j]).count("1") <= 2}
    assert {tuple(sorted(p)) for p in zip(left.tolist(), right.tolist(), strict=True)} == expected and len(left) == len(expected)


def test_simhash_components_are_those_of_all_pairs(spark):
    texts = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()] + ODD
    texts += [t.replace("the", "tha", 1) for t in texts[:40] if t and len(t) > 2000]
    rows = simhash.near_duplicates(docs_of(spark, texts)).orderBy("doc_id").collect()
    prints = [simhash.simhash(t) & (2**64 - 1) for t in texts]
    pairs = [(i, j) for i, j in combinations(range(len(texts)), 2) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    assert [r.fingerprint for r in rows] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in rows] == union_find(len(texts), pairs)
    assert rows[texts.index(None)].fingerprint == "0" * 16
    assert simhash.near_duplicates(no_rows(spark)).count() == 0


def test_simhash_of_a_short_text_is_its_hash():
    from xxhash import xxh64_intdigest

    assert simhash.simhash("Ab c") & (2**64 - 1) == xxh64_intdigest(b"ab c", 42)
    assert simhash.shingles("a b c d") == [b"a b c", b"b c d"] and simhash.shingles(" \n") == []


def test_embedding_links_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)  # buckets in several parts
    drawn = np.random.default_rng(11)
    centres = drawn.normal(size=(30, 24))
    vectors = [(c + drawn.normal(scale=0.07, size=24)).tolist() for c in centres for _ in range(8)]
    vectors += [(centres[0] + drawn.normal(scale=0.03, size=24)).tolist() for _ in range(60)] + [vectors[3]] * 3
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [None, *[1.0] * 23], [1.0], [2.0]]
    rows = [(i, v, 0) for i, v in enumerate(vectors + odd)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).orderBy("vec_id").collect()
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    n = len(vectors)
    close = unit @ unit.T >= 0.95
    found, there = sum(r.n_links for r in got[:n]), close.sum() - n
    assert 0.98 * there <= found <= there
    pairs = [(i, j) for i, j in combinations(range(n), 2) if close[i, j]]
    assert [r.component_id for r in got[:n]] == union_find(n, pairs)
    assert [r.n_links for r in got[n:]] == [0, 0, 0, 0, 0, 1, 1] and [r.kept for r in got[n:]] == [True] * 6 + [False]


def test_embeddings_without_rows(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def invented(drawn, n):
    return [f"w{drawn.randrange(5000)}" for _ in range(n)]


def test_repeated_passages_are_found_and_others_left(spark):
    drawn = random.Random(2)
    passage, fuzzy = invented(drawn, 60), invented(drawn, 120)
    texts = [invented(drawn, 200) for _ in range(8)]
    texts[1][50:50] = passage
    texts[3][10:10] = passage
    texts[6] += passage
    changed = [*fuzzy[:60], "changed", *fuzzy[61:]]
    texts[2][0:0] = fuzzy
    texts[5][100:100] = changed
    texts[7] = texts[4]
    line = invented(drawn, 12)
    texts += [invented(drawn, 30) + line * 9, invented(drawn, 40) + line * 8]
    docs = docs_of(spark, [*map(" ".join, texts), *ODD])
    rows = substring_dedup.repeated_passages(docs).orderBy("doc_id", "begin").collect()
    found = {(r.doc_id, r.ref_id): (r.begin, r.end) for r in rows}
    assert found[3, 1] == (10, 70) and found[6, 1] == (200, 260) and found[5, 2] == (100, 220) and found[7, 4] == (0, 200)
    assert {d for d, _ in found} == {3, 5, 6, 7, 9}
    assert all(r.identity >= 0.8 and r.end - r.begin >= 50 for r in rows)
    rest = {r.doc_id: r.text for r in substring_dedup.remove_passages(docs, substring_dedup.repeated_passages(docs)).collect()}
    assert rest[1] == " ".join(texts[1]) and rest[3] == " ".join(texts[3][:10] + texts[3][70:]) and rest[7] == ""
    assert len(rest) == docs.count() and rest[10] is None
    assert substring_dedup.repeated_passages(no_rows(spark)).count() == 0


def test_best_chain_is_the_one_of_all_chains():
    drawn = random.Random(8)
    for _ in range(40):
        points = sorted({(drawn.randrange(40), drawn.randrange(40)) for _ in range(9)})
        x, y = [p[0] for p in points], [p[1] for p in points]
        cost, k = substring_dedup.GAP_COST, substring_dedup.K

        def worth(chain):
            steps = zip(chain, chain[1:], strict=False)
            return k * len(chain) - cost * sum(x[b] - x[a] + y[b] - y[a] for a, b in steps)

        ordered = [
            c
            for n in range(1, len(points) + 1)
            for c in combinations(range(len(points)), n)
            if all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:], strict=False))
        ]
        assert worth(substring_dedup.chains(x, y)[0]) == pytest.approx(max(map(worth, ordered)))


def test_passages_behind_a_long_gap_and_around_different_words_are_kept(spark):
    drawn = random.Random(5)
    one, two, three = (invented(drawn, n) for n in (400, 70, 60))
    noise = lambda n: invented(drawn, n)
    texts = {1: one + noise(90) + two + noise(55) + three, 2: one + noise(100) + two + noise(60) + three}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id bigint, text string")
    covered = {i for r in substring_dedup.repeated_passages(docs).collect() for i in range(r.begin, r.end)}
    wanted = {*range(400), *range(500, 570), *range(630, 690)}
    assert wanted <= covered and len(covered - wanted) < 40
    x = [*range(0, 400, 10), *range(600, 900, 10)]
    assert [len(c) for c in substring_dedup.chains(x, x)] == [40, 30]


def test_repeats_whose_parts_occur_earlier_elsewhere_are_found(spark):
    drawn = random.Random(12)
    texts, passages = {}, []
    for i in range(12):  # halves occur in two documents before both together do
        passage = invented(drawn, 50 + i)
        halves = [passage[:30], passage[30:], passage, passage]
        texts |= {4 * i + n: invented(drawn, 20 + n) + half + invented(drawn, 20) for n, half in enumerate(halves)}
        passages.append(set(range(23, 23 + len(passage))))
    texts[90] = texts[2] + texts[3]
    texts[91] = list(texts[90])
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id bigint, text string")
    rows = substring_dedup.repeated_passages(docs).collect()
    covered = {d: {i for r in rows if r.doc_id == d for i in range(r.begin, r.end)} for d in texts}
    assert all(passages[i] <= covered[4 * i + 3] and not covered[4 * i + 2] for i in range(12))
    assert covered[91] == set(range(len(texts[91])))
    assert all(texts[r.doc_id][r.begin : r.end] == texts[r.ref_id][r.ref_begin : r.ref_end] for r in rows if r.identity == 1)


def test_passages_with_a_tenth_and_a_fifth_of_their_words_changed_are_found(spark):
    drawn = random.Random(21)
    texts, changed = {}, {}
    for i in range(30):
        passage, words = invented(drawn, 60), 12 if i >= 20 else 6
        other = list(passage)
        for at in drawn.sample(range(60), words):
            other[at] = f"v{drawn.randrange(5000)}"
        texts[i], texts[100 + i] = (invented(drawn, 40) + p + invented(drawn, 70) for p in (passage, other))
        changed[100 + i] = words
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id bigint, text string")
    rows = substring_dedup.repeated_passages(docs).collect()
    found = {r.doc_id for r in rows if r.ref_id == r.doc_id - 100}
    assert all(d in found for d, words in changed.items() if words == 6) and sum(words == 12 for d, words in changed.items() if d in found) >= 8
    assert all(r.ref_id == r.doc_id - 100 and r.identity >= 0.8 and 30 <= r.begin and r.end <= 110 for r in rows)


@pytest.mark.parametrize("few", [32, 0])
def test_changed_passages_whose_parts_occur_earlier_elsewhere_are_found(spark, monkeypatch, few):
    monkeypatch.setattr(substring_dedup, "FEW", few, raising=False)  # 0: all places are compared by their pairs of words
    drawn = random.Random(33)
    texts, phrase = {}, invented(drawn, 14)
    for i in range(40):  # both halves come first in two other documents
        passage = invented(drawn, 26) + (phrase if i % 2 else invented(drawn, 14)) + invented(drawn, 26)
        other = list(passage)
        for at in drawn.sample(range(66), 3 + i % 7):
            other[at] = f"v{drawn.randrange(5000)}"
        halves = [passage[:33], passage[33:], passage, other]
        texts |= {1000 * n + i: invented(drawn, 20 + n) + half + invented(drawn, 20) for n, half in enumerate(halves)}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id bigint, text string")
    rows = substring_dedup.repeated_passages(docs).collect()
    assert {(r.doc_id, r.ref_id) for r in rows} == {(3000 + i, 2000 + i) for i in range(40)}
    assert all(r.identity >= 0.8 and r.end - r.begin >= 50 and 15 <= r.begin and r.end <= 97 for r in rows)


def test_seeds_are_shared_by_any_common_run():
    drawn = np.random.default_rng(4)
    run = drawn.integers(0, 2**63, substring_dedup.K + substring_dedup.W - 1, dtype=np.uint64)
    a = np.concatenate([drawn.integers(0, 2**63, 31, dtype=np.uint64), run, drawn.integers(0, 2**63, 5, dtype=np.uint64)])
    b = np.concatenate([run, drawn.integers(0, 2**63, 90, dtype=np.uint64)])
    text, pos, value = substring_dedup.seeds(np.concatenate([a, b]), np.array([len(a), 0, len(b)]))
    mine = {(p - 31, v) for t, p, v in zip(text, pos, value, strict=True) if t == 0}
    assert mine & {(p, v) for t, p, v in zip(text, pos, value, strict=True) if t == 2}


ITEM = "How long does the red train need for 120 km when its usual speed is 80 km per hour and Maria waits five minutes?"


def test_reparameterised_items_are_caught(spark):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "too short"), (1, ITEM)], "item_id bigint, text string")
    other = ITEM.replace("120", "360").replace("80", "90").replace("Maria", "Elena").replace("five", "nine")
    mixed = "How long does the red train need for 7 km when its usual speed is 7 km per hour and Anna waits 9 minutes?"
    two = "need for 5 km when its usual speed is 6 km per hour and 5 km per hour more than usual speed"
    texts = ["Intro words here. " + ITEM + " More.", other, mixed, "How long does it take?", two, *ODD]
    docs = docs_of(spark, texts)
    for sent in (10**6, 0):  # by a broadcast of the hashes, and by a join of all windows
        rows = {r.doc_id: r for r in decontamination.contaminated(docs, items, sent_windows=sent).collect()}
        assert {0, 1} <= set(rows) and rows[0].same_values and not rows[1].same_values and 3 not in rows
        assert {r.item_id for r in rows.values()} == {1}
    assert {r.doc_id for r in decontamination.without_contaminated(docs, items).collect()} >= {3, 5, 6, 7}
    assert decontamination.contaminated(no_rows(spark), items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0


def test_inconsistent_values_are_no_copy(spark):
    item = "take number 5 from the first box and put number 5 into the second box then add number 5 again slowly"
    good, bad = item.replace("5", "8"), item.replace("5", "8", 2)
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = decontamination.contaminated(docs_of(spark, [good, bad]), items).collect()
    assert [r.doc_id for r in rows] == [0]


def test_a_copy_beside_another_version_is_caught(spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    other, third = ITEM.replace("120", "360").replace("80", "90"), ITEM.replace("120", "7").replace("80", "5").replace("red", "very old red")
    texts = [f"{ITEM} {other}", f"{other} Then again. {third}", f"{other} {other.replace('360', '11')} {ITEM}"]
    for sent in (10**6, 0):
        rows = {r.doc_id: r for r in decontamination.contaminated(docs_of(spark, texts), items, sent_windows=sent).collect()}
        assert set(rows) == {0, 1, 2} and rows[0].same_values and not rows[1].same_values and rows[2].same_values


def test_copies_without_enough_plain_words_are_caught(spark):
    texts = ["What is 12 times 7?", "3 4 5 6 7 8 9 10 11 12 13 14", "Ask Anna, Ben Carl Dora Emil Fritz Gina Hugo Ida now", ITEM]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    docs = [*(f"Some words first. {t} And others behind it." for t in texts), ITEM.upper(), ITEM.title(), "What is 13 times 7?", *ODD]
    for sent in (10**6, 0):
        rows = decontamination.contaminated(docs_of(spark, docs), items, sent_windows=sent).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (5, 3)}


def test_benchmark_passages_of_the_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    rows = {(r.doc_id, r.item_id) for r in QUERIES["op8_benchmark_decontamination"](spark, folder).collect()}
    plain = lambda t: " ".join(t.split())
    items = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = [(r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert {(d, i) for d, text in texts for i, item in items if item in text} <= rows


def test_toxicity_on_held_out_rows(spark):
    drawn = random.Random(1)
    insults = ["blorgface", "snarfling", "grumblewit"]
    rows = []
    for i in range(400):
        words, toxic = invented(drawn, drawn.randrange(5, 200)), i % 4 == 0
        if toxic:
            words[drawn.randrange(len(words))] = drawn.choice(insults)
        rows.append((i, " ".join(words), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(table, table.select("doc_id", "toxic").filter(~held_out()))
    scored = toxicity.score(table.filter(held_out()), model).toPandas()
    assert ((scored.score >= 0.5) == (scored.toxic == 1)).mean() > 0.95 and (scored.predicted == (scored.score >= 0.5)).all()
    odd = toxicity.score(docs_of(spark, [*ODD, "you are a blorgfacce honestly"]), model).orderBy("doc_id").collect()
    assert [r.score for r in odd[:3]] == [0, 0, 0] and odd[-1].predicted == 1
    assert toxicity.score(no_rows(spark), model).count() == 0
    assert toxicity.train(table, table.select("doc_id", "toxic").filter("toxic = 0")) is None
    assert toxicity.score(docs_of(spark, ["a"]), None).first().score == 0


def test_licences_in_canonical_form(spark):
    mit = next(text for name, text in licences.KNOWN if text.startswith("Permission is hereby"))
    texts = ["Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ; "), "Some text.\nreleased under the mit licence!\nmore", "nothing", *ODD]
    rows = licences.scan(docs_of(spark, texts), licences.known_licences(spark)).orderBy("doc_id").collect()
    assert rows[0].licence == "MIT" and rows[1].licence is None and rows[1].notices == "MIT" and rows[2].notices is None
    assert rows[3].digest is None and rows[4].digest is None
    assert licences.scan(no_rows(spark), licences.known_licences(spark)).count() == 0


def test_usual_licence_files_match_as_a_whole(spark):
    import textwrap

    titles = {"MIT": "The MIT License (MIT)", "ISC": "ISC License", "BSD-2-Clause": 'BSD 2-Clause "Simplified" License', "BSD-3-Clause": "BSD 3-Clause License"}
    wholes = [(name, text) for name, text in licences.KNOWN if len(text) > 400]
    assert {name for name, _ in wholes} == {"MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Unlicense"}
    files = []
    for name, text in wholes:
        for width in (60, 72, 79):
            body = "\n".join(textwrap.fill(part, width) for part in text.split("\n"))
            files.append((name, f"{titles.get(name, '')}\n\nCopyright (c) 2019-2024, Some One <some@one.org>\nAll rights reserved.\n\n{body}\n"))
        files.append((name, text.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "- ")))
    docs = docs_of(spark, [text for _, text in files])
    found = {r.doc_id: r.licence for r in licences.scan(docs, licences.known_licences(spark)).collect()}
    assert [found[i] for i in range(len(files))] == [name for name, _ in files]


def test_licence_rows_stay_rows(spark):
    rows = [(7, "a b", 1, 2), (7, "a b", 3, 4), (7, "c", 5, 6), (7, "a\nb", 7, 8), (None, None, 1, 1), (None, None, 1, 1), (None, "SPDX-License-Identifier: MIT", 1, 1), (8, "MIT License", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int, forms int")
    out = licences.scan(docs, licences.known_licences(spark)).collect()
    assert sorted((r.doc_id or 0, r.digest is not None, r.notices or "") for r in out) == [(0, False, "")] * 2 + [(0, True, "MIT")] + [(7, True, "")] * 4 + [(8, False, "")]


def test_licence_query_agrees_with_sql(spark):
    from compare import connect, duckdb_rows, spark_rows

    assert spark_rows(QUERIES["op10_licence_scan"](spark, FOLDER)) == duckdb_rows(connect(FOLDER), SQL["op10_licence_scan"])


def brute_perplexity(trusted, text):
    """Interpolated modified Kneser-Ney from its definition."""
    grams = lambda t: [("\x02" * 3 + t + "\x03")[i : i + 4] for i in range(len(t) + 1)]
    counts = {4: {}}
    for t in trusted:
        for g in grams(t):
            counts[4][g] = counts[4].get(g, 0) + 1
    for n in (3, 2, 1):
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    cuts = {}
    for n in (2, 3, 4):
        c = [list(counts[n].values()).count(i) for i in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1]) if all(c) else 0
        ideal = [1 - 2 * y * c[1] / c[0], 2 - 3 * y * c[2] / c[1], 3 - 4 * y * c[3] / c[2]] if all(c) else [0.5, 1, 1.5]
        cuts[n] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(ideal)]
    total, kinds = sum(counts[1].values()), len(counts[1])

    def p(g):
        n = len(g)
        if n == 1:
            return max(counts[1].get(g, 0) - 0.75, 0) / total + 0.75 * kinds / total / (kinds + 1)
        same = [c for h, c in counts[n].items() if h[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        cut = lambda c: cuts[n][min(c, 3) - 1]
        seen = counts[n].get(g, 0)
        return ((max(seen - cut(seen), 0) if seen else 0) + sum(min(cut(c), c) for c in same) * p(g[1:])) / sum(same)

    bits = [-np.log2(p(g)) for g in grams(text)]
    return 2 ** np.mean(bits)


def test_perplexity_is_that_of_the_definition(spark, monkeypatch):
    monkeypatch.setattr(quality, "SHARD", 150)
    monkeypatch.setattr(quality, "GROUP_BYTES", 64)
    texts = ["the cat sat on the mat", "the dog sat on a log", "a cat and a dog", "zqx éé 日本", "the the the"]
    docs = docs_of(spark, [*texts, *ODD[:3]])
    got = {r.doc_id: r for r in quality.perplexities(docs, docs.filter("doc_id < 3").select("doc_id")).collect()}
    assert set(got) == set(range(len(texts)))
    for i, text in enumerate(texts):
        assert got[i].perplexity == pytest.approx(brute_perplexity(texts[:3], text)) and got[i].trusted == (i < 3)


def test_quality_keeps_what_reads_like_trusted_text(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    rows = QUERIES["op3_quality"](spark, folder).toPandas().merge(labels, on="doc_id")
    assert rows.kept[rows.quality == 1].mean() > 0.95 and rows.kept[rows.quality == 0].mean() < 0.5
    docs = spark.createDataFrame([(1, "a b", None), (2, None, "x"), (None, "c", "x"), (3, "", "x")], "doc_id bigint, text string, lang string")
    none = docs.select("doc_id").limit(0)
    assert {r.doc_id: r.kept for r in quality.classify(docs, none).collect()} == {1: True, 2: False, 3: False}
    assert quality.classify(docs.limit(0), none).count() == 0


def test_quality_limit_is_the_quantile_of_held_out_trusted_text(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = QUERIES["op3_quality"](spark, folder).join(labels.filter("quality = 1").select("doc_id", held_out().alias("out")).distinct(), "doc_id").toPandas()
    for _, mine in rows[rows.perplexity.notna()].groupby("lang"):
        out = mine[mine.out]
        assert not len(out) or mine.highest.iloc[0] <= out.perplexity.max() * (1 + 1e-9)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = [(10**6, None, "en", "s", 0), (10**6 + 1, "123", "en", "s", 3), (None, "no id here at all", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).cache()
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], FOLDER).cache())
        assert kept[-1].columns == docs.columns
    assert not kept[1].filter("doc_id >= 1000000").count()
    groups = simhash.near_duplicates(kept[1])  # the row without an id is a group of its own
    assert kept[2].count() == groups.select("component_id").distinct().count()
    assert kept[3].count() == kept[2].count() and kept[4].count() < kept[3].count()
    last = corpus_pipeline.STAGES[-1][1](spark, kept[-1], FOLDER).collect()
    assert len(last) == kept[-1].count() and all(r.round_trip and len(r.ids) == r.n_tokens for r in last)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


def test_dealt_queries_are_registered():
    from __spark_entry__ import queries

    names = list(queries())
    assert "pipeline" in names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)) == list(range(1, 11))


def test_fingerprint_column_matches_the_function(spark):
    texts = ["a b c d", None, "", "One two"]
    rows = docs_of(spark, texts).select("doc_id", simhash.fingerprint(F.col("text")).alias("f")).orderBy("doc_id").collect()
    assert [r.f for r in rows] == [simhash.simhash(t) for t in texts]


def test_common_words_are_those_of_the_table():
    drawn = np.random.default_rng(5)
    for _ in range(200):
        a, b = (drawn.integers(0, 6, drawn.integers(0, 90)).tolist() for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, word in enumerate(a, 1):
            for j, other in enumerate(b, 1):
                table[i, j] = table[i - 1, j - 1] + 1 if word == other else max(table[i - 1, j], table[i, j - 1])
        assert substring_dedup.common(a, b) == table[-1, -1]


def test_white_space_of_any_kind_and_place_parts_words(spark):
    run = [f"w{i}" for i in range(60)]
    texts = [" ".join(run), "\t\n " + "\r\n".join(run) + " \x0b\x0c", "", " \n ", None]
    found = substring_dedup.repeated_passages(docs_of(spark, texts)).collect()
    assert [(r.doc_id - r.ref_id, r.begin, r.end, r.ref_begin, r.ref_end) for r in found] == [(1, 0, 60, 0, 60)]
