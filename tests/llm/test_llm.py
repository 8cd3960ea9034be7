"""The training-data operators against brute force, exact round trips and held-out accuracy on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logvigil.llm import common, decontaminate, exact_dedup, licences, line_dedup, near_copies, packing, simhash, substring, token_counts, token_files, toxicity
from logvigil.llm.vocab import ByteEncoder, Encoder, WordEncoder, encoder_for

FOLDER = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "a", "\n\n", "The same. the SAME.", "the same. THE SAME.", "É é", "x" * 5000, "  two  spaces\tand\r\nlines \n",
       "日本語 😀 text", "<|endoftext|> inside", "non breaking", "• bullets • here", "word " * 3000, "it's 12,5 kg"]


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest table with odd texts, a row without id, and a clashing column."""
    base = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    return base.union(extra).withColumn("digest", F.lit("mine")).withColumn("fp", F.lit(1))


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_library(path, rows):
    model, mine = Tokenizer.from_file(path), Encoder(path, keep=500)
    texts = [t for _, t in rows]
    for text, ids in zip(texts, mine.encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == model.encode(text, add_special_tokens=False).ids, text[:60]


def test_new_chunks_are_encoded_in_short_texts():
    model, mine, rnd, long = Tokenizer.from_file(WORDS), Encoder(WORDS), random.Random(17), []
    plain, mine._plain = mine._plain, lambda text: long.append(len(text)) or plain(text)
    for n in (1, 499, 500, 501, 3000):  # texts of 500 chunks, and one more
        text = " ".join("".join(rnd.choice("abcÉß.,'1") for _ in range(rnd.randrange(3, 12))) for _ in range(n)) + " a\u2020b e\u0301 <|endoftext|>"
        assert np.frombuffer(mine.encode([text])[0], "<u2").tolist() == model.encode(text, add_special_tokens=False).ids
    assert max(long) < 200


def test_byte_encoder_equals_library(rows):
    model, mine = Tokenizer.from_file(BYTES), encoder_for(BYTES)
    assert isinstance(mine, ByteEncoder) and isinstance(encoder_for(WORDS), Encoder)
    rnd = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\r", "a", "B", "é", "1", "\u0663", "'s", "'", "!", "\u2003", "\xa0", "\u200b", "日", "😀", "e\u0301", "_", "\x1c", "\x85",
             "<|endoftext|>", "\u00b2", "\u01c5", "\ufeff"]
    texts = [t for _, t in rows] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(5000)]
    for text, ids in zip(texts, mine.encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == model.encode(text, add_special_tokens=False).ids, text[:60]


def test_word_encoder_equals_library(rows):
    model, mine, rnd = Tokenizer.from_file(WORDS), encoder_for(WORDS), random.Random(5)
    assert isinstance(mine, WordEncoder) and not WordEncoder.fits(BYTES)
    tokens = [t.removesuffix("</w>") for t in model.get_vocab() if t.isascii()]
    words = [rnd.choice(tokens) + rnd.choice(tokens) * rnd.randrange(2) + rnd.choice(tokens) * rnd.randrange(2) for _ in range(60_000)]
    marks = [" ", "  ", "\n", "\t", "\r", "a", "B", "Éß", "ÿ", "1", "23", "'s", "'", "'LL", "'ve", "''", "!", ".,", "“", "’s", "—", "_", "<|", "<|endoftext|>", "<|ENDOFTEXT|>"]
    parts = [*marks, "\u0663", "\u2003", "\xa0", "×", "µ", "ª", "Σ", "İ", "日", "😀", "e\u0301", "\x1c", "\x85", "\x00", "\x7f", "\u00b2"]
    texts = [t for _, t in rows] + tokens + [" ".join(words[i : i + 20]) for i in range(0, len(words), 20)]
    texts += ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 12))) for some in (marks[:-3], parts) for _ in range(10_000)]
    for text, ids in zip(texts, mine.encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == model.encode(text, add_special_tokens=False).ids, text[:60]
    fresh = encoder_for(WORDS)
    fresh.encode(["It's plain prose, É and ñ; 12 (of it)."])
    assert not fresh.memo  # no look-up of chunks


def test_packing_keeps_neighbours_together(spark):
    """The best BM25 neighbour of a document in the whole corpus: how often is it in the same one of many shards?"""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokens = packing.tokenized(docs, BYTES, 0).cache()
    held = tokens.filter("ids IS NOT NULL")
    df = packing.frequencies(tokens)
    n, total = held.count(), held.agg(F.sum("n_tokens")).first()[0]
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).clip(1e-6).astype(np.float32)
    order = held.orderBy("near", "next", "doc_id").select("doc_id", "ids").collect()
    index = packing.Index([np.frombuffer(r.ids, "<u2") for r in order], idf, total / n)
    best = []
    for i in range(0, n, 5):
        scores = index.scores(i, 24)
        scores[i] = -1
        best.append((i, int(np.argmax(scores))))
    shares = []
    for shards in (4, 16, 64):
        size = n / shards
        shares.append(sum(int(a // size) == int(b // size) for a, b in best) / len(best))
    print("share of best neighbours in the same of 4, 16, 64 shards:", shares, "by chance:", [1 / 4, 1 / 16, 1 / 64])
    assert all(share > least for share, least in zip(shares, (0.4, 0.25, 0.18)))


def test_packing_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c")] * 3 + [(1, "same text " * 50)] * 40 + [(2, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("near", F.lit("mine")).withColumn("ids", F.lit(1))
    pieces = packing.packed(docs, BYTES, shard_tokens=1000).collect()
    assert sum(p.start == 0 for p in pieces) == len(rows)
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert collections.Counter(p.doc_id for p in pieces if p.start == 0) == collections.Counter(d for d, _ in rows)
    assert packing.packed(empty(spark), BYTES).count() == 0


def test_packing_covers_every_id_once(spark, docs, rows):
    model = Tokenizer.from_file(BYTES)
    ids = {d: [*model.encode(t, add_special_tokens=False).ids, 0] for d, t in rows}
    pieces = packing.packed(docs, BYTES, shard_tokens=40_000).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        assert p.doc_tokens == len(ids[p.doc_id])
    assert set(by_doc) == set(ids)
    for d, mine in by_doc.items():
        at = 0
        for p in sorted(mine, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(ids[d])
    short = 0
    for mine in by_sequence.values():
        at = 0
        for p in sorted(mine, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        short += at < 1024
    shards = {s >> 32 for s in by_sequence}
    assert short <= len(shards) and len(shards) > 3
    assert packing.packed(empty(spark), BYTES).count() == 0


def test_packing_prefers_lexical_neighbours():
    rng = np.random.default_rng(1)
    topics = [np.arange(100, 160), np.arange(500, 560)]
    ids = [rng.choice(topics[i % 2], 200).astype("<u2") for i in range(10)]
    idf = np.ones(1 << 16, np.float32)
    used = packing.pack(ids, idf, 200.0, 1000, 24)
    first = [d for d, _, _, s, _ in used if s == 0]
    assert len(first) == 5 and len({d % 2 for d in first}) == 1


def plain_fingerprint(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_groups_equal_brute_force(spark, docs, rows):
    prints = {d: plain_fingerprint(t, 3) for d, t in rows}
    want = plain_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {d: (prints[d], want[d]) for d in prints}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == set(want.values())
    assert simhash.near_groups(empty(spark)).count() == 0


def test_golay_keys_meet_at_three_bits():
    rng = random.Random(3)
    bits = [1 << i for i in range(64)]
    for _ in range(3):
        base = rng.getrandbits(64)
        others = [base] + [base ^ b for b in bits] + [base ^ sum(rng.sample(bits, n)) for n in (2, 3) for _ in range(4000)]
        found, keys = simhash.keys_of(np.array(others, np.uint64))
        mine = set(keys[found == 0].tolist())
        assert {int(r) for r, key in zip(found, keys.tolist()) if key in mine} == set(range(len(others)))


def test_simhash_splits_large_buckets(spark):
    rng = random.Random(4)
    values = {0}
    while len(values) < 300:
        values.add(rng.choice(sorted(values)) ^ 1 << rng.randrange(63))
    far = [(1 << 63) - 1 ^ (rng.getrandbits(20) << 30) for _ in range(40)]
    frame = spark.createDataFrame([(v,) for v in {*values, *far}], "fp long")
    edges = simhash.links(frame, block=16)
    got = {r.node: r.root for r in common.components(edges).collect()}
    want = plain_components({*values, *far}, lambda a, b: (a ^ b).bit_count() <= 3)
    assert all(got.get(n, n) == r for n, r in want.items())


def plain_similarity(a, b, k=5):
    sets = []
    for text in (a, b):
        words = text.encode().lower().split()
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("block", [4096, 8])
def test_near_copies_equal_brute_force(spark, block):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for family in range(12):
        base = [word() for _ in range(rng.choice([60, 300, 1500]))]
        for edits in (0, 0.004, 0.006, 0.01, 0.1, 0.2):
            rows.append((len(rows), " ".join(word() if rng.random() < edits else w for w in base)))
    rows += [(1000 + i, t) for i, t in enumerate(["", None, " ", "a b", "A  B", "a c"])]
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), rows[5]], "doc_id long, text string").withColumn("f0", F.lit(1)).withColumn("key", F.lit("x"))
    text = {i: t or "" for i, t in rows}
    want = plain_components(text, lambda a, b: plain_similarity(text[a], text[b]) >= 0.8)
    got = {r.doc_id: r.component_id for r in near_copies.similar_groups(docs, block=block).collect()}
    assert set(got) == set(text) and got[1000] == got[1001] == got[1002] and got[1003] == got[1004] != got[1005]
    assert all(want[i] == want[g] for i, g in got.items())  # nothing is joined that is not similar
    assert sum(got[i] == w for i, w in want.items()) >= 0.97 * len(want)
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.select("doc_id").collect()) == collections.Counter([*set(got.values()), None])
    assert near_copies.similar_groups(empty(spark)).count() == 0


def test_near_copies_of_the_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: near_copies.shingles(r.text or "", 5) for r in table.collect()}
    got = {r.doc_id: r.component_id for r in near_copies.similar_groups(table).collect()}
    places = collections.defaultdict(list)
    for i, found in rows.items():
        for code in found[found % 16 == 0].tolist():
            places[code].append(i)
    pairs = {(a, b) for where in places.values() for i, a in enumerate(where) for b in where[i + 1 :]}
    shared = {(a, b): len(np.intersect1d(rows[a], rows[b])) for a, b in pairs}
    similar = [p for p, n in shared.items() if n >= 0.8 * (len(rows[p[0]]) + len(rows[p[1]]) - n)]
    assert similar and sum(got[a] == got[b] for a, b in similar) >= 0.9 * len(similar)


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {frozenset(e) for e in edges}
    want = plain_components({n for e in edges for n in e if e[0] != e[1]}, lambda a, b: frozenset((a, b)) in linked)
    assert {n: r for n, r in got.items() if n in want} == want


def test_token_files_round_trip(spark, docs, rows, tmp_path):
    token_files.write_tokens(docs, WORDS, 1, str(tmp_path / "out"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(spark, str(tmp_path / "out")).collect()}
    model, at = Tokenizer.from_file(WORDS), 0
    for d, t in sorted(rows):
        ids = [*model.encode(t, add_special_tokens=False).ids, 1]
        assert got[d] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    token_files.write_tokens(empty(spark), WORDS, 1, str(tmp_path / "none"))
    assert token_files.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_line_dedup_small(spark):
    pages = spark.createDataFrame(
        [(i, "a.com", f"menu\nonly {i}\n\nmenu") for i in range(4)] + [(10 + i, "b.com", f"menu\nx{i}") for i in range(2)] + [(20, None, None)],
        "doc_id long, source string, text string").withColumn("line", F.lit(0))
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(pages, ratio=0.5).collect()}
    assert got[1] == ("only 1\n", 4, 2) and got[10] == ("menu\nx0", 2, 0) and got[20] == ("", 1, 0)
    assert line_dedup.drop_boilerplate(empty(spark)).count() == 0


def test_url_host(spark):
    frame = spark.createDataFrame([("https://u@M.Example.org:8/x?y",), ("nothing",), (None,)], "url string")
    assert [r.h for r in frame.select(line_dedup.url_host(F.col("url")).alias("h")).collect()] == ["m.example.org", None, None]


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs.withColumn("score", F.lit(1)), labels)
    marked = scored.join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in marked) / len(marked)
    assert right > 0.97
    toxic, clean = [r.score for r in marked if r.toxic], [r.score for r in marked if not r.toxic]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.97
    assert scored.count() == docs.count()


def test_toxicity_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scores = [r.score for r in toxicity.score_toxicity(docs, none).collect()]
    assert len(scores) == docs.count() and max(scores) < 1e-6
    assert toxicity.keep_clean(docs, none).columns == docs.columns
    assert toxicity.score_toxicity(empty(spark), none).count() == 0


def test_passages_found_and_clean_left_alone(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(70)]
    docs, spots = [], {}
    for i in range(30):
        body = [word() for _ in range(200)]
        if i % 3 == 0:
            mine = list(passage)
            mine[20] = word()  # one changed word in each
            spots[i] = rng.randrange(100)
            body[spots[i] : spots[i]] = mine
        docs.append((i, " ".join(body)))
    docs += [(100, None), (101, "short"), (None, docs[0][1])]
    got = substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").withColumn("seed", F.lit(1))).collect()
    assert {r.doc_id for r in got} == set(spots)
    assert all(abs(r.start - spots[r.doc_id]) <= 3 and 64 <= r.n_words <= 72 for r in got)
    assert substring.repeated_passages(empty(spark)).count() == 0


def test_chains_equal_quadratic_program():
    rng = random.Random(6)
    for _ in range(60):
        points = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(1, 25))})
        x, y = zip(*points)
        found = substring.chains(list(x), list(y), 6, 1000)
        assert sorted(i for c in found for i in c) == list(range(len(points)))
        assert all(x[a] < x[b] and y[a] < y[b] for c in found for a, b in zip(c, c[1:]))


def test_chains_with_gap_equal_quadratic_program():
    def plain(x, y, k, gap):
        score = []
        for i in range(len(x)):
            near = [score[j] + (x[j] + y[j] - x[i] - y[i]) // 8 for j in range(i) if 0 < x[i] - x[j] <= gap and 0 < y[i] - y[j] <= gap]
            score.append(k + max([0, *near]))
        return score

    rng = random.Random(8)
    for _ in range(200):
        points = sorted({(rng.randrange(400), rng.randrange(400)) for _ in range(rng.randrange(1, 80))})
        x, y = map(list, zip(*points))
        best = substring.chains(x, y, 6, 60)[0]
        value = 0
        for a, b in zip([None, *best], best):
            value = 6 + (0 if a is None else value + (x[a] + y[a] - x[b] - y[b]) // 8)
            assert a is None or (0 < x[b] - x[a] <= 60 and 0 < y[b] - y[a] <= 60)
        assert value == max(plain(x, y, 6, 60))
    for apart in (100, 300, 1000):  # a second passage has its own chain, however long the first one
        first, second = list(range(0, 200, 6)), list(range(200 + apart, 300 + apart, 6))
        x = [*first, *second]
        assert sorted(map(len, substring.chains(x, x, 6, 60))) == [len(second), len(first)]


def test_weak_ends_do_not_drop_a_passage(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    passage, line = some(60), some(10)
    docs = [(1, some(80) + passage + some(30) + line + some(50)), (2, some(90) + passage + some(30) + line + some(60)),
            # words before the passage stand again inside it
            (3, some(60) + passage[40:43] + some(5) + passage + some(60)), (4, some(70) + passage + some(60))]
    got = substring.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()
    first = {i: next(at for at in range(len(w)) if w[at : at + 60] == passage) for i, w in docs}
    for i in first:
        assert any(r.start <= first[i] and r.start + r.n_words >= first[i] + 60 and r.n_equal >= 0.8 * r.n_words for r in got if r.doc_id == i)


def test_stretches_equal_brute_force():
    rng = random.Random(10)
    for _ in range(100):
        runs, i, j = [], 0, 0
        for _ in range(rng.randrange(0, 12)):
            i, j, n = i + rng.randrange(0, 8), j + rng.randrange(0, 8), rng.randrange(1, 20)
            runs.append((i, j, n))
            i, j = i + n, j + n
        fit = [min(runs[e][0] + runs[e][2] - runs[s][0], runs[e][1] + runs[e][2] - runs[s][1]) for s in range(len(runs)) for e in range(s, len(runs))
               if sum(r[2] for r in runs[s : e + 1]) >= 0.8 * max(runs[e][0] + runs[e][2] - runs[s][0], runs[e][1] + runs[e][2] - runs[s][1])]
        got = substring.stretches(runs, 20, 0.8)
        assert max((min(a1 - a0, b1 - b0) for _, a0, a1, b0, b1 in got), default=0) == max([f for f in fit if f >= 20], default=0)
        assert all(e >= 0.8 * max(a1 - a0, b1 - b0) for e, a0, a1, b0, b1 in got) and all(p[2] <= q[1] for p, q in zip(got, got[1:]))


def test_passages_near_the_identity_are_found(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, spots = [], {}
    for pair in range(120):
        passage, copy = some(60), None
        edits = (rng.sample(range(1, 59), 6), rng.sample(range(1, 59), 9), rng.sample(range(1, 59), 11), range(4, 59, 6))[pair % 4]
        copy = [rng.choice(vocabulary) if i in edits else w for i, w in enumerate(passage)]
        for side, body in enumerate((passage, copy)):
            before = rng.randrange(20, 90)
            docs.append((2 * pair + side, " ".join(some(before) + body + some(70))))
            spots[2 * pair + side] = before
    got = substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {r.doc_id for r in got if r.other_id == r.doc_id ^ 1 and abs(r.start - spots[r.doc_id]) <= 8}
    for kind in range(4):  # 10, 15, 18 % of the words at random, then every sixth
        assert len([d for d in found if d // 2 % 4 == kind]) >= 57  # of 60
    assert all(r.n_equal >= 0.8 * r.n_words for r in got)


def test_equal_passages_meet_without_a_hub(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    docs, want = [], {}
    for i in range(0, 40, 4):  # first half, whole, second half or heavily edited, whole
        passage = some(60)
        edited = [word() if j % 3 == 0 else w for j, w in enumerate(passage)]
        for j, body in enumerate((passage[:30], passage[30:], passage, passage) if i % 8 else (edited[:30], edited[30:], passage, passage)):
            docs.append((i + j, " ".join(some(80) + body + some(70))))
            if j > 1:
                want[i + j] = i + 5 - j
    docs += [(1000 + i, " ".join(some(50) + list("xyzuvw") * 12 + some(20))) for i in range(40)]  # one frequent passage
    got = substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in got if r.doc_id < 1000} == set(want.items())
    assert all(abs(r.start - 80) <= 3 and 57 <= r.n_words <= 66 for r in got if r.doc_id < 1000)
    assert {r.doc_id for r in got if r.doc_id >= 1000} == set(range(1000, 1040))
    assert {r.class_id for r in got if r.doc_id >= 1000} == {1000}
    partners = collections.defaultdict(set)
    for r in got:
        partners[r.doc_id].add(r.other_id)
    assert all(r.n_links == len(partners[r.doc_id]) for r in got)


def test_passages_do_not_depend_on_partitions(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    hot = some(60)
    docs = [(i, " ".join(some(30) + hot * (30 if i == 3 else 2) + some(30))) for i in range(12)]  # one document repeats the seeds of all
    docs += [(100 + i, " ".join(some(40) + hot[:55] + some(40))) for i in range(5)] + [(3, docs[3][1])]
    table, before, found = spark.createDataFrame(docs, "doc_id long, text string"), spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for count in (1, 3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", count)
            found.append(sorted(map(tuple, substring.repeated_passages(table).distinct().collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and {r[0] for r in found[0]} == {i for i, _ in docs}


def test_copies_and_repeated_words_make_few_rows(spark):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    copy = " ".join(some(80))
    docs = [(i, copy) for i in range(7, 27)] + [(100 + i, " ".join(some(30 + i) + ["xx", "yy"] * 150 + some(30))) for i in range(12)]
    docs += [(200, "one two three"), (201, "one two three"), (202, None), (203, "")]  # copies too short for a passage
    got = substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    copies = [r for r in got if r.doc_id < 100]
    assert sorted((r.doc_id, r.other_id) for r in copies) == sorted(p for i in range(8, 27) for p in ((7, i), (i, 7)))
    assert all((r.start, r.n_words, r.other_start, r.n_equal, r.class_id) == (0, 80, 0, 80, 7) and r.n_links == (19 if r.doc_id == 7 else 1) for r in copies)
    repeated = [r for r in got if r.doc_id >= 100]
    assert {r.doc_id for r in repeated} == set(range(100, 112)) and {r.class_id for r in repeated} == {100}
    assert max(collections.Counter((r.doc_id, r.other_id) for r in repeated).values()) <= 6
    assert len(copies) + len(repeated) == len(got)


def test_edited_passages_meet_whatever_hubs_their_seeds_have(spark):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    docs, pairs = [], []
    for p in range(12):
        passage = some(60)
        for run in range(0, 60, 5):  # every run of equal words has its hub in another document
            docs.append((len(docs), " ".join(some(90) + passage[run : run + 4] + some(90))))
        pairs.append((10_000 + 2 * p, 10_001 + 2 * p))
        for doc in pairs[-1]:
            docs.append((doc, " ".join(some(80) + [word() if doc % 2 and j % 5 == 4 else w for j, w in enumerate(passage)] + some(70))))
    got = substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} <= {d for pair in pairs for d in pair}
    met = [p for p in pairs if {(r.doc_id, r.other_id, r.class_id) for r in got if r.doc_id in p} == {(p[0], p[1], p[0]), (p[1], p[0], p[0])}]
    assert len(met) >= 11
    assert all(abs(r.start - 80) <= 3 and r.n_words >= 50 and r.n_equal >= 0.8 * r.n_words for r in got)


def test_pairs_with_a_short_line_only_are_not_made():
    rng = random.Random(18)
    some = lambda n: rng.sample(range(1 << 16), n)
    line, rows = some(30), []
    for i in range(3000):  # one line of 30 words, or a run of one word, and nothing else in common
        rows.append(some(60) + (line if i % 2 else [7] * 30) + some(60))
    passages = [some(64) for _ in range(20)]
    for p in passages:  # and pairs that share 64 words, one of six replaced
        rows += [some(40) + p + some(40), some(50) + [rng.randrange(1 << 16) if j % 6 == 5 else w for j, w in enumerate(p)] + some(40)]
    around = [np.array(r, np.uint16).tobytes() for r in rows]
    key, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
    found = {(int(a), int(b)) for one, two in substring.alike(key, root, around, 3, 50, 0.8) for a, b in zip(one, two)}
    assert found == {(3000 + 2 * i, 3001 + 2 * i) for i in range(20)}
    assert not list(substring.alike(key, root * 0, around, 3, 50, 0.8)) and not list(substring.alike(root, root, around, 3, 50, 0.8))


def test_others_of_equal_brute_force():
    rng = np.random.default_rng(19)
    for many in (2, 5, 300):  # up to more roots of a seed than there are bits
        seed, root = np.sort(rng.integers(-4, 4, 600)), rng.integers(0, many, 600) * 7919
        bit = {int(r): 1 << (int(r) * 0x9E3779B97F4A7C15 % 2**64 >> 58) for r in root}
        want = [0] * len(seed)
        for i in range(len(seed)):
            for r in {int(r) for s, r in zip(seed, root) if s == seed[i] and r != root[i]}:
                want[i] |= bit[r]
        assert [int(x) % 2**64 for x in substring.others_of(seed, root)] == want


def test_seeds_met_in_different_classes_make_no_pairs(spark):
    rng = random.Random(20)
    # Each of 60 documents shares 40 seeds with one document each, as by chance; ten pairs of documents share four more, 20 words apart.
    points = [(d, 5 * j, 1000 + 40 * d + j, 0) for d in range(60) for j in range(40)]
    points += [(1000 + 40 * d + j, 3, 1000 + 40 * d + j, 0) for d in range(60) for j in range(40)]
    points += [(2 * p + side, 1000 + 20 * j + side, 5000 + p, j) for p in range(10) for j in range(4) for side in range(2)]
    rng.shuffle(points)
    table = spark.createDataFrame([(*row, 3, True) for row in points], "doc_id long, pos long, hub_id long, hub_pos long, n long, dense boolean")
    classes = spark.createDataFrame([(1, 0), (0, 0)], "node long, root long")  # the first pair is one class already
    made = substring.two_seeds(substring.contested(table, classes), 13, 73, 48).cache()
    kept = substring.in_several(made).collect()
    assert {r.doc_id for r in kept} == set(range(2, 20)) and len(kept) == 18 * 6
    assert made.count() < 1000  # all pairs of contested seeds: 60 x 446


def test_open_rows_meet_the_nearest_other_document():
    rng = random.Random(14)
    for _ in range(300):
        rows = sorted([rng.randrange(3), rng.randrange(3), i, 0, 0] for i in range(rng.randrange(1, 25)))
        cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randrange(6))))
        pieces = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        sides = {}
        for p, piece in enumerate(pieces):
            first, last = piece[0], piece[-1]
            other = [r for r in piece if r[:2] != first[:2]], [r for r in piece if r[:2] != last[:2]]
            sides[p] = {0: first, 3: last} | ({1: other[0][0]} if other[0] else {}) | ({2: other[1][-1]} if other[1] else {})
        for step in (-1, 1):
            want, at = {}, 0
            for p, piece in enumerate(pieces):
                mine = piece[0] if step < 0 else piece[-1]
                around = rows[: at][::-1] if step < 0 else rows[at + len(piece) :]
                found = next((r for r in around if r[:2] != mine[:2]), None)
                if found and found[0] == mine[0]:
                    want[p] = found
                at += len(piece)
            assert substring.neighbours(sides, step) == want


def plain_licences(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    spots = [(i, label) for label, phrase in licences.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.encode().split()]
    return len(words), len(spots), min(spots, default=(None,))[0], max(spots, default=(None,))[0], ",".join(sorted({x for _, x in spots}))


def test_licences_equal_brute_force(spark, docs, rows):
    more = ["All rights reserved. all RIGHTS reserved", "cc-by cc by cc by-sa", "the GNU General Public License v3", "Licensed under the Apache License, Version 2.0.",
            "general public general public license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(20_000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = {r.doc_id: r for r in licences.scan_licences(frame).collect()}
    for d, t in [*rows, *((20_000 + i, t) for i, t in enumerate(more))]:
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licences(t)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[20_003].labels == "apache-2.0" and got[20_005].labels == "mit"


def test_token_counts_equal_library(spark, docs, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, PIECES).collect()}
    want = {d: (len(t.encode()), n := len(model.encode(t)), n > 4096) for d, t in rows}
    assert got == want
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc thein  ▁éñ1\n,日😀") for _ in range(rng.randrange(1, 2500))) for _ in range(40)]
    assert token_counts.Transducer(token_counts.Vocabulary(PIECES), most=50).counts([t.encode() for t in texts]) == [len(model.encode(t)) for t in texts]


def test_exact_groups_equal_brute_force(spark, docs, rows):
    low = {d: re.sub("[A-Z]", lambda m: m[0].lower(), t) for d, t in rows}
    groups = collections.defaultdict(list)
    for d, t in low.items():
        groups[t].append(d)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {d: (max(groups[t]), len(groups[t]), d == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in low.items()}
    kept = exact_dedup.drop_copies(docs.union(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(max(g) for g in groups.values())
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


QUESTION = "If Ann Miller buys 12 kg of apples for 30 dollars and gives half of them to Bob Stone then how many does Ann Miller keep for the winter?"


def test_exact_groups_with_repeated_rows_and_null_ids(spark):
    rows = [(1, "Same"), (1, "Same"), (1, "same"), (0, "SAME"), (1, "other"), (None, "lost"), (None, "LOST"), (None, "same"), (7, None), (8, ""), (8, "")] + [(5, "x")] * 9000
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("mine")).withColumn("check", F.lit(1)).withColumn("named", F.lit(2))
    out = exact_dedup.exact_groups(docs).collect()
    assert len(out) == len(rows)
    by_text = collections.defaultdict(list)
    for doc_id, text in rows:
        by_text[hashlib.sha256((text or "").lower().encode()).hexdigest()].append(doc_id)
    kept = collections.Counter(r.text_sha256 for r in out if r.kept)
    for digest, ids in by_text.items():
        best = max((i for i in ids if i is not None), default=None)
        mine = [r for r in out if r.text_sha256 == digest]
        assert {(r.keep_id, r.group_size) for r in mine} == {(best, len(ids))} and sorted(map(str, (r.doc_id for r in mine))) == sorted(map(str, ids))
        assert kept[digest] == (best is not None)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "").lower()) for r in left.collect()) == [("1", "other"), ("1", "same"), ("5", "x"), ("8", ""), ("None", "lost")]
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0 and exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_decontamination_templates(spark):
    items = spark.createDataFrame([(1, QUESTION), (2, "Too short"), (3, None)], "item_id long, text string")
    other = QUESTION.replace("Ann", "Eve").replace("Miller", "Jones").replace("12", "7").replace("30", "9").replace("Bob Stone", "Carl Reed")
    mixed = other.replace("does Eve Jones keep", "does Zoe Green keep")
    docs = spark.createDataFrame(
        [(1, f"Some words before. {QUESTION} And after."), (2, f"As they say: {other}"), (3, mixed), (4, "nothing of the kind " * 30), (5, None), (6, ""), (None, QUESTION)],
        "doc_id long, text string").withColumn("code", F.lit(1))
    found = decontaminate.contaminated(docs, items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 1), (None, 1)}
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {3, 4, 5, 6}
    assert decontaminate.contaminated(empty(spark), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_slots_may_coincide(spark):
    shop = "A shop sells 3 apples and 5 pears in 2 boxes with 2 bags and asks how many pieces of fruit are left"
    story = ("If the farmer Ann Miller counts all the sheep on the long green hill before the sun goes down behind the old stone wall "
             "then the shepherd of the valley will bring every lamb home while the farmer Ann Miller waits at the gate with warm milk for all")
    items = spark.createDataFrame([(1, shop), (2, story), (3, QUESTION)], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, shop.replace("3", "4").replace("5", "4")), (2, shop.replace("2 boxes", "3 boxes").replace("2 bags", "4 bags")),
        (3, "Ann Miller".join(story.split("Ann Miller")[:2]) + "Zoe Green" + story.split("Ann Miller")[2]),
        (4, QUESTION.replace("Ann", "Eve").replace("Miller", "Jones").replace("Bob Stone", "Eve Jones").replace("12", "7")),  # two people became one
    ], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == {(1, 1), (2, 1), (3, 2)}


def test_decontamination_finds_planted_items(spark):
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    bench = [(r.item_id, re.findall(r"\w+", r.text.lower())) for r in items.collect()]
    want = set()
    for r in docs.collect():
        text = " ".join(re.findall(r"\w+", r.text.lower()))
        want |= {(r.doc_id, i) for i, w in bench if f" {' '.join(w)} " in f" {text} "}
    assert want <= {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = source
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.checkpointed(stage(spark, docs, FOLDER))
        assert docs.columns == source.columns
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    assert 0 < len(left) < source.count()
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {p.doc_id for p in packed} == left
