"""MinHash links, alignment of tokenizers and resampling against plain Python over all rows."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_models import classes_of
from tokenizers import Tokenizer

from tablecheck.llm import align, minhash, resample

DOCS = "doc_id bigint, text string"
ODD = [None, "", " ", "\n", "a", "É" * 3000, "x y " * 2000, "日本語 テキスト", "\x00\x1c\x85 　", "it's 12 o'clock!!  ok\n\n", "one▁two", "<s> </s> <unk> <0x41> <|endoftext|>", "‍👩‍🚀 ﬁne"]


def say(rnd, n, letters="abcdefghij"):
    return ["".join(rnd.choice(letters) for _ in range(5)) for _ in range(n)]


# ---- minhash


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_sets(rows, size):
    held = []
    for _, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", lowered(text)) if w]
        held.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    return held


def plain_classes(rows, size, percent=80):
    """(n_shingles, component_id) of every row by comparing all pairs."""
    held = plain_sets(rows, size)
    ids = {s: k for k, s in enumerate(sorted(set().union(*held)))}
    table = np.zeros((len(rows), len(ids)), np.float32)
    for i, s in enumerate(held):
        table[i, [ids[x] for x in s]] = 1
    common, n = (table @ table.T).astype(np.int64), np.array([len(s) for s in held])
    linked = (100 * common >= percent * (n[:, None] + n[None, :] - common)) & (n[:, None] > 0) & (n[None, :] > 0)
    out = [None] * len(rows)
    for group in classes_of(len(rows), np.argwhere(np.triu(linked, 1))):
        least = min((rows[i][0] for i in group if rows[i][0] is not None), default=None)
        for i in group:
            out[i] = (int(n[i]), least if n[i] else rows[i][0])
    return out


def check_minhash(spark, rows, size=4, **more):
    df = spark.createDataFrame(rows, DOCS).withColumn("node", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("text_hash", F.lit(0))
    got = minhash.near_duplicates(df, size, **more).collect()
    want = Counter((d, *w, d is not None and d == w[1]) for (d, _), w in zip(rows, plain_classes(rows, size), strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    return got


def test_minhash_edges_and_edits_equal_brute_force(spark):
    rnd, rows = random.Random(1), [(i, t) for i, t in enumerate(ODD)]
    rows += [(None, "null id of a text"), (None, "null id of a text"), (900, "NULL id of a text"), (None, "alone and null"), (901, None), (901, "")]
    for n in (1, 3, 4, 5, 9, 12, 20, 26, 40, 90, 300):
        for _ in range(6):
            words = say(rnd, n)
            for changes in (0, 0, 1, 1, 2, 4):
                near = list(words)
                for _ in range(changes):
                    near[rnd.randrange(n)] = "changed"
                rows.append((1000 + len(rows), " ".join(near)))
            rows.append((1000 + len(rows), " ".join([*words, "Added"])))
    rows += [rows[-1], (3, "long " * 30000), (4, " ".join(say(rnd, 20000)))]
    got = check_minhash(spark, rows)
    assert sum(r.kept for r in got) < 0.8 * len(rows)


@pytest.mark.parametrize("rounds,pairs", [(3, 4), (1, 0)])
def test_minhash_crowds_equal_brute_force(spark, monkeypatch, rounds, pairs):
    """Texts that share most of a passage, near copies of one text at the threshold, a chain: also where nearly all is left to the exact way."""
    monkeypatch.setattr(minhash, "PAIRS", pairs)
    rnd, rows = random.Random(2), []
    passage = say(rnd, 30)
    while len(rows) < 700:
        own = say(rnd, rnd.choice([6, 8, 9, 40]))
        rows.append((len(rows), " ".join([*passage, *own])))
        if rnd.random() < 0.3:
            rows.append((len(rows), " ".join([*passage, *own[:-1], "last"])))
    base = say(rnd, 120)
    for _ in range(200):  # similarity of two copies about 0.75-0.85
        near = list(base)
        for _ in range(2):
            near[rnd.randrange(120)] = say(rnd, 1)[0]
        rows.append((len(rows), " ".join(near)))
    chain = say(rnd, 500)
    for k in range(0, 300, 10):
        rows.append((len(rows), " ".join(chain[k : k + 120])))
    check_minhash(spark, rows, rounds=rounds)


def test_minhash_prefixes_hold_all_links_in_few_pairs(spark):
    """A crowd that shares a passage: its pairs are below the threshold by the place of what they share first, links are all there."""
    rnd = random.Random(9)
    passage = list(range(85))
    sets = [[*passage, *(1000 + rnd.randrange(10**9) for _ in range(15))] for _ in range(300)]
    for of in rnd.sample(sets, 40):  # near copies, larger and smaller ones
        sets.append([x for x in of if rnd.random() > rnd.choice([0.01, 0.05, 0.12])] + [rnd.randrange(10**9) for _ in range(rnd.randrange(6))])
    sets += [passage, passage[:70], passage[5:] + [10**10 + k for k in range(10)]]
    rows = [(k, sorted(set(x))) for k, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "node bigint, shingles array<bigint>")
    nodes = df.select("node", F.size("shingles").cast("long").alias("n"))
    members = minhash.prefixes(df, nodes.select("node"), 80).join(nodes, "node").withColumn("label", F.col("node"))
    got = {(r.a, r.b) for r in minhash.cross_pairs(members, 80).collect()}
    both = [(i, j, set(x), set(y)) for i, x in rows for j, y in rows if i < j]
    links = {(i, j) for i, j, x, y in both if 100 * len(x & y) >= 80 * len(x | y)}
    assert len(links) > 20 and links <= got
    assert len(got) < 4 * len(rows)


def test_minhash_rounds_grow_with_nodes_not_with_their_keys(spark):
    """60 nodes under 64 keys, each with a representative of its own, and two nodes under one key: all nodes ask, under eight keys at most."""
    crowd = [(k, n, 0, 100, 64, n) for k in range(64) for n in range(60)] + [(k, 1000 + k, 0, 100, 65, 1000 + k) for k in range(64)]
    rows = [*crowd, (64, 2000, 0, 100, 1, 2000), (64, 2001, 0, 100, 1, 2001)]
    labelled = spark.createDataFrame(rows, "key long, node long, before long, n long, keys long, label long")
    met = [{(r.a, r.b) for r in minhash.star_pairs(labelled, 80, salt).collect()} for salt in (0, 1)]
    assert {a for a, _ in met[0]} == {*range(60), 2000} and len(met[0]) == 60 * minhash.ASKED + 1
    assert (2000, 2001) in met[1] and len(met[1]) <= (60 + 64) * minhash.ASKED + 1
    under = [{(r.key, r.node) for r in minhash.asking(labelled, salt).collect()} for salt in (0, 1)]
    assert under[0] != under[1]


def test_minhash_loses_fewer_than_it_says(spark):
    """Of 20,000 simulated pairs at the threshold, half keys of one collection all differ about as often as by the formula."""
    rnd = np.random.default_rng(3)
    lost = 0
    for _ in range(40):
        a = rnd.integers(0, 1 << 63, (500, 45)).astype(np.uint64)
        b = a.copy()
        b[:, :5] = rnd.integers(0, 1 << 63, (500, 5)).astype(np.uint64)  # 40 of 50
        made = [minhash.half_keys(x.reshape(-1), np.arange(0, 500 * 45, 45), 3, 2) for x in (a, b)]
        same = made[0] == made[1]
        lost += int((~(same[:, :3].any(1) & same[:, 3:].any(1))).sum())
    share = 1 - (1 - (1 - 0.8**2) ** 3) ** 2
    assert abs(lost / 20000 - share) < 5 * math.sqrt(share / 20000)


def test_minhash_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert minhash.near_duplicates(df).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], DOCS)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(only).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


# ---- alignment


def plain_alignment(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    vocabulary = {n: t for t, n in tokenizer.get_vocab().items()}
    to_byte = align.byte_level()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def piece(n):
        p = sp.id_to_piece(n)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    told = []
    for _, text in rows:
        groups = []
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        bytes_a, bytes_b = [bytes(to_byte[c] for c in vocabulary[n]) for n in a], [piece(n) for n in b]
        if text and b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            i = j = 0
            left, right, x, y = [], [], 0, 0
            while i < len(a) or j < len(b):
                if x <= y:
                    left.append(a[i])
                    x, i = x + len(bytes_a[i]), i + 1
                else:
                    right.append(b[j])
                    y, j = y + len(bytes_b[j]), j + 1
                if x == y and left and right:
                    groups.append((left, right))
                    left, right = [], []
        else:
            a, b = [], []
        told.append((a, b, groups))
    counts = Counter()
    for _, _, groups in told:
        counts.update({(x, y) for left, right in groups for x in left for y in right})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, _), (a, b, groups) in zip(rows, told, strict=True):
        links = [(x, y) for left, right in groups for x in left for y in right]
        written = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out


def run_alignment(spark, rows, **more):
    df = spark.createDataFrame(rows, DOCS).withColumn("copies", F.lit("clash")).withColumn("k1", F.lit(1)).repartition(3)
    made = align.measures(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"), **more)
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in made.collect()]


@pytest.mark.parametrize("chunk,links", [(6_000_000, 1 << 22), (300, 5)])
def test_alignment_equals_both_libraries(spark, monkeypatch, chunk, links):
    monkeypatch.setattr(align, "LINKS", links)  # tasks get the module by value
    rnd = random.Random(3)
    rows = [(i, t) for i, t in enumerate(ODD)]
    syllables = ["the", "ing", " and", "é", "ß", "日本", "語", "\n", "  ", "'s", " 12", "…", "ठीक", "\t", "x", "Zu", "<0x0A>", "🚀"]
    rows += [(100 + i, "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 120)))) for i in range(60)]
    rows += [(200, rows[30][1]), (200, rows[30][1]), (None, rows[31][1]), (None, None), (201, " " * 3000), (202, "ab" * 4000), (203, "́" * 50), (204, "many words of a text " * 800)]
    assert Counter(run_alignment(spark, rows, chunk=chunk)) == Counter(plain_alignment(rows))


def test_a_batch_of_texts_stays_small():
    """Two workers of an executor hold a batch each, and keep what it took."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        aligner = align.Aligner(align.load_a(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN), public_tokenizers.PATTERN, f.read())
    words = random.Random(5).choices(["".join(random.Random(i).choices("etaoinshrdlu", k=2 + i % 9)) for i in range(5000)], k=200 * align.CHUNK // 1300)
    texts, size = [], 200
    for at in range(0, len(words), size):
        texts.append(" ".join(words[at : at + size]))
        if sum(map(len, texts[-1:])) * len(texts) >= align.CHUNK:
            break
    aligner.align(texts[:2])
    tracemalloc.start()
    aligner.align(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 450e6  # 618 MB with batches of 6 million characters and 4 million links


def test_alignment_of_nothing(spark):
    assert run_alignment(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert align.measures(spark.createDataFrame([], DOCS), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_ranks_merge_like_the_library():
    """Every entry of the vocabulary, alone and after a letter."""
    ranks = align.load_a(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        aligner = align.Aligner(ranks, public_tokenizers.PATTERN, f.read())
    texts = [t.decode() for t in ranks if t.isascii()]
    texts += ["q" + t for t in texts[::7]]
    want = [e.ids for e in tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [aligner.a.encode_ordinary(" " + t) for t in texts] == want


# ---- resampling


def plain_words(text):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text)) if w]


def plain_resample(docs, target, order, buckets, percent, least):
    def features(text):
        words = plain_words(text)
        return [" ".join(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text)) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        held = features(text)
        weight = sum(gain[bucket(f)] for f in held) // len(held) if held else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("order,percent,words", [(1, 10, 1 << 17), (3, 50, 8), (2, 100, 40)])
def test_resampling_equals_plain_counts(spark, monkeypatch, order, percent, words):
    monkeypatch.setattr(resample, "SLICE", 100)
    monkeypatch.setattr(resample, "FIRST", 4)
    monkeypatch.setattr(resample, "CHUNK", 500)
    rnd = random.Random(4)
    odd = [None, "", " \n", "A", "Éa b-c_d E9", "x " * 5000, "日本 語。テ", "\x00\x7f~`{", "a" * 5000, "it's 12 o'clock"]
    vocabulary = [*say(rnd, 60, "abcé1"), "ﬁ", "ß", "Zoo", "9"]
    docs = [(i, t) for i, t in enumerate(odd)]
    docs += [(20 + i, rnd.choice([" ", "; ", "\n\n"]).join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60)))) for i in range(200)]
    docs += [(None, docs[40][1]), (40, docs[50][1]), (41, docs[51][1]), (41, docs[51][1])]
    target = [None, *(" ".join(rnd.choice(vocabulary[:20]) for _ in range(30)) for _ in range(5))]
    df = spark.createDataFrame(docs, DOCS).withColumn("weight", F.lit("clash")).withColumn("score", F.lit(1)).repartition(3)
    got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, buckets=500, order=order, words=words)
    want = plain_resample(docs, target, order, 500, percent, 20)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect()) == want


def test_composed_checksums_and_dictionary():
    rnd = random.Random(5)
    parts = [(rnd.randbytes(rnd.randint(0, 9)), rnd.randbytes(rnd.choice([0, 1, 2, 7, 300, 70000]))) for _ in range(60)]
    crc = lambda k: np.array([zlib.crc32(p[k]) for p in parts], np.uint32)
    made = resample.composed(crc(0), crc(1), np.array([len(b) for _, b in parts], np.int64))
    assert made.tolist() == [zlib.crc32(a + b) for a, b in parts]
    held = resample.Dictionary(most=30, first=2)
    for _ in range(40):  # known, unknown and overfull
        words = [rnd.choice(["a", "ab", "b", "é", *say(rnd, 2, "xy")]) for _ in range(rnd.randint(0, 30))]
        text = " " + rnd.choice([" ", "  ", "    "]).join(words) + " "
        start, crcs, size = held.scan(text)
        assert [text[s : text.index(" ", s)] for s in start] == words
        assert crcs.tolist() == [zlib.crc32(w.encode()) for w in words] and size.tolist() == [len(w.encode()) for w in words]
    assert len(held.known) <= 30 and len(held.payload)


def test_resampling_of_nothing(spark):
    none, texts = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c " * 10)], DOCS)
    assert resample.resample(none, texts).count() == 0
    rows = resample.resample(texts, none, percent=100).collect()
    assert [(r.n_features, r.rank) for r in rows] == [(30, 1)]
    column = pa.array([None, ""])
    assert [list(n) for _, n, _ in resample.features(resample.Dictionary(), column, 2, 10)] == [[0, 0]]
