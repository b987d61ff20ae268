"""Archives, languages, fingerprints, scores, tokens and pages: exact round trips, brute force, held-out accuracy."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tablecheck.llm import bpe, components, html_wrapper, langid, ngram_lm, simhash, warc

DOCS = "doc_id bigint, text string"
ODD = [None, "", " ", "\n", "a", "É" * 3000, "x y " * 2000, "日本語 テキスト", "\x00\x1c\x85 　", "it's 12 o'clock!!  ok\n\n"]


# ---- archives


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}?a=%0A", p) for i, p in enumerate([None, b"", b"x", b"x", b"same" * 9, b"same" * 9, bytes(range(256)) * 9000])]
    rows += [(None, None, b"x"), (3, "line\r\nbreak", b"x"), (None, "u", b"nulls"), (None, "u", b"nulls")]
    df = spark.createDataFrame(rows, "record_id bigint, url string, payload binary").withColumn("head", F.lit("clash"))
    for least in (0, 2):
        marked = warc.mark_revisits(df, least)
        stored = warc.bundles(marked.coalesce(1), frame_bytes=64, bundle_bytes=4000).cache()
        got = warc.read(stored).collect()
        assert Counter((r.record_id, r.url) for r in got) == Counter((i, u) for i, u, _ in rows)
        largest = defaultdict(list)
        for i, _, p in rows:
            largest[p or b""].append(-1 if i is None else i)
        for r in got:
            same = next(p or b"" for i, u, p in rows if (i, u) == (r.record_id, r.url))
            head = max(largest[same])
            revisit = len(same) >= least and len(largest[same]) > 1 and (-1 if r.record_id is None else r.record_id) != head
            assert (r.record_type, r.refers_to) == (("revisit", head) if revisit else ("response", None))
            assert r.payload == (None if revisit else same) and r.payload_bytes == len(same)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(same).digest()).decode()
        contents = {r.bundle: bytes(r.content) for r in stored.collect()}
        for r in warc.index(stored).collect():
            assert warc.read_record(contents[r.bundle], r.frame, r.offset)["record_id"] == r.record_id
    warc.export(stored, str(tmp_path / "out"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == contents
    assert warc.read(warc.bundles(warc.mark_revisits(df.limit(0)))).count() == 0


# ---- tokens


def reference_encoding():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_equal_the_library(spark):
    rnd = random.Random(3)
    alphabet = list(" \n\t\r\x1c\x85\xa0 abcdé日's'reST12½!?#́") + ["  ", "<|endoftext|>", "the ", "tion"]
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(400)] + ["-" * 3000, "ab" * 1500]
    known = reference_encoding()
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("n_tokens", F.lit("clash"))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.decode(bpe.encode(df, path, public_tokenizers.PATTERN), path)
    for r in coded.collect():
        want = known.encode_ordinary(r.text or "")
        assert r.token_ids == want and bytes(r.decoded) == (r.text or "").encode()
    got = {r.doc_id: r for r in bpe.digests(df, path, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = known.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.digests(df.limit(0), path, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(coded, path, public_tokenizers.PATTERN)


def test_tokens_and_digests_need_one_worker_a_core(spark, monkeypatch):
    """One Python step in the plan; batches are cut by their bytes, with nulls and a text longer than a part."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    df = spark.createDataFrame([(1, "one"), (2, None), (3, "long " * 50), (4, ""), (5, "two é"), (5, "two é")], DOCS)
    plan = bpe.digests(df, path, pattern)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    monkeypatch.setattr(bpe, "SLICE", 11)
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in df.collect()])
    parts = list(bpe.slices(batch, "text"))
    assert [p.num_rows for p in parts] == [2, 1, 2, 1] and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert list(bpe.slices(batch.slice(0, 0), "text")) == []
    one = bpe.round_trip(df, path, pattern).collect()
    two = bpe.decode(bpe.encode(df, path, pattern).drop("text"), path).collect()
    assert one == two and [bytes(r.decoded).decode() for r in one] == [r.text or "" for r in df.collect()]
    with pytest.raises(ValueError):
        bpe.round_trip(df.withColumn("decoded", F.lit(1)), path, pattern)


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"k{i}".encode() for i in range(3000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.find(k) for k in keys) == list(range(3000))
    assert all(table.find(f"x{i}".encode()) == -1 for i in range(3000))
    assert bpe.PerfectHash([]).find(b"a") == -1


# ---- languages

PIECES = sorted({"▁", "▁a", "a", "b", "ab", "▁ab", "ba", "abab"})


def brute_sum(word, prob):
    total = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        total[end] = sum(total[at] * prob.get(word[at:end], prob["?"] if end - at == 1 else 0.0) for at in range(end))
    return total[-1]


def test_forward_sums_all_segmentations():
    rnd = np.random.default_rng(1)
    table = rnd.dirichlet(np.ones(len(PIECES) + 1), 2).T
    words = ["▁ab", "▁abab", "▁", "▁xyab", "▁babababab"]
    got = langid.Lattice(words, {p: i for i, p in enumerate(PIECES)}, 4).log_probability(table)
    for w, word in enumerate(words):
        for m in range(2):
            prob = {p: table[i, m] for i, p in enumerate(PIECES)} | {"?": table[-1, m]}
            assert math.isclose(got[w, m], math.log(brute_sum(word, prob)), rel_tol=1e-9)


def test_expected_uses_cover_every_letter():
    table = np.full((len(PIECES) + 1, 1), 1 / (len(PIECES) + 1))
    words, counts = ["▁abab", "▁ba"], np.array([2.0, 3.0])
    uses = langid.Lattice(words, {p: i for i, p in enumerate(PIECES)}, 4).expected(table, counts)
    letters = sum(u * len(p) for u, p in zip(uses, [*PIECES, "?"], strict=True))
    assert math.isclose(letters, 2 * 5 + 3 * 3)


def language_texts(rnd, n):
    sounds = {"aa": ["tion", "the", "ing", "and"], "bb": ["eau", "ment", "que", "les"]}
    return [(i, " ".join("".join(rnd.choice(sounds[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(20)), lang) for i in range(n) for lang in [rnd.choice(["aa", "bb"])]]


def test_languages_held_out_and_edges(spark):
    rows = language_texts(random.Random(5), 200)
    rows += [(1000 + i, t, None if i % 2 else "aa") for i, t in enumerate([None, "", "123 !?", " \n"])] + [(None, "the thing", None)] + [rows[0]] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = langid.identify(df, public_tokenizers.path("piece_bpe_32k.model"), ~held_out).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    tested = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(tested) > 20 and all(r.lang_pred == truth[r.doc_id] for r in tested)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id is not None and r.doc_id >= 1000)
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_without_labels_or_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "the", None)], "doc_id bigint, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(df, path, F.lit(True)).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0), path, F.lit(True)).count() == 0


# ---- fingerprints


def plain_fingerprint(text, n):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes_of(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    groups = defaultdict(list)
    for i in range(n):
        groups[root(i)].append(i)
    return list(groups.values())


@pytest.mark.parametrize("crowd", [2048, 4])
def test_near_duplicates_equal_brute_force(spark, crowd):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, t) for i, t in enumerate(ODD)]
    for base in range(12):
        text = [rnd.choice(words) for _ in range(rnd.choice([3, 200, 900]))]
        for _ in range(rnd.randint(1, 9)):
            near = list(text)
            near[rnd.randrange(len(near))] = "NEW"
            rows.append((len(rows) + 10, " ".join(near)))
            rows.append((len(rows) + 10, " ".join(near)))
    rows.append((5000, rows[12][1]))
    rows.append((5000, rows[12][1]))
    df = spark.createDataFrame(rows, DOCS).withColumn("fingerprint", F.lit("clash")).withColumn("root", F.lit(1))
    got = simhash.near_duplicates(df, 3, crowd=crowd).collect()
    assert len(got) == len(rows)
    marks = [plain_fingerprint(t, 3) for _, t in rows]
    edges = [(a, b) for a in range(len(rows)) for b in range(a) if (marks[a] ^ marks[b]).bit_count() <= 3]
    least = {rows[i][0]: min(rows[k][0] for k in group) for group in classes_of(len(rows), edges) for i in group}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (format(m, "016x"), least[d]) for (d, _), m in zip(rows, marks, strict=True)}


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "same text here"), (None, "same text here"), (7, None), (9, " ")], DOCS)
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(df, 3).collect())
    assert got == [("7", 7), ("9", 7), ("None", None), ("None", None)]
    assert sorted(str(r.doc_id) for r in simhash.keep_first(df).collect()) == ["7", "None"]
    assert simhash.near_duplicates(df.limit(0), 3).count() == 0 and simhash.keep_first(df.limit(0)).count() == 0


def test_keep_first_equals_brute_force(spark):
    rnd = random.Random(6)
    rows = [(None, "x y z"), (None, "x y z"), (3, "x y z"), (None, "alone here"), (4, None), (5, " \n"), (5, " \n")]
    for b in range(25):
        text = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
        for c in range(4):
            near = list(text)
            for _ in range(c):
                near[rnd.randrange(300)] = f"z{rnd.randint(0, 99)}"
            rows.append((len(rows), " ".join(near)))
    df = spark.createDataFrame(rows, DOCS).withColumn("text_hash", F.lit(0)).withColumn("key_id", F.lit("clash"))
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    marks = [plain_fingerprint(t, 3) for _, t in rows]
    edges = [(a, b) for a in range(len(rows)) for b in range(a) if (marks[a] ^ marks[b]).bit_count() <= 3]
    first = [min((rows[i] for i in group), key=lambda r: (r[0] is None, r[0] or 0)) for group in classes_of(len(rows), edges)]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(first)
    assert 25 <= len(first) < len(rows)


@pytest.mark.parametrize("radius", [1, 3, 15])
def test_bit_sliced_distances(radius):
    rnd = np.random.default_rng(radius)
    values = rnd.integers(0, 2**63, 64, dtype=np.uint64)
    values[1::2] = values[::2] ^ (np.uint64(1) << np.arange(32, dtype=np.uint64)) ^ np.uint64((1 << radius) - 1)
    planes = simhash.transpose(values.reshape(1, 64))
    for q in values[:9]:
        word = int(simhash.near(planes, np.array([q]), radius)[0])
        assert word == sum(1 << i for i, v in enumerate(values) if int(v ^ q).bit_count() <= radius)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 90)] + [(-5, -9), (-9, -5), (3, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(90)) and got[-5] == got[-9] == -9


# ---- scores


def test_scores_against_plain_counts(spark):
    rnd = random.Random(12)
    rows = [(i, " ".join(rnd.choice(["The", "a", "b", "c", "rare%d" % rnd.randint(0, 50)]) for _ in range(rnd.randint(0, 40)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n"), (None, "the a"), (203, "once " * 3000), (5, rows[5][1])]
    df = spark.createDataFrame(rows, DOCS).withColumn("kind", F.lit("clash")).withColumn("score", F.lit(0))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    trains = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 != 2
    tokens = [[*re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower()), None] for _, t in rows]
    count = Counter(w for (d, _), ws in zip(rows, tokens, strict=True) if trains(d) for w in ws)
    total, distinct = sum(count.values()), len(count)
    want = Counter()
    for (d, _), ws in zip(rows, tokens, strict=True):
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws)
        want[d, len(ws), sum(count[w] > 0 for w in ws), total, round(base, 6)] += 1
    runs = []
    for chars in (1 << 30, 300):
        got = ngram_lm.score(df, fold != 2, fold == 5, batch_chars=chars).collect()
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
        runs.append(sorted((str(r.doc_id), round(r.score, 6)) for r in got))
    assert runs[0] == runs[1]  # batches change nothing


@pytest.mark.parametrize("chars,part", [(1 << 30, 1 << 30), (2000, 700)])
def test_mixed_score_equals_plain_counts(spark, chars, part):
    """Every previous word is a context: counts, buckets, weights and scores by plain Python, whatever the batches and blocks are."""
    rnd = random.Random(13)
    after = {w: [rnd.randrange(400) for _ in range(3)] for w in range(400)}
    rows = []
    for i in range(150):
        w, words = rnd.randrange(400), []
        for _ in range(rnd.randint(0, 60)):
            words.append(f"W{w}")
            w = rnd.choice(after[w]) if rnd.random() < 0.8 else rnd.randrange(400)
        rows.append((i, " ".join(words)))
    kind = lambda d: {2: 0, 5: 2}.get(zlib.crc32(str(d).encode()) % 7, 1)
    tokens = {d: ["<s>", *t.lower().split(), None] for d, t in rows}
    pair, word, fold_pair, fold_word = Counter(), Counter(), Counter(), Counter()
    for d, ws in tokens.items():
        if kind(d):
            for p, w in ((pair, word), (fold_pair, fold_word))[: kind(d)]:
                p.update(zip(ws, ws[1:], strict=False))
                w.update(ws[1:])
                w["<s>"] += 1
    size = sum(n for w, n in word.items() if w != "<s>")
    fold_size = sum(n for w, n in fold_word.items() if w != "<s>")
    uniform = 1 / len(word)  # without the start and with one more
    table = Counter()
    step = lambda f: round(ngram_lm.STEPS * math.log2(f)) if f else -9999
    for d, ws in tokens.items():
        if kind(d) == 2:
            for h, w in zip(ws, ws[1:], strict=False):
                c = word[h] - fold_word[h]
                f2, f1 = (pair[h, w] - fold_pair[h, w]) / max(c, 1), (word[w] - fold_word[w]) / (size - fold_size)
                table[int(ngram_lm.bucket(np.array([c]))[0]), step(f2), step(f1)] += 1
    weights = ngram_lm.learn_weights([(*k, n) for k, n in table.items()], uniform)
    assert len({k[0] for k in table}) >= 4 and weights[2, 0] < weights[6, 0]  # rare contexts are trusted less
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    got = {r.doc_id: r.score for r in ngram_lm.score(spark.createDataFrame(rows, DOCS).repartition(3), fold != 2, fold == 5, batch_chars=chars, part_bytes=part).collect()}
    for d, ws in tokens.items():
        want = 0.0
        for h, w in zip(ws, ws[1:], strict=False):
            m = weights[int(ngram_lm.bucket(np.array([word[h]]))[0])]
            want += math.log10(m[0] * pair[h, w] / max(word[h], 1) + m[1] * word[w] / size + m[2] * uniform)
        assert abs(got[d] - want) < 1e-6, d


def test_packed_numbers_come_back():
    values = np.array([0, 1, 255, 256, 2**40, 2**64 - 1], np.uint64)
    assert ngram_lm.unpacked(ngram_lm.packed(values)).tolist() == values.tolist() and len(ngram_lm.unpacked(ngram_lm.packed(np.zeros(0, np.uint64)))) == 0


def test_bigrams_help_where_there_are_any(spark):
    rows = [(i, "x y z " * 20 if i % 2 else "p q r " * 20) for i in range(80)]
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    got = ngram_lm.score(spark.createDataFrame(rows, DOCS), fold != 2, fold == 5).collect()
    held = [r for r in got if r.kind == 0]
    assert held and all(r.score > 0.5 * r.base_score for r in held)


def test_scores_without_training_or_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_lm.score(df, F.lit(False), F.lit(False)).collect()}
    assert got == {1: (3, 0, 0, 0.0, 0.0), 2: (1, 0, 0, 0.0, 0.0)}
    assert ngram_lm.score(df.limit(0), F.lit(True), F.lit(False)).count() == 0


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Head&nbsp;line &lt;%d&gt;</h1></header><p>First <b>bold</b>text %d.<br>next<p>Second   open
paragraph %d<div class="ad">Buy</div><ul><li>one %d<li>two %d</ul><form><p>Mail <input></p></form><!-- <p>hidden</p> -->
<table><tr><td>c1 %d<td>c2 %d</table><section id="comments"><p>Nice!</p></section></article>
<aside><p>Side</p></aside><footer>&copy; me</footer></body></html>"""
TEXT = "Head line <%d>\nFirst boldtext %d. next\nSecond open paragraph %d\none %d\ntwo %d\nc1 %d\nc2 %d"
PLAIN = "<html><body><div class='top'>Links here</div><div class='story'><p>Story %s goes on and on %s</p><div>Join us now</div><p>End %s</p></div><div class='end'>Imprint</div></body></html>"


def test_pages(spark):
    rows = [(i, f"http://a.example/{i}", PAGE % ((i,) * 7)) for i in range(6)]
    rows += [(10 + i, f"https://b.example:80/{i}", PLAIN % ((f"n{i}",) * 3)) for i in range(6)]
    rows += [(50, None, None), (51, "::", ""), (52, "http://c/", "just text &eacute; a < b"), (None, "http://a.example/x", "<p>un<p>closed <a title=\"x>"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("wrapper", F.lit("clash"))
    got = html_wrapper.main_text(df).collect()
    assert len(got) == len(rows)
    text = {(r.page_id, r.url): r.text for r in got}
    for i in range(6):
        assert text[i, f"http://a.example/{i}"] == TEXT % ((i,) * 7)
        # no article: the varying slot is found by aligning the host's pages, what is constant in it is template
        assert text[10 + i, f"https://b.example:80/{i}"] == f"Story n{i} goes on and on n{i}\nEnd n{i}"
    assert text[50, None] == "" and text[51, "::"] == "" and text[52, "http://c/"] == "just text é a < b"
    assert text[None, "http://a.example/x"] == "un\nclosed"
    assert html_wrapper.main_text(df.limit(0)).count() == 0


def test_constant_blocks_of_an_article_are_template(spark):
    """A paragraph, a list and a heading that stand on all pages of a host go, in an article too; what varies stays, whatever its tag."""
    page = "<html><body><div class='top'>Links</div><article><h1>Title %d</h1><p>Sign up for our letter today</p><p>Story %d</p><ul><li>Buy now</li></ul><div>Note %d</div></article></body></html>"
    rows = [(i, f"http://a.example/{i}", page % (i, i, i)) for i in range(7)] + [(9, "http://b.example/", page % (9, 9, 9))]
    got = {r.page_id: r.text for r in html_wrapper.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\nStory {i}\nNote {i}" for i in range(7))
    assert got[9] == "Title 9\nSign up for our letter today\nStory 9\nBuy now\nNote 9"  # one page says nothing about its host


def test_names_that_only_hold_a_chrome_word_stay():
    page = "<article><div class='share-price'>12 USD</div><p class='article-header'>Head</p><div class='social-science'>Study</div><div id='comment-policy-essay'>Essay</div>%s</article>"
    chrome = "<div class='site-footer'>f</div><div id='cookie-notice'>c</div><div class='x ad'>a</div><ul class='share-buttons'><li>s</li></ul><div class='comments'>n</div>"
    assert html_wrapper.extract(page % chrome) == "12 USD\nHead\nStudy\nEssay"


def plain_match(a, b):
    if a.label != b.label:
        return 0
    left, right = a.elements(), b.elements()
    best = lambda i, j: 0 if i == len(left) or j == len(right) else max(best(i + 1, j), best(i, j + 1), plain_match(left[i], right[j]) + best(i + 1, j + 1))
    return 1 + best(0, 0)


def test_alignment_equals_brute_force():
    rnd = random.Random(8)
    grow = lambda depth: "".join(f"<{t}>{grow(depth - 1) if depth else 'x'}</{t}>" for t in rnd.choices(["div", "span", "ul"], k=rnd.randint(0, 3)))
    for _ in range(150):
        a, b = html_wrapper.parse(grow(3)), html_wrapper.parse(grow(3))
        pairs = {}
        assert html_wrapper.match(a, b, pairs) == plain_match(a, b) == len(pairs)


def test_wrappers_of_deep_and_wide_pages():
    deep = lambda i: "<div>" * 3000 + f"<p>in {i}</p>" + "</div>" * 3000
    wrapper = html_wrapper.induce([deep(i) for i in range(4)])
    assert html_wrapper.extract(deep(7), json.loads(json.dumps(wrapper))) == "in 7"
    wide = lambda i: "<body>" + "".join(f"<p>{i} {k}</p>" for k in range(20000)) + "<p>always</p></body>"
    wrapper = html_wrapper.induce([wide(i) for i in range(4)])
    assert html_wrapper.extract(wide(9), wrapper) == "\n".join(f"9 {k}" for k in range(20000))


def test_tree_matching_counts_the_largest_alignment():
    tree = html_wrapper.parse
    a, b = tree("<div><p>1</p><ul><li>x</li></ul><p>2</p></div>"), tree("<div><p>1</p><p>2</p></div>")
    pairs = {}
    assert html_wrapper.match(a, b, pairs) == 4 and len(pairs) == 4
    assert html_wrapper.match(a, tree("<span>1</span>")) == 1


def test_deep_and_long_pages_do_not_break():
    assert html_wrapper.extract("<div>" * 3000 + "in" + "</div>" * 3000) == "in"
    assert html_wrapper.extract("<article>" + "<p>a b</p>" * 20000) == "\n".join(["a b"] * 20000)


def test_wide_and_rich_pages_are_aligned_like_small_ones():
    """The best alignment at any size: an element that moved to the end costs only itself, however long the lists."""
    for n in (3, 60, 150, 1500):
        items = "".join(f"<p>{'<b></b>' * (k % 5)}</p>" for k in range(n))
        a, b = html_wrapper.parse(f"<ul><div></div>{items}</ul>"), html_wrapper.parse(f"<ul>{items}<div></div></ul>")
        pairs = {}
        assert html_wrapper.match(a, b, pairs) == 2 + n + sum(k % 5 for k in range(n)) == len(pairs)
    # more pairs of nodes than the former limit: the moved element comes last
    many = "".join(f"<p>{'<b></b>' * (k % 40)}</p>" for k in range(90)) * 12
    tail = "<em></em><em></em>"
    a, b = html_wrapper.parse(f"<ul>{many}<div><i></i>{tail}</div></ul>"), html_wrapper.parse(f"<ul>{many}<div>{tail}<i></i></div></ul>")
    assert html_wrapper.match(a, b) == len(html_wrapper.in_post_order(a)) - 1


def test_long_lists_have_the_pairs_of_short_ones(monkeypatch):
    rnd = random.Random(6)
    for _ in range(200):
        left, right = ([rnd.randrange(4) for _ in range(rnd.randint(1, 14))] for _ in range(2))
        size = lambda x, y: (x == y) * (x + 1) + (x + y == 3)
        monkeypatch.setattr(html_wrapper, "SMALL", 4096)
        want = html_wrapper._best(left, right, size)
        monkeypatch.setattr(html_wrapper, "SMALL", -1)
        assert html_wrapper._best(left, right, size) == want
