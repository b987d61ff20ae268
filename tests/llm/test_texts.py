"""Chat windows, quality, line templates, decontamination: edge cases and brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablecheck.llm import chat, decontaminate, linetree, quality

TURNS = "conv_id bigint, turn bigint, role string, text string"
DOCS = "doc_id bigint, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turns_table():
    rnd = random.Random(4)
    odd = ["", None, "\\### Assistant: </turn> ok", "a\\b\\h\\t###", "</turn>\n### user: x</turn>\n", "#### </turn></turn>", "\\\\h", "x " * 3000, "é\n\n" * 40]
    rows = []
    for conv in range(30):
        roles = (["system"] if conv % 3 == 0 else []) + ["user", "assistant"] * rnd.randint(0, 6) + ["user"]
        rows += [(conv, t, r, rnd.choice(odd) if rnd.random() < 0.4 else "word " * rnd.randint(0, 120)) for t, r in enumerate(roles)]
    rows += [(None, None, None, None), (None, 1, "a: b\\", "t"), (90, 5, "user", "same"), (90, 5, "user", "same"), (90, 5, "assistant", "tie"), (91, 0, "system", "only")]
    return rows


@pytest.mark.parametrize("budget,history", [(1024, 128), (60, 20), (8, 0)])
def test_chat_reads_back_what_was_said(spark, budget, history):
    rows = turns_table()
    df = spark.createDataFrame(rows, TURNS).withColumn("pos", F.lit("clash")).withColumn("span", F.lit(1))
    made = chat.windows(df, budget, history).cache()
    got = {r.conv_id: r for r in chat.digests(chat.read_back(made)).collect()}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, (role or "") != "system", role or "", text or ""))
    assert set(got) == set(by_conv)
    for conv, turns in by_conv.items():
        turns.sort()
        learned = "".join(t[4] for t in turns if t[3] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{t[3]}\n{t[4]}\n" for t in turns))), conv
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned)), conv
    for r in made.collect():
        text_tokens = re.findall(chat.TURN_START, r.formatted)
        assert len(text_tokens) == r.n_turns
        new = r.n_turns - r.n_repeated
        assert budget == 8 or new == 1 or r.n_tokens <= budget


def test_chat_empty_table(spark):
    df = spark.createDataFrame([], TURNS)
    assert chat.digests(chat.read_back(chat.windows(df))).count() == 0


def plain_measures(text):
    words = [x for x in re.split(r"[\x20\x09-\x0d]+", text or "") if x]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    uses = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if uses[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_edges(spark):
    rnd = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b c", "a b c a b c", "x y z " * 400, "\n\n a \n a \n", "# | <>&%$*\nα β"]
    texts += [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 300))) for _ in range(30)]
    texts += [" ".join(f"w{rnd.randint(0, 900)}" for _ in range(4000)) * 2]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("words", F.lit(0)).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(9, 1, 0), (10, 1, None), (None, 1, 0), (9, 1, 0)], "doc_id bigint, quality int, toxic int")
    weights = quality.fit(df, labels, buckets=64)
    got = {r.doc_id: r for r in quality.judge(df, weights).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(text), i
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert got[0].score == 0.0


def test_quality_score_is_the_mean_log_ratio(spark):
    good, bad = [" ".join(f"alpha{i % 7} beta{i % 5}" for i in range(40))] * 3, ["qq!! zz!! " * 30] * 3
    df = spark.createDataFrame(list(enumerate(good + bad)), DOCS)
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(df, quality.fit(df, labels)).collect()}
    assert got[2].score > 0 > got[3].score and got[2].kept and not got[3].kept


def test_quality_equals_plain_counts(spark):
    """Score by plain counting, bucket by bucket, and the same verdicts from few and from all trusted labels."""
    rnd = random.Random(5)
    chain = {w: [rnd.choice(range(300)) for _ in range(4)] for w in range(300)}  # each word is followed by one of four

    def prose(n):
        w, out = rnd.randrange(300), []
        for _ in range(n):
            out.append(f"w{w}")
            w = rnd.choice(chain[w])
        return out

    texts, kind = [], []
    for i in range(240):
        words = prose(rnd.randint(60, 200))
        kind.append(i % 3 != 2)
        if not kind[-1]:
            rnd.shuffle(words)
        texts.append(" ".join(words))
    df = spark.createDataFrame([*enumerate(texts), (1000, None), (None, texts[0]), (1001, "")], DOCS)
    rows = [(i, int(kind[i]), 0) for i in range(240) if i % 2]
    labels = lambda r: spark.createDataFrame(r, "doc_id bigint, quality int, toxic int")
    weights = quality.fit(df, labels(rows), buckets=4096)

    def places(text):
        words = [x for x in (text or "").split(" ") if x]
        spoken = spark.createDataFrame([(words,)], "w array<string>").select(quality.grams("w", 4096).alias("g"))
        return spoken.first().g

    held = [places(t) for t in (texts[1], texts[2])]
    raw, target = Counter(), Counter()
    for r in df.select(quality.words(F.col("text")).alias("w"), "doc_id").select("doc_id", quality.grams("w", 4096).alias("g")).collect():
        raw.update(r.g)
        if r.doc_id is not None and r.doc_id < 240 and r.doc_id % 2 and kind[r.doc_id]:
            target.update(r.g)
    size, trusted = sum(raw.values()), sum(target.values())
    for b in set(held[0] + held[1]):
        plain = (target[b] + trusted * raw[b] / size) / (2 * trusted)  # smoothed by as many n-grams, dealt like the corpus
        assert abs(weights[b] - math.log(plain / (raw[b] / size))) < 1e-9
    cut = quality.threshold(df, labels([(i, int(kind[i]), 0) for i in range(0, 240, 2)]), weights)
    got = {r.doc_id: r for r in quality.judge(df, weights, cut).collect()}
    assert abs(got[1].score - sum(weights[b] for b in held[0]) / len(held[0])) < 1e-9 and got[1000].score == 0 == got[1001].score
    right = sum(got[i].kept == kind[i] for i in range(0, 240, 2))
    assert right >= 0.95 * 120  # shuffled words go, though every word of them is common
    few = quality.fit(df, labels([r for r in rows if r[1]][:20]), buckets=4096)
    again = {r.doc_id: r.kept for r in quality.judge(df, few, quality.threshold(df, labels([(i, int(kind[i]), 0) for i in range(0, 240, 2)]), few)).collect()}
    assert sum(again[i] == got[i].kept for i in range(240)) >= 0.9 * 240


def test_threshold_without_both_kinds_and_with_ties(spark):
    df = spark.createDataFrame([(i, "a b c " * 40) for i in range(4)], DOCS)
    labels = lambda r: spark.createDataFrame(r, "doc_id bigint, quality int, toxic int")
    assert quality.threshold(df, labels([(1, 1, 0), (2, None, 0)]), [0.5] * 8) == quality.THRESHOLD
    cut = quality.threshold(df, labels([(1, 1, 0), (2, 0, 0), (3, 0, 1)]), [0.5] * 8)
    assert cut <= 0.5  # equal scores cannot be parted, so nothing good is lost


def test_quality_without_labels_or_documents(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    empty = spark.createDataFrame([], DOCS)
    assert quality.fit(empty, labels, buckets=8) == [0.0] * 8
    assert quality.judge(empty, [0.0] * 8).count() == 0


def paragraphs(rnd, n):
    return [" ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(14)) for _ in range(n)]


def test_lines_of_recurring_templates_go_and_copies_stay(spark):
    rnd = random.Random(2)
    passage = " ".join("".join(rnd.choice("rstuv") for _ in range(6)) for _ in range(55))
    rows = [(i, "\n".join([*paragraphs(rnd, 4), passage if i % 2 else passage.upper(), f"Posted on 2024-01-{i:02d} by user {i} in section news today only"])) for i in range(8)]
    copy = "\n".join(paragraphs(rnd, 5))
    rows += [(100 + i, copy) for i in range(6)]
    rows += [(200, None), (201, ""), (None, "one line of five tokens"), (202, "\n\n"), (203, "x"), (203, "x")]
    df = spark.createDataFrame(rows, DOCS).withColumn("dropped", F.lit(1)).withColumn("lines", F.lit("clash"))
    got = linetree.drop_recurring(df)
    assert got.count() == len(rows) and got.select("row.*").columns == df.columns
    out = {(r.row.doc_id, r.row.text): r for r in got.collect()}
    for i, text in rows:
        r = out[i, text]
        if i is not None and i < 8:
            assert r.n_dropped == 2 and r.kept == "\n".join(text.split("\n")[:4])
        else:
            assert r.n_dropped == 0 and r.kept == text


def test_template_needs_count_lead_and_one_half(spark):
    head = "one two three four five six seven eight"
    lines = [f"{head} a b c d", f"{head} a b x y", f"{head} p q c d", f"{head} k l m n", f"{head} a b c d e", "one two"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], DOCS)
    keys = {r.doc_id: set(r.k) for r in df.select("doc_id", linetree.templates(linetree.masked_lines(F.col("text"))[0]).alias("k")).collect()}
    assert keys[0] & keys[1] and keys[0] & keys[2] and not keys[1] & keys[2]
    assert not keys[0] & keys[3] and not keys[0] & keys[4] and len(keys[5]) == 1


def test_boilerplate_heavy_pages_and_short_lines(spark):
    """Pages with 40 words of their own and five lines of twelve that all share lose these lines and a short one; near copies of a text keep theirs."""
    rnd = random.Random(6)
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared = [say(12) for _ in range(5)]
    rows = [(i, "\n".join([say(40), *shared, "Read more"])) for i in range(200)]
    text = [say(20) for _ in range(6)]
    for i in range(30):  # one word of one line changed
        near = list(text)
        at = rnd.randrange(6)
        near[at] = " ".join([*near[at].split(" ")[:-1], f"new{chr(97 + i % 26)}"])
        rows.append((1000 + i, "\n".join(near)))
    rows += [(2000 + i, "\n".join([say(30), "Yes"])) for i in range(10)]  # too few for a single word
    out = {r.row.doc_id: r for r in linetree.drop_recurring(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t in rows:
        assert out[i].kept == (t.split("\n")[0] if i < 200 else t), i


def test_lines_empty_table(spark):
    assert linetree.drop_recurring(spark.createDataFrame([], DOCS)).count() == 0


def word_list(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain_leaks(docs, items, similarity):
    found = {}
    for d, text in docs:
        words = word_list(text)
        for item, said in items:
            want = word_list(said)
            k = min(5, len(want))
            if not want or len(words) < k:
                continue
            grams = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
            a, b = grams(words), grams(want)
            for s in range(max(1, len(a) - len(b) + 1)):
                x, y = Counter(a[s : s + len(b)]), Counter(b)
                common = sum((x & y).values())
                value = common / (sum(x.values()) + len(b) - common)
                if value >= similarity:
                    found[d, item] = max(found.get((d, item), 0), value)
    return found


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rnd.randint(1, 60)))) for i in range(12)] + [(50, None), (51, "?!"), (0, "again " * 9), (None, " ".join(say(30)))]
    docs = []
    for d in range(60):
        words = say(rnd.randint(0, 150))
        leak = word_list(rnd.choice(items)[1])
        for _ in range(rnd.randint(0, 3)):
            if leak:
                leak[rnd.randrange(len(leak))] = "changed"
        at = rnd.randint(0, len(words))
        docs.append((d, " ".join(words[:at] + leak + words[at:]).upper()))
    docs += [(60, None), (61, ""), (62, "..."), (None, items[3][1]), (63, "z " * 4000 + (items[2][1]))]
    df = spark.createDataFrame([*docs, docs[3]], DOCS).withColumn("item_id", F.lit("clash")).withColumn("pos", F.lit(0))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("n", F.lit(1))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(df, bench).collect()}
    want = plain_leaks(docs, items, 0.8)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    leaked = {d for d, _ in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in [*docs, docs[3]] if d not in leaked)


def test_items_with_one_beginning_are_found_by_the_index(spark):
    """Many items that share twelve words: a position carries lengths, the index the items; equal texts under two ids are two items."""
    rnd = random.Random(11)
    say = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(4)) for _ in range(n))
    head = say(12)
    items = [(i, f"{head} {say(18)}") for i in range(60)] + [(None, f"{head} {say(18)}"), (60, "one and the same text of this item"), (None, "one and the same text of this item"), (7, "another text under the id seven")]
    docs = [(0, f"{say(20)} {items[5][1]} {say(20)}"), (1, f"{head} {say(40)}"), (2, items[60][1]), (3, "x one and the same text of this item y"), (4, "another text under the id seven " * 2)]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(df, bench).collect()}
    want = plain_leaks(docs, items, 0.8)
    assert set(got) == set(want) == {(0, 5), (2, None), (3, 60), (3, None), (4, 7)} and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_leaks_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c")], DOCS), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(docs, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench).count() == 1
    assert decontaminate.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")).count() == 0


def test_simhash_is_the_majority_of_bits(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.getrandbits(64) - (1 << 63) for _ in range(rnd.randint(1, 50))]) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, w array<bigint>").withColumn("f", decontaminate.simhash(F.col("w")))
    for r in df.collect():
        want = sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in r.w) > len(r.w))
        assert r.f & (2**64 - 1) == want
