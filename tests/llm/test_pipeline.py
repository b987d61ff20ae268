"""The stages over a small corpus with planted cases, against what must become of them."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from test_models import classes_of, plain_fingerprint


def corpus(rnd):
    syllables = {"aa": ["the", "ing", "and", "tion", "er", "on"], "bb": ["eau", "ment", "que", "les", "oir", "ai"]}

    def say(lang, n):
        return ["".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(2, 4))) for _ in range(n)]

    docs, kind = [], {}
    passage = " ".join(say("aa", 60))
    item = " ".join(say("aa", 40))

    def add(text, lang, what):
        kind[len(docs)] = what
        docs.append((len(docs), text, lang, "src", len(text or ""), "x", 7))

    for i in range(40):
        lang = "aa" if i % 2 else "bb"
        add("\n".join(" ".join(say(lang, 30)) for _ in range(4)), lang, "clean")
    for i in range(6):
        add("\n".join([*(" ".join(say("aa", 30)) for _ in range(3)), passage]), "aa", "passage")
    near = say("aa", 200)
    for i in range(5):
        words = list(near)
        if i:
            words[rnd.randrange(200)] = "changed"
        add(" ".join(words), "aa", "near")
    for _ in range(4):
        add(docs[0][1], "bb", "copy")
    add(" ".join([*say("aa", 50), item, *say("aa", 50)]), "aa", "leak")
    for odd in (None, "", "123 456 !!"):
        add(odd, "aa", "no letter")
    return docs, kind, passage, item


def test_stages(spark, tmp_path):
    docs, kind, passage, item = corpus(random.Random(3))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, lang_pred int"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, current, str(tmp_path)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == current.columns
        current, left[name] = after, {r.doc_id: r for r in after.collect()}
    is_kind = lambda what: {d for d, k in kind.items() if k == what}
    assert set(left["language"]) == set(kind) - is_kind("no letter")
    assert set(left["lines"]) == set(left["language"])
    for d, row in left["lines"].items():
        before = left["language"][d]
        if kind[d] == "passage":
            assert row.text == before.text.replace("\n" + passage, "") and row.n_chars == len(row.text)
        else:
            assert row == before
    kept, before = set(left["near_copies"]), sorted(left["lines"])
    marks = [plain_fingerprint(left["lines"][d].text, 3) for d in before]
    edges = [(a, b) for a in range(len(before)) for b in range(a) if (marks[a] ^ marks[b]).bit_count() <= 3]
    assert kept == {before[min(group)] for group in classes_of(len(before), edges)}
    assert not kept & is_kind("copy") and is_kind("clean") <= kept
    assert kept - set(left["benchmark"]) == is_kind("leak")
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in done.collect()} == set(left["benchmark"])


def test_stages_on_nothing_and_on_odd_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = [(None, "words without a label", None, None, None), (None, None, None, None, None), (1, "same", "aa", "s", 4), (1, "same", "aa", "s", 4), (2, "long " * 5000, "aa", "s", 25000)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema).withColumn("row", F.lit("clash")).withColumn("dropped", F.lit(1))
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.write.parquet(str(tmp_path / f"{name}{len(rows)}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{len(rows)}"))
        assert docs.count() == (3 if rows else 0)
