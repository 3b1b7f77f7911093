"""Language identification against the definition of its code lengths, and on held-out rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import langid


def plain_cost(text, counts):
    """Bits by the definition: escape from context to shorter context, then eight bits."""
    total = 0.0
    for i in range(3, len(text)):
        bits = 0.0
        for order in (3, 2, 1, 0):
            seen = counts.get((order, tuple(text[i - order : i])))
            if seen is None:
                continue
            n, t = sum(seen.values()), len(seen)
            if text[i] in seen:
                bits -= np.log2(seen[text[i]] / (n + t))
                break
            bits -= np.log2(t / (n + t))
        else:
            bits += 8
        total += bits
    return total


def counted(texts):
    counts = {}
    for t in texts:
        s = [255] * 3 + list(t)
        for i in range(3, len(s)):
            for order in range(4):
                counts.setdefault((order, tuple(s[i - order : i])), {}).setdefault(s[i], 0)
                counts[order, tuple(s[i - order : i])][s[i]] += 1
    return counts


def test_code_lengths_follow_the_definition(monkeypatch):
    rnd = random.Random(6)
    train = ["".join(rnd.choices("abcde ж日", k=200)).encode() for _ in range(5)]
    grams = np.concatenate([langid._strings(np.frombuffer(b"\xff\xff\xff" + t, np.uint8)) for t in train])
    tree = langid.Tree(*np.unique(grams, return_counts=True))
    texts = [b"abcab", b"ezzq!", b"", "日жa".encode(), b"a", b"bead cab " * 20, bytes(range(128, 200))]
    counts = counted(train)
    want = [plain_cost([255] * 3 + list(t), counts) for t in texts]
    assert langid.code_lengths(texts, [tree, tree]).T.tolist() == [pytest.approx(want, abs=1e-9)] * 2
    monkeypatch.setattr(langid, "_RUN", 7)  # a text in many parts costs the same
    assert langid.code_lengths(texts, [tree])[:, 0] == pytest.approx(want, abs=1e-9)


def test_fit_counts_whole_texts(spark, monkeypatch):
    texts = ["abcABC" * 50, "xyz", "ж" * 40]
    model = langid.fit(spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)] + [(9, "", "l"), (10, None, "l"), (11, "q", None)], "doc_id long, text string, lang string"))
    want = np.unique(np.concatenate([langid._strings(np.frombuffer(b"\xff\xff\xff" + t.lower().encode(), np.uint8)) for t in texts]), return_counts=True)
    grams, numbers = model.counts["l"]
    order = np.argsort(grams)
    assert model.languages == ["l"] and grams[order].tolist() == want[0].tolist() and numbers[order].tolist() == want[1].tolist()


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(langid.learned(docs))
    found = langid.identify(docs.withColumn("score", F.lit("clash")), model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    right = found.filter(langid.held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98
    rows = [(1, None), (2, ""), (3, "12 34 !"), (4, "² ½ Ⅷ ①"), (5, "the")]
    odd = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert [(r["lang_pred"], r["score"]) for r in odd[:4]] == [("und", 0.0)] * 4 and 0 < odd[4]["score"] <= 1 and odd[4]["lang_pred"] in model.languages
    nothing = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs.limit(3), nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).collect() == []


def test_two_scripts_that_share_no_bytes_of_the_others(spark):
    """Languages of other scripts than Latin are told apart by all of their bytes."""
    rnd = random.Random(2)
    alphabets = {"ka": "აბგდევზთიკლმნოპჟრსტუფქ", "hy": "աբգդեզէըթժիլխծկհձղճմյն", "am": "ሀለሐመሠረሰሸቀበተቸኀነኘአከኸወዐ", "ru": "абвгдежзийклмнопрстуфх", "sr": "абвгдђежзијклљмнњопрст"}
    rows = [(i, lang, "".join(rnd.choice(letters + "  ") for _ in range(120))) for lang, letters in alphabets.items() for i in range(40)]
    frame = spark.createDataFrame([(k, lang, text) for k, (_, lang, text) in enumerate(rows)], "doc_id long, lang string, text string")
    model = langid.fit(frame.filter("doc_id % 2 = 0"))
    got = langid.identify(frame.filter("doc_id % 2 = 1"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def test_determined_keeps_rows_as_they_are(spark):
    learn = spark.createDataFrame([(i, "en", "the house on the hill was old and the road to it was long") for i in range(20)], "doc_id long, lang string, text string")
    model = langid.fit(learn)
    rows = [(1, "the old house", {"a": 1}), (2, None, None), (3, "12 !", None), (None, "the road", None), (4, "ქართული ენა არის", None), (4, "the hill", None), (4, "the hill", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang_pred map<string,int>")
    kept = langid.determined(frame, model)
    assert kept.schema == frame.schema and [tuple(r) for r in kept.collect()] == [rows[i] for i in (0, 3, 5, 6)]
    assert [r["doc_id"] for r in langid.determined(frame, langid.Model({})).collect()] == [1, None, 4, 4, 4]
