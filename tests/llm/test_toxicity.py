import random
import zlib

import numpy as np

from contractlens.llm import toxicity


def corpus(n, seed):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [f"w{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}ab" for _ in range(40)]
        y = int(rnd.random() < 0.3)
        if y:
            w += rnd.sample(["idiot", "grumblix", "grumbler", "snarfo", "trash"], 3)
            rnd.shuffle(w)
        docs.append((i, " ".join(w), "extra"))
        labels.append((i, 1, y))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(900, 4)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(d, lab).collect()}
    out = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == (y == 1) for i, y in out]) >= 0.97
    kept = {r.doc_id for r in toxicity.reject(d, lab).collect()}
    assert kept == {i for i in got if got[i] < 0.7}


def test_held_out_labels_do_not_matter(spark):
    docs, labels = corpus(300, 5)
    flip = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, q, y in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    a, b = ({r.doc_id: round(r.score, 9) for r in toxicity.score(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, flip))
    assert a == b


def test_nulls_and_no_labels(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (None, "idiot")], "doc_id long, text string")
    none = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score(d, none).collect())
    assert toxicity.score(d.limit(0), none).count() == 0
