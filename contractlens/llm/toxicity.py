"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier on its posteriors.

Voters are lexicons of insults, contempt, threats and dismissals, patterns (shouting, runs of marks, links, masked words and others), and
words and word beginnings (of 3 to 8 letters) that the training rows tie to either label. The label model estimates each voter's hit rates under both classes by expectation maximization, with the
given labels as one more voter of estimated accuracy, and discounts voters by their correlation within a class. A logistic regression on
the votes is fitted to the posteriors. Training takes at most TRAIN_ROWS labelled rows, chosen by hash, whose held-out remainder is not
HELD_OUT; labels, lang, source and doc_id are never inputs of a score.

Rules for odd input: a null or empty text gets the score of a document without votes; a null label or id is not used for training;
without labelled rows of both classes every score is the share of toxic ones, a half at most, so that nothing is rejected; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, small, table, tidied, written

TRAIN_ROWS, VOTERS, FOLDS, HELD_OUT, REJECT = 4_000, 400, 3, 1, 0.7
STEMS = (3, 4, 5, 6, 7, 8)
#: Lexicon voters, each with its words: insults, contempt, threats, dismissals.
LEXICONS = {
    "!insult": "idiot stupid moron loser scum trash clown dumb fool garbage jerk imbecile cretin dimwit halfwit buffoon".split(),
    "!contempt": "pathetic worthless disgusting ugly filthy useless vile despicable repulsive revolting miserable hopeless".split(),
    "!threat": "kill hurt destroy smash beat burn crush choke suffer bleed".split(),
    "!dismissal": "shut silence begone vanish disappear leave".split(),
}
WORD = re.compile(r"[^\W\d_]+")
#: Pattern voters: shouting, runs of marks, links, words masked with signs, words of address, drawn-out letters.
PATTERNS = (
    ("!shout", re.compile(r"(?:\b[A-Z]{3,}\b\W+){3}")),
    ("!marks", re.compile(r"!!|\?\?")),
    ("!link", re.compile(r"https?://")),
    ("!masked", re.compile(r"\b[A-Za-z][*#@$%]{2,}[a-z]?\b|\b[A-Za-z]+\*+[a-z]+")),
    ("!address", re.compile(r"\b[Yy]ou(?:'re| are)? (?:a|an|all|such|so|people)\b")),
    ("!drawn", re.compile(r"([A-Za-z])\1\1\1")),
)
IN_LEXICONS = {w: [name for name, words in LEXICONS.items() if w in words] for words in LEXICONS.values() for w in words}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def units(word: str) -> list[str]:
    """A word as voters see it: itself, and its beginnings marked with a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n), *IN_LEXICONS.get(word, ())]


def features(text: str | None) -> set[str]:
    text = text or ""
    out = {u for w in set(WORD.findall(text.lower())) for u in units(w)}
    return out | {name for name, p in PATTERNS if p.search(text)}


def _hashed(batches):
    """Training rows as sorted 64-bit feature hashes, so that the driver gets numbers, not texts."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    for b in batches:
        rows = [np.sort(np.fromiter((xxhash.xxh64_intdigest(f) >> 1 for f in features(t)), np.int64)) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64())), *b.columns[1:]], ["f", "y", "o", "t"])


def label_model(votes, labels, rounds: int = 20):
    """Posterior of class 1 for each row, and (rate under 0, rate under 1, discount) of each voter.

    votes: rows x voters of 0/1. The labels are a voter whose accuracy is estimated as well, from a start of 0.95.
    """
    import numpy as np

    p = np.where(labels > 0, 0.95, 0.05)
    for _ in range(rounds):
        n1, n0 = p.sum() + 2, (1 - p).sum() + 2
        r1 = (p @ votes + 0.5) / n1
        r0 = ((1 - p) @ votes + 0.5) / n0
        resid = votes - np.outer(p, r1) - np.outer(1 - p, r0)
        std = resid.std(0) + 1e-6
        corr = np.clip((resid.T @ resid) / len(votes) / np.outer(std, std), 0, 1)
        weight = 1 / np.maximum(1, corr.sum(1))
        right = np.clip((p @ labels + (1 - p) @ (1 - labels)) / len(p), 0.6, 0.99)
        on, off = np.log(r1 / r0) * weight, np.log((1 - r1) / (1 - r0)) * weight
        z = np.log(n1 / n0) + votes @ on + (1 - votes) @ off + np.where(labels > 0, 1, -1) * np.log(right / (1 - right))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p, r0, r1, weight


def fit_linear(votes, target, ridge: float = 0.02, rounds: int = 25):
    """Ridge logistic regression on soft labels by Newton steps; returns weights with the bias last."""
    import numpy as np

    x = np.hstack([votes, np.ones((len(votes), 1))])
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(pen), x.T @ (target - p) - pen * w)
        w += step
        if abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[dict[int, float], float]:
    """Weight by feature hash, and the bias."""
    import numpy as np

    order = F.xxhash64("id", F.lit(7))
    given = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    given = written(given.orderBy(order, "id", "y").limit(most), "tox-given")
    have = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(small(given), "id").select("text", "y", order.alias("o"), F.xxhash64("text").alias("t"))
    # repeated ids may give more rows than labels; the first by the same order count
    with batches(docs.sparkSession):
        rows = have.mapInArrow(tidied(_hashed), "f array<long>, y int, o long, t long").orderBy("o", "t", "y").limit(most).toArrow()
    y = rows.column("y").to_numpy()
    if len(y) == 0 or y.min() == y.max():
        prior = min(0.5, (y.sum() + 1) / (len(y) + 2))
        return {}, float(np.log(prior / (1 - prior)))
    lists = rows.column("f").combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    who = np.repeat(np.arange(len(y)), ends)
    kinds, code = np.unique(flat, return_inverse=True)
    t = np.bincount(code, y[who], len(kinds))
    c = np.bincount(code, 1 - y[who], len(kinds))
    odds = np.log((t + 0.5) / (y.sum() + 1)) - np.log((c + 0.5) / ((1 - y).sum() + 1))
    # seen in a few toxic rows at least and mostly there; the strongest by how many rows they settle
    good = np.flatnonzero((t >= 3) & (odds > 2.5))
    good = good[np.lexsort((kinds[good], -(odds[good] * np.sqrt(t[good]))))][: VOTERS - 60]
    bad = np.flatnonzero((c >= 20) & (odds < -0.2))
    bad = bad[np.lexsort((kinds[bad], odds[bad] * np.sqrt(c[bad])))][:60]
    chosen = np.concatenate([good, bad])
    slot = np.full(len(kinds), -1)
    slot[chosen] = np.arange(len(chosen))
    hit = slot[code] >= 0
    votes = np.zeros((len(y), len(chosen)))
    votes[who[hit], slot[code[hit]]] = 1
    posterior, *_ = label_model(votes, y)
    w = fit_linear(votes, posterior)
    return dict(zip(kinds[chosen].tolist(), w[:-1].tolist(), strict=True)), float(w[-1])


def _score(batches, weights, bias):
    import math

    import pyarrow as pa
    import xxhash

    of = lambda u: xxhash.xxh64_intdigest(u) >> 1
    patterns = [(weights[of(n)], p) for n, p in PATTERNS if of(n) in weights]
    known: dict[str, tuple] = {}
    for b in batches:
        out = []
        for t in b.column(1):
            text, hits = t.as_py() or "", {}
            for w in set(WORD.findall(text.lower())):
                if (got := known.get(w)) is None:
                    if len(known) > 150_000:
                        known.clear()
                    got = known[w] = tuple((h, weights[h]) for h in map(of, units(w)) if h in weights)
                if got:
                    hits.update(got)
            z = bias + math.fsum(hits.values()) + sum(v for v, p in patterns if p.search(text))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64()), *b.columns[2:]], ["doc_id", "score", *b.schema.names[2:]])


def score(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """docs' columns but with score for text: doc_id, score. No shuffle once the classifier is fitted."""
    weights, bias = train(docs, labels, most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(_score, weights=weights, bias=bias), "doc_id long, score double")


def _keep(batches, weights, bias, at, limit):
    """Batches of whole rows without those that score limit or more."""
    import pyarrow as pa

    for b in batches:
        two = pa.RecordBatch.from_arrays([pa.array([0] * b.num_rows, pa.int64()), b.column(at)], ["doc_id", "text"])
        s = next(iter(_score([two], weights, bias))).column(1).to_pylist()
        yield b.filter(pa.array([x < limit for x in s], pa.bool_()))


def reject(docs: DataFrame, labels: DataFrame, limit: float = REJECT) -> DataFrame:
    """docs without the rows that score limit or more; all columns stay."""
    weights, bias = train(docs, labels)
    return docs.mapInArrow(tidied(_keep, weights=weights, bias=bias, at=docs.columns.index("text"), limit=limit), docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
