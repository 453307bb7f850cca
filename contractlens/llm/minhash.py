"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and union-find grouping.

Rules for odd input: a null or wordless text has no shingles and links with nothing; a text of fewer words than a shingle is one
shingle; rows with equal ids count as one document; a row whose id is null links with nothing (component_id null, kept true);
an empty table gives an empty result; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, drop, small, table, tidied, written

WORDS, SLOTS, ROWS = 5, 250, 5
#: Shingles that are signed together, and words whose hashes a worker keeps: bounds of its memory.
FLUSH, KNOWN_WORDS = 32_000, 100_000
#: Bits of the parity vector of a set. Where two of them differ, the sets differ: an exact bound on how many shingles only one has.
PARITY = 1024
#: Fixed odd constants of the 64-bit mixing function.
GOLD, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class WordHashes(dict):
    """Word -> 64-bit hash, kept to a bounded size."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def mix(x):
    """A bijective scramble of uint64."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: WordHashes, k: int = WORDS):
    """Sorted distinct 64-bit hashes of a text's k-word shingles; A-Z lower-cased, words split at ASCII white space."""
    import numpy as np

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - k + 1)
    acc = np.full(n, len(w) if len(w) < k else k, np.uint64)
    for j in range(min(k, len(w))):
        acc = mix(acc + np.uint64(GOLD)) ^ w[j : j + n]
    return np.unique(mix(acc + np.uint64(GOLD)))


def signatures(sets: list, slots: int = SLOTS):
    """SuperMinHash of each non-empty set, for a whole batch at once.

    Step j gives every element the j-th position of its own random permutation and the value j + u. Only elements of sets whose
    largest slot value is still j + 1 or more go to the next step: later values cannot lower any slot (early stopping).
    """
    import numpy as np

    count = len(sets)
    sig = np.full(count * slots, np.inf)
    elems = np.concatenate(sets)
    doc = np.repeat(np.arange(count), [len(s) for s in sets])
    perm = None
    for j in range(slots):
        r = mix(elems + np.uint64((j + 1) * GOLD & 0xFFFFFFFFFFFFFFFF))
        value = j + (r >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = (j + mix(r ^ np.uint64(MIX1)) % np.uint64(slots - j)).astype(np.int64)
        if perm is None:
            place = k
        else:
            rows = np.arange(len(k))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(sig, doc * slots + place, value)
        live = (sig.reshape(count, slots).max(1) >= j + 1)[doc]
        if not live.any():
            break
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (int(live.sum()), 1))
            rows = np.arange(len(perm))
            perm[rows, k[live]] = perm[:, 0]
        else:
            perm = perm[live]
        elems, doc = elems[live], doc[live]
    return sig.reshape(count, slots)


def bands(sig, rows: int = ROWS):
    """One 64-bit hash for each group of rows slots, salted with the group's number."""
    import numpy as np

    bits = sig.view(np.uint64).reshape(len(sig), -1, rows)
    acc = np.arange(bits.shape[1], dtype=np.uint64)[None, :] * np.uint64(GOLD)
    for j in range(rows):
        acc = mix(acc + np.uint64(GOLD)) ^ bits[:, :, j]
    return mix(acc)


def parity(hashes):
    """For each of PARITY cells, whether an odd number of a set's hashes falls there."""
    import numpy as np

    odd = np.bincount((hashes & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sign(batches, slots, rows, k):
    import numpy as np
    import pyarrow as pa

    hashes = WordHashes()

    def flush(ids, sets):
        full = [i for i, s in enumerate(sets) if len(s)]
        sig = signatures([sets[i] for i in full], slots) if full else None
        got = dict(zip(full, bands(sig, rows).view(np.int64), strict=True)) if full else {}
        digest = [(int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s)))) if len(s) else (None, None) for s in sets]
        signed = lambda x: None if x is None else x - (1 << 64) if x >> 63 else x
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([signed(d[0]) for d in digest], pa.int64()),
                pa.array([signed(d[1]) for d in digest], pa.int64()),
                pa.array([got.get(i) for i in range(len(sets))], pa.list_(pa.int64())),
                pa.array([parity(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ],
            ["doc_id", "n_shingles", "d1", "d2", "bands", "parity"],
        )

    for b in batches:
        ids, sets, size = [], [], 0
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids.append(i)
            sets.append(s := shingles(t.as_py(), hashes, k))
            size += len(s)
            if size > FLUSH:
                yield flush(ids, sets)
                ids, sets, size = [], [], 0
        if ids:
            yield flush(ids, sets)


def _verify(batches, percent, k):
    """Pairs with both texts in, the pairs that hold out."""
    import numpy as np
    import pyarrow as pa

    hashes, kept = WordHashes(), {}

    def of(i, t):
        if i not in kept:
            if len(kept) > 64:
                kept.clear()
            kept[i] = (t, shingles(t, hashes, k))
        elif kept[i][0] != t:
            kept[i] = (t, shingles(t, hashes, k))
        return kept[i][1]

    for b in batches:
        u, v = [], []
        for i, j, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            a, c = of(i, x.as_py()), of(j, y.as_py())
            both = len(np.intersect1d(a, c, assume_unique=True))
            if 100 * both >= percent * (len(a) + len(c) - both) and both:
                u.append(i)
                v.append(j)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _links(texts: DataFrame, pairs: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (u, v) of a written table whose full shingle sets are alike enough."""
    ids = written(pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct(), "mh-ids")
    wanted = texts.join(small(ids), "doc_id")
    a = wanted.select(F.col("doc_id").alias("u"), F.col("text").alias("x"))
    b = wanted.select(F.col("doc_id").alias("v"), F.col("text").alias("y"))
    both = pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", "x", "y")
    out = written(both.mapInArrow(tidied(_verify, percent=percent, k=k), "u long, v long"), "mh-links")
    drop(ids)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, words: int = WORDS, slots: int = SLOTS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Rows with equal shingle sets become one class (min id). Each bucket of a band first compares its members with its smallest
    one; what that links is grouped, and only members of buckets that still hold several groups are compared across groups. Before texts
    are fetched, a pair must pass exact bounds on lengths and parity vectors, which no pair at the threshold fails. Members of a bucket
    meet by length class: sets at the threshold are of one class or of neighbouring ones. With 50 bands of 5 slots a pair at 0.75 meets
    in some band with probability 1 - 2e-6.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = written(src.mapInArrow(tidied(_sign, slots=slots, rows=rows, k=words), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, parity array<long>"), "mh-sig")
    real = sig.where("doc_id is not null and n_shingles > 0")
    classes = real.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("parity").alias("parity"))
    reps = written(classes.select("rep", F.col("n_shingles").alias("n"), "bands", "d1", "d2", "parity"), "mh-reps")
    banded = reps.select("rep", "n", F.posexplode("bands").alias("band", "h"))
    buckets = banded.groupBy("band", "h").agg(F.min("rep").alias("pivot"), F.count("*").alias("c"), F.max("rep").alias("top")).where("pivot < top").select("band", "h", "pivot")
    members = written(banded.join(buckets, ["band", "h"]), "mh-members")
    cells = PARITY // 64
    bits = lambda name: reps.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), *[F.element_at("parity", i + 1).alias(f"{name}{i}") for i in range(cells)])

    def possible(u: str, v: str):
        """The exact bounds: 100 both >= percent union, with both = (n - d) / 2 and union = (n + d) / 2 for n = |u| + |v| and d = |u ^ v|."""
        n_u, n_v = F.col(f"n_{u}"), F.col(f"n_{v}")
        differ = sum((F.bit_count(F.col(f"{u}{i}").bitwiseXOR(F.col(f"{v}{i}"))) for i in range(cells)), F.lit(0))
        return (F.least(n_u, n_v) * 100 >= F.greatest(n_u, n_v) * percent) & (differ * (100 + percent) <= (n_u + n_v) * (100 - percent))

    pairs = written(members.where("rep <> pivot").select(F.col("pivot").alias("u"), F.col("rep").alias("v")).distinct(), "mh-pairs")
    star = written(pairs.join(bits("u"), "u").join(bits("v"), "v").where(possible("u", "v")).select("u", "v"), "mh-star")
    texts = src.where("doc_id is not null and text is not null")
    first = _links(texts, star, percent, words)
    comp = written(components(first, "mh-cc"), "mh-comp")
    marked = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = marked.groupBy("band", "h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.when(F.col("rep") == F.col("pivot"), F.col("comp"))).alias("pc")).where("lo < hi").select("band", "h", "pc")
    left = written(marked.join(mixed, ["band", "h"]).select("band", "h", "rep", "comp", "pivot", "pc"), "mh-left")
    # a class reaches a little further than the threshold's length ratio, so that rounding cannot part neighbours
    ratio = math.log(100 / percent) * 1.001 if percent < 100 else 1.0
    grade = lambda n: F.floor(F.log(F.col(n).cast("double")) / F.lit(ratio))
    s = left.where("comp <> pc").select("band", "h", F.col("rep").alias("s"), F.col("comp").alias("cs"), "pivot").join(bits("s"), "s")
    s = s.withColumn("grade", F.explode(F.array(*[grade("n_s") + i for i in (-1, 0, 1)])))
    m = left.select("band", "h", F.col("rep").alias("m"), F.col("comp").alias("cm"), "pc").join(bits("m"), "m").withColumn("grade", grade("n_m"))
    cross = s.join(m, ["band", "h", "grade"]).where((F.col("cs") != F.col("cm")) & (F.col("m") != F.col("pivot")) & ((F.col("cm") == F.col("pc")) | (F.col("s") < F.col("m"))) & possible("s", "m"))
    rest = written(cross.select(F.least("s", "m").alias("u"), F.greatest("s", "m").alias("v")).distinct(), "mh-rest")
    links = first
    second = None
    if rest.limit(1).count():
        second = _links(texts, rest, percent, words)
        links = first.unionByName(second)
    # a document whose id is shared by several shingle sets joins their classes
    shared = real.join(reps.select("d1", "d2", F.col("n").alias("n_shingles"), "rep"), ["d1", "d2", "n_shingles"])
    own = written(shared.select(F.col("doc_id"), "rep").distinct(), "mh-own")
    twice = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    more = own.join(twice.select("doc_id"), "doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    final = components(links.unionByName(more), "mh-final")
    named = own.join(final.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("comp", "rep")).alias("comp"))
    out = sig.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    comp_id = F.coalesce("comp", "doc_id")
    result = out.select("doc_id", "n_shingles", comp_id.alias("component_id"), F.coalesce(comp_id == F.col("doc_id"), F.lit(True)).alias("kept"))
    result.work_tables = [sig, reps, members, pairs, star, comp, left, rest, own, *([second] if second is not None else []), first]
    return result


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents at five words and 0.75."""
    return near_duplicates(table(spark, sf_dir, "documents"))
