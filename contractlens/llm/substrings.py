"""Removal of repeated byte strings by suffix arrays.

A 200-byte window is named by its anchor: the 48-byte gram in it with the least hash, leftmost of equals. Equal windows have equal
anchors, so windows dealt by anchor need to meet only those of the same anchor. Runs of windows with one anchor place form a row (352
bytes at most). Only rows whose anchor occurs twice go on; equal rows (by a 128-bit digest of their bytes) are counted, and of anchors with
different rows one copy of each goes to a shard; where all rows of an anchor are equal, their count says all there is to know. A shard sorts its suffixes by Larsson-Sadakane doubling (only groups that are not yet sorted are refined), takes common
prefixes by Kasai's rule, and marks windows that share 200 bytes with a neighbour. An anchor with too many rows for one shard is split;
its shards' sorted windows are merged slot by slot with binary searches.

Rules for odd input: a null or empty text has 0 bytes; a text shorter than a window is kept whole; repeated rows repeat each other, so
they lose all windows; a null id is a row like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, drop, row_key, table, tidied, written

WINDOW, GRAM = 200, 48
#: Bytes a slice is scanned in, rows a shard aims at, distinct rows of one anchor above which it is split, most bits of the anchor filter.
SLICE, SHARD_ROWS, HOT_ROWS, FILTER_BITS = 1 << 19, 6_000, 6_000, 28
#: Fixed odd multiplier of the rolling hash.
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


class Roller:
    """Powers of the rolling hash's base and of its inverse modulo 2^64, and a random number for each byte."""

    def __init__(self, n: int):
        import numpy as np

        inverse = pow(BASE, -1, 1 << 64)
        self.up, self.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, x & MASK, np.uint64)])) for x in (BASE, inverse))
        self.byte = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)

    def grams(self, buf, k: int):
        """64-bit hash of the k bytes from each position."""
        import numpy as np

        h = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.byte[buf] * self.up[: len(buf)], out=h[1:])
        x = (h[k:] - h[:-k]) * self.down[: len(buf) - k + 1]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def runs(roller, buf, window: int, gram: int):
    """Runs of windows with one anchor place: (first window, one past the last, anchor hash) of a buffer of at least a window."""
    import numpy as np

    g = roller.grams(buf, gram)
    w, n = window - gram + 1, len(buf) - window + 1
    key = (g & ~np.uint64((1 << 20) - 1)) | np.arange(len(g), dtype=np.uint64)
    blocks = -(-len(key) // w)
    pad = np.full(blocks * w, MASK, np.uint64)
    pad[: len(key)] = key
    pad = pad.reshape(blocks, w)
    left = np.minimum.accumulate(pad, axis=1).ravel()
    right = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.minimum(right[:n], left[w - 1 : w - 1 + n])
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate([[0], cut])
    return first, np.concatenate([cut, [n]]), g[(at[first] & np.uint64((1 << 20) - 1)).astype(np.int64)]


def _slices(texts, window):
    """(text number, offset, bytes) pieces of texts; a long text is cut into pieces that overlap by a window less a byte."""
    for i, t in enumerate(texts):
        raw = t or b""
        for at in range(0, max(0, len(raw) - window + 1), SLICE):
            yield i, at, raw[at : at + SLICE + window - 1]


def _bytes(column):
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def _joined(texts, window):
    """Batches of pieces laid end to end: (buffer, list of (text, offset, start, length))."""
    import numpy as np

    parts, where, size = [], [], 0
    for i, at, raw in _slices(texts, window):
        if size and size + len(raw) > SLICE + window:
            yield np.frombuffer(b"".join(parts), np.uint8), where
            parts, where, size = [], [], 0
        parts.append(raw)
        where.append((i, at, size, len(raw)))
        size += len(raw)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), where


def _rows(texts, roller, window, gram):
    """For each batch of pieces: buffer, text number, byte offset in the text, first and last window in the buffer, anchor, of each run."""
    import numpy as np

    for buf, where in _joined(texts, window):
        first, last, anchor = runs(roller, buf, window, gram)
        start = np.array([w[2] for w in where])
        stop = start + np.array([w[3] for w in where]) - window + 1  # one past a piece's last window
        piece = np.searchsorted(start, first, side="right") - 1
        end = np.minimum(last, stop[piece])
        # a run may reach over windows that straddle pieces into the next piece
        nxt = np.minimum(piece + 1, len(start) - 1)
        over = (last > start[nxt]) & (nxt > piece)
        first2, last2, piece2, anchor2 = start[nxt][over], np.minimum(last, stop[nxt])[over], nxt[over], anchor[over]
        ok = end > first
        f, e, p, a = (np.concatenate([x[ok], y]) for x, y in ((first, first2), (end, last2), (piece, piece2), (anchor, anchor2)))
        good = e > f
        f, e, p, a = f[good], e[good], p[good], a[good]
        text, off = np.array([w[0] for w in where])[p], np.array([w[1] for w in where])[p] + f - start[p]
        yield buf, text, off, f, e, a


def _anchors(batches, window, gram):
    import numpy as np
    import pyarrow as pa

    roller = Roller(2 * (SLICE + window))
    for b in batches:
        for *_, a in _rows(_bytes(b.column(0)), roller, window, gram):
            kinds, n = np.unique(a.view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n.astype(np.int64))], ["a", "n"])


def _repeated(batches, window, gram, bits, power):
    """Rows whose anchor is in the filter: anchor, 128-bit digest of their bytes, text key, offset, number of windows. Their bytes stay in the text."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    roller, seen = Roller(2 * (SLICE + window)), bits.value
    for b in batches:
        k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
        for buf, text, off, f, e, a in _rows(_bytes(b.column(2)), roller, window, gram):
            spot = (a >> np.uint64(64 - power)).astype(np.int64)
            on = np.flatnonzero((seen[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1))
            if not len(on):
                continue
            d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(buf[x : y + window - 1]) for x, y in zip(f[on].tolist(), e[on].tolist(), strict=True)), np.int64).reshape(-1, 2)
            t = text[on]
            yield pa.RecordBatch.from_arrays([pa.array(a[on].view(np.int64)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(k1[t]), pa.array(k2[t]), pa.array(off[on]), pa.array((e - f)[on].astype(np.int32))], ["a", "d", "d2", "k1", "k2", "s", "n"])


def _fetch(batches, window):
    """The bytes of the rows that a text was asked for."""
    import pyarrow as pa

    kinds = [*[pa.int64()] * 5, pa.binary()]
    for b in batches:
        for raw, wanted in zip(_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
            rows = [(w["a"], w["d"], w["d2"], w["c"], w["pieces"], raw[w["s"] : w["s"] + w["n"] + window - 1]) for w in wanted]
            for i in range(0, len(rows), 5_000):
                part = list(zip(*rows[i : i + 5_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(part, kinds, strict=True)], ["a", "d", "d2", "c", "pieces", "raw"])


def eights(buf):
    """Eight bytes from each position as a big-endian number, zeros behind the end."""
    import numpy as np

    pad = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(buf), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | pad[j : j + len(buf)]
    return out


def suffix_array(buf, depth: int):
    """Suffix order of buf, exact in the first depth bytes at least."""
    import numpy as np

    n = len(buf)
    key = eights(buf)
    sa = np.argsort(key, kind="stable")
    sorted_ = key[sa]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = group
    h = 8
    while h < depth:
        head = np.concatenate([new, [True]])
        open_ = np.flatnonzero(~(head[:-1] & head[1:]))  # places in groups of more than one
        if not len(open_):
            break
        sub = sa[open_]
        after = np.where(sub + h < n, rank[np.minimum(sub + h, n - 1)], -1)
        order = np.lexsort((after, rank[sub]))
        sub, after = sub[order], after[order]
        own = rank[sub]
        sa[open_] = sub
        first = np.concatenate([[True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])])
        new[open_] = first
        rank[sub] = np.maximum.accumulate(np.where(first, open_, 0))
        h *= 2
    return sa


def common_prefixes(buf, sa):
    """Common prefix of each suffix in order with the one before it (0 for the first).

    Kasai's rule: where the bytes before both suffixes agree, the prefix is one less than at the position before; only the other
    positions are compared, eight bytes at a time.
    """
    import numpy as np

    n = len(buf)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    same = np.zeros(n, bool)
    inner = (i > 0) & (before > 0)
    same[inner] = buf[i[inner] - 1] == buf[before[inner] - 1]
    todo = np.flatnonzero(~same & (before >= 0))
    length = np.zeros(n, np.int64)
    key = np.concatenate([eights(buf), np.zeros(8, np.uint64)])
    live = todo
    while len(live):
        a, b = live + length[live], before[live] + length[live]
        room = np.maximum(a, b) + 8 <= n
        live, a, b = live[room], a[room], b[room]
        live = live[key[a] == key[b]]
        length[live] += 8
    live = todo
    for _ in range(8):
        a, b = live + length[live], before[live] + length[live]
        room = np.maximum(a, b) < n
        live = live[room]
        live = live[buf[a[room]] == buf[b[room]]]
        length[live] += 1
    last = np.maximum.accumulate(np.where(same, 0, i))
    return np.maximum(0, length[last] - (i - last))[sa]


def repeated_windows(raws: list[bytes], counts, window: int):
    """(row, window) pairs, as arrays, of windows that start twice among the rows, and all windows in suffix order."""
    import numpy as np

    buf = np.frombuffer(b"".join(raws), np.uint8)
    size = np.array([len(r) for r in raws])
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(len(raws)), size)
    off = np.arange(len(buf)) - start[row]
    valid = off + window <= size[row]
    sa = suffix_array(buf, len(buf))  # in full: Kasai's rule needs the true order
    prefix = common_prefixes(buf, sa)
    at = np.flatnonzero(valid[sa])
    order = sa[at]
    shared = np.minimum.reduceat(prefix[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
    # shared[k]: least prefix over the places after the valid one before k, up to k
    twin = np.zeros(len(order), bool)
    eq = shared >= window
    eq[:1] = False
    twin |= eq
    twin[:-1] |= eq[1:]
    hit = twin | (np.asarray(counts)[row[order]] >= 2)
    return row[order], off[order], hit


def _ranges(rows, offs, window):
    """Per row, merged (from, to) byte stretches that its windows cover."""
    import numpy as np

    by = np.lexsort((offs, rows))
    rows, offs = rows[by], offs[by]
    first = np.concatenate([[True], (rows[1:] != rows[:-1]) | (offs[1:] > offs[:-1] + window)])
    a = np.flatnonzero(first)
    b = np.concatenate([a[1:], [len(rows)]]) - 1
    return rows[a], offs[a], offs[b] + window


def _sorted(group, window):
    """One shard: covered stretches of its rows; for shards of a split anchor also each sorted window's digest (slot >= 0)."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    names = ["a", "d", "d2", "x", "y", "slot", "w1", "w2"]
    raws, counts = group.column("raw").to_pylist(), group.column("c").to_numpy()
    a, d, d2 = (group.column(c).to_numpy() for c in ("a", "d", "d2"))
    rows, offs, hit = repeated_windows(raws, counts, window)
    r, x, y = _ranges(rows[hit], offs[hit], window) if hit.any() else (np.empty(0, np.int64),) * 3
    none = np.full(len(r), -1)
    cols = [a[r], d[r], d2[r], x, y, none, none, none]
    if group.column("pieces")[0].as_py() > 1:
        w = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raws[i][o : o + window]) for i, o in zip(rows.tolist(), offs.tolist(), strict=True)), np.int64).reshape(-1, 2)
        slot = (np.ascontiguousarray(w[:, 0]).view(np.uint64) % np.uint64(4096)).astype(np.int64)
        cols = [np.concatenate(p) for p in zip(cols, [a[rows], d[rows], d2[rows], offs, offs + window, slot, w[:, 0], w[:, 1]], strict=True)]
    return pa.table([pa.array(np.ascontiguousarray(c).astype(np.int64)) for c in cols], names)


def _cross(group, window):
    """Windows of one slot of a split anchor: those whose digest another window has, by binary search in the sorted run."""
    import numpy as np
    import pyarrow as pa

    w = np.rec.fromarrays([group.column("w1").to_numpy(), group.column("w2").to_numpy()], names="p,q")
    run = np.sort(w)
    many = np.searchsorted(run, w, side="right") - np.searchsorted(run, w, side="left") >= 2
    return group.select(["a", "d", "d2", "x", "y"]).filter(pa.array(many))


def _cut(batches):
    """Remove the covered stretches from the texts and digest what is left."""
    import hashlib

    import pyarrow as pa

    for b in batches:
        out = []
        for raw, spans in zip(_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
            raw, at, kept, gone, n = raw or b"", 0, hashlib.sha256(), 0, 0
            merged: list[list[int]] = []
            for s in sorted((s["x"], s["y"]) for s in spans or []):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            for x, y in merged:
                kept.update(raw[at:x])
                gone, n, at = gone + y - x, n + 1, y
            kept.update(raw[at:])
            out.append((len(raw), gone, n, kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([o[k] for o in out], pa.int64()) for k in range(3)], pa.array([o[3] for o in out])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def covered(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_rows: int = HOT_ROWS) -> DataFrame:
    """k1, k2 and spans (array of byte stretches, overlapping) of every text that holds a repeated window."""
    import numpy as np

    spark = docs.sparkSession
    src = docs.select(*row_key(F.col("doc_id"), F.col("text")), "text").where(F.octet_length("text") >= window)
    counted = src.select("text").mapInArrow(tidied(_anchors, window=window, gram=gram), "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    twice = written(counted.where("n > 1").select("a"), "sub-anchors")
    # a filter of bounded size; when it fills up it only lets more rows through
    power = min(FILTER_BITS, max(10, (16 * twice.count() + 1).bit_length()))
    spot = F.shiftrightunsigned("a", 64 - power)
    one = F.expr(f"shiftleft(cast(1 as bigint), cast(pmod(shiftrightunsigned(a, {64 - power}), 64) as int))")
    words = twice.select(F.shiftright(spot, 6).alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (power - 6), np.uint64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)
    rows = written(src.mapInArrow(tidied(_repeated, window=window, gram=gram, bits=shared, power=power), "a long, d long, d2 long, k1 long, k2 long, s long, n int"), "sub-rows")
    drop(twice)
    # equal rows (same anchor, same digest) are one kind, with one place that has its bytes
    kinds = written(rows.groupBy("a", "d", "d2").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "s", "n")).alias("at")), "sub-kinds")
    per = kinds.groupBy("a").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    marked = written(kinds.join(per, "a").select("a", "d", "d2", "c", "kinds", "at.*"), "sub-marked")
    drop(kinds)
    several = marked.where("kinds > 1").withColumn("pieces", F.ceil(F.col("kinds") / hot_rows))
    wanted = written(several.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "d", "d2", "c", "pieces", "s", "n")).alias("wanted")), "sub-wanted")
    keys = wanted.select("k1", "k2")
    keys = F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys
    texts = src.join(keys, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    distinct = texts.join(wanted, ["k1", "k2"]).select("text", "wanted").mapInArrow(tidied(_fetch, window=window), "a long, d long, d2 long, c long, pieces long, raw binary")
    shards = max(1, -(-several.count() // SHARD_ROWS))
    shard = F.when(F.col("pieces") > 1, F.xxhash64("a", F.pmod("d", F.col("pieces")))).otherwise(F.pmod(F.xxhash64("a"), F.lit(shards)))
    found = written(distinct.withColumn("shard", shard).groupBy("shard").applyInArrow(partial(_sorted, window=window), "a long, d long, d2 long, x long, y long, slot long, w1 long, w2 long"), "sub-found")
    split = found.where("slot >= 0").groupBy("a", "slot").applyInArrow(partial(_cross, window=window), "a long, d long, d2 long, x long, y long")
    whole = marked.where("kinds = 1").select("a", "d", "d2", F.lit(0).cast("long").alias("x"), (F.col("n") + (window - 1)).cast("long").alias("y"))
    parts = whole.unionByName(found.where("slot < 0").select("a", "d", "d2", "x", "y")).unionByName(split)
    hit = rows.select("a", "d", "d2", "k1", "k2", "s").join(parts, ["a", "d", "d2"]).select("k1", "k2", (F.col("s") + F.col("x")).alias("x"), (F.col("s") + F.col("y")).alias("y"))
    return written(hit.groupBy("k1", "k2").agg(F.collect_set(F.struct("x", "y")).alias("spans")), "sub-spans")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = covered(docs, window, gram, hot_rows)
    keyed = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), "text")
    keys = spans.select("k1", "k2")
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # then only texts that lose bytes are shuffled
        keys = F.broadcast(keys)
        rest = keyed.join(keys, ["k1", "k2"], "left_anti").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
        both = rest.unionByName(keyed.join(keys, ["k1", "k2"], "left_semi").join(spans, ["k1", "k2"]))
    else:
        both = keyed.join(spans, ["k1", "k2"], "left")
    return both.select("doc_id", "text", "spans").mapInArrow(tidied(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
