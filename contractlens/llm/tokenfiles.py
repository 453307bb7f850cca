"""Token ids in Arrow files: batches of one fixed-size-list column of ids and one of masks, for zero-copy random access.

Documents are put in ascending id order by range partitioning; each partition writes one token file (rows of LENGTH ids, uint16 or
uint32 by vocabulary size, and a mask of the same length, false on the padding of the last row) and one index file (doc_id, first id,
count). Files get a name of their own per task attempt and the name that a finished attempt returns is the one that is read, so a lost
executor's rerun never mixes with what it left.

Rules for odd input: a null or empty text is its end id alone; null ids come first; repeated ids are ordered by a hash of the text; an empty table
gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
import uuid
from itertools import chain, repeat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEPT, batches, new_path, release, table, tidied

LENGTH, BATCH, END = 2048, 256, 2
VOCABULARY = "word_bpe_49k.json"
#: Marks behind a run of letters, at which the tokenizer cuts; words of Latin-1 alone, which are lower-cased letter by letter.
MARKS = ".,!?;:"
BEYOND_LATIN = re.compile(r"[^\x00-\xff]")
#: Pieces of which a process keeps the ids, bytes of texts encoded together, bytes of text aimed at in a file.
KNOWN, AT_ONCE, FILE_BYTES = 400_000, 4 << 20, 128 << 20


class Encoder:
    """Ids of whole texts by way of the pieces between white space; a piece is encoded by the tokenizers library when it is new.

    Texts are split and their pieces numbered by Arrow, so Python sees each distinct piece of a batch once. What is known of a piece is a
    row: where its ids stand in one array, how many they are, and in how many batches it came up. Over KNOWN rows, only pieces that came
    up again are kept.
    """

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        pieces = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(pieces.values()) + 1, bool)  # ids that end a word
        for piece, i in pieces.items():
            self.ends[i] = piece.endswith("</w>")
        self.rows: dict[str, int] = {"": 0}
        self.start, self.size, self.hits = np.zeros(1, np.int64), np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.ids = np.empty(0, self.kind)

    def _gather(self, rows):
        """The ids of the rows, one after the other, and how many each has."""
        import numpy as np

        size = self.size[rows]
        last = np.cumsum(size)
        total = int(last[-1]) if len(last) else 0
        kind = np.int32 if max(total, len(self.ids)) < 1 << 31 else np.int64
        at = np.repeat((self.start[rows] - (last - size)).astype(kind), size)
        at += np.arange(total, dtype=kind)
        return self.ids[at], size

    def _add(self, pieces: list[str], ids, size) -> None:
        import numpy as np

        n = len(self.rows)
        self.rows.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.hits = np.concatenate([self.hits, np.zeros(len(size), np.int32)])
        self.ids = np.concatenate([self.ids, ids])

    def _words(self, words: list[str]) -> None:
        """Encode runs of letters, many at a time: each is one word of the tokenizer, so it ends where an end-of-word id stands."""
        import numpy as np

        got, sizes, have, rest = [], [], [], []
        for i in range(0, len(words), 500):
            some = words[i : i + 500]
            (out,) = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(out.ids, self.kind)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some):
                got.append(ids)
                sizes.append(np.diff(cut, prepend=0))
                have += some
            else:
                rest += some
        if have:
            self._add(have, np.concatenate(got), np.concatenate(sizes))
        self._each(rest)

    def _each(self, pieces: list[str]) -> None:
        import numpy as np

        if pieces:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            flat = np.fromiter(chain.from_iterable(ids), self.kind)
            self._add(pieces, flat, np.fromiter(map(len, ids), np.int64, len(ids)))

    def _learn(self, pieces: list[str]) -> None:
        """Add rows for pieces without one; a word with marks behind it is put together from both."""
        import numpy as np

        known = self.rows
        bare = [p.rstrip(MARKS) for p in pieces]
        worded = [q.isalpha() and (q.isascii() or not BEYOND_LATIN.search(q)) for q in bare]
        self._words(list({q for q, w in zip(bare, worded, strict=True) if w and q not in known}))
        both = [(p, q, p[len(q) :]) for p, q, w in zip(pieces, bare, worded, strict=True) if w and p is not q and p not in known]
        self._each(list({t for *_, t in both if t not in known} | {p for p, w in zip(pieces, worded, strict=True) if not w and p not in known}))
        if both:
            two = np.array([(known[q], known[t]) for _, q, t in both])
            ids, size = self._gather(two.ravel())
            self._add([p for p, *_ in both], ids, size.reshape(-1, 2).sum(1))

    def _forget(self) -> None:
        """Keep the rows that came up in two batches at least, the most frequent half of KNOWN at most."""
        import numpy as np

        least = max(2, int(np.partition(self.hits, -KNOWN // 2)[-KNOWN // 2]))
        kept = np.flatnonzero(self.hits >= least)[: KNOWN // 2]
        names, old = list(self.rows), self.hits
        ids, size = self._gather(kept)
        kept_names = [names[i] for i in kept.tolist()]
        self.rows = {"": 0}
        self.start, self.size, self.hits = np.zeros(1, np.int64), np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.ids = np.empty(0, self.kind)
        full = kept != 0  # row 0 is the empty piece, which stays first
        self._add([x for x in kept_names if x], ids, size[full])
        self.hits[1:] = old[kept[full]] // 2

    def __call__(self, texts):
        """Ids of an Arrow array of texts, one text after the other, and how many each has; null is empty."""
        import numpy as np
        import pyarrow.compute as pc

        if len(self.rows) > KNOWN:
            self._forget()
        texts = pc.fill_null(texts, "")
        small = pc.ascii_lower(texts)
        # lowering could make a special token of a text that has none; the tokenizer lowers the rest itself
        marked = pc.match_substring(small, "<|")
        if pc.any(marked).as_py():
            small = pc.if_else(marked, texts, small)
        split = pc.ascii_split_whitespace(small)
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        rows = np.fromiter(map(self.rows.get, pieces, repeat(-1)), np.int32, len(pieces))
        if len(new := np.flatnonzero(rows < 0)):
            fresh = [pieces[i] for i in new.tolist()]
            self._learn(fresh)
            rows[new] = np.fromiter(map(self.rows.__getitem__, fresh), np.int32, len(fresh))
        self.hits[rows] += 1
        ids, size = self._gather(rows[coded.indices.to_numpy()])
        last = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(last[split.offsets.to_numpy() - split.offsets[0].as_py()])


def _open(path: str, mode: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    if mode == "w":
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(at)
    return store.open_input_file(at)


def _pieces(batch, column: int):
    """A batch cut at rows so that each piece holds about AT_ONCE bytes of that column (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // AT_ONCE
    cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def _write(batches, folder, vocabulary, length, end):
    import os

    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoders = KEPT.setdefault(__name__, {})  # the tasks of one worker share what they have learned
    encode = encoders[vocabulary] = encoders.get(vocabulary) or Encoder(vocabulary)
    kind = encode.kind
    part = TaskContext.get().partitionId()
    name = f"{folder}/{part:06d}-{uuid.uuid4().hex}"
    ids_type, mask_type = pa.list_(pa.from_numpy_dtype(kind), length), pa.list_(pa.bool_(), length)
    schema = pa.schema([("input_ids", ids_type), ("mask", mask_type)])
    index = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("count", pa.int64())])
    files: list = []
    rest, total = np.empty(0, kind), 0

    def put(flat, mask):
        files[1].write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(flat), type=ids_type), pa.FixedSizeListArray.from_arrays(pa.array(mask), type=mask_type)], schema=schema))

    for b in batches:
        if not b.num_rows:
            continue
        if not files:
            sinks = [_open(f"{name}.arrow", "w"), _open(f"{name}.index.arrow", "w")]
            files = [sinks, pa.ipc.new_file(sinks[0], schema), pa.ipc.new_file(sinks[1], index)]
        for cut in _pieces(b, 1):
            ids, sizes = encode(cut.column(1))
            counts = sizes + 1
            ends = np.cumsum(counts) - 1
            flat = np.full(len(ids) + len(sizes), end, kind)
            body = np.ones(len(flat), bool)
            body[ends] = False
            flat[body] = ids
            first = total + ends + 1 - counts
            files[2].write_batch(pa.record_batch([cut.column(0).cast(pa.int64()), pa.array(first), pa.array(counts)], schema=index))
            total += len(flat)
            rest = np.concatenate([rest, flat])
            while len(rest) >= length * BATCH:
                put(rest[: length * BATCH], np.ones(length * BATCH, bool))
                rest = rest[length * BATCH :]
            release(cycles=False)  # what a piece needed is many times its text
    if files:
        if len(rest):
            rows = -(-len(rest) // length)
            mask = np.arange(rows * length) < len(rest)
            flat = np.zeros(rows * length, kind)
            flat[: len(rest)] = rest
            put(flat, mask)
        files[1].close()
        files[2].close()
        for s in files[0]:
            s.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([total], pa.int64())], ["part", "name", "n_ids"])


def write(docs: DataFrame, folder: str, vocabulary: str, partitions: int, length: int = LENGTH, end: int = END) -> list[tuple[int, str, int]]:
    """Write the files; returns (part, name, number of ids) of each, one short row a file, in order.

    Rows are dealt by id, then by a hash of the text, then by place, so that no id (or null) has to fit one task, however many rows have it.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    src = src.withColumn("h", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("place")]
    ordered = src.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("doc_id", "text")
    done = ordered.mapInArrow(tidied(_write, folder=folder, vocabulary=vocabulary, length=length, end=end), "part long, name string, n_ids long")
    with batches(docs.sparkSession):
        return sorted(tuple(r) for r in done.collect())


def _read(batches):
    import zlib

    import numpy as np
    import pyarrow as pa

    for b in batches:
        for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            with _open(f"{name}.arrow", "r") as f, _open(f"{name}.index.arrow", "r") as g:
                tokens, index = pa.ipc.open_file(f), pa.ipc.open_file(g)
                length = tokens.schema.field("input_ids").type.list_size
                have, k, begin = np.empty(0, np.uint32), 0, 0  # ids from position begin on
                for i in range(index.num_record_batches):
                    part = index.get_batch(i)
                    crc = []
                    for first, count in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                        while begin + len(have) < first + count:
                            got = tokens.get_batch(k)
                            flat = got.column(0).flatten().to_numpy()[got.column(1).flatten().to_numpy(zero_copy_only=False)]
                            have = np.concatenate([have[first - begin :], flat]) if first > begin else np.concatenate([have, flat])
                            begin, k = max(begin, first), k + 1
                        crc.append(zlib.crc32(have[first - begin : first - begin + count].astype("<u4").tobytes()))
                    start = np.asarray(part.column(1)) + base
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(start, pa.int64()), part.column(2), pa.array(crc, pa.int64()), pa.array([name] * len(crc)), pa.array([length] * len(crc), pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "file", "row_length"])


def read(spark: SparkSession, files: list[tuple[int, str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file, row_length of every document, from the files alone."""
    base, rows = 0, []
    for _, name, n in files:
        rows.append((name, base))
        base += n
    names = spark.createDataFrame(rows, "name string, base long")
    return names.repartition(max(1, len(rows))).mapInArrow(tidied(_read), "doc_id long, start long, n_tokens long, ids_crc32 long, file string, row_length int")


def store(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write docs in the shared folder and describe them from the files."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    return read(spark, write(docs, new_path(spark, "tokens"), vocabulary, partitions))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32", "row_length")
