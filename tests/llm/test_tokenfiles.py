import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from contractlens.llm import tokenfiles

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_encode_like_whole_texts():
    rnd, t, e = random.Random(1), Tokenizer.from_file(PATH), tokenfiles.Encoder(PATH)
    bits = ["a", "É", "é", " ́", " ", " ", "\n", "\t", "'s", "don't", "12", "<|endoftext|>", "<|", "ΑΣ", "日本", "\x0b", "\x85", "!?", "퟿", "İ", "ß", "Ünï", "ÀB", ",", ".", "...", "÷", "ªb", "‍", "　"]
    for _ in range(3000):
        s = "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))
        ids, counts = e(pa.array([s, None]))
        assert ids.tolist() == t.encode(s, add_special_tokens=False).ids and counts.tolist() == [len(ids), 0], repr(s)


def test_forgotten_pieces_encode_alike(monkeypatch):
    monkeypatch.setattr(tokenfiles, "KNOWN", 60)
    rnd, t, e = random.Random(4), Tokenizer.from_file(PATH), tokenfiles.Encoder(PATH)
    for _ in range(40):
        texts = ["the <|ENDOFTEXT|> The, " + " ".join(rnd.choice("abcdefg") * rnd.randrange(1, 6) + rnd.choice(["", ",", "!?"]) for _ in range(30)) for _ in range(3)]
        ids, counts = e(pa.array(texts))
        ends = np.cumsum(counts)
        assert [ids[a:b].tolist() for a, b in zip(ends - counts, ends, strict=True)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
        assert len(e.rows) == len(e.start) == len(e.size) == len(e.hits)


def test_null_and_repeated_ids(spark):
    rnd, t = random.Random(3), Tokenizer.from_file(PATH)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"w{i % 40} beta" if i % 5 else None) for i in range(400)]
    out = tokenfiles.store(spark, spark.createDataFrame(rows, "doc_id int, text string").repartition(5)).collect()
    want = [len(t.encode(s or "", add_special_tokens=False).ids) + 1 for _, s in rows]
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out) == sorted((i is not None, i or 0) for i, _ in rows)
    by = sorted(out, key=lambda r: r.start)
    assert [r.start for r in by] == [sum(x.n_tokens for x in by[:k]) for k in range(len(by))] and sum(r.n_tokens for r in out) == sum(want)
    assert [r.doc_id is not None for r in by] == sorted(r.doc_id is not None for r in by)
    ids = [r.doc_id for r in by if r.doc_id is not None]
    assert ids == sorted(ids)


def test_round_trip(spark):
    rnd, t = random.Random(2), Tokenizer.from_file(PATH)
    rows = [(i * 7 % 101, " ".join(rnd.choice(["alpha", "beta", "Ünï", "x#2"]) for _ in range(rnd.choice([0, 3, 900])))) for i in range(101)] + [(500, None), (501, "")]
    df = spark.createDataFrame([(i, s, 1) for i, s in rows], "doc_id long, text string, start int").repartition(6)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.store(spark, df).collect()}
    start, want = 0, {}
    for i, s in sorted(rows):
        ids = [*t.encode(s or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)
    assert got == want
    assert tokenfiles.store(spark, df.limit(0)).count() == 0
