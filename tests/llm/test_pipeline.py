import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contractlens.llm import decontam, mixing, sharding


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rnd = random.Random(6)
    d = str(tmp_path_factory.mktemp("data"))
    text = lambda n: " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))
    item = [text(20), text(30)]
    rows, toxic = [], []
    for i in range(240):
        t = text(rnd.randrange(20, 80))
        if i % 6 == 0:
            t, y = t + " idiot trash moron", 1
        else:
            y = 0
        toxic.append((i, 1, y))
        rows.append((i, t, "en", f"s{i % 4}" if i % 9 else None, len(t)))
    rows += [(300 + i, rows[1][1], "en", "s1", 1) for i in range(3)]
    rows += [(400, item[0] + " " + item[1], "en", "s0", 1), (401, text(40) + " " + item[0], "en", "s0", 1), (500, None, None, None, None), (501, "", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(item)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, dict((i, y) for i, _, y in toxic)


def test_stages(spark, data):
    d, rows, toxic = data
    docs = spark.read.parquet(f"{d}/documents.parquet")
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, d), "t")
        steps.append(docs)
    ids = [[r.doc_id for r in s.select("doc_id").collect()] for s in steps]
    assert set(ids[0]) == {r[0] for r in rows if not toxic.get(r[0])}
    assert sorted(ids[1]) == sorted(set(ids[0]) - {300, 301, 302})
    assert sorted(ids[2]) == sorted(set(ids[1]) - {400, 401})
    assert set(ids[3]) <= set(ids[2]) and all(ids[3].count(i) <= 2 for i in ids[3])
    assert sorted(ids[4]) == sorted(ids[3])
    want = steps[2].count()
    assert mixing.mix(steps[2]).count() == want


def test_clean_drops_whole_windows_and_keeps_everyday_phrases(spark):
    rnd = random.Random(8)
    items = [(1, "u0 u1 u2 u3 u4 u5 u6 u7 u8"), (2, "thank you"), (3, "good morning"), (4, "v0 v1 v2 v3 v4 v5 v6 v7")]
    texts = {0: "x y z", 1: "x u1 u2 u3 u4 u5 u6 u7 u8 y", 2: "u0 u1 u2 u3 u4 u5 u6", 3: "Thank you all " * 9, 4: "thank YOU; good morning", 5: "v0 v1 v2 v3 x v4 v5 v6 v7", 6: None, 7: "V0,v1 v2 v3 v4 v5 v6 v7", 8: ""}
    rows = [(i, t, rnd.random(), i + 1, i + 2, True) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad1 double, k1 long, k2 long, whole boolean")
    out = decontam.clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == docs.columns
    assert sorted(out.collect()) == sorted(r for r in docs.collect() if r.doc_id not in (1, 4, 7))


def test_mix_against_python(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(["w"] * rnd.randrange(0, 60)) if i % 11 else None, rnd.choice(["a", "b", "c", "d", None]) if i > 5 else "z") for i in range(400)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    size = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.discard(s)
    for i, t, s in rows:
        assert got[i].mix_target == pytest.approx(target[s]) and got[i].mix_source_size == size[s] and got[i].mix_copies <= 2
    for s in order:
        taken = sum(got[i].mix_size * got[i].mix_copies for i, _, x in rows if x == s)
        assert abs(taken - target[s]) <= 0.25 * size[s] + 60


def test_shards_fit_and_split_only_where_needed(spark):
    rows = [(i, "x" * (i % 300)) for i in range(600)] + [(9, "y" * 5000), (9, "z" * 100), (None, None)] + [(77, "same" * 50)] * 90 + [(None, f"null {i} " * 20) for i in range(70)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, try int, shard_bytes int, n_bytes_here int").repartition(4)
    out = sharding.shard(df, limit=4000)
    assert out.columns == ["doc_id", "text", "try", "n_bytes_here", *sharding.ADDED[:0], "shard_bits", "shard_prefix", "shard_bytes", "shard_piece"]
    out = out.collect()
    assert sorted((str(r.doc_id), r.text) for r in out if r.text) == sorted((str(i), t) for i, t in rows if t) and len(out) == len(rows)
    by, pieces = {}, {}
    for r in out:
        by.setdefault((r.shard_bits, r.shard_prefix), []).append(r)
        pieces.setdefault((r.shard_bits, r.shard_prefix, r.shard_piece), []).append(r)
    for (bits, _, piece), rs in pieces.items():
        total = sum(len(r.text or "") for r in rs)
        assert {r.shard_bytes for r in rs} == {total} and (total <= 4000 or sum(bool(r.text) for r in rs) == 1) and (piece == 0 or bits == 30)
    for (bits, prefix), rs in by.items():
        total = sum(len(r.text or "") for r in rs)
        if bits:
            sibling = sum(sum(len(r.text or "") for r in x) for (b, p), x in by.items() if b >= bits and p >> (b - bits) == prefix ^ 1)
            assert total + sibling > 4000
    assert sharding.shard(df.limit(0)).count() == 0


def test_mix_with_many_sources_equals_mix_in_one_task(spark):
    rnd = random.Random(12)
    names = [f"s{i}" for i in range(60)] + [None, "É", "z"]
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 3, 200])) if i % 17 else None, rnd.choice(names), "a", 1.0) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copies string, mix_rate double")
    one, many = (sorted(map(str, mixing.mix(df, one_task=n).collect())) for n in (10**6, 0))
    assert one == many and len(one) == len(rows)
    out = mixing.emit(df)
    assert out.columns == df.columns and {r.mix_copies for r in out.collect()} == {"a"}
    assert mixing.mix(df.limit(0)).count() == mixing.mix(df.limit(0), one_task=0).count() == 0
    assert mixing.mix(df.withColumn("doc_id", F.lit(None).cast("long"))).count() == len(rows)


def test_decontaminate_odd_rows(spark):
    docs = spark.createDataFrame([(1, "A b, c D e f g h i"), (2, None), (None, "q r"), (4, "x q R y q r"), (4, "x q R y q r")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "Q r"), (3, ""), (4, None), (None, "b c d e f g h i")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.decontaminate(docs, items).collect())
    assert got == [("1", 9, 9, 2, True), ("2", 0, 0, 0, False), ("4", 6, 4, 1, False), ("4", 6, 4, 1, False), ("None", 2, 2, 1, False)]
    assert decontam.decontaminate(docs.limit(0), items).count() == 0
    assert {r.n_items for r in decontam.decontaminate(docs, items.limit(0)).collect()} == {0}
