"""Every operator on nulls, empty and very long texts, repeated rows, empty tables, and extra columns called like its own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contractlens.llm import decontam, licences, minhash, mixing, pii, sharding, substrings, tokenfiles, toxicity

CLASH = "k1 k2 h b n u v x y w s e rep comp band bands parity score found row try place pos win word words at first count total spans kept start n_tokens mix_copies mix_rate shard_bytes shard_bits bad1 whole title id label o t f rate size node".split()
LONG = "lorem ipsum dolor sit amet " * 40_000 + "All rights reserved. write to a.b@c.org now"
TEXTS = [(1, "u0 u1 u2 u3 u4 u5 u6 u7 u8 end"), (1, "u0 u1 u2 u3 u4 u5 u6 u7 u8 end"), (2, None), (None, "a b c d e f g"), (None, None), (3, ""), (4, " \n\t "), (5, LONG), (6, LONG), (7, "é" * 250 + "日本語 テスト"), (7, "other text")]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, t, "en" if i else None, "s1" if i and i > 2 else None, None) for i, t in TEXTS]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, n_chars long").repartition(3)
    docs = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])
    labels = spark.createDataFrame([(1, None, 1), (3, 1, 0), (None, 1, 1), (5, 0, None), (3, 1, 0)], "doc_id int, quality int, toxic int")
    items = spark.createDataFrame([(1, "u0 u1 u2 u3 u4 u5 u6 u7 u8"), (2, None), (None, ""), (2, "sit amet lorem ipsum dolor sit amet lorem ipsum")], "item_id int, text string")
    return docs, labels, items


OPERATORS = {
    "score": lambda d, lab, it: toxicity.score(d, lab),
    "reject": lambda d, lab, it: toxicity.reject(d, lab),
    "pii": lambda d, lab, it: pii.scan(d),
    "shard": lambda d, lab, it: sharding.shard(d, limit=600),
    "decontaminate": lambda d, lab, it: decontam.decontaminate(d, it),
    "tokens": lambda d, lab, it: tokenfiles.store(d.sparkSession, d),
    "substrings": lambda d, lab, it: substrings.remove_repeats(d),
    "minhash": lambda d, lab, it: minhash.near_duplicates(d),
    "licences": lambda d, lab, it: licences.scan(d),
    "mix": lambda d, lab, it: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_whatever_the_rows(tables, name):
    out = OPERATORS[name](*tables).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(tables, name):
    docs, labels, items = tables
    assert OPERATORS[name](docs.limit(0), labels, items).count() == 0
    assert OPERATORS[name](docs.limit(0), labels.limit(0), items.limit(0)).count() == 0


def test_what_long_and_repeated_rows_get(tables):
    docs, labels, items = tables
    by = lambda df: {r.doc_id: r for r in df.collect()}
    assert {(r.component_id, r.kept) for r in minhash.near_duplicates(docs).where("doc_id in (5, 6)").collect()} == {(5, True), (5, False)}
    assert by(decontam.decontaminate(docs, items))[5].n_hit > 190_000
    cut = by(substrings.remove_repeats(docs))
    assert cut[5].n_removed == cut[5].n_bytes == len(LONG) and cut[3].n_bytes == 0 and cut[7].n_bytes > 0
    assert [f.licence for f in by(licences.scan(docs))[6].found] == ["reserved-notice"] and [s.kind for s in by(pii.scan(docs))[6].found] == ["email"]


@pytest.mark.parametrize("carry", [lambda d, lab, it: toxicity.reject(d, lab), lambda d, lab, it: decontam.clean(d, it), lambda d, lab, it: mixing.emit(d)])
def test_carried_columns_come_through(tables, carry):
    docs = tables[0]
    out = carry(*tables)
    assert out.columns == docs.columns and {r.shard_bytes for r in out.collect()} <= {"own shard_bytes"}


def test_pipeline_on_empty_tables(spark, tables, tmp_path):
    docs, labels, items = tables
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, df in (("documents", plain.limit(0)), ("labels", labels.limit(0)), ("benchmark", items.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_alignment_finds_what_comparing_every_window_finds():
    import random

    rnd = random.Random(21)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(60):
        model = [f"m{i}" for i in range(20)]
        text = [f"x{rnd.randrange(50)}" for _ in range(rnd.randrange(10, 40))]
        for _ in range(rnd.choice([0, 1, 1, 2])):
            edited = [w if rnd.random() > 0.12 else rnd.choice(["zz", None]) for w in model]
            at = rnd.randrange(len(text))
            text[at:at] = [w for w in edited if w]
        found = licences.find(" ".join(text), {"m": model})
        best = max((common(text[a : a + 24], model) / 20, -a) for a in range(len(text)))
        assert bool(found) == (best[0] >= 0.8), (text, found, best)
        if found:
            assert max(f[3] for f in found) >= best[0] - 0.051


def test_alignment_takes_time_in_proportion():
    import time

    models = {n: licences.split(t) for n, t in licences.TEMPLATES.items()}
    index, took = licences.indexed(models), []
    for n in (2_000, 8_000):
        began = time.process_time()
        assert len(licences.find("All rights reserved. " * n, models, index=index)) == n
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]
