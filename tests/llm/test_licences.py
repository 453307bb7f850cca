import itertools
import random

from contractlens.llm import licences


def test_increasing_matches_all_subsets():
    rnd = random.Random(1)
    for _ in range(200):
        v = rnd.sample(range(20), rnd.randrange(9))
        best = max((len(c) for n in range(len(v) + 1) for c in itertools.combinations(v, n) if list(c) == sorted(set(c))), default=0)
        got = [v[i] for i in licences.increasing(v)]
        assert got == sorted(set(got)) and len(got) == best


def test_finds_edited_and_repeated_texts():
    models = {n: licences.split(t) for n, t in licences.TEMPLATES.items()}
    mit = licences.TEMPLATES["mit"]
    edited = mit.replace("charge", "cost").replace("any person", "anyone")
    text = f"Some words first. {edited}\nfiller in between of the text here\nAll rights reserved.\n" + "x y z " * 20 + "All rights reserved."
    got = [(f[0], round(f[3], 1)) for f in licences.find(text, models)]
    assert got == [("mit", 1.0), ("reserved-notice", 1.0), ("reserved-notice", 1.0)], got
    assert licences.find("the rights of all are of the software and to the", models) == []


def test_rows(spark):
    df = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0."), (None, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id: [f.licence for f in r.found] for r in licences.scan(df).collect()} == {1: ["cc-by-nc-4.0-notice"], None: [], 3: []}


def test_whole_published_texts_are_known():
    models = {n: licences.split(t) for n, t in licences.TEMPLATES.items()}
    for name in ("apache-2.0", "bsd-2-clause", "bsd-3-clause", "mpl-2.0", "gpl-3.0", "lgpl-2.1", "unlicense", "mit", "isc", "gpl-header"):
        got = {f[0]: f[3] for f in licences.find("Some words first.\n" + licences.TEMPLATES[name] + "\nand words after", models)}
        assert got.get(name) == 1.0, (name, got)
    half = licences.TEMPLATES["mit"].split("THE SOFTWARE IS PROVIDED")[0]
    assert "mit" not in {f[0] for f in licences.find(half, models)}


def test_notices_in_long_stretches_are_found_whole():
    models = {"mit": licences.split(licences.TEMPLATES["mit"])}
    mit, rnd = models["mit"], random.Random(5)
    prose = lambda n: [rnd.choice("the of to any and in or a software copies this is rights without".split()) for _ in range(n)]
    for at in range(0, 400, 13):
        assert licences.find(" ".join(prose(at) + mit + prose(300)), models) == [("mit", at, at + len(mit), 1.0)]
    assert licences.find(" ".join(prose(50) + mit * 3), models) == [("mit", 50 + k * len(mit), 50 + (k + 1) * len(mit), 1.0) for k in range(3)]
    parted = mit[:60] + ["inserted"] * 7 + mit[60:]
    assert licences.find(" ".join(parted), models) == [("mit", 0, len(parted), 1.0)]
