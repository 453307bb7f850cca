import random

from contractlens.llm import minhash


def brute(rows):
    """doc_id -> (size, component) by comparing all pairs of shingle sets."""
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).encode().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    lo, hi = sorted((comp[a], comp[b]))
                    comp = {k: lo if v == hi else v for k, v in comp.items()}
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_matches_all_pairs(spark):
    rnd = random.Random(5)
    rows, base = [], [[f"w{rnd.randrange(900)}" for _ in range(n)] for n in (3, 5, 9, 40, 80, 200)]
    for i in range(90):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(9999)}"
        rows.append((i * 3 % 97, " ".join(w).upper() if i % 7 == 0 else "\t".join(w)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "É é")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, comp string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_repeated_null_and_empty(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("None", None, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
