import hashlib
import random
import re

from contractlens.llm import pii


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_match_the_patterns():
    rnd = random.Random(3)
    for _ in range(4000):
        t = "".join(rnd.choice(["a", "B", "é", "@", ".", "-", "+", "1", "4", "25", " ", "(", ")", "x.y", "4111 1111 1111 1111", "10.0.0.255", "٣"]) for _ in range(rnd.randrange(30)))
        assert pii.base_spans(t) == plain(t), t


def test_added_kinds_and_rows(spark):
    rows = [(1, "bank account GB82 WEST 1234 5698 7654 32 end"), (2, None), (2, ""), (None, "ssn 123-45-6789 a@b.co"), (4, "GB82 WEST 1234 5698 7654 33")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [("iban", 13, 40)], 2: [], None: [("email", 16, 22), ("ssn", 4, 15)], 4: []}


def contract_row(text):
    """n_email, n_ip, n_card, n_phone and base_sha256 by the plain patterns."""
    text = text or ""
    digits = lambda x: [int(c) for c in x if c in "0123456789"]

    def luhn(x):
        d = digits(x)[::-1]
        return sum(d[::2] + [sum(divmod(2 * v, 10)) for v in d[1::2]]) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(digits(x)) <= 19 and luhn(x)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    }
    found = {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in kinds.items()}
    said = ",".join(f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans)
    return (*[len(x) for x in found.values()], hashlib.sha256(said.encode()).hexdigest())


def test_registered_query_against_plain_patterns(spark, tmp_path):
    rnd = random.Random(7)
    bits = ["a@b.c", "x.y+z@mail-1.example.org", "@", "1.2.3.4", "256.1.1.1", "01.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+44 20 7946 0958", "+1 (555) 010-9999", "+1", " ", ".", "-", "é", "日本", "\U0001f600", "DE89 3704 0044 0532 0130 00", "078-05-1120", "ssn", "card", "9" * 25, "\n", "test", "version", ","]
    rows = [(i, "".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.randrange(14))), 1, "x") for i in range(600)]
    rows += [(None, "a@b.c", 1, "x"), (601, None, None, None), (602, "", 1, "x"), (602, "a@b.c", 1, "x"), (603, "word " * 60_000 + "1.2.3.4", 1, "x")]
    spark.createDataFrame(rows, "doc_id int, text string, n_email int, spans string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = pii.op3_pii(spark, str(tmp_path)).collect()
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out)
    assert got == sorted((str(i), *contract_row(t)) for i, t, *_ in rows)
    by = {r.doc_id: r for r in out}
    for i, t, *_ in rows[:600]:
        spans = [x.split(":") for x in by[i].spans.split(",") if x]
        base = ",".join(":".join(x) for x in spans if x[0] in pii.BASE)
        assert hashlib.sha256(base.encode()).hexdigest() == by[i].base_sha256
        for kind, a, b in spans:
            assert kind in pii.BASE or (kind == "iban" and pii.mod97(t[int(a) : int(b)].replace(" ", ""))) or kind == "ssn"
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert pii.op3_pii(spark, f"{tmp_path}/empty").count() == 0
