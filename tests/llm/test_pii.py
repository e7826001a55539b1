import hashlib
import re

from loomspark.llm import pii

from .odd import odd, texts

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in hit.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def spans_by_hand(text):
    out = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p) in enumerate(BASE) for m in re.finditer(p, text or "") if holds(kind, m[0])]
    return [s for _, _, s in sorted(out)]


TRICKY = [
    "a@b.c_x@y.zz", "a@b.cc@d.ee", "x..y@z.q. .a@b", "@b.c a@b a@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.0000255", "4111-1111 1111-1111  4111 1111 1111 1111", "+1 (555) 123-4567. +12 +1234567890123456 +49 30 123456789-", "4111111111111111" * 3,
    "5500005555555559 and 5500005555555558", "é😀 10.0.0.1 漢 a@b.co", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "9" * 5000 + " " + "1 " * 4000, "a@" + "b." * 5000 + "c", "." * 3000 + "@x.y", "+1" + "-" * 2000 + "2345678901",
]


def test_base_spans_against_brute_force(spark, monkeypatch):
    df = odd(spark, [(100 + k, t) for k, t in enumerate(TRICKY)])
    monkeypatch.setattr(pii, "table", lambda *a: df)
    want = {}
    for i, t in texts(df):
        want.setdefault(i, []).append(hashlib.sha256(",".join(spans_by_hand(t)).encode()).hexdigest())
    got = pii.op9_pii(spark, "").collect()
    assert len(got) == df.count()
    for r in got:
        assert r.base_sha256 in want[r.doc_id], r.doc_id
    monkeypatch.setattr(pii, "table", lambda *a: df.limit(0))
    assert pii.op9_pii(spark, "").count() == 0


def test_patterns_find_what_the_base_misses(spark):
    rows = [(k, f"please call phone number +1 (555) 000-{1000 + k} today") for k in range(8)] + [(50, "please call phone number 555-019-9999x today"), (51, "we counted number 1234567 of them")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert [(s.found, pii.KINDS[s.k]) for s in got[50]] == [("555-019-9999x", "phone")] and got[51] == []
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert masked[50] == "please call phone number [PHONE] today" and masked[51] == rows[-1][1] and masked[3] == "please call phone number [PHONE] today"


def test_each_kind_is_discovered_by_its_own_shape(spark):
    cards = ["4111 1111 1111 1111", "5500005555555559", "4012 8888 8888 1881", "4222222222222220", "6011 1111 1111 1117"]
    cards = [c for c in cards if holds("card", c)]
    seeds = {
        "email": ("please write mailbox", [f"user{k}@site{k}.example" for k in range(8)]), "ip": ("reach the server", [f"10.0.{k}.7" for k in range(8)]),
        "card": ("charged my card", cards), "phone": ("ring telephone number", [f"+1 (555) 000-{1000 + k}" for k in range(8)]),
    }
    missed = {"email": ["root@localhost", "zoë@site.example"], "ip": ["fe80::1", "300.1.2.3"], "card": ["4111-1111-11"], "phone": ["555-019-9999x"]}
    plain = {"email": "at@", "ip": "12.5", "card": "12345", "phone": "1234"}
    rows, want = [], {}
    for kind, (lead, found) in seeds.items():
        rows += [(len(rows) + k, f"{lead} {x} today") for k, x in enumerate(found)]
        for x in missed[kind]:
            want[len(rows)] = (x, kind)
            rows.append((len(rows), f"{lead} {x} today"))
        want[len(rows)] = None
        rows.append((len(rows), f"{lead} {plain[kind]} today"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.found, pii.KINDS[s.k]) for s in r.spans] for r in pii.find(df).collect()}
    for d, x in want.items():
        assert got[d] == ([x] if x else []), rows[d]


def test_secrets_come_of_patterns_that_seeds_induce(spark):
    hexes = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(12)]
    rows = [(k, f'the key is token = "{h}" here') for k, h in enumerate(hexes[:6])] + [(k, f"commit: {h} was made") for k, h in enumerate(hexes[6:11], 10)]
    rows += [(20, "set token = x9-not-hex-but-long-1 now"), (21, f"lone {hexes[11]} word"), (22, 'token="another-1-secret-value"'), (23, "token = 12 only"), (24, f"seen again as {hexes[0]}")]
    got = {r.doc_id: [(s.found, pii.ALL_KINDS[s.k], s.start, s.stop) for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, h in enumerate(hexes[:6]):
        assert got[k] == [(h, "secret", 20, 60)]
    assert got[20] == [("x9-not-hex-but-long-1", "secret", 12, 33)] and got[22] == [("another-1-secret-value", "secret", 7, 29)] and got[24] == [(hexes[0], "secret", 14, 54)]
    assert not got[21] and not got[23] and not any(got[k] for k in range(10, 15))


def graph_by_hand(links):
    """The rounds over (pattern, found, seed) in plain Python."""
    seeds = {}
    for p, f, k in links:
        if k is not None:
            seeds.setdefault((p, k), set()).add(f)
    kinds = {(p, k): [(f, s) for q, f, s in links if q == p] for (p, k), found in seeds.items() if len(found) >= pii.LEAST_SEEDS}
    score = None
    for _ in range(pii.ROUNDS):
        sure = {}
        for (p, k), found in kinds.items():
            judged = [(1.0 if s == k else (score or {}).get((f, k), 0.0) if s is None else 0.0) for f, s in found if score is not None or s is not None]
            sure[p, k] = sum(judged) / (len(judged) + pii.SUPPORT)
        fresh, best = {}, {}
        for (p, k), found in kinds.items():
            for f, s in found:
                if s is None:
                    fresh[f, k] = fresh.get((f, k), 1.0) * (1 - min(sure[p, k], 0.999999))
                    best[f, k] = max(best.get((f, k), 0.0), sure[p, k])
        score = {x: 1 - y for x, y in fresh.items()}
    return {x: y for x, y in score.items() if best[x] >= pii.CONFIDENCE and y >= pii.MIN_SCORE}


def test_the_graph_against_plain_rounds(spark):
    links = [(f"before p{j}", f"{j}-{i}-555-000-{1000 + i}", 3) for j in range(3) for i in range(6 + j)]
    links += [(f"before p{j}", f"new-{i}-{100000 + i}", None) for j in range(3) for i in range(1 + j)] + [("before p0", f"w{i}-1234567", None) for i in range(30)] + [("before q", "1234567", None), ("before p1", "no1", None)]
    links += [("before p2", f"10.0.0.{i}", 1) for i in range(2)]
    edges = spark.createDataFrame([(0, 0, 1, f, p, k) for p, f, k in links], "row long, start int, stop int, found string, pattern string, k int")
    got = {(r.found, r.k): round(r.score, 9) for r in pii.bootstrap(edges).collect()}
    want = {(f, k): round(y, 9) for (f, k), y in graph_by_hand(links).items() if sum(c.isdigit() for c in f) >= pii.LEAST_DIGITS}
    assert got == want and got


def test_masking(spark):
    df = odd(spark)
    out = pii.mask(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert [r.text for r in out.where("doc_id = 10").collect()] == ["[EMAIL] and [PHONE], then [CARD]; [IP]"]
    assert [r.n_chars for r in out.where("doc_id = 10").collect()] == [38]


def test_no_python_in_the_plan(spark):
    plan = pii.op9_pii(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
