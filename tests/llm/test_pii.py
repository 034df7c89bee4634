import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from inkloom.llm import pii

CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    spans = [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(CONTRACT[k], text or "") if good(k, m.group())]
    return [sum(k == kind for k, _, _ in spans) for kind in pii.KINDS], ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def texts():
    rng = random.Random(4)
    pools = ["ab.@-%+_ ", "01.25 ", "0123 -", "+12 (). -", "a@b.c é\n😀1-.+", "4111-2 ."]
    made = ["".join(rng.choice(p) for _ in range(rng.randrange(60))) for p in pools for _ in range(150)]
    known = [
        "write to a.b@c-d.example.com. or x@y", "a@b.c%d@e.f", "a@b@c.d", "a@b..c d@e.f.", "..@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.255",
        "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 41111111111111111111", "4111  1111 1111 1111", "+1 (389) 555-5010 Les", "+1 2+3 44 5555 66 ",
        "é😀 mail@x.yz", "", None, "1" * 30_000, "a.b" * 20_000 + "@x.y" + ".z" * 20_000, "+1" + "(" * 30_000,
    ]
    return [*known, *made]


def test_base_spans_match_the_contract(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.found(docs, pii.Model()).select("doc_id", pii.rendered(F.col("spans")).alias("s"), *(pii.count_of("base", k).alias(k) for k in pii.KINDS))
    got = {r.doc_id: r for r in out.collect()}
    for i, text in rows:
        counts, spans = brute(text)
        assert got[i].s == spans, text
        assert [got[i][k] for k in pii.KINDS] == counts


def plain_kind(v):
    digits = re.sub("[^0-9]", "", v)
    if re.search(pii.GAZETTEER["secret"], v):
        return "secret"
    if re.search(r"@|[(\[{][aA][tT][)\]}]", v):
        return "email"
    if v[0] == "+":
        return "phone"
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}|[0-9A-Fa-f]+(:[0-9A-Fa-f]+){7}", v):
        return "ip"
    if re.fullmatch(r"[0-9 ().·_/-]+", v):
        return "card" if len(digits) >= 13 else "phone"
    return "secret"


def plain_parts(kind, v, before):
    """The votes and the features of a span, restated."""
    digits = re.sub("[^0-9]", "", v)
    asked = {
        "email": lambda: bool(re.search(r"(?i)[a-z].*(@|at).*[a-z]", v)),
        "ip": lambda: not re.fullmatch("[0:.]+", v) and (":" in v or all(int(x) <= 255 for x in v.split("."))),
        "card": lambda: luhn(digits),
        "phone": lambda: 8 <= len(digits) <= 15,
        "secret": lambda: len(digits) >= 3 and bool(re.search("[A-Za-z]", v)),
    }
    check = asked[kind]()
    marks = len(re.sub("[A-Za-z0-9%+]", "", v))
    votes = (
        int(bool(re.search(pii.STRICT[kind], v))),
        int(check),
        1 if re.search(pii.GAZETTEER[kind], v) else -1,
        1 if re.search(pii.CUES[kind], before) else 0 if re.search(r"[0-9]\s*$|[/#]\s*$", before) else -1,
        1 if marks <= 5 else 0 if marks > 8 else -1,
    )
    left = re.search(r"([!-/:-@\[-`{-~0-9])?\s*$", before).group(1) or ""
    return votes, (*map(str, votes), str(min(len(v) // 4, 10)), str(min(len(digits), 20)), left)


def plain_decisions(texts):
    """Spans that the method adds to each text: votes, expectation-maximisation and logistic regression in plain loops."""
    wide = re.compile(pii.WIDE)
    spans = []
    for i, text in enumerate(texts):
        end = 0
        for m in wide.finditer(text or ""):
            kind = plain_kind(m.group())
            spans.append((i, kind, m.start(), m.end(), m.group(), *plain_parts(kind, m.group(), text[max(end, m.start() - 40) : m.start()])))
            end = m.end()
    added = {i: [] for i in range(len(texts))}
    for kind in {s[1] for s in spans}:
        mine = [s for s in spans if s[1] == kind]
        share, rates = 0.5, [pii.BELIEFS[v] for v in pii.VOTES]

        def p_of(votes):
            yes, no = share, 1 - share
            for x, (a, b) in zip(votes, rates):
                yes, no = yes * (a if x == 1 else 1 - a if x == 0 else 1), no * (b if x == 1 else 1 - b if x == 0 else 1)
            return yes / (yes + no)

        belief = 2 + pii.BELIEF * len(mine)
        for _ in range(pii.EM_ROUNDS):
            p = [p_of(s[5]) for s in mine]
            share = min(0.99, max(0.01, (sum(p) + 1) / (len(p) + 2)))
            new = []
            for j, v in enumerate(pii.VOTES):
                pair = []
                for side, prior in enumerate(pii.BELIEFS[v]):
                    w = [(q if side == 0 else 1 - q, s[5][j]) for q, s in zip(p, mine) if s[5][j] >= 0]
                    pair.append((sum(q * x for q, x in w) + belief * prior) / (sum(q for q, _ in w) + belief))
                new.append(tuple(pair))
            rates = new
        p = [p_of(s[5]) for s in mine]
        weight, bias = {}, 0.0
        odds = lambda s: bias + sum(weight.get((j, c), 0.0) for j, c in enumerate(s[6]))
        for _ in range(pii.NEWTON_ROUNDS):
            sums = {}
            for q, s in zip(p, mine):
                now = 1 / (1 + math.exp(-odds(s)))
                for key in [None, *enumerate(s[6])]:
                    a, b = sums.get(key, (0.0, 0.0))
                    sums[key] = a + q - now, b + now * (1 - now)
            step = {k: (a - pii.RIDGE * (weight.get(k, 0.0) if k else 0)) / (8 * b / 2 + pii.RIDGE) for k, (a, b) in sums.items()}
            bias += step.pop(None)
            for k, d in step.items():
                weight[k] = weight.get(k, 0.0) + d
        for s in mine:
            base = kind in CONTRACT and re.fullmatch(CONTRACT[kind], s[4]) and good(kind, s[4])
            if not base:
                added[s[0]].append((kind, s[2], s[3], odds(s) >= math.log(pii.ACCEPT / (1 - pii.ACCEPT))))
    return added


def test_the_method_against_a_plain_restatement(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    rows += [(10_000 + i, f"my email is user{i} (at) mail{i % 7} (dot) com please, the key AKIA{'ABCDEFGH'[i % 8]}1234567890{10000 + i}, call phone 212-555-{1000 + i}.") for i in range(30)]
    rows += [(20_000 + i, f"part 9{i:02d}-555-{1000 + i}-77 = 1234-567-{8000 + i}, 999.12.3.{i} and 4111.1111.1111.1111") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    assert set(model.prior) == set(pii.ALL_KINDS) and all(len(t) >= 3 for t in model.weights.values())
    got = {r.doc_id: r for r in pii.found(docs, model).collect()}
    want = plain_decisions([t for _, t in rows])
    taken = refused = 0
    for (doc, text), decided in zip(rows, want.values()):
        base = [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(CONTRACT[k], text or "") if good(k, m.group())]
        spans = sorted(base + [d[:3] for d in decided if d[3]], key=lambda s: (pii.ALL_KINDS.index(s[0]), s[1]))
        assert [(pii.ALL_KINDS[s.kind], s.start, s.end) for s in got[doc].spans] == spans, text
        taken, refused = taken + sum(d[3] for d in decided), refused + sum(not d[3] for d in decided)
    assert taken > 60 and refused > 20
    clean = {r.doc_id: r.text for r in pii.redacted(docs, model).collect()}
    assert clean[10_000].startswith("my email is <email> please, the key <secret>")


def test_very_many_matches_and_odd_texts(spark):
    many = " ".join(f"u{i}@m{i % 7}.example.com" for i in range(32_000))
    mixed = " ".join(f"a{i}@b.cd 10.0.{i % 256}.1 +1 (212) 555-{1000 + i % 9000}" for i in range(1500))
    rows = [(1, many), (2, None), (3, ""), (4, mixed), (4, mixed), (None, "x@y.zz"), (5, "é😀 x@y.zz 😀 1.2.3.4@a.bc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("spans_", "n_chars", "kind")})
    began = time.time()
    model = pii.Model()
    got = [(r.doc_id, r.text, len(r.spans), pii_text(r)) for r in pii.found(docs, model).collect()]
    assert {(i, n) for i, _, n, _ in got} == {(1, 32_000), (2, 0), (3, 0), (4, 4500), (None, 1), (5, 3)}
    assert all(s == brute(t)[1] for _, t, _, s in got)
    clean = pii.redacted(docs, model)
    assert clean.columns == docs.columns
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[1] == " ".join(["<email>"] * 32_000) and text[2] is None and text[5] == "é😀 <email> 😀 <ip>"
    assert text[4] == " ".join(["<email> <ip> <phone>"] * 1500)
    assert time.time() - began < 120
    assert pii.found(docs.limit(0), model).count() == 0 and not pii.fit(docs.limit(0)).prior


def pii_text(row):
    return ",".join(f"{pii.ALL_KINDS[s.kind]}:{s.start}:{s.end}" for s in row.spans)


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.cd"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op3_weak_supervision_pii(spark, str(tmp_path)).collect()}
    assert got[1].spans == "email:0:6" and got[1].base_sha256 == hashlib.sha256(b"email:0:6").hexdigest()
    assert got[2].spans == "" and got[2].n_email == 0


def test_the_wide_pattern_matches_what_its_parts_do(spark):
    rng = random.Random(11)
    pieces = ["a.b@mail.example.org", "joe (at) site (dot) de", "x" * 70 + " [at] y.org", "1:2:3:4:5:6:7:8", "zz9:a:b:c:d:1:2:3:4", "10.0.0.256", "+49 (30) 1234567", "tel+4912345678", "4111-1111-1111-1111", "4111.1111.1111.1111", "(212) 555-1234", "token=abc123def", "PASSWD: hunter2", "AKIAABCDEFGHIJ12", "a1b2c3d4e5f6a7b8c9", "word", "ſecret kEY", "0x3f:", "-", "+", " ", ".", "_", "é", "12"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "  ", ". "]) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    before = r"@|[0-9][0-9:.-]{2}|[0-9]{2}\x20[0-9]|(?i:[(\[{]at[)\]}]|passw|pwd|secret|token|key)"
    every = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    got = rows.select(every(pii.WIDE).alias("wide"), every("|".join(pii.CANDIDATES).replace("{1,64}+", "{1,64}")).alias("parts"), F.col("text").rlike(pii.WIDE_NEEDS).alias("needs"), F.col("text").rlike(before).alias("before")).collect()
    assert all(r.wide == r.parts and r.needs == r.before for r in got)
    assert sum(len(r.wide) for r in got) > 3000 and 0 < sum(r.needs for r in got) < len(got)
