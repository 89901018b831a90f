import hashlib
import math
import random
import re
from collections import Counter

import duckdb

from sparkloom.llm import secrets as sc
from sparkloom.llm.queries import QUERIES


def slow_base(text):
    """The base patterns as given."""
    text = text or ""
    out = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW](?:[oO][rR][dD]|[dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def test_query_against_plain_patterns(spark):
    d = "/root/testdata/sf0.01"
    docs = dict(duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall())
    got = QUERIES["op3_secrets"](spark, d).collect()
    assert len(got) == len(docs)
    for r in got:
        base = slow_base(docs[r.doc_id])
        n = Counter(k for k, _, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == hashlib.sha256(sc.joined(base).encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("entropy")) == sc.joined(base)
    assert sum(r.n_assign for r in got) > 5


def test_windows_against_recounting():
    rnd = random.Random(3)
    for _ in range(60):
        s = "".join(rnd.choice("abcdefgh0123456789XYZ"[: rnd.randint(2, 21)]) for _ in range(rnd.randint(5, 120)))
        width, least = rnd.choice([(8, 2.2), (16, 3.1), (24, 3.5)])
        hit = set()
        for a in range(len(s) - width + 1):
            c = Counter(s[a : a + width])
            if -sum(v / width * math.log2(v / width) for v in c.values()) >= least - 1e-9:
                hit |= set(range(a, a + width))
        assert {i for a, b in sc.windows(s, width, least) for i in range(a, b)} == hit


def test_entropy_spans_and_allow_list():
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKEYq8"
    found = sc.scan(f"see {key} here")
    assert [k for k, _, _ in found] == ["entropy"] and found[0][1] >= 4 and found[0][2] <= 4 + len(key)
    for public in ("123e4567-e89b-12d3-a456-426614174000", "averyveryverylongplainwordofletters", "src/main/java/com/example/app1/module2", "2024-01-01-00-00-00-000000", "xY12xY12xY12xY12xY12xY12xY12xY12xY12", "=" * 60, "https://example.com/some/long/path/of/words"):
        assert sc.scan(f"x {public} y") == [], public
    assert [k for k, _, _ in sc.scan(f'token = "{key}"')] == ["assign"]
    assert sc.scan("\u017fecret: abcdefgh to\u212aen: abcdefgh") == []
    assert sc.scan("password: a=b") == [] and len(sc.scan("PASSWORD : 'abc.def=='")) == 1


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, None, 0), (None, "", 0), (2, "é" * 1000 + " AKIA" + "A1B2" * 5, 1), (2, "x " * 200000 + "0123456789abcdef" * 4, 2), (3, "a1B" * 50000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = df.select("doc_id", sc.scan_column(F.col("text")).alias("s")).select("doc_id", "s.*").collect()
    assert [r.spans for r in got][:3] == ["", "", "access:1001:1025"] and got[3].spans == "hex:400000:400064"
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_after_equals_signs_and_short_candidates():
    rnd = random.Random(11)
    alnum = "".join(chr(c) for r in ((48, 58), (65, 91), (97, 123)) for c in range(*r))
    kinds = [("AWS_SECRET_ACCESS_KEY=", alnum + "+/", 40), ("auth=", alnum, 48), ("https://a.example/b?sig=", alnum, 43), ("see ", alnum, 22), ("see glpat-", alnum, 20), ("see ", alnum + "-_", 28), ("id=", "0123456789abcdef", 20)]
    for before, letters, n in kinds:
        found = sum(bool(sc.entropy_spans(f"{before}{''.join(rnd.choice(letters) for _ in range(n))} end")) for _ in range(200))
        assert found >= 190, (before, n, found)
    for public in ("id=123e4567-e89b-12d3-a456-426614174000", "path=src/main/java/com/app1", "x=aaaaaaaaaa1aaaaaaaaaa", "day=2024-01-01-00-00-00", "name=averyveryverylongplainword"):
        assert sc.entropy_spans(public) == [], public


def slow_entropy(text):
    """Entropy spans by the definition: each window counted anew, marked characters joined."""
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", text):
        s = m[0]
        if any(a.fullmatch(s) for a in sc.ALLOW):
            continue
        if all(c in "0123456789abcdefABCDEF" for c in s):
            width, least = 24, 3.0
        elif s.isalnum():
            width, least = 24, 3.7
        else:
            width, least = 32, 4.1
        if bool(re.search("[0-9]", s)) + bool(re.search("[a-z]", s)) + bool(re.search("[A-Z]", s)) < 2:
            continue
        short = min(width, len(s))
        least -= math.log2(width / short)
        hit = set()
        for a in range(len(s) - short + 1):
            c = Counter(s[a : a + short])
            if sum(-v / short * math.log2(v / short) for v in c.values()) >= least - 1e-9:
                hit |= {(a, a + short)}
        merged = []
        for a, b in sorted(hit):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        out += [(m.start() + a, m.start() + b) for a, b in merged]
    return out


def test_whole_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = dict(duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall())
    found = 0
    for r in QUERIES["op3_secrets"](spark, d).collect():
        base = slow_base(docs[r.doc_id])
        more = [("entropy", a, b) for a, b in slow_entropy(docs[r.doc_id] or "") if not any(s <= a and b <= e for _, s, e in base)]
        found += len(more)
        assert r.spans == sc.joined(sorted(base + more, key=lambda x: (x[1], sc.KINDS.index(x[0]), x[2])))
    print("entropy spans", found)


def test_allow_list_takes_no_keys():
    rnd = random.Random(4)
    for key in ("ghp_16C7e42F292c6912E7", "sk_live_4eC39HqLyjWD", "a1B2-c3D4_e5F6-g7H8_i9J0k1", "xoxb-123456789012-abcdefghijkl"):
        assert [k for k, _, _ in sc.scan(f"see {key} here")] == ["entropy"], key
    low, both = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for letters, n in ((both, 24), (low + "0123456789", 28), (low + "0123456789-_", 32)):
        keys = ["".join(rnd.choice(letters) for _ in range(n)) for _ in range(300)]
        assert sum(any(a.fullmatch(k) for a in sc.ALLOW) for k in keys) <= 3, letters
        assert sum(bool(sc.entropy_spans(f"x {k}")) for k in keys) >= 270, letters
    text = "fooBar12 baz/qux-3 " + "".join(rnd.choice(both + "0123456789+/-_=") for _ in range(3000))
    assert sc.entropy_spans(text) == slow_entropy(text)
