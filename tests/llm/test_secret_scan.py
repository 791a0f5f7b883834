import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from wattframe.llm import secret_scan as S

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def base62(n, width):
    s = ""
    while n or len(s) < width:
        n, r = divmod(n, 62)
        s = S.BASE62[r] + s
    return s


def forge(prefix="ghp_", body="abcDEF0123456789abcDEF01234567"):
    return prefix + body + base62(zlib.crc32(body.encode()), 6)


def base_of(text):
    return [x for x in S.scan_text(text, S._automata()) if x[1] < 3]


def test_base_kinds_equal_one_expression_per_kind():
    r = random.Random(0)
    parts = ["password", "PassWd", "secret", "tok", "token", "api_key", "APIKEY", "apikey", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIAAKIA", "Z0",
             "ABCDEFGHIJKLMNOP", "0123456789abcdef", "ab12", "é", "ſecret", "K", "\n", "x", "İ", "日本", "_", "a" * 24, "b" * 23]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert base_of(t) == brute(t), t


def test_checksums_decide():
    good = forge()
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    text = f"é {good} {bad} {forge('npm_')} {good}x card 4111 1111 1111 1111, card: 4111 1111 1111 1112 IBAN GB82 WEST 1234 5698 7654 32 iban GB82WEST12345698765433"
    kinds = [(S.KINDS[k], text[s:e]) for s, k, e in S.scan_text(text, S._automata()) if k > 2]
    assert kinds == [("forge", good), ("registry", forge("npm_")), ("card", "4111 1111 1111 1111"), ("iban", "GB82 WEST 1234 5698 7654 32")]


def test_numbers_before_more_digits_or_capitals():
    card, gb, de = "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"
    for text, kind, want in [
            (f"card {card} 12/27", "card", [card]), (f"Visa {card} 123", "card", [card]), (f"visa 4111-1111-1111-1111-123", "card", ["4111-1111-1111-1111"]),
            (f"amex {card}12", "card", []), (f"card {card[:-1]}2 12/27 visa {card}", "card", [card]), (f"card {card} 1234 5678", "card", [card]),
            (f"IBAN {gb} BIC DEUTDEFF", "iban", [gb]), (f"IBAN: {de} Deutsche Bank", "iban", [de]),
            (f"IBAN {gb[:-1]}3 BIC DEUTDEFF iban {de}", "iban", [de]), (f"IBAN {gb.replace(' ', '')} {de}", "iban", [gb.replace(" ", "")]),
            ("IBAN NO93 8601 1117 947 X", "iban", ["NO93 8601 1117 947"]), (f"IBAN {gb}", "iban", [gb])]:
        found = [text[s:e] for s, k, e in S.scan_text(text, S._automata()) if S.KINDS[k] == kind]
        assert found == want, text
    text = f"IBAN {gb} BIC DEUTDEFF, card {card} 12/27"
    assert S.redact(text, S.scan_text(text, S._automata())) == "IBAN [IBAN] BIC DEUTDEFF, card [CARD] 12/27"


def test_query_columns_and_removal(spark):
    rows = [(1, "token = abcdef1 and " + "0f" * 12, 5), (2, None, None), (3, "", 0), (4, "clean text", 10), (1, "AKIA" + "A" * 20, 24),
            (5, "token=" + "ab" * 30, 1), (6, "x " * 200_000 + "secret:abcdefg", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("spans", F.lit("clash"))
    found = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_spans) for r in S.find_secrets(df, [F.col("doc_id")]).collect()}
    want = set()
    for i, t, _ in rows:
        b = brute(t or "")
        want.add((i, *[sum(x[1] == k for x in b) for k in range(3)], ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in b)))
    assert found == want
    clean = S.remove_secrets(df)
    assert clean.columns == df.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in clean.collect()), key=str)
    assert (4, "clean text", 10) in got and (2, None, None) in got and (3, "", 0) in got
    assert (1, "[ASSIGN] and [HEX]", 18) in got and (1, "[ACCESS]", 8) in got and (5, "[ASSIGN]", 8) in got
    assert S.find_secrets(df.limit(0), [F.col("doc_id")]).count() == 0
    assert S.sha256_hex("") == hashlib.sha256(b"").hexdigest()
