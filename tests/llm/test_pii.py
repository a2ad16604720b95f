import re

from pyspark.sql import functions as F

from tessera.llm import pii

from .data import SCHEMA, odd_rows, ordered, sha, with_extra_columns

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

TEXTS = ["a@b.com_x@y.org a@b..c x@y@z.com a@b.c.+x@d.e", "1.2.3.4.5.6.7.8 0000255.1.1.1 0.0.0.0 256.1.1.1 1.2.3 000.00.0.300",
         "4111 1111 1111 1111-4111111111111111 4111-1111 0000000000000000", "+1 (743) 555-3824 +1+22222222222 +12345678 +1()()2",
         "é😀 a@b.co 😀 +49 170 1234567 x 10.0.0.1", "9" * 30000, "a" * 50000, "@" * 1000, "a@" * 500 + "b.c",
         "phone 555-123-4567, ssn 123-45-6789 page 12-13 call (212) 555-1234 version 1.2.3 name [at] host [dot] com",
         "(1.1.1.1.1" * 50, "1 2 3-4-5  6", "+1" + " (" * 3000, "1.1." * 300, "1-" * 3000, "token = \"" + "a1" * 20 + "\" end"]


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = 0
        for i, c in enumerate(reversed(digits)):
            x = int(c) * (2 if i % 2 else 1)
            total += x - 9 if x > 9 else x
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    spans, counts = [], []
    for k, kind in enumerate(KINDS):
        own = [(m.start(), k, m.end()) for m in re.finditer(PATTERNS[kind], text or "") if passes(kind, m.group())]
        counts.append(len(own))
        spans += own
    listing = [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)]
    return counts, listing


def check(docs, rows):
    got = pii.digest(docs).collect()
    expected = [(d, *brute(t)[0], sha(",".join(brute(t)[1]))) for d, t in rows]
    assert ordered([tuple(r)[:6] for r in got]) == ordered(expected)
    listings = {(d, sha(",".join(brute(t)[1]))): brute(t)[1] for d, t in rows}
    for r in got:  # base spans stay, and all are in order
        spans = [s for s in r.spans.split(",") if s]
        assert set(listings[r.doc_id, r.base_sha256]) <= set(spans)
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
    return got


def test_base_spans_match_brute_force(spark):
    rows = list(enumerate(TEXTS)) + odd_rows()
    check(with_extra_columns(spark.createDataFrame(rows, SCHEMA)), rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check(docs, [tuple(r) for r in docs.collect()])


def test_classifier_adds_what_the_labelers_agree_on(spark):
    rows = [(i, f'set token = "{sha(str(i))}" and call (212) 555-1{i:03d} on page 12-{i + 10}, version 3.{i + 10}.12') for i in range(200)]
    cards = 0
    for r in pii.digest(spark.createDataFrame(rows, SCHEMA)).collect():
        spans = r.spans.split(",")
        # digits of a key that pass as a card stay one, and the key around them is a secret
        expected = ["secret", *["card"] * r.n_card, "phone"]
        assert [s.split(":")[0] for s in spans] == expected, spans
        cards += r.n_card
    assert cards > 0


def test_secret_around_a_card_is_masked_whole(spark):
    rows = [(i, f'token = "{sha(str(i))}" end', 1) for i in range(200)]
    out = pii.mask_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")).collect()
    assert {r.text for r in out} == {'[secret]" end'}


def test_places_of_many_matches(spark):
    text = "".join(f"é10.0.{i % 256}.{i // 256} " for i in range(3000))
    r = pii.digest(spark.createDataFrame([(1, text)], SCHEMA)).first()
    assert (r.n_ip, r.base_sha256) == (3000, sha(",".join(brute(text)[1])))


def test_em_tells_good_labelers_from_bad():
    # labelers 1-3 agree with each other, labeler 4 votes at random, labeler 5 is silent
    patterns = [("number", "+++" + v + "0", "1" * pii.FEATURES, 50) for v in "+-"]
    patterns += [("number", "---" + v + "0", "0" * pii.FEATURES, 50) for v in "+-"]
    patterns += [("number", "++-+0", "1" * pii.FEATURES, 5), ("number", "--+-0", "0" * pii.FEATURES, 5)]
    belief = pii.reliabilities(patterns)
    assert belief["number", "+++-0"] > 0.9 and belief["number", "---+0"] < 0.1
    assert abs(belief["number", "++++0"] - belief["number", "+++-0"]) < 0.1
    weights = pii.train(patterns, belief)
    assert sum(weights["number"]) > 1 > weights["number"][0]


def test_masking(spark):
    rows = [(1, "é 😀 a@b.co and +49 170 1234567!", 3), (2, "clean", 5), (3, None, None), (4, "", 0), (5, "10.0.0.1", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").withColumn("_base", F.lit("mine"))
    out = {r.doc_id: r for r in pii.mask_personal_data(docs.drop("_base")).collect()}
    assert (out[1].text, out[1].n_chars) == ("é 😀 [email] and [phone]!", 24)
    assert (out[2].text, out[3].text, out[4].text, out[5].text) == ("clean", None, "", "[ip]")


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.digest(empty).collect() == []
    assert pii.mask_personal_data(empty).collect() == []
