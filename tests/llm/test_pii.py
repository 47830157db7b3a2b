import re

from graphloom.llm import pii
from pyspark.sql import functions as F


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    out = []
    for no, pattern, ok in (
        (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
        (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
        (2, r"[0-9]([\x20-]?[0-9])+", lambda m, d: 14 <= len(d) <= 19 and luhn(d)),
        (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 10 <= len(d) <= 15),
    ):
        out += [(m.start(), no, m.end()) for m in re.finditer(pattern, text) if ok(m[0], re.sub("[^0-9]", "", m[0]))]
    return sorted(out)


CASES = [
    "a.b_c@d.e.f_g@h.ij x@y.z a@b@c.d", "1.2.3.4.5.6.7.8 999.1.1.1 00001.2.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112 0000 0000 0000 00",
    "+1 (743) 555-3824 ++12 34 56 78 90 12+1234567890 +1--", "é\U0001f600 x@y.zz 1.1.1.1 \U0001f600 +1234567890123456", "", None, "x" * 3000 + "@a.b " + "1" * 3000, "5 5 5 5 5 5-5-5-5-5 5 5 5 5 a",
]


def test_base_spans_equal_plain_patterns(spark, awkward):
    rows = [(i, t, 0) for i, t in enumerate(CASES + [r.text for r in awkward.collect()])]
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string, spans long")).collect():
        assert [(s.start, s.no, s.end) for s in r.spans if s.no < 4] == base(r.text)


def test_disclosing_terms_are_found_and_removed(spark, nothing):
    rows = [(i, f"report {i} by agent Zorblax mail zed@corp.example.org about item{i} today", 0) for i in range(5)]
    rows += [(100 + i, f"some other report about the item number {i} today by nobody", 0) for i in range(60)]
    rows += [(300, "zorblax came alone", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in pii.stage(spark, docs, "").collect()}
    assert "Zorblax" not in got[0] and "[EMAIL]" in got[0] and "today" in got[0] and got[300] == " came alone"
    assert got[100] == rows[5][1]
    assert pii.sanitise(nothing).count() == 0 and pii.sanitise(nothing).columns == nothing.columns


def test_sanitising_merges_overlaps(spark):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(no).alias("no"), F.lit(b).alias("end"), F.lit("").alias("value")) for a, no, b in ((2, 0, 5), (4, 2, 7), (9, 4, 10))])
    assert spark.range(1).select(pii.sanitised(F.lit("0123456789x"), spans)).first()[0] == "01[EMAIL]78x"


def test_words_at_the_edges_of_a_text_are_context(spark):
    far = "y" * 80
    rows = [("Zorblax mail z@y.org came end", 13, 20), (f"{far} mail z@y.org came {far}", 86, 93)]
    found = spark.createDataFrame(rows, "text string, start int, end int").select(pii._contexts(F.col("text"), F.array(F.struct("start", F.lit(0).alias("no"), "end", F.lit("z@y.org").alias("value"))))[0]["terms"].alias("c")).collect()
    assert [sorted(r.c) for r in found] == [["came", "end", "mail", "zorblax"], ["came", "mail"]]


def test_many_spans_in_one_text_and_overlaps(spark):
    """Against a plain loop: thousands of spans, and base spans that overlap."""
    line = "word a@b.example.com and +1 212 555 0100 x 1.2.3.4@c.example \u00e9 "
    text = line * 1500
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.sanitise(docs).collect()[0].text
    found = pii.find(docs).collect()[0].spans
    want, at = [], 0
    for x in sorted(found, key=lambda x: (x.start, x.no)):
        if x.start >= at:
            want += [text[at : x.start], ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "")[x.no]]
        at = max(at, x.end)
    assert got == "".join(want) + text[at:]
    assert len(found) == 4 * 1500 and all(text[x.start : x.end] == x.value for x in found)


def test_pooled_entities_disclose_what_single_values_cannot(spark):
    """Every address occurs once; their domain occurs with one word wherever it does."""
    rows = [(i, f"filler{i} talk about zanzibar person{i}@secret.example today filler") for i in range(6)] + [(100 + i, f"plain text number {i} talk about today filler") for i in range(200)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    terms = {r.text[x.start : x.end] for r in got for x in r.spans if x.no == 4}
    assert "zanzibar" in terms and "talk" not in terms and "filler" not in terms
