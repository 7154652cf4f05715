import re

from pyspark.sql import functions as F

from quern.llm import surrogates as s

TEXTS = [
    "Write Mr. John Smith or Mrs Anna Jones, mail JO.81@mail7.example.com now.",
    "Mr Smith called +1 (017) 555-7713 or +1 017 555 7713; card 4111 1111 1111 1111.",
    '4111111111111111 ip 97.51.17.173 token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" jo.81@mail7.example.com',
    None,
    "",
    "plain 4.0. text of version 3.",
    "Г-н Иванов и Frau Müller DE89 3704 0044 0532 0130 00 123-45-6789",
]


def test_replacement(spark, make_docs):
    docs = make_docs([*TEXTS, TEXTS[2]], ids=[*range(7), 2]).withColumn("n_entities", F.lit("mine"))
    out = s.pseudonymised(docs)
    assert out.columns == [*docs.columns, "_n_entities"]
    got = out.collect()
    assert len(got) == 8
    text = {r["doc_id"]: r["text"] for r in got}
    assert [text[i] for i in (3, 4, 5)] == [None, "", TEXTS[5]]
    joined = " ".join(x for x in text.values() if x)
    for secret in ("Smith", "John", "Jones", "jo.81", "JO.81", "555", "4111", "97.51", "04dbebab", "Иванов", "Müller", "3704", "123-45"):
        assert secret not in joined
    a, b = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 (\d{3}) (\d{3}) (\d{4})", text[1])[0][:3], re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 (\d{3}) (\d{3}) (\d{4})", text[1])[0][3:]
    assert a == b  # one number, two writings
    card = re.search(r"card ([\d ]{19})", text[1])[1].replace(" ", "")
    assert text[2].startswith(card)
    luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(card)))
    assert luhn % 10 == 0  # 4111... is valid, so is its surrogate
    assert all(1 <= int(x) <= 254 for x in re.search(r"ip ([\d.]+) ", text[2])[1].split("."))
    family = re.search(r"Mr (\S+) called", text[1])[1]
    given = re.search(r"Mr\. (\S+) (\S+) or Mrs (\S+) ", text[0])
    assert given[2] == family and given[1].endswith("o") and given[3].endswith("a")
    assert re.search(r"Г-н [А-Я][а-я]+ и Frau [A-Z][a-z]+ DE\d\d(?: \d{4}){4} \d\d \d{3}-\d\d-\d{4}$", text[6])
    mail = re.search(r"mail (\S+@\S+) now", text[0])[1]
    assert re.fullmatch(r"[A-Z]{2}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", mail) and text[2].endswith(mail.lower())
    assert [r["_n_entities"] for r in sorted(got, key=lambda r: r["doc_id"])] == [5, 4, 4, 4, 0, 0, 0, 4]
    assert {r["doc_id"]: r["text"] for r in s.pseudonymised(docs, key="other").collect()}[2] != text[2]
    assert s.pseudonymised(docs.limit(0)).count() == 0


def test_wider_forms_and_one_number_one_surrogate(spark, make_docs):
    names = ["Dr Smith", "Prof Smith", "Mr McDonald", "Mr O'Brien", "Mr\nSmith", "Mr John Michael Smith", "Mrs Smith-Jones", "Herr Dr. Müller", "Mr J. R. Adams"]
    numbers = ["555.123.4567", "555 123 4567", "020 7946 0958", "3782 822463 10005", "2001:db8:85a3::8a2e:370:7334", "fe80::1ff:fe23", "+15551234567", "+1 555 123 4567", "01 23 45 67 89"]
    clean = ["at 12:30:45 std::vector", "Sirloin Steak and Drab Walls", "version 4.0.1 of 2024"]
    out = [r["text"] for r in s.pseudonymised(make_docs([f"so {x} said" for x in names + numbers] + clean)).orderBy("doc_id").collect()]
    assert out[-len(clean) :] == clean
    for x, y in zip(names, out, strict=False):
        title, *parts = re.split(r"\s", x)
        assert y.startswith(f"so {title}") and y.endswith(" said") and not any(p.strip(".") in re.findall(r"[\w'-]+", y) for p in parts if p != "Dr."), y
        assert not re.search(r"[-'](Jones|Brien)|Donald", y)
    for x, y in zip(numbers, out[len(names) :], strict=False):
        assert y[3:-5] != x and re.sub("[0-9a-f]", "0", y) == re.sub("[0-9a-f]", "0", f"so {x} said"), y
        assert not any(g in re.findall(r"\w{4,}", y) for g in re.findall(r"\w{4,}", x)), y
    one, two = (re.sub("[^0-9]", "", y) for y in out[len(names) + 6 : len(names) + 8])
    assert one == two and one[0] == "1"


def test_surrogates_stay_distinct(spark):
    # all two-digit endings of a small space: most first draws collide
    names = [(f"{'FAMILY'}", f"n{i:04d}") for i in range(6000)]
    got = s.assigned(spark.createDataFrame(names, "kind string, canon string"), "k")
    assert got.count() == 6000 and got.select("new").distinct().count() == 6000
    one = spark.createDataFrame([("IP", "1.2.3.4")], "kind string, canon string")
    new = s.assigned(one, "k").head()["new"]
    both = s.assigned(one.union(spark.createDataFrame([("IP", new)], one.schema)), "k").collect()
    assert {r["new"] for r in both}.isdisjoint({"1.2.3.4", new}) and len({r["new"] for r in both}) == 2


def test_no_python_on_the_way(spark, make_docs):
    plan = s.pseudonymised(make_docs(TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_every_entity_passes_the_hint(spark, make_docs):
    """The cheap test before the search is implied by the patterns: letters alone make secrets too."""
    secrets = ["sk-" + "abcdefghijklmnopqrstuvwxyzABCD", "ghp_" + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ", "AKIA" + "ABCDEFGHIJKLMNOP", "abcdefab" * 5, "ABCDEFAB" * 4, "jo@mail.example", "Г-жа Иванова", "Mlle\u00a0Dupont"]
    out = s.pseudonymised(make_docs([f"so {x} it is" for x in secrets])).orderBy("doc_id").collect()
    for x, r in zip(secrets, out, strict=True):
        assert r["n_entities"] == 1 and x.split()[-1] not in r["text"] and len(r["text"]) >= 12, r


def test_names_are_found_again_without_their_title(spark, make_docs):
    texts = ["Mr John Smith-Lee came. Later Smith-Lee met John, not Johnson; smith-Lee", "Smith-Lee alone", "Mrs Robin Ray and Mr Robin Poe, then Ray and Poe. Ray@mail.example"]
    a, b, c = (r["text"] for r in s.pseudonymised(make_docs(texts)).orderBy("doc_id").collect())
    got = re.fullmatch(r"Mr (\S+) (\S+) came\. Later (\S+) met (\S+), not Johnson; smith-Lee", a)
    assert got and got[1] == got[4] != "John" and got[2] == got[3] != "Smith-Lee" and b == texts[1]
    got = re.fullmatch(r"Mrs (\S+) (\S+) and Mr (\S+) (\S+), then (\S+) and (\S+)\. (\S+)@\S+", c)
    assert got and got[2] == got[5] and got[4] == got[6] and got[1][-1] == "a" and got[3][-1] == "o"


def test_it_ends_where_most_of_a_format_is_real(spark, make_docs):
    """6,000 of 10,000 numbers, all ten of a digit's, nine of ten, and a lone one whose format the others use up."""
    rows = [("PHONE", f"+1 {i:04d}") for i in range(6000)] + [("IPV6", f"::{i}") for i in range(10)] + [("IPV6", f"a::{i}") for i in range(9)] + [("OTHER", "7")]
    got = s.assigned(spark.createDataFrame(rows, "kind string, canon string"), "k").collect()
    assert len(got) == len(rows) and len({(r["kind"], r["new"]) for r in got}) == len(rows) and {(r["kind"], r["canon"]) for r in got} == set(rows)
    assert all(r["new"] != r["canon"] for r in got)
    assert all(re.fullmatch(r"\+1 \d{4}", r["new"]) for r in got if r["kind"] == "PHONE")
    done = spark.createDataFrame([("OTHER", "3", "9")], "kind string, new string, canon string")
    left = spark.createDataFrame([("OTHER", "5")], "kind string, canon string")
    assert {(r["canon"], r["new"]) for r in s._ring(left, done, "k").collect()} == {("5", "3"), ("9", "5")}
    assert [r["new"] for r in s._ring(left, done.limit(0), "k").collect()] == ["6"]


def test_account_numbers_keep_valid_digits(spark, make_docs):
    valid = ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19"]
    out = [r["text"] for r in s.pseudonymised(make_docs([f"to {x} now" for x in [*valid, "GB29NWBK60161331926818"]])).orderBy("doc_id").collect()]

    def rest(t):
        t = t.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97

    for x, y in zip(valid, out, strict=False):
        assert rest(x) == 1 == rest(y[3:-4]) and y[3:5] == x[:2] and y[7:-4] != x[4:]
    assert re.fullmatch(r"to GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d now", out[1]) and re.fullmatch(r"to GB\d\d[A-Z]{4}\d{14} now", out[2])


def test_long_texts_and_clashing_columns(spark, make_docs, prose):
    text = prose(5, 30_000) + " call +1 017 555 7713 or Mr Smith"
    docs = make_docs([text, None, "", "Mr Smith"])
    for c in ("__new", "new_", "segs_", "id_", "hash_", "more_", "i", "kind", "canon", "segs", "ents", "t", "x"):
        docs = docs.withColumn(c, F.lit(1))
    for most in (s.BROADCAST_ROWS, 0):  # both ways to the texts
        was, s.BROADCAST_ROWS = s.BROADCAST_ROWS, most
        try:
            out = s.pseudonymised(docs).orderBy("doc_id").collect()
        finally:
            s.BROADCAST_ROWS = was
        assert [r["n_entities"] for r in out] == [2, 0, 0, 1] and out[0]["text"].startswith(prose(5, 30_000)) and out[0]["kind"] == 1
        assert out[0]["text"].split()[-1] == out[3]["text"].split()[-1] != "Smith"
