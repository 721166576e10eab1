import pytest
from pyspark.sql import functions as F

from boxwise.llm import catalog
from boxwise.llm import surrogates as S

from .helpers import documents

KEY = b"test"


def texts(spark, rows, key=KEY):
    return {(r.doc_id, r.text, r.n_entities) for r in S.replace(documents(spark, rows), key).collect()}


def test_feistel_is_a_permutation():
    for n, radix in ((2, 10), (3, 10), (4, 4)):
        seen = {tuple(S.permuted(KEY, [v // radix**i % radix for i in range(n)], radix, "t")) for v in range(radix**n)}
        assert len(seen) == radix**n


def test_formats_and_coreference():
    text = 'Mr. John Smith and Mrs. JOHN SMITH, господин Иван Петров; (212) 555-1234 or 212-555-1234, 4111 1111 1111 1111 / 4111111111111111, DE44 5001 0517 5407 3249 31, me@x.co, ME@X.CO, 10.20.30.40, +1 (017) 555-7713, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    found = S.mentions(text)
    made = [(k, text[s:e], S.shaped(k, text[s:e], S.replacement(KEY, k, n, 0))) for s, e, k, n in found]
    kinds = [k for k, _, _ in made]
    assert kinds.count("person") == 3 and kinds.count("phone") == 3 and kinds.count("card") == 2 and kinds.count("email") == 2 and {"iban", "ip", "secret"} <= set(kinds)
    digits = lambda s: "".join(c for c in s if c.isdigit())
    by = {a: b for _, a, b in made}
    assert digits(by["(212) 555-1234"]) == digits(by["212-555-1234"]) and digits(by["4111 1111 1111 1111"]) == by["4111111111111111"]
    assert by["me@x.co"] == by["ME@X.CO"] and by["JOHN SMITH"].isupper() and by["John Smith"].upper() != by["JOHN SMITH"]
    assert S.script(by["Иван Петров"]) == "cyrillic"
    assert S.luhn([int(c) for c in by["4111111111111111"]])
    for kind, a, b in made:
        assert a != b
        if kind in ("phone", "card", "iban"):
            assert [c if not c.isalnum() else "x" for c in a] == [c if not c.isalnum() else "x" for c in b]
    assert not S.mentions("plain words, 1234, 9807915762804490, v1.2.3.4.5, 300.1.1.1 and 12:30")


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "no data"), (4, "a@b.co c@d.co a@b.co"), (4, "a@b.co c@d.co a@b.co"), (None, "a@b.co"), (5, "word " * 50000 + "a@b.co")]
    got = S.replace(documents(spark, rows), KEY).collect()
    assert len(got) == len(rows)
    four = [g.text for g in got if g.doc_id == 4]
    parts = four[0].split(" ")
    assert four[0] == four[1] and parts[0] == parts[2] != parts[1]
    assert next(g.text for g in got if g.doc_id is None) == parts[0]
    assert next(g.text for g in got if g.doc_id == 5).endswith("word " + parts[0])
    assert {(g.doc_id, g.text) for g in got if g.doc_id in (1, 2, 3)} == {(1, None), (2, ""), (3, "no data")}
    assert S.replace(documents(spark, rows).limit(0), KEY).count() == 0
    with pytest.raises(ValueError):
        S.replace(documents(spark, rows).withColumn("n_entities", F.lit(1)), KEY)


def test_clashes_are_made_anew(spark):
    """A real entity that equals another one's surrogate forces a second attempt, in the table and in the texts."""
    first = S.replacement(KEY, "ip", "10.0.0.1", 0)
    rows = [(1, "x 10.0.0.1 y"), (2, f"x {first} y"), (3, "x 10.0.0.1 y")]
    found = S.entities(documents(spark, rows))
    table = {r.norm: (r.made, r.attempt) for r in S.assigned(found, KEY).collect()}
    assert table["10.0.0.1"][1] > 0 and len({m for m, _ in table.values()}) == 2
    assert not {m for m, _ in table.values()} & set(table)
    got = {r.doc_id: r.text for r in S.replace(documents(spark, rows), KEY).collect()}
    assert got[1] == got[3] == f"x {table['10.0.0.1'][0]} y" and got[2] == f"x {table[first][0]} y"


def test_query(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    seen = {}
    for r in catalog.QUERIES["op7_pii_surrogates"](spark, small).collect():
        spans = S.mentions(docs[r.doc_id])
        assert r.n_entities == len(spans)
        assert spans or r.text == docs[r.doc_id]
        for s, e, k, n in spans:
            assert docs[r.doc_id][s:e] not in r.text
            seen[k, n] = S.replacement(catalog.KEY, k, n, 0)
    assert seen and len(set(seen.values())) == len(seen)
