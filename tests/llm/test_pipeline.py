import hashlib

import tokenizers

import __spark_entry__ as entry
import corpus_pipeline as P
from boxwise.llm import catalog, decontaminate, langid, surrogates

from .helpers import jaccard_components, prose, rnd


def test_stages_against_plain_counterparts(spark, small, tmp_path, vocabulary):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ref = tokenizers.Tokenizer.from_str(vocabulary)
    rows = {r.doc_id: r for r in docs.collect()}
    now = docs
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r for r in now.collect()}
        out = stage(spark, now, small)
        assert k == len(P.STAGES) - 1 or out.columns == P.COLUMNS
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in now.collect()}
        assert now.count() == len(after)
        if name == "language":
            assert len(after) >= 0.98 * len(before)
        elif name == "near_duplicates":
            parts = jaccard_components([(d, r.text) for d, r in before.items()])
            assert set(after) == {d for d, _, c in parts if d == c}
        elif name == "decontamination":
            items = spark.read.parquet(f"{small}/benchmark.parquet")
            bad = {r.doc_id for r in decontaminate.leaks(docs, items).collect()}
            assert set(after) == set(before) - bad and bad & set(before)
        elif name == "pii":
            assert set(after) == set(before)
            for d, r in after.items():
                spans = surrogates.mentions(before[d].text)
                assert spans or r == before[d]
                assert not any(before[d].text[s:e] in r.text for s, e, _, _ in spans)
                assert not spans or r.n_chars == len(r.text)
        else:
            assert set(after) == set(before)
            for d, r in after.items():
                ids = ref.encode(before[d].text, add_special_tokens=False).ids
                assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    final = {tuple(r) for r in P.run(spark, small).collect()}
    assert final == {tuple(r) for r in now.collect()} and len(rows) > len(final)


def test_odd_rows_pass_every_stage(spark, small):
    r = rnd(1)
    text = prose(r, 30)
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text + " end", "en", "s", 5), (None, "another text without id", "en", None, None), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "word " * 30000, "en", "s", 9)]
    docs = spark.createDataFrame(rows, ",".join(f"{c} {t}" for c, t in zip(P.COLUMNS, ("long", "string", "string", "string", "long")))).selectExpr("*", "1 AS label", "2 AS k", "3 AS n_entities_seen")
    kept = {x.doc_id for x in P.near_duplicates(spark, docs, small).collect()}
    assert kept == {1, 3, 4, 5, None} and P.near_duplicates(spark, docs, small).filter("doc_id = 1").count() == 1
    other = prose(r, 40)
    clash = [(7, text, "en", "s", 1), (7, other, "en", "s", 1), (7, other, "en", "s", 1), (None, prose(r, 40), "en", "s", 1), (None, prose(r, 40), "en", "s", 1), (None, other + " x", "en", "s", 1), (8, "", "en", "s", 0), (8, None, "en", "s", 0)]
    left = P.near_duplicates(spark, spark.createDataFrame(clash, docs.schema[:5]), small).collect()
    assert sorted((str(x.doc_id), str(x.text)) for x in left) == sorted((str(c[0]), str(c[1])) for k, c in enumerate(clash) if k not in (2, 5))
    for _, stage in P.STAGES:
        assert stage(spark, docs, small).count() <= len(rows)
        assert stage(spark, docs.limit(0), small).count() == 0


def test_registration():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
    assert callable(langid.fit) and catalog.KEY
