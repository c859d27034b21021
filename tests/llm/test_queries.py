"""The registered corpus queries and the pipeline on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tidewater.llm import queries  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    assert rows
    if name in queries.ORACLES:
        want = duck.sql(queries.ORACLES[name])
        names = sorted(want.columns)
        assert sorted(df.columns) == names
        at = [want.columns.index(n) for n in names]
        assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(tuple(r[k] for k in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op1_mix_sources", "op3_quality_rules", "op7_chat_format", "op8_pii"])
def test_native_queries_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExternalRDD"))


def test_language_held_out(spark):
    got = queries.op5_language_id(spark, str(DATA)).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_pseudonyms_of_the_table(spark):
    """op8 over all documents against the same in Python, text by text."""
    from tests.llm.test_corpus import py_pseudonymised

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op8_pii(spark, str(DATA)).collect()
    assert sum(r.n_replaced for r in got) > 0
    for r in got:
        assert r.text == (texts[r.doc_id] and py_pseudonymised(texts[r.doc_id], queries.TRIAL_KEY))


def test_pipeline(spark, duck, tmp_path):
    """Every stage against SQL or brute force over what the stage before it left."""
    import hashlib
    from collections import Counter
    from itertools import combinations

    from tests.llm.test_corpus import brute_links, brute_sets, py_pseudonymised

    at = docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mix", "encode"]
    for name, stage in corpus_pipeline.STAGES:
        before, out = at, stage(spark, at, str(DATA))
        if name != "encode":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        old, new = before.collect(), at.collect()
        if name == "quality":
            kept = {r[0] for r in duck.sql(f"SELECT doc_id FROM ({queries.ORACLES['op3_quality_rules']}) WHERE kept").fetchall()}
            assert sorted(new) == sorted(r for r in old if r.doc_id in kept)
        if name == "near_duplicates":
            sets = {r.doc_id: brute_sets(r.text) for r in old}
            alike = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            firsts = {root for _, root in brute_links(alike, list(sets)).values()}
            assert alike and sorted(new) == sorted(r for r in old if r.doc_id in firsts)
        if name == "pii":
            want = {r.doc_id: py_pseudonymised(r.text, queries.TRIAL_KEY) for r in old}
            assert {r.doc_id: r.text for r in new} == want and all(r.n_chars == len(r.text) for r in new)
        if name == "mix":
            duck.sql(f"CREATE SCHEMA mixed; CREATE VIEW mixed.documents AS SELECT * FROM '{tmp_path}/pii/*.parquet'")
            taken = duck.sql(queries.ORACLES["op1_mix_sources"].replace("FROM documents", "FROM mixed.documents"))
            sized = taken.project("doc_id, taken // size AS copies").fetchall()
            assert Counter(r.doc_id for r in new) == Counter({d: c for d, c in sized if c}) and {tuple(r) for r in new} <= {tuple(r) for r in old}
        if name == "encode":
            import tokenizers

            lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            lib.no_truncation()
            lib.no_padding()
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            want = []
            for r in old:
                ids = lib.encode(r.text, add_special_tokens=False).ids
                want.append((r.doc_id, r.source, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
            assert sorted(map(tuple, new)) == sorted(want)
    assert sorted(new) == sorted(corpus_pipeline.run(spark, str(DATA)).collect())


def test_pipeline_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(DATA))
    assert docs.count() == 0
