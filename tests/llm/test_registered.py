"""The registered queries, their SQL, and the pipeline."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from data import ODD_TEXTS, documents
from receiptlake.llm import bpe, minhash, mixing, secret_scan, toxicity
from receiptlake.llm.common import table
from receiptlake.llm.queries import oracle_sql, queries

CONTRACT = {
    "op2_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op3_toxicity": "doc_id held_out score predicted",
    "op4_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op5_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op8_embeddings": "vec_id n_links component_id kept",
    "op9_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op10_page_text": "page_id url text n_chars",
    "op11_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op12_whitening": "vec_id component n deviation whitened explained identity_error",
    "op13_conversations": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
}


def test_names():
    assert {int(n[2:].split("_")[0]) for n in queries()} == set(range(1, 14)) and len(queries()) == 13
    assert {*queries(), "pipeline"} <= set(entry.queries()) and set(oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(queries()))
def test_whole_table(spark, sf_small, name):
    df = queries()[name](spark, sf_small)
    of = {"op8_embeddings": "embeddings", "op10_page_text": "pages", "op12_whitening": "embeddings"}
    rows = table(spark, sf_small, of.get(name, "documents")).count()
    if name == "op11_packing":
        assert df.select("doc_id").distinct().count() == rows
    elif name == "op12_whitening":
        assert df.count() == 8 * rows
    elif name == "op13_conversations":
        assert df.count() == table(spark, sf_small, "conversations").select("conv_id").distinct().count()
    elif name != "op6_mixing":
        assert df.count() == rows
    assert set(CONTRACT.get(name, "doc_id").split()) <= set(df.columns)


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_sql(spark, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    c = duckdb.connect()
    for view in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {view} AS SELECT * FROM '{sf_dir}/{view}.parquet'")
    columns = sorted(df.columns)
    want = c.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, want))


def test_pipeline(spark, sf_dir):
    """The stages in the driver's way against the operators on plain rows."""
    docs, columns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "documents").columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "secrets", "mixing", "bpe"]

    clean = stages["toxicity"](spark, docs, sf_dir)
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    rejected = {r.doc_id for r in toxicity.toxicity(docs, model).filter("predicted = 1").collect()}
    assert clean.columns == columns and rejected
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - rejected

    kept = stages["near_duplicates"](spark, clean, sf_dir)
    from test_copies import groups_of

    groups, _ = groups_of({r.doc_id: r.text for r in clean.collect()})
    assert kept.columns == columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values()))

    masked = stages["secrets"](spark, kept, sf_dir)
    assert masked.columns == columns and masked.count() == kept.count()
    assert masked.filter("n_chars != length(text)").count() == 0
    assert masked.filter("text LIKE '%[SECRET]%'").count()
    assert not any(r.spans for r in secret_scan.secret_spans(masked).collect())

    mixed = stages["mixing"](spark, masked, sf_dir)
    assert mixed.columns == columns
    counts = {r.doc_id: r.n_copies for r in mixing.mix(masked).collect()}
    encoded = stages["bpe"](spark, mixed, sf_dir)
    assert encoded.count() == sum(counts.values())

    one = {r.doc_id: r for r in bpe.round_trip(masked).collect()}
    ran = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(tuple, ran)) == sorted(tuple(one[i]) for i, n in counts.items() for _ in range(n))


def test_pipeline_on_odd_and_no_documents(spark, sf_small, monkeypatch):
    for texts in (ODD_TEXTS, []):
        docs = documents(spark, texts, clashing=False)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_small)
            assert out.columns == docs.columns, name
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_small).count() == docs.count()
    one = minhash.deduplicated(documents(spark)).count()
    assert one == len({t for t in ODD_TEXTS if (t or "").strip()}) + sum(not (t or "").strip() for t in ODD_TEXTS)
