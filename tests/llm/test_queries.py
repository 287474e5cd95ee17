"""The package's queries: against their SQL where there is one, and their columns."""

import pytest

from patchlens.llm import queries as Q

from ..compare import assert_same, connection
from ..conftest import SF

COLUMNS = {
    "op1_quality": ["doc_id", "held_out", "score", "predicted"],
    "op2_line_dedup": ["doc_id", "text", "lines_total", "lines_dropped"],
    "op3_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op4_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5_minhash": ["doc_id", "class_id"],
    "op6_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op7_language_id": ["doc_id", "held_out", "lang_pred", "score", "rejected"],
    "op8_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op9_ann": ["query_id", "rank", "vec_id", "score"],
    "op10_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(name, spark):
    df = Q.queries()[name](spark, SF)
    assert df.columns == COLUMNS[name]
    if name in Q.oracle_sql():
        assert_same(df, Q.oracle_sql()[name], connection(SF))
    elif name != "op9_ann":
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        assert df.count() == docs.count()


def test_pipeline_stages(spark):
    """Each stage on its predecessor's rows: what must hold whatever the models learn."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made.append(stage(spark, made[-1], SF).cache())
        assert name and made[-1].count() > 0
    rated, lined, single, mixed, encoded = made[1:]
    assert all(d.columns == docs.columns for d in made[:-1])
    ids = lambda d: sorted(r[0] for r in d.select("doc_id").collect())
    assert set(ids(rated)) < set(ids(docs)) and ids(lined) == ids(rated) and set(ids(single)) < set(ids(lined))
    assert set(ids(mixed)) <= set(ids(single)) and ids(encoded) == ids(mixed)
    assert single.select("text").distinct().count() == single.count()
    assert corpus_pipeline.run(spark, SF).count() == encoded.count()
