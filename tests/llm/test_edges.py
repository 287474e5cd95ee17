"""Every operator on empty tables, odd rows and columns that clash with its own names."""

import corpus_pipeline
import pytest

from patchlens.llm import bpe, langid, line_dedup, media, minhash, mixing, pii, quality

MODEL = quality.RuleModel(0.5, (((("upper", True, 0.3), ("words", False, 9.0)), -2.0),))
PER_DOCUMENT = {"mix": mixing.mix, "keep_one": minhash.keep_one}
PER_ROW = {
    "quality": lambda d: quality.score(d, MODEL),
    "line_dedup": line_dedup.drop_boilerplate,
    "mixing": mixing.copies,
    "bpe": bpe.round_trip,
    "minhash": minhash.near_duplicates,
    "media": lambda d: media.digest_media(media.store_documents(d)),
    "langid": lambda d: langid.identify(d, {"en": b"the one two three four", "fr": "été à l'école".encode()}),
    "pii": pii.find_spans,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_every_row(name, docs_of, odd_rows):
    out = PER_ROW[name](docs_of(odd_rows, clashes=True)).toPandas()
    assert len(out) == len(odd_rows)
    assert sorted(out["doc_id"].dropna()) == sorted(r[0] for r in odd_rows if r[0] is not None)


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(name, docs_of):
    assert PER_ROW[name](docs_of([])).count() == 0


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_columns_of_any_name_come_through(name, docs_of, odd_rows):
    """The same rows as without them, and their values untouched."""
    docs = docs_of(odd_rows, clashes=True)
    out = PER_DOCUMENT[name](docs)
    assert out.columns == docs.columns
    plain = PER_DOCUMENT[name](docs_of(odd_rows))
    rows = out.collect()
    assert sorted((r[:5] for r in rows), key=str) == sorted((tuple(r) for r in plain.collect()), key=str)
    assert {v for r in rows for v in r[5:]} <= {"clash"}
    assert PER_DOCUMENT[name](docs_of([], clashes=True)).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_columns(k, spark, docs_of, odd_rows, tmp_path):
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage = corpus_pipeline.STAGES[k][1]
    docs = docs_of(odd_rows, clashes=True)
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    assert stage(spark, docs_of([]), str(tmp_path)).count() == 0
    if k == 4:
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and len(rows) == len(odd_rows)
        return
    assert out.columns == docs.columns and {v for r in rows for v in r[5:]} <= {"clash"}
    assert sorted((r[:5] for r in rows), key=str) == sorted((tuple(r) for r in stage(spark, docs_of(odd_rows), str(tmp_path)).collect()), key=str)
