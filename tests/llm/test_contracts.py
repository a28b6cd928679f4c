"""The opN queries over whole test tables: columns, types and folds as agreed, held-out quality, and the SQL twins."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
COLUMNS = {
    "op1_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_lattice_likelihood": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op4_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}
FOLDS = {"op2_lattice_likelihood": (10, 0), "op4_language_id": (4, 2), "op8_toxicity": (3, 1)}


def _rows(frame):
    text = lambda v: "" if v is None or v != v else f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)
    return sorted("|".join(text(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_folds(spark, name):
    got = entry.queries()[name](spark, SF)
    kinds = dict(got.dtypes)
    for column in COLUMNS[name].split(", "):
        assert kinds[column.split()[0]] == column.split()[1]
    rows = got.collect()
    ids = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in rows) == sorted(ids)
    if name in FOLDS:
        parts, held = FOLDS[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == held) for r in rows)
    if name == "op8_toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert _rows(entry.queries()[name](spark, SF).toPandas()) == _rows(con.execute(entry.oracle_sql()[name]).df())


def test_language_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    got = entry.queries()["op4_language_id"](spark, sf).where("held_out AND lang_pred <> 'und'")
    known = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL")
    right, total = known.agg(F.count(F.when(F.col("lang") == F.col("lang_pred"), 1)), F.count("*")).first()
    assert right / total >= 0.97


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    got = entry.queries()["op8_toxicity"](spark, sf).where("held_out")
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("toxic IS NOT NULL").select("score", "toxic").collect()
    one, zero = [r[0] for r in rows if r[1] == 1], sorted(r[0] for r in rows if r[1] == 0)
    import bisect

    area = sum((bisect.bisect_left(zero, x) + bisect.bisect_right(zero, x)) / 2 for x in one) / (len(one) * len(zero))
    assert area >= 0.94


def test_spans_give_every_document(spark):
    """Documents that repeat nothing come back as they are."""
    from gridloom.llm.substrings import op10_sentence_spans

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in op10_sentence_spans(spark, SF).collect()}
    assert got.keys() == docs.keys() and any(r["n_removed"] for r in got.values())
    assert all(r["clean_text"] == docs[k] for k, r in got.items() if not r["n_removed"])
