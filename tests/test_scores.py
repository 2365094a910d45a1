"""The evaluation queries on rows of their own, empty texts among them."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from check import compare

from __spark_entry__ import oracle_sql, queries

TEXTS = {"de": "für ü und mehr", "en": "the thing with them", "es": "canción y razón", "fr": "été né clé"}
KEYS = (
    "auc_by_class", "best_f1_threshold", "classification_metrics", "confusion_matrix", "log_loss_accuracy", "model_leaderboard", "roc_points",
    "thresholded_predictions", "weighted_eval",
)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    to = tmp_path_factory.mktemp("scores")
    langs = [*TEXTS] * 6
    texts = [TEXTS[x] + " th ü" * (i % 3) + " word" * i for i, x in enumerate(langs)]
    langs, texts = [*langs, "en", "fr", "de"], [*texts, "", "", ""]
    ids = list(range(len(texts)))
    pq.write_table(pa.table({"doc_id": ids, "text": texts, "lang": langs, "n_chars": [len(t) for t in texts]}), to / "documents.parquet")
    pq.write_table(pa.table({"doc_id": ids[::2], "quality": [i % 2 for i in ids[::2]]}), to / "labels.parquet")
    return str(to)


@pytest.mark.parametrize("key", KEYS)
def test_empty_texts(spark, tables, key):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    assert compare(queries()[key](spark, tables), con, oracle_sql()[key]) is None
