"""The pipeline against a brute-force run of its stages, and the guard of the entry module."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import tiktoken
from test_operators import VOCABULARY, brute_leaks, brute_lines, brute_near, brute_quality, hashlib, planted, prose, random

import corpus_pipeline
from lexiqua.llm import bpe, lines
from lexiqua.llm.lines import MIN_SITES

ROOT = Path(__file__).resolve().parents[2]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(13)
    items = [(i, prose(30, rng)) for i in range(3)]
    rows = [(d, t, f"s{d % 11}") for d, t in planted(rng) if t is None or len(t.split()) < 200]
    top = max(d for d, *_ in rows) + 1
    shared = prose(9, rng)
    for k in range(24):
        extra = f"\n{items[k % 3][1]}" if k % 6 == 0 else ""
        rows.append((top + k, f"{prose(70, rng)}\n{shared}\n{prose(20, rng)}{extra}", f"s{k % 11}"))
    rows.append((top + 30, "again and again " * 40, "s1"))
    frame = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = [r for r in rows if brute_quality(r[1] or "")[6]]
    source = {d: s for d, _, s in rows}
    # documents that lost every worded line are dropped
    worded = {d for d, t, _ in kept if (t or "").split()}
    cleaned = [(d, t) for d, t in brute_lines(kept, MIN_SITES) if (t or "").split() or d not in worded]
    near = brute_near(cleaned)
    single = [(d, t) for d, t in cleaned if near[d][2]]
    leaked = {d for d, _ in brute_leaks(single, items)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})
    want = {}
    for d, t in single:
        if d not in leaked:
            ids = library.encode_ordinary(t)
            want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got == want and leaked and len(single) < len(cleaned) < len(rows) and source


def test_copies_over_many_sources_leave_one_document(spark, tmp_path):
    rng = random.Random(17)
    text = "\n".join(prose(30, rng) for _ in range(4))
    own = {100 + k: prose(30, rng) for k in range(2)}
    rows = [(d, text, f"s{d % 12}") for d in range(36)] + [(d, f"{text}\n{line}", f"s{d % 12}") for d, line in own.items()]
    rows += [(200, None, "s1"), (201, " \n\t", "s2"), (202, prose(60, rng), "s3")]
    frame = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, prose(30, rng))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    cleaned = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, frame, str(tmp_path)).collect()}
    # blank rows had no word to lose; near copies keep the line of their own
    assert cleaned == {0: text, **own, **{d: t for d, t, _ in rows if d >= 200}}
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {d for d in got if d < 36} == {0}
    kept = lines.without_boilerplate(frame).collect()
    assert len(kept) == len(rows) and sum(r["text"] == "" for r in kept) == 35


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, clashing extra columns, and then no row at all."""
    rng = random.Random(23)
    text, other = prose(80, rng), prose(90, rng)
    rows = [(1, text), (1, text), (2, text + " end"), (None, other), (None, prose(70, rng)), (3, None), (4, ""), (5, "few words"), (6, prose(3000, rng))]
    columns = "doc_id long, text string, lang string, source string, n_chars long, n long, kept string, `_gone` int, `key` string, sig int"
    frame = spark.createDataFrame([(d, t, None, None, None, 1, "k", 2, None, 3) for d, t in rows], columns)
    for name, part in (("full", frame), ("none", frame.limit(0))):
        part.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(0, prose(30, rng))], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 1), (False, 1), (False, 6), (True, 0), (True, 0)]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_every_stage_but_the_last_keeps_the_columns(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    for name, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, documents, small).schema.names == documents.columns, name


def test_entry_works_without_the_subpackage(tmp_path):
    (tmp_path / "lexiqua").mkdir()
    for path in (ROOT / "lexiqua").iterdir():
        if path.name != "llm":
            (tmp_path / "lexiqua" / path.name).symlink_to(path)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') and k[2].isdigit() for k in e.queries()), 'pipeline' in e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0 and out.stdout.split()[1:] == ["False", "False"], out.stderr


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "lexiqua").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in [w for line in path.read_text().splitlines() if line.startswith(("import ", "from ")) for w in line.replace(".", " ").split()], path
