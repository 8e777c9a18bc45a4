"""The pipeline on a small corpus: each stage does its part and leaves clean documents alone."""

import random

import corpus_pipeline
import pytest

from pagestrata.llm.common import DOCUMENT_COLUMNS

from .helpers import docs


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(12)
    words = {lang: ["".join(draw.choices(parts, k=2)) for _ in range(300)] for lang, parts in {"en": ["th", "er", "ing", "wh", "ou"], "de": ["sch", "ein", "ich", "ung", "tz"]}.items()}

    def prose(lang, n):
        return " ".join(draw.choices(words[lang], k=n))

    item = prose("en", 40)
    notice = "This notice stands under many of the documents here."
    rows = [(i, "\n".join(prose(lang, 25) for _ in range(4)), lang) for i, lang in enumerate(["en", "de"] * 30)]
    rows += [(100 + i, f"{rows[i][1]}\n{notice}", "en") for i in range(0, 8, 2)]  # near copies with a notice
    rows += [(200 + i, "\n".join([prose("en", 30), notice, prose("en", 30)]), "en") for i in range(5)]
    rows += [(300, rows[1][1], "de"), (300, rows[1][1], "de"), (301, f"{prose('en', 20)} {item} {prose('en', 20)}", "en"), (302, "12 34 !!", "en"), (303, None, "en"), (304, "", None)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", 0) for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, template string, node int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, notice


def test_stages(spark, corpus, tmp_path):
    folder, rows, notice = corpus
    now = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, now, folder)
        made.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = now
        if k < 4:
            assert tuple(now.columns) == DOCUMENT_COLUMNS
    ids = {name: sorted(r["doc_id"] for r in df.select("doc_id").collect()) for name, df in seen.items()}
    clean = set(range(60)) | {200, 201, 202, 203, 204}
    assert set(ids["language"]) == clean | {100, 102, 104, 106, 300, 301}
    assert ids["lines"] == ids["language"]
    assert not any(notice in (r["text"] or "") for r in seen["lines"].where("doc_id BETWEEN 200 AND 204").collect())
    assert all(r["n_chars"] == len(r["text"]) for r in seen["lines"].collect())
    assert ids["near_duplicates"] == sorted(clean | {301})
    assert ids["decontamination"] == sorted(clean)
    pieces = seen["packing"].collect()
    assert {r["doc_id"] for r in pieces} == clean


def test_run_and_empty_tables(spark, corpus, tmp_path):
    folder, rows, _ = corpus
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == set(range(60)) | {200, 201, 202, 203, 204}
    docs(spark, ["x"]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
