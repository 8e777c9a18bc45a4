"""The registered queries of the corpus operators on the smallest tables: against their SQL, or a plain version."""

import hashlib
import os
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagestrata.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import plain

from .helpers import ask
from .test_secrets import base
from .test_text_filters import plain_lines
from .test_tokens import check_groups, check_packing

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def rows(table, columns):
    return duckdb.execute(f"SELECT {columns} FROM '{DATA}/{table}.parquet' ORDER BY 1").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got = QUERIES[name](spark, DATA)
    cursor = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()), key=repr)
    assert want and sorted((tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()), key=repr) == want


def test_op1(spark):
    docs = rows("documents", "doc_id, text")
    want = plain_lines([t for _, t in docs])
    digest = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    found = sorted(((d, n, dropped, digest(t)) for (d, _), (t, n, dropped) in zip(docs, want)), key=repr)
    assert any(r[2] for r in found)
    assert ask(QUERIES["op1_line_templates"](spark, DATA), "doc_id", "n_lines", "dropped", "kept_sha256") == found


def test_op5(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = [(d, len((t or "").encode()), n, n > 2048) for d, t in rows("documents", "doc_id, text") for n in [len(library.encode(t or "", add_special_tokens=False).ids)]]
    assert ask(QUERIES["op5_token_counts"](spark, DATA), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_op6(spark):
    docs = {d: (t, lang) for d, t, lang in rows("documents", "doc_id, text, lang")}
    got = {r["doc_id"]: r for r in QUERIES["op6_languages"](spark, DATA).collect()}
    assert got.keys() == docs.keys()
    learned = {lang for _, lang in docs.values() if lang}
    right = Counter()
    for d, (text, lang) in docs.items():
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= got[d]["score"] <= 1
        assert (got[d]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) and got[d]["lang_pred"] in learned | {"und"}
        if got[d]["held_out"] and lang:
            right[got[d]["lang_pred"] == lang] += 1
    assert right[True] >= 0.95 * right.total()
    again = {r["doc_id"]: r for r in QUERIES["op6_languages"](spark, DATA).collect()}
    assert again == got


def test_op7(spark):
    found = {r["doc_id"]: r for r in QUERIES["op7_secret_spans"](spark, DATA).collect()}
    for d, text in rows("documents", "doc_id, text"):
        want = [f"{kind}:{a}:{b}" for a, kind, b in base(text or "")]
        listed = found[d]["spans"].split(",") if found[d]["spans"] else []
        assert [s for s in listed if not s.startswith("random")] == want and len(listed) - len(want) == found[d]["n_random"]
        assert found[d]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [found[d][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")]
    assert sum(bool(r["spans"]) for r in found.values()) > 3


def test_op8(spark):
    found = QUERIES["op8_packed_sequences"](spark, DATA).collect()
    assert check_packing(found, dict(rows("documents", "doc_id, text")), public_tokenizers.path("byte_bpe_50k.json")) <= 2048 * 8
    check_groups(found)
