"""Cases that a review found cut short."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from pagestrata.llm import op9_jaccard
from pagestrata.llm.common import Scratch
from pagestrata.llm.op1_lines import without_boilerplate
from pagestrata.llm.op3_leaks import leaks

from .helpers import DOCS, ask, docs
from .test_near import brute_jaccard, near_copies
from .test_text_filters import plain_leaks, spoken

WORDS = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]


def test_copies_keep_their_lines_and_bearers_do_not(spark):
    draw = random.Random(3)
    shared = [" ".join(draw.choices(WORDS, k=30)) for _ in range(2)]
    own = [" ".join(draw.choices(WORDS, k=k)) for k in (40, 41, 42)]
    copied = "\n".join(" ".join(draw.choices(WORDS, k=20)) for _ in range(4))
    # 60 of about 100 tokens recur, but no document is like another
    texts = [*("\n".join([*shared, x]) for x in own), "\n".join(shared), copied, copied, copied + " more", None, ""]
    got = ask(without_boilerplate(docs(spark, texts, clash=True)), "doc_id", "text", "n_dropped", "dropped")
    want = [(i, x, 2, "0,1") for i, x in enumerate(own)] + [(3, "", 2, "0,1")]
    want += [(4, copied, 0, ""), (5, copied, 0, ""), (6, copied + " more", 0, ""), (7, None, 0, ""), (8, "", 0, "")]
    assert got == want


def test_language_rejects_what_was_never_learned(spark):
    draw = random.Random(5)
    rows = [(i, "\n".join(spoken(draw, lang, 40) for _ in range(2)), lang) for i, lang in enumerate(["en", "de", "es", "fr"] * 40)]
    known = {r[0] for r in rows} | {800}
    rows += [(800, spoken(draw, "de", 3), None)]
    rows += [(900, spoken(draw, "xx", 80), None)]
    rows += [(901 + i, " ".join("".join(draw.sample(w, len(w))) for w in "".join(draw.sample(rows[i][1], len(rows[i][1]))).split()), None) for i in range(4)]
    rows += [(910, "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.", None)]
    table = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], DOCS)
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, table, "").select("doc_id").collect()} == known


def test_leaks_with_inserted_words(spark):
    draw = random.Random(4)
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in (58, 60, 64, 66, 80)]
    texts = []
    for i in range(30):
        own = draw.choice(items)[1].split() if i >= 5 else items[i][1].split()
        for _ in range(draw.choice((1, 2, 3)) if i >= 5 else 0):
            own.insert(draw.randrange(len(own)), "in")
        own[0], own[-1] = "other", "words"
        half = len(own) // 2
        if i < 5:
            own[half:half] = ["in", "between"]
        elif i % 5 == 0:
            own = own[half:] + own[:half]
        texts.append((i, " ".join(draw.choices(WORDS, k=draw.choice((0, 9)))) + " " + " ".join(own) + " and so on and on"))
    want = plain_leaks(texts, items)
    assert {(i, n) for i, (n, _) in enumerate(items[:4])} <= {w[:2] for w in want}
    got = ask(leaks(docs(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")), "doc_id", "item_id", "similarity", "start")
    assert [(d, k, round(x, 9), start) for d, k, x, start in got] == want


def test_texts_are_not_dealt_out_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(op9_jaccard, "BROADCAST_ROWS", 0)
    plans, keep = [], Scratch.__call__

    def seen(self, df, now=False):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df, now)

    monkeypatch.setattr(Scratch, "__call__", seen)
    texts = near_copies(seed=7)
    want, links = brute_jaccard(texts)
    assert links
    assert ask(op9_jaccard.jaccard_components(docs(spark, texts)), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    assert plans and not any("Exchange" in p or "Join" in p for p in plans)


def test_marks_miss_no_row(monkeypatch):
    rows = np.random.default_rng(8).integers(-(1 << 63), 1 << 63, 3000)
    for most in (op9_jaccard.MOST_MARKS, 11):
        monkeypatch.setattr(op9_jaccard, "MOST_MARKS", most)
        marks = op9_jaccard.marks_of(rows[:1000])
        assert op9_jaccard.marked(rows[:1000], marks).all()
    assert op9_jaccard.marked(rows[1000:], op9_jaccard.marks_of(rows[:0])).sum() == 0


def test_near_duplicates_lets_shuffles_go_before_texts_are_dealt_out(spark, monkeypatch):
    done, save, clear = [], corpus_pipeline.saved, corpus_pipeline.cleared
    monkeypatch.setattr(corpus_pipeline, "saved", lambda df, name: (save(df, name), done.append(name))[0])
    monkeypatch.setattr(corpus_pipeline, "cleared", lambda s: (clear(s), done.append("cleared"))[0])
    made = corpus_pipeline.near_duplicates(spark, docs(spark, ["a b c d e f", "a b c d e f", "other words", None]), "")
    assert done == ["groups", "cleared"]
    assert ask(made, "doc_id") == [(0,), (2,), (3,)]


def none_frequent() -> tuple[np.ndarray, np.ndarray]:
    return np.empty(0, np.uint64), np.empty(0, np.int32)


def test_shingles_met_by_chance_make_no_pairs(spark):
    draw = random.Random(11)
    own = lambda k: " ".join(f"w{draw.randrange(10**9)}" for _ in range(k))
    texts = []
    for _ in range(60):
        shared = own(5)
        texts += [f"{own(4)} {shared} {own(3)}" for _ in range(2)]
    copy = own(40)
    texts += [copy, copy + " more"]
    keyed = docs(spark, texts).select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    assert op9_jaccard.candidate_pairs(keyed, *none_frequent(), 80).count() == 1


def test_similar_sets_have_several_first_keys_in_common():
    draw = np.random.default_rng(12)
    for percent in (50, 80, 90):
        common = op9_jaccard.common_keys(percent)
        for n in [*range(1, 40), 200]:
            a = draw.choice(1 << 40, n + 40, replace=False).astype(np.uint64)
            for out in range(1, n + 1):
                x, y = np.sort(a[:n]), np.sort(a[out // 2 : n + (out + 1) // 2])
                both = len(np.intersect1d(x, y))
                if 100 * both < percent * len(np.union1d(x, y)) or (x.size == y.size and (x == y).all()):
                    continue
                late = np.sort(draw.choice(a, 10, replace=False))
                first = [op9_jaccard.prefix(s, late, percent, common) for s in (x, y)]
                assert len(np.intersect1d(*first)) >= common


def test_shingles_rare_in_every_block_but_not_in_the_table_are_frequent(spark, monkeypatch):
    monkeypatch.setattr(op9_jaccard, "BLOCK_HASHES", 1)
    draw = random.Random(13)
    texts = ["this is said in all texts " + " ".join(f"w{draw.randrange(10**9)}" for _ in range(3)) for _ in range(400)]
    keyed = docs(spark, texts).select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    hashes, parts = op9_jaccard.frequent_hashes(op9_jaccard.members(keyed), keyed, 80)
    assert set(op9_jaccard.Shingler().hashes("this is said in all texts").tolist()) & set(hashes.tolist())


def test_near_duplicates_deals_out_few_texts(spark, monkeypatch):
    draw = random.Random(14)
    monkeypatch.setattr(op9_jaccard, "MARKS", 4096)
    texts = [" ".join(draw.choices(WORDS, k=20)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(400, texts[0]), (5, texts[5]), (5, texts[5]), (None, texts[6]), (None, ""), (None, ""), (401, None), (402, texts[7] + " more")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    want = {(i, t) for i, t in enumerate(texts)}
    made = corpus_pipeline.near_duplicates(spark, table, "")
    got = [tuple(r) for r in made.select("doc_id", "text").collect()]
    assert sorted(got, key=repr) == sorted([*want, (None, ""), (None, ""), (401, None)], key=repr)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plain = corpus_pipeline.near_duplicates(spark, table, "")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    unmarked = plain.split("\n:- ")[1]
    assert plain.startswith("Union") and "ArrowEvalPython" in unmarked and "Exchange" not in unmarked
