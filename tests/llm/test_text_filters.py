"""op1, op3 and op6 on small texts, against plain versions and held-out labels."""

import random
import unicodedata
from collections import Counter, defaultdict

import pytest

from pagestrata.llm import op1_lines, op3_leaks
from pagestrata.llm.op1_lines import templates, without_boilerplate
from pagestrata.llm.op3_leaks import leaks
from pagestrata.llm.op6_language import UNKNOWN, Model, features, languages

from .helpers import LONG, ask, docs
from .test_near import brute_jaccard

# -- op1 --


def plain_templates(line):
    tokens = ["<*>" if any(unicodedata.category(c)[0] == "N" for c in t) else t for t in line.split()]
    n = len(tokens)
    if not any(unicodedata.category(c)[0] == "L" for t in tokens if t != "<*>" for c in t):
        return set()
    rest = n - 2
    if n < 5:
        return {tuple(tokens)}
    if n < 12:
        return {(n, i, *tokens[:i], *tokens[i + 1 :]) for i in range(2, n)}
    edges = [2 + rest * i // 4 for i in range(5)]
    return {(n, *tokens[:2], *((i, *tokens[edges[i] : edges[i + 1]]) for i in pair)) for pair in ((0, 1), (2, 3), (0, 2), (1, 3))}


def plain_lines(texts, min_docs=3, min_docs_long=2, copies_once=True, copy_share=0.5):
    """(text, lines, dropped) of each text, by comparing everything with everything."""
    distinct = {t for t in texts if t}
    own = {t: [plain_templates(line) for line in t.split("\n")] for t in distinct}

    def dropped(origin):
        seen = defaultdict(set)
        for t in distinct:
            for line, made in zip(t.split("\n"), own[t]):
                for m in made:
                    seen[m, len(line.split()) >= 50].add(origin(t))
        return {t: {i for i, line in enumerate(t.split("\n")) if any(len(seen[m, len(line.split()) >= 50]) >= (min_docs_long if len(line.split()) >= 50 else min_docs) for m in own[t][i])} for t in distinct}

    gone = dropped(lambda t: t)
    if copies_once:
        alike = sorted(t for t in distinct if gone[t] and sum(len(t.split("\n")[i].split()) for i in gone[t]) >= copy_share * len(t.split()))
        group = {t: g for t, (_, _, g) in zip(alike, brute_jaccard(alike)[0])}
        first, gone = gone, dropped(lambda t: group.get(t, t))
        gone = {t: gone[t] & first[t] for t in distinct}
    return [(None, 0, "") if t is None else ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(t, ())), t.count("\n") + 1, ",".join(map(str, sorted(gone.get(t, ()))))) for t in texts]


def line_texts():
    draw = random.Random(6)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    notice = "Page 17 of 90 was printed on 2024-05-01 by user 4711"
    passage, rare = (" ".join(draw.choices(words, k=k)) for k in (45, 70))
    texts = []
    for i in range(60):
        lines = [" ".join(draw.choices(words, k=draw.randint(1, 40))) for _ in range(draw.randint(2, 8))]
        if i % 4 == 0:
            lines.insert(draw.randrange(len(lines)), notice.replace("17", str(i)).replace("4711", str(i * 7)))
        if i % 6 == 0:
            own = passage.split()
            own[40], own[15] = draw.choice(words), draw.choice(words)
            lines.append(" ".join(own))
        if i % 5 == 0:
            lines.append(f"Posted by {draw.choice(words).title()} in the forum")
        if i in (7, 11):
            lines.insert(1, rare)
        if i % 3 == 0:
            lines.append(draw.choice(["Share this", "* * *", "12", "Read 4 more"]))
        texts.append("\n".join(lines))
    near = ["\n".join([texts[2], texts[3], texts[9], extra]) for extra in ("", "one more line", "and another line here")]
    return [*texts, *near, texts[1], texts[1], texts[1], None, "", LONG, LONG + "x", "\n\n", notice]


@pytest.mark.parametrize("limit, copies_once", [(op1_lines.BROADCAST_ROWS, True), (0, True), (op1_lines.BROADCAST_ROWS, False)])
def test_lines(spark, monkeypatch, limit, copies_once):
    monkeypatch.setattr(op1_lines, "BROADCAST_ROWS", limit)
    texts = line_texts()
    want = sorted(((i, *row) for i, row in enumerate(plain_lines(texts, copies_once=copies_once))), key=repr)
    assert sum(bool(r[3]) for r in want) >= 40
    assert ask(without_boilerplate(docs(spark, texts, clash=True), copies_once=copies_once), "doc_id", "text", "n_lines", "dropped") == want


def test_fields_share_a_template():
    for a, b in (
        ("Error 3 at line 9: cannot open the file named x1.txt", "Error 77 at line 12: cannot open the file named y2.txt"),
        ("Posted by Alice in General on Monday", "Posted by Bob in General on Monday"),
        ("The opening hours of the museum on Monday are from ten to five as always", "The opening hours of the theatre on Sunday are from ten to five as always"),
    ):
        assert set(templates(a)[0]) & set(templates(b)[0])
    assert templates("* * *") == ([], 3) and templates("") == ([], 0) and templates("12 34")[0] == []
    assert not set(templates("Posted by Alice in General on Monday")[0]) & set(templates("Posted by Bob in Sports on Monday")[0])


def test_lines_edge_cases(spark):
    line = "the same line of enough words"
    rows = [(None, f"own words come first {i}here always {i}{i}\n{line}") for i in "abc"]
    kept = ask(without_boilerplate(docs(spark, rows)), "doc_id", "n_dropped")
    assert kept == [(None, 1)] * 3
    assert without_boilerplate(docs(spark, ["x"]).limit(0)).count() == 0


# -- op3 --


def plain_leaks(texts, items):
    def cut(text):
        words, now = [], ""
        for c in (text or "").lower() + " ":
            if c.isalnum():
                now += c
            elif now:
                words.append(now)
                now = ""
        return words

    def grams(words):
        return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]

    found = {}
    for d, text in texts:
        words = cut(text)
        for k, item in items:
            own = cut(item)
            if item is None or len(own) < 5:
                continue
            want = Counter(grams(own))
            for start in range(max(1, len(words) - 4)):
                window = Counter(grams(words[start : start + len(own)]))
                total = sum((window | want).values())
                s = sum((window & want).values()) / total if total else 0
                if s >= 0.8 and s >= found.get((d, k), (0, 0))[0]:
                    found[d, k] = (s, start)
    return sorted(((d, k, round(s, 9), start) for (d, k), (s, start) in found.items()), key=repr)


@pytest.mark.parametrize("limit", [op3_leaks.BROADCAST_ROWS, 0])
def test_leaks(spark, monkeypatch, limit):
    monkeypatch.setattr(op3_leaks, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(op3_leaks, "BROADCAST_TEXTS", limit)
    draw = random.Random(8)
    words = [chr(97 + i % 26) + chr(97 + i // 26) for i in range(120)]
    items = [(i, " ".join(draw.choices(words, k=draw.choice((5, 8, 20, 45))))) for i in range(7)] + [(7, " ".join(draw.choices(words, k=100)))]
    items += [(90, "too short"), (91, None), (92, ""), (3, items[3][1])]
    texts = []
    for i in range(60):
        own = draw.choices(words, k=draw.randint(0, 120))
        if i % 2 == 0:
            leak = draw.choice(items[:8])[1].split()
            for _ in range(draw.choice((0, 0, 0, 1, 2))):
                leak[draw.randrange(len(leak))] = draw.choice(words)
            kind = draw.random()
            if kind < 0.2:
                leak = leak[1:]
            elif kind < 0.4:  # rotated, or split by other words
                half = draw.randrange(len(leak))
                leak = leak[half:] + leak[:half] if kind < 0.3 else leak[:half] + draw.choices(words, k=draw.randint(1, 4)) + leak[half:]
            at = draw.randint(0, len(own))
            own[at:at] = [w.upper() + "," for w in leak]
        texts.append((i, " ".join(own)))
    long = items[7][1].split()
    texts += [(64 + k, " ".join([*own[:9], *long[k:], *draw.choices(words, k=k % 3), *long[:k], *own[:9]])) for k in range(2, 40, 7)]
    texts += [(60, None), (61, ""), (62, LONG), (63, f"before {items[0][1]}"), (63, f"before {items[0][1]}")]
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, shingles int")
    got = [(d, k, round(s, 9), start) for d, k, s, start in ask(leaks(docs(spark, texts, clash=True), benchmark), "doc_id", "item_id", "similarity", "start")]
    want = plain_leaks(texts, items)
    assert len(want) >= 15 and sorted(got, key=repr) == want


def test_leaks_edge_cases(spark):
    kind = "item_id bigint, text string"
    items = spark.createDataFrame([(1, "one two three four five six")], kind)
    got = ask(leaks(docs(spark, [(None, "zero one two three four five six seven"), (4, "none of it")]), items), "doc_id", "item_id", "start", "n_words", "similarity")
    assert got == [(None, 1, 1, 6, 1.0)]
    assert leaks(docs(spark, ["x"]).limit(0), items).count() == 0
    assert leaks(docs(spark, ["one two three four five six"]), spark.createDataFrame([], kind)).count() == 0


# -- op6 --

SOUNDS = {"en": "th er ing ed the and of to in", "de": "sch ein ich ung der die und zu ge", "es": "ción ado que los el la mente ar os", "fr": "eau eux ment que le la les é oi", "xx": "zk vk prr tlz qk"}


def spoken(draw, lang, n):
    parts = SOUNDS[lang].split()
    return " ".join("".join(draw.choices(parts, k=draw.randint(1, 3))) for _ in range(n)).capitalize() + "."


def test_languages(spark):
    draw = random.Random(9)
    langs = [draw.choice(list(SOUNDS)) for _ in range(400)]
    rows = [(i, spoken(draw, lang, draw.randint(8, 60)), lang, "s", 1) for i, lang in enumerate(langs)]
    rows += [(900, None, "en", "s", 0), (901, "", None, "s", 0), (902, "12 + 34 = 46 !!", "de", "s", 0), (None, spoken(draw, "fr", 30), "fr", "s", 0), (903, LONG, None, "s", 0), (904, "ab", "en", "s", 0), (904, "ab", "en", "s", 0)]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, held_out int, LANG string")
    got = {r["doc_id"]: r for r in languages(table, per_language=40).collect()}
    for i in (900, 901, 902):
        assert got[i]["lang_pred"] == UNKNOWN and got[i]["score"] == 0
    assert got[None]["held_out"] is False and got[None]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(400) if got[i]["held_out"]]
    assert 40 < len(held) < 130
    assert sum(got[i]["lang_pred"] == langs[i] for i in held) >= 0.95 * len(held)
    assert languages(table, per_language=40).count() == len(rows)
    assert languages(table.limit(0)).count() == 0


def test_nothing_to_learn_from(spark):
    table = docs(spark, ["some words", None]).drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert ask(languages(table), "doc_id", "lang_pred", "score") == [(0, UNKNOWN, 0.0), (1, UNKNOWN, 0.0)]


def test_one_language_and_whole_texts():
    import numpy as np

    model = Model.fit(["en", "en"], np.stack([features("the and"), features("of to")]))
    assert model.predict("anything at all") == ("en", 1.0)
    a, b = features("x" * 50_000 + " the end"), features("x" * 50_000)
    assert not np.allclose(a, b)
    counts = defaultdict(int)
    counts[features("Ärger") is None] += 1
    assert counts == {False: 1}
