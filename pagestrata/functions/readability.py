"""How hard a text is to read: LIX, Flesch, and the language that decides between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from .numbers import clamp, size
from .steps import bind, once
from .text import squeezed

VOWELS = "[aeiouyäöüáéíóúàèìòùâêîôûãõ]"
#: Vowel sounds of German inside a run of vowels.
GERMAN_NUCLEI = "ei|ai|au|eu|äu|ie|ey|ay|aa|ee|oo|[aeiouyäöü]"


def plain(block: Column) -> Column:
    """A block without tags."""
    return squeezed(F.regexp_replace(block, "<[^>]+>", " "))


#: A token that holds a vowel, one of them with more than six letters, digits and hyphens, and a sentence of a block.
WORD = rf"(?iu)(?<!\S)\S*?{VOWELS}\S*+"
LONG_WORD = rf"(?iu)(?<!\S)(?=\S*?{VOWELS})(?:[^\s\p{{L}}\p{{N}}-]*+[\p{{L}}\p{{N}}-]){{7}}\S*+"
SENTENCE = r"(?![.!?…]+(?:\s|\z))\S(?:(?![.!?…]+(?:\s|\z))[^\n])*+"
#: A word whose final e is silent in English: another vowel sound stands before it, and neither a vowel nor a consonant with l precedes.
SILENT = rf"(?<!\S)(?=\S*{VOWELS}[^\s{VOWELS[1:]}\S*e(?!\S))(?!\S*[aeiouy]e(?!\S))(?!\S*[^aeiouy\s]le(?!\S))\S++"


def joined(blocks: Column) -> Column:
    """Blocks without tags, a line each."""
    return F.array_join(F.transform(blocks, plain), "\n")


def counted(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def word_count(lines: Column) -> Column:
    """Tokens that hold a vowel. lines: as of joined."""
    return counted(lines, WORD)


def long_word_count(lines: Column) -> Column:
    return counted(lines, LONG_WORD)


def sentence_count(lines: Column) -> Column:
    """Sentences of all blocks; a block's end is one."""
    return counted(lines, SENTENCE)


def syllable_count(lines: Column, lang: str = "en") -> Column:
    """Runs of vowels in all words; German counts its vowel sounds, English drops a silent final e."""

    def counts(low: Column) -> Column:
        return counted(low, GERMAN_NUCLEI) if lang == "de" else counted(low, f"{VOWELS}+") - (counted(low, SILENT) if lang == "en" else 0)

    return bind(F.lower(F.regexp_replace(lines, r"[^\p{L}\p{N}\s-]", "")), counts)


def syllables(word: Column, lang: str = "en") -> Column:
    """Syllables of one word, at least one."""
    return F.when(F.char_length(word) == 0, 0).when(F.char_length(word) <= 2, 1).otherwise(F.greatest(syllable_count(word, lang), F.lit(1)))


def guessed_language(text: Column) -> Column:
    """de or en by function words, with five of them and twice as many as of the other; else null."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    de, en = size(F.filter(tokens, lambda t: t.isin(config.GERMAN_WORDS))), size(F.filter(tokens, lambda t: t.isin(config.ENGLISH_WORDS)))
    return F.when(de + en < 5, F.lit(None)).when(de >= en * 2, F.lit("de")).when(en >= de * 2, F.lit("en"))


def content_language(declared: Column, blocks: Column) -> Column:
    """The declared language, if it is one; else a guess from the text."""
    code = F.get(F.split(F.lower(F.trim(F.coalesce(declared, F.lit("")))), "[-_]"), 0)
    named = code.rlike("^[a-z]{2,3}$") & ~code.isin("und", "mul", "zxx", "mis")
    return F.when(named, code).otherwise(guessed_language(F.array_join(blocks, " ")))


def lix(words: Column, long_words: Column, sentences: Column) -> Column:
    return F.when((words > 0) & (sentences > 0), words / sentences + long_words * F.lit(100.0) / words)


def flesch(words: Column, sounds: Column, sentences: Column) -> Column:
    return F.when((words > 0) & (sentences > 0), clamp(F.lit(206.835) - F.lit(1.015) * (words / sentences) - F.lit(84.6) * (sounds / words), 0.0, 100.0))


def rated(lines: Column, english: Column) -> Column:
    """struct(score, raw, formula) of a text, raw null without a word. Flesch is for English, LIX for all else."""
    # counts are bound: the formulas mention each several times, and each mention would be a pass over the text
    counts = F.struct(word_count(lines).alias("words"), sentence_count(lines).alias("sentences"), F.when(english, syllable_count(lines)).otherwise(long_word_count(lines)).alias("hard"))
    raw = bind(counts, lambda c: F.when(english, flesch(c["words"], c["hard"], c["sentences"])).otherwise(lix(c["words"], c["hard"], c["sentences"])))
    score = lambda r: clamp(F.when(english, (r - 30) / F.lit(60.0)).otherwise((F.lit(65.0) - r) / F.lit(25.0)))
    return bind(raw, lambda r: F.struct(score(r).alias("score"), r.alias("raw"), F.when(english, F.lit("flesch")).otherwise(F.lit("lix")).alias("formula")))


def with_readability(df: DataFrame, blocks: Column, lang: Column, name: str = "readability") -> DataFrame:
    """Adds struct(score, raw, formula), null for less than 50 characters or no word.

    Words, sentences and sounds are counted in the joined text; no list of words is made.
    """
    step = [f"_{name}_{k}" for k in ("text", "english", "rated")]
    text, english, made = map(F.col, step)
    shown = F.array_join(F.filter(F.transform(blocks, squeezed), lambda b: b != ""), " ")
    long_enough = F.char_length(shown) >= 50
    df = once(df, {step[0]: F.when(long_enough, joined(F.filter(blocks, lambda b: squeezed(b) != ""))), step[1]: F.coalesce(lang == "en", F.lit(False))})
    df = once(df, {step[2]: F.when(text.isNotNull(), rated(text, english))})
    return df.withColumn(name, F.when(made["raw"].isNotNull(), made)).drop(*step)


def block_readability(block: Column, english: Column) -> Column:
    """struct(score, raw, formula) of one block, as with_readability tells it."""
    made = bind(plain(block), lambda line: rated(line, english))
    return F.when((F.char_length(squeezed(block)) >= 50) & made["raw"].isNotNull(), made)


def stats(blocks: Column) -> Column:
    """struct(words, sentences, longWords, syllables), syllables by English rules."""
    made = bind(joined(blocks), lambda t: F.struct(word_count(t).alias("words"), sentence_count(t).alias("sentences"), long_word_count(t).alias("longWords"), syllable_count(t).alias("syllables")))
    return F.when((made["words"] > 0) & (made["sentences"] > 0), made)


def raw_for_score(score: Column, formula: Column) -> Column:
    """The raw value at which a score is reached."""
    return F.when(formula == "lix", F.lit(65.0) - score * 25).otherwise(F.lit(30.0) + score * 60)


def band(raw: Column, formula: Column) -> Column:
    """Five bands from very easy to very hard."""
    names = ("very_easy", "easy", "medium", "hard")
    by_lix = F.when(raw < 30, names[0]).when(raw < 40, names[1]).when(raw < 50, names[2]).when(raw < 60, names[3]).otherwise("very_hard")
    by_flesch = F.when(raw >= 80, names[0]).when(raw >= 70, names[1]).when(raw >= 60, names[2]).when(raw >= 50, names[3]).otherwise("very_hard")
    return F.when(formula == "lix", by_lix).otherwise(by_flesch)
