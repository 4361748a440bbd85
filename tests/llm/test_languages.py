"""Languages of one script, and texts in no learned language."""

import os
import random

import pytest

from tidewatch.llm import language

DATA = "/root/testdata/sf0.01"


def _prose(draw: random.Random, pool: list[str], words: int, gap: str = " ") -> str:
    return gap.join("".join(draw.choice(pool) for _ in range(draw.randint(1, 3))) for _ in range(words))


def test_two_languages_of_one_script_beside_long_latin_texts(spark):
    draw = random.Random(3)
    latin = {lang: [a + b for a in draw.sample("bcdfghjklmnprstvwz", 9) for b in "aeiou"] for lang in ("xa", "xb")}
    signs = [chr(0x4E00 + i) for i in draw.sample(range(20000), 400)]
    # beyond the letters of the longer texts, and half of the signs in both languages
    latin["xa"] += [chr(c) for c in range(0xE0, 0x120)]
    han = {"ya": signs[:300], "yb": signs[100:]}
    rows = [(lang, _prose(draw, pool, 300)) for lang, pool in latin.items() for _ in range(40)]
    rows += [(lang, _prose(draw, pool, 40, "")) for lang, pool in han.items() for _ in range(40)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.fit(docs.filter("doc_id % 4 <> 0"))
    held = [(lang, t) for i, (lang, t) in enumerate(rows) if i % 4 == 0]
    got = model.predict([t for _, t in held])[0]
    assert sum(g == lang for g, (lang, _) in zip(got, held)) >= 0.95 * len(held)
    # the plane of a sign counts
    assert language._grams(language._symbols("\U00010330"))[0].tolist() != language._grams(language._symbols("\U00010331"))[0].tolist()


def test_ngrams_across_stretches(monkeypatch):
    text = "abcabcab xyz 12" * 9
    want = language._grams(language._symbols(text))
    monkeypatch.setattr(language, "STRETCH", 7)
    got = language._grams(language._symbols(text))
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist() and want[1].sum() == 3 * len(text) - 3


STRANGE = [
    "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita. Ahi quanto a dir qual era è cosa dura",
    "Litwo, Ojczyzno moja! ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. Dziś piękność twą w całej ozdobie",
    "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Все смешалось в доме Облонских",
    "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    _prose(random.Random(1), list("abcdefghijklmnopqrstuvwxyz"), 80),
    _prose(random.Random(2), list("bcdfghjklmnpqrstvwxz"), 300),
]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_texts_in_no_learned_language_go_and_labelled_ones_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id", "text", "lang")
    strange = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(STRANGE)], "doc_id long, text string, lang string")
    # a fifth of the rows come without their label
    hidden = docs.selectExpr("doc_id", "text", "if(doc_id % 5 = 0, null, lang) AS lang")
    kept = {r.doc_id for r in language.known_language(hidden.union(strange)).select("doc_id").collect()}
    assert not {i for i in kept if i < 0}
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(kept) >= 0.99 * len(ids) and len([i for i in kept if i % 5 == 0]) >= 0.98 * len([i for i in ids if i % 5 == 0])
