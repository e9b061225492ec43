import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, component_id string, key string"

_WORDS = {
    "en": "the and of with that from this they their have which were would there about when".split(),
    "de": "der und die nicht das ist ein von auch sich mit dass werden über für größe".split(),
    "fr": "le et les dans une pour que qui être avec plus très même où déjà leurs".split(),
}


def rows(n: int = 60, seed: int = 1) -> list[tuple]:
    """Documents with copies, near copies, nulls, empty, blank and very long texts, and clashing extra columns."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(_WORDS))
        text = " ".join(rng.choice(_WORDS[lang]) for _ in range(rng.randint(40, 90))) + "."
        if i % 5 == 4:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        out.append((i, text, lang, "s"))
    odd = [None, "", " \n\t ", "1234 !!", "🙂", "a\0b", "  two  blanks \n\n lines", "word " * 30_000, "x" * 100_000, out[0][1], out[0][1], out[1][1] + " extra"]
    out += [(1000 + i, t, None, None) for i, t in enumerate(odd)]
    out += [out[3], (None, "text without an id", "en", None), (None, None, None, None)]
    return [(a, t, lang, s, len(t or ""), "clash", "clash", "clash", None) for a, t, lang, s in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    made = [(i, int(i % 5 != 4), 0) for i in range(60)] + [(None, 1, 0), (5, None, 0), (5, 7, 0), (99999, 1, 1), (6, 1, 0)]
    return spark.createDataFrame(made, "doc_id long, quality int, toxic int")
