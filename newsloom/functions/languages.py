"""Language codes, and a small detector for texts that declare none."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newsloom.functions.text import _col

# Names of languages and their codes.
NAMES = {
    "english": "en", "german": "de", "french": "fr", "spanish": "es", "italian": "it", "portuguese": "pt", "dutch": "nl",
    "arabic": "ar", "urdu": "ur", "chinese": "zh", "japanese": "ja", "russian": "ru", "hindi": "hi", "turkish": "tr",
}

#: Frequent words by language.
STOP_WORDS = {
    "en": "the of and to in that is for it with as was on be at by this are from",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas sur",
    "es": "de la que el en y los del se las por un para con no una su al lo como",
    "it": "di e il la che in un per è una sono non con del da si le dei al",
    "pt": "de a o que e do da em um para com não uma os no se na por mais",
    "nl": "de het een en van in is dat op te zijn voor met niet aan er om",
}
_TABLE = {w: [k for k, v in STOP_WORDS.items() if w in v.split()] for v in STOP_WORDS.values() for w in v.split()}
MIN_CHARS = 50
#: A word that several languages have counts its part of this for each.
WHOLE = 60


def normalize_language(value: Column | str) -> Column:
    """'en-US', 'en_GB' and 'English' to 'en'; what has no such form is NULL."""
    head = F.substring_index(F.replace(F.lower(F.trim(_col(value))), F.lit("_"), F.lit("-")), "-", 1)
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    code = F.coalesce(names[head], head)
    return F.when(code.rlike("^[a-z]{2,3}$"), code)


def guess(text: str | None) -> str | None:
    """The language whose frequent words are most in a text, of equals the first; None for short texts and no such words."""
    if not text or len(text) < MIN_CHARS:
        return None
    score = dict.fromkeys(STOP_WORDS, 0)
    for w in re.findall(r"\w+", text.lower()):
        for k in _TABLE.get(w, ()):
            score[k] += WHOLE // len(_TABLE[w])
    best = max(score, key=score.get)
    return best if score[best] else None


def frequent_words() -> list[tuple[str, str, int, int]]:
    """(word, language, what it counts, place of the language) of all frequent words."""
    order = list(STOP_WORDS)
    return [(w, k, WHOLE // len(found), order.index(k)) for w, found in sorted(_TABLE.items()) for k in found]


@F.pandas_udf(StringType())
def detect_language(text: pd.Series) -> pd.Series:
    return text.map(guess)
