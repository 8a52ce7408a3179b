"""Finnish words without their endings, so that inflected forms of a word meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is cut off, step by step: of the endings of a step the longest that leaves so many letters at least.
STEPS = [
    (4, ["kin", "kaan", "kään", "ko", "kö", "han", "hän", "pa", "pä"]),
    (4, ["nsa", "nsä", "ni", "si", "mme", "nne", "ksi", "iksi"]),
    (
        3,
        ["issa", "issä", "ista", "istä", "illa", "illä", "ilta", "iltä", "ille", "iksi", "itta", "ittä", "ina", "inä", "ihin", "isiin", "iden", "itten", "ia", "iä", "ien"]
        + ["ssa", "ssä", "sta", "stä", "lla", "llä", "lta", "ltä", "lle", "ksi", "tta", "ttä", "na", "nä", "seen", "hun", "hyn", "hon", "hen", "hin", "den", "tten"]
        + ["aan", "ään", "oon", "öön", "uun", "yyn", "een", "iin", "ta", "tä", "en", "an", "än", "on", "ön", "un", "yn", "in", "at", "ät", "et", "it", "ot", "öt", "ut", "yt", "n", "t"],
    ),
    (3, ["[aeiouyäö]+"]),
    (3, ["oj", "öj", "uj", "yj"]),
]
#: Shorter words are left as they are.
LEAST = 4


def ending(least: int, endings: list[str]) -> str:
    """The pattern whose first group is what stays. The shortest beginning leaves the longest ending."""
    return rf"^(\p{{L}}{{{least},}}?)(?:{'|'.join(endings)})$"


def stem(word: Column) -> Column:
    """A lower-case word without clitics, possessive and case endings and the vowels that change before these. Words with
    other signs than letters and short words stay."""
    out = word
    for least, endings in STEPS:
        out = F.regexp_replace(out, ending(least, endings), "$1")
    return F.when(F.length(word) < LEAST, word).otherwise(out)


def stems(words: Column) -> Column:
    return F.transform(words, stem)
