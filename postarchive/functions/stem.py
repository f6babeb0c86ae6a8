"""English stemming of terms and of token arrays.

Spark has no stemmer, so this is the one place that runs Python: an Arrow UDF.  The
index stems its vocabulary: Python sees each different term once, and its stem is joined
back to the tokens.  The few tokens of queries are stemmed as arrays, where they stand.

The rules are those of M. F. Porter, "An algorithm for suffix stripping",
Program 14(3), 1980, with the two later changes ``bli`` -> ``ble`` and
``logi`` -> ``log``.
"""

from __future__ import annotations

import sys

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship the rules inside the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_BYTES, MAX_BYTES = 3, 64
CACHE_WORDS = 500_000

# The suffix tables of the paper's steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance",
    "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "",
}
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]
LONGEST_FIRST_2 = sorted(STEP_2, key=len, reverse=True)
LONGEST_FIRST_3 = sorted(STEP_3, key=len, reverse=True)
LONGEST_FIRST_4 = sorted(STEP_4, key=len, reverse=True)


def _shape(word: str) -> str:
    """The word as a string of ``v`` (vowel) and ``c`` (consonant)."""
    marks: list[str] = []
    for i, letter in enumerate(word):
        is_vowel = letter in "aeiou" or (letter == "y" and i > 0 and marks[-1] == "c")
        marks.append("v" if is_vowel else "c")
    return "".join(marks)


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _has_vowel(word: str) -> bool:
    return "v" in _shape(word)


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, suffixes: list[str], table: dict[str, str]) -> str:
    for suffix in suffixes:
        if word.endswith(suffix):
            root = word[: -len(suffix)]
            return root + table[suffix] if _measure(root) > 0 else word
    return word


def stem_word(word: str) -> str:
    if not MIN_BYTES <= len(word.encode()) <= MAX_BYTES:
        return word
    # 1a: plurals
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b: -eed, -ed, -ing
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double_consonant(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    # 1c: -y
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, LONGEST_FIRST_2, STEP_2)
    word = _swap(word, LONGEST_FIRST_3, STEP_3)
    # 4: remaining suffixes of longer words
    for suffix in LONGEST_FIRST_4:
        if word.endswith(suffix):
            root = word[: -len(suffix)]
            if _measure(root) > 1 and (suffix != "ion" or root.endswith(("s", "t"))):
                word = root
            break
    # 5: final -e and -ll
    if word.endswith("e"):
        root = word[:-1]
        if _measure(root) > 1 or (_measure(root) == 1 and not _short_end(root)):
            word = root
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


_cache: dict[str, str] = {}


def stem_distinct(words: list[str]) -> list[str]:
    """The stems of different words, remembered from call to call."""
    if len(_cache) > CACHE_WORDS:
        _cache.clear()
    for word in words:
        if word not in _cache:
            _cache[word] = stem_word(word)
    return [_cache[word] for word in words]


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems(token_arrays: pa.Array) -> pa.Array:
    """Stem every token of every array, keeping order and length."""
    lengths = pc.fill_null(pc.list_value_length(token_arrays), 0)
    offsets = pa.concat_arrays(
        [pa.array([0], pa.int32()), pc.cast(pc.cumulative_sum(lengths), pa.int32())]
    )
    encoded = pc.list_flatten(token_arrays).dictionary_encode()
    stemmed = pa.array(stem_distinct(encoded.dictionary.to_pylist()), pa.string())
    values = stemmed.take(encoded.indices)
    return pa.ListArray.from_arrays(offsets, values)


@F.arrow_udf(T.StringType())
def stem(words: pa.Array) -> pa.Array:
    """Stem every word of a column."""
    return pa.array([w if w is None else stem_word(w) for w in words.to_pylist()], pa.string())
