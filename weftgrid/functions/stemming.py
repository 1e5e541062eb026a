"""English (Porter2) stemming, once per distinct word of a batch.

The words of an Arrow batch are dictionary-encoded, so a word is stemmed once
however often it occurs, and a bounded memory carries stems from batch to batch.
Nothing is shuffled and no vocabulary is collected.  (The same steps as lambdas over
``transform`` stay in the JVM but cost about fifteen times as much.)
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the published Snowball English algorithm.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STOP_AFTER_1A = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
R1_PREFIXES = ["gener", "commun", "arsen"]
DOUBLES = ["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"]
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble",
    "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "", "ative": "",
}
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous",
    "ive", "ize", "ion",
]
LI_ENDINGS = "cdeghkmnrt"

REMEMBERED = 200_000  # stems a task keeps

# The functions travel with the query: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FIRST_REGION = re.compile(rf"{'|'.join(R1_PREFIXES)}|.*?[aeiouy][^aeiouy]")
_NEXT_REGION = re.compile(r".*?[aeiouy][^aeiouy]")
_CONSONANT_Y = re.compile(r"(^|[aeiouy])y")
_VOWEL = re.compile(r"[aeiouy]")
_PLURAL = re.compile(r"[aeiouy].+s$")
_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_FINAL_Y = re.compile(r".[^aeiouy][yY]$")


def _longest(*suffixes: str) -> re.Pattern:
    """The leftmost match at the end of a word is its longest suffix."""
    return re.compile(f"(?:{'|'.join(suffixes)})$")


_POSSESSIVE = _longest("'s'", "'s", "'")
_PAST = _longest("eedly", "ingly", "edly", "eed", "ing", "ed")
_SUFFIX2, _SUFFIX3, _SUFFIX4 = _longest(*STEP2), _longest(*STEP3), _longest(*STEP4)


def stem_word(word: str) -> str:
    """Stem of one lower-case word."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.removeprefix("'")
    if "y" in w:
        w = _CONSONANT_Y.sub(r"\1Y", w)
    r1 = _region(_FIRST_REGION, w, 0)
    r2 = _region(_NEXT_REGION, w, r1)
    w = _drop_plural(_POSSESSIVE.sub("", w))
    if w in STOP_AFTER_1A:
        return w
    w = _drop_past(w, r1)
    if w[-1:] in ("y", "Y") and _FINAL_Y.search(w):
        w = w[:-1] + "i"
    w = _derivation(w, r1, r2)
    if w.endswith("e"):
        if len(w) > r2 or (len(w) > r1 and not _SHORT.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.lower()


def _region(pattern: re.Pattern, word: str, start: int) -> int:
    found = pattern.match(word, start)
    return found.end() if found else len(word)


def _drop_plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith(("us", "ss")) or not _PLURAL.search(w):
        return w
    return w[:-1]


def _drop_past(w: str, r1: int) -> str:
    found = _PAST.search(w)
    if not found:
        return w
    cut = w[: found.start()]
    if found.group().startswith("eed"):
        return cut + "ee" if len(cut) >= r1 else w
    if not _VOWEL.search(cut):
        return w
    if cut.endswith(("at", "bl", "iz")):
        return cut + "e"
    if cut[-2:] in DOUBLES:
        return cut[:-1]
    return cut + "e" if r1 >= len(cut) and _SHORT.search(cut) else cut


def _derivation(w: str, r1: int, r2: int) -> str:
    found = _SUFFIX2.search(w)
    if found and found.start() >= r1:
        suffix, cut = found.group(), w[: found.start()]
        allowed = {"ogi": "l", "li": LI_ENDINGS}.get(suffix)
        if allowed is None or (cut and cut[-1] in allowed):
            w = cut + STEP2[suffix]
    found = _SUFFIX3.search(w)
    if found and found.start() >= (r2 if found.group() == "ative" else r1):
        w = w[: found.start()] + STEP3[found.group()]
    found = _SUFFIX4.search(w)
    if found and found.start() >= r2 and (found.group() != "ion" or w[: found.start()].endswith(("s", "t"))):
        w = w[: found.start()]
    return w


def _stem_array(words: pa.Array, memory: dict[str, str]) -> pa.Array:
    encoded = words.dictionary_encode()
    distinct = encoded.dictionary.to_pylist()
    if len(memory) > REMEMBERED:
        memory.clear()
    for word in distinct:
        if word not in memory:
            memory[word] = stem_word(word)
    return pa.array([memory[word] for word in distinct], pa.string()).take(encoded.indices)


@F.arrow_udf(T.StringType())
def _stem_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    memory: dict[str, str] = {}
    for words in batches:
        yield _stem_array(words, memory)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stem_list_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    memory: dict[str, str] = {}
    for lists in batches:
        yield pa.ListArray.from_arrays(lists.offsets, _stem_array(lists.values, memory), mask=lists.is_null())


def stem(word: Column) -> Column:
    """Stem of a lower-case word column."""
    return _stem_batches(word)


def stem_tokens(tokens: Column) -> Column:
    """Stems of an array of lower-case words, in order; NULL stays NULL."""
    return _stem_list_batches(tokens)
