"""Porter2 (English) stemming of distinct words, after the published description."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

V = "aeiouy"
# Fixed values of the published algorithm.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "ization": "ize", "ational": "ate", "ousness": "ous", "iveness": "ive", "fulness": "ful", "tional": "tion", "lessli": "less", "biliti": "ble", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "fulli": "ful", "ousli": "ous", "iviti": "ive", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    m = re.match("gener|commun|arsen", w)
    r1 = m.end() if m else (m.end() if (m := re.search(f"[{V}][^{V}]", w)) else len(w))
    m = re.compile(f"[{V}][^{V}]").search(w, r1)
    return r1, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(f"[^{V}][{V}][^{V}wxY]$", w) or re.fullmatch(f"[{V}][^{V}]", w))


def stem(word: str) -> str:
    """The stem of a lower-case word; words of other letters than a-z and ' stay."""
    if len(word) < 3 or not re.fullmatch("[a-z']+", word):
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.lstrip("'")
    w = re.sub(f"^y|(?<=[{V}])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif re.search("(ied|ies)$", w):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif re.search(f"[{V}].*[^us]s$|[{V}].+s$", w) and not re.search("(us|ss)$", w) and re.search(f"[{V}]", w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    if m := re.search("(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search(f"[{V}]", w[: m.start()]):
        w = w[: m.start()]
        if re.search("(at|bl|iz)$", w):
            w += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in V:
        w = w[:-1] + "i"
    for suffix in sorted([*STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if len(base) >= r1:
                if suffix == "ogi":
                    w = base + "og" if base.endswith("l") else w
                elif suffix == "li":
                    w = base if base[-1:] and base[-1] in "cdeghkmnrt" else w
                else:
                    w = base + STEP2[suffix]
            break
    for suffix in sorted([*STEP3, "ative"], key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if suffix == "ative":
                w = base if len(base) >= r2 else w
            elif len(base) >= r1:
                w = base + STEP3[suffix]
            break
    for suffix in sorted([*STEP4, "ion"], key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if len(base) >= r2 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stem(t) for t in batch.column(0).to_pylist()], pa.string())], ["term", "stem"])


def with_stems(terms: DataFrame) -> DataFrame:
    """(term, stem) of distinct terms."""
    return terms.select("term").mapInArrow(_stems, "term string, stem string")
