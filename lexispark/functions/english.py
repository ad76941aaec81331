"""English texts in a form in which two transcripts can be compared, and forms that ignore matters of style."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The published speech-recognition normal form's fillers, contractions and titles.
FILLERS = r"\b(hmm|mm|mhm|mmm|uh|um)\b"
SPOKEN = [
    (r"\bwon't\b", "will not"), (r"\bcan't\b", "can not"), (r"\blet's\b", "let us"), (r"\bain't\b", "aint"), (r"\by'all\b", "you all"),
    (r"\bwanna\b", "want to"), (r"\bgotta\b", "got to"), (r"\bgonna\b", "going to"), (r"\bi'ma\b", "i am going to"), (r"\bimma\b", "i am going to"),
    (r"\bwoulda\b", "would have"), (r"\bcoulda\b", "could have"), (r"\bshoulda\b", "should have"), (r"\bma'am\b", "madam"),
    (r"\bmr\b", "mister "), (r"\bmrs\b", "missus "), (r"\bst\b", "saint "), (r"\bdr\b", "doctor "), (r"\bprof\b", "professor "),
    (r"\bcapt\b", "captain "), (r"\bgov\b", "governor "), (r"\bald\b", "alderman "), (r"\bgen\b", "general "), (r"\bsen\b", "senator "),
    (r"\brep\b", "representative "), (r"\bpres\b", "president "), (r"\brev\b", "reverend "), (r"\bhon\b", "honorable "),
    (r"\basst\b", "assistant "), (r"\bassoc\b", "associate "), (r"\blt\b", "lieutenant "), (r"\bcol\b", "colonel "),
    (r"\bjr\b", "junior "), (r"\bsr\b", "senior "), (r"\besq\b", "esquire "),
    (r"'d been\b", " had been"), (r"'s been\b", " has been"), (r"'d gone\b", " had gone"), (r"'s gone\b", " has gone"),
    (r"'d done\b", " had done"), (r"'s got\b", " has got"),
    (r"n't\b", " not"), (r"'re\b", " are"), (r"'s\b", " is"), (r"'d\b", " would"), (r"'ll\b", " will"), (r"'t\b", " not"), (r"'ve\b", " have"), (r"'m\b", " am"),
]
BEFORE_SYMBOLS = [(r"[<\[][^>\]]*[>\]]", ""), (r"\([^)]*\)", ""), (FILLERS, ""), (r"\s+'", "'"), *SPOKEN, (r"(\d),(\d)", r"\1\2"), (r"\.([^0-9]|$)", r" \1")]
# Symbols and marks that may stand beside a number, and only there.
AFTER_SYMBOLS = [(r"[.$¢€£]([^0-9]|$)", r" \1"), (r"([^0-9]|^)%", r"\1 "), (r"\s+", " ")]


@F.pandas_udf(StringType())
def plain_letters(text: pd.Series) -> pd.Series:
    """Letters without their accents; marks, symbols and punctuation are spaces, but for those of numbers."""
    import unicodedata

    def plain(t):
        if t is None:
            return None
        if t.isascii():
            return re.sub(r"[^\w\s.%$]|_", " ", t)
        kind = {c: unicodedata.category(c) for c in set(unicodedata.normalize("NFKD", t))}
        say = {ord(c): "" if k == "Mn" else " " for c, k in kind.items() if k[0] in "MSP" and c not in ".%$¢€£"}
        return unicodedata.normalize("NFKD", t).translate(say)

    return text.map(plain)


def normal_english(text: Column, spelling: dict[str, str] | None = None) -> Column:
    """Lower case, no remarks in brackets, no fillers, contractions in full, no accents, symbols only beside numbers.

    ``spelling`` maps words to the spelling to compare (say, British to American). Number words stay as they are. Null
    is empty.
    """
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, said in BEFORE_SYMBOLS:
        out = F.regexp_replace(out, "(?U)" + pattern, re.sub(r"\\(\d)", r"$\1", said))
    out = plain_letters(out)
    for pattern, said in AFTER_SYMBOLS:
        out = F.regexp_replace(out, "(?U)" + pattern, re.sub(r"\\(\d)", r"$\1", said))
    out = F.trim(out)
    if not spelling:
        return out
    table = F.create_map(*(F.lit(x) for pair in spelling.items() for x in pair))
    return F.array_join(F.transform(F.split(out, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


_LETTERS = re.compile(r"(?<!\S)(?:[a-z]|00?)(?: (?:[a-z]|00?))+(?!\S)")
_AGAIN = re.compile(r"(?<!\S)(\S+ \S+ \S+|\S+ \S+|\S+) \1(?!\S)")
NUMBER = r"\d+(?:\.\d+)?"


def _any_of(forms) -> str:
    return "|".join(re.escape(f) for f in sorted(forms, key=lambda f: (-f.count(" "), f)))


def _letter_run(m) -> str:
    """A spelled run as one word (nought is said as the letter); numbers alone and repeated "i" stay."""
    said = set(m[0].split())
    return m[0] if said == {"i"} or said <= {"0", "00"} else m[0].replace(" ", "").replace("0", "o")


def style_neutral(groups: str, units: dict[str, str] | None = None, compounds: dict[str, str] | None = None, fillers: tuple[str, ...] = ()):
    """A UDF on normalised texts (words and single spaces) that undoes the named ``groups`` of style, in this order.

    acr: letters said one by one are joined. unit: a unit's name after a number is its short form, "per" between two of
    them goes. cmp: a compound's two words are one. dis: fillers go, and words, pairs and triples said again at once
    stay once. Null stays null.
    """
    units, compounds, wanted = units or {}, compounds or {}, set(groups.split())
    if unknown := wanted - {"acr", "unit", "cmp", "dis"}:
        raise ValueError(f"unknown groups of style: {sorted(unknown)}")
    unit, pair = _any_of(units), _any_of(compounds)
    measure = re.compile(rf"(?<!\S)({NUMBER}) ({unit})(?: per ({unit}))?(?!\S)") if units and "unit" in wanted else None
    joined = re.compile(rf"(?<!\S)(?:{pair})(?!\S)") if compounds and "cmp" in wanted else None

    def neutral(t: str) -> str:
        if "acr" in wanted:
            t = _LETTERS.sub(_letter_run, t)
        if measure:
            t = measure.sub(lambda m: " ".join([m[1], units[m[2]], *([units[m[3]]] if m[3] else [])]), t)
        if joined:
            t = joined.sub(lambda m: compounds[m[0]], t)
        if "dis" in wanted:
            t, changes = " ".join(w for w in t.split(" ") if w not in fillers), 1
            while changes:
                t, changes = _AGAIN.subn(r"\1", t)
        return t

    @F.pandas_udf(StringType())
    def apply(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else neutral(t))

    return apply
