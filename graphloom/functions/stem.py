"""The Snowball English stemmer (Porter2) and stop words as column expressions.

A stem is a chain of `when`s over the ends of a word, all in the JVM; it is meant for distinct words or for the few
words that a query could mean. Words are expected in lower case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words of the English text search configuration.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
#: Words with stems of their own, words that are their own stems, and words that step 1a ends.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = "sky news howe atlas cosmos bias andes".split()
ENDED = "inning outing canning herring earring proceed exceed succeed".split()
#: The endings of steps 2 and 3 with what replaces them in R1, and those that step 4 deletes in R2.
STEP_2 = {
    "ational": "ate", "ization": "ize", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
    "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
#: A short syllable at the end: a vowel between two others, the last not w, x or Y; or a vowel and another at the start.
SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def is_stop(word: Column) -> Column:
    return word.isin(*STOP_WORDS)


def _cut(w: Column, n: int, add: str = "") -> Column:
    """The word without its last n letters, with another ending."""
    return F.concat(F.substring(w, F.lit(1), F.length(w) - n), F.lit(add)) if add else F.substring(w, F.lit(1), F.length(w) - n)


def _first(w: Column, endings: dict[str, Column]) -> Column:
    """The value of the longest ending that the word has, else the word."""
    out = None
    for e in sorted(endings, key=len, reverse=True):
        out = F.when(w.endswith(e), endings[e]) if out is None else out.when(w.endswith(e), endings[e])
    return out.otherwise(w)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _step_1a(w: Column) -> Column:
    short = F.when(F.length(w) > 4, _cut(w, 3, "i")).otherwise(_cut(w, 3, "ie"))
    return _first(w, {"sses": _cut(w, 2), "ied": short, "ies": short, "us": w, "ss": w, "s": F.when(w.rlike(f"{VOWEL}.+s$"), _cut(w, 1)).otherwise(w)})


def _step_1b(w: Column, r1: Column) -> Column:
    def mended(x: Column) -> Column:
        add = x.rlike("(at|bl|iz)$")
        double = x.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
        short = x.rlike(SHORT) & (F.length(x) <= r1)
        return F.when(add, F.concat(x, F.lit("e"))).when(double, _cut(x, 1)).when(short, F.concat(x, F.lit("e"))).otherwise(x)

    def without(n: int) -> Column:
        rest = _cut(w, n)
        return F.when(rest.rlike(VOWEL), _let(rest, mended)).otherwise(w)

    inside = lambda n: F.when(F.length(w) - n >= r1, _cut(w, n, "ee")).otherwise(w)
    return _first(w, {"eedly": inside(5), "eed": inside(3), "ingly": without(5), "edly": without(4), "ing": without(3), "ed": without(2)})


def _step_1c(w: Column) -> Column:
    return F.when(w.rlike(f"^.+{OTHER}[yY]$"), _cut(w, 1, "i")).otherwise(w)


def _step_2(w: Column, r1: Column) -> Column:
    inside = lambda n: F.length(w) - n >= r1
    ends = {e: F.when(inside(len(e)), _cut(w, len(e), to)).otherwise(w) for e, to in STEP_2.items()}
    ends["ogi"] = F.when(inside(3) & w.endswith("logi"), _cut(w, 1)).otherwise(w)
    ends["li"] = F.when(inside(2) & w.rlike("[cdeghkmnrt]li$"), _cut(w, 2)).otherwise(w)
    return _first(w, ends)


def _step_3(w: Column, r1: Column, r2: Column) -> Column:
    ends = {e: F.when(F.length(w) - len(e) >= r1, _cut(w, len(e), to)).otherwise(w) for e, to in STEP_3.items()}
    ends["ative"] = F.when(F.length(w) - 5 >= r2, _cut(w, 5)).otherwise(w)
    return _first(w, ends)


def _step_4(w: Column, r2: Column) -> Column:
    ends = {e: F.when(F.length(w) - len(e) >= r2, _cut(w, len(e))).otherwise(w) for e in STEP_4}
    ends["ion"] = F.when((F.length(w) - 3 >= r2) & w.rlike("[st]ion$"), _cut(w, 3)).otherwise(w)
    return _first(w, ends)


def _step_5(w: Column, r1: Column, r2: Column) -> Column:
    at = F.length(w) - 1
    e = w.endswith("e") & ((at >= r2) | ((at >= r1) & ~_cut(w, 1).rlike(SHORT)))
    return F.when(e | (w.endswith("ll") & (at >= r2)), _cut(w, 1)).otherwise(w)


def _regular(word: Column) -> Column:
    """All steps; r1 and r2 are where the regions R1 and R2 begin, which no step moves."""
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), f"({VOWEL})y", "$1Y")

    def steps(w: Column) -> Column:
        one = f"{OTHER}*{VOWEL}+{OTHER}"
        ends = lambda x, head: F.coalesce(F.nullif(F.length(F.regexp_extract(x, head, 0)), F.lit(0)), F.length(x))
        regions = F.struct(ends(w, f"^(gener|commun|arsen|{one})").alias("r1"), ends(w, f"^(gener|commun|arsen|{one}){one}").alias("r2"))

        def rest(r: Column) -> Column:
            r1, r2 = r["r1"], r["r2"]
            later = (lambda x: _step_1b(x, r1), _step_1c, lambda x: _step_2(x, r1), lambda x: _step_3(x, r1, r2), lambda x: _step_4(x, r2), lambda x: _step_5(x, r1, r2))

            def chain(x: Column, k: int) -> Column:
                return x if k == len(later) else _let(later[k](x), lambda y: chain(y, k + 1))

            return _let(_step_1a(w), lambda x: F.when(x.isin(*ENDED), x).otherwise(chain(x, 0)))

        return _let(regions, rest)

    return F.replace(_let(marked, steps), F.lit("Y"), F.lit("y"))


def stem(word: Column) -> Column:
    """The stem of a word in lower case."""
    special = F.create_map(*(F.lit(x) for pair in SPECIAL.items() for x in pair))
    return F.when((F.length(word) <= 2) | word.isin(*INVARIANT), word).when(word.isin(*SPECIAL), F.element_at(special, word)).otherwise(_regular(word))
