"""Normalisers for corpora before scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: contractions and titles, in order of use
ENGLISH_RULES = [
    (r"\bwon't\b", "will not"), (r"\bcan't\b", "can not"), (r"\blet's\b", "let us"), (r"\bain't\b", "aint"), (r"\by'all\b", "you all"), (r"\bwanna\b", "want to"),
    (r"\bgotta\b", "got to"), (r"\bgonna\b", "going to"), (r"\bi'ma\b", "i am going to"), (r"\bimma\b", "i am going to"), (r"\bwoulda\b", "would have"),
    (r"\bcoulda\b", "could have"), (r"\bshoulda\b", "should have"), (r"\bma'am\b", "madam"), (r"\bmr\b", "mister "), (r"\bmrs\b", "missus "), (r"\bst\b", "saint "),
    (r"\bdr\b", "doctor "), (r"\bprof\b", "professor "), (r"\bcapt\b", "captain "), (r"\bgov\b", "governor "), (r"\bald\b", "alderman "), (r"\bgen\b", "general "),
    (r"\bsen\b", "senator "), (r"\brep\b", "representative "), (r"\bpres\b", "president "), (r"\brev\b", "reverend "), (r"\bhon\b", "honorable "), (r"\basst\b", "assistant "),
    (r"\bassoc\b", "associate "), (r"\blt\b", "lieutenant "), (r"\bcol\b", "colonel "), (r"\bjr\b", "junior "), (r"\bsr\b", "senior "), (r"\besq\b", "esquire "),
    (r"'d been\b", " had been"), (r"'s been\b", " has been"), (r"'d gone\b", " had gone"), (r"'s gone\b", " has gone"), (r"'d done\b", " had done"), (r"'s got\b", " has got"),
    (r"n't\b", " not"), (r"'re\b", " are"), (r"'s\b", " is"), (r"'d\b", " would"), (r"'ll\b", " will"), (r"'t\b", " not"), (r"'ve\b", " have"), (r"'m\b", " am"),
]
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿđðł"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyddl"
FILLERS = r"\b(hmm|mm|mhm|mmm|uh|um)\b"


def basic(x: Column) -> Column:
    """Lower case; bracketed parts go; marks, symbols and punctuation become spaces."""
    low = F.regexp_replace(F.lower(x), r"[<\[][^>\]]*[>\]]", "")
    low = F.regexp_replace(low, r"\(([^)]+?)\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[\p{M}\p{S}\p{P}]", " "), r"\s+", " "))


def english(x: Column) -> Column:
    """Fillers, contractions and titles, number commas, letters without their accents, and signs of money, percent and points
    only beside a digit; the number-word state machine is not built."""
    low = F.regexp_replace(F.lower(x), r"[<\[][^>\]]*[>\]]", "")
    low = F.regexp_replace(F.regexp_replace(low, r"\(([^)]+?)\)", ""), FILLERS, "")
    low = F.regexp_replace(low, r"\s+'", "'")
    for pattern, to in ENGLISH_RULES:
        low = F.regexp_replace(low, pattern, to)
    low = F.regexp_replace(F.regexp_replace(low, r"(\d),(\d)", "$1$2"), r"\.([^0-9]|$)", " $1")
    low = F.translate(low, ACCENTED, PLAIN)
    for letter, pair in (("œ", "oe"), ("æ", "ae"), ("ß", "ss"), ("þ", "th")):
        low = F.replace(low, F.lit(letter), F.lit(pair))
    low = F.regexp_replace(F.regexp_replace(low, r"\p{Mn}", ""), r"[\p{M}\p{S}\p{P}&&[^.%$¢€£]]", " ")
    low = F.regexp_replace(F.regexp_replace(low, r"[.$¢€£]([^0-9])", " $1"), r"([^0-9])%", "$1 ")
    return F.trim(F.regexp_replace(low, r"\s+", " "))


def normalize_corpus(df: DataFrame, text: str = "text", mode: str = "basic", spelling: DataFrame | None = None) -> DataFrame:
    """Normalise a text column; ``spelling`` (wrong, correct) is looked up per word."""
    out = df.withColumn(text, {"basic": basic, "english": english}[mode](F.col(text)))
    if spelling is None:
        return out
    from .filters import apply_dictionary
    return apply_dictionary(out, spelling, text, whole_words=True)
