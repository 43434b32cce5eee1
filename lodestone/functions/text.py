"""Text columns: cleaning, keys, predicates.  Everything here is built-in Spark but for NFKC and casefold."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# They define which lines count as references or damaged text.
REFERENCE_LIKE = r"^(?:\[?[0-9]{1,3}\]?\s*[.)]|references?\b|bibliography\b)|\bdoi\s*:\s*10\.[0-9]{4,9}/"
MOJIBAKE_MARKERS = ("�", "Ã", "Â", "â€", "ï¬")
NEGATION_CUES = ("not", "no ", "neither", "without", "didn't", "did not", "wasn't", "was not")
UNCERTAINTY_CUES = ("may", "might", "could", "suggest", "likely", "possibly", "potentially", "appears")
STRAY_ENDINGS = "tion|tions|ment|ments|ness|ously|ively|ically|ations|ability|ities|jection|centrations|cant|ances|diate|izontal|istry|ficult"
EXCLUDED_SECTION_TERMS = (
    "reference", "bibliograph", "acknowledg", "funding", "author contribution", "credit authorship", "competing interest",
    "conflict of interest", "data availability", "supplementary", "appendix", "article info", "orcid", "citation",
    "declaration", "ethics statement", "publisher", "copyright", "keywords",
)
SECTION_TERMS = {
    "results": ("result", "finding"),
    "discussion": ("discussion",),
    "conclusion": ("conclusion", "summary"),
    "methods": ("method", "material", "experimental", "methodology", "statistical analysis"),
    "abstract": ("abstract",),
    "introduction": ("introduction", "background"),
}


def round6(c: Column) -> Column:
    """Six decimals by the same arithmetic in any engine."""
    return F.floor(c.cast("double") * 1e6 + 0.5) / 1e6


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility normalisation (Spark has none)."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full case folding, which ``lower`` is not outside ASCII."""
    return s.map(lambda x: None if x is None else x.casefold())


def unicode_clean(c: Column) -> Column:
    """NFKC, then control and format characters out, then white space collapsed; pure ASCII skips the Python step."""
    ascii_only = F.octet_length(c) == F.char_length(c)
    normal = F.when(ascii_only, c).otherwise(nfkc(F.when(~ascii_only, c)))
    return F.trim(F.regexp_replace(F.regexp_replace(normal, r"[\p{Cc}\p{Cf}&&[^\t\n\r]]", ""), r"(?U)\s+", " "))


def normal_form(c: Column, compat: bool = True, fold: bool = False) -> Column:
    """White space collapsed and stripped; with ``compat`` after NFKC, with ``fold`` in full case folding.

    The combinations are different normal forms and must not be mixed.
    """
    out = F.trim(F.regexp_replace(nfkc(c) if compat else c, r"(?U)\s+", " "))
    return casefold(out) if fold else out


def ascii_clean(c: Column) -> Column:
    """Control characters out, ASCII white space collapsed and stripped."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", ""), "[ \\t\\n\\r]+", " "))


def key(c: Column) -> Column:
    """Lower case with every run outside a-z and 0-9 as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def compact_key(c: Column) -> Column:
    """Lower case with everything outside a-z and 0-9 deleted (headings)."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def match_text(c: Column, compat: bool = False) -> Column:
    """Normal form for comparing answers; ``compat`` keeps the order of replacements that turns "percentage" into "%age"."""
    low = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.replace(low, F.lit("percent"), F.lit("%")) if compat else F.regexp_replace(low, "percent(age)?", "%")


def word_split_suspected(c: Column) -> Column:
    """A word broken by a hyphen and a blank, or a common ending standing alone."""
    return c.rlike(rf"(?U)\b(?:[A-Za-z]{{3,}}-\s+[a-z]{{2,}}|[A-Za-z]{{2,}}\s+(?:{STRAY_ENDINGS}))\b")


def any_of(c: Column, terms) -> Column:
    """Whether a text contains one of the terms."""
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms])


def section_class(text: Column) -> Column:
    """One of eight section labels; exclusion terms win, results with discussion is a label of its own."""
    low = F.lower(text)
    has = {k: any_of(low, v) for k, v in SECTION_TERMS.items()}
    out = F.when(any_of(low, EXCLUDED_SECTION_TERMS), "excluded").when(has["results"] & has["discussion"], "results_discussion")
    for label in ("results", "discussion", "conclusion", "methods", "abstract", "introduction"):
        out = out.when(has[label], label)
    return out.otherwise("other")


def reference_like(c: Column) -> Column:
    return F.lower(c).rlike(REFERENCE_LIKE)


def mojibake(c: Column) -> Column:
    return any_of(c, MOJIBAKE_MARKERS)


def negated(c: Column) -> Column:
    """Substring test, as the cues are written (so "another" counts)."""
    return any_of(F.concat(F.lit(" "), F.lower(c), F.lit(" ")), NEGATION_CUES)


def uncertain(c: Column) -> Column:
    """A word beginning with an uncertainty cue."""
    return F.lower(c).rlike(r"\b(?:" + "|".join(UNCERTAINTY_CUES) + ")")


def semantic_context(c: Column) -> Column:
    """At least 18 characters and four words, and not a citation alone."""
    words = F.size(F.regexp_extract_all(c, F.lit("([A-Za-z][A-Za-z'-]*)"), 1))
    return (F.char_length(c) >= 18) & (words >= 4) & ~c.rlike(r"^\s*[\[(][0-9,;\s–-]+[\])]\s*$")


def valid_span(text: Column, start: Column, end: Column, answer: Column) -> Column:
    """0 <= start < end <= length, and the text there is the answer."""
    inside = (start >= 0) & (start < end) & (end <= F.char_length(text))
    return F.coalesce(inside & (F.substring(text, start + 1, end - start) == answer), F.lit(False))


def stable_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """Content address: prefix and the first digits of the SHA-256 of the parts, NULL as empty."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length))


def token_count(c: Column) -> Column:
    """Tokens of the default deterministic tokenizer: runs of ASCII letters and digits, and other visible marks."""
    return F.size(F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+|[^A-Za-z0-9\\s])"), 1)).cast("long")
