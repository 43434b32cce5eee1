"""Fixed values of the detectors: cues, units and patterns, in one place.

They decide which spans are found, so they are stated as they must be.
"""

from __future__ import annotations

import re

ACRONYM = r"[A-Z][A-Z0-9-]{1,9}"
LONG_FORM = r"[A-Za-z][A-Za-z0-9'/-]*(?:\s+(?:of|the|and|for|in|to|on|with|[A-Za-z][A-Za-z0-9'/-]*)){1,11}"
SMALL_WORDS = ("of", "the", "and", "for", "in", "to", "on", "with")
DEFINITION_CUES = ("refers to", "is defined as", "denotes", "means")
RELATION_CUES = (
    "increased", "increase", "decreased", "decrease", "higher", "lower", "associated", "correlated", "resulted", "led",
    "promoted", "inhibited", "improved", "reduced", "affected", "related", "effect", "significant",
)
INFLECTED = ("increase", "decrease")
UNITS = (
    "%", "°C", "°F", "K", "km", "m", "cm", "mm", "μm", "um", "nm", "km2", "km²", "m2", "m²", "cm2", "cm²", "mm2", "mm²",
    "kg", "g", "mg", "μg", "ug", "ng", "pg", "L", "mL", "ml", "μL", "uL", "mol", "mmol", "μmol", "umol",
    "M", "mM", "μM", "uM", "nM", "pM", "mg/L", "g/L", "ng/mL", "Pa", "kPa", "MPa", "bar", "mbar", "Hz", "kHz", "MHz", "GHz",
    "s", "ms", "min", "h", "hr", "day", "days", "week", "weeks", "month", "months", "year", "years", "yr", "yrs",
    "ka", "kyr", "Ma", "Myr", "m/s", "km/h", "mm/yr", "mm/y", "cm/yr", "m/yr", "kg/m2", "kg/m²",
    "ng/g", "μg/g", "ug/g", "mg/g", "g/kg", "mg/kg", "μg/kg", "ug/kg", "ppm", "ppb", "ppt", "‰", "Sv", "W", "kW", "MW",
    "J", "kJ", "MJ", "N", "mN", "dB", "cells/mL", "CFU/mL", "bp", "kb", "Mb", "Gb",
)
NUMBER = r"[+-]?(?:\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?|\.\d+)(?:\s*[×x]\s*10\s*[−-]?\s*\d+)?"
UNIT = "(?:" + "|".join(re.escape(u) for u in sorted(UNITS, key=len, reverse=True)) + ")"
ABBREVIATIONS = ("fig.", "figs.", "eq.", "eqs.", "ref.", "refs.", "cf.", "al.", "e.g.", "i.e.", "vs.")

TERMS = {
    "long_form_abbreviation": re.compile(rf"(?P<long>{LONG_FORM})\s*\(\s*(?P<term>{ACRONYM})\s*\)"),
    "abbreviation_long_form": re.compile(rf"(?P<term>{ACRONYM})\s*\(\s*(?P<long>{LONG_FORM})\s*\)"),
    "explicit_definition": re.compile(rf"(?P<term>[A-Za-z][A-Za-z0-9'/-]*(?:\s+[A-Za-z][A-Za-z0-9'/-]*){{0,4}})\s+(?P<cue>{'|'.join(DEFINITION_CUES)})\s+(?P<long>[^.;!?]{{3,180}})"),
}
#: In order of priority: a span taken by an earlier pattern is closed to later ones.
NUMBERS = {
    "mean_dispersion": re.compile(rf"(?<![\w.])({NUMBER}\s*(?:±|\+/-)\s*{NUMBER}\s*{UNIT})(?!\w)"),
    "range": re.compile(rf"(?<![\w.])({NUMBER}\s*(?:–|—|-|to)\s*{NUMBER}\s*{UNIT})(?!\w)"),
    "percentage": re.compile(rf"(?<![\w.])({NUMBER}\s*(?:%|percent(?:age)?))(?!\w)", re.I),
    "statistical_ci": re.compile(rf"(?<!\w)({NUMBER}\s*%\s*(?:CI|confidence interval)\s*[:=]?\s*[\[(]?\s*{NUMBER}\s*[,–—-]\s*{NUMBER}\s*[\])]?)(?!\w)", re.I),
    "statistical_p": re.compile(rf"(?<!\w)([pP]\s*(?:=|<|>|≤|≥)\s*{NUMBER})(?!\w)"),
    "statistical_test": re.compile(rf"(?<!\w)((?:R\s*\^?2|r|F|t|χ2|χ²|z)\s*(?:=|<|>|≤|≥)\s*{NUMBER})(?!\w)"),
    "measurement": re.compile(rf"(?<![\w.])({NUMBER}\s*{UNIT})(?!\w)"),
    "year_like": re.compile(r"(?<![\w.])((?:18\d{2}|19\d{2}|20\d{2}|2100))(?![\w.])"),
}
RELATION = re.compile(
    r"\b(significant(?:ly)?|"
    + "|".join(c + ("(?:d|s|ing)?" if c in INFLECTED else "") for c in sorted(RELATION_CUES, key=len, reverse=True) if c != "significant")
    + r")\b",
    re.I,
)
CONDITIONS = {
    "quantity_or_threshold": rf"[+-]?(?:\d+(?:\.\d+)?|\.\d+)\s*(?:{UNIT}|%|percent)",
    "comparison": r"\b(?:compared (?:with|to)|relative to|versus|vs\.?|than)\s+[^,;.]{1,90}",
    "treatment": r"\b(?:treated with|exposed to|subjected to|under)\s+[^,;.]{1,80}",
    "method": r"\b(?:using|measured by|estimated (?:with|using)|based on)\s+[^,;.]{1,90}",
    "spatial": r"\b(?:at Site\s+[A-Za-z0-9-]+|in the\s+[A-Za-z][A-Za-z -]{2,50}\s+(?:region|area|basin|margin|ocean|sea|soil|sediment))",
    "temporal": r"\b(?:during|after|before|over the past|throughout)\s+[^,;.]{1,80}",
    "negation": r"\b(?:not|no|neither|without|did not|was not)\b",
    "uncertainty": r"\b(?:may|might|could|suggest\w*|likely|possibly|potentially|appear\w*)\b",
}
INVALID_TERM = r"(?i)\b(?:provides?|acquired|evaluated|trained|computed|present|allows?|refined|this|that|which|we|it)\b"
STRUCTURAL_PREFIX = r"(?i)(?:fig(?:ure)?|table|eq(?:uation)?|section|page|pp?|vol(?:ume)?|no)\.?\s*$"
STATISTICAL_CONTEXT = r"(?i)\b(?:significant|difference|effect|association|correlation|compared|higher|lower|increase|decrease|model|regression|test)\w*\b"
METHOD_RESULT = r"(?i)\b(?:performance|accuracy|precision|recall|f1|outperform|compared|higher|lower|resulted|yield|error|improved|reduced)\w*\b"
URL_OR_DOI = r"(?i)https?://|www\.|doi\s*:|10\.\d{4,9}/"
