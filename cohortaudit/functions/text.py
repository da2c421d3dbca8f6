"""Text column expressions: normalising, tokens, mentions, context states and length bins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cue words before a mention, in the order in which they are tried.
NEGATION_CUES = ("no ", "without ", "negative for ", "denies ", "absence of ", "free of ")
SPECULATION_CUES = ("rule out ", "r/o ", "evaluate for ", "concern for ", "possible ", "suspected ", "query ", "question of ", "check for ", "follow up ")
# Fixed value: what a token is.
TOKEN = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?"
#: Characters to the left of a mention that cues are looked for in.
CUE_WINDOW = 45


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def literal(phrase: str) -> str:
    """A phrase as a regular expression of itself, lower-cased."""
    return re.sub(r"([^0-9A-Za-z_ ])", r"\\\1", phrase.lower())


def normalize(text: Column | str) -> Column:
    """F1: lower case, runs of underscores and of white space to one blank, trimmed; null gives ''."""
    # one pass that stops only where a run isn't one blank already
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), r"(?U)[\s_&&[^ ]][\s_]*| [\s_]+", " "))


def token_count(text: Column | str) -> Column:
    """number of tokens of the normalised text."""
    return F.size(F.regexp_extract_all(normalize(text), F.lit(TOKEN), F.lit(0)))


def contains_phrase(text: Column | str, phrase: str) -> Column:
    """whether the normalised text holds the phrase between word boundaries."""
    return _c(text).rlike(rf"(?U)\b{literal(phrase)}\b")


def mentions(text: Column | str, phrases: list[str]) -> Column:
    """struct of any, affirmed, negated and speculative for the phrases' mentions.

    Each occurrence is of one kind, by the cues in the CUE_WINDOW characters before it:
    negation before speculation before neither. Cues are plain substrings. Phrases that
    begin at one place have one window, so all are looked for in one pass.
    """
    s = normalize(text)
    apart = [p for p in phrases if _overlaps_itself(p)]
    once = [p for p in phrases if p not in apart]
    windows = F.concat(*(_left_windows(s, ps) for ps in [once] * bool(once) + [[p] for p in apart]))
    some = lambda cues: "|".join(map(literal, cues))
    kind = lambda w: F.when(w.rlike(some(NEGATION_CUES)), "negated").when(w.rlike(some(SPECULATION_CUES)), "speculative").otherwise("affirmed")
    # one element, so that the windows are made and classified once for the four answers
    kinds = F.array(F.array_distinct(F.transform(windows, kind)))
    names = ("affirmed", "negated", "speculative")
    return F.transform(kinds, lambda k: F.struct((F.size(k) > 0).alias("any"), *(F.array_contains(k, n).alias(n) for n in names)))[0]


def _overlaps_itself(phrase: str) -> bool:
    """Whether a phrase may begin inside an occurrence of itself, where the second doesn't count."""
    p = phrase.lower()
    return any(p.startswith(p[m.start() :]) for m in re.finditer(r"\b", p) if 0 < m.start() < len(p))


def _left_windows(s: Column, phrases: list[str]) -> Column:
    """The CUE_WINDOW characters to the left of each occurrence of the phrases, or what there are.

    One phrase is matched itself; of several only the places where any begins are matched,
    so that they may overlap. A look-behind of two fixed shapes takes the window: windows
    may overlap, and the work is in proportion to the text.
    """
    window = rf"(^.{{0,{CUE_WINDOW - 1}}}|.{{{CUE_WINDOW}}})"
    if len(phrases) == 1:
        p = literal(phrases[0])
        return F.regexp_extract_all(s, F.lit(rf"(?U)\b{p}\b(?<={window}{p})"), F.lit(1))
    some = "|".join(map(literal, phrases))
    return F.regexp_extract_all(s, F.lit(rf"(?U)\b(?=(?:{some})\b)(?<={window})"), F.lit(1))


def _counted(text: Column | str, least: int, generic: list[str]) -> Column:
    """array of one struct of present, tokens and low."""
    # reads on to the end of the least-th run only; runs are taken whole, so none is tried again
    enough = rf"\A[^a-z0-9]*+(?:[a-z0-9]++[^a-z0-9]*+){{{least}}}"

    def counts(s: Column) -> Column:
        stripped = s
        for p in generic:
            stripped = F.regexp_replace(stripped, rf"(?U)\b{literal(p)}\b", " ")
        return F.struct((s != "").alias("present"), F.size(F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0))).alias("tokens"), (~stripped.rlike(enough)).alias("few"))

    # arrays of one element, so that a text is normalised and counted once for all that is asked of it
    low = lambda c: c["present"] & ((c["tokens"] < least) | c["few"])
    return F.transform(F.transform(F.array(normalize(text)), counts), lambda c: F.struct(c["present"].alias("present"), c["tokens"].alias("tokens"), low(c).alias("low")))


def low_information(text: Column | str, least: int, generic: list[str]) -> Column:
    """fewer than `least` tokens, counted also without the generic phrases; empty text is not low."""
    return _counted(text, least, generic)[0]["low"]


def effective_tokens(text: Column | str) -> Column:
    """white-space tokens with a letter or digit, once runs of two or more underscores are taken out."""
    # a match is a token from its first letter or digit on
    return F.size(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"(?U)[\p{L}\p{N}](?:[^\s_]++|_(?!_))*+"), F.lit(0)))


def deid_spans(text: Column | str) -> Column:
    """number of runs of two or more underscores."""
    return F.size(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit("_{2,}"), F.lit(0)))


def deid_only(text: Column | str) -> Column:
    """whether a non-blank text is nothing but such runs, blanks and punctuation."""
    t = F.coalesce(_c(text), F.lit(""))
    return (F.trim(t) != "") & ~F.regexp_replace(t, "_{2,}", " ").rlike(r"[\p{L}\p{N}]")


def mask_digits(text: Column | str) -> Column:
    """runs of digits to #, white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(text), r"[0-9]+", "#"), r"(?U)\s+", " "))


def one_line(text: Column | str) -> Column:
    """line breaks to blanks, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(text), r"\n", " "), r"(?U)\s+", " "))


def study_id(name: Column | str) -> Column:
    """the number of a file name s<digits>.txt, else null."""
    return F.regexp_extract(_c(name), r"(?:^|[/\\])s(\d+)\.txt$", 1).try_cast("long")


def build_context(columns: list[str], present: list[str]) -> Column:
    """The non-blank columns, trimmed and joined by a blank; raises if none of them exists."""
    there = [c for c in columns if c in present]
    if not there:
        raise ValueError(f"none of the context columns exists: {columns}")
    return F.concat_ws(" ", *(F.nullif(F.trim(F.col(c)), F.lit("")) for c in there))


def context_features(text: Column | str, least: int, generic: list[str]) -> Column:
    """Struct of present, tokens, low, usable and state (absent, low_information, usable)."""
    state = lambda c: F.when(~c["present"], "absent").when(c["low"], "low_information").otherwise("usable")
    return F.transform(_counted(text, least, generic), lambda c: F.struct(c["present"], c["tokens"], c["low"], (c["present"] & ~c["low"]).alias("usable"), state(c).alias("state")))[0]


def natural_state(tokens: Column | str, least: int = 3) -> Column:
    """P10: N3 without effective tokens, N2 with fewer than `least`, else N1."""
    return F.when(_c(tokens) == 0, "N3").when(_c(tokens) < least, "N2").otherwise("N1")


def _bin(n: Column, edges: list[int], names: list) -> Column:
    """The name of the first edge that n is below, else the last name."""
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names))):
        out = F.when(n < edge, F.lit(name)).otherwise(out)
    return out


def length_bin(tokens: Column | str) -> Column:
    """Bins 0 to 5 at 5, 10, 20, 40 and 80 effective tokens; an edge is in the upper bin."""
    return _bin(_c(tokens), [5, 10, 20, 40, 80], [0, 1, 2, 3, 4, 5])


def sweep_bin(tokens: Column | str) -> Column:
    """Bins by name; an edge is in the lower bin, 0 tokens have none."""
    n = _c(tokens)
    return F.when(n > 0, _bin(n, [6, 11, 21, 41, 81], ["01-05", "06-10", "11-20", "21-40", "41-80", "81+"]))


def preflight_bin(text: Column | str) -> Column:
    """0, 1-4, 5-9 or 10+ white-space tokens."""
    s = F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?U)\s+", " "))
    return _bin(F.when(s == "", 0).otherwise(F.size(F.split(s, " "))), [1, 5, 10], ["0", "1-4", "5-9", "10+"])
