"""Lexical signals of a chunk, its suitability scores and tags. Tokens and signals are columns of their own, computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sievewright.functions.text import jaccard, n_tokens, word_set

#: For each signal, the count at which it is full and its groups of phrases (regular expressions of words).
PHRASES = {
    "definition": (3, [
        ["is a", "refers to", "defined as", "means?", "is defined to be", "refers"],
        ["represents?", "stands for", "signifies?", "denotes?"],
        ["known as", "called", "termed", "described as"],
    ]),
    "enumeration": (5, [
        ["first", "second", "third", "fourth", "fifth"],
        ["initially", "firstly", "secondly", "thirdly", "finally"],
        ["includes?", "consists? of", "comprises?", "contains?"],
        ["such as", "including", "like", "for example"],
    ]),
    "comparison": (3, [
        ["compared to", "compared with", "unlike", "unlike to"],
        ["whereas", "while", "although", "though"],
        ["in contrast", "by contrast", "conversely"],
        ["similarly", "likewise"],
        ["different from", "differs from"],
        ["better than", "worse than", "higher than", "lower than", "greater than", "lesser than"],
    ]),
    "causal": (4, [
        ["because", "since", "as", "for"],
        ["therefore", "thus", "hence", "consequently", "as a result"],
        ["led to", "resulted in", "caused", "brought about"],
        ["due to", "owing to", "thanks to", "because of"],
        ["triggered", "induced", "provoked"],
    ]),
    "mechanism": (2, [
        ["process", "mechanism", "function", "operation"],
        ["works by", "operates through", "functions via"],
        ["through which", "by which", "via which"],
        ["involves?", "entails?", "requires?"],
    ]),
    "conditional": (2, [
        ["if", "unless", "provided that", "assuming that"],
        ["under", "in case of", "in the event of"],
        ["depends on", "relies on", "contingent upon"],
    ]),
}
#: Words and patterns of the other signals, and the counts at which they are full.
PRONOUNS = ["he", "she", "it", "they", "this", "that", "these", "those", "which", "who", "whom", "whose"]
NUMBERS = [r"\b\d{1,4}(?:,\d{3})*(?:\.\d+)?\b", r"\b(?:19|20)\d{2}\b", r"\b\d+\.?\d*%\b", r"\b\d+[-–]\d+\b"]
YEARS = NUMBERS[1]
NAME = r"\b[A-Z][a-z]+\b"
NAMES = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
NUMERIC_FULL, ENTITY_FULL = 5, 15
#: Weights of the scores.
MCQ = {"definition": 0.25, "enumeration": 0.20, "numeric": 0.20, "alignment": 0.15, "length": 0.10, "entity": 0.10, "ambiguity": -0.15, "usage": -0.05}
QA = {"causal": 0.25, "mechanism": 0.25, "alignment": 0.20, "entity": 0.15, "conditional": 0.10, "comparison": 0.05, "ambiguity": -0.10, "usage": -0.05}
HARD = {"causal": 0.22, "comparison": 0.20, "mechanism": 0.18, "conditional": 0.12, "entity": 0.10, "numeric": 0.08, "alignment": 0.10, "ambiguity": -0.10, "usage": -0.08}


def _words(phrase: str) -> list[str]:
    """The words that a phrase may be made of; one that ends in ? stands for two."""
    return [w for x in phrase.split(" ") for w in ([x[:-2], x[:-1]] if x.endswith("?") else [x])]


def _any(words: set[str]) -> str:
    """An expression of the words, one branch for each first letter."""
    letters = sorted({w[0] for w in words})
    return rf"(?:{'|'.join(f'{x}(?:{'|'.join(sorted((w[1:] for w in words if w[0] == x), key=lambda w: (-len(w), w)))})' for x in letters)})\b"


def _runs_of_phrases() -> str:
    phrases = [p for groups in (*(g for _, g in PHRASES.values()), [PRONOUNS]) for g in groups for p in g]
    firsts, words = {w for p in phrases for w in _words(p.split(" ")[0])}, {w for p in phrases for w in _words(p)}
    return rf"(?i)(?=[{''.join(sorted({w[0] for w in firsts}))}])\b{_any(firsts)}(?: {_any(words)})*"


#: A word that a phrase begins with, and the words of phrases that follow it: every phrase in a text lies in one of these runs.
RUNS = _runs_of_phrases()


def said(text: Column) -> Column:
    """The runs of words that phrases and pronouns are made of, one a line: phrase_count() is that of the text, which is read once."""
    return F.array_join(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0)), "\n")


def phrase_count(text: Column, groups: list[list[str]], low: Column | None = None) -> Column:
    """Matches of the groups' phrases. low: the text in lower case; a group none of whose phrases it contains isn't searched for, which is far cheaper."""
    low = F.lower(text) if low is None else low
    counts = []
    for g in groups:
        heads = {p.split("?")[0][:-1] if "?" in p else p for p in g}
        there = None
        for h in sorted(heads):
            if not any(o != h and o in h for o in heads):
                there = F.contains(low, F.lit(h)) if there is None else there | F.contains(low, F.lit(h))
        counts.append(F.when(there, F.regexp_count(text, F.lit(rf"(?i)\b(?:{'|'.join(g)})\b"))).otherwise(0))
    return sum(counts[1:], counts[0])


def per_hundred(count: Column, tokens: Column, full: float) -> Column:
    """Count for each 100 tokens over `full`, at most 1; 0 without tokens."""
    return F.when(tokens > 0, F.least(count * F.lit(100.0) / tokens / F.lit(float(full)), F.lit(1.0))).otherwise(0.0)


def names(text: Column) -> Column:
    """Names, and twice the runs of several."""
    return F.regexp_count(text, F.lit(NAME)) + F.regexp_count(text, F.lit(NAMES)) * 2


def entity(text: Column, tokens: Column) -> Column:
    return per_hundred(names(text), tokens, ENTITY_FULL)


def length(tokens: Column, low: int = 200, high: int = 600) -> Column:
    t = tokens.cast("double")
    return F.when(tokens < low, t / low).when(tokens <= high, 1.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - (t - high) / high))


#: A piece of five tokens or more.
FIVE = r"^\s*+(?:\S++\s++){4}\S"


def pieces(text: Column) -> Column:
    """What stands between terminators."""
    return F.split(F.trim(text, F.lit(" \t\r\n")), r"[.!?]+")


def ambiguity(text: Column, tokens: Column, runs: Column | None = None, parts: Column | None = None) -> Column:
    """Pronouns for each token times 10, 0.2 for each sentence (none can end in a terminator once split at it), 0.1 for each piece under five tokens.
    runs, parts: said() and pieces() of the text, where they are columns already."""
    runs, parts = said(text) if runs is None else runs, pieces(text) if parts is None else parts
    return _vague(phrase_count(runs, [PRONOUNS]), _full(parts), _short(parts), tokens)


def _full(parts: Column) -> Column:
    return F.size(F.filter(parts, lambda p: F.trim(p, F.lit(" \t\r\n")) != ""))


def _short(parts: Column) -> Column:
    return F.size(F.filter(parts, lambda p: ~p.rlike(FIVE)))


def _vague(pronouns: Column, full: Column, short: Column, tokens: Column) -> Column:
    penalty = pronouns * F.lit(10.0) / tokens + full * F.lit(0.2) + short * F.lit(0.1)
    return F.when(tokens > 0, F.least(penalty, F.lit(1.0))).otherwise(1.0)


def usage(count: Column, most: int = 5) -> Column:
    return F.least(count.cast("double") / most, F.lit(1.0))


def counts(text: Column, runs: Column, parts: Column, digits: Column) -> dict[str, Column]:
    """What signals are made of, counted in the text. runs, parts: its said() and pieces(); digits: whether it has any, as most texts have none."""
    number = lambda p: F.when(digits, F.regexp_count(text, F.lit(p))).when(text.isNotNull(), 0)
    made = {name: phrase_count(runs, groups) for name, (_, groups) in PHRASES.items()}
    made |= {"numbers": sum([number(p) for p in NUMBERS[1:]], number(NUMBERS[0])), "years": number(YEARS), "names": names(text)}
    return made | {"pronouns": phrase_count(runs, [PRONOUNS]), "full": _full(parts), "short": _short(parts)}


def from_counts(df: DataFrame, c: dict[str, Column], alignment: Column | None = None, uses: str | None = None) -> DataFrame:
    """df(tokens, ...) with all signals, by the counts."""
    n = F.col("tokens")
    made = {name: per_hundred(c[name], n, full) for name, (full, _) in PHRASES.items()}
    made |= {
        "numeric": per_hundred(c["numbers"], n, NUMERIC_FULL),
        "entity": per_hundred(c["names"], n, ENTITY_FULL),
        "alignment": F.lit(0.0) if alignment is None else alignment,
        "length": length(n),
        "ambiguity": _vague(c["pronouns"], c["full"], c["short"], n),
        "usage": usage(F.col(uses)) if uses else F.lit(0.0),
        "years": c["years"],
    }
    return df.withColumns(made)


def with_signals(df: DataFrame, summary: str | None = None, uses: str | None = None) -> DataFrame:
    """df(text, ...) with tokens and all signals. summary: a column that the text is aligned with, or of its word set; uses: a column of earlier uses."""
    first = {"tokens": n_tokens(F.col("text")), "_said": said(F.col("text")), "_pieces": pieces(F.col("text")), "_digits": F.col("text").rlike("[0-9]")}
    if summary:
        ready = isinstance(df.schema[summary].dataType, ArrayType)
        first |= {"_own": word_set(F.col("text")), "_other": F.col(summary) if ready else word_set(F.col(summary))}
    df = df.withColumns(first)
    made = counts(F.col("text"), F.col("_said"), F.col("_pieces"), F.col("_digits"))
    df = from_counts(df, made, jaccard(F.col("_own"), F.col("_other")) if summary else None, uses)
    return df.drop("_said", "_pieces", "_digits", "_own", "_other")


#: Counts that don't add up where texts are joined by a space, as a phrase, a run of names or a sentence may go across; the others stand in one token.
#: No phrase has over four tokens, no begin of one is the end of another in its group, and a sentence is short below five.
ACROSS = (*PHRASES, "names", "full", "short")
HEAD = r"^\s*+(?:\S++\s++){4}\S++"


def ends(text: Column, tokens: Column) -> Column:
    """The text, of which a full stop stands for all but the first and last five tokens: what a joined text has across its parts, those of the parts' ends have too."""
    last = F.reverse(F.regexp_extract(F.reverse(text), HEAD, 0))
    return F.when(tokens > 10, F.concat(F.regexp_extract(text, HEAD, 0), F.lit(" . "), last)).otherwise(text)


def across(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the counts ACROSS of the text, as name_..."""
    df = df.withColumns({"_said": said(F.col(text)), "_pieces": pieces(F.col(text))})
    made = counts(F.col(text), F.col("_said"), F.col("_pieces"), F.lit(False))
    return df.withColumns({f"{name}_{k}": made[k] for k in ACROSS}).drop("_said", "_pieces")


def with_counts(df: DataFrame, tokens: str | None = None) -> DataFrame:
    """df(text, ...) with tokens, the counts as c_..., the text's ends and the counts of these as e_...: all that signals of joined texts need.
    tokens: a column of the number of tokens, if there is one."""
    t = F.col("text")
    df = df.withColumns({"tokens": F.col(tokens) if tokens else n_tokens(t), "_said": said(t), "_pieces": pieces(t), "_digits": t.rlike("[0-9]")})
    made = counts(t, F.col("_said"), F.col("_pieces"), F.col("_digits"))
    df = df.withColumns({f"c_{k}": x for k, x in made.items()} | {"ends": ends(t, F.col("tokens"))}).drop("_said", "_pieces", "_digits")
    return across(df, "ends", "e")


def counted(df: DataFrame) -> list[str]:
    """The columns of with_counts()."""
    return [c for c in df.columns if c in ("tokens", "ends") or c.startswith(("c_", "e_"))]


def signals_of_counted(df: DataFrame) -> DataFrame:
    """with_counts() as with_signals()."""
    made = from_counts(df, {c[2:]: F.col(c) for c in df.columns if c.startswith("c_")})
    return made.drop(*(c for c in counted(df) if c != "tokens"))


def weighted(weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(w) * F.col(name)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def with_scores(df: DataFrame) -> DataFrame:
    """df with signals, and mcq_score, qa_score and hard_score."""
    return df.withColumns({"mcq_score": weighted(MCQ), "qa_score": weighted(QA), "hard_score": weighted(HARD)})


def with_tags(df: DataFrame) -> DataFrame:
    """df with signals, and tags in fixed order."""
    marks = [(F.col(n) > 0.5, n) for n in ("definition", "comparison", "causal", "mechanism", "enumeration")]
    marks += [(F.col("years") >= 3, "timeline"), (F.col("numeric") > 0.6, "numeric_dense"), (F.col("entity") > 0.6, "entity_dense")]
    return df.withColumn("tags", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in marks])))
