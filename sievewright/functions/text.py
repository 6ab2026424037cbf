"""Tokens, words, sentences and extraction from strings, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """White-space tokens; those of null are null."""
    return F.array_remove(F.split(text, r"\s+"), "")


def n_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def word_set(text: Column) -> Column:
    """The different lower-cased words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all words of two word sets; 0 if either is empty or null."""
    # what they share is bound to a variable: below a condition it would be made twice
    share = F.get(F.transform(F.array(F.size(F.array_intersect(a, b)).cast("double")), lambda both: both / (F.size(a) + F.size(b) - both)), F.lit(0))
    return F.when((F.coalesce(F.size(a), F.lit(0)) > 0) & (F.coalesce(F.size(b), F.lit(0)) > 0), share).otherwise(0.0)


def sentences(text: Column) -> Column:
    """Runs up to and with their terminators, trimmed."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), lambda x: F.trim(x)), lambda s: s != "")


def trim_partial_sentences(text: Column) -> Column:
    """Sentences without a first one that begins in lower case and a last one without terminator, joined by spaces."""
    s = sentences(text)
    first = F.when((F.size(s) > 0) & ~F.get(s, F.lit(0)).rlike(r"^\p{Lu}"), 1).otherwise(0)
    last = F.when((F.size(s) > first) & ~F.element_at(s, -1).rlike(r"[.!?]$"), 1).otherwise(0)
    return F.when(F.size(s) > 0, F.array_join(F.slice(s, first + 1, F.greatest(F.size(s) - first - last, F.lit(0))), " ")).otherwise("")


def salvage_clauses(text: Column, least: int = 5) -> Column:
    """Like trim_partial_sentences, but a broken first sentence keeps what follows its first comma or semicolon and a broken last one what
    precedes its last, if at least `least` words remain."""
    s = sentences(text)
    head, tail = F.get(s, F.lit(0)), F.element_at(s, -1)
    after = F.trim(F.regexp_replace(head, r"^[^,;]*[,;]?", ""))
    before = F.trim(F.regexp_replace(tail, r"[,;]?[^,;]*$", ""))
    whole_head, whole_tail = head.rlike(r"^\p{Lu}"), tail.rlike(r"[.!?]$")
    one = F.size(s) == 1
    first = F.when(whole_head, head).when(n_tokens(after) >= least, after).otherwise("")
    last = F.when(whole_tail, tail).when(n_tokens(before) >= least, before).otherwise("")
    parts = F.when(one, F.array(first)).otherwise(F.concat(F.array(first), F.slice(s, 2, F.greatest(F.size(s) - 2, F.lit(0))), F.array(last)))
    return F.when(F.size(s) > 0, F.array_join(F.array_remove(parts, ""), " ")).otherwise("")


def xml_tag(text: Column, tag: str) -> Column:
    """What stands in the first closed tag, else after the first open one, else an empty string; trimmed."""
    closed, opened = F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1), F.regexp_extract(text, f"(?s)<{tag}>(.*)", 1)
    return F.trim(F.when(text.rlike(f"(?s)<{tag}>.*?</{tag}>"), closed).otherwise(opened), F.lit(" \t\r\n"))


def summary(text: Column) -> Column:
    """The final summary tag in any case, else the first 200 characters."""
    found = F.regexp_extract(text, r"(?is)<final_summary>(.*?)</final_summary>", 1)
    return F.when(found != "", F.trim(found, F.lit(" \t\r\n"))).otherwise(F.left(text, F.lit(200)))


def verdict(reasons: Column) -> Column:
    """What follows the last ##, trimmed."""
    return F.trim(F.element_at(F.split(reasons, "##"), -1))


def chunk_number(chunk_id: Column) -> Column:
    """The number after chunk_, else trailing digits, else 0."""
    found = F.coalesce(F.nullif(F.regexp_extract(chunk_id, r"chunk_(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(chunk_id, r"(\d+)$", 1), F.lit("")))
    return F.coalesce(found.try_cast("int"), F.lit(0))


def normalized_question(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def exact_match(a: Column, b: Column) -> Column:
    return F.coalesce((F.lower(F.trim(a)) == F.lower(F.trim(b))).cast("int"), F.lit(0))


def category_label(category: Column, entity: Column, requirement: Column) -> Column:
    """category||entity[requirement] where there is a requirement, else the category."""
    return F.when(requirement.isNotNull() & (requirement != ""), F.concat(category, F.lit("||"), F.coalesce(entity, F.lit("")), F.lit("["), requirement, F.lit("]"))).otherwise(category)


def paragraphs(text: Column) -> Column:
    """Lines without [n] marks, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"\[\d+\]", ""), "\n"), lambda x: F.trim(x)), lambda p: p != "")


def hash32(*parts: Column) -> Column:
    """32 bits of md5 as a long; the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def race_key(weight: Column, *parts: Column) -> Column:
    """Keys of an exponential race: the k smallest are a weighted sample without replacement. Weight 0 comes last."""
    u = (hash32(*parts) + 1).cast("double") / F.lit(4294967297.0)
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(1e300))
