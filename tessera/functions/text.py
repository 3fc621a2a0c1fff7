"""Text rules as column expressions: references, identifiers, similarity, denial phrases, citations, routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never identify code, and the phrases that decline an answer.
STOPWORDS = (
    "a an the and or to of in on for is are was were be been being that this these those with from by as at it its how what where which who when why does do did can could should would file files "
    "module modules code function class defined define implements implement handle handles using use used via into over about agent tools tool phase github repo repository answer question"
).split()
ABSTAIN = (
    r"(?i)\b(not (?:found|present|available|in the repo(?:sitory)?)|does not (?:contain|exist|appear|seem)|could ?n[o']t find|could not find|unable to (?:find|locate)"
    r"|no (?:\w+ )*(?:found|present|in the repo(?:sitory)?)|i (?:don'?t|do not) (?:know|see|find)|there (?:is|are) no|isn'?t (?:any|present|in))\b"
)
CITATION = r"\[\[\s*([^\[\]\s:]+):(\d+)(?:\s*-\s*(\d+))?\s*\]\]"


def github_login(email: Column) -> Column:
    """Login of a no-reply address, else null."""
    found = F.regexp_extract(F.trim(email), r"(?i)^(?:\d+\+)?([A-Za-z0-9-]+)@users\.noreply\.github\.com$", 1)
    return F.when(found != "", found)


def pr_numbers(message: Column) -> Column:
    """Distinct numbers of ``#n`` and ``GH-n`` in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(message, F.lit("")), F.lit(r"(?i)(?:#|GH-)(\d+)\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def scrub(text: Column) -> Column:
    """Without NUL characters."""
    return F.translate(text, "\0", "")


def query_identifiers(query: Column) -> Column:
    """Code-like tokens first: distinct by lower case, at least 3 letters, no stopwords; by score, then length, then token."""
    tokens = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    good = F.filter(tokens, lambda t: (F.length(t) >= 3) & ~F.array_contains(F.array(*[F.lit(w) for w in sorted(set(STOPWORDS))]), F.lower(t)))
    low = F.transform(good, lambda t: F.lower(t))
    first = F.filter(good, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
    score = lambda t: (
        F.when(t.contains("_"), 20).otherwise(0) + F.when(t.rlike(r"^.[\s\S]*[A-Z]"), 15).otherwise(0) + F.when(t.rlike("^[A-Z]"), 8).otherwise(0) + F.least(F.length(t), F.lit(24))
    )
    ranked = F.array_sort(F.transform(first, lambda t: F.struct((-score(t)).alias("a"), (-F.length(t)).alias("b"), t.alias("t"))))
    return F.transform(ranked, lambda x: x["t"])


def trigrams(text: Column) -> Column:
    """Distinct padded trigrams of the lower-case alphanumeric words."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared part of two trigram sets."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def overlap_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]{3,})"), F.lit(1)))


def abstains(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("")).rlike(ABSTAIN)


def route_group(path: Column) -> Column:
    """First segment that is no parameter, upper-case; ROOT if none."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.startswith("{") & ~x.startswith(":"))
    return F.upper(F.coalesce(F.get(parts, F.lit(0)), F.lit("root")))


def norm_route(path: Column) -> Column:
    """Leading slash, no trailing one."""
    p = F.regexp_replace(F.concat(F.lit("/"), F.trim(path)), "/+", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)


def clip(text: Column, most: int) -> Column:
    """At most ``most`` characters; a cut text ends in an ellipsis."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def diagram_label(text: Column) -> Column:
    """A label that can stand between quotes in a diagram."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit("'")), r"[\r\n]+", " ")
