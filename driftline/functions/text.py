"""Text rules as column expressions: content words, their overlap, question cues, vector cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without weight, and words taken to mean others.
STOP = "the a an of in on and or is are was were for to from with by all any their every each do does we have".split()
SYNONYMS = {
    "many": ["count", "number"],
    "number": ["count"],
    "how": ["count"],
    "name": ["named"],
    "names": ["name"],
    "song": ["songs", "track", "title"],
    "songs": ["song"],
    "year": ["years"],
    "list": ["show", "display"],
    "show": ["list", "display"],
    "find": ["show", "list"],
    "average": ["avg", "mean"],
    "smallest": ["min", "minimum"],
    "largest": ["max", "maximum"],
    "oldest": ["max"],
    "youngest": ["min"],
    "people": ["singer", "singers", "artist", "artists"],
    "singer": ["singers", "artist", "artists"],
    "singers": ["singer", "artist", "artists"],
    "artist": ["singer", "singers", "artists"],
    "artists": ["singer", "singers", "artist"],
    "release": ["released"],
}
# Cues of a question whose answer isn't empty; of one with a single value; with groups; with several
# attributes; with a list.
AFFIRMATIVE = r"\b(?:how\s+many|count|list|what|which|find|show|name|who|where|number\s+of|total)\b"
SCALAR = r"^\s*(?:count|how many|how much|average|total|sum|number of|max(?:imum)?|min(?:imum)?|what is the (?:average|total|number|count|maximum|minimum|highest|lowest|oldest|youngest|largest|smallest))\b"
GROUPED = r"\b(?:by|per|for each|in each)\b"
SEVERAL = r"^\s*(?:list|show|find|give|what are|display)\b[^?]*?\w(?:,\s*\w| and \w)"
LISTED = r"^\s*(?:list|show|what are|display)\b"


def cue(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def plain_tokens(text: Column) -> Column:
    """Distinct runs of a-z that carry weight."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))), F.array(*map(F.lit, STOP)))


def tokens(text: Column) -> Column:
    """plain_tokens and, one level deep, what they are taken to mean."""
    means = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    plain = plain_tokens(text)
    return F.array_union(plain, F.flatten(F.transform(plain, lambda t: F.coalesce(F.try_element_at(means, t), none))))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets given as arrays without repeats; 1 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(F.lit(1), either))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def strip_fences(text: Column) -> Column:
    """The query in a generated answer: without thinking, code fences and final semicolons."""
    out = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"(?s)^<think>.*?</think>\s*", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)^```sql\s*", ""), r"^```\s*", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s*```$", ""), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(out, r";+$", ""), r"\s+$", "")
