"""Column expressions of scoring, text and vectors. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.sources.inputs import ALIASES, LAYERS

#: Words that are no keywords. Fixed values.
STOPWORDS = (
    "the a an is are was were be been being do does did have has had having my mine your yours our ours their theirs i you we they he she it me him her us them "
    "this that these those what when where who whom how why which and or but not no nor for to of in on at by from with about as if then than so too very "
    "can could would should may might will shall am"
).split()
#: Words of conceptual questions. Fixed values.
CONCEPTUAL = ["how", "why", "explain", "approach", "strategy", "tend", "overall", "architecture", "design", "philosophy", "pattern", "style", "in general", "generally", "怎么", "为什么", "如何", "倾向", "风格", "整体", "一般", "通常", "总体", "模式"]
#: Forms that name something exactly. Fixed values.
NAVIGATIONAL = [
    r"`[^`]+`",
    r'"[^"]{2,}"',
    r"'[^']{2,}'",
    r"[/\\][\w.\-]+[/\\]",
    r"\b[a-z][a-z0-9]*_[a-z0-9_]+\b",
    r"\b[A-Za-z][a-z0-9]+[A-Z][A-Za-z0-9]*\b",
    r"\bmem-[a-f0-9]{8,}\b",
    r"\b[a-f0-9]{8}(?:-[a-f0-9]{4}){3}-[a-f0-9]{12}\b",
    r"\bv?\d+\.\d+(?:\.\d+)?\b",
    r"\b[a-f0-9]{16,}\b",
    r"https?://\S+",
]
#: Names before secrets. Fixed values.
SECRET_KEYS = "password|passwd|pwd|api[_-]?key|apikey|secret|token|access[_-]?key|private[_-]?key|auth[_-]?token|bearer"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing, empty or zero, or lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x / norm)).otherwise(a)


def tokens(text: Column) -> Column:
    """Lower-case ASCII words and CJK runs."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+|[\x{4e00}-\x{9fff}]+"), F.lit(0))


def keywords(text: Column, most: int = 10) -> Column:
    """ASCII words of 3 letters or more that are no stop words, and CJK runs of 2 or more, once each in order."""
    good = F.filter(tokens(text), lambda t: F.when(t.rlike("^[a-z0-9]"), (F.length(t) >= 3) & ~t.isin(STOPWORDS)).otherwise(F.length(t) >= 2))
    return F.slice(F.array_distinct(good), 1, most)


def intent(text: Column) -> Column:
    low = F.lower(text)
    conceptual = F.lit(False)
    for w in CONCEPTUAL:
        conceptual = conceptual | low.contains(w)
    return F.when(text.rlike("|".join(NAVIGATIONAL)), "NAVIGATIONAL").when(conceptual, "CONCEPTUAL").otherwise("FACTUAL")


def language(text: Column) -> Column:
    """By the share of CJK among letters: zh from 0.3 on, en for none, else zh above 0.1."""
    cjk = F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]", ""))
    every = F.length(F.regexp_replace(text, r"\s", ""))
    share = F.when(every > 0, cjk / every).otherwise(F.lit(0.0))
    return F.when(share >= 0.3, "zh").when(share == 0, "en").when(share > 0.1, "zh").otherwise("en")


def sigmoid_bm25(score: Column, n_terms: Column) -> Column:
    middle = F.when(n_terms <= 2, 5.0).when(n_terms <= 5, 8.0).otherwise(12.0)
    slope = F.when(n_terms <= 2, 0.8).when(n_terms <= 5, 0.5).otherwise(0.3)
    return F.when(score <= 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-slope * (score - middle))))


def evidence_boost(n: Column) -> Column:
    return F.least(n / 5, F.lit(1.0)) * 0.3


def strength(access: Column, idle_days: Column, layer: Column) -> Column:
    """Forgetting by idle time, slowed by use; basic facts, schemas and intentions keep full strength."""
    return F.when(layer.isin("l0_basic_info", "l6_schema", "l7_intention"), F.lit(1.0)).otherwise((1 + F.log(F.greatest(access, F.lit(1)))) * F.exp(-idle_days / 180))


def composite(semantic: Column, idle_days: Column, importance: Column, access: Column) -> Column:
    recency = F.when(idle_days.isNull(), 0.5).when(idle_days < 0, 1.0).otherwise(F.pow(F.lit(0.9), F.floor(idle_days) / 30))
    return 0.5 * semantic + 0.3 * recency + 0.15 * importance + 0.05 * F.log(access + 1) / F.log(F.lit(101.0))


def layer_name(value: Column) -> Column:
    """The layer that a name or an older name stands for; null for an unknown one."""
    low = F.lower(F.trim(value))
    alias = F.coalesce(*(F.when(low == k, v) for k, v in ALIASES.items()), low)
    return F.when(alias.isin(LAYERS), alias)


def owner(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low == "user", "user").when(low.isin("agent", "assistant"), "agent")


def redact(text: Column) -> Column:
    keyed = F.regexp_replace(text, rf"(?i)((?:{SECRET_KEYS})\s*[=:]\s*)['\"]?([^\s'\"<>]+)['\"]?", "$1<REDACTED>")
    return F.regexp_replace(keyed, r"(?i)(--(?:password|api[_-]?key|token)\s+)([^\s]+)", "$1<REDACTED>")


def head_tail(text: Column, head: int, tail: int) -> Column:
    n = F.length(text)
    return F.when(n <= head + tail, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit("...["), (n - head - tail).cast("string"), F.lit(" omitted]..."), F.right(text, F.lit(tail))))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def normal_words(text: Column) -> Column:
    """The text's words without stop words and single CJK characters, by spaces."""
    return F.array_join(F.filter(tokens(text), lambda t: F.when(t.rlike("^[a-z0-9]"), ~t.isin(STOPWORDS)).otherwise(F.length(t) >= 2)), " ")


def since(text: Column) -> Column:
    """A day, yyyy-MM-dd or yyyy/MM/dd, at the start of the text as its first instant; null for anything else."""
    day = F.substring(F.regexp_replace(F.trim(text), r"^['\"]+", ""), 1, 10)
    return F.coalesce(*(F.when(day.rlike(p), F.try_to_timestamp(day, F.lit(f))) for p, f in ((r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd"), (r"^\d{4}/\d\d/\d\d$", "yyyy/MM/dd"))))


def map_patch(old: Column, new: Column) -> Column:
    """old with the keys of new set to its values."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def context_line(rank: Column, layer: Column, observed: Column, relation: Column, start: Column, end: Column, content: Column) -> Column:
    """`[rank] layer=... observed=... time_relation=... event=a..b | content`; what is null, blank or of no told time is left out."""
    day = lambda t: F.date_format(t, "yyyy-MM-dd")
    known = lambda c: F.when(F.trim(c) != "", F.trim(c))
    over = F.when(day(end) != day(start), F.concat(F.lit(".."), day(end)))
    told = F.when(~known(relation).isin("unknown", "atemporal"), known(relation))
    header = F.concat_ws(" ", F.concat(F.lit("layer="), known(layer)), F.concat(F.lit("observed="), day(observed)), F.concat(F.lit("time_relation="), told), F.concat(F.lit("event="), day(start), F.coalesce(over, F.lit(""))))
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), F.when(header != "", F.concat(header, F.lit(" | "))).otherwise(F.lit("")), F.coalesce(F.trim(content), F.lit("")))


#: Keys of a profile. Fixed values.
PROFILE_KEYS = ["name", "age", "location", "occupation", "employer"]


def profile_value(key: Column, value: Column) -> Column:
    """A profile's value as text: yes or no for a truth value, a whole number for an age that is one, trimmed; null for other keys and for blank, `null` and `none`."""
    text = F.trim(value)
    low = F.lower(text)
    age = F.coalesce(F.floor(text.try_cast("double")).cast("string"), text)
    kept = F.when(low == "true", "yes").when(low == "false", "no").when(key == "age", age).otherwise(text)
    return F.when(key.isin(PROFILE_KEYS) & ~low.isin("", "null", "none"), kept)
