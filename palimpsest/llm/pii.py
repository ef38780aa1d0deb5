"""Personal data: spans proposed by generators, judged by boosted trees.

Strict patterns give the base spans, which always count. Looser generators
propose more, overlapping spans of the same kinds: addresses spelled out, phone
numbers without a country code, digits in other groupings. Boosted trees see
each proposal's format and the words around it; what passes its kind's
calibrated threshold, and overlaps nothing better, is added.

The trees are fitted on a bounded sample of documents, from their base spans:
each is rewritten in place, in its own surroundings, in the loose forms of its
kind and as it stands before another number that a base pattern would swallow.
These are positive. Negative are decoys in the same places: what looks like the
kind but fails its check, or is another thing that people write with the same
signs. Other proposals in the texts may or may not be personal data, so they
teach nothing. Thresholds come from scores by trees that haven't seen the span.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.tables import alone, documents, fresh, in_short_batches
from palimpsest.llm.trees import BoostedTrees

KINDS = ("email", "ip", "card", "phone")
#: Documents of the fitting sample, and examples from it, at most; folds of the calibration.
SAMPLE_DOCS, SAMPLE_SPANS, FOLDS = 20_000, 20_000, 3
#: Share of accepted proposals that must be right in the folds that trees haven't seen.
PRECISION = 0.98
#: Characters on either side that context features see.
CONTEXT = 32

# Equal to the base patterns; a lookbehind and possessive repeats only spare what can't match.
_local = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_email_on, _email = re.compile(_local), re.compile(r"(?<![A-Za-z0-9._%+-])" + _local)
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digit, _dotted = re.compile("[0-9]"), re.compile("[0-9][0-9.]*")
#: Stretches that a loose pattern of numbers lies within.
_numbers = re.compile(r"[0-9][0-9 ()\[\]./_+-]*[0-9]")

_loose_email = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}+(?: ?(?:@|\(at\)|\[at\]) ?[\w-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[\w-]{1,63}){1,5}| at [\w-]{1,63}(?:(?:\.| dot )[\w-]{1,63}){1,5})")
_loose_hex = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_loose = [
    (1, re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?\. ?| ?\[\.\] ?)[0-9]{1,3}(?: ?\. ?| ?\[\.\] ?)[0-9]{1,3}(?: ?\. ?| ?\[\.\] ?)[0-9]{1,3}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}([ ./_-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?:\1[0-9]{1,3})?(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+.-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])")),
    (3, re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")),
]
_hints = {"email": re.compile(r"mail|contact|write|@", re.I), "ip": re.compile(r"\bip\b|host|server|address|addr", re.I), "card": re.compile(r"card|visa|pay|credit|account", re.I), "phone": re.compile(r"phone|call|tel|mobile|fax|dial", re.I)}
_digits_only = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end): leftmost matches of each base pattern that pass its check, in order."""
    out = []
    if "@" in text:
        at = 0
        while m := _email_on.match(text, at) or _email.search(text, at):
            out.append((m.start(), 0, m.end()))
            at = m.end()
    if _digit.search(text):
        for run in _dotted.finditer(text):
            if run[0].count(".") >= 3:
                for m in _ip.finditer(text, run.start(), run.end()):
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        out.append((m.start(), 1, m.end()))
        for m in _card.finditer(text):
            if m.end() - m.start() <= 37:
                d = _digits_only.sub("", m[0])
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _phone.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the loose generators, overlapping as they come."""
    found = set()
    if "@" in text or "(at)" in text or "[at]" in text or " at " in text:
        found.update((m.start(), 0, m.end()) for m in _loose_email.finditer(text))
    if text.count(":") > 2:
        found.update((m.start(), 1, m.end()) for m in _loose_hex.finditer(text))
    for run in _numbers.finditer(text):
        begin, end = max(0, run.start() - 1), min(len(text), run.end() + 1)
        for k, pattern in _loose:
            found.update((m.start(), k, m.end()) for m in pattern.finditer(text, begin, end) if m.end() <= run.end())
    return sorted(found)


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = _digits_only.sub("", span)
    groups = re.findall("[0-9]+", span)
    parts = re.split(r"[^0-9A-Za-z]+", span)
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        len(span),
        len(digits),
        len(groups),
        max(map(len, groups), default=0),
        len(groups[-1]) if groups else 0,
        sum(not c.isalnum() for c in span),
        sum(c.isalpha() for c in span),
        float("@" in span),
        float(" " in span),
        span.count("."),
        float("(" in span),
        span.count(":"),
        float("::" in span),
        float(" at " in span),
        float(" dot " in span or "dot)" in span or "dot]" in span),
        float(luhn(digits)) if 12 <= len(digits) <= 19 else -1.0,
        max((int(g) for g in groups if len(g) < 6), default=-1),
        len(parts[-1]),
        float(parts[-1].isalpha()),
        float(parts[-1].islower()),
        float(". " in span),
        float(len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)),
        float(bool(_hints[KINDS[kind]].search(before))),
        float(bool(_hints[KINDS[kind]].search(after))),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(before[-1:] in "+$#="),
        sum(map(str.isdigit, before)),
        sum(map(str.isdigit, after)),
    ]


def loose_forms(span: str, kind: int) -> list[str]:
    """The span as people might write it who don't follow the pattern."""
    if kind == 0:
        name, _, host = span.partition("@")
        return [name + at + host.replace(".", dot) for at, dot in ((" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" @ ", "."))]
    if kind == 1:
        a, b, c, d = (int(p) for p in span.split("."))
        return [span.replace(".", dot) for dot in (" . ", "[.]", " [.] ")] + [f"2001:db8:{a:x}{b:02x}:{c:x}{d:02x}::1"]
    digits = _digits_only.sub("", span)
    if kind == 2:
        return [sep.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for sep in "._/"] if len(digits) > 12 else []
    local, area = digits[-7:], digits[-10:-7] or digits[:3]
    return [form.format(area, local[:3], local[3:]) for form in ("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "001 {} {} {}")]


def swallowed_forms(span: str, kind: int, pick: random.Random) -> list[tuple[str, str]]:
    """The span, and what may follow it so that the base pattern takes both together and rejects them."""
    n = lambda a, b: pick.randrange(a, b)
    if kind == 2:
        return [(span, f" {n(10, 100)} {n(1000, 10_000)}")] if len(span) == 19 else []
    return [(span, f" {n(1, 256)}.{n(0, 256)}.{n(0, 256)}.{n(1, 256)}"), (span, f" {n(10**15, 10**16)}")] if kind == 3 else []


def decoys(span: str, kind: int, pick: random.Random) -> list[str]:
    """What is not personal data, but would be proposed as of the kind."""
    n = lambda a, b: pick.randrange(a, b)
    if kind == 0:
        a, b, c = (pick.choice(("look", "meet", "prices", "home", "noon", "this", "place", "they")) for _ in range(3))
        return [f"{a} @ {b}", f"{a} @ {b}. {c.capitalize()}", f"{n(1, 90)} @ {n(1, 90)}.{n(10, 99)}", f"{a} at {b}.{c.capitalize()}", f"{a} at {n(1, 90)}.{n(10, 99)}"]
    if kind == 1:
        parts = [n(256, 1000), n(0, 400), n(0, 400), n(0, 400)]
        pick.shuffle(parts)
        return [dot.join(map(str, parts)) for dot in (".", " . ", "[.]")] + [":".join(f"{n(0, 60):02d}" for _ in range(4)), ":".join(f"{n(0, 256):02x}" for _ in range(6))]
    if kind == 2:
        digits = _digits_only.sub("", span)
        wrong = digits[:-1] + str((int(digits[-1]) + n(1, 10)) % 10)
        return [sep.join(wrong[i : i + 4] for i in range(0, len(wrong), 4)) for sep in ("", " ", "-", ".", "_", "/")]
    return [f"{n(100, 1000)}.{n(100, 1000)}.{n(100, 1000)}", f"{n(1900, 2030)} {n(1900, 2030)} {n(1900, 2030)}", f"{n(100, 1000)}-{n(1000, 10_000)}", f"{n(10, 100)}/{n(100, 1000)}/{n(1900, 2030)}", f"{n(100, 1000)} {n(100, 1000)} {n(100, 1000)}", f"+{n(1, 10)} {n(100, 1000)}.{n(100, 1000)}.{n(1000, 10_000)}.{n(10, 1000)}.{n(10, 100)}"]


#: What may stand before personal data, or before what only looks like it.
LEADS = (
    ("write to ", "my email is ", "contact: ", "mail "),
    ("host ", "the server at ", "ip ", "address: "),
    ("card ", "pay with ", "visa ", "account "),
    ("call ", "phone: ", "my mobile is ", "tel. "),
)
ENDS = ("com", "org", "net", "info", "de", "io", "co.uk")
#: Made-up spans of each kind that are learnt from beside those of the table.
SEEDS = 40


def word(pick: random.Random, least: int = 2, most: int = 9) -> str:
    return "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(pick.randrange(least, most + 1)))


def made_up(kind: int, pick: random.Random) -> str:
    """A span of the kind that the base pattern takes."""
    n = lambda a, b: pick.randrange(a, b)
    if kind == 0:
        name = pick.choice((word(pick), f"{word(pick)}.{word(pick)}", f"{word(pick)}{n(1, 1000)}", f"{word(pick, 1, 1)}_{word(pick)}"))
        return f"{name}@{word(pick, 3)}.{pick.choice(ENDS)}"
    if kind == 1:
        return ".".join(str(n(0, 256)) for _ in range(4))
    if kind == 2:
        digits = "".join(str(n(0, 10)) for _ in range(pick.choice((15, 15, 15, 14, 18))))
        return next(digits + str(c) for c in range(10) if luhn(digits + str(c)))
    return f"+{n(1, 100)} ({n(200, 1000)}) {n(200, 1000)}-{n(1000, 10_000)}"


def seeds(pick: random.Random, each: int = SEEDS) -> list[str]:
    """Texts that hold one made-up span each."""
    sentence = lambda: " ".join(word(pick, 1) for _ in range(6))
    return [f"{sentence()} {made_up(k, pick)}{pick.choice((' ', ', ', '. '))}{sentence()}" for k in range(len(KINDS)) for _ in range(each)]


def examples(text: str, pick: random.Random) -> list[tuple[list[float], int, float]]:
    """(features, place of the span, target) of proposals for the base spans of a text rewritten, and for decoys in their stead.

    Every form, of the span and of a made-up one, and every decoy stands once in
    the surroundings as they are, and once behind words that announce its kind.
    """
    out = []
    for place, (s, k, e) in enumerate(base_spans(text)):
        span, after = text[s:e], text[e : e + 2 * CONTEXT]
        other = made_up(k, pick)
        right = [(span, ""), *((f, "") for f in loose_forms(span, k)), *((f, "") for f in loose_forms(other, k)), *swallowed_forms(span, k, pick)]
        wrong = decoys(span, k, pick)
        for lead in ("", pick.choice(LEADS[k])):
            before = text[max(0, s - 2 * CONTEXT) : s] + lead
            at = len(before)
            for form, behind in right:
                near = before + form + behind + after
                # what is inside of the form is only a part of it
                out += [(features(near, p, q, r), place, float((p, r) == (at, at + len(form)))) for p, q, r in proposals(near) if q == k and at <= p and r <= at + len(form)]
            for form in wrong:
                near = before + form + after
                out += [(features(near, p, q, r), place, 0.0) for p, q, r in proposals(near) if p < at + len(form) and r > at]
    return out


class Judge:
    """Trees and a threshold for each kind (above 1: never), from features, targets, and a number of each example's span, by which it is dealt into folds."""

    def __init__(self, x: np.ndarray, y: np.ndarray, of: np.ndarray | None = None, precision: float = PRECISION):
        self.thresholds, self.model = [2.0] * len(KINDS), None
        if len(y) < 50 or y.min() == y.max():
            return
        fold, p = (np.arange(len(y)) if of is None else of) % FOLDS, np.zeros(len(y))
        for f in range(FOLDS):
            if (fold == f).any() and (fold != f).any():
                p[fold == f] = BoostedTrees().fit(x[fold != f], y[fold != f]).probability(x[fold == f])
        self.model = BoostedTrees().fit(x, y)
        for k in range(len(KINDS)):
            own = x[:, k] == 1
            order = np.argsort(-p[own], kind="stable")
            sorted_p, hit = p[own][order], y[own][order]
            # one more error than was seen is allowed for
            right = hit.cumsum() / (np.arange(len(hit)) + 2)
            good = np.flatnonzero(right >= precision)
            if len(good):
                below = sorted_p[good[-1] + 1] if good[-1] + 1 < len(hit) else 0.0
                self.thresholds[k] = float(max((sorted_p[good[-1]] + below) / 2, 0.5))

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        if self.model is None:
            return []
        free = [s for s in proposals(text) if not any(s[0] < b[2] and b[0] < s[2] for b in base)]
        if not free:
            return []
        p = self.model.probability(np.array([features(text, *s) for s in free]))
        taken: list[tuple[int, int, int]] = []
        for i in sorted(range(len(free)), key=lambda i: (-round(p[i], 2), free[i][0] - free[i][2], free[i])):
            s = free[i]
            if p[i] >= self.thresholds[s[1]] and not any(s[0] < t[2] and t[0] < s[2] for t in taken):
                taken.append(s)
        return taken

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base = base_spans(text)
        return base, sorted(base + self.added(text, base))


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by the first one's kind in angle brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def fitted(df: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_spans: int = SAMPLE_SPANS) -> Judge:
    """Trees from about sample_docs texts that hold a digit or an @, chosen by a 64-bit hash of them, at most sample_spans examples, in order of that hash, and those of made-up spans.

    A text counts once, however often it comes, and is read whole whatever its
    length. Null and empty texts, and an empty table, add nothing to the made-up
    spans.
    """
    marked = in_short_batches(df).select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]"))

    @F.pandas_udf("array<array<double>>")
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [[*x, place, y] for x, place, y in examples(t, random.Random(len(t)))])

    share = min(1.0, sample_docs / max(df.count(), 1))
    hashed = marked.withColumn("h", F.xxhash64("text")).where(F.col("h") <= min(int(share * 2**64), 2**64 - 1) - 2**63).dropDuplicates(["h"])
    rows = hashed.select("h", F.explode(of("text")).alias("e")).orderBy("h", "e").limit(sample_spans).collect()
    pick = random.Random(9)
    rows = [(r["h"], r["e"]) for r in rows] + [(n, [*x, place, y]) for n, t in enumerate(seeds(pick)) for x, place, y in examples(t, pick)]
    kept = np.array([e for _, e in rows], float)
    spans = np.array([h for h, _ in rows], np.int64) % 1_000_003 + kept[:, -2].astype(np.int64)
    return Judge(kept[:, :-2], kept[:, -1], spans)


def found(text: Column, judge: Judge, redact: bool = True) -> Column:
    """Struct of the base counts (n_email, ...), base_sha256, spans and, if asked for, the redacted text. Null texts count as empty."""
    fields = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"]

    @F.pandas_udf(", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, redacted string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        alone()
        for s in batches:
            rows = []
            for t in s:
                base, every = judge.spans(t or "")
                rows.append((*(sum(x[1] == k for x in base) for k in range(len(KINDS))), sha256(told(base).encode()).hexdigest(), told(every), (redacted(t, every) if every else t) if redact else None))
            yield pd.DataFrame(rows, columns=fields)

    return of(text)


def with_spans(df: DataFrame, text: str = "text", judge: Judge | None = None, redact: bool = True) -> DataFrame:
    """df with n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added) and redacted (null unless asked for).

    Null and empty texts have no spans; a null text stays null when redacted.
    Texts of any length are read whole. Repeated rows have equal spans, and an
    empty table gives an empty table. Columns of these names are replaced.
    """
    name = fresh(df, "pii")
    out = in_short_batches(df).withColumn(name, found(F.col(text), judge or fitted(df, text), redact))
    return out.withColumns({c: F.col(f"{name}.{c}") for c in [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"]}).drop(name)


def without_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """df with all spans of its text redacted, each by its kind in angle brackets; every row and column stays. Null texts stay null; see with_spans for the rest."""
    name = fresh(df, "pii")
    return in_short_batches(df).withColumn(name, found(F.col(text), fitted(df, text))).withColumn(text, F.col(f"{name}.redacted")).select(*df.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of base spans and all spans of each document, by trees fitted on the same documents."""
    out = with_spans(documents(spark, sf_dir).select("doc_id", "text"), redact=False)
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans")
