"""Text functions as Catalyst expressions: clipping, counting, readability, facts, claims, injection attempts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import BLANK, count, every, has

# Word lists and patterns that decide results.
FACT = r"(?:[$€£]\s?\d[\d,]*(?:\.\d+)?)|(?:\b\d[\d,]*(?:\.\d+)?\s?(?:%|percent\b|[a-z]{3,}))"
NOT_A_FACT = r"^\d{4}\s?(?:acme|all|copyright)"
VAGUE = r"\b(best|leading|world[- ]class|cutting[- ]edge|state[- ]of[- ]the[- ]art|innovative|unique|premier|top[- ]quality|unrivall?ed|second to none|number one|revolutionary|next[- ]generation)\b"
DEFINING = r"\b(is|are|was|provides?|offers?|helps?|specialis(?:es|e)s?|makes?|sells?|builds?|designs?|runs?|delivers?|creates?|supplies|serves?|bakes?|brews?|repairs?|teaches|trains?|treats?|manufactures?)\b"
COPYRIGHT = r"(?:©|copyright)\s*(?:\(c\)\s*)?(\d{4})(?:\s*[-–—]\s*(\d{4}))?"
COMMON_ACRONYMS = "USA AUD USD FAQ FAQS CEO PDF URL HTML CSS UK EU NSW VIC QLD WA SA TAS ACT AM PM TV DIY GST ABN ACN NZ AI SEO RRP OK ID CBD HQ PO BBQ LED USB WIFI NBN".split()
AUDIENCE = r"(?<![\d.,])(\d{1,3}(?:,\d{3})+|\d{1,12})(?:\.(\d{1,2}))?\s?([KMB])?\s+(followers?|likes?|following|posts?|subscribers?|talking about this)(?![a-z])"
INJECTIONS = [
    r"\b(ignore|disregard|forget|override)\b[^.\n]{0,40}\b(previous|prior|above|earlier|all|any|the)\b[^.\n]{0,20}\binstructions?\b",
    r"\byou are now\b",
    r"\b(reveal|show|print|repeat|leak)\b[^.\n]{0,30}\b(system prompt|your prompt|your instructions)\b",
    r"</?\s*(system|assistant|developer)\s*>",
    r"\bnew instructions\s*:",
    r"\bas an ai( language)? model\b[^.\n]{0,40}\byou (must|should|will)\b",
]
#: A match of any of INJECTIONS holds one of these.
INJECTION_WORDS = ("instruction", "you are now", " prompt", "system", "assistant", "developer", "as an ai")
KEYWORD_STOPS = (
    "this that with from your have will about more what when where which their them they home page also been each every into most other over than then there these "
    "those were would while such only very just like make made many much some same here does doing being ours ourselves yours click menu search contact privacy policy "
    "terms cookie cookies login cart"
).split()
TOPIC_STOPS = (
    "this that with from your have will about more what when where which their them they home page shop online welcome best quality products product service services "
    "contact australia australian free view news blog menu search"
).split()
NOT_ENTITIES = "the our we your you welcome home about contact shop view read more shopping cart login sign free new all get see why how what when where who this that".split()
OPEN_FENCE, CLOSE_FENCE = "<<<UNTRUSTED_PAGE_TEXT>>>", "<<<END_UNTRUSTED_PAGE_TEXT>>>"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated a single time per row."""
    return F.transform(F.array(value), f)[0]


def js_round(x: Column) -> Column:
    """Half goes up, also below zero."""
    return F.floor(x + 0.5).cast("long")


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, BLANK + "+", " "), "^ | $", "")


def one_line(text: Column, most: int = 200) -> Column:
    return F.left(collapse(F.regexp_replace(text, r"[\x00-\x1f\x7f]+", " ")), F.lit(most))


def clip(text: Column, most: int = 160) -> Column:
    return once(collapse(text), lambda t: F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most - 1)), F.lit("…"))).otherwise(t))


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def sentences(text: Column) -> Column:
    parts = F.split(text, r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def syllables(word: Column) -> Column:
    """A letters-only word in lower case; silent endings and a leading y do not count."""
    stem = F.regexp_replace(F.regexp_replace(word, r"(?:[^laeiouy]es|ed|[^laeiouy]e)\z", ""), "^y", "")
    groups = F.size(F.regexp_extract_all(stem, F.lit("[aeiouy]{1,2}"), F.lit(0)))
    return F.when(word == "", 0).when(F.length(word) <= 3, 1).otherwise(F.greatest(groups, F.lit(1)))


def ease(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    n = n_words.cast("double")
    return js_round(F.lit(206.835) - F.lit(1.015) * (n / n_sentences) - F.lit(84.6) * (n_syllables / n))


def reading_ease(text: Column) -> Column:
    """struct<ease, words>; null where there is nothing to measure. For whole tables of texts: ``passes.reading_eases``."""
    kept = F.filter(F.transform(F.split(text, BLANK + "+"), lambda w: F.regexp_replace(w, "[^A-Za-z']", "")), lambda w: w != "")
    n_sentences = F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"[.!?]+(?:\s|\z)"), lambda s: F.trim(s) != "")))

    def score(w: Column) -> Column:
        # Letters in a list of their own: syllables() reads a word several times.
        letters = F.transform(w, lambda x: F.replace(F.lower(x), F.lit("'"), F.lit("")))
        total = F.aggregate(F.transform(letters, syllables), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(w) > 0, F.struct(ease(F.size(w), n_sentences, total).alias("ease"), F.size(w).cast("long").alias("words")))

    return once(kept, score)


def facts(text: Column) -> Column:
    """Distinct figures with a unit or a currency, lower case, first come first."""
    found = F.filter(F.transform(every(text, FACT), lambda m: F.trim(m)), lambda m: ~has(m, NOT_A_FACT))
    return F.array_distinct(F.transform(found, lambda m: F.lower(m)))


def vague_terms(text: Column) -> Column:
    """Superlatives in sentences without a digit."""
    claims = F.filter(sentences(text), lambda s: ~s.rlike("[0-9]"))
    return F.aggregate(F.transform(claims, lambda s: count(s, VAGUE)), F.lit(0), lambda a, x: a + x).cast("long")


def undefined_acronyms(text: Column) -> Column:
    """Two to six capitals, used twice or more and spelled out nowhere in brackets; sorted."""
    found = every(text, r"\b[A-Z]{2,6}\b", ignore_case=False)
    # Sorted, equal ones are neighbours: no list is compared with itself.
    again = lambda s: F.array_distinct(F.filter(s, lambda a, i: F.coalesce(a == F.get(s, i - 1), F.lit(False)) & ~a.isin(COMMON_ACRONYMS)))
    twice = once(F.array_sort(found), again)
    return F.array_sort(F.filter(twice, lambda a: ~text.contains(F.concat(F.lit("("), a, F.lit(")"))) & ~F.regexp_like(text, F.concat(a, F.lit(r"\s*\(")))))


def newest_copyright_year(text: Column) -> Column:
    years = F.concat(every(text, COPYRIGHT, 1), every(text, COPYRIGHT, 2))
    return F.array_max(F.transform(F.filter(years, lambda y: y != ""), lambda y: y.cast("int")))


def injection_attempts(text: Column) -> Column:
    """Matches of all patterns; the patterns run only where one of the words they cannot do without occurs."""
    total, low = F.lit(0), F.lower(text)
    for p in INJECTIONS:
        total = total + count(text, p)
    some = low.contains(INJECTION_WORDS[0])
    for w in INJECTION_WORDS[1:]:
        some = some | low.contains(w)
    return F.when(text.isNotNull(), F.when(some, total).otherwise(0)).cast("long")


def fenced(text: Column, most: int = 6000) -> Column:
    """Text marked as data: no run of three angle brackets survives, so it cannot close its fence."""
    return F.concat(F.lit(OPEN_FENCE + "\n"), F.left(F.regexp_replace(text, "<{3,}|>{3,}", " "), F.lit(most)), F.lit("\n" + CLOSE_FENCE))


def audience_note(text: Column) -> Column:
    """Up to three public counts, one a label; null where there are none."""
    parts = [every(text, AUDIENCE, g) for g in (1, 2, 3, 4)]
    rows = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "abcd", strict=True)])
    said = F.transform(
        rows,
        lambda r: F.struct(
            F.regexp_replace(F.lower(r["d"]), r"s\z", "").alias("key"),
            F.concat(r["a"], F.when(r["b"] != "", F.concat(F.lit("."), r["b"])).otherwise(""), F.upper(r["c"]), F.lit(" "), F.lower(r["d"])).alias("text"),
        ),
    )
    firsts = once(said, lambda s: F.filter(s, lambda x, i: F.array_position(s["key"], x["key"]) == i + 1))
    texts = F.slice(F.transform(firsts, lambda x: x["text"]), 1, 3)
    return F.when(F.size(texts) > 0, F.array_join(texts, ", "))


def normal_quote(text: Column) -> Column:
    """Lower-case words with single blanks: curly marks count as plain ones, and ASCII punctuation is dropped."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s!-/:-@\[-`{-~\x{00A0}…‘’‚‛′“”„‟″‐-―−]+", " "))


def verified(quote: Column, *fields: Column) -> Column:
    """Whether a quote of ten characters and three words or more stands in one of the fields, all normalised."""
    long_enough = (F.length(quote) >= 10) & (F.size(words(quote)) >= 3)
    inside = F.lit(False)
    for f in fields:
        inside = inside | F.coalesce(f.contains(quote), F.lit(False))
    return long_enough & inside


def escape_markdown(text: Column) -> Column:
    t = collapse(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, r"([\\`*_{}\[\]()#+!|~])", r"\\$1")


def code_span(text: Column) -> Column:
    t = F.regexp_replace(text, "[`\r\n]+", " ")
    t = F.replace(F.replace(t, F.lit("<"), F.lit("‹")), F.lit(">"), F.lit("›"))
    t = collapse(F.replace(t, F.lit("]("), F.lit("]​(")))
    return F.when(t == "", "").otherwise(F.concat(F.lit("`"), t, F.lit("`")))


def code_fence(text: Column) -> Column:
    """One backtick more than the longest run inside, three at least."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda r: F.length(r))), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


def escape_attribute(text: Column) -> Column:
    return escape_xml(one_line(text), "&#39;")


def escape_xml(text: Column, apostrophe: str = "&apos;") -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", apostrophe)):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def safe_file_name(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9.-]", ""), r"^[.-]+|[.-]+\z", "")
    return F.left(t, F.lit(80))


def compact_number(n: Column) -> Column:
    """1234 is 1.2K, 999950 and more are millions; whole below a thousand."""
    short = lambda x: F.regexp_replace(F.format_string("%.1f", x), r"\.0\z", "")
    return F.when(n >= 999_950, F.concat(short(F.floor(n / 100_000.0 + 0.5) / 10), F.lit("M"))).when(n >= 1_000, F.concat(short(F.floor(n / 100.0 + 0.5) / 10), F.lit("K"))).otherwise(n.cast("string"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").when(score.isNotNull(), "F")


def readiness_band(score: Column) -> Column:
    return F.when(score >= 80, "Strong").when(score >= 60, "Moderate").when(score >= 40, "Weak").when(score.isNotNull(), "Very weak")


def inp_rating(ms: Column) -> Column:
    return F.when(ms <= 200, "good").when(ms <= 500, "needs improvement").when(ms.isNotNull(), "poor")


def speed_credit(value: Column, good: float, poor: float) -> Column:
    return F.when(value <= good, 1.0).when(value <= poor, 0.5).when(value.isNotNull(), 0.0)


def retry_wait(attempt: Column, retry_after_ms: Column, base: float = 400.0, factor: float = 2.0, most: float = 4_000.0) -> Column:
    """Milliseconds before a further attempt, without jitter; what the server asks for wins, up to the cap."""
    return F.least(F.lit(most), F.coalesce(retry_after_ms.cast("double"), F.lit(base) * F.pow(F.lit(factor), attempt)))


def transient(status: Column) -> Column:
    return status.isin(408, 425, 429) | status.between(500, 599)
