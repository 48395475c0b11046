"""Quality rules as weak supervision, DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. A document is good or bad in one of a few ways
(KINDS: repetitive, noisy, shouting, broken), for documents that repeat themselves and those full of symbols have
little in common. Expectation-maximisation over all documents estimates the shares of these classes and how each
rule votes in each of them, which is its accuracy there; the posterior probability of the good class replaces the
test that all rules pass. One bad vote decides nothing by itself: it counts as much as the rule's estimated
accuracy and the other votes let it.

Documents matter to the estimate only by their votes, so the cluster counts vote patterns (at most 3 to the
number of rules) and the driver iterates on these counts; the posterior is then a sum of constants by vote and
class, a Catalyst expression.

A text is analysed once: the measures are written to the shared folder, and both the counts and the result
read them from there. Sums over a text stay inside the row (array functions, values bound once by a one-element
``transform``), so nothing is exploded or shuffled.

Defined results: null and empty texts have no words and fail the base rules; a rule that cannot judge
abstains; an empty table gives an empty result; ties and repeated rows change nothing; other columns are kept,
and new names made unique. Windows of three words are compared by a 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, free_name

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_caps", "n_stops", "n_marks", "n_marked", "n_letters")
SYMBOLS = r"#*$%&|<>"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeat_words(words: Column) -> Column:
    """Words inside windows of three words that the text has twice or more."""

    def windows(hashes: Column) -> Column:
        return F.transform(F.slice(hashes, 1, F.size(hashes) - 2), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))

    def covered(found: Column) -> Column:
        """found: places of repeated windows in order; each covers three words, less those covered before."""
        steps = F.transform(found, lambda p, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), p - F.get(found, i - 1))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        # Outside the array, get() is null, which filter takes for no.
        again = lambda s: F.filter(s, lambda x, i: (x["g"] == F.get(s, i - 1)["g"]) | (x["g"] == F.get(s, i + 1)["g"]))
        places = bind(ordered, lambda s: F.sort_array(F.transform(again(s), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(bind(places, covered))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: bind(windows(h), count)))


def measures(text: Column) -> Column:
    """struct of MEASURES of a text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda xs: F.length(t) - F.length(F.regexp_replace(t, "[" + xs + "]+", ""))
    caps = lambda w: F.size(F.filter(w, lambda x: (F.upper(x) == x) & (F.lower(x) != x) & (F.length(x) > 1)))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            caps(w).cast("long").alias("n_caps"),
            F.size(F.filter(w, lambda x: x.rlike("[" + SYMBOLS + "]"))).cast("long").alias("n_marked"),
        )

    a = bind(words_of(t), of_words)
    b = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    c = F.struct(without(SYMBOLS).cast("long").alias("n_symbols"), without(r"\p{L}").cast("long").alias("n_letters"), (F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))).cast("long").alias("n_stops"), (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_marks"))
    return F.struct(a.alias("a"), b.alias("b"), c.alias("c"))


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with one column per measure; the names they got."""
    m = free_name(docs, "_m")
    # The array around the struct keeps later projections from repeating the expression.
    rows = docs.select("*", F.explode(F.array(measures(F.col(text)))).alias(m))
    names = {k: free_name(docs, k) for k in MEASURES}
    where = {"n_lines": "b", "n_dup_lines": "b", "n_symbols": "c", "n_stops": "c", "n_marks": "c", "n_letters": "c"}
    return rows.select(*docs.columns, *[F.col(m)[where.get(k, "a")][k].alias(n) for k, n in names.items()]), names


def base_failed(c: dict[str, str]) -> Column:
    return (F.col(c["n_words"]) < 50) | (F.col(c["n_repeat_words"]) * 100 > F.col(c["n_words"]) * 50)


#: The rules in order, and the ways of being bad with the rules that tell of them.
RULES = ("words", "word_length", "symbols", "marked", "letters", "lines", "repeats", "capitals", "exclamations", "stops", "vocabulary")
KINDS = {"repetitive": ("lines", "repeats", "vocabulary"), "noisy": ("symbols", "marked", "letters"), "shouting": ("capitals", "exclamations"), "broken": ("words", "word_length", "stops")}


def votes(c: dict[str, str]) -> list[Column]:
    """The votes of RULES. Each is 1, -1 or 0; the thresholds leave a band between good and bad where a rule abstains."""
    n = F.col(c["n_words"])

    def by(value: Column, good: Column, bad: Column) -> Column:
        return F.when(n == 0, F.lit(0)).when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    share = lambda k: F.try_divide(F.col(c[k]), n)
    length = F.try_divide(F.col(c["word_chars"]), n)
    letters = F.try_divide(F.col(c["n_letters"]), F.col(c["word_chars"]))
    repeat, symbol, marked, caps, marks, stops = (share(k) for k in ("n_repeat_words", "n_symbols", "n_marked", "n_caps", "n_marks", "n_stops"))
    lines = F.try_divide(F.col(c["n_dup_lines"]), F.col(c["n_lines"]))
    fresh = F.try_divide(F.col(c["n_distinct"]), F.sqrt(n.cast("double")))
    by_rule = {
        "words": by(n, n >= 80, n < 50),
        "word_length": by(length, length.between(3.0, 10.0), (length < 2.5) | (length > 12.0)),
        "symbols": by(symbol, symbol < 0.05, symbol > 0.2),
        "marked": by(marked, marked < 0.03, marked > 0.15),
        "letters": by(letters, letters > 0.85, letters < 0.7),
        "lines": by(lines, lines < 0.1, lines > 0.3),
        "repeats": by(repeat, repeat < 0.2, repeat > 0.5),
        "capitals": by(caps, caps < 0.1, caps > 0.4),
        "exclamations": by(marks, marks < 0.1, marks > 0.3),
        "stops": by(stops, stops.between(0.01, 0.5), (stops < 0.002) & (n > 150)),
        "vocabulary": by(fresh, fresh > 4.0, (fresh < 2.0) & (n >= 50)),
    }
    return [by_rule[r] for r in RULES]


def prior_model() -> tuple[list[float], list[list[float]]]:
    """Shares of the classes (good first, then KINDS) and by class and rule the probability of a good vote, as believed beforehand."""
    good = [0.95] * len(RULES)
    bad = [[0.1 if r in own else 0.9 for r in RULES] for own in KINDS.values()]
    return [0.8, *[0.2 / len(KINDS)] * len(KINDS)], [good, *bad]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 300, belief: float = 0.02) -> tuple[list[float], list[list[float]]]:
    """Expectation-maximisation on counted vote patterns, from prior_model() on.

    The prior counts as much as the share ``belief`` of all documents, so it weighs alike at every size: it keeps
    a class that hardly occurs what it is meant to be. A rule that a kind is known by, but that votes good there
    as often as on good documents, tells nothing and is left out of both.
    """
    import numpy as np

    shares, right = (np.array(x) for x in prior_model())
    patterns = sorted(patterns)
    total = sum(c for _, c in patterns)
    if not total:
        return shares.tolist(), right.tolist()
    v, n = np.array([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    good, bad = (v > 0).astype(float), (v < 0).astype(float)
    weight, old_shares, old_right = belief * total, shares, right
    for _ in range(rounds):
        p = responsibilities(good, bad, shares, right) * n[:, None]
        new_shares = (p.sum(0) + weight * old_shares) / (total + weight)
        voted, agreed = p.T @ (good + bad), p.T @ good
        new = np.clip((agreed + weight * old_right) / (voted + weight), 0.01, 0.99)
        for k, own in enumerate(KINDS.values(), 1):
            for r in map(RULES.index, own):
                if new[k, r] >= new[0, r]:
                    new[k, r] = new[0, r]
        moved = max(abs(new_shares - shares).max(), abs(new - right).max())
        shares, right = new_shares, new
        if moved < 1e-9:
            break
    return shares.tolist(), right.tolist()


def responsibilities(good, bad, shares, right):
    """Probabilities of the classes, by row; good, bad: 1 where a rule votes so."""
    import numpy as np

    z = np.log(shares) + good @ np.log(right).T + bad @ np.log(1 - right).T
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def posterior(v: list[Column], shares: list[float], right: list[list[float]]) -> Column:
    """The probability of the good class, given votes."""
    odds = []
    for share, own in zip(shares[1:], right[1:], strict=True):
        z = F.lit(math.log(share / shares[0]))
        for x, g, b in zip(v, right[0], own, strict=True):
            if g != b:
                z = z + F.when(x == 1, math.log(b / g)).when(x == -1, math.log((1 - b) / (1 - g))).otherwise(0.0)
        odds.append(F.exp(z))
    return 1 / (1 + sum(odds[1:], odds[0]))


def judged(rows: DataFrame, names: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Measured rows with base_failed, quality_probability and kept; all names. Writes the rows once."""
    rows, names = Stash(rows.sparkSession).put(rows), dict(names)
    v = votes(names)
    counted = rows.groupBy(F.array(*v).alias("v")).agg(F.count("*").alias("n")).collect()  # at most 3 ** len(v) rows
    model = estimate([(tuple(r["v"]), r["n"]) for r in counted])
    for k in ("base_failed", "quality_probability", "kept"):
        names[k] = free_name(rows, k)
    _v = free_name(rows, "_v")
    out = rows.withColumn(_v, F.array(*v)).withColumn(names["base_failed"], base_failed(names))
    out = out.withColumn(names["quality_probability"], posterior([F.col(_v)[i] for i in range(len(v))], *model)).drop(_v)
    return out.withColumn(names["kept"], ~F.col(names["base_failed"]) & (F.col(names["quality_probability"]) >= 0.5)), names


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents kept, with the columns of docs."""
    out, names = judged(*measured(docs))
    return out.where(F.col(names["kept"])).select(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows, names = measured(docs)
    out, _ = judged(rows.drop("text"), names)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_probability")
