"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at a few counts of one text and votes good (1), bad (-1) or abstains (0). How often each rule votes so on good
documents and on bad ones isn't set by hand: expectation-maximisation over all documents' votes estimates these probabilities
together with the share of good documents, and a document stays if its posterior probability of being good is at least one half.

What is believed beforehand counts as a share of all votes, so that estimates behave alike at every size: on good documents a rule
hardly ever votes bad; on bad ones, which come in many kinds, it does so more often. This also tells which class is the good one.

The corpus enters the estimate only as counts of distinct vote patterns, at most 3 ** len(RULES) rows whatever the
corpus holds; the rounds run as one aggregate over that array, so no data pass is made per round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Rounds of expectation-maximisation, and the first guess of the share of good documents.
ROUNDS, PRIOR = 25, 0.7
#: What is believed of every rule beforehand: shares of bad votes, of none, and of good ones, on good and on bad documents; and how
#: many documents that is worth, as a share of all and besides.
GOOD, BAD = (0.01, 0.04, 0.95), (0.2, 0.1, 0.7)
STRENGTH, LEAST = 0.05, 4.0

#: name, bad if, good if; SQL that Spark and other engines read alike. Bad is looked at first.
RULES = [
    ("symbols", "8 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("plain", "4 * n_plain < 3 * n_words", "20 * n_plain >= 19 * n_words"),
    ("case", "4 * n_upper > word_chars OR 10 * n_bangs > n_words", "15 * n_upper <= word_chars AND n_bangs = 0"),
    ("lines", "5 * n_dup_lines > 2 * n_lines", "10 * n_dup_lines <= n_lines"),
    ("passages", "4 * n_repeat_words > n_words", "20 * n_repeat_words <= n_words"),
    ("stutter", "10 * n_stutter > n_words", "30 * n_stutter <= n_words"),
    ("shape", "word_chars < 3 * n_words OR word_chars > 9 * n_words", "word_chars BETWEEN 4 * n_words AND 7 * n_words"),
    ("length", "n_words < 20", "n_words >= 40"),
]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluates value once for all places where use refers to it, also those inside other lambdas."""
    return F.transform(F.array(value), use)[0]


def repeated(w: Column) -> Column:
    """Words that stand in a window found more than once in the array w.

    Windows are hashed to 64 bits. Most texts repeat none, which a distinct count over longs shows; only for the rest
    the windows are sorted by hash and the covered words are summed from their sorted starts.
    """

    def covered(hashes: Column) -> Column:
        at = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(
            at,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        s,
                        lambda x, k: (F.get(s, k - 1)["h"] == x["h"]).eqNullSafe(True)
                        | (F.get(s, k + 1)["h"] == x["h"]).eqNullSafe(True),
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        return let(
            starts,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(WINDOW), x - F.coalesce(F.get(p, k - 1), F.lit(-WINDOW)))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    # words are hashed once, and windows from the hashes of their words
    window = lambda h: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), window)
    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(w) < WINDOW, 0).otherwise(counted)


def measure(docs: DataFrame) -> DataFrame:
    """The counts that rules look at, one row for each row of docs: doc_id and long columns. A null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    counts = {
        "word_chars": without(BLANKS),
        "n_symbols": F.length(text) - without(SYMBOLS),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "n_bangs": F.regexp_count(text, F.lit("!!")),
        "n_plain": F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])\p{L}+[.,;:!?]?(?![^\x20\x09-\x0D])")),
    }
    by_word = let(
        words(text),
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            repeated(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x, i: F.get(w, i - 1) == x)).alias("n_stutter"),
        ),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    own = docs.select("doc_id", by_word.alias("w"), by_line.alias("l"), *[c.cast("long").alias(k) for k, c in counts.items()])
    flat = [F.col(f"w.{k}").cast("long").alias(k) for k in ("n_words", "n_repeat_words", "n_stutter")]
    flat += [F.col(f"l.{k}").cast("long").alias(k) for k in ("n_lines", "n_dup_lines")]
    return own.select("doc_id", *flat, *counts)


def vote(measured: DataFrame) -> DataFrame:
    """measured with base_failed and votes, an array of 1, -1 and 0 in the order of RULES."""
    each = [F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for _, bad, good in RULES]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("votes", F.array(*each))


def odds(model: Column, votes: Column) -> Column:
    """Posterior probability of good, for a model and one array of votes."""
    weigh = F.zip_with(votes, model["weights"], lambda v, w: F.get(w, v + 1))
    start = F.log(model["prior"] / (1 - model["prior"]))
    return 1 / (1 + F.exp(-F.aggregate(weigh, start, lambda s, x: s + x)))


def learn(patterns: DataFrame) -> DataFrame:
    """One row: the patterns (votes, n), sorted, and the model that expectation-maximisation ends with: prior, the share of good
    documents, and for each rule and vote the probabilities on good and bad documents and their ratio's logarithm (weights).

    At most 3 ** len(RULES) patterns come in, so that one row can hold them. No patterns give what is believed beforehand.
    """
    held = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    total = lambda rows, f: F.aggregate(rows, F.lit(0.0), lambda s, r: s + f(r))
    number = lambda c: c.cast("double")
    cast = lambda r, j, vote: F.when(r["v"][j] == vote, number(r["n"])).otherwise(0.0)

    def model(prior: Column, good: list[list[Column]], bad: list[list[Column]]) -> Column:
        nested = lambda table: F.array(*[F.array(*row) for row in table])
        weights = [[F.log(g) - F.log(b) for g, b in zip(*pair, strict=True)] for pair in zip(good, bad, strict=True)]
        return F.struct(prior.alias("prior"), nested(good).alias("good"), nested(bad).alias("bad"), nested(weights).alias("weights"))

    first = model(F.lit(PRIOR), [[F.lit(x) for x in GOOD]] * len(RULES), [[F.lit(x) for x in BAD]] * len(RULES))

    def round_(now: Column, _: Column) -> Column:
        rated = F.transform(F.col("patterns"), lambda p: F.struct(p["votes"].alias("v"), p["n"].alias("n"), odds(now, p["votes"]).alias("q")))

        def estimate(rows: Column, sums: Column) -> Column:
            worth = STRENGTH * sums["n"] + LEAST
            good, bad = [], []
            for j in range(len(RULES)):
                own = [total(rows, lambda r, j=j, v=v: cast(r, j, v) * r["q"]) for v in (-1, 0, 1)]
                every = [total(rows, lambda r, j=j, v=v: cast(r, j, v)) for v in (-1, 0, 1)]
                good.append([(x + worth * p) / (sums["good"] + worth) for x, p in zip(own, GOOD, strict=True)])
                bad.append([(n - x + worth * p) / (sums["n"] - sums["good"] + worth) for n, x, p in zip(every, own, BAD, strict=True)])
            return model((sums["good"] + worth * PRIOR) / (sums["n"] + worth), good, bad)

        sums = lambda rows: F.struct(total(rows, lambda r: number(r["n"])).alias("n"), total(rows, lambda r: r["n"] * r["q"]).alias("good"))
        return let(rated, lambda rows: let(sums(rows), lambda s: estimate(rows, s)))

    return held.select("patterns", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, round_).alias("model"))


def _rate(learned: DataFrame) -> DataFrame:
    """Each pattern's posterior under the learned model."""
    rows = learned.select(F.explode("patterns").alias("p"), "model")
    return rows.select(F.col("p.votes").alias("votes"), odds(F.col("model"), F.col("p.votes")).alias("quality"))


def judge(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, the counts, base_failed, votes, quality (the posterior) and kept.

    docs needs doc_id and text; other columns are left alone. A null or blank text has no words, fails the base rule
    and isn't kept. Repeated rows are judged alike, row by row, and a null doc_id is carried through. No rows give no
    rows. Ties (a posterior of exactly one half) stay. Texts are read whole.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    voted = scratch.keep(vote(measure(docs)))
    learned = learn(voted.groupBy("votes").agg(F.count("*").alias("n")))
    # as many rows as patterns: at most 3 ** len(RULES), so that it can be broadcast at any scale
    rated = scratch.keep(_rate(learned))
    out = voted.join(F.broadcast(rated), "votes")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "votes"
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with docs' own columns.

    A verdict follows from the text alone, so rows that share a doc_id, or have none, each get that of their own text:
    the rows are joined with the few vote patterns that are good enough, not with each other.
    """
    scratch = Scratch(docs.sparkSession, "keep-good")
    row = docs.select(F.struct("*").alias("doc_id"), F.col("text").alias("text"))
    voted = scratch.keep(vote(measure(row)).select("doc_id", "base_failed", "votes"))
    learned = learn(voted.groupBy("votes").agg(F.count("*").alias("n")))
    rated = scratch.keep(_rate(learned))
    return voted.join(F.broadcast(rated), "votes").where(~F.col("base_failed") & (F.col("quality") >= 0.5)).select("doc_id.*")


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).drop("quality", "votes")


def oracle(table: str = "documents") -> str:
    """The query of this operator in DuckDB's SQL, for its exact counts and verdicts."""
    blanks = r"[^\x20\x09-\x0D]+"
    votes = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for _, bad, good in RULES)
    k = range(1, len(RULES) + 1)
    logit = "ln(prior / (1 - prior))" + "".join(f" + weights[{j}][votes[{j}] + 2]" for j in k)
    worth = f"({STRENGTH} * sum(n) + {LEAST})"
    cast = lambda j, v, x: f"sum(CASE WHEN votes[{j}] = {v} THEN {x} ELSE 0 END)"
    weight = lambda j, v: (
        f"ln(({cast(j, v, 'n * q')} + {worth} * {GOOD[v + 1]}) / (sum(n * q) + {worth}))"
        f" - ln(({cast(j, v, 'n')} - {cast(j, v, 'n * q')} + {worth} * {BAD[v + 1]}) / (sum(n) - sum(n * q) + {worth}))"
    )
    weights = ", ".join("[" + ", ".join(weight(j, v) for v in (-1, 0, 1)) + "]" for j in k)
    start = "[" + ", ".join(f"ln({g}::DOUBLE) - ln({b}::DOUBLE)" for g, b in zip(GOOD, BAD, strict=True)) + "]"
    return rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{blanks}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{blanks}')) AS lines,
         row_number() OVER () AS r
  FROM {table}
), places AS (
  SELECT r, i, w[i:i + {WINDOW - 1}] AS win FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM split WHERE len(w) >= {WINDOW})
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM places) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT i + o) AS n FROM twice, range({WINDOW}) AS t(o) GROUP BY r
), measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x, i: i > 1 AND w[i - 1] = x)) AS n_stutter,
         len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, len(list_filter(w, lambda x: regexp_full_match(x, '\p{{L}}+[.,;:!?]?'))) AS n_plain, len(regexp_extract_all(text, '!!')) AS n_bangs
  FROM split LEFT JOIN covered USING (r)
), voted AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, [{votes}] AS votes FROM measured
), patterns AS (
  SELECT votes, count(*)::DOUBLE AS n FROM voted GROUP BY votes
), em(i, prior, weights) AS (
  SELECT 0, {PRIOR}::DOUBLE, [{", ".join([start] * len(RULES))}]
  UNION ALL
  SELECT i + 1, (sum(n * q) + {worth} * {PRIOR}) / (sum(n) + {worth}), [{weights}]
  FROM (SELECT i, votes, n, 1 / (1 + exp(-({logit}))) AS q FROM em, patterns WHERE i < {ROUNDS}) GROUP BY i
), model AS (SELECT * FROM em WHERE i = {ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 1 / (1 + exp(-({logit}))) >= 0.5 AS kept
FROM voted, model"""
