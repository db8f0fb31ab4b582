"""Quality rules as weak supervision, in DataFrame functions alone.

Rules vote good (1) or bad (-1) or abstain (0). Expectation-maximisation over the table of vote
patterns estimates, for both classes, how often each rule votes what, and with that each
pattern's posterior probability of good quality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

WHITE = " \t\n\x0b\f\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Words of the windows whose repetition counts.
WINDOW = 5
#: Rounds of expectation-maximisation.
ROUNDS = 30
#: Log odds of good before the first round, and of a vote of -1, 0 and 1.
START = (1.0, -6.0, 0.0, 0.5)


def _trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITE))


def base_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds the counts that rules are made of, from the whole text in text_col (null: no words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: _trimmed(x) != "")
    cut = docs.withColumn("_trim", _trimmed(text)).withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", WHITE_RUN))).withColumn("_lines", lines)
    counted = cut.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_other": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")).cast("long"),
            "n_bare": F.regexp_count(text, F.lit(r"(?<![^\s])[^\p{L}\p{N}\s]+(?![^\s])")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hash": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    )
    at = F.sequence(F.lit(0), F.size("_hash") - WINDOW)
    windows = F.when(F.size("_hash") >= WINDOW, F.transform(at, lambda i: F.xxhash64(*[F.get("_hash", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    tried = counted.withColumn("n_distinct", F.size(F.array_distinct("_hash")).cast("long")).withColumn("_win", windows)
    ordered = F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    sorted_ = tried.withColumn("_sorted", ordered)
    again = F.filter(
        "_sorted",
        lambda x, i: F.coalesce(F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False)) | ((i > 0) & F.coalesce(F.get("_sorted", i - 1)["h"] == x["h"], F.lit(False))),
    )
    covered = F.aggregate(
        F.sort_array(F.transform(again, lambda x: x["i"])),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    return sorted_.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_trim", "_words", "_lines", "_hash", "_win", "_sorted")


#: The rules, in the order of their digits in a vote code.
RULES = ("length", "word_length", "symbols", "letters", "bare", "lines", "windows", "variety")


def rules() -> dict[str, Column]:
    """Rule name -> vote, from the counts of base_counts. Different words are held against the square root of all, so that variety means the same at every length."""
    c = {x: F.col(x) for x in ("n_words", "word_chars", "n_symbols", "n_other", "n_bare", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct")}

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "length": vote(c["n_words"] >= 30, c["n_words"] < 10),
        "word_length": vote((c["word_chars"] >= 3 * c["n_words"]) & (c["word_chars"] <= 15 * c["n_words"]), (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 30 * c["n_words"])),
        "symbols": vote(100 * c["n_symbols"] <= c["word_chars"], 100 * c["n_symbols"] > 8 * c["word_chars"]),
        "letters": vote(100 * c["n_other"] <= 20 * c["word_chars"], 100 * c["n_other"] > 30 * c["word_chars"]),
        "bare": vote(100 * c["n_bare"] <= 5 * c["n_words"], 100 * c["n_bare"] > 20 * c["n_words"]),
        "lines": vote(c["n_dup_lines"] == 0, 2 * c["n_dup_lines"] > c["n_lines"]),
        "windows": vote(100 * c["n_repeat_words"] <= 5 * c["n_words"], 100 * c["n_repeat_words"] > 20 * c["n_words"]),
        "variety": vote(c["n_distinct"] * c["n_distinct"] >= 9 * c["n_words"], c["n_distinct"] * c["n_distinct"] < 2 * c["n_words"]),
    }


def _posterior(log_odds: Column, ratio: Column, slots: Column) -> Column:
    return 1 / (1 + F.exp(-F.aggregate(slots, log_odds, lambda a, k: a + F.get(ratio, k))))


def pattern_posteriors(votes: DataFrame, code: str, count: int) -> DataFrame:
    """(code, posterior) of each vote pattern of ``votes``; code: the votes plus 1 as base-3 digits of ``count`` rules, the first the lowest.

    The patterns, 3**count at most, are one row's array; each round is an expression over it.
    """
    k3 = 3 * count
    slots = F.array(*[(3 * j + F.floor(F.col(code) / 3**j) % 3).cast("int") for j in range(count)])
    table = votes.groupBy(code).agg(F.count(F.lit(1)).cast("double").alias("n")).select(code, "n", slots.alias("slots"))
    whole = table.agg(F.sort_array(F.collect_list(F.struct(code, "n", "slots"))).alias("patterns"))
    first = F.struct(F.lit(START[0]).alias("odds"), F.array(*[F.lit(START[1 + k % 3]) for k in range(k3)]).alias("ratio"))

    def step(state: Column, _: Column) -> Column:
        split = F.transform("patterns", lambda p: F.struct(p["slots"].alias("slots"), (p["n"] * _posterior(state["odds"], state["ratio"], p["slots"])).alias("g"), p["n"].alias("n")))
        sums = F.aggregate(
            split,
            F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("b"), F.array_repeat(F.lit(0.0), k3).alias("gs"), F.array_repeat(F.lit(0.0), k3).alias("bs")),
            lambda a, x: F.struct(
                (a["g"] + x["g"]).alias("g"),
                (a["b"] + x["n"] - x["g"]).alias("b"),
                F.transform(a["gs"], lambda y, k: F.when(F.array_contains(x["slots"], k), y + x["g"]).otherwise(y)).alias("gs"),
                F.transform(a["bs"], lambda y, k: F.when(F.array_contains(x["slots"], k), y + x["n"] - x["g"]).otherwise(y)).alias("bs"),
            ),
            lambda a: F.struct(
                (F.ln(a["g"] + 1) - F.ln(a["b"] + 1)).alias("odds"),
                F.transform(a["gs"], lambda y, k: F.ln((y + 1) / (a["g"] + 3)) - F.ln((F.get(a["bs"], k) + 1) / (a["b"] + 3))).alias("ratio"),
            ),
        )
        return sums

    fitted = whole.withColumn("fit", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, step))
    return fitted.select("fit", F.explode("patterns").alias("p")).select(F.col(f"p.{code}").alias(code), F.round(_posterior(F.col("fit.odds"), F.col("fit.ratio"), F.col("p.slots")), 6).alias("posterior"))


def rate(docs: DataFrame, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """docs (or these columns of it) as struct ``row``, the counts, base_failed, vote_<rule>, posterior and kept.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated windows; such rows
    aren't kept, the others are if their posterior is 0.5 or more. Null texts have no words.
    Every row gives one row, whatever its id; an empty table gives none.
    """
    own = rules()
    code = sum(((F.col(f"vote_{name}") + 1) * 3**j for j, name in enumerate(own)), F.lit(0)).cast("int")
    counted = base_counts(docs.select(F.struct(*[F.col(f"`{x}`") for x in columns or docs.columns]).alias("row"), F.col(text_col).alias("_text")), "_text").drop("_text")
    voted = saved(counted.withColumns({f"vote_{name}": vote.cast("int") for name, vote in own.items()}).withColumn("_code", code))
    rated = voted.join(F.broadcast(pattern_posteriors(voted, "_code", len(own))), "_code").drop("_code")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rated.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= 0.5))


def oracle() -> str:
    """The same in DuckDB's SQL over ``documents``: doc_id, counts, base_failed, kept and posterior."""
    names = RULES
    slots = ", ".join(f"{3 * j + 1} + vote_{name} + 1" for j, name in enumerate(names))
    post = "1 / (1 + exp(-(odds + list_sum(list_transform({slots}, lambda k: ratio[k])))))"
    k3 = 3 * len(names)
    start = ", ".join(f"{START[1 + k % 3]}::double" for k in range(k3))
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
win AS (
  SELECT doc_id, i, words[i:i + {WINDOW - 1}] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win), range(0, {WINDOW}) AS r(k) WHERE c > 1 GROUP BY doc_id),
c AS (
  SELECT w.doc_id, len(words)::bigint AS n_words, length(array_to_string(words, ''))::bigint AS word_chars,
    len(regexp_extract_all(t, '{SYMBOLS}'))::bigint AS n_symbols, len(regexp_extract_all(t, '[^\\p{{L}}\\p{{N}}\\x20\\x09-\\x0D]'))::bigint AS n_other,
    len(list_filter(words, lambda x: regexp_matches(x, '^[^\\p{{L}}\\p{{N}}]+$')))::bigint AS n_bare, len(lines)::bigint AS n_lines, (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
    coalesce(rep.n, 0)::bigint AS n_repeat_words, len(list_distinct(words))::bigint AS n_distinct
  FROM w LEFT JOIN rep ON w.doc_id IS NOT DISTINCT FROM rep.doc_id),
v AS (
  SELECT *,
    CASE WHEN n_words < 10 THEN -1 WHEN n_words >= 30 THEN 1 ELSE 0 END AS vote_length,
    CASE WHEN word_chars < 2 * n_words OR word_chars > 30 * n_words THEN -1 WHEN word_chars >= 3 * n_words AND word_chars <= 15 * n_words THEN 1 ELSE 0 END AS vote_word_length,
    CASE WHEN 100 * n_symbols > 8 * word_chars THEN -1 WHEN 100 * n_symbols <= word_chars THEN 1 ELSE 0 END AS vote_symbols,
    CASE WHEN 100 * n_other > 30 * word_chars THEN -1 WHEN 100 * n_other <= 20 * word_chars THEN 1 ELSE 0 END AS vote_letters,
    CASE WHEN 100 * n_bare > 20 * n_words THEN -1 WHEN 100 * n_bare <= 5 * n_words THEN 1 ELSE 0 END AS vote_bare,
    CASE WHEN 2 * n_dup_lines > n_lines THEN -1 WHEN n_dup_lines = 0 THEN 1 ELSE 0 END AS vote_lines,
    CASE WHEN 100 * n_repeat_words > 20 * n_words THEN -1 WHEN 100 * n_repeat_words <= 5 * n_words THEN 1 ELSE 0 END AS vote_windows,
    CASE WHEN n_distinct * n_distinct < 2 * n_words THEN -1 WHEN n_distinct * n_distinct >= 9 * n_words THEN 1 ELSE 0 END AS vote_variety
  FROM c),
s AS (SELECT *, [{slots}] AS slots FROM v),
p AS (SELECT slots, count(*)::double AS n FROM s GROUP BY slots),
l AS (SELECT list(slots ORDER BY slots) AS ss, list(n ORDER BY slots) AS ns FROM p),
em AS (
  SELECT 0 AS i, {START[0]}::double AS odds, [{start}] AS ratio
  UNION ALL
  SELECT i + 1, ln(g + 1) - ln(b + 1), list_transform(range(1, {k3 + 1}), lambda k:
      ln((list_sum(list_transform(range(1, len(ss) + 1), lambda j: CASE WHEN list_contains(ss[j], k) THEN gs[j] ELSE 0 END)) + 1) / (g + 3))
    - ln((list_sum(list_transform(range(1, len(ss) + 1), lambda j: CASE WHEN list_contains(ss[j], k) THEN ns[j] - gs[j] ELSE 0 END)) + 1) / (b + 3)))
  FROM (
    SELECT *, list_sum(gs) AS g, list_sum(ns) - list_sum(gs) AS b FROM (
      SELECT i, ss, ns, list_transform(range(1, len(ss) + 1), lambda j: ns[j] * ({post.format(slots="ss[j]")})) AS gs FROM em, l WHERE i < {ROUNDS})))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= 0.5 AS kept, posterior
FROM (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, round({post.format(slots="slots")}, 6) AS posterior
  FROM s, (SELECT odds, ratio FROM em WHERE i = {ROUNDS}))
"""
