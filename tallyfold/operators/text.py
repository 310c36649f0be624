"""Word-list and topic scores of documents, and their session aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The categories of the word list (which is licensed and not part of this repository).
CATEGORIES = ("negative", "positive", "uncertainty", "litigious", "strong_modal", "weak_modal", "constraining")
#: Topics and their words, matched as whole tokens.
TOPICS = {
    "trade_tariff": ("tariff", "tariffs", "trade", "import", "imports", "export", "exports", "customs", "duty", "duties", "quota"),
    "rates_fed": ("fed", "federal", "reserve", "powell", "rate", "rates", "interest", "hike", "cut", "cuts", "basis", "fomc"),
    "inflation": ("inflation", "inflationary", "prices", "price", "cpi", "deflation", "cost", "costs", "expensive"),
    "geopolitics": ("china", "russia", "ukraine", "iran", "israel", "nato", "war", "sanctions", "military", "border"),
    "energy": ("oil", "gas", "gasoline", "energy", "opec", "barrel", "drilling", "pipeline", "crude"),
    "economy_market": ("economy", "economic", "market", "markets", "stock", "stocks", "gdp", "recession", "jobs", "unemployment"),
    "legal_regulation": ("court", "judge", "lawsuit", "indictment", "trial", "regulation", "regulatory", "sec", "doj", "appeal"),
    "election_policy": ("election", "vote", "voters", "campaign", "poll", "polls", "congress", "senate", "house", "bill", "policy"),
}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and apostrophes."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z']+)"), F.lit(1))


def is_empty(text: Column) -> Column:
    return F.coalesce((F.trim(text) == "") | (F.lower(F.trim(text)) == "nan"), F.lit(True))


def load_lexicon(spark, path: str, categories=CATEGORIES, sha256: str | None = None) -> dict[str, list[str]]:
    """Category -> words from a CSV with a Word column and a column of non-zero years for each category; the checksum is verified if given."""
    from ..sources.files import file_sha256

    if sha256 and (found := file_sha256(path)) != sha256:
        raise ValueError(f"{path} has checksum {found}, not {sha256}")
    df = spark.read.csv(path, header=True)
    at = {c.lower(): c for c in df.columns}
    flags = F.array(*(F.struct(F.lit(c).alias("category"), F.coalesce(F.col(at[c]).try_cast("int"), F.lit(0)).alias("year")) for c in categories))
    rows = df.select(
        F.lower(F.trim(at["word"])).alias("word"), F.inline(flags)
    ).where("year != 0 AND word IS NOT NULL").select("category", "word").distinct().collect()
    out: dict[str, list[str]] = {c: [] for c in categories}
    for r in sorted(rows, key=lambda r: r["word"]):
        out[r["category"]].append(r["word"])
    return out


#: Words of all lists up to which their table goes to every task; a longer table is joined as Spark decides.
BROADCAST_WORDS = 200_000


def word_table(spark, lists: dict[str, list[str]]) -> DataFrame:
    """word and, for each list, 1 where it has the word, else 0."""
    words = sorted({w for ws in lists.values() for w in ws})
    held = {n: set(ws) for n, ws in lists.items()}
    table = spark.createDataFrame([(w, *(int(w in held[n]) for n in lists)) for w in words], "word string, " + ", ".join(f"`{n}` int" for n in lists))
    return F.broadcast(table) if len(words) <= BROADCAST_WORDS else table


def score(docs: DataFrame, lexicon: dict[str, list[str]], topics: dict[str, tuple[str, ...]] = TOPICS, keep: list[str] = ("session",)) -> DataFrame:
    """keep, n_tokens, a count for each category and topic_<name> for each topic.

    Tokens are joined with one table of all words, whatever their number, and summed by document within the task
    that read it, so that a row for each document is shuffled.
    """
    lists = {**lexicon, **{f"topic_{t}": w for t, w in topics.items()}}
    # numbered before the words are rows of their own
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("__row"), tokens(F.col("text")).alias("__tokens"))
    rows = rows.select(*keep, "__row", F.explode_outer("__tokens").alias("word"))
    found = rows.join(word_table(docs.sparkSession, lists), "word", "left")
    sums = [F.sum(F.coalesce(F.col(f"`{n}`"), F.lit(0))).cast("long").alias(n) for n in lists]
    return found.groupBy("__row", *keep).agg(F.count("word").alias("n_tokens"), *sums).drop("__row")


def session_features(scores: DataFrame, spine: DataFrame, lexicon, topics, prefix: str = "") -> DataFrame:
    """session and doc_count, token_count, tone, category and topic rates on the whole grid, 0 where there is no document."""
    names = [*lexicon, *(f"topic_{t}" for t in topics)]
    sums = scores.groupBy("session").agg(F.count(F.lit(1)).alias("doc_count"), *(F.sum(c).alias(c) for c in ("n_tokens", *names)))
    dense = spine.select("session").distinct().join(sums, "session", "left").na.fill(0)
    rate = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n_tokens")), F.lit(0.0))
    pos, neg = F.col("positive").cast("double"), F.col("negative").cast("double")
    tone = F.coalesce(F.try_divide(pos - neg, pos + neg), F.lit(0.0))
    out = [
        F.col("doc_count").cast("double").alias("doc_count"), F.col("n_tokens").cast("double").alias("token_count"),
        tone.alias("tone"), *(rate(c).alias(f"{c}_rate") for c in names)
    ]
    return dense.select("session", *out).select(
        "session",
        *(F.col(c).alias(f"{prefix}{c}") for c in ["doc_count", "token_count", "tone", *(f"{c}_rate" for c in names)])
    )


def with_empty_counts(features: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Adds the number of empty documents of each session, which are not scored."""
    empty = docs.where(is_empty(F.col("text"))).groupBy("session").agg(F.count(F.lit(1)).cast("double").alias(name))
    return features.join(empty, "session", "left").na.fill(0.0, [name])
