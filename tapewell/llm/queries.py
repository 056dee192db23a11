"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewell.llm import contributors, cooccurrence, packing, pii, subjects, tokens, toxicity
from tapewell.operators.records import clean_tickers, latest_records
from tapewell.session import table


def _baskets(spark: SparkSession, folder: str) -> DataFrame:
    records = latest_records(table(spark, folder, "mention"), "id", "ingested_at", ["tickers"])
    return cooccurrence.collapse(records.select(clean_tickers("tickers").alias("items")), "items")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cooccurrence.pair_counts(_baskets(spark, folder), pair_share=0.005)
    return pairs.where("lift >= 3").select(F.col("item_a").alias("ticker_a"), F.col("item_b").alias("ticker_b"))


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair that occurs, with its count, lift and conviction."""
    pairs = cooccurrence.pair_counts(_baskets(spark, folder))
    return pairs.select(F.col("item_a").alias("ticker_a"), F.col("item_b").alias("ticker_b"), "n_ab", F.round("lift", 12).alias("lift"), F.round("conviction", 12).alias("conviction"))


def _toxicity(spark: SparkSession, folder: str, keep=(), spans: bool = False) -> DataFrame:
    return toxicity.scored_records(table(spark, folder, "mention"), table(spark, folder, "toxic_label"), keep, spans, table(spark, folder, "subject_label"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _toxicity(spark, folder).where("flagged").select("id")


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every record, and where flagged texts offend."""
    return _toxicity(spark, folder, ("subreddit",), spans=True).select("id", "subreddit", F.round("score", 4).alias("score"), "flagged", "spans")


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Records, flagged records and their rate per subreddit."""
    return toxicity.rates(_toxicity(spark, folder, ("subreddit",)), "subreddit").withColumn("rate", F.round("rate", 9))


def _authored(spark: SparkSession, folder: str) -> DataFrame:
    records = latest_records(table(spark, folder, "mention"), "id", "ingested_at", ["author", "score", "created_utc"])
    return records.withColumn("who", contributors.contributor_key("author"))


def _cap(records: DataFrame, share: int):
    return records.agg(F.floor(F.count(F.lit(1)) / share).alias("cap")).scalar()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    records = _authored(spark, folder)
    marked = contributors.mark_capped(
        records,
        "who",
        _cap(records, 100),
        levels=[
            [F.col("score").isNull(), F.bitwise_not("score")],
            [F.col("created_utc").isNull(), F.shiftright("created_utc", 16)],
            [F.col("created_utc")],
            [contributors.beginning("id", records, 2)],
            [contributors.beginning("id", records, 4)],
        ],
        exact=[F.col("score").desc_nulls_last(), F.col("created_utc").asc_nulls_last(), F.col("id")],
        most=100,
    )
    return marked.where(~F.col("kept")).select("id")


def p3_reservoir(spark: SparkSession, folder: str) -> DataFrame:
    """Records that stay when each author keeps a quality-weighted random sample of the same cap."""
    records = _authored(spark, folder)
    records = records.withColumn("key", contributors.exponential_key(F.col("score"), [F.col("id")]))
    marked = contributors.mark_capped(
        records,
        "who",
        _cap(records, 100),
        levels=[[F.floor(F.log2("key") * 64)], [F.col("key")]],
        exact=[F.col("key"), F.col("id")],
        most=100,
    )
    return marked.where("kept").select("id", "author", "score")


def _finder(spark: SparkSession, folder: str) -> pii.Finder:
    return pii.train(companies=pii.company_names(table(spark, folder, "universe")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found_kinds(table(spark, folder, "mention"), _finder(spark, folder))


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every record's text and title with placeholders for personal information."""
    return pii.redacted_records(table(spark, folder, "mention"), _finder(spark, folder))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_table(table(spark, folder, "documents"), "doc_id", "text")


#: The kinds of containers are read on the driver; a table with more is refused.
MOST_CONTAINERS = 1000


def _containers(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    rows = table(spark, folder, "container_size").select("container", "capacity_tokens").limit(MOST_CONTAINERS + 1).collect()
    if len(rows) > MOST_CONTAINERS:
        raise ValueError(f"more than {MOST_CONTAINERS} kinds of containers")
    return [(r[0], r[1]) for r in rows]


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, list[tuple[str, int]]]:
    documents = table(spark, folder, "documents")
    sizes, containers = tokens.count_table(documents, "doc_id", "text"), _containers(spark, folder)
    return packing.pack(sizes, "doc_id", "n_tokens", containers, number=documents.count()), containers


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)[0]


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each kind are."""
    return packing.fill(*_packed(spark, folder))


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects per document with the number of sentences about them and their score."""
    found = subjects.document_subjects(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "subject_label"))
    return found.withColumn("score", F.round("score", 6))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_scores(spark, folder).select("doc_id", "subject")


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Composition of the corpus: documents per subject and their share of all documents."""
    return subjects.corpus_shares(p10_found(spark, folder), table(spark, folder, "documents"))


_RECORD = "rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM mention WHERE id IS NOT NULL) WHERE rn = 1)"
_PAIRS = f"""{_RECORD},
tick AS (SELECT DISTINCT id, upper(trim(t)) AS ticker FROM (SELECT id, unnest(tickers) AS t FROM rec) WHERE t IS NOT NULL),
one AS (SELECT ticker, count(*) AS n FROM tick GROUP BY 1), num AS (SELECT count(*) AS n FROM rec),
two AS (SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, count(*) AS n_ab FROM tick a JOIN tick b ON a.id = b.id AND a.ticker < b.ticker GROUP BY 1, 2),
pair AS (SELECT ticker_a, ticker_b, n_ab, x.n AS n_a, y.n AS n_b, num.n AS n, CAST(n_ab AS DOUBLE) * num.n / (CAST(x.n AS DOUBLE) * y.n) AS lift
  FROM two JOIN one x ON x.ticker = ticker_a JOIN one y ON y.ticker = ticker_b CROSS JOIN num)"""

QUERIES = {
    "p1_found": p1_found,
    "p1_pairs": p1_pairs,
    "p2_found": p2_found,
    "p2_scores": p2_scores,
    "p2_rates": p2_rates,
    "p3_found": p3_found,
    "p3_reservoir": p3_reservoir,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_shares": p10_shares,
}

SQL = {
    "p1_found": f"WITH {_PAIRS} SELECT ticker_a, ticker_b FROM pair WHERE n_ab >= 0.005 * n AND lift >= 3",
    "p1_pairs": f"""WITH {_PAIRS} SELECT ticker_a, ticker_b, n_ab, round(lift, 12) AS lift,
        round(CASE WHEN n_ab < n_a THEN (1 - CAST(n_b AS DOUBLE) / n) / (1 - CAST(n_ab AS DOUBLE) / n_a) END, 12) AS conviction FROM pair""",
    "p3_reservoir": f"""WITH {_RECORD}, w AS (SELECT id, author, score, lower(trim(author)) AS who,
        -ln((CAST('0x' || substr(md5('0:' || id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / greatest(1.0, ln(1 + CAST(greatest(0, coalesce(score, 0)) AS DOUBLE))) AS key FROM rec),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY key, id) AS place FROM w)
        SELECT id, author, score FROM ranked WHERE who IS NULL OR who = '[deleted]' OR place <= (SELECT count(*) // 100 FROM rec)""",
    "p3_found": f"""WITH {_RECORD}, who AS (SELECT id, score, created_utc, lower(trim(author)) AS who FROM rec),
        ranked AS (SELECT id, row_number() OVER (PARTITION BY who ORDER BY score DESC NULLS LAST, created_utc ASC NULLS LAST, id) AS place FROM who
          WHERE who IS NOT NULL AND who <> '[deleted]')
        SELECT id FROM ranked WHERE place > (SELECT count(*) // 100 FROM rec)""",
}
