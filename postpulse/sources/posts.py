"""Posts and questions derived from the given tables.

The tables hold invented prose without market words, so a rule would only ever see
its default case.  Events become short posts (a sentence chosen by id, plus the
event's own fields); every document becomes one long post (the same kind of
sentence, followed by its whole text).  Nothing is cut, sampled or joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.functions.text import string_array

#: Session setting of a caller who wants a table dealt over so many partitions (one large row
#: group in one file can't be split); unset, a table is read as it lies.
PARTITIONS = "spark.postpulse.inputPartitions"
# tables whose rows are expensive to work on
_TEXT_TABLES = ("documents", "events", "conversations")

SENTENCES = (
    "$NVDA earnings beat with record profit and strong growth",
    "Tesla shares drop on weak demand and margin loss",
    "Banxico mantiene la tasa de interés por inflación",
    "Moody’s recorta la calificación de México a Baa3",
    "Peso mexicano sube frente al dólar",
    "Tariffs and war fear hit global trade",
    "Google faces antitrust lawsuit from regulator, risk of fine",
    "Crude oil gains while opec holds output",
    "Bond spreads widen, default talk, debt stays high",
    "BBVA loan book shows no loss this quarter",
    "Payrolls strong but unemployment may not gain",
    "Overweight with new price target for Apple iPhone maker",
    "Amazon AWS revenue higher, guidance strong",
    "Stocks rally, bullish market tone",
    "Nvidia GPU supply for artificial intelligence",
    "Microsoft will launch a new app model",
    "Fraud scandal and cyberattack at the exchange",
    "Good morning everyone, lovely weather today",
    "Free crypto giveaway, dm me for the airdrop",
    "JPMorgan warns of slowdown, never sell strong hands",
    "Viral celebrity football meme about stocks",
    "Tesla cae por riesgo y caída de ventas",
    "",
    "Fed rates, Fed rates",
)
SPANISH_SENTENCES = (2, 3, 4, 21)
HANDLES = (
    "Reuters", "Banxico", "PeterLBrandt", "zerohedge", "bespokeinvest", "@GBMplus", "some_user", "",
)
ROTATION = ("AAPL", "AMZN", "BBVA", "GOOGL", "JPM", "MSFT", "NVDA", "TSLA")

QUESTIONS = (
    "AI chips and the earnings of Nvidia",
    "¿Qué se dice de Google? ¿Va mal?",
    "¿creen que la tasa de interés en México va a subir?",
    "Mexico Moody",
    "Google antitrust DOJ",
    "Banxico tasa inflación",
    "Tesla va mal?",
    "oil and war risk for markets",
    "Trump tariffs",
    "bank loan losses this quarter",
    "stock market outlook",
    "lovely weather",
    "Apple iPhone sales",
    "deuda soberana BBB grado de inversión Colombia",
    "(Fed OR ECB) rates",
    "",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wanted = spark.conf.get(PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted and name in _TEXT_TABLES else df


def _pick(values: tuple, index: Column) -> Column:
    return F.get(string_array(values), index.cast("int"))


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    event, user = F.col("event_id"), F.col("user_id")
    kind = F.pmod(event, F.lit(24))
    turn = F.floor(event / 24)
    created = F.col("ts").cast("timestamp")

    def suffix(every: int, text: Column) -> Column:
        return F.when(F.pmod(turn, F.lit(every)) == 0, text).otherwise(F.lit(""))

    return e.select(
        (event * 2).alias("ord"),
        (event - F.when(F.pmod(event, F.lit(50)) == 49, 1).otherwise(0)).cast("string").alias("tweet_id"),
        F.concat(
            _pick(SENTENCES, kind),
            F.concat(F.lit("\n"), F.col("event_type"), F.lit("\n"), F.col("props")),
            suffix(5, F.concat(F.lit(" https://ex.example/p"), event)),
            suffix(7, F.concat(F.lit(" @user"), user)),
        ).alias("text"),
        F.when(F.pmod(event, F.lit(41)) != 0, created).alias("created_at"),
        F.when(F.pmod(event, F.lit(37)) == 0, F.lit(None))
        .when(kind.isin(list(SPANISH_SENTENCES)), "es").otherwise("en").alias("lang"),
        F.nullif(_pick(HANDLES, F.pmod(user, F.lit(8))), F.lit("")).alias("author_username"),
        user.cast("string").alias("author_id"),
        F.when(F.pmod(event, F.lit(29)) != 0, F.floor(F.greatest(F.col("value"), F.lit(0.0))))
        .alias("like_count"),
        F.pmod(user, F.lit(20)).alias("retweet_count"),
        F.pmod(event, F.lit(5)).alias("reply_count"),
        F.pmod(event, F.lit(3)).alias("quote_count"),
        F.when(F.pmod(turn, F.lit(4)) == 0, "manual_upload").otherwise("twitter_live").alias("source"),
        F.concat(F.lit("run_"), F.date_format(created, "yyyyMMdd")).alias("run_id"),
        F.date_format(created, "yyyy-MM-dd").alias("ingestion_date"),
        F.lit(None).cast("string").alias("title"),
    )


def document_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    created = F.timestamp_seconds(F.lit(1704067200) + F.pmod(doc * 7919, F.lit(30 * 86400)))
    return d.select(
        (doc * 2 + 1).alias("ord"),
        F.concat(F.lit("d"), doc).alias("tweet_id"),
        F.concat(_pick(SENTENCES, F.pmod(doc, F.lit(24))), F.lit(" "), F.col("text")).alias("text"),
        created.alias("created_at"),
        F.col("lang"),
        F.col("source").alias("author_username"),
        F.lit(None).cast("string").alias("author_id"),
        F.pmod(F.col("n_chars"), F.lit(100)).alias("like_count"),
        F.lit(None).cast("bigint").alias("retweet_count"),
        F.lit(0).cast("bigint").alias("reply_count"),
        F.lit(0).cast("bigint").alias("quote_count"),
        F.lit("manual_upload").alias("source"),
        F.lit("run_documents").alias("run_id"),
        F.date_format(created, "yyyy-MM-dd").alias("ingestion_date"),
        F.lit(None).cast("string").alias("title"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_posts(spark, sf_dir).unionByName(document_posts(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn asks one of the sample questions and adds its own words."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    number = F.col("conv_id") * 1000 + F.col("turn")
    base = _pick(QUESTIONS, F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(QUESTIONS))))
    return c.select(number.alias("question_id"), F.concat(base, F.lit(" "), F.col("text")).alias("question"))
