"""Transcript tables derived from the synthetic tables by formula, the same in Spark and in DuckDB.

Times are whole tenths of a second in ``*_ds`` columns; seconds are those over ten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each line of a document that isn't blank: 0.4 s a word, gaps of up to 2 s."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    lines = docs.withColumn("text", F.trim(F.regexp_replace("line", "[ \t\r]+", " "))).where("text <> ''")
    along = W.partitionBy("rec_id").orderBy("ln")
    n = lines.withColumn("seg_idx", F.row_number().over(along) - 1).withColumn("n_words", F.size(F.split("text", " ")))
    length = 4 * F.col("n_words") + (F.col("rec_id") * 7 + F.col("seg_idx") * 3) % 5 * 5
    start = F.coalesce(F.sum(length).over(W.partitionBy("rec_id").orderBy("seg_idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    s = n.withColumn("start_ds", start).withColumn("end_ds", F.col("start_ds") + 4 * F.col("n_words"))
    return s.select(
        "rec_id",
        "seg_idx",
        "start_ds",
        "end_ds",
        (F.col("start_ds") / 10).alias("start"),
        (F.col("end_ds") / 10).alias("end"),
        "text",
        "n_words",
        F.when((F.col("rec_id") + F.col("seg_idx")) % 11 == 0, "ar").otherwise("ur").alias("language"),
        (-((F.col("rec_id") * 31 + F.col("seg_idx") * 17) % 100) / 100).alias("avg_logprob"),
    )


#: The same in DuckDB; ``s`` is the table of segments.
SEGMENTS = r"""WITH l AS (SELECT doc_id, u.pos - 1 AS ln, u.line FROM documents, UNNEST(string_split(text, chr(10))) WITH ORDINALITY AS u(line, pos)),
c AS (SELECT doc_id, ln, trim(regexp_replace(line, '[ \t\r]+', ' ', 'g')) AS t FROM l),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS seg_idx, t, len(string_split(t, ' ')) AS n_words FROM c WHERE t <> ''),
p AS (SELECT *, ((doc_id*7 + seg_idx*3) % 5) * 5 AS gap_ds FROM n),
s0 AS (SELECT *, coalesce(sum(4*n_words + gap_ds) OVER (PARTITION BY doc_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ds FROM p),
s AS (SELECT doc_id AS rec_id, seg_idx, start_ds, start_ds + 4*n_words AS end_ds, t AS text, n_words,
  CASE WHEN (doc_id + seg_idx) % 11 = 0 THEN 'ar' ELSE 'ur' END AS language,
  -((doc_id*31 + seg_idx*17) % 100)::DOUBLE / 100 AS avg_logprob FROM s0)"""


def recordings(seg: DataFrame) -> DataFrame:
    return seg.groupBy("rec_id").agg(F.max("end").alias("total"))


def words(seg: DataFrame) -> DataFrame:
    """One for each word, 0.3 s long, every 0.4 s."""
    w = seg.select("rec_id", "seg_idx", F.col("start_ds").alias("s"), "language", F.posexplode(F.split("text", " ")).alias("word_idx", "word"))
    start = F.col("s") + 4 * F.col("word_idx")
    return w.select("rec_id", "seg_idx", "word_idx", start.alias("start_ds"), (start + 3).alias("end_ds"), "word", "language", ((F.col("rec_id") + 13 * F.col("seg_idx") + 7 * F.col("word_idx")) % 100 / 100).alias("prob"))


WORDS = """, w AS (SELECT rec_id, seg_idx, i - 1 AS word_idx, start_ds + 4*(i-1) AS start_ds, start_ds + 4*(i-1) + 3 AS end_ds, word, language,
  ((rec_id + 13*seg_idx + 7*(i-1)) % 100) / 100.0 AS prob FROM s, UNNEST(string_split(text, ' ')) WITH ORDINALITY AS u(word, i))"""


def with_words(seg: DataFrame) -> DataFrame:
    """Segments with an array of word timings."""
    at = F.transform(F.split("text", " "), lambda w, i: F.struct(((F.col("start_ds") + 4 * i) / 10).alias("start"), ((F.col("start_ds") + 4 * i + 3) / 10).alias("end"), w.alias("word"), ((F.col("rec_id") + 13 * F.col("seg_idx") + 7 * i) % 100 / 100).alias("prob")))
    return seg.withColumn("words", at)


def sections(seg: DataFrame) -> DataFrame:
    """Every fifth segment opens one, which ends where the next begins."""
    fifth = seg.where("seg_idx % 5 = 0")
    return fifth.select("rec_id", F.expr("cast(seg_idx div 5 as int)").alias("sec_idx"), "start", F.lead("start").over(W.partitionBy("rec_id").orderBy("seg_idx")).alias("end"), "text")


SECTIONS = """, c5 AS (SELECT rec_id, seg_idx // 5 AS sec_idx, start_ds, lead(start_ds) OVER (PARTITION BY rec_id ORDER BY seg_idx) AS end_ds, text FROM s WHERE seg_idx % 5 = 0)"""


def lines(seg: DataFrame) -> DataFrame:
    """Human transcripts: a heading before every fifth segment."""
    from .functions.clock import stamp

    at = seg.select("rec_id", F.posexplode(F.array(F.when(F.col("seg_idx") % 5 == 0, stamp(F.col("start"))), F.col("text"))).alias("k", "line"), "seg_idx").where("line is not null")
    return at.select("rec_id", (F.col("seg_idx") * 2 + F.col("k")).alias("line_no"), "line")


def token_pairs(seg: DataFrame) -> DataFrame:
    """Aligned words: some of four letters, eight, ... have other letters in the human text."""
    w = seg.select("rec_id", "seg_idx", F.posexplode(F.split("text", " ")).alias("pos", "model"))
    changed = (F.length("model") % 4 == 0) & ((F.col("rec_id") + F.col("pos")) % 3 != 0)
    return w.withColumn("ref", F.when(changed, F.translate("model", "esn", "éßñ")).otherwise(F.col("model")))


TOKEN_PAIRS = """, tp AS (SELECT rec_id, seg_idx, i - 1 AS pos, w AS model,
  CASE WHEN length(w) % 4 = 0 AND (rec_id + i - 1) % 3 <> 0 THEN translate(w, 'esn', 'éßñ') ELSE w END AS ref FROM s, UNNEST(string_split(text, ' ')) WITH ORDINALITY AS u(w, i))"""


def excludes(seg: DataFrame) -> DataFrame:
    """Excluded ranges of every seventh recording; every fourteenth is cut off at 90 s."""
    at = seg.select("rec_id").distinct().where("rec_id % 7 = 0")
    end = F.array(F.struct(F.lit(10.0).alias("start"), F.lit(30.0).alias("end")), F.when(F.col("rec_id") % 14 == 0, F.struct(F.lit(90.0).alias("start"), F.lit(float("inf")).alias("end"))))
    return at.select("rec_id", F.inline(F.array_compact(end)))


EXCLUDES = """, ex AS (SELECT DISTINCT rec_id, 100 AS lo, 300::DOUBLE AS hi FROM s WHERE rec_id % 7 = 0 UNION ALL SELECT DISTINCT rec_id, 900, 'infinity'::DOUBLE FROM s WHERE rec_id % 14 = 0)"""


def probes(seg: DataFrame) -> DataFrame:
    at = seg.where("seg_idx % 6 = 0")
    return at.select("rec_id", "seg_idx", F.when(F.col("seg_idx") % 12 == 0, "ar").otherwise("ur").alias("detected"), (F.col("seg_idx") % 10 / 10).alias("probability"), F.concat(F.lit("AR "), "text").alias("arabic_text"))


def voice(seg: DataFrame) -> DataFrame:
    return seg.select("rec_id", (F.col("start_ds") * 1600).alias("start_sample"), (F.col("end_ds") * 1600).alias("end_sample"))


def arabic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with Arabic and Urdu letters for some of theirs."""
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), F.translate(F.lower("text"), "abcdefghij", "ايكةهأإىۃۓ").alias("text"))


ARABIC = """WITH a AS (SELECT doc_id AS rec_id, translate(lower(text), 'abcdefghij', 'ايكةهأإىۃۓ') AS text FROM documents)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames of sound, louder and softer."""
    e = _table(spark, sf_dir, "embeddings").where("embedding is not null")
    loud = ((F.col("vec_id") * 37) % 50 + 1) / 50
    return e.select(F.col("label").alias("rec_id"), (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("frame_idx"), F.transform("embedding", lambda x: x.cast("double") * loud).alias("samples"))


FRAMES = """WITH f AS (SELECT label AS rec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx,
  10 * log10(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * (((vec_id*37) % 50 + 1) / 50.0)) ** 2)) / len(embedding) + 1e-10) AS db FROM embeddings WHERE embedding IS NOT NULL)"""


def quiet_gaps(seg: DataFrame) -> DataFrame:
    """Quiet stretches between segments half a second apart or more, a twentieth of a second short of both."""
    words = F.col("start_ds") + 4 * F.col("n_words") - 1  # where the last word ends
    at = seg.select("rec_id", ((words + 0.5) / 10).alias("start"), ((F.lead("start_ds").over(W.partitionBy("rec_id").orderBy("seg_idx")) - 0.5) / 10).alias("end"))
    return at.where("end - start > 0.35")


#: Samples a second of the derived sound.
SOUND_RATE = 20


def sound(seg: DataFrame, chunk: int) -> DataFrame:
    """Samples of each recording by formula, up to two seconds before its end, in rows of ``chunk``."""
    n = F.greatest((F.max("end_ds") * SOUND_RATE / 10).cast("int") - 2 * SOUND_RATE, F.lit(1))
    total = seg.groupBy("rec_id").agg(n.alias("n"))
    rows = total.select("rec_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk).cast("int"))).alias("chunk_idx"))
    first = F.col("chunk_idx") * chunk
    value = lambda i: F.pmod(F.col("rec_id") * 7 + i * 13, F.lit(2001)).cast("int") - 1000
    return rows.select("rec_id", "chunk_idx", F.transform(F.sequence(first, F.least(first + chunk, F.col("n")) - 1), lambda i: value(i).cast("smallint")).alias("samples"))
