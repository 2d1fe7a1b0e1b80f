"""A query for each operator, on tables derived from the synthetic ones, and its SQL for DuckDB where SQL can say it.

Results carry whole tenths of a second where times are compared, never rounded floats.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import clock as K
from .functions import costs
from .functions import helpers as H
from .functions import text as T
from .jobs import workloads as J
from .operators import clips as CL
from .operators import frames as FR
from .operators import learning as LE
from .operators import paragraphs as PA
from .operators import pending as PE
from .operators import regions as RE
from .operators import scoring as SC
from .operators import sections as SE
from .operators import segments as SG
from .sources import readers as RD
from .sources import writers as WR
from .streaming.corrected import stream_corrected

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def on_segments(name: str, sql: str | None = None) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """A query of the derived segments alone."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Query:
        return query(name, None if sql is None else X.SEGMENTS + sql)(lambda spark, d: f(X.segments(spark, d)))

    return add


def ds(c: Column | str) -> Column:
    """Seconds as whole tenths."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 10).cast("long")


#: Whole-word rules that the derived texts hold.
RULES = [("the", "THE"), ("of the", "OF-THE"), ("que", "QUE"), ("die", "DIE"), ("de", "d$1e")]


def _ruled(c: str) -> str:
    """RULES in SQL, on single-spaced texts whose words stand alone."""
    out = f"' ' || replace({c}, ' ', '  ') || ' '"
    for wrong, right in RULES:
        out = f"replace({out}, ' {wrong.replace(' ', '  ')} ', ' {right} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


_PLAIN = r"trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N} ]', ' ', 'g'), ' +', ' ', 'g'))"


def plain(seg: DataFrame) -> DataFrame:
    """Segments whose texts have single blanks and no punctuation."""
    return seg.withColumn("text", F.trim(F.regexp_replace(F.regexp_replace("text", r"[^\p{L}\p{N} ]", " "), " +", " "))).where("text <> ''")


PLAIN = f", pl AS (SELECT * REPLACE ({_PLAIN} AS text) FROM s WHERE {_PLAIN} <> '')"


# segments


@on_segments(
    "clean_segments",
    """, m AS (SELECT rec_id, max(end_ds) AS total FROM s GROUP BY 1)
SELECT rec_id, seg_idx, start_ds + rec_id % 3 * 10 AS start_ds, least(end_ds + rec_id % 3 * 10, total) AS end_ds, text, coalesce(nullif(language, 'ar'), 'ur') AS language
FROM s JOIN m USING (rec_id) WHERE start_ds + rec_id % 3 * 10 < total - 5""",
)
def _(seg):
    raw = seg.select("rec_id", "seg_idx", "start", "end", F.concat(F.lit(" \t"), "text", F.lit(" ")).alias("text"), F.nullif("language", F.lit("ar")).alias("language"))
    out = SG.clean_segments(raw, X.recordings(seg).withColumn("offset", F.col("rec_id") % 3 * 1.0))
    return out.select("rec_id", "seg_idx", ds("start").alias("start_ds"), ds("end").alias("end_ds"), "text", "language")


@query(
    "script_predicates",
    X.ARABIC
    + r""" SELECT rec_id, regexp_matches(text, '[\x{0900}-\x{097F}]') AS devanagari, regexp_matches(text, '[\x{0629}\x{064A}\x{0643}\x{0649}\x{0625}\x{0623}\x{064B}-\x{0652}]') AS arabic_only,
 regexp_matches(text, '[\x{0629}\x{064A}\x{0643}\x{0649}\x{0625}\x{0623}]') AS arabic_letters, regexp_matches(text, '[A-Za-z]') AS latin, regexp_matches(text, '(?i)اشترك|القناة|سبسکرائب|سبسکرائیب|ترجمة|subscribe|subtitles') AS invented,
 regexp_matches(text, '(۔|؟|!|\?|\.|۔»)$') AS sentence FROM a""",
)
def _(spark, d):
    t = F.col("text")
    return X.arabic_text(spark, d).select("rec_id", T.has_devanagari(t).alias("devanagari"), T.has_arabic_only(t).alias("arabic_only"), T.has_arabic_letters(t).alias("arabic_letters"), T.has_latin(t).alias("latin"), T.is_invented(t).alias("invented"), T.ends_sentence(t).alias("sentence"))


_ODD = r"[\x{0629}\x{064A}\x{0643}\x{0649}\x{0625}\x{0623}\x{064B}-\x{0652}]"


@on_segments("arabic_candidates", f" SELECT rec_id, seg_idx FROM s WHERE (avg_logprob < -0.6 OR regexp_matches(CASE WHEN seg_idx % 3 = 0 THEN translate(text, 'abcdefghij', 'ايكةهأإىۃۓ') ELSE text END, '{_ODD}')) AND end_ds - start_ds >= 20")
def _(seg):
    mapped = F.when(F.col("seg_idx") % 3 == 0, F.translate("text", "abcdefghij", "ايكةهأإىۃۓ")).otherwise(F.col("text"))
    return SG.arabic_candidates(seg.withColumn("text", mapped)).select("rec_id", "seg_idx")


@on_segments(
    "resolve_language",
    """ SELECT rec_id, seg_idx, CASE WHEN seg_idx % 12 = 0 AND seg_idx % 10 >= 6 THEN 'AR ' || text ELSE text END AS text, CASE WHEN seg_idx % 12 = 0 AND seg_idx % 10 >= 6 THEN 'ar' ELSE 'ur' END AS language FROM s""",
)
def _(seg):
    return SG.resolve_language(seg, X.probes(seg)).select("rec_id", "seg_idx", "text", "language")


@on_segments("sparse_segments", " SELECT rec_id, seg_idx FROM s WHERE (end_ds - start_ds) * 2 > 40 AND n_words / ((end_ds - start_ds) * 2 / 10.0) < 1.3")
def _(seg):
    return SG.sparse_segments(seg.withColumns({"start": F.col("start") * 2, "end": F.col("end") * 2})).select("rec_id", "seg_idx")


@on_segments("slice_text", " SELECT rec_id, string_agg(text, ' ' ORDER BY seg_idx) AS text FROM s WHERE start_ds >= 100 AND start_ds < 600 GROUP BY 1")
def _(seg):
    return SG.slice_text(seg, 10, 60)


@on_segments("rebase", " SELECT rec_id, seg_idx, start_ds + 25 AS start_ds, end_ds + 25 AS end_ds FROM s")
def _(seg):
    return SG.rebase(seg, 2.5).select("rec_id", "seg_idx", ds("start").alias("start_ds"), ds("end").alias("end_ds"))


@on_segments("flag_overlaps", X.EXCLUDES + " SELECT rec_id, seg_idx, EXISTS (SELECT 1 FROM ex WHERE ex.rec_id = s.rec_id AND start_ds < hi AND end_ds > lo) AS overlaps FROM s")
def _(seg):
    return SG.flag_overlaps(seg, X.excludes(seg)).select("rec_id", "seg_idx", "overlaps")


@on_segments("apply_exclude", X.EXCLUDES + " SELECT rec_id, seg_idx FROM s WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.rec_id = s.rec_id AND start_ds < hi AND end_ds > lo)")
def _(seg):
    return SG.apply_exclude(seg, X.excludes(seg)).select("rec_id", "seg_idx")


@on_segments("cut_totals", X.EXCLUDES + ", m AS (SELECT rec_id, max(end_ds) AS total FROM s GROUP BY 1) SELECT m.rec_id, least(total, coalesce((SELECT min(lo) FROM ex WHERE ex.rec_id = m.rec_id AND hi = 'infinity'::DOUBLE), total))::BIGINT AS total_ds FROM m")
def _(seg):
    return SG.cut_totals(X.recordings(seg), X.excludes(seg)).select("rec_id", ds("total").alias("total_ds"))


@on_segments("ordered", " SELECT rec_id, seg_idx, start_ds, text FROM s")
def _(seg):
    return SG.ordered(seg).select("rec_id", "seg_idx", "start_ds", "text")


@on_segments(
    "filter_recovered",
    """, q AS (SELECT rec_id, seg_idx, start_ds, text, string_split(text, ' ') AS ws FROM s WHERE seg_idx % 30 <= 24 AND avg_logprob * 1.25 >= -1.0),
k AS (SELECT rec_id, seg_idx, start_ds, ws, list_filter(generate_series(0, len(ws) - 1), lambda i: start_ds + 4*i + 1.5 >= start_ds + 7.2 AND start_ds + 4*i + 1.5 <= start_ds + 50.2) AS ix FROM q)
SELECT rec_id, seg_idx AS region_idx, start_ds + 4 * ix[1] AS start_ds, start_ds + 4 * ix[len(ix)] + 3 AS end_ds, array_to_string(list_transform(ix, lambda i: ws[i + 1]), '') AS text FROM k WHERE len(ix) > 0""",
)
def _(seg):
    at = X.with_words(seg).withColumn("avg_logprob", F.col("avg_logprob") * 1.25)  # from 0 to beyond the limit
    local = F.transform("words", lambda w: F.struct((w["start"] - F.col("start") + 1).alias("start"), (w["end"] - F.col("start") + 1).alias("end"), w["word"].alias("word"), w["prob"].alias("prob")))
    pieces = at.select("rec_id", F.col("seg_idx").alias("region_idx"), F.lit(0).alias("piece_idx"), (F.col("start") - 1).alias("clip_start"), "text", "avg_logprob", (F.col("seg_idx") % 30 / 10).alias("compression_ratio"), local.alias("words"))
    regions = at.select("rec_id", F.col("seg_idx").alias("region_idx"), (F.col("start") + 0.72).alias("start"), (F.col("start") + 5.02).alias("end"), F.lit(1e9).alias("total"))
    return SG.filter_recovered(pieces, regions).select("rec_id", "region_idx", ds("start").alias("start_ds"), ds("end").alias("end_ds"), "text")


# sections and learning


@on_segments(
    "section_pairs",
    X.SECTIONS
    + r""", j AS (SELECT c5.rec_id, sec_idx, any_value(c5.text) AS ref, string_agg(s.text, ' ' ORDER BY s.seg_idx) AS model FROM c5 JOIN s ON s.rec_id = c5.rec_id AND s.start_ds >= c5.start_ds AND s.start_ds < coalesce(c5.end_ds, 1e18) GROUP BY 1, 2),
k AS (SELECT rec_id, sec_idx, list_filter(string_split(regexp_replace(model, '[،۔؟؛٫!?.,:;"''«»()\[\]{}—–\-…]', ' ', 'g'), ' '), lambda x: x <> '') AS m, list_filter(string_split(regexp_replace(ref, '[،۔؟؛٫!?.,:;"''«»()\[\]{}—–\-…]', ' ', 'g'), ' '), lambda x: x <> '') AS r FROM j)
SELECT rec_id, sec_idx, array_to_string(m, ' ') AS model, array_to_string(r, ' ') AS ref FROM k WHERE len(m) > 0 AND len(r) > 0""",
)
def _(seg):
    return SE.section_pairs(X.sections(seg), seg).select("rec_id", "sec_idx", F.array_join("model", " ").alias("model"), F.array_join("ref", " ").alias("ref"))


_STAMP = "CASE WHEN {0} // 36000 > 0 THEN ({0} // 36000)::VARCHAR || ':' || lpad(({0} // 600 % 60)::VARCHAR, 2, '0') || ':' || lpad(({0} // 10 % 60)::VARCHAR, 2, '0') ELSE lpad(({0} // 600)::VARCHAR, 2, '0') || ':' || lpad(({0} // 10 % 60)::VARCHAR, 2, '0') END"


@on_segments("stamp", f" SELECT rec_id, seg_idx, {_STAMP.format('start_ds')} AS stamp, {_STAMP.format('(start_ds * 10)')} AS later FROM s")
def _(seg):
    return seg.select("rec_id", "seg_idx", K.stamp(F.col("start")).alias("stamp"), K.stamp(F.col("start") * 10).alias("later"))


@on_segments(
    "clock_round_trip",
    """ SELECT rec_id, seg_idx, lpad((start_ds // 36000)::VARCHAR, 2, '0') || ':' || lpad((start_ds // 600 % 60)::VARCHAR, 2, '0') || ':' || lpad((start_ds // 10 % 60)::VARCHAR, 2, '0') || '.' || (start_ds % 10)::VARCHAR AS clock,
 lpad((start_ds // 36000)::VARCHAR, 2, '0') || ':' || lpad((start_ds // 600 % 60)::VARCHAR, 2, '0') || ':' || lpad((start_ds // 10 % 60)::VARCHAR, 2, '0') || ',' || (start_ds % 10)::VARCHAR || '00' AS srt, start_ds, start_ds AS lenient_ds, start_ds // 10 AS heading, start_ds AS cue_ds FROM s""",
)
def _(seg):
    t = K.clock(F.col("start"))
    srt = K.srt_clock(F.col("start"))
    return seg.select("rec_id", "seg_idx", t.alias("clock"), srt.alias("srt"), ds(K.parse_time(srt)).alias("start_ds"), ds(K.clock_seconds(t)).alias("lenient_ds"), K.heading_seconds(F.substring(t, 1, 8)).cast("long").alias("heading"), ds(K.cue_seconds(F.concat(srt, F.lit(" --> "), srt, F.lit(" [Speaker 0]")))).alias("cue_ds"))


_SECTION_SQL = X.SECTIONS + """, h AS (SELECT rec_id, sec_idx, start_ds // 10 AS start, lead(start_ds // 10) OVER (PARTITION BY rec_id ORDER BY sec_idx) AS ended FROM c5),
b AS (SELECT rec_id, seg_idx // 5 AS sec_idx, string_agg(text, ' ' ORDER BY seg_idx) AS text FROM s GROUP BY 1, 2)"""


@on_segments("load_sections", _SECTION_SQL + " SELECT rec_id, sec_idx, start, coalesce(ended, -1) AS ended, length(text) AS n FROM h JOIN b USING (rec_id, sec_idx) WHERE NOT regexp_matches(text, '(^| )[^ ] [^ ]( |$)|^\\d+$')")
def _(seg):
    out = SE.load_sections(X.lines(seg), repair=False)
    kept = X.sections(seg).select("rec_id", "sec_idx").join(seg.groupBy("rec_id", F.expr("cast(seg_idx div 5 as int)").alias("sec_idx")).agg(SG.joined(["seg_idx"]).alias("t")), ["rec_id", "sec_idx"]).where(~F.col("t").rlike(r"(^| )[^ ] [^ ]( |$)|^\d+$"))
    return out.join(kept, ["rec_id", "sec_idx"]).select("rec_id", "sec_idx", F.col("start").cast("long").alias("start"), F.coalesce(F.col("end").cast("long"), F.lit(-1)).alias("ended"), F.length("text").cast("long").alias("n"))


_REPAIR = """, q AS (SELECT rec_id, list(start_ds // 10 + CASE sec_idx % 4 WHEN 1 THEN 900 WHEN 2 THEN -600 ELSE 0 END ORDER BY sec_idx) AS raws FROM c5 GROUP BY 1),
g AS (WITH RECURSIVE r AS (SELECT rec_id, raws, 1 AS k, raws[1]::DOUBLE AS t FROM q UNION ALL
  SELECT rec_id, raws, k + 1, CASE WHEN raws[k + 1] > t THEN raws[k + 1] ELSE coalesce(list_filter(list_transform([3600, 600, 1200, 1800, 2400, 3000, 3600, 4200, 4800, 5400, 6000, 6600], lambda x: raws[k + 1] + x), lambda m: m > t AND m < coalesce(list_filter(raws[k + 2:], lambda x: x > t)[1]::DOUBLE, 'infinity'::DOUBLE))[1]::DOUBLE,
    (t + list_filter(raws[k + 2:], lambda x: x > t)[1]) / 2, t + 1) END FROM r WHERE k < len(raws)) SELECT * FROM r)"""


@on_segments("repair_times", X.SECTIONS + _REPAIR + " SELECT rec_id, k - 1 AS sec_idx, round(t, 4) AS start FROM g")
def _(seg):
    """Sections of which some are an hour's quarter late and others ten minutes early."""
    odd = F.when(F.col("sec_idx") % 4 == 1, 900).when(F.col("sec_idx") % 4 == 2, -600).otherwise(0)
    out = SE.repaired(X.sections(seg).select("rec_id", "sec_idx", (F.floor("start") + odd).cast("double").alias("start"), "text"))
    return out.select("rec_id", "sec_idx", F.round("start", 4).alias("start"))


@on_segments(
    "merge_sections",
    X.SECTIONS
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY sec_idx) AS k FROM c5),
g AS (WITH RECURSIVE r AS (SELECT rec_id, k, start_ds AS a, end_ds AS z, 0 AS grp FROM o WHERE k = 1
  UNION ALL SELECT o.rec_id, o.k, CASE WHEN r.z IS NOT NULL AND r.z - r.a < 600 THEN r.a ELSE o.start_ds END, o.end_ds, CASE WHEN r.z IS NOT NULL AND r.z - r.a < 600 THEN r.grp ELSE r.grp + 1 END FROM r JOIN o ON o.rec_id = r.rec_id AND o.k = r.k + 1) SELECT * FROM r)
SELECT g.rec_id, grp AS sec_idx, min(start_ds) AS start_ds, arg_max(coalesce(end_ds, -1), g.k) AS end_ds, string_agg(text, ' ' ORDER BY g.k) AS text FROM g JOIN o ON o.rec_id = g.rec_id AND o.k = g.k GROUP BY 1, 2""",
)
def _(seg):
    return SE.merge_sections(X.sections(seg), 60).select("rec_id", "sec_idx", ds("start").alias("start_ds"), F.coalesce(ds("end"), F.lit(-1)).alias("end_ds"), "text")


@on_segments(
    "aligned_pairs",
    X.TOKEN_PAIRS
    + """, x AS (SELECT *, (rec_id + pos) % 17 = 5 AS lost FROM tp), e AS (SELECT model, ref FROM x WHERE model = ref AND NOT lost),
o AS (SELECT *, pos - row_number() OVER (PARTITION BY rec_id, seg_idx ORDER BY pos) AS run FROM x WHERE model <> ref OR lost),
gr AS (SELECT rec_id, seg_idx, run, count(*) AS m, count(*) FILTER (WHERE NOT lost) AS r, string_agg(model, ' ' ORDER BY pos) AS ms, string_agg(ref, ' ' ORDER BY pos) FILTER (WHERE NOT lost) AS rs FROM o GROUP BY 1, 2, 3),
pr AS (SELECT * FROM e UNION ALL SELECT model, ref FROM o JOIN gr USING (rec_id, seg_idx, run) WHERE m = r AND m <= 2 UNION ALL SELECT ms, rs FROM gr WHERE m = 2 AND r = 1) SELECT model, ref, count(*) AS count FROM pr GROUP BY 1, 2""",
)
def _(seg):
    # each word carries its place, so only one alignment is right; some words are missing in the human text
    marked = lambda x, c: F.concat(x[c], F.lit("#"), x["pos"].cast("string"))
    rows = X.token_pairs(seg).groupBy("rec_id", "seg_idx").agg(F.sort_array(F.collect_list(F.struct("pos", "model", "ref"))).alias("p"))
    heard = F.filter("p", lambda x: (F.col("rec_id") + x["pos"]) % 17 != 5)
    out = LE.align(rows.select(F.transform("p", lambda x: marked(x, "model")).alias("model"), F.transform(heard, lambda x: marked(x, "ref")).alias("ref")))
    bare = lambda c: F.regexp_replace(c, r"#\d+(?= |$)", "").alias(c)
    return out.select(bare("model"), bare("ref")).groupBy("model", "ref").count()


@on_segments("alignment_seen", X.TOKEN_PAIRS + " SELECT model AS wrong, count(*) AS seen FROM tp GROUP BY 1")
def _(seg):
    return LE.seen(X.token_pairs(seg))


_NORM = r"trim(regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace({0}, '\(\p{{Nd}}{{1,2}}(:\p{{Nd}}{{2}}){{1,2}}\)', ' ', 'g'), '[\x{{0610}}-\x{{061A}}\x{{064B}}-\x{{065F}}\x{{0670}}\x{{06D6}}-\x{{06ED}}\x{{200C}}\x{{200D}}\x{{200F}}]', '', 'g'), 'يىكةۃهأإۓ', 'ییکہہہااے'), '[^\p{{L}}\p{{N}}\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g'), '[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"
_FIXES = X.TOKEN_PAIRS + f", fx AS (SELECT model AS wrong, ref AS \"right\", count(*) AS n FROM tp WHERE {_NORM.format('model')} <> {_NORM.format('ref')} GROUP BY 1, 2)"
_BEST = _FIXES + ", bf AS (SELECT wrong, \"right\", n FROM fx QUALIFY row_number() OVER (PARTITION BY wrong ORDER BY n DESC, \"right\" DESC) = 1), sn AS (SELECT model AS wrong, count(*) AS seen FROM tp GROUP BY 1)"
_RULES = _BEST + ", rl AS (SELECT wrong, \"right\", n, n / seen AS share FROM bf JOIN sn USING (wrong) WHERE n >= 2 AND n / seen >= 0.6 AND length(replace(wrong, ' ', '')) >= 3 AND wrong NOT IN ('that', 'oned'))"
_VOCAB = _RULES + ", rw AS (SELECT ref AS word, count(*) AS n FROM tp GROUP BY 1), vc AS (SELECT DISTINCT word, rw.n FROM rl JOIN rw ON word = \"right\" WHERE rw.n >= 2)"


@on_segments("alignment_fixes", _FIXES + ' SELECT wrong, "right", n AS count FROM fx')
def _(seg):
    return LE.fixes(X.token_pairs(seg))


@on_segments("best_fix", _BEST + ' SELECT wrong, "right", n AS count FROM bf')
def _(seg):
    return LE.best_fix(LE.fixes(X.token_pairs(seg)))


def _rules(seg: DataFrame, alike: float | None = None) -> DataFrame:
    p = X.token_pairs(seg)
    ignore = seg.sparkSession.createDataFrame([("that",), ("oned",)], "word string")
    return LE.select_rules(LE.alignment_counts(p), ignore=ignore, alike=alike)


@on_segments("select_rules", _RULES + ' SELECT wrong, "right", n AS count, share FROM rl')
def _(seg):
    return _rules(seg)


@on_segments("looks_alike")
def _(seg):
    return _rules(seg, 0.5)


@on_segments("top_rules", _RULES + ' SELECT wrong, "right", n AS count, share FROM rl ORDER BY n DESC, share DESC, wrong DESC, "right" DESC LIMIT 40')
def _(seg):
    return LE.top_rules(_rules(seg))


def _vocabulary(seg: DataFrame) -> DataFrame:
    words = X.token_pairs(seg).select(F.array("ref").alias("ref"))
    return LE.vocabulary(_rules(seg), LE.ref_words(words))


@on_segments("vocabulary", _VOCAB + " SELECT word, n AS count FROM vc")
def _(seg):
    return _vocabulary(seg)


@on_segments("top_vocabulary", _VOCAB + " SELECT word, n AS count FROM vc ORDER BY n DESC, word LIMIT 30")
def _(seg):
    return LE.top_vocabulary(_vocabulary(seg))


@on_segments("render_rules", _RULES + " SELECT wrong || chr(9) || \"right\" || chr(9) || '# ' || n || 'x, ' || round_even(share * 100, 0)::INT || '%' AS line FROM rl")
def _(seg):
    return WR.render_rules(_rules(seg))


@on_segments("render_vocabulary", _VOCAB + " SELECT word AS line FROM vc")
def _(seg):
    return WR.render_vocabulary(_vocabulary(seg))


@on_segments("learn_rules")
def _(seg):
    rules, _ = J.learn(X.lines(seg), seg.withColumn("text", F.translate("text", "s", "z")))
    return rules


# scoring


# The machine's texts are the human ones with three letters for others that occur nowhere: what holds one of the three can
# match nothing, so the cheapest alignment is one for one, and SQL can count the edits without a distance. Words that are
# left out of the human texts are insertions.
def _read(seg: DataFrame) -> DataFrame:
    norm = T.normalize(F.col("text"))
    return seg.withColumn("ref", norm).withColumn("hyp", F.translate(norm, "esn", "þđŋ")).where("ref <> ''")


_READ = f", q AS (SELECT rec_id, seg_idx, language, {_NORM.format('text')} AS ref FROM s), u AS (SELECT rec_id, seg_idx, language, unnest(string_split(ref, ' ')) AS h FROM q WHERE ref <> '')"


@on_segments("char_error", _READ + " SELECT rec_id, seg_idx, length(ref) - length(regexp_replace(ref, '[esn]', '', 'g')) AS edits, length(ref) AS n FROM q WHERE ref <> ''")
def _(seg):
    q = _read(seg)
    return q.select("rec_id", "seg_idx", F.round(SC.char_error(F.col("ref"), F.col("hyp")) * F.length("ref")).cast("long").alias("edits"), F.length("ref").cast("long").alias("n"))


@on_segments("word_error", _READ + " SELECT rec_id, seg_idx, count(*) AS n, count(*) FILTER (WHERE regexp_matches(h, '[esn]')) AS wrong FROM u GROUP BY 1, 2")
def _(seg):
    out = SC.word_error(_read(seg).select("rec_id", "seg_idx", "ref", "hyp"))
    return out.select("rec_id", "seg_idx", F.col("ref_words").cast("long").alias("n"), F.round(F.col("wer") * F.col("ref_words")).cast("long").alias("wrong"))


_EDITS = "count(*) FILTER (WHERE NOT regexp_matches(h, '[esn]')) AS hits, count(*) FILTER (WHERE regexp_matches(h, '[esn]')) AS substitutions"


@on_segments("edit_ops", _READ + f" SELECT rec_id, seg_idx, {_EDITS}, 0 AS deletions, 2::BIGINT AS insertions FROM u GROUP BY 1, 2")
def _(seg):
    ops = H.edit_ops("ref", F.concat("hyp", F.lit(" ŋŋ ŋŋŋ"))).alias("o")
    return _read(seg).select("rec_id", "seg_idx", ops).select("rec_id", "seg_idx", "o.hits", "o.substitutions", "o.deletions", "o.insertions")


@on_segments(
    "corpus_error",
    _READ + """, e AS (SELECT language, count(*) AS n, count(*) FILTER (WHERE regexp_matches(h, '[esn]')) AS wrong FROM u GROUP BY 1), d AS (SELECT language, count(*) AS m FROM q WHERE ref <> '' GROUP BY 1)
SELECT language, n + m AS ref_words, n AS hyp_words, (wrong + m)::DOUBLE / (n + m) AS wer, (wrong + m)::DOUBLE / (n + m) AS miss FROM e JOIN d USING (language)""",
)
def _(seg):
    # the human texts have a word more
    q = _read(seg).withColumn("ref", F.concat(F.lit("ŋŋŋ "), "ref"))
    return SC.corpus_error(SC.word_error(q.select("rec_id", "language", "ref", "hyp")), ["language"])


_SCORED = """, r AS (SELECT rec_id, string_agg(text, ' ' ORDER BY seg_idx) AS text FROM s {0} GROUP BY 1), nn AS (SELECT rec_id, {1} AS ref FROM r),
v AS (SELECT rec_id, unnest(string_split(ref, ' ')) AS h FROM nn WHERE ref <> ''), e AS (SELECT rec_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(h, '[esn]')) AS wrong FROM v GROUP BY 1)
SELECT nn.rec_id, coalesce(e.n, 0) AS ref_words, coalesce(e.n, 0) AS hyp_words, coalesce(e.wrong, 0) AS wrong, length(ref) - length(regexp_replace(ref, '[esn]', '', 'g')) AS letters FROM nn LEFT JOIN e USING (rec_id)"""


def _scores(out: DataFrame, seg: DataFrame) -> DataFrame:
    size = seg.groupBy("rec_id").agg(F.length(T.normalize(SG.joined(["seg_idx"]))).alias("size"))
    letters = F.round(F.coalesce(F.col("cer"), F.lit(0.0)) * F.col("size")).cast("long")
    both = out.join(size, "rec_id")
    return both.select("rec_id", F.col("ref_words").cast("long").alias("ref_words"), F.col("hyp_words").cast("long").alias("hyp_words"), F.col("substitutions").cast("long").alias("wrong"), letters.alias("letters"))


def _misheard(seg: DataFrame) -> DataFrame:
    return seg.withColumn("text", F.translate("text", "esn", "þđŋ"))


@on_segments("score_cut", _SCORED.format("WHERE start_ds >= 100 AND start_ds < 900", _NORM.format("text")))
def _(seg):
    """Every third recording has no sections and is held against its whole transcript, which is the same stretch here."""
    own = seg.where("start_ds >= 100 and start_ds < 900")
    sections = own.where("rec_id % 3 <> 0").select("rec_id", F.col("seg_idx").alias("sec_idx"), "start", "end", "text")
    raw = own.groupBy("rec_id").agg(SG.joined(["seg_idx"]).alias("text"))
    out = J.score(sections, _misheard(seg), raw=raw, start=10, end=90)
    return _scores(out, own)


@on_segments("anchored_error", _SCORED.format("", _NORM.format("text")))
def _(seg):
    """Whole recordings, in pieces."""
    raw = seg.groupBy("rec_id").agg(SG.joined(["seg_idx"]).alias("text"))
    none = X.sections(seg).where("rec_id is null")
    return _scores(J.score(none, _misheard(seg), raw=raw, anchors=True), seg)


@on_segments("score_pairs")
def _(seg):
    return J.score(SE.load_sections(X.lines(seg)), seg.withColumn("text", F.translate("text", "s", "z")), RULES, anchors=True).drop("candidate")


# paragraphs


@on_segments(
    "paragraphs",
    PLAIN
    + f""", r0 AS (SELECT rec_id, seg_idx, start_ds, end_ds, language, {_ruled("text")} AS text FROM pl), b AS (SELECT *, CASE WHEN lag(language) OVER w = language AND start_ds - lag(end_ds) OVER w <= 15 THEN 0 ELSE 1 END AS brk FROM r0 WINDOW w AS (PARTITION BY rec_id ORDER BY start_ds, seg_idx)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY rec_id ORDER BY start_ds, seg_idx) AS grp FROM b)
SELECT rec_id, (grp - 1)::BIGINT AS par_idx, min(start_ds) AS start_ds, max(end_ds) AS end_ds, any_value(language) AS language, string_agg(text, ' ' ORDER BY seg_idx) || CASE WHEN any_value(language) = 'ur' THEN '۔' ELSE '' END AS text FROM g GROUP BY 1, 2""",
)
def _(seg):
    out = PA.paragraphs(plain(seg), RULES, max_words=1 << 30)
    return out.select("rec_id", F.col("par_idx").cast("long").alias("par_idx"), ds("start").alias("start_ds"), ds("end").alias("end_ds"), "language", "text")


@on_segments(
    "paragraphs_by_length",
    PLAIN
    + """, x AS (SELECT *, len(string_split(text, ' ')) AS m, row_number() OVER (PARTITION BY rec_id ORDER BY start_ds, seg_idx) AS k FROM pl),
g AS (WITH RECURSIVE r AS (SELECT rec_id, k, m AS held, end_ds, language, 0 AS p FROM x WHERE k = 1
  UNION ALL SELECT x.rec_id, x.k, CASE WHEN x.language <> r.language OR x.start_ds - r.end_ds > 15 OR r.held > 110 THEN x.m ELSE r.held + x.m END, x.end_ds, x.language, CASE WHEN x.language <> r.language OR x.start_ds - r.end_ds > 15 OR r.held > 110 THEN r.p + 1 ELSE r.p END FROM r JOIN x ON x.rec_id = r.rec_id AND x.k = r.k + 1) SELECT * FROM r)
SELECT rec_id, p AS par_idx, max(held) AS n_words FROM g GROUP BY 1, 2""",
)
def _(seg):
    out = PA.paragraphs(plain(seg))
    return out.select("rec_id", F.col("par_idx").cast("int").alias("par_idx"), T.word_count(F.col("text")).cast("long").alias("n_words"))


@on_segments(
    "rebuild_documents",
    PLAIN
    + f""", r0 AS (SELECT rec_id, seg_idx, start_ds, end_ds, language, {_ruled("text")} AS text FROM pl), x AS (SELECT *, len(string_split(text, ' ')) AS m, row_number() OVER (PARTITION BY rec_id ORDER BY start_ds, seg_idx) AS k FROM r0),
g AS (WITH RECURSIVE r AS (SELECT rec_id, k, m AS held, end_ds, language, 0 AS p FROM x WHERE k = 1
  UNION ALL SELECT x.rec_id, x.k, CASE WHEN x.language <> r.language OR x.start_ds - r.end_ds > 15 OR r.held > 110 THEN x.m ELSE r.held + x.m END, x.end_ds, x.language, CASE WHEN x.language <> r.language OR x.start_ds - r.end_ds > 15 OR r.held > 110 THEN r.p + 1 ELSE r.p END FROM r JOIN x ON x.rec_id = r.rec_id AND x.k = r.k + 1) SELECT * FROM r),
y AS (SELECT x.rec_id, g.p, min(x.start_ds) AS start_ds, string_agg(x.text, ' ' ORDER BY x.k) || CASE WHEN any_value(x.language) = 'ur' THEN '۔' ELSE '' END AS text FROM x JOIN g ON g.rec_id = x.rec_id AND g.k = x.k GROUP BY 1, 2),
b AS (SELECT rec_id, string_agg('(' || {_STAMP.format("start_ds")} || ') ' || text, chr(10) ORDER BY p) AS body FROM y GROUP BY 1), m AS (SELECT rec_id, max(end_ds) AS total FROM s GROUP BY 1)
SELECT rec_id, concat_ws(chr(10), rec_id || '.mp3 | ' || {_STAMP.format("total")} || ' | Whisper m | 2024-01-02 | machine transcript, please verify', body) AS text FROM m LEFT JOIN b USING (rec_id)""",
)
def _(seg):
    recs = X.recordings(seg).select("rec_id", F.concat(F.lit("/talks/"), "rec_id", F.lit(".mp3")).alias("source"), F.col("total").alias("duration_seconds"), F.lit("m").alias("model"), F.lit("2024-01-02T03:04").alias("created"))
    return J.rebuild_documents(recs, plain(seg), RULES)


# skipped speech


def _recognized(seg: DataFrame) -> DataFrame:
    return seg.where("seg_idx % 4 <> 3")


_BINS = """, m AS (SELECT rec_id, max(end_ds) AS total FROM s GROUP BY 1), v AS (SELECT rec_id, unnest(generate_series(start_ds, end_ds)) AS bin FROM s),
k AS (SELECT rec_id, unnest(generate_series(start_ds, end_ds)) AS bin FROM s WHERE seg_idx % 4 <> 3), u AS (SELECT DISTINCT v.rec_id, v.bin FROM v JOIN m USING (rec_id) ANTI JOIN k ON k.rec_id = v.rec_id AND k.bin = v.bin WHERE v.bin < total + 1),
i AS (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY rec_id ORDER BY bin) <= 5 THEN 0 ELSE 1 END AS n FROM u), j AS (SELECT *, sum(n) OVER (PARTITION BY rec_id ORDER BY bin) AS run FROM i),
runs AS (SELECT rec_id, run, min(bin) AS a, max(bin) AS z FROM j GROUP BY 1, 2)"""


@on_segments("islands", _BINS + " SELECT rec_id, a AS first, z AS last FROM runs WHERE z - a + 1 >= 8")
def _(seg):
    bins = RE.uncovered_bins(_recognized(seg), X.voice(seg), X.recordings(seg))
    return RE.islands(bins, ["rec_id"], "bin", 5, 8)


_REGIONS = _BINS + """, rg AS (SELECT rec_id, a AS start_ds, z + 1 AS end_ds, NULL::INT AS seg_idx FROM runs WHERE z - a + 1 >= 8)"""


@on_segments(
    "missed_regions",
    _REGIONS
    + """, sp AS (SELECT * FROM rg UNION ALL SELECT rec_id, start_ds, end_ds, seg_idx::INT FROM s WHERE seg_idx % 4 <> 3 AND seg_idx % 5 = 2 AND end_ds - start_ds > 40 AND least(n_words, 2) / ((end_ds - start_ds) / 10.0) < 1.3)
SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY start_ds, seg_idx IS NOT NULL, seg_idx) - 1 AS region_idx, start_ds, end_ds, seg_idx FROM sp""",
)
def _(seg):
    # of every fifth segment only the first two words were recognized
    heard = seg.withColumn("text", F.when(F.col("seg_idx") % 5 == 2, F.substring_index("text", " ", 2)).otherwise(F.col("text")))
    out = RE.missed_regions(_recognized(heard), X.voice(seg), X.recordings(seg))
    return out.select("rec_id", F.col("region_idx").cast("long").alias("region_idx"), ds("start").alias("start_ds"), ds("end").alias("end_ds"), F.col("replaced_seg_idx").alias("seg_idx"))


@on_segments("uncovered_stretches", _BINS + ", b AS (SELECT *, bin - row_number() OVER (PARTITION BY rec_id ORDER BY bin) AS g FROM u) SELECT rec_id, min(bin) AS first, max(bin) AS last FROM b GROUP BY rec_id, g")
def _(seg):
    # neighbours that touch where a voice begins or ends are one stretch
    return RE.bridged(RE.uncovered_stretches(_recognized(seg), X.voice(seg), X.recordings(seg)), ["rec_id"], 1)


@on_segments(
    "widen_regions",
    _REGIONS
    + """, wd AS (SELECT DISTINCT rg.rec_id, coalesce((SELECT max(end_ds) FROM s WHERE s.rec_id = rg.rec_id AND s.seg_idx % 4 <> 3 AND s.end_ds <= rg.start_ds + 0.5), 0) AS start_ds,
 coalesce((SELECT min(start_ds) FROM s WHERE s.rec_id = rg.rec_id AND s.seg_idx % 4 <> 3 AND s.start_ds >= rg.end_ds - 0.5), total) AS end_ds FROM rg JOIN m USING (rec_id)) SELECT * FROM wd""",
)
def _(seg):
    return J.recovery_regions(_recognized(seg), X.voice(seg), X.recordings(seg)).select("rec_id", ds("start").alias("start_ds"), ds("end").alias("end_ds"))


@on_segments(
    "merge_recovered",
    """, f AS (SELECT rec_id, seg_idx FROM s WHERE seg_idx % 4 = 3), b AS (SELECT rec_id, seg_idx, n_words FROM s WHERE seg_idx % 8 = 0), x AS (SELECT rec_id, seg_idx FROM b WHERE seg_idx % 16 = 0)
SELECT s.rec_id, count(*) AS segments, sum(start_ds)::BIGINT AS starts, sum(CASE WHEN seg_idx % 16 = 0 THEN 2 * n_words ELSE n_words END)::BIGINT AS n FROM s GROUP BY 1""",
)
def _(seg):
    # found again: what was dropped, twice the words for half of the sparse ones, half the words for the others
    gaps = seg.where("seg_idx % 4 = 3").select("rec_id", F.col("seg_idx").alias("region_idx"), "start", "end", F.lit(None).cast("int").alias("replaced_seg_idx"), "text")
    sparse = seg.where("seg_idx % 8 = 0").select("rec_id", F.col("seg_idx").alias("region_idx"), "start", "end", F.col("seg_idx").cast("int").alias("replaced_seg_idx"), F.when(F.col("seg_idx") % 16 == 0, F.concat_ws(" ", "text", "text")).otherwise("one").alias("text"))
    both = gaps.unionByName(sparse)
    found = both.select("rec_id", "region_idx", F.lit(0).alias("piece_idx"), "start", "end", "text", F.lit("ur").alias("language"))
    out = RE.merge_recovered(_recognized(seg), both.drop("text"), found)
    return out.groupBy("rec_id").agg(F.count("*").alias("segments"), F.sum(ds("start")).alias("starts"), F.sum(T.word_count(F.col("text"))).alias("n"))


@on_segments(
    "recover",
    _REGIONS
    + """, wd AS (SELECT DISTINCT rg.rec_id, coalesce((SELECT max(end_ds) FROM s WHERE s.rec_id = rg.rec_id AND s.seg_idx % 4 <> 3 AND s.end_ds <= rg.start_ds + 0.5), 0) AS lo,
 coalesce((SELECT min(start_ds) FROM s WHERE s.rec_id = rg.rec_id AND s.seg_idx % 4 <> 3 AND s.start_ds >= rg.end_ds - 0.5), total) AS hi FROM rg JOIN m USING (rec_id)),
found AS (SELECT s.rec_id, s.start_ds, s.text FROM s JOIN wd ON wd.rec_id = s.rec_id AND s.start_ds >= lo AND s.start_ds < hi WHERE seg_idx % 4 = 3)
SELECT rec_id, start_ds, text FROM s WHERE seg_idx % 4 <> 3 UNION ALL SELECT rec_id, start_ds, text FROM found""",
)
def _(seg):
    recs = X.recordings(seg)
    regions = J.recovery_regions(_recognized(seg), X.voice(seg), recs)
    # the second recognizer hears what the first passed over, and half a second more on both sides
    lost = X.with_words(seg).where("seg_idx % 4 = 3").select("rec_id", "seg_idx", F.col("start").alias("s"), "words")
    spans = regions.select("rec_id", "region_idx", F.col("start").alias("lo"), F.col("end").alias("hi"))
    heard = spans.join(lost, "rec_id").where("s >= lo and s < hi").withColumn("clip_start", F.col("lo") - 0.5)
    local = lambda w: F.struct((w["start"] - F.col("clip_start")).alias("start"), (w["end"] - F.col("clip_start")).alias("end"), F.concat(F.lit(" "), w["word"]).alias("word"))
    noise = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(0.2).alias("end"), F.lit(" noise").alias("word")))
    pieces = heard.select("rec_id", "region_idx", F.col("seg_idx").alias("piece_idx"), "clip_start", F.lit("x").alias("text"), F.lit(-0.2).alias("avg_logprob"), F.lit(1.5).alias("compression_ratio"), F.concat(noise, F.transform("words", local)).alias("words"))
    return J.recover(_recognized(seg), regions, pieces, recs).select("rec_id", ds("start").alias("start_ds"), "text")


# frames


@query("frame_energy", X.FRAMES + " SELECT rec_id, frame_idx, round(db, 4) AS db FROM f")
def _(spark, d):
    return FR.frame_energy(X.frames(spark, d)).select("rec_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.round("db", 4).alias("db"))


@query("energy_thresholds", X.FRAMES + " SELECT rec_id, round(quantile_cont(db, 0.1), 4) AS floor, round(quantile_cont(db, 0.95), 4) AS speech FROM f GROUP BY 1")
def _(spark, d):
    return FR.energy_thresholds(FR.frame_energy(X.frames(spark, d))).select("rec_id", F.round("floor", 4).alias("floor"), F.round("speech", 4).alias("speech"))


@query(
    "quiet_runs",
    X.FRAMES
    + """, t AS (SELECT rec_id, quantile_cont(db, 0.1) AS lo, quantile_cont(db, 0.95) AS hi FROM f GROUP BY 1), q AS (SELECT f.rec_id, frame_idx FROM f JOIN t USING (rec_id) WHERE db < lo + 0.6 * (hi - lo) - 0.3 * (hi - lo)),
i AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY rec_id ORDER BY frame_idx) AS g FROM q) SELECT rec_id, min(frame_idx) AS first, max(frame_idx) + 1 AS last FROM i GROUP BY rec_id, g HAVING count(*) >= 2""",
)
def _(spark, d):
    runs = FR.quiet_runs(FR.frame_energy(X.frames(spark, d)), 2)
    return runs.select("rec_id", F.round(F.col("start") * 100).cast("long").alias("first"), F.round(F.col("end") * 100).cast("long").alias("last"))


# clips


def _units(seg: DataFrame) -> DataFrame:
    return CL.make_units(X.with_words(seg).withColumn("language", F.when(F.col("seg_idx") % 9 == 4, "ar").otherwise("ur")))


_UNITS = """, un AS (SELECT rec_id, seg_idx, 0 AS k, start_ds, end_ds, text, 'arabic' AS kind FROM s WHERE seg_idx % 9 = 4 UNION ALL SELECT rec_id, seg_idx, word_idx, start_ds, end_ds, word, 'word' FROM w WHERE seg_idx % 9 <> 4),
u AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start_ds, seg_idx, k) - 1 AS unit_idx FROM un)"""


@on_segments("make_units", X.WORDS + _UNITS + " SELECT rec_id, unit_idx, start_ds, end_ds, text, kind FROM u")
def _(seg):
    return _units(seg).select("rec_id", F.col("unit_idx").cast("long").alias("unit_idx"), ds("start").alias("start_ds"), ds("end").alias("end_ds"), "text", "kind")


@on_segments(
    "resolve_overlaps",
    X.WORDS
    + """, un AS (SELECT rec_id, seg_idx, 0 AS n, 10 * start_ds - 70 AS a, 10 * end_ds AS z, 'recovered' AS kind FROM s WHERE seg_idx % 3 = 1 AND language <> 'ar' UNION ALL SELECT rec_id, seg_idx, 0, 10 * start_ds - CASE WHEN seg_idx % 3 = 1 THEN 70 ELSE 0 END, 10 * end_ds, 'arabic' FROM s WHERE language = 'ar'
  UNION ALL SELECT rec_id, seg_idx, word_idx, 10 * start_ds, 10 * end_ds, 'word' FROM w WHERE seg_idx % 3 <> 1 AND language <> 'ar'),
m AS (SELECT *, max(z) OVER (PARTITION BY rec_id ORDER BY a, seg_idx, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM un),
st AS (SELECT *, sum(CASE WHEN reach IS NULL OR a >= reach + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY a, seg_idx, n) AS stretch FROM m), o AS (SELECT *, row_number() OVER (PARTITION BY rec_id, stretch ORDER BY a, seg_idx, n) AS k FROM st),
g AS (WITH RECURSIVE r AS (SELECT rec_id, stretch, k, 1 AS u, a::DOUBLE AS a, z::DOUBLE AS z, kind, NULL::DOUBLE AS cut FROM o WHERE k = 1 UNION ALL
  SELECT o.rec_id, o.stretch, o.k, CASE WHEN r.z > o.a AND big THEN r.u ELSE r.u + 1 END, CASE WHEN r.z <= o.a THEN o.a WHEN big THEN r.a ELSE (r.z + o.a) / 2 END, CASE WHEN r.z <= o.a THEN o.z WHEN big THEN greatest(r.z, o.z) ELSE greatest(o.z, (r.z + o.a) / 2 + 2) END,
   CASE WHEN r.z <= o.a OR NOT big THEN o.kind WHEN 'arabic' IN (r.kind, o.kind) THEN 'arabic' ELSE 'recovered' END, CASE WHEN r.z > o.a AND NOT big THEN (r.z + o.a) / 2 END
  FROM r JOIN o ON o.rec_id = r.rec_id AND o.stretch = r.stretch AND o.k = r.k + 1, LATERAL (SELECT r.z - o.a > 30 AND 'recovered' IN (r.kind, o.kind) AS big)) SELECT * FROM r),
e AS (SELECT rec_id, stretch, u, arg_max(a, k) AS a, arg_max(z, k) AS z, arg_max(kind, k) AS kind, arg_min(coalesce(cut, -1e9), k) AS cut FROM g GROUP BY 1, 2, 3)
SELECT rec_id, row_number() OVER v - 1 AS unit_idx, round(10 * a)::BIGINT AS start_ms, round(10 * CASE WHEN lead(u) OVER v > 1 AND lead(cut) OVER v > -1e9 THEN lead(cut) OVER v ELSE z END)::BIGINT AS end_ms, kind FROM e WINDOW v AS (PARTITION BY rec_id ORDER BY stretch, u)""",
)
def _(seg):
    late = F.when(F.col("seg_idx") % 3 == 1, 0.7).otherwise(0.0)
    words = F.when(F.col("seg_idx") % 3 == 1, F.array().cast("array<struct<start:double,end:double,word:string,prob:double>>")).otherwise(F.col("words"))
    at = X.with_words(seg).withColumn("words", words).withColumn("start", F.col("start") - late)
    return CL.make_units(at).select("rec_id", F.col("unit_idx").cast("long").alias("unit_idx"), K.millis(F.col("start")).alias("start_ms"), K.millis(F.col("end")).alias("end_ms"), "kind")


_EDGES = X.WORDS + _UNITS + ", e AS (SELECT *, CASE WHEN lead(start_ds) OVER (PARTITION BY rec_id ORDER BY unit_idx) IS NULL THEN 10 ELSE greatest(0, lead(start_ds) OVER (PARTITION BY rec_id ORDER BY unit_idx) - end_ds) END AS pause_ds FROM u)"


@on_segments("word_edges", _EDGES + " SELECT rec_id, unit_idx, start_ds AS left_ds, end_ds AS right_ds, pause_ds FROM e")
def _(seg):
    out = CL.word_edges(_units(seg))
    return out.select("rec_id", F.col("unit_idx").cast("long").alias("unit_idx"), ds("left").alias("left_ds"), ds("right").alias("right_ds"), ds("pause").alias("pause_ds"))


@on_segments(
    "word_edges_with_sound",
    X.WORDS
    + _UNITS
    + """, g AS (SELECT *, lead(start_ds) OVER w AS nx, lag(end_ds) OVER w AS pv FROM u WINDOW w AS (PARTITION BY rec_id ORDER BY unit_idx)),
h AS (SELECT rec_id, unit_idx, start_ds, end_ds, CASE WHEN kind = 'word' AND nx - end_ds >= 5 THEN 10 * end_ds + 5 ELSE 10 * end_ds END AS right_cs, CASE WHEN start_ds - pv >= 5 AND pk = 'word' THEN 10 * start_ds - 5 ELSE 10 * start_ds END AS left_cs
  FROM (SELECT *, lag(kind) OVER (PARTITION BY rec_id ORDER BY unit_idx) AS pk FROM g))
SELECT rec_id, unit_idx, left_cs, right_cs, CASE WHEN lead(left_cs) OVER v IS NULL THEN 100 ELSE greatest(0, lead(left_cs) OVER v - right_cs) END::BIGINT AS pause_cs FROM h WINDOW v AS (PARTITION BY rec_id ORDER BY unit_idx)""",
)
def _(seg):
    spoken = seg.where("seg_idx % 9 <> 4")  # Arabic segments have no words here, and no quiet beside them
    gaps = X.quiet_gaps(seg).join(spoken.select("rec_id", ((F.col("start_ds") + 4 * F.col("n_words") - 0.5) / 10).alias("start")), ["rec_id", "start"], "left_semi")
    out = CL.word_edges(_units(seg), X.recordings(seg), gaps)
    cs = lambda c: F.round(F.col(c) * 100).cast("long")
    return out.select("rec_id", F.col("unit_idx").cast("long").alias("unit_idx"), cs("left").alias("left_cs"), cs("right").alias("right_cs"), cs("pause").alias("pause_cs"))


_RUNS = (
    _EDGES
    + X.EXCLUDES
    + """, z AS (SELECT e.*, kind = 'arabic' OR EXISTS (SELECT 1 FROM ex WHERE ex.rec_id = e.rec_id AND e.start_ds < hi AND e.end_ds > lo) AS barrier, lead(start_ds) OVER (PARTITION BY rec_id ORDER BY unit_idx) AS nx FROM e),
y AS (SELECT z.*, NOT barrier AND nx IS NOT NULL AND EXISTS (SELECT 1 FROM ex WHERE ex.rec_id = z.rec_id AND z.end_ds < hi AND z.nx > lo) AS gap FROM z),
x AS (SELECT *, lag(barrier OR pause_ds >= 10 OR gap) OVER w AS pe, coalesce(lag(barrier OR gap) OVER w, FALSE) AS fo, gap OR (coalesce(lead(barrier) OVER w, FALSE) AND pause_ds < 10) AS ot FROM y WINDOW w AS (PARTITION BY rec_id ORDER BY unit_idx)),
q AS (SELECT *, sum(CASE WHEN NOT barrier AND coalesce(pe, TRUE) THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY unit_idx) AS run_id FROM x)"""
)


@on_segments("speech_runs", _RUNS + " SELECT rec_id, run_id::BIGINT AS run_id, count(*) AS n, min(unit_idx) AS first, arg_min(fo, unit_idx) AS open_start, arg_max(ot, unit_idx) AS open_end FROM q WHERE NOT barrier GROUP BY 1, 2")
def _(seg):
    runs, _ = CL.speech_runs(CL.word_edges(_units(seg)), X.excludes(seg))
    return runs.groupBy("rec_id", "run_id").agg(F.count("*").alias("n"), F.min("unit_idx").cast("long").alias("first"), F.first("open_start").alias("open_start"), F.first("open_end").alias("open_end"))


_TRIMMED = (
    _RUNS
    + """, t0 AS (SELECT q.*, coalesce(lag(pause_ds) OVER (PARTITION BY rec_id ORDER BY unit_idx), 10) AS before FROM q),
r AS (SELECT rec_id, run_id, arg_min(fo, unit_idx) AS opens, arg_max(ot, unit_idx) AS stays, arg_min(before, unit_idx) AS before, min(start_ds) AS a, min(unit_idx) FILTER (WHERE pause_ds >= 2) AS head, arg_min(end_ds, unit_idx) FILTER (WHERE pause_ds >= 2) AS head_end FROM t0 WHERE NOT barrier GROUP BY 1, 2),
fr AS (SELECT q.*, stays, coalesce(opens AND r.before < 2 AND head_end - a <= 15 AND unit_idx <= head, FALSE) AS front FROM q JOIN r USING (rec_id, run_id) WHERE NOT barrier),
lu AS (SELECT rec_id, run_id, max(unit_idx) AS last_idx, arg_max(pause_ds, unit_idx) AS last_pause, arg_max(end_ds, unit_idx) AS last_end FROM fr WHERE NOT front GROUP BY 1, 2),
tl AS (SELECT fr.rec_id, fr.run_id, max(unit_idx) AS tail FROM fr JOIN lu USING (rec_id, run_id) WHERE pause_ds >= 2 AND NOT front AND unit_idx < last_idx GROUP BY 1, 2),
ts AS (SELECT fr.rec_id, fr.run_id, any_value(tail) AS tail, min(start_ds) AS tail_start FROM fr JOIN tl USING (rec_id, run_id) WHERE unit_idx > tail GROUP BY 1, 2),
bk AS (SELECT fr.*, coalesce(stays AND last_pause < 2 AND last_end - tail_start <= 15 AND unit_idx > tail AND NOT front, FALSE) AS back FROM fr LEFT JOIN lu USING (rec_id, run_id) LEFT JOIN ts USING (rec_id, run_id))"""
)


@on_segments(
    "trim_runs",
    _TRIMMED
    + """ SELECT rec_id, run_id::BIGINT AS run_id, count(*) AS n FROM bk WHERE NOT front AND NOT back GROUP BY 1, 2 UNION ALL SELECT rec_id, -1, count(*) FROM (SELECT DISTINCT rec_id, run_id, front FROM bk WHERE front OR back) GROUP BY 1""",
)
def _(seg):
    runs, _ = CL.speech_runs(CL.word_edges(_units(seg)), X.excludes(seg))
    kept, dropped = CL.trim_runs(runs)
    return kept.groupBy("rec_id", "run_id").agg(F.count("*").alias("n")).unionByName(dropped.groupBy("rec_id").agg(F.count("*").alias("n")).withColumn("run_id", F.lit(-1).cast("long")))


# Dynamic programming by recursion: a step adds the cheapest way to end a clip at the next word of every run.
_CUTS = """, li AS (SELECT rec_id, run_id, list(start_ds ORDER BY unit_idx) AS lo, list(end_ds ORDER BY unit_idx) AS hi, list(pause_ds ORDER BY unit_idx) AS pa, list(regexp_matches(text, '(۔|؟|!|\\?|\\.|۔»)$') ORDER BY unit_idx) AS st FROM {0} GROUP BY 1, 2),
dp AS (WITH RECURSIVE d(rec_id, run_id, k, best, back) USING KEY (rec_id, run_id) AS (SELECT rec_id, run_id, 0, [0.0::DOUBLE], []::BIGINT[] FROM li UNION
  SELECT rec_id, run_id, k + 1, list_append(best, m.c), list_append(back, -m.n) FROM (SELECT rec_id, run_id, k, best, back, list_min(list_transform(list_filter(generate_series(greatest(1, k - 79), k + 1), lambda i: i = k + 1 OR hi[k + 1] - lo[i] <= 300), lambda i: {{
    'c': ((CASE WHEN hi[k + 1] - lo[i] < 10 THEN 60 WHEN hi[k + 1] - lo[i] < 20 THEN 25 + (2 - (hi[k + 1] - lo[i])::DOUBLE / 10) * 10 WHEN hi[k + 1] - lo[i] < 50 THEN (5 - (hi[k + 1] - lo[i])::DOUBLE / 10) * 0.8::DOUBLE WHEN hi[k + 1] - lo[i] <= 100 THEN 0 WHEN hi[k + 1] - lo[i] <= 150 THEN ((hi[k + 1] - lo[i])::DOUBLE / 10 - 10) * 0.6::DOUBLE ELSE 100 + ((hi[k + 1] - lo[i])::DOUBLE / 10 - 15) * 10 END)::DOUBLE
      + (CASE WHEN k + 1 = len(lo) THEN 0 WHEN pa[k + 1] >= 3 THEN CASE WHEN st[k + 1] THEN 0 ELSE 1 END WHEN pa[k + 1] >= 2 THEN CASE WHEN st[k + 1] THEN 2 ELSE 3 END WHEN pa[k + 1] >= 1 THEN CASE WHEN st[k + 1] THEN 6 ELSE 8 END ELSE 25 END)::DOUBLE) + best[i], 'n': -i}})) AS m FROM d JOIN li USING (rec_id, run_id) WHERE k < len(lo))) SELECT * FROM d),
wk AS (WITH RECURSIVE v AS (SELECT rec_id, run_id, back, back[k] AS i, k::BIGINT AS j FROM dp UNION ALL SELECT rec_id, run_id, back, back[i - 1], i - 1 FROM v WHERE i > 1) SELECT rec_id, run_id, i, j FROM v),
cu AS (SELECT *, row_number() OVER (PARTITION BY rec_id, run_id ORDER BY i) - 1 AS cut FROM wk)"""


@on_segments("best_cuts", _RUNS + _CUTS.format("q WHERE NOT barrier") + " SELECT rec_id, run_id::BIGINT AS run_id, cut, j - i + 1 AS n FROM cu")
def _(seg):
    runs, _ = CL.speech_runs(CL.word_edges(_units(seg)), X.excludes(seg))
    return CL.cut_runs(runs).groupBy("rec_id", "run_id", F.col("cut").cast("long").alias("cut")).agg(F.count("*").alias("n"))


@on_segments("clip_stats", X.WORDS + " SELECT rec_id, seg_idx, string_agg(word, ' ' ORDER BY word_idx) AS text, sum((rec_id + 13*seg_idx + 7*word_idx) % 100)::BIGINT AS cents, FALSE AS recovered FROM w GROUP BY 1, 2")
def _(seg):
    at = X.words(seg).select("rec_id", "seg_idx", "word_idx", F.col("word").alias("text"), "prob", F.lit(-0.5).alias("logprob"), F.lit("word").alias("kind"))
    # the operator rounds its mean to three decimals; the sum of hundredths can be held against SQL
    cents = at.groupBy("rec_id", "seg_idx").agg(F.sum(F.round(F.col("prob") * 100).cast("long")).alias("cents"))
    return CL.clip_stats(at, ["rec_id", "seg_idx"], "word_idx").drop("prob", "logprob").join(cents, ["rec_id", "seg_idx"])


def _as_clips(seg: DataFrame) -> DataFrame:
    at = F.when(F.col("seg_idx") % 13 == 0, F.array(F.lit("end"))).otherwise(F.array().cast("array<string>"))
    return seg.select("rec_id", F.col("seg_idx").alias("clip_idx"), "start", "end", "text", ((F.col("rec_id") + F.col("seg_idx")) % 10 / 10).alias("prob"), F.lit(-0.1).alias("logprob"), (F.col("seg_idx") % 7 == 0).alias("recovered"), at.alias("tight"))


@on_segments("split_eligible", " SELECT rec_id, seg_idx AS clip_idx, CASE WHEN end_ds - start_ds < 10 OR end_ds - start_ds > 200 THEN printf('%.1f', ((end_ds - start_ds) / 10.0)::DOUBLE) || 's is outside 1-20 s' END AS reason FROM s")
def _(seg):
    good, bad = CL.split_eligible(_as_clips(seg))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).select("rec_id", "clip_idx", F.replace("reason", F.lit(","), F.lit("")).alias("reason"))


@on_segments("median_rate", " SELECT rec_id, round(median(length(replace(text, ' ', '')) / (n_words * 4 / 10.0)), 4) AS median FROM s GROUP BY 1")
def _(seg):
    clips = _as_clips(seg).withColumn("start", F.lit(0.0)).withColumn("end", T.word_count(F.col("text")) * 4 / 10.0)
    return CL.median_rate(clips).select("rec_id", F.round("median", 4).alias("median"))


@on_segments(
    "review_reasons",
    r""", t AS (SELECT *, CASE WHEN seg_idx % 5 = 1 THEN translate(text, 'abcdefghij', 'ايكةهأإىۃۓ') WHEN seg_idx % 5 = 2 THEN text || ' नमस्ते' WHEN seg_idx % 5 = 3 THEN text || ' ab cd ab cd ab cd' ELSE text END AS t, (end_ds - start_ds)::DOUBLE / 10 AS d FROM s),
r AS (SELECT *, length(replace(t, ' ', '')) / d AS rate FROM t), m AS (SELECT rec_id, median(rate) AS typical FROM r GROUP BY 1)
SELECT rec_id, seg_idx AS clip_idx, (rec_id + seg_idx) % 10 < 6 AS unsure, regexp_matches(t, '[A-Za-z]') AS latin, regexp_matches(t, '[\x{0900}-\x{097F}]') AS devanagari, regexp_matches(t, '[\x{0629}\x{064A}\x{0643}\x{0649}\x{0625}\x{0623}]') AS arabic,
 rate < typical * 0.5 OR rate > typical * 1.8 AS rate, end_ds - start_ds < 18 OR end_ds - start_ds > 152 AS length, seg_idx % 7 = 0 AS recovered, seg_idx % 13 = 0 AS tight, seg_idx % 5 = 3 OR len(list_filter(generate_series(1, len(string_split(t, ' ')) - 2), lambda i: string_split(t, ' ')[i] = string_split(t, ' ')[i + 1] AND string_split(t, ' ')[i] = string_split(t, ' ')[i + 2])) > 0
  OR len(list_filter(generate_series(1, len(string_split(t, ' ')) - 5), lambda i: string_split(t, ' ')[i:i+1] = string_split(t, ' ')[i+2:i+3] AND string_split(t, ' ')[i:i+1] = string_split(t, ' ')[i+4:i+5])) > 0
  OR len(list_filter(generate_series(1, len(string_split(t, ' ')) - 8), lambda i: string_split(t, ' ')[i:i+2] = string_split(t, ' ')[i+3:i+5] AND string_split(t, ' ')[i:i+2] = string_split(t, ' ')[i+6:i+8])) > 0
  OR len(list_filter(generate_series(1, len(string_split(t, ' ')) - 11), lambda i: string_split(t, ' ')[i:i+3] = string_split(t, ' ')[i+4:i+7] AND string_split(t, ' ')[i:i+3] = string_split(t, ' ')[i+8:i+11])) > 0 AS repeated
FROM r JOIN m USING (rec_id)""",
)
def _(seg):
    kind, text = F.col("clip_idx") % 5, F.col("text")
    mixed = F.when(kind == 1, F.translate(text, "abcdefghij", "ايكةهأإىۃۓ")).when(kind == 2, F.concat(text, F.lit(" नमस्ते"))).when(kind == 3, F.concat(text, F.lit(" ab cd ab cd ab cd"))).otherwise(text)
    out = CL.review_reasons(_as_clips(seg).withColumn("text", mixed))
    has = lambda start: F.exists("review", lambda r: r.startswith(start))
    starts = {"unsure": "unsure", "latin": "has Latin", "devanagari": "has Devanagari", "arabic": "has letters of Arabic", "rate": "odd rate", "repeated": "says three", "length": "odd length", "recovered": "recovered", "tight": "hardly"}
    return out.select("rec_id", "clip_idx", *(has(v).alias(k) for k, v in starts.items()))


def _built(seg: DataFrame) -> tuple[DataFrame, DataFrame]:
    spoken = X.with_words(seg).withColumn("language", F.when(F.col("seg_idx") % 9 == 4, "ar").otherwise("ur"))
    return CL.build_clips(spoken, X.recordings(seg), X.excludes(seg))


# Clips with the pauses beside them, ``ck``: hundredths of seconds.
_BUILT = (
    _TRIMMED
    + _CUTS.format("bk WHERE NOT front AND NOT back")
    + """, ix AS (SELECT bk.*, before, row_number() OVER (PARTITION BY bk.rec_id, bk.run_id ORDER BY unit_idx) AS kx FROM bk JOIN (SELECT rec_id, unit_idx, before FROM t0) USING (rec_id, unit_idx) WHERE NOT front AND NOT back),
cl AS (SELECT cu.rec_id, cu.run_id, cut, arg_min(unit_idx, kx) = 0 AS begins, 10 * arg_min(start_ds, kx) AS a, arg_min(before, kx) AS before, 10 * arg_max(end_ds, kx) AS z, arg_max(pause_ds, kx) AS pause, string_agg(text, ' ' ORDER BY kx) AS text FROM cu JOIN ix ON ix.rec_id = cu.rec_id AND ix.run_id = cu.run_id AND kx BETWEEN i AND j GROUP BY 1, 2, 3),
tt AS (SELECT rec_id, 10 * max(end_ds) AS total FROM s GROUP BY 1), cp AS (SELECT rec_id, greatest(0, a - CASE WHEN begins THEN 5 ELSE least(5, 5 * before) END) AS a, least(total, z + least(5, 5 * pause)) AS z, text, NOT begins AND before = 0 AS tight_start, pause = 0 AS tight_end FROM cl JOIN tt USING (rec_id)),
ck AS (SELECT rec_id, coalesce((SELECT max(10 * hi) FROM ex WHERE ex.rec_id = cp.rec_id AND 10 * lo < a AND a < 10 * hi), a) AS a, coalesce((SELECT min(10 * lo) FROM ex WHERE ex.rec_id = cp.rec_id AND 10 * lo < z AND z < 10 * hi), z) AS z, text, tight_start, tight_end FROM cp)"""
)


@on_segments("build_clips", _BUILT + " SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY a, z, text) - 1 AS clip_idx, (10 * a)::BIGINT AS start_ms, (10 * z)::BIGINT AS end_ms, text, tight_start, tight_end FROM ck WHERE z - a >= 100")
def _(seg):
    out = _built(seg)[0]
    has = lambda side: F.array_contains("tight", side).alias(f"tight_{side}")
    return out.select("rec_id", F.col("clip_idx").cast("long").alias("clip_idx"), K.millis(F.col("start")).alias("start_ms"), K.millis(F.col("end")).alias("end_ms"), "text", has("start"), has("end"))


# What is left out, with its kind: hundredths of seconds.
_LEFT_OUT = (
    _BUILT
    + """, lf AS (SELECT rec_id, a, z, 'short' AS kind, text FROM ck WHERE z - a < 100
UNION ALL SELECT rec_id, 10 * start_ds, 10 * end_ds, CASE WHEN kind = 'arabic' THEN 'arabic' ELSE 'excluded' END, trim(text) FROM z WHERE barrier
UNION ALL SELECT rec_id, 10 * arg_min(start_ds, unit_idx), 10 * arg_max(end_ds, unit_idx), 'trimmed', string_agg(trim(text), ' ' ORDER BY unit_idx) FROM bk WHERE front OR back GROUP BY rec_id, run_id, front)"""
)


@on_segments("left_out", _LEFT_OUT + " SELECT rec_id, (10 * a)::BIGINT AS start_ms, (10 * z)::BIGINT AS end_ms, kind, text FROM lf")
def _(seg):
    names = {CL.LEFT_ARABIC: "arabic", CL.LEFT_EXCLUDED: "excluded", CL.LEFT_TRIMMED: "trimmed"}
    kind = F.when(F.col("reason").startswith("too short"), "short")
    for reason, name in names.items():
        kind = kind.when(F.col("reason") == reason, name)
    return _built(seg)[1].select("rec_id", K.millis(F.col("start")).alias("start_ms"), K.millis(F.col("end")).alias("end_ms"), kind.alias("kind"), "text")


@on_segments(
    "clip_totals",
    _LEFT_OUT
    + """, ct AS (SELECT rec_id, count(*) AS clips, sum((10 * (z - a))::BIGINT)::BIGINT AS ms, count(*) FILTER (WHERE tight_start OR tight_end) AS flagged FROM ck WHERE z - a >= 100 GROUP BY 1), lc AS (SELECT rec_id, count(*) AS left_out FROM lf GROUP BY 1)
SELECT rec_id, coalesce(clips, 0) AS clips, coalesce(ms, 0)::BIGINT AS ms, coalesce(flagged, 0) AS flagged, coalesce(left_out, 0) AS left_out FROM ct FULL JOIN lc USING (rec_id)""",
)
def _(seg):
    """The summary with the tight ends alone to check."""
    clips, left = _built(seg)
    out = CL.clip_summary(clips.withColumn("review", F.col("tight")), left)
    return out.select("rec_id", "clips", F.round(F.col("minutes") * 60000).cast("long").alias("ms"), "flagged", "left_out")


@on_segments("clip_summary")
def _(seg):
    return J.make_clips(X.with_words(seg), X.recordings(seg), X.excludes(seg))[2]


# scalar functions


@query("normalize", X.ARABIC + f" SELECT rec_id, {_NORM.format('text')} AS text FROM a")
def _(spark, d):
    return X.arabic_text(spark, d).select("rec_id", T.normalize(F.col("text")).alias("text"))


@on_segments("tokens", r""" SELECT rec_id, seg_idx, array_to_string(list_filter(string_split(regexp_replace(text, '[،۔؟؛٫!?.,:;"''«»()\[\]{}—–\-…]', ' ', 'g'), ' '), lambda x: x <> ''), ' ') AS tokens FROM s""")
def _(seg):
    return seg.select("rec_id", "seg_idx", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@on_segments("apply_corrections", PLAIN + f" SELECT rec_id, seg_idx, {_ruled('text')} AS text FROM pl")
def _(seg):
    return plain(seg).select("rec_id", "seg_idx", T.apply_corrections(F.col("text"), RULES).alias("text"))


@on_segments("apply_many_rules", PLAIN + f" SELECT rec_id, seg_idx, {_ruled('text')} AS text FROM pl")
def _(seg):
    return plain(seg).select("rec_id", "seg_idx", H.apply_many_rules(RULES)("text").alias("text"))


@on_segments("join_broken_words", r", q AS (SELECT rec_id, seg_idx, list_filter(string_split(text, ' '), lambda x: length(x) >= 4 AND regexp_matches(x, '^[a-z]+$')) AS ws FROM s) SELECT rec_id, seg_idx, array_to_string(ws, ' ') AS text FROM q WHERE len(ws) > 0")
def _(seg):
    words = F.filter(F.split("text", " "), lambda w: (F.length(w) >= 4) & w.rlike("^[a-z]+$"))
    at = seg.select("rec_id", "seg_idx", words.alias("w")).where("size(w) > 0")
    # the first word whole, every other one cut into single letters after its first three: they come together again
    return at.select("rec_id", "seg_idx", F.array_join(F.transform("w", lambda x: T.join_broken_words(F.when(F.length(x) > 4, F.concat(F.substring(x, 1, 3), F.regexp_replace(F.substring(x, 4, 1000), "(.)", " $1"))).otherwise(x))), " ").alias("text"))


@on_segments("speaking_rates", " SELECT rec_id, seg_idx, n_words, round(n_words / ((end_ds - start_ds) / 10.0), 4) AS density, round(length(replace(text, ' ', '')) / ((end_ds - start_ds) / 10.0), 4) AS rate FROM s")
def _(seg):
    d = (F.col("end_ds") - F.col("start_ds")) / 10
    return seg.select("rec_id", "seg_idx", T.word_count(F.col("text")).cast("long").alias("n_words"), F.round(T.density(F.col("text"), d), 4).alias("density"), F.round(T.speaking_rate(F.col("text"), d), 4).alias("rate"))


@on_segments(
    "costs",
    """, q AS (SELECT rec_id, seg_idx, (end_ds - start_ds) / 10.0 AS d, (seg_idx % 40) / 100.0 AS p, seg_idx % 2 = 0 AS e FROM s)
SELECT rec_id, seg_idx, round(CASE WHEN d < 1 THEN 60 WHEN d < 2 THEN 25 + 10 * (2 - d) WHEN d < 5 THEN 0.8 * (5 - d) WHEN d <= 10 THEN 0 WHEN d <= 15 THEN 0.6 * (d - 10) ELSE 100 + 10 * (d - 15) END::DOUBLE, 4) AS clip,
 (CASE WHEN p >= 0.3 THEN CASE WHEN e THEN 0 ELSE 1 END WHEN p >= 0.15 THEN CASE WHEN e THEN 2 ELSE 3 END WHEN p >= 0.05 THEN CASE WHEN e THEN 6 ELSE 8 END ELSE 25 END)::DOUBLE AS cut FROM q""",
)
def _(seg):
    d = (F.col("end_ds") - F.col("start_ds")) / 10
    return seg.select("rec_id", "seg_idx", F.round(costs.clip_cost(d), 4).alias("clip"), costs.cut_cost(F.col("seg_idx") % 40 / 100, F.col("seg_idx") % 2 == 0).alias("cut"))


@on_segments(
    "repeated_phrase",
    """, q AS (SELECT rec_id, seg_idx, string_split(text, ' ') AS w FROM s), r AS (SELECT rec_id, seg_idx, w, unnest([1, 2, 3, 4]) AS n FROM q),
h AS (SELECT rec_id, seg_idx, n, w, list_filter(generate_series(1, len(w) - 3*n + 1), lambda i: w[i:i+n-1] = w[i+n:i+2*n-1] AND w[i:i+n-1] = w[i+2*n:i+3*n-1]) AS ix FROM r WHERE len(w) >= 3*n)
SELECT rec_id, seg_idx, arg_min(array_to_string(list_slice(w, ix[1], ix[1]+n-1), ' '), n) AS phrase FROM h WHERE len(ix) > 0 GROUP BY 1, 2""",
)
def _(seg):
    return seg.select("rec_id", "seg_idx", T.repeated_phrase(F.col("text")).alias("phrase")).where("phrase is not null")


_NAME = r"coalesce(nullif(regexp_replace(regexp_replace({0}, '[^\p{{L}}\p{{N}}_-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'clip')"


@on_segments("clip_file", f" SELECT rec_id, seg_idx, {_NAME.format('substr(text, 1, 20)')} || '_' || CASE WHEN seg_idx < 10000 THEN lpad(seg_idx::VARCHAR, 4, '0') ELSE seg_idx::VARCHAR END || '.wav' AS file FROM s")
def _(seg):
    return seg.select("rec_id", "seg_idx", T.clip_file(T.safe_name(F.substring("text", 1, 20)), F.col("seg_idx")).alias("file"))


# sources, sinks, state


def _delete(spark: SparkSession, path: str) -> None:
    """At the end of the driver's Python, if its JVM is still there."""
    with suppress(Py4JError, OSError):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; it goes when the driver's Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    path = f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _write_files(spark: SparkSession, seg: DataFrame) -> str:
    """Saved-segments files, one for each recording, as the recognizer leaves them."""
    path = _folder(spark)
    w = F.transform("words", lambda x: F.array(x["start"].cast("string"), x["end"].cast("string"), x["word"], x["prob"].cast("string")))
    rows = X.with_words(seg).withColumn("words", w).groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("seg_idx", F.struct("start", "end", F.col("text"), "language", "avg_logprob", "words").alias("s")))).alias("x"))
    files = rows.select(F.struct(F.col("rec_id").cast("string").alias("source"), F.lit("m").alias("model"), F.array_max(F.transform("x", lambda x: x["s"]["end"])).alias("duration_seconds"), F.transform("x", lambda x: x["s"]).alias("segments")).alias("o"))
    files.select("o.*").write.option("maxRecordsPerFile", 1).json(path)
    return path


@query("read_segments", X.SEGMENTS + " SELECT rec_id, seg_idx, start_ds, end_ds, text, n_words FROM s")
def _(spark, d):
    _, out = RD.read_segments(spark, _write_files(spark, X.segments(spark, d)), "source")  # Spark names the files
    return out.select(F.col("source").cast("long").alias("rec_id"), F.col("seg_idx").cast("long").alias("seg_idx"), ds("start").alias("start_ds"), ds("end").alias("end_ds"), "text", F.size("words").cast("long").alias("n_words"))


@query("stream_corrected", X.SEGMENTS + PLAIN + f", m AS (SELECT rec_id, max(end_ds) AS total FROM pl GROUP BY 1) SELECT rec_id, start_ds, {_ruled('text')} AS text FROM pl JOIN m USING (rec_id) WHERE start_ds < total - 5")
def _(spark, d):
    source, folder = _write_files(spark, plain(X.segments(spark, d))), _folder(spark)
    for _ in range(2):  # the second run finds nothing new
        stream_corrected(spark, source, f"{folder}/out", f"{folder}/state", RULES).awaitTermination()
    recordings, _ = RD.read_segments(spark, source)
    out = spark.read.schema("rec_id string, start double, text string").parquet(f"{folder}/out")
    return out.join(recordings.select("rec_id", F.col("source").cast("long").alias("doc")), "rec_id").select(F.col("doc").alias("rec_id"), ds("start").alias("start_ds"), "text")


@on_segments("write_segments", " SELECT rec_id, seg_idx, start_ds, end_ds, text, language FROM s")
def _(seg):
    path = _folder(seg.sparkSession)
    WR.write_segments(seg.limit(0), path)
    WR.write_segments(seg, path)  # replaces what was there
    return seg.sparkSession.read.schema(seg.schema).parquet(path).select("rec_id", "seg_idx", "start_ds", "end_ds", "text", "language")


@on_segments("read_broken", " SELECT rec_id, CASE WHEN rec_id % 3 = 0 THEN 'no whole JSON object' ELSE 'no segments' END AS reason FROM s WHERE rec_id % 3 < 2 GROUP BY 1 UNION ALL SELECT DISTINCT rec_id, 'fine' FROM s WHERE rec_id % 3 = 2")
def _(seg):
    """Of three files one is cut off in the middle and one has no list of segments."""
    spark, path = seg.sparkSession, _folder(seg.sparkSession)
    rows = seg.groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("seg_idx", "start", "end", "text"))).alias("segments"))
    whole = F.to_json(F.struct(F.col("rec_id").cast("string").alias("source"), F.when(F.col("rec_id") % 3 != 1, F.col("segments")).alias("segments")))
    cut_off = F.when(F.col("rec_id") % 3 == 0, F.substring(whole, F.lit(1), F.length(whole) - 5)).otherwise(whole)
    rows.select(cut_off.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    odd = RD.read_broken(spark, path)
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r'"source":"(\d+)"', 1).cast("long").alias("doc"), F.col("_metadata.file_path").alias("file"))
    fine = RD.read_segments(spark, path)[1].join(seg.select(F.col("rec_id").alias("doc"), "seg_idx", "text"), ["seg_idx", "text"]).select("doc").where("doc % 3 = 2").distinct()
    named = odd.join(files, "file").select(F.col("doc").alias("rec_id"), "reason")
    return named.unionByName(fine.select(F.col("doc").alias("rec_id"), F.lit("fine").alias("reason")))


@on_segments("bucketed_paragraphs", ORACLES["paragraphs_by_length"].removeprefix(X.SEGMENTS))
def _(seg):
    """Paragraphs of a table written by buckets of recordings, read without an exchange."""
    path = _folder(seg.sparkSession)
    name = "segments_" + path.rsplit("-", 1)[-1]
    WR.write_bucketed(plain(seg), name, 8, path)
    out = PA.paragraphs(seg.sparkSession.table(name))
    return out.select("rec_id", F.col("par_idx").cast("int").alias("par_idx"), T.word_count(F.col("text")).cast("long").alias("n_words"))


@on_segments("read_transcript_lines", " SELECT sum(1 + (seg_idx % 5 = 0)::INT)::BIGINT AS lines, sum(length(text))::BIGINT AS letters, count(*) FILTER (WHERE seg_idx % 5 = 0) AS headings FROM s GROUP BY rec_id")
def _(seg):
    path = _folder(seg.sparkSession)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\r\n")
    X.lines(seg).groupBy("rec_id").agg(F.concat(F.lit("\ufeff"), text).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    lines = RD.read_transcript_lines(seg.sparkSession, path)
    heading = K.heading_seconds(F.col("line")).isNotNull() & F.col("line").rlike("^[0-9:]+$")
    return lines.groupBy("rec_id").agg(F.count("*").alias("lines"), F.sum(F.when(~heading, F.length("line")).otherwise(0)).alias("letters"), F.count_if(heading).alias("headings")).drop("rec_id")


@on_segments("read_word_list", " SELECT DISTINCT split_part(text, ' ', 1) AS word FROM s WHERE NOT starts_with(text, '#')")
def _(seg):
    path = _folder(seg.sparkSession)
    first = F.substring_index("text", " ", 1)
    line = F.when(first.startswith("#"), first).otherwise(F.concat(F.lit(" "), first, F.lit("\t")))
    seg.select(F.explode(F.array(line, F.lit("# a note"), F.lit(" "))).alias("value")).write.text(path)
    return RD.read_word_list(seg.sparkSession, path)


@on_segments("learn_summary", X.SECTIONS + _RULES + " SELECT 'sections' AS what, count(*) AS n FROM c5 UNION ALL SELECT 'used', count(*) FROM c5 WHERE regexp_matches(text, '[^،۔؟؛٫!?.,:;\"''«»()\\[\\]{}—–\\-… ]') UNION ALL SELECT 'rules', count(*) FROM rl")
def _(seg):
    sections = X.sections(seg)
    return J.learn_summary(sections, SE.section_pairs(sections, seg), _rules(seg))


@on_segments(
    "export_clips",
    f""", z AS (SELECT rec_id, greatest(floor(max(end_ds) * {X.SOUND_RATE} / 10) - 2 * {X.SOUND_RATE}, 1)::BIGINT AS samples FROM s GROUP BY 1),
t AS (SELECT s.rec_id, seg_idx, text, floor(start_ds * {X.SOUND_RATE} / 10)::BIGINT AS a, floor(end_ds * {X.SOUND_RATE} / 10)::BIGINT AS b, samples FROM s JOIN z USING (rec_id) WHERE end_ds - start_ds BETWEEN 10 AND 200),
k AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY seg_idx) AS n FROM t WHERE least(b, samples) - a >= 0.9 * (b - a) AND least(b, samples) > a)
SELECT 'talk' || rec_id || '_' || lpad(n::VARCHAR, 4, '0') || '.wav' AS file_name, text, 44 + 2 * (least(b, samples) - a) AS bytes FROM k""",
)
def _(seg):
    items = _as_clips(seg).select("rec_id", F.col("clip_idx").alias("item_idx"), "start", "end", "text")
    names = seg.select("rec_id").distinct().select("rec_id", F.concat(F.lit("talk"), "rec_id").alias("name"))
    old = names.select(F.concat("name", F.lit("_0001.wav")).alias("file_name"), F.lit("old").alias("text"))
    metadata, files, _ = J.export_clips(items, X.sound(seg, WR.CHUNK), names, old, overwrite=True, rate=X.SOUND_RATE)
    return metadata.join(files, "file_name").select("file_name", "text", F.octet_length("wav").cast("long").alias("bytes"))


@on_segments("parse_corrections", _RULES + ' SELECT wrong, "right", \'# \' || n AS note FROM rl')
def _(seg):
    made = _rules(seg)
    lines = made.select(F.lit(0).alias("file_idx"), F.xxhash64("wrong").alias("line_no"), F.concat_ws("\t", F.concat(F.lit(" "), "wrong"), F.concat("right", F.lit(" ")), F.concat(F.lit("# "), "count")).alias("line"))
    bad = made.select(F.lit(1).alias("file_idx"), F.xxhash64("wrong").alias("line_no"), F.concat(F.lit("# "), "wrong").alias("line"))
    return RD.parse_corrections(lines.unionByName(bad))[0].drop("priority")


@on_segments("parse_exclude", X.EXCLUDES + " SELECT rec_id, lo AS start_ds, CASE WHEN hi = 'infinity'::DOUBLE THEN -1 ELSE hi::BIGINT END AS end_ds FROM ex")
def _(seg):
    at = X.excludes(seg)
    line = F.concat(K.clock(F.col("start")), F.lit(" – "), F.when(F.col("end") < 1e9, K.clock(F.col("end"))).otherwise("END"), F.lit(" (noise) # check"))
    lines = at.select("rec_id", F.col("start").cast("int").alias("line_no"), line.alias("line"))
    return RD.parse_exclude(lines)[0].select("rec_id", ds("start").alias("start_ds"), F.when(F.col("end") < 1e9, ds("end")).otherwise(-1).alias("end_ds"))


@on_segments("srt_round_trip", " SELECT rec_id, seg_idx AS item_idx, start_ds, end_ds, text FROM s")
def _(seg):
    out = RD.parse_srt(WR.render_srt(_as_clips(seg)))
    return out.select("rec_id", F.col("item_idx").cast("long").alias("item_idx"), ds("start").alias("start_ds"), ds("end").alias("end_ds"), "text")


@on_segments("clip_tsv_round_trip", " SELECT rec_id, seg_idx AS item_idx, start_ds, end_ds, text FROM s")
def _(seg):
    lines = WR.render_clip_tsv(_as_clips(seg)).select("rec_id", F.col("clip_idx").alias("line_no"), "line")
    return RD.parse_clip_tsv(lines).select("rec_id", F.col("item_idx").cast("long").alias("item_idx"), ds("start").alias("start_ds"), ds("end").alias("end_ds"), "text")


@on_segments("render_review")
def _(seg):
    clips, left, summary = J.make_clips(X.with_words(seg), X.recordings(seg), X.excludes(seg))
    named = X.recordings(seg).select("rec_id", F.concat(F.lit("/talks/"), "rec_id", F.lit(".mp3")).alias("source"))
    return WR.render_review(clips, left, summary, named)


@on_segments(
    "merge_metadata",
    """, q AS (SELECT rec_id, seg_idx, text, row_number() OVER (PARTITION BY rec_id ORDER BY seg_idx) AS n FROM s WHERE end_ds - start_ds BETWEEN 10 AND 200)
SELECT 'talk' || rec_id || '_' || lpad(n::VARCHAR, 4, '0') || '.wav|' || text AS value FROM q UNION ALL SELECT 'talk' || rec_id || '_0001.wav|old' FROM s WHERE seg_idx = 0 AND NOT EXISTS (SELECT 1 FROM q WHERE q.rec_id = s.rec_id)""",
)
def _(seg):
    name = F.concat(F.lit("talk"), "rec_id")
    clips = CL.split_eligible(_as_clips(seg))[0].select(name.alias("name"), "clip_idx", "text")
    old = seg.where("seg_idx = 0").select(F.concat(name, F.lit("_0001.wav")).alias("file_name"), F.lit("old").alias("text"))
    return WR.metadata_line(WR.merge_metadata(old, clips, overwrite=True))


@query("cut_clips", "WITH f AS (SELECT label AS rec_id, count(*) * 64 AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1) SELECT rec_id, 44 + 2 * (n // 2) AS bytes FROM f")
def _(spark, d):
    e = X.frames(spark, d)
    n = 64
    per = WR.CHUNK // n
    whole = e.select("rec_id", F.floor(F.col("frame_idx") / per).alias("chunk_idx"), "frame_idx", F.transform("samples", lambda x: (x * 3000).cast("short")).alias("s"))
    pcm = whole.groupBy("rec_id", "chunk_idx").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("frame_idx", "s"))), lambda x: x["s"])).alias("samples"))
    clips = e.groupBy("rec_id").agg(F.count("*").alias("k")).select("rec_id", F.lit(0).alias("clip_idx"), F.lit(0.0).alias("start"), (F.expr("k * 64 div 2") / WR.RATE).alias("end"))
    return WR.cut_clips(pcm, clips).select("rec_id", F.octet_length("wav").cast("long").alias("bytes"))


@on_segments(
    "cut_parts",
    f""", z AS (SELECT rec_id, greatest(floor(max(end_ds) * {X.SOUND_RATE} / 10) - 2 * {X.SOUND_RATE}, 1)::BIGINT AS samples, max(end_ds) AS total FROM s GROUP BY 1),
cc AS (SELECT rec_id, samples, 3 * {X.SOUND_RATE} AS a, floor(total * {X.SOUND_RATE} / 10)::BIGINT AS b FROM z WHERE total > 30), kk AS (SELECT * FROM cc WHERE samples > a AND samples - a >= 0.9 * (b - a)),
pp AS (SELECT rec_id, i // 1000 AS part, string_agg(printf('%02X%02X', v & 255, (v >> 8) & 255), '' ORDER BY i) AS x FROM (SELECT rec_id, i, ((rec_id * 7 + i * 13) % 2001 - 1000 + 65536) % 65536 AS v FROM (SELECT rec_id, unnest(generate_series(a, samples - 1)) AS i FROM kk)) GROUP BY 1, 2)
SELECT rec_id, (part - min(part) OVER (PARTITION BY rec_id))::INT AS part_idx, md5(unhex(x)) AS content FROM pp""",
)
def _(seg):
    """Each recording from its third second on as one clip, in parts of 1000 samples."""
    clips = X.recordings(seg).where("total > 3").select("rec_id", F.lit(0).alias("clip_idx"), F.lit(3.0).alias("start"), F.col("total").alias("end"))
    parts = WR.cut_parts(X.sound(seg, 1000), clips, X.SOUND_RATE, 1000)
    samples = F.when(F.col("part_idx") == 0, F.expr("substring(data, 45, 1 << 30)")).otherwise(F.col("data"))
    return parts.select("rec_id", "part_idx", F.md5(samples).alias("content"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    part = F.when(F.col("doc_id") % 5 == 0, "10:00")
    return docs.select(F.col("doc_id").alias("rec_id"), F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), F.expr("doc_id div 2").cast("string"), F.lit(".v1.mp3")).alias("source"), part.alias("start"), F.lit(None).cast("string").alias("duration"))


@query(
    "pending",
    """WITH r AS (SELECT doc_id, '/in/' || source || '/' || (doc_id // 2) || '.v1.mp3' AS src, (doc_id // 2) || '.v1' || CASE WHEN doc_id % 5 = 0 THEN '_section' ELSE '' END AS name FROM documents),
f AS (SELECT name, min(src) AS source FROM r GROUP BY 1) SELECT name, source FROM f WHERE name NOT IN (SELECT (doc_id // 2) || '.v1' FROM documents WHERE doc_id % 3 = 0)""",
)
def _(spark, d):
    done = spark.read.parquet(f"{d}/documents.parquet").where("doc_id % 3 = 0").select(F.concat(F.expr("doc_id div 2").cast("string"), F.lit(".v1")).alias("name"))
    return PE.pending(_sources(spark, d), done).select("name", "source")


@on_segments(
    "resume_points",
    """, m AS (SELECT rec_id, max(end_ds) AS total FROM s GROUP BY 1), k AS (SELECT rec_id, max(end_ds) AS off FROM s WHERE seg_idx % 3 <> 2 AND rec_id % 4 <> 1 GROUP BY 1)
SELECT rec_id, coalesce(off, 0)::BIGINT AS offset_ds, total - coalesce(off, 0) < 10 AS done FROM m LEFT JOIN k USING (rec_id)""",
)
def _(seg):
    # recordings of which rec_id % 4 = 1 were begun with another model
    setting = lambda model: F.struct(model.alias("model"), F.lit(None).cast("string").alias("prompt")).alias("settings")
    recs = X.recordings(seg).select("rec_id", "total", setting(F.lit("m")))
    saved = seg.where("seg_idx % 3 <> 2").select("rec_id", setting(F.when(F.col("rec_id") % 4 == 1, "other").otherwise("m")), "seg_idx", "end")
    return PE.resume_points(recs, saved).select("rec_id", ds("offset").alias("offset_ds"), "done")
