"""The registered queries and, for each that SQL can express, DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codepoints, evidence, markers, reports, style
from ..operators import evaluation, ngrams
from ..sources import tables, web

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = tables.read_table(spark, sf_dir, name)
    return tables.spread(df) if name in ("documents", "pages", "conversations") else df


# The tables hold no carrier and no style phrase, so queries about them put some in, by the same SQL text in both engines.
_INJECTED = """(
  SELECT doc_id, lang, source,
         CASE WHEN doc_id % 5 = 0 THEN t6 || ' Furthermore, we delve into a myriad of ideas in order to leverage them.' ELSE t6 END AS text
  FROM (SELECT *, CASE WHEN doc_id % 29 = 0 THEN t5 || '\U0001f3f4\U000e0067\U000e0062\U000e007f' ELSE t5 END AS t6
  FROM (SELECT *, CASE WHEN doc_id % 23 = 0 THEN t4 || '\U0001f468‍\U0001f469a‍b' ELSE t4 END AS t5
  FROM (SELECT *, CASE WHEN doc_id % 19 = 0 AND instr(t3, 'a') > 0 THEN substr(t3, 1, instr(t3, 'a') - 1) || 'а' || substr(t3, instr(t3, 'a') + 1) ELSE t3 END AS t4
  FROM (SELECT *, CASE WHEN doc_id % 17 = 0 THEN '‮' || t2 ELSE t2 END AS t3
  FROM (SELECT *, CASE WHEN doc_id % 13 = 0 THEN '‪' || substr(t1, 1, 10) || '‬' || substr(t1, 11) ELSE t1 END AS t2
  FROM (SELECT *, CASE WHEN doc_id % 11 = 0 AND instr(t0, ' ') > 0 THEN substr(t0, 1, instr(t0, ' ') - 1) || ' ' || substr(t0, instr(t0, ' ') + 1) ELSE t0 END AS t1
  FROM (SELECT doc_id, lang, source, CASE WHEN doc_id % 7 = 0 THEN substr(text, 1, 5) || '​' || substr(text, 6) ELSE text END AS t0
  FROM documents)))))))) injected"""


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_INJECTED.replace('FROM documents', 'FROM {documents}')}", documents=table(spark, sf_dir, "documents"))


# Code points of the documents with a carrier, and the verdict on each, by windows: the oracle's own formulation.
_UNITS = f"""units AS (
  SELECT doc_id, source, pos, unicode(ch) AS cp
  FROM (SELECT doc_id, source, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM {_INJECTED}
        WHERE regexp_matches(text, '[^\\x00-\\x7FÀ-ÿ]'))),
near AS (
  SELECT *, lag(cp) OVER w AS prev, lead(cp) OVER w AS next,
         sum(CASE WHEN cp IN (8234, 8235, 8237, 8238) THEN 1 WHEN cp = 8236 THEN -1 ELSE 0 END) OVER w AS depth,
         last_value(CASE WHEN cp NOT BETWEEN 917536 AND 917630 THEN cp END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tag_base,
         first_value(CASE WHEN cp NOT BETWEEN 917536 AND 917630 THEN cp END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS tag_close
  FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
marked AS (
  SELECT *, cp IN (9732, 35, 42) OR cp BETWEEN 48 AND 57 OR cp BETWEEN 126976 AND 129791 AS emoji,
         (cp BETWEEN 917536 AND 917630 AND tag_base = 127988 AND tag_close = 917631) OR (cp = 917631 AND prev BETWEEN 917536 AND 917630 AND tag_base = 127988) AS flag
  FROM near),
verdicts AS (
  SELECT *, CASE
    WHEN flag THEN NULL
    WHEN cp = 8205 AND (prev BETWEEN 126976 AND 129791) AND (next BETWEEN 126976 AND 129791) THEN NULL
    WHEN cp BETWEEN 917505 AND 917631 THEN 'tag_chars'
    WHEN cp IN (8203, 8204, 8205) THEN 'zwj_family'
    WHEN cp IN (8234, 8235, 8236, 8237, 8238) THEN 'bidi'
    WHEN cp = 160 THEN 'space' END AS kind
  FROM marked)"""


@query(
    f"""WITH {_UNITS},
    per_doc AS (SELECT doc_id, count(kind) AS total, count(DISTINCT CASE WHEN kind = 'space' THEN cp END) AS informational,
                       count(DISTINCT CASE WHEN kind <> 'space' THEN cp END) AS probable FROM verdicts GROUP BY doc_id)
    SELECT source, count(*) AS documents, count(CASE WHEN total > 0 THEN 1 END) AS with_carriers, coalesce(sum(total), 0)::BIGINT AS suspicious_total,
           count(CASE WHEN probable > 0 THEN 1 END) AS actionable, coalesce(sum(probable), 0)::BIGINT AS findings_probable, coalesce(sum(informational), 0)::BIGINT AS findings_informational
    FROM documents LEFT JOIN per_doc USING (doc_id) GROUP BY source"""
)
def audit_summary_by_source(spark, sf_dir):
    x = codepoints.inspect_text(injected(spark, sf_dir)).select("source", "inspection")
    confidence = F.col("inspection.hits.confidence")
    number = lambda c: F.size(F.filter(confidence, lambda v: v == c))
    return x.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("inspection.suspicious_total") > 0).alias("with_carriers"), F.sum("inspection.suspicious_total").alias("suspicious_total"),
        F.count_if(evidence.actionable(F.lit(False), confidence)).alias("actionable"), F.sum(number("probable")).alias("findings_probable"), F.sum(number("informational")).alias("findings_informational"),
    )


@query(
    f"""WITH {_UNITS}
    SELECT doc_id, cp::INTEGER AS codepoint, kind, CASE WHEN kind = 'space' THEN 'informational' ELSE 'probable' END AS confidence, count(*) AS hits,
           array_to_string(list_slice(list(pos ORDER BY pos), 1, 10), ',') AS sample_offsets
    FROM verdicts WHERE kind IS NOT NULL GROUP BY doc_id, cp, kind"""
)
def carrier_hits(spark, sf_dir):
    x = codepoints.inspect_text(injected(spark, sf_dir)).select("doc_id", F.explode("inspection.hits").alias("h"))
    return x.select("doc_id", "h.codepoint", "h.kind", "h.confidence", F.col("h.count").alias("hits"), F.array_join(F.col("h.sample_offsets").cast("array<string>"), ",").alias("sample_offsets"))


@query("SELECT count(*) AS documents, 0::BIGINT AS suspicious FROM documents")
def carrier_control(spark, sf_dir):
    """The documents as they are hold no carrier."""
    x = codepoints.inspect_text(table(spark, sf_dir, "documents")).agg(F.count(F.lit(1)).alias("documents"), F.sum("inspection.suspicious_total").alias("suspicious"))
    return x.select("documents", "suspicious")


@query(
    f"""WITH {_UNITS},
    marks AS (SELECT doc_id, pos, cp, CASE WHEN cp = 8236 THEN depth + 1 ELSE depth END AS level FROM near WHERE cp IN (8234, 8235, 8236, 8237, 8238)),
    pairs AS (SELECT doc_id, pos, CASE WHEN cp = 8236 THEN lag(cp) OVER w IN (8234, 8235) ELSE cp IN (8234, 8235) AND lead(cp) OVER w = 8236 END AS paired FROM marks WINDOW w AS (PARTITION BY doc_id, level ORDER BY pos)),
    done AS (SELECT v.*, CASE WHEN coalesce(paired, false) THEN NULL ELSE kind END AS act FROM verdicts v LEFT JOIN pairs USING (doc_id, pos)),
    built AS (SELECT doc_id, string_agg(CASE WHEN act IS NULL THEN chr(cp::INTEGER) WHEN act = 'space' THEN ' ' ELSE '' END, '' ORDER BY pos) AS cleaned,
                     count(CASE WHEN act <> 'space' THEN 1 END) AS removed, count(CASE WHEN act = 'space' THEN 1 END) AS replaced FROM done GROUP BY doc_id)
    SELECT i.doc_id, md5(coalesce(b.cleaned, i.text)) AS cleaned_md5, coalesce(removed, 0) AS removed, coalesce(replaced, 0) AS replaced FROM {_INJECTED.replace(') injected', ') i')} LEFT JOIN built b USING (doc_id)"""
)
def carrier_clean(spark, sf_dir):
    x = codepoints.clean_text(injected(spark, sf_dir)).select("doc_id", "cleaning.*")
    return x.select("doc_id", F.md5("cleaned").alias("cleaned_md5"), "removed", "replaced")


_ALIKE = "".join(map(chr, codepoints.CYRILLIC))


@query(f"SELECT doc_id, md5(translate(translate(text, '{_ALIKE}', '{''.join(codepoints.CYRILLIC.values())}'), '{''.join(map(chr, codepoints.SPACES))}', '{' ' * len(codepoints.SPACES)}')) AS folded_md5 FROM {_INJECTED}")
def look_alike_fold(spark, sf_dir):
    text = F.translate(F.translate("text", _ALIKE, "".join(codepoints.CYRILLIC.values())), "".join(map(chr, codepoints.SPACES)), " " * len(codepoints.SPACES))
    return injected(spark, sf_dir).select("doc_id", F.md5(text).alias("folded_md5"))


def _sql_text(s: str) -> str:
    return s.replace("'", "''")


_MARKER_ROWS = ", ".join(f"({i}, '{_sql_text('(?i)' + p)}', '{_sql_text(label)}', {w})" for i, (p, label, w) in enumerate(style.MARKERS))


@query(
    f"""SELECT doc_id, label, hits FROM (SELECT doc_id, label, len(regexp_extract_all(text, pattern)) AS hits
    FROM {_INJECTED} CROSS JOIN (VALUES {_MARKER_ROWS}) m(n, pattern, label, weight)) WHERE hits > 0"""
)
def style_markers(spark, sf_dir):
    labels = F.array(*(F.lit(label) for _, label, _ in style.MARKERS))
    x = style.style_measures(injected(spark, sf_dir)).select("doc_id", F.explode(F.arrays_zip(labels.alias("label"), F.col("style.hits").alias("hits"))).alias("m"))
    return x.select("doc_id", F.col("m.label").alias("label"), F.col("m.hits").alias("hits")).where("hits > 0")


_STYLE = f"""WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n
  FROM (SELECT doc_id, [lower(x) for x in regexp_extract_all(text, '{_sql_text(style.WORD)}')] AS ws FROM {_INJECTED})),
windows AS (SELECT doc_id, n, pos, count(DISTINCT word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {style.WINDOW - 1} FOLLOWING) AS d, count(DISTINCT word) OVER (PARTITION BY doc_id) AS whole FROM w),
mattr AS (SELECT doc_id, any_value(n) AS n, CASE WHEN any_value(n) <= {style.WINDOW} THEN any_value(whole) / any_value(n) ELSE sum(CASE WHEN pos <= n - {style.WINDOW} + 1 THEN d END) / {style.WINDOW}.0 / (any_value(n) - {style.WINDOW} + 1) END AS mattr FROM windows GROUP BY doc_id),
lines AS (SELECT doc_id, array_to_string([trim(l) for l in string_split(text, chr(10)) if trim(l) <> ''], chr(10)) AS t FROM {_INJECTED}),
parts AS (SELECT doc_id, unnest(regexp_split_to_array(t, '[.!?]+\\s+|\\n+')) AS s FROM lines),
sizes AS (SELECT doc_id, len(regexp_extract_all(s, '{_sql_text(style.WORD)}')) AS k FROM parts),
burst AS (SELECT doc_id, CASE WHEN count(*) > 1 THEN stddev_samp(k) / avg(k) END AS cv FROM sizes WHERE k > 0 GROUP BY doc_id),
dense AS (SELECT doc_id, sum(len(regexp_extract_all(text, pattern)) * weight) AS weight FROM {_INJECTED} CROSS JOIN (VALUES {_MARKER_ROWS}) m(n, pattern, label, weight) GROUP BY doc_id),
joined AS (SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(mattr, 0) AS mattr, cv, weight / (n / 100.0) AS density FROM documents d LEFT JOIN mattr USING (doc_id) LEFT JOIN burst USING (doc_id) LEFT JOIN dense USING (doc_id)),
steps AS (SELECT *, CASE WHEN cv < .25 THEN .95 WHEN cv < .35 THEN .8 WHEN cv < .45 THEN .5 WHEN cv < .55 THEN .25 ELSE .05 END AS b, CASE WHEN density >= 2 THEN 1.0 WHEN density >= 1 THEN .75 WHEN density >= .5 THEN .45 WHEN density > 0 THEN .2 ELSE 0 END AS d, CASE WHEN mattr BETWEEN .68 AND .76 THEN .4 ELSE .1 END AS v FROM joined),
scored AS (SELECT *, CASE WHEN n >= 30 THEN greatest(0, least(1, (CASE WHEN cv IS NULL THEN (d::DOUBLE * .45 + v * .1) / .55 ELSE b::DOUBLE * .45 + d * .45 + v * .1 END) * (CASE WHEN n < 100 THEN .4::DOUBLE + .6 * (n - 30) / 70 ELSE 1 END))) END AS score FROM steps)"""


@query(
    _STYLE
    + """ SELECT doc_id, n::BIGINT AS n_words, round(mattr, 4) AS mattr, round(cv, 4) AS burstiness_cv, CASE WHEN n >= 30 THEN round(density, 4) END AS density, round(score, 4) AS score,
    CASE WHEN score IS NULL THEN 'uncalibrated' WHEN score >= .65 THEN 'high' WHEN score >= .4 THEN 'medium' ELSE 'low' END AS density_tier,
    CASE WHEN score >= .75 THEN 'HIGH' WHEN score >= .5 THEN 'MEDIUM' WHEN score >= .25 THEN 'LOW' WHEN score IS NOT NULL THEN 'CLEAN' END AS confidence_level,
    CASE WHEN n >= 30 THEN 'ok' ELSE 'insufficient_length' END AS status FROM scored"""
)
def style_scores(spark, sf_dir):
    x = style.style_measures(injected(spark, sf_dir))
    x = x.withColumns(style.style_score(F.col("style")))
    four = lambda c: (F.round(F.col(c) * 10000, 0) / 10000).alias(c.rpartition(".")[2])
    return x.select("doc_id", "style.n_words", four("style.mattr"), four("style.burstiness_cv"), four("density"), four("score"), "density_tier", "confidence_level", "status")


_GRAMS = """tok AS (SELECT lang, doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}_]+|[^\\s\\p{L}\\p{Nd}_]') AS t FROM documents),
flat AS (SELECT lang, doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM tok),
grams AS (SELECT lang, doc_id, tok, lag(tok, 2) OVER w AS c1, lag(tok, 1) OVER w AS c2 FROM flat WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""


@query(
    f"""WITH {_GRAMS},
    ctx AS (SELECT coalesce(lang = 'en', false) AS target, c1, c2, tok, count(*) AS n FROM grams WHERE c1 IS NOT NULL GROUP BY ALL),
    tot AS (SELECT target, c1, c2, sum(n) AS total FROM ctx GROUP BY ALL),
    uni AS (SELECT coalesce(lang = 'en', false) AS target, tok, count(*) AS n FROM flat GROUP BY ALL),
    voc AS (SELECT target, count(*) AS v, sum(n) AS s FROM uni GROUP BY target),
    p AS (SELECT a.c1, a.c2, a.tok, ln(((a.n + .4::DOUBLE) / greatest(ta.total + .4::DOUBLE * (SELECT v FROM voc WHERE target), 1) + 1e-6) /
      ((CASE WHEN tb.total IS NOT NULL THEN (coalesce(b.n, 0) + .4::DOUBLE) / greatest(tb.total + .4::DOUBLE * (SELECT v FROM voc WHERE NOT target), 1)
             ELSE (coalesce(u.n, 0) + .4::DOUBLE) / greatest((SELECT s FROM voc WHERE NOT target) + .4::DOUBLE * (SELECT v FROM voc WHERE NOT target), 1) END) + 1e-6)) AS score
      FROM ctx a JOIN tot ta USING (target, c1, c2) LEFT JOIN tot tb ON NOT tb.target AND tb.c1 = a.c1 AND tb.c2 = a.c2
      LEFT JOIN ctx b ON NOT b.target AND b.c1 = a.c1 AND b.c2 = a.c2 AND b.tok = a.tok LEFT JOIN uni u ON NOT u.target AND u.tok = a.tok WHERE a.target)
    SELECT c1, c2, tok, rank, round(score, 5) AS score FROM (SELECT *, (row_number() OVER (PARTITION BY c1, c2 ORDER BY round(score, 12) DESC, tok))::INTEGER AS rank FROM p) WHERE rank <= 50"""
)
def ngram_contrast(spark, sf_dir):
    """English against all other documents, with the operator's own limits: every context and its fifty best."""
    out = ngrams.corpus_contrast(table(spark, sf_dir, "documents"), F.col("lang") == "en")
    return out.select(F.col("ctx")[0].alias("c1"), F.col("ctx")[1].alias("c2"), "tok", "rank", "score")


@query(f"WITH {_GRAMS} SELECT lang, c1, c2, tok, count(*) AS n FROM grams WHERE c1 IS NOT NULL GROUP BY ALL")
def ngram_counts(spark, sf_dir):
    """Trigrams of every language, null among them."""
    return ngrams.context_counts(table(spark, sf_dir, "documents"), by=["lang"]).select("lang", F.col("ctx")[0].alias("c1"), F.col("ctx")[1].alias("c2"), "tok", "n")


_TURNS = """(SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) turns"""


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    return c.select("conv_id", "turn", F.col("text").alias("x")).join(after, ["conv_id", "turn"])


def _duck_bigrams(column: str) -> str:
    words = f"regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]+')"
    return f"list_distinct([{words}[i] || ' ' || {words}[i + 1] for i in range(1, len({words}))])"


@query(
    f"""SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE 1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS divergence, numbers FROM
    (SELECT conv_id, turn, {_duck_bigrams('x')} AS a, {_duck_bigrams('y')} AS b,
     CASE WHEN len(list_distinct(regexp_extract_all(x, '[0-9]+'))) = 0 THEN 1 ELSE round(len(list_intersect(list_distinct(regexp_extract_all(x, '[0-9]+')), list_distinct(regexp_extract_all(y, '[0-9]+')))) / len(list_distinct(regexp_extract_all(x, '[0-9]+'))), 6) END AS numbers FROM {_TURNS})"""
)
def turn_similarity(spark, sf_dir):
    divergence = F.round(ngrams.bigram_divergence(F.col("x"), F.col("y")), 6)
    return _turns(spark, sf_dir).select("conv_id", "turn", divergence.alias("divergence"), F.round(ngrams.preserved("[0-9]+", F.col("x"), F.col("y")), 6).alias("numbers"))


_NUMBERED = "(SELECT conv_id, turn, x || ' see http://ex.com/' || length(x) % 3 || ' or https://ex.org' AS x, y || ' see http://ex.com/' || length(y) % 3 AS y FROM {turns}) t"


@query(
    f"""SELECT conv_id, turn, len(list_intersect(list_distinct(regexp_extract_all(x, 'https?://\\S+')), list_distinct(regexp_extract_all(y, 'https?://\\S+')))) / len(list_distinct(regexp_extract_all(x, 'https?://\\S+'))) AS urls,
    greatest(1, length(x) // 4)::INTEGER AS tokens_in, round(length(y) / greatest(length(x), 1), 6) AS length_ratio FROM {_NUMBERED.replace('{turns}', _TURNS)}"""
)
def turn_quality(spark, sf_dir):
    """URLs that a turn's answer keeps, tokens by length, and the ratio of lengths."""
    t = spark.sql(f"SELECT * FROM {_NUMBERED}", turns=_turns(spark, sf_dir))
    x, y = F.col("x"), F.col("y")
    return t.select("conv_id", "turn", ngrams.preserved(r"https?://\S+", x, y).alias("urls"), evaluation.token_estimate(x).alias("tokens_in"), F.round(evaluation.length_ratio(x, y), 6).alias("length_ratio"))


@query("SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS divergence FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_divergence(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    return e.join(after, "vec_id").select("vec_id", F.round(evaluation.semantic_divergence(F.col("embedding"), F.col("after")), 6).alias("divergence"))


@query(
    """WITH x AS (SELECT n_chars::DOUBLE AS s, quality AS y FROM documents JOIN labels USING (doc_id)),
    r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM x)
    SELECT sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, round((sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * sum(1 - y)), 9) AS auroc FROM r"""
)
def quality_auroc(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("s")).join(table(spark, sf_dir, "labels"), "doc_id")
    return ngrams.auroc(x, "s", "quality").select("n_pos", "n_neg", F.round("auroc", 9).alias("auroc"))


_VARIANTS = "(SELECT event_type AS variant, count(*) AS n, round(avg(value), 9) AS gain, round(avg(abs(value - 50)), 9) AS loss, round(count(CASE WHEN value > 60 THEN 1 END) / count(*), 9) AS rate FROM events GROUP BY event_type)"


@query(f"SELECT * FROM {_VARIANTS} a WHERE NOT EXISTS (SELECT 1 FROM {_VARIANTS} b WHERE b.gain >= a.gain AND b.loss <= a.loss AND b.rate >= a.rate AND (b.gain > a.gain OR b.loss < a.loss OR b.rate > a.rate))")
def variant_skyline(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("variant"))
    nine = lambda c: F.round(c, 9)
    v = e.agg(F.count(F.lit(1)).alias("n"), nine(F.avg("value")).alias("gain"), nine(F.avg(F.abs(F.col("value") - 50))).alias("loss"), nine(F.count_if(F.col("value") > 60) / F.count(F.lit(1))).alias("rate"))
    return ngrams.skyline(v, "variant", ["gain", "rate"], ["loss"])


@query(
    """SELECT event_type AS variant, count(*) AS n, count(CASE WHEN value > 60 THEN 1 END) AS cleared, round(count(CASE WHEN value > 60 THEN 1 END) / count(*), 6) AS clear_rate,
    round(avg(value), 6) AS mean_value, list_sort(list(value))[(count(value) // 2 + 1)::BIGINT] AS upper_median, round(median(value), 9) AS true_median, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"""
)
def variant_aggregate(spark, sf_dir):
    """Rates with a zero guard, means, upper and true medians."""
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "variant")
    cleared = F.count_if(F.col("value") > 60)
    out = e.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), cleared.alias("cleared"), F.round(F.try_divide(cleared, F.count(F.lit(1))), 6).alias("clear_rate"), F.round(F.avg("value"), 6).alias("mean_value"), F.countDistinct("user_id").alias("users"))
    medians = evaluation.grouped_medians(e, ["variant"], "value").select("variant", "upper_median", F.round("true_median", 9).alias("true_median"))
    return out.join(medians, "variant", "left").select("variant", "n", "cleared", "clear_rate", "mean_value", "upper_median", "true_median", "users")


# Events as result rows of a search: the same SQL text in both engines.
_RESULTS = """(SELECT event_type AS variant, value > 20 AS before_pos, value > 80 AS after_pos, CASE WHEN value < 90 THEN value > 60 END AS cleared, value > 75 AS robust_cleared, value < 5 AS noop,
  CASE WHEN user_id % 5 > 0 THEN value END AS score_before, CASE WHEN user_id % 7 > 0 THEN value / 2 END AS score_after, value - 50 AS margin, value / 10 AS seconds, CASE WHEN value < 95 THEN floor(value / 25) END AS attempts,
  value / 1000 AS usd, CASE WHEN value > 10 THEN value / 100 END AS ai_style_score, CASE WHEN value > 30 THEN value / 100 END AS lexical, CASE WHEN value > 50 THEN value / 200 END AS semantic,
  CASE WHEN value > 30 THEN CAST(floor(value) AS BIGINT) END AS tokens_out, CASE WHEN value > 92 THEN 'slow' WHEN value < 3 THEN 'identical watermarked generation' END AS note, floor(value / 20) AS level FROM events) r"""


def _results(spark, sf_dir):
    r = spark.sql("SELECT * FROM " + _RESULTS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    quality = F.when(F.col("lexical").isNotNull(), F.struct(F.col("lexical").alias("lexical_divergence"), F.col("semantic").alias("semantic_divergence"), F.lit(1.0).alias("length_ratio"), F.lit(1.0).alias("numbers_preserved"), F.col("tokens_out").alias("tokens_in"), "tokens_out"))
    return r.withColumns({"quality": quality, "notes": F.array_compact(F.array("note")), "semantic_divergence": F.col("semantic"), "lexical_divergence": F.col("lexical")})


@query(
    f"""SELECT variant, count(*) AS n, count(CASE WHEN before_pos THEN 1 END) AS before_positive, count(CASE WHEN cleared THEN 1 END) AS cleared, round(count(CASE WHEN cleared THEN 1 END) / nullif(count(CASE WHEN before_pos THEN 1 END), 0), 4) AS clear_rate,
    count(CASE WHEN robust_cleared THEN 1 END) AS robust_cleared, count(CASE WHEN noop THEN 1 END) AS noop_n, count(ai_style_score) AS human_n, round(avg(score_before), 4) AS mean_score_before, round(avg(score_before - score_after), 4) AS mean_score_delta,
    round(list_sort(list(score_before - score_after) FILTER (score_before - score_after IS NOT NULL))[(count(score_before - score_after) // 2 + 1)::BIGINT], 4) AS median_score_delta, count(semantic) AS semantic_n, round(avg(semantic), 4) AS mean_semantic_divergence,
    round(avg(attempts), 2) AS mean_attempts, round(sum(coalesce(usd, 0)), 6) AS est_usd, coalesce(array_to_string(list_sort(list(DISTINCT note) FILTER (note IS NOT NULL)), ','), '') AS notes FROM {_RESULTS} GROUP BY variant"""
)
def variant_results(spark, sf_dir):
    x = evaluation.variant_summary(_results(spark, sf_dir))
    names = ["variant", "n", "before_positive", "cleared", "clear_rate", "robust_cleared", "noop_n", "human_n", "mean_score_before", "mean_score_delta", "median_score_delta", "semantic_n", "mean_semantic_divergence", "mean_attempts", "est_usd"]
    return x.select(*names, F.array_join("notes", ",").alias("notes"))


@query(
    f"""SELECT count(cleared) AS n_samples, count(CASE WHEN cleared THEN 1 END) AS n_cleared, round(count(CASE WHEN cleared THEN 1 END) / count(cleared), 4) AS clear_rate, count(CASE WHEN cleared IS NULL AND coalesce(attempts, 0) = 0 THEN 1 END) AS n_excluded,
    count(CASE WHEN starts_with(note, 'identical') THEN 1 END) AS n_duplicate_generations, round(avg(CASE WHEN cleared THEN level END), 4) AS mean_min_level, round(median(CASE WHEN cleared THEN level END), 4) AS median_min_level,
    round(median(CASE WHEN cleared THEN semantic END), 4) AS median_min_semantic_divergence, round(avg(CASE WHEN cleared THEN margin END), 4) AS mean_min_margin, count(CASE WHEN cleared AND level = 3 THEN 1 END) AS at_level_3,
    count(CASE WHEN cleared IS NULL AND coalesce(attempts, 0) = 0 AND note = 'slow' THEN 1 END) AS excluded_slow FROM {_RESULTS}"""
)
def search_summary(spark, sf_dir):
    x = evaluation.minimal_summary(_results(spark, sf_dir))
    names = ["n_samples", "n_cleared", "clear_rate", "n_excluded", "n_duplicate_generations", "mean_min_level", "median_min_level", "median_min_semantic_divergence", "mean_min_margin"]
    at = F.coalesce(F.element_at("level_usage", F.lit(3.0)), F.lit(0)) if dict(x.dtypes)["level_usage"].startswith("map<double") else F.coalesce(F.element_at("level_usage", F.lit(3).cast("bigint")), F.lit(0))
    return x.select(*names, at.alias("at_level_3"), F.coalesce(F.element_at("excluded_reasons", F.lit("slow")), F.lit(0)).alias("excluded_slow"))


# Pages carry no evidence either: every third gets an AI generator tag, every third a CMS one, every third a JSON-LD block.
_PAGES = """(SELECT page_id, url, replace(html, '<head>', '<head>' || CASE page_id % 3 WHEN 0 THEN '<meta name="generator" content="Midjourney AI">' WHEN 1 THEN '<meta name="generator" content="WordPress 6">' ELSE '<script type="application/ld+json">{"digitalSourceType":"trainedAlgorithmicMedia","p":"c2pa"}</script>' END) AS html FROM pages) p"""


def _pages(spark, sf_dir):
    text = _PAGES.replace("{", "{{").replace("}", "}}").replace("FROM pages", "FROM {pages}")
    return spark.sql("SELECT * FROM " + text, pages=table(spark, sf_dir, "pages"))


@query(
    f"""SELECT page_id, contains(html, '"p":"c2pa"') AS has_c2pa, contains(html, '"p":"c2pa"') OR contains(html, 'content="Midjourney AI"') AS has_ai_metadata,
    CASE WHEN contains(html, '"p":"c2pa"') THEN 'json-ld provenance-like block' WHEN contains(html, 'content="Midjourney AI"') THEN 'meta: <meta name="generator" content="Midjourney AI">'
         WHEN contains(html, 'content="WordPress 6"') THEN 'info: cms generator: <meta name="generator" content="WordPress 6">' ELSE '' END AS findings FROM {_PAGES}"""
)
def page_evidence(spark, sf_dir):
    x = evidence.html_evidence(_pages(spark, sf_dir))
    return x.select("page_id", "has_c2pa", "has_ai_metadata", F.array_join("findings", "|").alias("findings"))


@query()
def page_evidence_all(spark, sf_dir):
    """As the reference has it, with an entity-encoded marker and an embedded image put into every seventh and eleventh page."""
    entity = F.when(F.col("page_id") % 7 == 0, "<p>&#99;2pa</p>").otherwise("")
    image = F.when(F.col("page_id") % 11 == 0, '<img src="data:image/png;base64,iVBORw0KGgoAAAAAY2FCWAAAAAA=">').otherwise("")
    x = _pages(spark, sf_dir).withColumn("html", F.concat("html", entity, image))
    x = evidence.html_evidence(x, all_markers=True)
    return x.select("page_id", "has_c2pa", "has_ai_metadata", F.array_join("findings", "|").alias("findings"))


@query(
    f"""SELECT 'page/' || page_id AS uri, CASE WHEN contains(html, '"p":"c2pa"') THEN 'AI-WATERMARK-C2PA' ELSE 'AI-WATERMARK-METADATA' END AS rule_id,
    CASE WHEN contains(html, '"p":"c2pa"') THEN 'error' WHEN contains(html, 'content="Midjourney AI"') THEN 'warning' ELSE 'note' END AS level,
    CASE WHEN contains(html, '"p":"c2pa"') OR contains(html, 'content="Midjourney AI"') THEN 'probable' ELSE 'informational' END AS confidence
    FROM {_PAGES} WHERE contains(html, '"p":"c2pa"') OR contains(html, 'content="Midjourney AI"') OR contains(html, 'content="WordPress 6"')"""
)
def page_sarif(spark, sf_dir):
    x = evidence.html_evidence(_pages(spark, sf_dir)).withColumn("path", F.concat(F.lit("page/"), F.col("page_id").cast("string")))
    return evidence.sarif_results(x).select("uri", "rule_id", "level", "confidence")


# Two thirds of the pages' evidence and, where a page is long, the name of a product and a comment's hint.
_MARKED = _PAGES.replace("END) AS html FROM pages", "END) || CASE WHEN length(html) % 2 = 0 THEN ' made with Firefly' ELSE ' dcterms:provenance' END AS html FROM pages")
_VOCABULARIES = {"ai_hints": markers.AI_HINTS, "c2pa_hints": markers.C2PA_MARKERS, "products": markers.PRODUCTS, "comment_hints": markers.COMMENT_HINTS, "jpeg_hints": markers.JPEG_C2PA}


@query("SELECT page_id, " + ", ".join(f"""array_to_string([m for m in ['{"', '".join(v)}'] if contains(lower(html), lower(m))], '|') AS {name}""" for name, v in _VOCABULARIES.items()) + f" FROM {_MARKED}")
def page_markers(spark, sf_dir):
    """What each of the five vocabularies finds in a page."""
    text = _MARKED.replace("{", "{{").replace("}", "}}").replace("FROM pages", "FROM {pages}")
    pages = spark.sql("SELECT * FROM " + text, pages=table(spark, sf_dir, "pages"))
    return pages.select("page_id", *(F.array_join(evidence.marker_hits(F.col("html"), v), "|").alias(name) for name, v in _VOCABULARIES.items()))


@query(
    """SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host,
    CASE lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) WHEN 'https' THEN 443 WHEN 'http' THEN 80 END AS port,
    CASE WHEN regexp_matches(regexp_extract(url, '^[^?#]*'), '(?i)\\.html?$') THEN 'container' ELSE 'unknown' END AS kind FROM pages"""
)
def page_origins(spark, sf_dir):
    x = table(spark, sf_dir, "pages").withColumn("o", web.origin(F.col("url")))
    return x.select("page_id", "o.scheme", "o.host", "o.port", evidence.kind_by_extension(F.try_parse_url("url", F.lit("PATH"))).alias("kind"))


@query(
    """SELECT page_id, CASE WHEN regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(?i)\\.html?$') THEN 'html' WHEN starts_with(ltrim(html, ' ' || chr(9) || chr(10) || chr(13)), '<') AND contains(lower(substr(html, 1, 480)), 'svg') THEN 'svg'
    WHEN contains(lower(substr(html, 1, 2000)), '<html') OR starts_with(ltrim(html, ' ' || chr(9) || chr(10) || chr(13)), '<') THEN 'html' ELSE 'text' END AS by_content,
    CASE WHEN length(html) % 3 = 0 THEN 'pdf' WHEN length(html) % 3 = 1 THEN 'html' ELSE 'mp4' END AS by_type FROM pages"""
)
def remote_kinds(spark, sf_dir):
    """Kinds of fetched pages without a content type, and with one that their length names."""
    kind = F.element_at(F.array(F.lit("application/pdf; x=y"), F.lit(" Text/HTML"), F.lit("video/quicktime")), (F.length("html") % 3 + 1).cast("int"))
    body = F.col("html").cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", web.remote_kind(F.col("url"), body, F.lit("")).alias("by_content"), web.remote_kind(F.col("url"), body, kind).alias("by_type"))


_FINDINGS = ["Layer-A U+00A0 (space)", "Layer-A U+200B (zwj_family)", "PNG chunk caBX", "info: cms generator: x", "byte-scan hit: c2pa", "meta: generator", "truncated chunk", "XMP packet present", "attr: data-ai", "plain note", "softwareAgent found", "JPEG APP1 exif"]
_EXPECTED = ["informational", "probable", "confirmed", "informational", "likely_false_positive", "probable", "informational", "informational", "probable", "informational", "confirmed", "probable"]


@query(f"SELECT doc_id, (['{"', '".join(_FINDINGS)}'])[doc_id % {len(_FINDINGS)} + 1] AS finding, (['{"', '".join(_EXPECTED)}'])[doc_id % {len(_FINDINGS)} + 1] AS confidence FROM documents")
def finding_confidences(spark, sf_dir):
    finding = F.element_at(F.array(*map(F.lit, _FINDINGS)), (F.col("doc_id") % len(_FINDINGS) + 1).cast("int"))
    x = table(spark, sf_dir, "documents").select("doc_id", finding.alias("finding"))
    return x.withColumn("confidence", evidence.finding_confidence(F.col("finding")))


_LINES = """(SELECT conv_id, turn, CASE length(text) % 5 WHEN 0 THEN text WHEN 1 THEN '{' || text WHEN 2 THEN '{"role": "' || role || '"}' WHEN 3 THEN '{"text": ' || length(text) || '}' ELSE ' {"text": "' || role || ' ' || length(text) || '"} ' END AS value FROM conversations) lines"""


@query(
    f"""SELECT conv_id, turn, text FROM (SELECT conv_id, turn, CASE WHEN starts_with(trim(value), '{{') AND json_valid(value) THEN CASE WHEN json_type(value, '$.text') = 'VARCHAR' THEN json_extract_string(value, '$.text') END
    ELSE regexp_replace(value, '^\\s+|\\s+$', '', 'g') END AS text FROM {_LINES}) WHERE text <> ''"""
)
def jsonl_corpus(spark, sf_dir):
    """Conversations as lines: plain ones, broken objects, objects without the field, with a number in it, and whole ones."""
    from ..sources.corpus import corpus_texts

    lines = spark.sql("SELECT * FROM " + _LINES.replace("{", "{{").replace("}", "}}").replace("FROM conversations", "FROM {conversations}"), conversations=table(spark, sf_dir, "conversations"))
    return corpus_texts(lines, "text").select("conv_id", "turn", "text")


@query("WITH d AS (SELECT source, dense_rank() OVER (ORDER BY source) AS r FROM (SELECT DISTINCT source FROM documents)), n AS (SELECT max(r) AS k FROM d) SELECT source, r <= greatest(1, round_even(k * 0.3, 0)) AS holdout FROM d, n")
def holdout_split(spark, sf_dir):
    """Sources split by name: the first share of the sorted ones is held out."""
    return ngrams.holdout(table(spark, sf_dir, "documents").select("source").distinct(), "source")


@query("WITH d AS (SELECT doc_id, dense_rank() OVER (ORDER BY doc_id) AS r FROM documents), n AS (SELECT max(r) AS k FROM d) SELECT doc_id, r <= greatest(1, round_even(k * 0.3, 0)) AS holdout FROM d, n")
def holdout_documents(spark, sf_dir):
    """Every document on its side of the split; the first share of the sorted ids is held out."""
    return ngrams.holdout(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(
    """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM (SELECT doc_id, translate(text, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ', repeat('é', 30)) AS text FROM documents)),
    c AS (SELECT doc_id, len(w) AS n, len(list_distinct([array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 3)])) AS k FROM t)
    SELECT doc_id, n AS tokens, least(4, n) AS skipped_no_context, greatest(0, n - 4) - k AS skipped_repeated, k AS counted FROM c"""
)
def replay_counts(spark, sf_dir):
    from ..functions.keyed import replay_test

    out = replay_test(table(spark, sf_dir, "documents").select("doc_id", "text"), "secret")
    return out.select("doc_id", "replay.tokens", "replay.skipped_no_context", "replay.skipped_repeated", "replay.counted")


def replay_scores(spark, sf_dir):
    from ..functions.keyed import replay_test

    return replay_test(table(spark, sf_dir, "documents").select("doc_id", "text"), "secret").select("doc_id", "replay.statistic", "replay.p_value", "replay.score", "replay.is_watermarked")


query()(replay_scores)


@query(
    """SELECT doc_id, s.seq::INTEGER AS seq, CASE s.seq WHEN 0 THEN 'IHDR' WHEN 1 THEN 'tEXt' ELSE 'IEND' END AS kind, CASE s.seq WHEN 0 THEN 13 WHEN 1 THEN octet_length(encode(source || lang)) ELSE 0 END::BIGINT AS size,
    s.seq = 1 AND doc_id % 4 = 0 AS marked FROM documents, (VALUES (0), (1), (2)) s(seq)""".replace("source || lang", "source || lang || CASE WHEN doc_id % 4 = 0 THEN 'c2pa' ELSE '' END")
)
def png_walk(spark, sf_dir):
    """Chunks of images that are written around each document's source."""
    from ..sources.binary import register_walkers

    register_walkers(spark)
    text = "concat(source, lang, if(doc_id % 4 = 0, 'c2pa', ''))"
    chunk = lambda kind, body: f"unhex(lpad(hex(octet_length({body})), 8, '0')), cast('{kind}' as binary), {body}, unhex('00000000')"
    png = f"concat(unhex('89504E470D0A1A0A'), {chunk('IHDR', 'unhex(repeat(chr(48), 26))')}, {chunk('tEXt', f'cast({text} as binary)')}, {chunk('IEND', 'unhex(chr(0) || chr(0))')})".replace("unhex(chr(0) || chr(0))", "cast('' as binary)")
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{png} AS content")
    out = spark.sql("SELECT doc_id, c.seq, c.kind, c.payload FROM {docs} d, LATERAL png_chunks(d.content) c", docs=docs)
    return out.select("doc_id", "seq", "kind", F.octet_length("payload").cast("long").alias("size"), F.size(evidence.marker_hits(F.decode("payload", "ISO-8859-1"), evidence.C2PA_MARKERS)).alias("hits")).select("doc_id", "seq", "kind", "size", (F.col("hits") > 0).alias("marked"))


@query(
    """SELECT doc_id, doc_id % 3 = 0 AS has_ai, CASE doc_id % 3 WHEN 0 THEN 'generator' ELSE '' END AS keys FROM documents"""
)
def frontmatter_evidence(spark, sf_dir):
    """Front matter put before each document: a tool key, prose about a name, or none."""
    head = F.element_at(F.array(F.lit("---\ntitle: x\ngenerator: Claude\n---\n"), F.lit("---\ntitle: Claude Monet\nauthor: y\n---\n"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(head, "text").alias("text"))
    x = evidence.frontmatter(docs)
    return x.select("doc_id", (F.size("ai_keys") > 0).alias("has_ai"), F.array_join("ai_keys", ",").alias("keys"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a PNG image' WHEN 1 THEN 'binary data (contains NUL bytes)' WHEN 2 THEN 'binary data (dense in control bytes)' ELSE '' END AS reason FROM documents")
def binary_guard(spark, sf_dir):
    head = F.element_at(F.array(F.unhex(F.lit("89504E470D0A1A0A")), F.unhex(F.lit("616200")), F.unhex(F.lit("01" * 4000)), F.lit("").cast("binary")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.col("text").cast("binary")).alias("content")).select("doc_id", evidence.binary_reason(F.col("content")).alias("reason"))


@query(
    f"""WITH v AS (SELECT variant, gain / 100 AS human_like, loss / 100 AS sem_div, rate FROM {_VARIANTS}),
    front AS (SELECT * FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.rate >= a.rate AND b.sem_div <= a.sem_div AND b.human_like >= a.human_like AND (b.rate > a.rate OR b.sem_div < a.sem_div OR b.human_like > a.human_like)))
    SELECT variant, round(0.5 * rate + 0.3 * (1 - sem_div) + 0.2 * human_like, 6) AS weighted FROM front WHERE rate >= 0.1"""
)
def variant_selection(spark, sf_dir):
    """The frontier's variants over a coverage floor, by weighted axes."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("variant"))
    nine = lambda c: F.round(c, 9)
    v = e.agg((nine(F.avg("value")) / 100).alias("human_like"), (nine(F.avg(F.abs(F.col("value") - 50))) / 100).alias("sem_div"), nine(F.count_if(F.col("value") > 60) / F.count(F.lit(1))).alias("robust_clear_rate"))
    out = evaluation.ranked_on_frontier(v, "variant", (0.5, 0.3, 0.2), coverage_floor=0.1)
    return out.select("variant", F.round("weighted_score", 6).alias("weighted"))


@query("SELECT event_type AS variant, CASE WHEN count(value) = 0 THEN 'undetermined' WHEN max(value) >= 100 THEN 'removable' WHEN max(value) > 0 THEN 'partial' ELSE 'resists' END AS verdict FROM events GROUP BY event_type")
def variant_verdict(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("variant")).agg(evaluation.verdict(F.max("value") / 100).alias("verdict"))


@query(
    f"""WITH {_GRAMS},
    ctx AS (SELECT c1, c2, tok, round(ln(count(*) + 1), 5) AS score FROM grams WHERE c1 IS NOT NULL AND lang = 'en' GROUP BY ALL),
    hits AS (SELECT doc_id, sum(score) AS score_sum, count(*) AS applied FROM grams JOIN ctx USING (c1, c2, tok) GROUP BY doc_id)
    SELECT d.doc_id, round(coalesce(score_sum, 0), 5) AS score_sum, coalesce(applied, 0) AS applied, round(round(score_sum, 5) / applied, 4) AS mean FROM documents d LEFT JOIN hits USING (doc_id)"""
)
def sequence_scores(spark, sf_dir):
    """Every document under a scorer of all English trigrams."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    scorer = ngrams.context_counts(docs.where("lang = 'en'")).select("ctx", "tok", F.round(F.log(F.col("n") + 1.0), 5).alias("score"))
    out = ngrams.sequence_scores(docs, scorer)
    return out.select("doc_id", F.round("score_sum", 5).alias("score_sum"), "applied", F.round(F.try_divide(F.round("score_sum", 5), F.col("applied")), 4).alias("mean"))


@query(
    f"""SELECT p.page_id, contains(html, '"p":"c2pa"') OR contains(html, 'content="Midjourney AI"') AS provenance, p.page_id % 2 = 0 AS layer_a, CASE WHEN p.page_id % 3 = 0 THEN p.page_id % 5 = 0 END AS detector,
    contains(html, '"p":"c2pa"') OR contains(html, 'content="Midjourney AI"') OR p.page_id % 2 = 0 OR (p.page_id % 3 = 0 AND p.page_id % 5 = 0) AS suspicious FROM {_PAGES}"""
)
def evidence_verdicts(spark, sf_dir):
    x = evidence.html_evidence(_pages(spark, sf_dir))
    detected = F.when(F.col("page_id") % 3 == 0, F.col("page_id") % 5 == 0)
    total = F.when(F.col("page_id") % 2 == 0, 2).otherwise(0)
    return x.select("page_id", evidence.evidence_classes(F.col("has_c2pa"), F.col("has_ai_metadata"), total, detected, F.lit(None).cast("double")).alias("e")).select("page_id", "e.provenance", "e.layer_a", "e.detector", "e.suspicious")


@query("SELECT page_id, 'image/png' AS media_type, (page_id % 2 = 0) AS base64, CASE WHEN page_id % 2 = 0 THEN hex(encode('c2pa' || page_id)) ELSE hex(encode('<svg/>')) END AS content FROM pages")
def page_data_uris(spark, sf_dir):
    """Pages with one embedded image each, base64 or percent-encoded."""
    packed = F.concat(F.lit("data:image/png;base64,"), F.base64(F.concat(F.lit("c2pa"), F.col("page_id").cast("string")).cast("binary")))
    uri = F.when(F.col("page_id") % 2 == 0, packed).otherwise("data:image/png,%3Csvg/%3E")
    x = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit('<img src="'), uri, F.lit('">')).alias("html"))
    x = x.select("page_id", F.explode(evidence.data_uris(F.col("html"))).alias("u"))
    return x.select("page_id", "u.media_type", "u.base64", F.hex("u.content").alias("content"))


@query("SELECT page_id, url AS location FROM pages WHERE page_id % 4 <> 0")
def sitemap_urls(spark, sf_dir):
    """Sitemaps of one page each; those with a DTD are refused."""
    head = F.when(F.col("page_id") % 4 == 0, "<!DOCTYPE x>").otherwise("<?xml version='1.0'?>")
    xml = F.concat(head, F.lit("<urlset><url><loc> "), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url></urlset>"))
    return table(spark, sf_dir, "pages").select("page_id", web.sitemap(xml.cast("binary")).alias("s")).select("page_id", F.explode("s.locations").alias("location"))


@query(
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'container' WHEN 1 THEN 'image' WHEN 2 THEN 'av' WHEN 3 THEN 'av' WHEN 4 THEN 'container' ELSE 'unknown' END AS kind,
    CASE page_id % 6 WHEN 2 THEN 'flac' WHEN 3 THEN 'wav' ELSE 'unknown' END AS av FROM pages"""
)
def content_kinds(spark, sf_dir):
    samples = ["68656C6C6F", "89504E470D0A1A0A", "49443303000000000001" + "00" + "664C6143", "5249464600000000" + "57415645", "255044462D", "68656C6C6F"]
    i = (F.col("page_id") % 6 + 1).cast("int")
    content = F.element_at(F.array(*(F.unhex(F.lit(s)) for s in samples)), i)
    path = F.element_at(F.array(*map(F.lit, ["/a/x.HTML", "/a/x", "/a/x.bin", "/x", "/x", "/x"])), i)
    return table(spark, sf_dir, "pages").select("page_id", evidence.kind_by_content(path, content).alias("kind"), evidence.av_format(content).alias("av"))


# Documents and pages as files.


@query(
    f"""WITH {_UNITS}, per_doc AS (SELECT doc_id, count(kind) AS total, count(CASE WHEN kind <> 'space' THEN 1 END) AS probable FROM verdicts GROUP BY doc_id),
    items AS (SELECT 'text' AS kind, false AS c2pa, false AS ai, coalesce(total, 0) AS total, coalesce(probable, 0) AS probable FROM documents LEFT JOIN per_doc USING (doc_id)
      UNION ALL SELECT 'html', contains(html, '"p":"c2pa"'), contains(html, '"p":"c2pa"') OR contains(html, 'content="Midjourney AI"'), 0, CASE WHEN contains(html, '"p":"c2pa"') OR contains(html, 'content="Midjourney AI"') THEN 1 ELSE 0 END FROM {_PAGES})
    SELECT kind, count(*) AS files, count(CASE WHEN c2pa THEN 1 END) AS with_c2pa, count(CASE WHEN ai THEN 1 END) AS with_ai_metadata, count(CASE WHEN total > 0 THEN 1 END) AS with_suspicious_text,
    count(CASE WHEN c2pa OR probable > 0 THEN 1 END) AS actionable_files FROM items GROUP BY kind"""
)
def file_audit(spark, sf_dir):
    """The audit of files by kind: documents as text files, pages as HTML files."""
    texts = injected(spark, sf_dir).select(F.format_string("doc/%d.txt", "doc_id").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    pages = _pages(spark, sf_dir).select(F.format_string("page/%d.html", "page_id").alias("path"), F.col("html").cast("binary").alias("content"))
    items = reports.audit_items(reports.inspect_files(texts.unionByName(pages)))
    summary = reports.audit_summary(items.withColumn("group", F.col("kind")), ["group"])
    return summary.select(F.col("group").alias("kind"), F.col("total").alias("files"), "with_c2pa", "with_ai_metadata", "with_suspicious_text", "actionable_files")


@query(
    f"""WITH {_UNITS}, {_STYLE[5:]},
    tiers AS (SELECT doc_id, CASE WHEN score IS NULL THEN 'uncalibrated' WHEN score >= .65 THEN 'high' WHEN score >= .4 THEN 'medium' ELSE 'low' END AS tier FROM scored)
    SELECT doc_id, 'unicode' AS detector, kind AS what, count(*) AS hits, CASE WHEN kind = 'space' THEN 'informational' ELSE 'probable' END AS severity FROM verdicts WHERE kind IS NOT NULL GROUP BY doc_id, cp, kind
    UNION ALL SELECT doc_id, 'stylometry', label, hits, tier FROM (SELECT doc_id, label, len(regexp_extract_all(text, pattern)) AS hits FROM {_INJECTED} CROSS JOIN (VALUES {_MARKER_ROWS}) m(n, pattern, label, weight)) JOIN tiers USING (doc_id) WHERE hits > 0"""
)
def flagged_texts(spark, sf_dir):
    """Everything that the text audit flags, carriers and style markers."""
    x = reports.text_audit(injected(spark, sf_dir), id_col="doc_id")
    return x.select("doc_id", "detector", F.coalesce("kind", "phrase").alias("what"), F.col("count").alias("hits"), "severity")


@query(
    f"""WITH {_UNITS}, {_STYLE[5:]}, per_doc AS (SELECT doc_id, count(kind) AS total FROM verdicts GROUP BY doc_id)
    SELECT doc_id, coalesce(score >= .65, false) OR coalesce(total, 0) > 0 AS suspicious, coalesce(score >= .65, false) AS detected FROM scored LEFT JOIN per_doc USING (doc_id)"""
)
def file_verdicts(spark, sf_dir):
    """The verdict on each document as a file, and whether any detector that is there says yes."""
    files = injected(spark, sf_dir).select("doc_id", F.format_string("doc/%d.txt", "doc_id").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    x = reports.styled(reports.detect(reports.inspect_files(files)))
    return x.select("doc_id", reports.is_suspicious(F.col("report"), F.col("style_score")).alias("suspicious"), reports.any_positive(F.col("detections")).alias("detected"))


@query(
    """WITH d AS (SELECT doc_id, coalesce(length(text), 0) % 4 AS form, contains(coalesce(text, ''), 'the') AS marked FROM documents)
    SELECT doc_id, CASE form WHEN 0 THEN 'gif' WHEN 1 THEN 'wav' WHEN 2 THEN 'pdf' ELSE 'latex' END AS format, marked AS has_ai_metadata,
    CASE form WHEN 0 THEN 'GIF comment extension present' || CASE WHEN marked THEN '|GIF comment: AIGC, aigc' ELSE '' END WHEN 1 THEN CASE WHEN marked THEN 'WAV LIST INFO chunk: AIGC, aigc' ELSE '' END
      WHEN 2 THEN CASE WHEN marked THEN 'pdf-structured:ai:AIGC|pdf-structured:ai:aigc' ELSE 'no PDF AI metadata markers found' END ELSE CASE WHEN marked THEN 'latex ai: hypersetup pdfauthor' ELSE 'info: latex hypersetup pdfauthor' END END AS findings FROM d"""
)
def built_files(spark, sf_dir):
    """Files written around documents: a GIF comment, a WAV tag, a PDF with the text in a stream, or a LaTeX head; each marked if the text holds a word."""
    told = "concat(coalesce(source, ''), if(contains(coalesce(text, ''), 'the'), ' AIGC', ''))"
    one, word = f"unhex(lpad(hex(octet_length({told})), 2, '0'))", f"unhex(rpad(lpad(hex(octet_length({told}) + 4), 2, '0'), 8, '0'))"
    gif = f"concat(unhex('47494638396100000000000000'), unhex('21FE'), {one}, cast({told} as binary), unhex('003B'))"
    wav = f"concat(cast('RIFF' as binary), unhex('00000000'), cast('WAVELIST' as binary), {word}, cast('INFO' as binary), cast({told} as binary), unhex('00'))"
    pdf = f"cast(concat('%PDF-1.4', chr(10), 'stream', chr(10), coalesce(text, ''), ' c2pa', chr(10), 'endstream', chr(10), '/Producer (', {told}, ')') as binary)"
    tex = f"cast(concat('{chr(92) * 2}hypersetup{{pdfauthor={{', {told}, '}}}}') as binary)"
    form = "coalesce(length(text), 0) % 4"
    files = table(spark, sf_dir, "documents").selectExpr("doc_id", f"if({form} = 3, 'x.tex', 'x') AS path", f"CASE {form} WHEN 0 THEN {gif} WHEN 1 THEN {wav} WHEN 2 THEN {pdf} ELSE {tex} END AS content")
    return reports.inspect_files(files).select("doc_id", "report.format", "report.has_ai_metadata", F.array_join("report.findings", "|").alias("findings"))
