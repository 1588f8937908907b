"""Queries of sequence gates, timecode continuity and sample statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomshed.functions import keys, timecode
from loomshed.operators import gates, stats
from loomshed.plans.registry import register
from loomshed.session import table


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("clip"),
        F.col("l_linenumber").alias("num"),
        "l_returnflag",
        "l_linestatus",
        F.col("l_quantity").cast("int").alias("v"),
    )


@register(
    "sequence_gate",
    """
    WITH steps AS (SELECT l_orderkey AS clip, l_linenumber AS num, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS prev FROM lineitem),
    found AS (
      SELECT clip, count(*) AS frames, count(*) FILTER (WHERE num = prev) AS n_dup, count(*) FILTER (WHERE num > prev + 1) AS n_gap,
             coalesce(sum(CASE WHEN num > prev + 1 THEN num - prev - 1 ELSE 0 END), 0)::BIGINT AS n_missing
      FROM steps GROUP BY clip)
    SELECT *, CASE WHEN n_dup + n_gap > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM found
    """,
)
def sequence_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers within a clip follow by one."""
    return gates.sequence_gate(lines(spark, sf).select("clip", "num"), "clip", "num")


@register(
    "sequence_gaps",
    """
    WITH steps AS (SELECT l_orderkey AS clip, l_linenumber AS num, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS prev FROM lineitem)
    SELECT DISTINCT clip, prev, num, num - prev - 1 AS n_missing,
      CASE WHEN num - prev - 1 <= 3 THEN array_to_string(list_transform(range(prev + 1, num), lambda x: x::VARCHAR), ', ')
           ELSE (prev + 1)::VARCHAR || '…' || (num - 1)::VARCHAR END AS missing
    FROM steps WHERE num > prev + 1
    """,
)
def sequence_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """What is missing in each gap."""
    steps = gates.sequence_steps(lines(spark, sf).select("clip", "num"), "clip", "num").filter("step = 'GAP'")
    return steps.select(
        "clip",
        "prev",
        "num",
        (F.col("num") - F.col("prev") - 1).alias("n_missing"),
        gates.missing_display(F.col("prev"), F.col("num"), 3).alias("missing"),
    ).distinct()


@register(
    "declared_counts",
    """
    WITH found AS (SELECT l_orderkey AS clip, count(*) AS frames FROM lineitem GROUP BY 1),
    declared AS (SELECT o_orderkey AS clip, (o_custkey % 7 + 1)::BIGINT AS declared FROM orders WHERE o_orderstatus <> 'P')
    SELECT clip, frames, declared, coalesce(declared <> frames, false) AS mismatch FROM found LEFT JOIN declared USING (clip)
    """,
)
def declared_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Found frames against declared ones."""
    found = lines(spark, sf).groupBy("clip").agg(F.count(F.lit(1)).alias("frames"))
    declared = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("clip"), (F.col("o_custkey") % 7 + 1).alias("declared")
    )
    return gates.declared_check(found, declared, "clip")



_CLASS_SQL = "CASE l_returnflag WHEN 'N' THEN 'raw' WHEN 'R' THEN 'camera-lossless' ELSE CASE WHEN l_linestatus = 'F' THEN 'archive' END END"


def classed(spark: SparkSession, sf: str) -> DataFrame:
    cls = F.when(F.col("l_returnflag") == "N", "raw").when(F.col("l_returnflag") == "R", "camera-lossless").when(
        F.col("l_linestatus") == "F", "archive"
    )
    return lines(spark, sf).withColumn("class", cls)


@register(
    "class_census",
    f"SELECT l_orderkey AS clip, coalesce({_CLASS_SQL}, 'unknown') AS class, count(*) AS frames FROM lineitem GROUP BY ALL",
)
def class_census(spark: SparkSession, sf: str) -> DataFrame:
    """frames by clip and class."""
    return gates.class_census(classed(spark, sf), "clip", "class")


@register(
    "class_contract",
    f"""
    WITH f AS (SELECT l_orderkey AS clip, l_linenumber AS num, coalesce({_CLASS_SQL}, 'unknown') AS class FROM lineitem),
    g AS (SELECT clip, list_sort(list(DISTINCT class)) AS classes, min(num) FILTER (WHERE class NOT IN ('raw', 'camera-lossless')) AS first_offender FROM f GROUP BY clip)
    SELECT clip, '{{' || array_to_string(classes, ', ') || '}}' AS class_set, classes IN (['raw'], ['camera-lossless', 'raw']) AS allowed, first_offender FROM g
    """,
)
def class_contract(spark: SparkSession, sf: str) -> DataFrame:
    """The classes a clip may hold, and the first frame that breaks the rule."""
    rows = classed(spark, sf).withColumn("class", F.coalesce("class", F.lit("unknown")))
    return gates.class_contract(rows, "clip", "class", "num")


_TC_SQL = """
  SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS num,
         CASE WHEN event_id % 10 <> 0 THEN ((hour(ts) * 60 + minute(ts)) * 60 + second(ts)) * 24 + event_id % 24 END AS tc FROM events
"""


def timed(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as frames of a clip; the timecode is the time of day, missing for every tenth event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    tc = timecode.total_frames(F.hour("ts"), F.minute("ts"), F.second("ts"), F.col("event_id") % 24)
    num = F.row_number().over(w) + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)
    return table(spark, sf, "events").select(
        F.col("user_id").alias("clip"), num.cast("long").alias("num"), F.when(F.col("event_id") % 10 != 0, tc).alias("tc")
    )


@register(
    "timecode_continuity",
    f"""
    WITH f AS ({_TC_SQL}),
    one AS (SELECT clip, num, min(tc) AS tc FROM f GROUP BY ALL),
    s AS (SELECT clip, num, tc, lag(num) OVER w AS pn, lag(tc) OVER w AS pt FROM one WINDOW w AS (PARTITION BY clip ORDER BY num)),
    d AS (SELECT clip, CASE WHEN num = pn + 1 THEN tc - pt END AS delta FROM s)
    SELECT clip, count(*) FILTER (WHERE delta = 1) AS n_ok, count(*) FILTER (WHERE delta > 1) AS n_gap, count(*) FILTER (WHERE delta <= 0) AS n_overlap, count(*) FILTER (WHERE delta IS NULL) AS n_unchecked
    FROM d GROUP BY clip
    """,
)
def timecode_continuity(spark: SparkSession, sf: str) -> DataFrame:
    """Timecodes follow where numbers do."""
    one = timed(spark, sf).groupBy("clip", "num").agg(F.min("tc").alias("tc"))

    def is_(s):
        return F.count_if(F.col("tc_step") == s)

    return gates.timecode_steps(one, "clip", "num", "tc").groupBy("clip").agg(
        is_("OK").alias("n_ok"),
        is_("TC_GAP").alias("n_gap"),
        is_("TC_OVERLAP").alias("n_overlap"),
        F.count_if(F.col("tc_step").isNull()).alias("n_unchecked"),
    )


@register(
    "reel_continuity",
    f"""
    WITH f AS ({_TC_SQL}), one AS (SELECT clip, num, min(tc) AS tc FROM f GROUP BY ALL),
    ends AS (SELECT clip, arg_min(tc, num) FILTER (WHERE tc IS NOT NULL) AS tc_first, arg_max(tc, num) FILTER (WHERE tc IS NOT NULL) AS tc_last FROM one GROUP BY clip),
    p AS (SELECT clip, lead(clip) OVER (ORDER BY clip) AS next_clip, lead(tc_first) OVER (ORDER BY clip) - tc_last AS delta FROM ends)
    SELECT clip, next_clip, delta, CASE WHEN delta <= 0 THEN 'REEL_OVERLAP' ELSE 'OK' END AS verdict FROM p WHERE next_clip IS NOT NULL
    """,
)
def reel_continuity(spark: SparkSession, sf: str) -> DataFrame:
    """Clips in key order do not overlap."""
    one = timed(spark, sf).groupBy("clip", "num").agg(F.min("tc").alias("tc"))
    return gates.reel_continuity(gates.tc_ends(one, "clip", "num", "tc"), "clip")


@register(
    "timecode_parse",
    """
    WITH b AS (SELECT event_id, (event_id * 7 % 256)::INT AS ff, (event_id * 13 % 160)::INT AS ss, (event_id * 29 % 160)::INT AS mm, (event_id * 31 % 64)::INT AS hh FROM events),
    p AS (SELECT event_id, CASE WHEN ff & 15 <= 9 THEN (ff >> 4) * 10 + (ff & 15) END AS f, CASE WHEN ss & 15 <= 9 THEN (ss >> 4) * 10 + (ss & 15) END AS s,
                 CASE WHEN mm & 15 <= 9 THEN (mm >> 4) * 10 + (mm & 15) END AS m, CASE WHEN hh & 15 <= 9 THEN (hh >> 4) * 10 + (hh & 15) END AS h FROM b),
    e AS (SELECT *, CASE WHEN f IS NULL THEN 'ff' WHEN s IS NULL THEN 'ss' WHEN m IS NULL THEN 'mm' WHEN h IS NULL THEN 'hh' WHEN h > 23 THEN 'hh range'
                         WHEN f > 23 THEN 'ff range' WHEN s > 59 THEN 'ss range' WHEN m > 59 THEN 'mm range' END AS err FROM p)
    SELECT event_id, err, CASE WHEN err IS NULL THEN ((h * 60 + m) * 60 + s) * 24 + f END AS frames,
           CASE WHEN err IS NULL THEN printf('%02d:%02d:%02d:%02d', h, m, s, f) END AS display FROM e
    """,
)
def timecode_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Packed timecodes, checked in order, as frames and as text."""

    def byte(k, m):
        return (F.col("event_id") * k % m).cast("int")

    t = table(spark, sf, "events").select(
        "event_id", timecode.parse(byte(7, 256), byte(13, 160), byte(29, 160), byte(31, 64)).alias("t")
    )
    fine, parts = F.col("t.err").isNull(), [F.col(f"t.{c}") for c in ("hh", "mm", "ss", "ff")]
    return t.select(
        "event_id",
        F.col("t.err").alias("err"),
        F.when(fine, timecode.total_frames(*parts)).alias("frames"),
        F.when(fine, timecode.display(*parts)).alias("display"),
    )


@register(
    "consecutive_duplicates",
    """
    WITH s AS (SELECT l_orderkey AS clip, l_returnflag AS digest, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS prev FROM lineitem)
    SELECT clip, digest, count(*) AS n_pairs FROM s WHERE digest = prev AND digest <> '' GROUP BY ALL
    """,
)
def consecutive_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours with equal digests."""
    rows = lines(spark, sf).select("clip", "num", F.col("l_returnflag").alias("digest"))
    return gates.consecutive_duplicates(rows, "clip", ["num", "digest"], "digest").groupBy("clip", "digest").agg(
        F.count(F.lit(1)).alias("n_pairs")
    )


_STATS_SQL = """
  SELECT l_orderkey AS frame, min(l_quantity::BIGINT) AS lo, max(l_quantity::BIGINT) AS hi, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS total,
         sum(l_quantity::BIGINT * l_quantity::BIGINT)::BIGINT AS squares FROM lineitem GROUP BY 1
"""


@register(
    "frame_stats",
    f"""
    WITH s AS ({_STATS_SQL}), m AS (SELECT *, hi - lo AS range, n * squares - total * total AS var_num FROM s)
    SELECT frame, lo, hi, n, range, printf('%.3f', total::DOUBLE / n) AS mean, printf('%.3f', var_num::DOUBLE / (n::DOUBLE * n)) AS variance, (range < 32 OR var_num < 256 * n * n) AS black FROM m
    """,
)
def frame_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Exact statistics of a frame and its black verdict."""
    m = stats.moments(stats.frame_stats(lines(spark, sf).withColumnRenamed("clip", "frame"), ["frame"], "v"))
    return m.select(
        "frame",
        "lo",
        "hi",
        "n",
        "range",
        "mean",
        "variance",
        stats.is_black(F.col("range"), F.col("var_num"), F.col("n")).alias("black"),
    )


@register(
    "clip_moments",
    f"""
    WITH s AS ({_STATS_SQL}),
    c AS (SELECT o_custkey AS clip, count(*) AS frames, min(lo) AS lo, max(hi) AS hi, sum(n)::BIGINT AS n, sum(total)::BIGINT AS total, sum(squares)::BIGINT AS squares FROM s JOIN orders ON frame = o_orderkey GROUP BY 1)
    SELECT clip, frames, lo, hi, n, printf('%.3f', total::DOUBLE / n) AS mean, printf('%.3f', (n * squares - total * total)::DOUBLE / (n::DOUBLE * n)) AS variance FROM c
    """,
)
def clip_moments(spark: SparkSession, sf: str) -> DataFrame:
    """frames' partial sums merged to the clip."""
    frames = stats.frame_stats(lines(spark, sf).withColumnRenamed("clip", "frame"), ["frame"], "v")
    clips = frames.join(
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame"), F.col("o_custkey").alias("clip")), "frame"
    )
    return stats.moments(stats.merge_stats(clips, ["clip"])).select("clip", "frames", "lo", "hi", "n", "mean", "variance")


@register(
    "histogram_percentiles",
    """
    WITH h AS (SELECT l_returnflag, l_quantity::INT AS v, count(*) AS c FROM lineitem GROUP BY ALL),
    k AS (SELECT *, sum(c) OVER (PARTITION BY l_returnflag ORDER BY v) AS cum, sum(c) OVER (PARTITION BY l_returnflag) AS al FROM h)
    SELECT l_returnflag, max(al)::BIGINT AS n, min(v) FILTER (WHERE cum >= (7 * al + 99) // 100) AS p7, min(v) FILTER (WHERE cum >= (50 * al + 99) // 100) AS p50,
           min(v) FILTER (WHERE cum >= (95 * al + 99) // 100) AS p95 FROM k GROUP BY l_returnflag
    """,
)
def histogram_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """nearest-rank percentiles with whole-number ranks."""
    return stats.histogram_percentiles(lines(spark, sf), ["l_returnflag"], "v", [7, 50, 95])


@register(
    "estimate_band",
    """
    WITH r AS (SELECT p_brand, p_retailprice AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
    SELECT p_brand, max(n) AS n, min(x) AS lo, median(x) AS median, max(x) FILTER (WHERE r = greatest(1, least(n, ceil(0.1::DOUBLE * n)))) AS p10,
      max(x) FILTER (WHERE r = greatest(1, least(n, ceil(0.5::DOUBLE * n)))) AS p50, max(x) FILTER (WHERE r = greatest(1, least(n, ceil(0.9::DOUBLE * n)))) AS p90, max(x) AS hi
    FROM r GROUP BY p_brand
    """,
)
def estimate_band(spark: SparkSession, sf: str) -> DataFrame:
    """The band of an estimate."""
    return stats.estimate_band(table(spark, sf, "part").select("p_brand", "p_retailprice"), ["p_brand"], "p_retailprice")


@register(
    "distribution_gate",
    """
    WITH r AS (SELECT p_brand, p_size / 40.0::DOUBLE AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
    g AS (SELECT p_brand, avg(x) AS mean, max(x) FILTER (WHERE r = n // 2) AS upper_median, count(*) FILTER (WHERE x > 1.5) AS n_over FROM r GROUP BY 1)
    SELECT p_brand, round(mean, 9) AS mean, upper_median, n_over, CASE WHEN NOT mean BETWEEN 0.1 AND 1.2 THEN 'mean' WHEN NOT upper_median BETWEEN 0.1 AND 1.4 THEN 'median' WHEN n_over > 5 THEN 'outliers' ELSE 'ok' END AS gate FROM g
    """,
)
def distribution_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Three checks of a ratio distribution, the first failure named."""
    rows = table(spark, sf, "part").select("p_brand", (F.col("p_size") / 40.0).alias("x"))
    return stats.distribution_gate(rows, ["p_brand"], "x").withColumn("mean", F.round("mean", 9))


@register(
    "scalar_keys",
    r"""
    SELECT p_partkey, regexp_extract('reel/' || p_brand || '/' || replace(p_name, ' ', '_') || '_' || lpad(p_partkey::VARCHAR, 6, '0') || '.dng', '^(.*)/[^/]*$', 1) AS clip,
      p_partkey::VARCHAR AS num, p_size::DOUBLE / nullif(p_partkey % 5, 0) AS r0, coalesce(p_size::DOUBLE / nullif(p_partkey % 5, 0), 0.0) AS ratio,
      length(bin(p_size)) AS bits, regexp_replace(lower(trim(p_type)), '\s+', '-', 'g') AS slug, least(p_partkey, least(60, greatest(20, (p_partkey + 9) // 10)))::BIGINT AS k,
      (p_type LIKE '%STEEL') AS ends_, (p_type LIKE 'ECONOMY%') AS starts_, printf('%02d:%02d', (round(p_retailprice * 100 / 1000.0)::BIGINT // 60), (round(p_retailprice * 100 / 1000.0)::BIGINT % 60)) AS mmss
    FROM part
    """,
)
def scalar_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys and names."""
    p = table(spark, sf, "part")
    number = F.col("p_partkey").cast("string")
    path = F.concat(
        F.lit("reel/"),
        F.col("p_brand"),
        F.lit("/"),
        F.replace("p_name", F.lit(" "), F.lit("_")),
        F.lit("_"),
        F.lpad(number, F.greatest(F.lit(6), F.length(number)), "0"),  # to six places at least: lpad cuts what is longer
        F.lit(".dng"),
    )
    d = F.col("p_partkey") % 5
    return p.select(
        "p_partkey",
        keys.clip_of(path).alias("clip"),
        keys.frame_number(keys.stem_of(path)).cast("string").alias("num"),
        (F.col("p_size").cast("double") / F.nullif(d, F.lit(0))).alias("r0"),
        keys.ratio(F.col("p_size"), d).alias("ratio"),
        keys.bit_length(F.col("p_size")).cast("long").alias("bits"),
        keys.slug(F.col("p_type")).alias("slug"),
        keys.default_sample(F.col("p_partkey")).alias("k"),
        keys.glob_match("*STEEL", F.col("p_type")).alias("ends_"),
        keys.glob_match("ECONOMY*", F.col("p_type")).alias("starts_"),
        keys.minutes_seconds(F.col("p_retailprice") * 100).alias("mmss"),
    )


@register(
    "text_escapes",
    """
    SELECT page_id, CASE WHEN regexp_matches(html, '[,"\\r\\n]') THEN '"' || replace(html, '"', '""') || '"' ELSE html END AS csv,
      replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html_ FROM pages
    """,
)
def text_escapes(spark: SparkSession, sf: str) -> DataFrame:
    """CSV and HTML escapes of whole texts."""
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", keys.csv_field(h).alias("csv"), keys.html_escape(h).alias("html_"))


@register("digests", "SELECT doc_id, strlen(text) AS size, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def digests(spark: SparkSession, sf: str) -> DataFrame:
    """Content digests."""
    return table(spark, sf, "documents").select(
        "doc_id",
        F.octet_length("text").cast("long").alias("size"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.md5(F.col("text").cast("binary")).alias("md5"),
    )


@register("crc32c_c4")
def crc32c_c4(spark: SparkSession, sf: str) -> DataFrame:
    """CRC-32C and C4 ids, which no SQL engine here has; tested against fixed vectors."""
    from loomshed.functions.hashing import c4_id, crc32c

    content = F.col("text").cast("binary")
    return table(spark, sf, "documents").select("doc_id", crc32c(content).alias("crc32c"), c4_id(content).alias("c4"))


@register(
    "ignored_paths",
    """WITH p AS (SELECT CASE p_partkey % 3 WHEN 0 THEN '*' || p_partkey || '.dng' WHEN 1 THEN 'd' || p_partkey || '*' ELSE 'd' || p_partkey || '.dng' END AS pattern FROM part),
    n AS (SELECT doc_id, source || '/' || lang || '/d' || doc_id || '.dng' AS path FROM documents),
    s AS (SELECT doc_id, path, unnest(string_split(path, '/')) AS name FROM n),
    hit AS (SELECT DISTINCT s.doc_id FROM s JOIN p ON CASE WHEN starts_with(pattern, '*') THEN ends_with(name, pattern[2:]) WHEN ends_with(pattern, '*') THEN starts_with(name, pattern[:-2]) ELSE name = pattern END)
    SELECT doc_id, path, hit.doc_id IS NOT NULL AS ignored FROM n LEFT JOIN hit USING (doc_id)""",
)
def ignored_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every path against a pattern of every part at once."""
    from loomshed.functions.patterns import ignored

    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    pattern = (
        F.when(k % 3 == 0, F.concat(F.lit("*"), n, F.lit(".dng")))
        .when(k % 3 == 1, F.concat(F.lit("d"), n, F.lit("*")))
        .otherwise(F.concat(F.lit("d"), n, F.lit(".dng")))
    )
    path = F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".dng"))
    rows = table(spark, sf, "documents").select("doc_id", path.alias("path"))
    return ignored(rows, "path", table(spark, sf, "part").select(pattern.alias("pattern")))
