"""Queries of diffs, audits and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomshed.operators import planning, reconcile as rc
from loomshed.plans.registry import register
from loomshed.session import table

# A manifest of documents, and a disk on which some are missing, unreadable, resized or altered.
_MANIFEST = "SELECT doc_id, n_chars AS size, sha256(text) AS sha256, CASE WHEN doc_id % 3 = 0 THEN (doc_id * 31 % 1000)::VARCHAR END AS crc32c FROM documents"
_DISK = """SELECT doc_id, CASE WHEN doc_id % 31 <> 0 THEN n_chars + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END END AS d_size, CASE WHEN doc_id % 11 <> 0 THEN sha256(CASE WHEN doc_id % 17 = 0 THEN text || '!' ELSE text END) END AS d_sha256,
  (doc_id * 31 % 1000 + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END)::VARCHAR AS d_crc32c, doc_id % 23 <> 0 AS is_file FROM documents WHERE doc_id % 7 <> 0"""


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.col("n_chars").alias("size"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.when(d % 3 == 0, (d * 31 % 1000).cast("string")).alias("crc32c"),
    )


def disk(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    text = F.when(d % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return (
        table(spark, sf, "documents")
        .filter(d % 7 != 0)
        .select(
            "doc_id",
            F.when(d % 31 != 0, F.col("n_chars") + F.when(d % 13 == 0, 1).otherwise(0)).alias("d_size"),
            F.when(d % 11 != 0, F.sha2(text.cast("binary"), 256)).alias("d_sha256"),
            (d * 31 % 1000 + F.when(d % 19 == 0, 1).otherwise(0)).cast("string").alias("d_crc32c"),
            (d % 23 != 0).alias("is_file"),
        )
    )


_AUDIT = """WHEN on_disk IS NULL THEN 'missing' WHEN d_size IS NULL THEN 'unreadable' WHEN size <> d_size THEN 'size' WHEN d_sha256 IS NULL THEN 'unreadable'
  WHEN sha256 <> d_sha256 THEN 'sha256' WHEN crc32c IS NOT NULL AND crc32c <> d_crc32c THEN 'crc32c'"""


def _audit_sql(cases: str, otherwise: str) -> str:
    return f"WITH m AS ({_MANIFEST}), d AS (SELECT *, true AS on_disk FROM ({_DISK})) SELECT doc_id, CASE {cases} ELSE '{otherwise}' END AS verdict FROM m LEFT JOIN d USING (doc_id)"


@register(
    "sidecar_audit",
    _audit_sql(_AUDIT, "ok"),
)
def sidecar_audit(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest against disk, first failing check."""
    return rc.audit(manifest(spark, sf), disk(spark, sf), "doc_id")


@register(
    "source_classes",
    _audit_sql(
        "WHEN coalesce(is_file, false) = false THEN 'MISSING' WHEN size <> d_size THEN 'SIZE' WHEN d_sha256 IS NULL THEN 'READ_ERROR' WHEN sha256 <> d_sha256 THEN 'SHA'",
        "OK",
    ),
)
def source_classes(spark: SparkSession, sf: str) -> DataFrame:
    """A source record against its card."""
    return rc.source_classes(manifest(spark, sf), disk(spark, sf), "doc_id")


@register(
    "repair_classes",
    _audit_sql(
        "WHEN d_sha256 IS NULL THEN 'Missing' WHEN size <> d_size THEN 'SizeMismatch' WHEN sha256 <> d_sha256 THEN 'ShaMismatch'",
        "Clean",
    ),
)
def repair_classes(spark: SparkSession, sf: str) -> DataFrame:
    """What a repair would have to do."""
    return rc.repair_classes(manifest(spark, sf), disk(spark, sf), "doc_id")


@register(
    "member_verdicts",
    f"""WITH m AS (SELECT doc_id, size, CASE WHEN doc_id % 29 <> 0 THEN sha256 END AS sha256 FROM ({_MANIFEST})), d AS (SELECT *, true AS on_disk FROM ({_DISK}))
    SELECT doc_id, CASE WHEN sha256 IS NULL THEN 'SRC_UNREADABLE' WHEN on_disk IS NULL THEN 'MISSING' WHEN d_sha256 IS NULL THEN 'DST_UNREADABLE' WHEN size <> d_size THEN 'SIZE' WHEN sha256 <> d_sha256 THEN 'SHA' ELSE 'OK' END AS verdict
    FROM m LEFT JOIN d USING (doc_id)""",
)
def member_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Copies against sources."""
    m = manifest(spark, sf).withColumn("sha256", F.when(F.col("doc_id") % 29 != 0, F.col("sha256")))
    return rc.member_verdicts(m, disk(spark, sf), "doc_id")


_REVERIFY = """WHEN d.doc_id IS NULL THEN 'MISSING' WHEN d_size IS NULL THEN 'UNREADABLE' WHEN size <> d_size THEN 'SIZE' WHEN m.sha256 = '-' THEN 'OK' WHEN d_sha256 IS NULL THEN 'UNREADABLE'
  WHEN m.sha256 <> d_sha256 THEN 'SHA' ELSE 'OK'"""


@register(
    "member_reverify",
    f"""WITH m AS (SELECT doc_id, size, CASE WHEN doc_id % 5 = 0 THEN '-' ELSE sha256 END AS sha256 FROM ({_MANIFEST})), d AS ({_DISK})
    SELECT m.doc_id, CASE {_REVERIFY} END AS verdict FROM m LEFT JOIN d ON m.doc_id = d.doc_id""",
)
def member_reverify(spark: SparkSession, sf: str) -> DataFrame:
    """Members against disk; '-' matches any digest."""
    m = manifest(spark, sf).withColumn("sha256", F.when(F.col("doc_id") % 5 == 0, "-").otherwise(F.col("sha256")))
    return rc.reverify(m, disk(spark, sf), ["doc_id"])


@register(
    "offload_reverify",
    f"""WITH m AS ({_MANIFEST}), d AS ({_DISK}), r AS (SELECT source AS dest, doc_id FROM documents)
    SELECT dest, m.doc_id, CASE WHEN dest IN ('src2', 'src5') OR dest IS NULL THEN 'DEST_MISSING' {_REVERIFY} END AS verdict FROM m JOIN r USING (doc_id) LEFT JOIN d ON m.doc_id = d.doc_id""",
)
def offload_reverify(spark: SparkSession, sf: str) -> DataFrame:
    """Copies at several destinations; every row of an absent destination is bad."""
    dest = table(spark, sf, "documents").select("doc_id", F.col("source").alias("dest"))
    here = dest.select("dest").distinct().filter(~F.col("dest").isin("src2", "src5"))
    return rc.reverify(manifest(spark, sf).join(dest, "doc_id"), disk(spark, sf).join(dest, "doc_id"), ["dest", "doc_id"], here)


@register(
    "audit_summary",
    f"""WITH v AS ({_audit_sql(_AUDIT, "ok")})
    SELECT source AS clip, count(*) AS total, count(*) FILTER (WHERE verdict = 'ok') AS ok, count(*) FILTER (WHERE verdict <> 'ok') AS dirty,
      CASE WHEN count(*) FILTER (WHERE verdict <> 'ok') = 0 THEN 'UNLOCKED' ELSE 'REFUSED' END AS card FROM v JOIN documents USING (doc_id) GROUP BY 1""",
)
def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Clean and dirty rows of each clip, and whether its card may be cleared."""
    v = rc.audit(manifest(spark, sf), disk(spark, sf), "doc_id").join(
        table(spark, sf, "documents").select("doc_id", F.col("source").alias("clip")), "doc_id"
    )
    ok = F.count_if(F.col("verdict") == "ok")
    return v.groupBy("clip").agg(
        F.count(F.lit(1)).alias("total"), ok.alias("ok"), F.count_if(F.col("verdict") != "ok").alias("dirty")
    ).withColumn("card", F.when(F.col("dirty") == 0, "UNLOCKED").otherwise("REFUSED"))


_SIDE = "SELECT l_orderkey AS clip, l_linenumber AS stem, {v} AS v FROM lineitem WHERE {w} GROUP BY 1, 2"
_A, _B = _SIDE.format(v="max(l_quantity)::INT", w="l_suppkey % 10 <> 1"), _SIDE.format(
    v="CASE WHEN l_orderkey % 97 <> 0 THEN max(l_quantity)::INT END", w="l_suppkey % 10 <> 2"
)


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("clip"),
        F.col("l_linenumber").alias("stem"),
        F.col("l_quantity").cast("int").alias("v"),
        "l_suppkey",
    )

    def best(x):
        return x.groupBy("clip", "stem").agg(F.max("v").alias("v"))

    a, b = best(lines.filter("l_suppkey % 10 <> 1")), best(lines.filter("l_suppkey % 10 <> 2"))
    return a, b.withColumn("v", F.when(F.col("clip") % 97 != 0, F.col("v")))


_DIFF = f"""WITH a AS (SELECT *, true AS ia FROM ({_A})), b AS (SELECT *, true AS ib FROM ({_B})),
  d AS (SELECT clip, stem, a.v AS va, b.v AS vb, CASE WHEN ia IS NULL OR ib IS NULL THEN 'MISSING' WHEN a.v IS NULL OR b.v IS NULL THEN 'FAILED' WHEN a.v <> b.v THEN 'DELTA' ELSE 'IDENTICAL' END AS verdict
        FROM a FULL JOIN b USING (clip, stem))"""


@register("frame_diff", f"{_DIFF} SELECT * FROM d")
def frame_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Full outer diff of two collections."""
    return rc.diff(*_sides(spark, sf), ["clip", "stem"], "v")


@register(
    "diff_run",
    f"""{_DIFF}, c AS (SELECT count(*) FILTER (WHERE verdict = 'IDENTICAL') AS n_identical, count(*) FILTER (WHERE verdict = 'DELTA') AS n_delta, count(*) FILTER (WHERE verdict = 'MISSING') AS n_missing, count(*) FILTER (WHERE verdict = 'FAILED') AS n_failed FROM d)
    SELECT *, CASE WHEN n_missing + n_failed > 0 THEN 'FAIL' WHEN n_delta > 0 THEN 'DELTA' ELSE 'IDENTICAL' END AS run, CASE WHEN n_missing + n_failed > 0 THEN 1 ELSE 0 END AS exit_code FROM c""",
)
def diff_run(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict of a whole diff."""
    return rc.run_verdict(
        rc.verdict_counts(rc.diff(*_sides(spark, sf), ["clip", "stem"], "v"), ["IDENTICAL", "DELTA", "MISSING", "FAILED"])
    )


@register(
    "camera_resolution",
    """WITH p AS (SELECT * FROM part WHERE p_partkey % 40 = 0),
    l1 AS (SELECT DISTINCT p_brand, true AS a FROM p), l2 AS (SELECT DISTINCT p_brand, p_type, true AS b FROM p), l3 AS (SELECT DISTINCT p_brand, p_type, p_size, true AS c FROM p)
    SELECT p_partkey, CASE WHEN a IS NULL THEN 1 WHEN b IS NULL THEN 2 WHEN c IS NULL THEN 3 ELSE 0 END AS failed_level
    FROM part LEFT JOIN l1 USING (p_brand) LEFT JOIN l2 USING (p_brand, p_type) LEFT JOIN l3 USING (p_brand, p_type, p_size)""",
)
def camera_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """The first level of a cascading lookup that fails."""
    part = table(spark, sf, "part")
    return rc.resolve_levels(
        part, part.filter("p_partkey % 40 = 0"), [["p_brand"], ["p_type"], ["p_size"]]
    ).select("p_partkey", "failed_level")


_RESUME = """frames AS (SELECT doc_id, sha256(text) AS src_sha FROM documents), outs AS (SELECT doc_id, md5(text) AS out_sha FROM documents WHERE doc_id % 5 <> 0),
  side AS (SELECT doc_id, md5(text || CASE WHEN doc_id % 9 = 0 THEN '?' ELSE '' END) AS side_sha FROM documents JOIN labels USING (doc_id)),
  maps AS (SELECT doc_id, sha256(text || CASE WHEN doc_id % 8 = 0 THEN '?' ELSE '' END) AS map_sha FROM documents WHERE doc_id % 2 = 0)"""


@register(
    "resume_plan",
    f"WITH {_RESUME} SELECT doc_id, coalesce(out_sha IS NOT NULL AND side_sha IS NOT NULL AND side_sha = out_sha AND (map_sha IS NULL OR map_sha = src_sha), false) AS skip FROM frames LEFT JOIN outs USING (doc_id) LEFT JOIN side USING (doc_id) LEFT JOIN maps USING (doc_id)",
)
def resume_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Frames that a resumed run may skip."""
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    sha, md5 = (lambda x: F.sha2(x.cast("binary"), 256)), (lambda x: F.md5(x.cast("binary")))

    def noisy(m):
        return F.concat("text", F.when(k % m == 0, "?").otherwise(""))

    side = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id").select("doc_id", md5(noisy(9)).alias("side_sha"))
    return rc.resume_plan(
        d.select("doc_id", sha(F.col("text")).alias("src_sha")),
        d.filter(k % 5 != 0).select("doc_id", md5(F.col("text")).alias("out_sha")),
        side,
        d.filter(k % 2 == 0).select("doc_id", sha(noisy(8)).alias("map_sha")),
        "doc_id",
    )


@register("stale_sidecar", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0)")
def stale_sidecar(spark: SparkSession, sf: str) -> DataFrame:
    """Sidecar rows without a frame."""
    return rc.stale_rows(
        table(spark, sf, "labels"), table(spark, sf, "documents").filter("doc_id % 4 <> 0").select("doc_id"), "doc_id"
    )


@register(
    "ingest_rederive",
    """WITH r AS (SELECT o_custkey AS clip, count(*) AS frames, min(o_orderkey) AS first, CASE WHEN o_custkey % 4 <> 0 THEN max(o_orderkey) END AS last, true AS ir FROM orders WHERE o_custkey % 9 <> 0 GROUP BY 1),
    d AS (SELECT o_custkey AS clip, count(*) AS frames, min(o_orderkey) AS first, CASE WHEN o_custkey % 8 <> 0 THEN max(o_orderkey) END AS last, true AS id FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY 1)
    SELECT clip, CASE WHEN id IS NULL THEN 'recorded only' WHEN ir IS NULL THEN 'derived only' ELSE coalesce(nullif(concat_ws(',', CASE WHEN r.frames IS DISTINCT FROM d.frames THEN 'frames' END,
      CASE WHEN r.first IS DISTINCT FROM d.first THEN 'first' END, CASE WHEN r.last IS DISTINCT FROM d.last THEN 'last' END), ''), 'same') END AS verdict FROM r FULL JOIN d USING (clip)""",
)
def ingest_rederive(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded clips against re-derived ones."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("clip"), "o_orderkey")

    def roll(rows, m):
        return rows.groupBy("clip").agg(
            F.count(F.lit(1)).alias("frames"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")
        ).withColumn("last", F.when(F.col("clip") % m != 0, F.col("last")))

    return rc.rederived(
        roll(orders.filter("clip % 9 <> 0"), 4),
        roll(orders.filter("o_orderkey % 50 <> 0"), 8),
        "clip",
        ["frames", "first", "last"],
    )


@register(
    "reel_row_check",
    """WITH reels AS (SELECT c_custkey AS clip, string_agg('a' || o_orderkey, ', ' ORDER BY o_orderkey) AS archive, string_agg(md5(o_orderkey::VARCHAR), ', ' ORDER BY o_orderkey) AS sha FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1),
    rows_ AS (SELECT clip, unnest(string_split(archive, ', ')) AS a, unnest(string_split(sha, ', ')) AS s FROM reels),
    disk AS (SELECT 'a' || o_orderkey AS a, md5((o_orderkey + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END)::VARCHAR) AS d FROM orders WHERE o_orderkey % 15 <> 0)
    SELECT clip, a AS archive, CASE WHEN d IS NULL THEN 'missing' WHEN d <> s THEN 'sha256' ELSE 'ok' END AS verdict FROM rows_ LEFT JOIN disk USING (a)""",
)
def reel_row_check(spark: SparkSession, sf: str) -> DataFrame:
    """Parallel lists of a reel row, taken apart and looked up."""
    from loomshed.sources.records import reel_archives

    o = table(spark, sf, "orders")

    def md5(c):
        return F.md5(c.cast("string").cast("binary"))

    def joined(c):
        return F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), c), ", ")

    reels = o.groupBy(F.col("o_custkey").alias("clip")).agg(
        joined(lambda x: F.concat(F.lit("a"), x.cast("string"))).alias("archive"), joined(md5).alias("archive_sha256")
    )
    k = F.col("o_orderkey")
    held = o.filter(k % 15 != 0).select(
        F.concat(F.lit("a"), k.cast("string")).alias("archive"), md5(k + F.when(k % 10 == 0, 1).otherwise(0)).alias("d")
    )
    return rc.reel_rows(reel_archives(reels), held)


@register(
    "source_sha_resolution",
    "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN md5(text) END, CASE WHEN l.quality = 1 THEN md5(lang) END, CASE WHEN doc_id % 2 = 0 THEN md5(source) END, '-') AS sha FROM documents LEFT JOIN labels l USING (doc_id)",
)
def source_sha_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """The first known digest of several."""
    k, md5 = F.col("doc_id"), lambda c: F.md5(F.col(c).cast("binary"))
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.select(
        "doc_id",
        rc.known_digest(
            F.when(k % 3 == 0, md5("text")), F.when(F.col("quality") == 1, md5("lang")), F.when(k % 2 == 0, md5("source"))
        ).alias("sha"),
    )


@register(
    "fan_out",
    """WITH f AS (SELECT doc_id, n_chars AS size, md5(text) AS sha256 FROM documents), e AS (SELECT doc_id, r_name, n_chars AS es, md5(text || CASE WHEN doc_id % 4 = 0 THEN '!' ELSE '' END) AS eh FROM documents, region WHERE (doc_id + r_regionkey) % 3 = 0)
    SELECT f.doc_id, r.r_name, CASE WHEN es = size AND eh = sha256 THEN 'skip' ELSE 'copy' END AS action FROM f CROSS JOIN region r LEFT JOIN e ON e.doc_id = f.doc_id AND e.r_name = r.r_name""",
)
def fan_out(spark: SparkSession, sf: str) -> DataFrame:
    """Every file for every destination."""
    d, k = table(spark, sf, "documents"), F.col("doc_id")

    def md5(c):
        return F.md5(c.cast("binary"))

    files = d.select("doc_id", F.col("n_chars").alias("size"), md5(F.col("text")).alias("sha256"))
    dests = table(spark, sf, "region")
    there = rc.each_dest(d, dests, "r_name").join(dests, "r_name").filter((k + F.col("r_regionkey")) % 3 == 0)
    held = there.select(
        "doc_id",
        "r_name",
        F.col("n_chars").alias("size"),
        md5(F.concat("text", F.when(k % 4 == 0, "!").otherwise(""))).alias("sha256"),
    )
    return rc.fan_out(files, dests, held, "doc_id", "r_name")


@register(
    "path_guards",
    """WITH p AS (SELECT n_nationkey AS i, '/' || r_name || CASE WHEN n_nationkey % 2 = 0 THEN '/' || n_name ELSE '' END AS path FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT a.i AS i, b.i AS j, CASE WHEN a.path = b.path THEN 'same' WHEN starts_with(b.path, a.path || '/') THEN 'contains' ELSE 'inside' END AS guard FROM p a JOIN p b ON a.i < b.i
    WHERE a.path = b.path OR starts_with(b.path, a.path || '/') OR starts_with(a.path, b.path || '/')""",
)
def path_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Equal and nested folders, found by joining each path's own prefixes, not all pairs."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    p = n.select(
        F.col("n_nationkey").alias("i"),
        F.concat(
            F.lit("/"), "r_name", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("/"), "n_name")).otherwise("")
        ).alias("path"),
    )
    return rc.nested_paths(p, "i", "path").toDF("i", "j", "guard")


@register(
    "nearest_verified",
    """WITH f AS (SELECT DISTINCT conv_id AS clip, turn AS o, role = 'assistant' OR turn = 0 OR conv_id % 3 = 0 AND turn % 5 = 4 AS v FROM conversations),
    one AS (SELECT clip, o, bool_or(v) AS v FROM f GROUP BY ALL),
    c AS (SELECT a.clip, a.o, b.o AS n, CASE WHEN (a.o - b.o) % 2 = 0 THEN abs(a.o - b.o) ELSE a.o + 1 END AS d, CASE WHEN b.o < a.o THEN 0 ELSE 1 END AS side
          FROM one a JOIN one b ON a.clip = b.clip AND a.o <> b.o AND b.v AND ((a.o - b.o) % 2 = 0 OR b.o = 0 AND a.o % 2 = 1)),
    r AS (SELECT *, row_number() OVER (PARTITION BY clip, o ORDER BY d, side, n) AS k FROM c)
    SELECT one.clip, one.o, r.n AS neighbour FROM one LEFT JOIN r ON r.clip = one.clip AND r.o = one.o AND k = 1""",
)
def nearest_verified(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest verified neighbour of the same parity, as an as-of join without pairs."""
    t, c = F.col("turn"), F.col("conv_id")
    rows = table(spark, sf, "conversations").select(
        c.alias("clip"), t.alias("o"), ((F.col("role") == "assistant") | (t == 0) | ((c % 3 == 0) & (t % 5 == 4))).alias("v")
    ).groupBy("clip", "o").agg(F.bool_or("v").alias("v"))
    return rc.nearest_verified(rows, "clip", "o", "v")


@register(
    "run_rollup",
    """SELECT l_orderkey AS clip, sum(CASE WHEN l_linestatus = 'O' OR l_returnflag = 'R' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS in_bytes, sum(CASE WHEN l_linestatus = 'O' THEN (l_quantity * 2)::BIGINT ELSE 0 END)::BIGINT AS out_bytes,
      count(*) FILTER (WHERE l_linestatus = 'O') AS done, count(*) FILTER (WHERE l_linestatus <> 'O' AND l_returnflag = 'R') AS skipped, count(*) FILTER (WHERE l_linestatus <> 'O' AND l_returnflag <> 'R') AS failed,
      CASE WHEN sum(CASE WHEN l_linestatus = 'O' THEN l_quantity * 2 ELSE 0 END) > 0 THEN sum(CASE WHEN l_linestatus = 'O' OR l_returnflag = 'R' THEN l_quantity ELSE 0 END)::DOUBLE / sum(CASE WHEN l_linestatus = 'O' THEN l_quantity * 2 ELSE 0 END) ELSE 0.0 END AS ratio
    FROM lineitem GROUP BY 1""",
)
def run_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Input of done and skipped frames, output of done ones."""
    from loomshed.functions.keys import ratio

    outcome = F.when(F.col("l_linestatus") == "O", "done").when(F.col("l_returnflag") == "R", "skipped").otherwise("failed")
    q = F.col("l_quantity").cast("long")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("clip"), outcome.alias("outcome"), q.alias("q"))

    def is_(*v):
        return F.col("outcome").isin(*v)

    return rows.groupBy("clip").agg(
        F.sum(F.when(is_("done", "skipped"), F.col("q")).otherwise(0)).alias("in_bytes"),
        F.sum(F.when(is_("done"), F.col("q") * 2).otherwise(0)).alias("out_bytes"),
        *[F.count_if(is_(v)).alias(v) for v in ("done", "skipped", "failed")],
    ).withColumn("ratio", ratio(F.col("in_bytes"), F.col("out_bytes")))


_LEDGER = """SELECT floor(epoch(ts))::BIGINT AS created, CASE event_id % 4 WHEN 0 THEN 'bake' WHEN 1 THEN 'bake-iso' ELSE 'audit' END AS command, 'reel' || (user_id % 60) AS input, 'reel' || (user_id % 70) AS output, CASE WHEN event_id % 3 = 0 THEN 'FAIL' ELSE 'OK' END AS verdict FROM events"""
_NOW = 1_900_000_000


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    command = F.when(e % 4 == 0, "bake").when(e % 4 == 1, "bake-iso").otherwise("audit")
    return table(spark, sf, "events").select(
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created"),
        command.alias("command"),
        F.concat(F.lit("reel"), (u % 60).cast("string")).alias("input"),
        F.concat(F.lit("reel"), (u % 70).cast("string")).alias("output"),
        F.when(e % 3 == 0, "FAIL").otherwise("OK").alias("verdict"),
    )


@register(
    "ledger_rotation",
    f"""WITH l AS ({_LEDGER}), reels AS (SELECT DISTINCT output AS reel FROM l WHERE command IN ('bake', 'bake-iso') AND verdict = 'OK'), a AS (SELECT input AS reel, max(created) AS last FROM l WHERE command = 'audit' GROUP BY 1),
    g AS (SELECT reel, greatest({_NOW} - last, 0) // 86400 AS age_days FROM reels LEFT JOIN a USING (reel)) SELECT * FROM g WHERE age_days IS NULL OR age_days > 30""",
)
def ledger_rotation(spark: SparkSession, sf: str) -> DataFrame:
    """Reels whose last audit is too long ago."""
    return rc.rotation(_ledger(spark, sf), 30, _NOW)


@register(
    "ledger_since",
    f"WITH l AS ({_LEDGER}), m AS (SELECT max(created) AS now FROM l) SELECT l.* FROM l, m WHERE created >= now - 3 * 86400",
)
def ledger_since(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the last days, the border included."""
    rows = _ledger(spark, sf)
    now = rows.agg(F.max("created")).first()[0] or 0
    return rows.filter(F.col("created") >= now - 3 * 86400)


@register(
    "job_rollup",
    """WITH clips AS (SELECT o_orderkey AS clip FROM orders) SELECT clip, count(l_orderkey) AS files, coalesce(sum(l_quantity::BIGINT), 0)::BIGINT AS bytes FROM clips LEFT JOIN lineitem ON l_orderkey = clip GROUP BY 1""",
)
def job_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """a job's clips, those without files too."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("clip")).agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.col("l_quantity").cast("long")).alias("bytes")
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("clip")).join(rows, "clip", "left").fillna(
        0, ["files", "bytes"]
    )


@register(
    "batch_measurement",
    """SELECT l_linenumber AS w, CASE WHEN grouping(l_returnflag) = 0 THEN l_returnflag END AS bits, count(*) AS frames, count(DISTINCT l_orderkey) AS clips FROM lineitem GROUP BY GROUPING SETS ((l_linenumber, l_returnflag), (l_linenumber))""",
)
def batch_measurement(spark: SparkSession, sf: str) -> DataFrame:
    """frames and distinct clips at two grains, in one pass of grouping sets."""
    table(spark, sf, "lineitem").createOrReplaceTempView("loomshed_lineitem")
    return spark.sql(
        "SELECT l_linenumber AS w, l_returnflag AS bits, count(*) AS frames, count(DISTINCT l_orderkey) AS clips FROM loomshed_lineitem GROUP BY l_linenumber, l_returnflag GROUPING SETS ((l_linenumber, l_returnflag), (l_linenumber))"
    )


@register(
    "merge_measurements",
    "WITH m AS (SELECT l_suppkey % 3 AS root, l_linenumber AS w, count(*) AS frames, count(DISTINCT l_orderkey) AS clips FROM lineitem GROUP BY ALL) SELECT w, sum(frames)::BIGINT AS frames, sum(clips)::BIGINT AS clips FROM m GROUP BY w",
)
def merge_measurements(spark: SparkSession, sf: str) -> DataFrame:
    """roots' counts added, clips not made distinct again."""
    one = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 3).alias("root"), F.col("l_linenumber").alias("w")).agg(
        F.count(F.lit(1)).alias("frames"), F.countDistinct("l_orderkey").alias("clips")
    )
    return one.groupBy("w").agg(F.sum("frames").alias("frames"), F.sum("clips").alias("clips"))


@register(
    "fresh_wins_union",
    """WITH p AS (SELECT l_orderkey AS f, max(l_quantity)::INT AS v FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1), n AS (SELECT l_orderkey AS f, min(l_quantity)::INT AS v FROM lineitem WHERE l_suppkey % 5 = 0 GROUP BY 1)
    SELECT f, coalesce(n.v, p.v) AS v FROM p FULL JOIN n USING (f)""",
)
def fresh_wins_union(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier rows with fresh ones over them."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("f"), "l_suppkey", F.col("l_quantity").cast("int").alias("v")
    )
    return rc.union_fresh(
        rows.filter("l_suppkey % 3 = 0").groupBy("f").agg(F.max("v").alias("v")),
        rows.filter("l_suppkey % 5 = 0").groupBy("f").agg(F.min("v").alias("v")),
        "f",
    )


@register(
    "partial_set",
    "SELECT o_orderkey AS f FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_suppkey % 3 = 0 EXCEPT SELECT l_orderkey FROM lineitem WHERE l_suppkey % 5 = 0",
)
def partial_set(spark: SparkSession, sf: str) -> DataFrame:
    """Frames that no record covers."""
    rows = table(spark, sf, "lineitem").filter("l_suppkey % 3 = 0 or l_suppkey % 5 = 0").select(F.col("l_orderkey").alias("f"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("f")).join(rows, "f", "left_anti").distinct()


@register(
    "name_collision",
    "SELECT split_part(url, '/', 4) AS name FROM pages WHERE page_id % 2 = 0 INTERSECT SELECT split_part(url, '/', 4) FROM pages WHERE page_id % 2 = 1",
)
def name_collision(spark: SparkSession, sf: str) -> DataFrame:
    """Top-level names that two sources share."""

    def top(r):
        return table(spark, sf, "pages").filter(F.col("page_id") % 2 == r).select(
            F.split_part("url", F.lit("/"), F.lit(4)).alias("name")
        )

    return top(0).intersect(top(1))


@register("selection_universe", "SELECT DISTINCT source AS clip FROM documents WHERE n_chars > 2000")
def selection_universe(spark: SparkSession, sf: str) -> DataFrame:
    """Clips with a frame."""
    return table(spark, sf, "documents").filter("n_chars > 2000").select(F.col("source").alias("clip")).distinct()


@register(
    "applied_selection",
    "SELECT doc_id, source FROM documents WHERE source IN (SELECT DISTINCT source FROM documents) AND source NOT IN ('src1', 'src3')",
)
def applied_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of the chosen clips."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    return planning.apply_selection(d, planning.resolve_selection(d, "source", None, planning.parse_list("src1, src3")), "source")


@register(
    "content_rows_identical",
    """WITH a AS (SELECT o_custkey AS reel, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderstatus AS c FROM orders WHERE o_orderkey % 2 = 0),
    b AS (SELECT o_custkey AS reel, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderstatus AS c FROM orders WHERE o_orderkey % 2 = 1)
    SELECT reel, bool_and(a.c IS NOT DISTINCT FROM b.c) AS same FROM a FULL JOIN b USING (reel, i) GROUP BY reel""",
)
def content_rows_identical(spark: SparkSession, sf: str) -> DataFrame:
    """Two reels' rows, compared place by place."""
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "reel")
    place = F.row_number().over(Window.partitionBy("reel").orderBy("o_orderkey")).alias("i")

    def side(r, c):
        return o.filter(F.col("o_orderkey") % 2 == r).select("reel", place, F.col("o_orderstatus").alias(c))

    return side(0, "a").join(side(1, "b"), ["reel", "i"], "full").groupBy("reel").agg(
        F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("same")
    )


_PINS = """SELECT p_name || p_partkey AS component, p_type AS expected, CASE p_size % 5 WHEN 0 THEN 'version-contains --version' WHEN 1 THEN 'lock-grep ' || p_brand WHEN 2 THEN 'toml-grep version'
  WHEN 3 THEN 'sha256-equal' ELSE 'version-contains -V' END AS probe, p_partkey AS k, p_size AS s, p_brand AS b FROM part"""


@register(
    "pin_check",
    f"""WITH pins AS ({_PINS}), found AS (SELECT component, CASE WHEN k % 7 = 0 THEN 'other' ELSE b END AS name, CASE WHEN k % 4 = 0 THEN 'v. ' || expected || ' x' ELSE expected END AS value FROM pins WHERE k % 3 <> 0),
    told AS (SELECT p.component, p.expected, p.probe, count(f.value) AS known, bool_and(CASE WHEN starts_with(probe, 'version') THEN contains(f.value, p.expected) ELSE f.value = p.expected END) AS fits
      FROM pins p LEFT JOIN found f ON f.component = p.component AND (starts_with(probe, 'version') OR f.name = split_part(p.probe, ' ', 2)) GROUP BY ALL)
    SELECT component, expected, probe, CASE WHEN starts_with(probe, 'version') AND known = 0 THEN 'skip-OK' WHEN starts_with(probe, 'version') OR starts_with(probe, 'lock') THEN CASE WHEN coalesce(fits, false) THEN 'OK' ELSE 'DRIFT' END
      WHEN starts_with(probe, 'toml') THEN 'OK' ELSE 'skip-OK' END AS state FROM told""",
)
def pin_check(spark: SparkSession, sf: str) -> DataFrame:
    """Each pin's probe decides how what runs is compared; what cannot be resolved passes as skipped."""
    k, s = F.col("p_partkey"), F.col("p_size")
    probe = (
        F.when(s % 5 == 0, "version-contains --version")
        .when(s % 5 == 1, F.concat(F.lit("lock-grep "), "p_brand"))
        .when(s % 5 == 2, "toml-grep version")
        .when(s % 5 == 3, "sha256-equal")
        .otherwise("version-contains -V")
    )
    part = table(spark, sf, "part").withColumn("component", F.concat("p_name", k.cast("string")))
    pins = part.select("component", F.col("p_type").alias("expected"), probe.alias("probe"))
    value = F.when(k % 4 == 0, F.concat(F.lit("v. "), "p_type", F.lit(" x"))).otherwise(F.col("p_type"))
    found = part.filter(k % 3 != 0).select(
        "component", F.when(k % 7 == 0, "other").otherwise(F.col("p_brand")).alias("name"), value.alias("value")
    )
    return rc.pin_states(pins, found)


@register(
    "restore_plan",
    """WITH f AS (SELECT source AS clip, doc_id, dense_rank() OVER (PARTITION BY source ORDER BY doc_id) AS n, n_chars FROM documents), m AS (SELECT doc_id, quality FROM labels)
    SELECT clip, doc_id, n, CASE WHEN quality IS NULL THEN 'no master' WHEN quality = 0 THEN 'master bad' ELSE 'restore' END AS action FROM f LEFT JOIN m USING (doc_id) WHERE n_chars > 1000""",
)
def restore_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Offenders by place in their clip, and whether a verified master has them."""
    f = planning.with_dense_place(
        table(spark, sf, "documents").select(F.col("source").alias("clip"), "doc_id", "n_chars"), "clip", "doc_id"
    ).filter("n_chars > 1000")
    master = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("fine"))
    return rc.restore_actions(f, master, "doc_id", "fine").select("clip", "doc_id", "n", "action")
