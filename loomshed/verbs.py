"""One-call jobs over folders and records, each composed of the library's operators.

A job returns DataFrames: rows with a verdict each, and a summary of one row. None
decodes a payload or writes a container; those are other programs' work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomshed.functions import keys
from loomshed.operators import gates, planes, planning, reconcile as rc, stats
from loomshed.scratch import many, placed, stored
from loomshed.sources import frames, records, reports, trees


@dataclass
class Found:
    """What a job found: a verdict a row, and one row for all."""

    rows: DataFrame
    summary: DataFrame


def hashed(found: DataFrame, crc: bool = False) -> DataFrame:
    """(rel, clip, stem, d_size, d_sha256) of scanned files, and with ``crc`` d_crc32c; contents are read once, where they lie."""
    told = frames.digests(found, crc)
    return told.withColumn("d_crc32c", F.lower(F.lpad(F.hex("d_crc32c"), 8, "0"))) if crc else told


def _folder(root: str, manifest: Column) -> Column:
    """The folder of a record below the root, '' for the root itself."""
    tail = F.regexp_extract(manifest, rf"/{root.rstrip('/').rsplit('/', 1)[-1]}/(.*)$", 1)
    return keys.clip_of(tail)


def _under(folder: Column, file: Column) -> Column:
    return F.when(folder == "", file).otherwise(F.concat(folder, F.lit("/"), file))


def _summary(rows: DataFrame, good: str) -> DataFrame:
    bad = F.count_if(F.col("verdict") != good)
    told = rows.agg(F.count(F.lit(1)).alias("rows"), bad.alias("bad"))
    return told.withColumns(
        {"verdict": F.when(F.col("bad") == 0, "PASS").otherwise("FAIL"), "exit_code": F.when(F.col("bad") == 0, 0).otherwise(1)}
    )


def verify_checksums(spark: SparkSession, root: str) -> Found:
    """Files of a folder against its checksum sidecars, each at any depth."""
    listed, bad = records.read_checksums(spark, root, glob="*.checksums.tsv")
    listed = listed.select(
        _under(_folder(root, F.col("manifest")), F.col("file")).alias("rel"),
        "size",
        F.lower("sha256").alias("sha256"),
        F.lower("crc32c").alias("crc32c"),
    )
    disk = hashed(frames.files(spark, root), crc=True).select("rel", "d_size", "d_sha256", "d_crc32c")
    rows = rc.audit(listed, disk, "rel").unionByName(bad.select(F.col("line").alias("rel"), F.lit("no row").alias("verdict")))
    return Found(rows, _summary(rows, "ok"))


def audit(spark: SparkSession, root: str, source: str | None = None, dests: dict[str, str] | None = None) -> Found:
    """Every record of a folder against disk: checksums, offload manifests against their destinations, and, with a ``source``, source records.

    ``dests`` gives the folder where a recorded destination is now; one that is not named is missing.
    Rows are (record, rel, verdict), and each kind keeps its own verdicts.
    """
    checks = verify_checksums(spark, root).rows.select(F.lit("checksums").alias("record"), "rel", F.col("verdict"))
    out = checks.withColumn("good", F.col("verdict") == "ok")
    if dests is not None:
        listed, _ = records.read_offload(spark, root, glob="*.offload-manifest.tsv")
        listed = listed.select("dest", F.col("file").alias("rel"), "size", F.lower("source_sha256").alias("sha256"))
        here = spark.createDataFrame([(d,) for d in dests], "dest string") if dests else listed.select("dest").limit(0)
        held = None
        for dest, folder in dests.items():
            one = hashed(frames.files(spark, folder)).select(F.lit(dest).alias("dest"), "rel", "d_size", "d_sha256")
            held = one if held is None else held.unionByName(one)
        if held is None:
            held = listed.select("dest", "rel", F.col("size").alias("d_size"), F.col("sha256").alias("d_sha256")).limit(0)
        again = rc.reverify(listed, many(held), ["dest", "rel"], here).select(F.lit("offload").alias("record"), "rel", "verdict")
        out = out.unionByName(again.withColumn("good", F.col("verdict") == "OK"))
    if source is not None:
        recorded, _ = records.read_sources(spark, root, glob="*.sources.tsv")
        card = hashed(frames.files(spark, source)).select("rel", "d_size", "d_sha256", F.lit(True).alias("is_file"))
        classes = rc.source_classes(
            recorded.select(F.col("file").alias("rel"), "size", F.lower("sha256").alias("sha256")), card, "rel"
        )
        out = out.unionByName(
            classes.select(F.lit("sources").alias("record"), "rel", "verdict", (F.col("verdict") == "OK").alias("good"))
        )
    told = out.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("good")).alias("bad"))
    return Found(
        out.drop("good"),
        told.withColumns(
            {
                "verdict": F.when(F.col("bad") == 0, "PASS").otherwise("FAIL"),
                "exit_code": F.when(F.col("bad") == 0, 0).otherwise(1),
            }
        ),
    )


def diff(spark: SparkSession, a: str, b: str, strict: bool = False) -> Found:
    """Frames of two folders by clip and stem, their contents' digests against each other."""

    def side(root):
        return hashed(frames.encoded(frames.files(spark, root))).select("clip", "stem", F.col("d_sha256").alias("v"))

    rows = rc.diff(side(a), side(b), ["clip", "stem"], "v")
    return Found(rows, rc.run_verdict(rc.verdict_counts(rows, ["IDENTICAL", "DELTA", "MISSING", "FAILED"]), strict))


def offload_plan(spark: SparkSession, source: str, dests: dict[str, str]) -> Found:
    """What to copy from a source to each destination; one that is the source, or holds it, or lies in it, is refused."""
    paths = spark.createDataFrame(
        [("", source.rstrip("/")), *[(d, p.rstrip("/")) for d, p in dests.items()]], "name string, path string"
    )
    clash = rc.nested_paths(paths, "name", "path").collect()
    if clash:
        raise ValueError(f"folders lie in one another: {sorted((r.a or 'the source', r.b) for r in clash)}")
    files = hashed(frames.files(spark, source)).select("rel", F.col("d_size").alias("size"), F.col("d_sha256").alias("sha256"))
    held = None
    for dest, folder in dests.items():
        one = hashed(frames.files(spark, folder)).select(
            "rel", F.lit(dest).alias("dest"), F.col("d_size").alias("size"), F.col("d_sha256").alias("sha256")
        )
        held = one if held is None else held.unionByName(one)
    names = spark.createDataFrame([(d,) for d in dests], "dest string")
    rows = rc.fan_out(files, names, many(held), "rel", "dest")
    return Found(
        rows, rows.agg(F.count_if(F.col("action") == "copy").alias("copy"), F.count_if(F.col("action") == "skip").alias("skip"))
    )


def offload(spark: SparkSession, source: str, dests: dict[str, str], out: str, magic: str) -> Found:
    """Copy what each destination lacks, judge every file there by its digest, and write a manifest a destination below ``out``.

    Executors copy, each file once read for all the destinations that lack it; one that fails ends the job with
    its name, and what has arrived stays for the next run, which skips it.
    """
    folders = F.create_map(*[x for d, f in dests.items() for x in (F.lit(d), F.lit(f.rstrip("/")))]) if dests else None
    if folders is None:
        raise ValueError("no destination is given")
    todo = offload_plan(spark, source, dests).rows.filter("action = 'copy'")
    plan = todo.groupBy("rel").agg(F.collect_set(F.try_element_at(folders, "dest")).alias("dests"))  # as many as are given
    told = trees.copy_files(source, plan)
    if bad := told.filter("verdict <> 'COPIED'").limit(1).collect():
        raise OSError(f"{bad[0]['rel']} was not copied to {bad[0]['dest']}: {bad[0]['verdict']}")
    rows, mine = None, stored(hashed(frames.files(spark, source)), "source")
    for dest, folder in dests.items():
        one = offload_record(spark, source, folder, f"{out}/{dest}", magic, dest, mine).rows.withColumn("dest", F.lit(dest))
        rows = one if rows is None else rows.unionByName(one)
    return Found(rows, _summary(rows, "OK"))


def offload_record(
    spark: SparkSession, source: str, dest: str, path: str, magic: str, name: str, mine: DataFrame | None = None
) -> Found:
    """After a copy: every file of the source against its destination, written as an offload manifest at ``path``.

    ``mine`` is what ``hashed`` has told of the source, where that is known.
    """
    mine = stored(hashed(frames.files(spark, source)), "source") if mine is None else mine
    mine = many(mine.select("rel", F.col("d_size").alias("size"), F.col("d_sha256").alias("sha256")))
    there = many(stored(hashed(frames.files(spark, dest)), "there").select("rel", "d_size", "d_sha256"))
    verdicts = rc.member_verdicts(mine, there, "rel")
    rows = mine.join(verdicts, "rel").join(there.select("rel", "d_sha256"), "rel", "left").select(
        F.col("rel").alias("file"),
        "size",
        F.col("sha256").alias("source_sha256"),
        F.coalesce("d_sha256", F.lit("-")).alias("dest_sha256"),
        "verdict",
    )
    rows = stored(rows, "offload-rows")
    records.write_offload(rows, path, magic, name)
    return Found(rows, _summary(rows, "OK"))


def repair(spark: SparkSession, manifest: str, source: str, workspace: str, dest: str, scope: list[str] | None = None) -> Found:
    """Both sides of an offload manifest against the fresh source, and what a repair of the scope would do."""
    listed, _ = records.read_offload(spark, manifest)
    recorded = listed.select(F.col("file").alias("rel"), "size", F.col("source_sha256").alias("sha256"))
    if scope is not None:
        rc.repair_scope(recorded, "rel", scope)

    def held(root):
        return hashed(frames.files(spark, root)).select("rel", "d_size", "d_sha256")

    fresh = hashed(frames.files(spark, source)).select(
        "rel", F.col("d_size").alias("f_size"), F.col("d_sha256").alias("f_sha256")
    )
    rows = rc.repair_rows(recorded, held(dest), held(workspace), fresh, "rel", scope)
    action = F.when(F.col("verdict") == "Clean", "none").when(F.col("in_scope"), "copy").otherwise("stays dirty")
    rows = rows.withColumn("action", action)

    def count(a):
        return F.count_if(F.col("action") == a).alias(a.replace(" ", "_"))

    return Found(rows, rows.agg(count("none"), count("copy"), count("stays dirty"), F.count_if("drifted").alias("drifted")))


def restore(spark: SparkSession, offenders: DataFrame, master: str, key: str = "rel", nth: int | None = None) -> Found:
    """Offenders (clip, key) against a master folder that must verify itself; ``nth`` keeps the n-th place of each clip."""
    listed = placed(offenders.select("clip", key).distinct(), F.col("clip").asc_nulls_first(), key)
    first = listed.groupBy("clip").agg(F.min("place").alias("first")).withColumnRenamed("clip", "of")
    numbered = listed.join(first, F.col("clip").eqNullSafe(F.col("of"))).select(
        F.col("clip").alias("_c"), F.col(key).alias("_k"), (F.col("place") - F.col("first") + 1).alias("n")
    )
    rows = offenders.join(many(numbered), F.col("clip").eqNullSafe(F.col("_c")) & (F.col(key) == F.col("_k"))).drop("_c", "_k")
    rows = rows if nth is None else rows.filter(F.col("n") == nth)
    checked = verify_checksums(spark, master).rows.select(F.col("rel").alias(key), (F.col("verdict") == "ok").alias("fine"))
    out = rc.restore_actions(rows, many(checked), key, "fine")
    return Found(out, out.groupBy("action").agg(F.count(F.lit(1)).alias("rows")))


def ingest_gate(spark: SparkSession, root: str, declared: DataFrame | None = None) -> Found:
    """The numbers of a folder's frames, clip by clip, against the counts that were declared."""
    found = frames.encoded(frames.files(spark, root)).withColumn("num", keys.frame_number(F.col("stem")).cast("long"))
    rows = gates.sequence_gate(found.select("clip", "num"), "clip", "num")
    if declared is None:
        rows = rows.withColumns({"declared": F.lit(None).cast("long"), "mismatch": F.lit(False)})
    else:
        rows = gates.declared_check(rows, declared, "clip")
    rows = rows.withColumn("verdict", F.when(F.col("mismatch"), "FAIL").otherwise(F.col("verdict")))
    return Found(rows, _summary(rows, "PASS"))


def dry_run(
    spark: SparkSession,
    root: str,
    ratio: float,
    ms_a_frame: float,
    include: list[str] | None = None,
    skip: list[str] | None = None,
) -> Found:
    """Before a run: the chosen clips' frames and bytes, the sample to measure, and what the run is expected to take."""
    found = frames.encoded(frames.files(spark, root)).select("rel", "clip", "length")
    chosen = planning.apply_selection(found, planning.resolve_selection(found, "clip", include, skip), "clip")
    clips = chosen.groupBy("clip").agg(F.count(F.lit(1)).alias("frames"), F.sum("length").alias("bytes"))
    rows = clips.withColumns(
        {
            "projected": planning.project_total(F.col("bytes").cast("double"), F.lit(ratio)),
            "minutes": keys.eta_minutes(F.col("frames"), ms_a_frame),
        }
    )
    picked = planning.sample(spark, chosen, "rel").select("place")
    mark = planning.fingerprint(picked, "place")
    total = rows.agg(
        F.coalesce(F.sum("frames"), F.lit(0)).alias("frames"),
        F.coalesce(F.sum("projected"), F.lit(0)).alias("projected"),
        F.coalesce(F.sum("minutes"), F.lit(0.0)).alias("minutes"),
    )
    return Found(rows, total.join(mark.select("places", "sha256")))


def run_plan(spark: SparkSession, root: str, out: str, profiles: DataFrame | None = None) -> Found:
    """A run's frames with what it will do to each: refuse by class, skip what a former run has done, or encode."""
    found = frames.encoded(frames.files(spark, root))
    seen = many(stored(frames.seen(found, sha=True), "seen").withColumn("class", frames.frame_class()))
    outputs = hashed(frames.files(spark, out)).select("rel", F.col("d_sha256").alias("out_sha"))
    side, _ = records.read_resume(spark, out)
    side = many(side.select(F.col("file").alias("rel"), F.lower("sha256").alias("side_sha")))
    known = seen.select("rel", F.lit(None).cast("string").alias("map_sha")).limit(0)
    skip = rc.resume_plan(seen.select("rel", "src_sha"), outputs, side, known, "rel")
    action = F.when(~F.col("class").isin("raw", "camera-lossless"), "refuse").when(F.col("skip"), "skip").otherwise("encode")
    rows = seen.join(skip, "rel").select("rel", "clip", "class", action.alias("action"))
    line = rc.camera_line(seen.select("rel", "facts.make", "facts.model"), profiles, "rel", [["make"], ["model"]])

    def count(a):
        return F.count_if(F.col("action") == a).alias(a)

    return Found(rows, rows.agg(count("encode"), count("skip"), count("refuse")).withColumn("camera", F.lit(line)))


def bake_plan(spark: SparkSession, root: str, target: int, most: int) -> Found:
    """Parts of each clip's archive, and the rows of the reel that they will be."""
    found = frames.files(spark, root).select("clip", "rel", "length")
    parts = planning.next_fit(found, "clip", "rel", "length", target, most)
    rows = found.join(parts, ["clip", "rel"])
    return Found(
        rows,
        rows.groupBy("clip").agg(
            (F.max("part") + 1).alias("parts"), F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
        ),
    )


def measure(spark: SparkSession, roots: list[str]) -> Found:
    """Sizes, depths and classes of the frames of several roots: counts of each root added, clips not made distinct again."""
    one = None
    for n, root in enumerate(roots):
        seen = frames.seen(frames.encoded(frames.files(spark, root))).withColumns(
            {"root": F.lit(n), "class": frames.frame_class()}
        )
        part = seen.groupBy("root", "facts.make", "facts.model", "facts.width", "facts.height", "facts.bits", "class").agg(
            F.count(F.lit(1)).alias("frames"), F.countDistinct("clip").alias("clips")
        )
        one = part if one is None else one.unionByName(part)
    if one is None:
        raise ValueError("no root is given")
    merged = one.groupBy("make", "model", "width", "height", "bits", "class").agg(
        F.sum("frames").alias("frames"), F.sum("clips").alias("clips")
    )
    return Found(merged, merged.agg(F.sum("frames").alias("frames"), F.countDistinct("make", "model").alias("cameras")))


def derive(rows: DataFrame, key: str, plane: str, bits: int) -> Found:
    """Planes of 12 bits at a lower depth, with a digest of each."""
    text = F.array_join(F.transform(plane, lambda v: v.cast("string")), ",")
    out = rows.withColumn(plane, planes.derive_depth(F.col(plane), bits)).select(
        key, plane, F.sha2(text.cast("binary"), 256).alias("sha256")
    )
    return Found(out, out.agg(F.count(F.lit(1)).alias("rows")))


def ledger(spark: SparkSession, path: str, since: int | None = None, as_json: bool = False) -> Found:
    """A ledger's rows from a time on, as they are or as JSON, and the rows that are none."""
    rows, bad = records.read_ledger(spark, path)
    rows = rows.drop("manifest") if since is None else rows.drop("manifest").filter(F.col("created") >= since)
    return Found(reports.json_rows(rows) if as_json else rows, bad.agg(F.count(F.lit(1)).alias("rejects")))


def statistics(samples: DataFrame, clip: str, frame: str, value: str) -> Found:
    """Statistics of each frame, black ones marked, and of each clip."""
    each = stats.moments(stats.frame_stats(samples, [clip, frame], value))
    each = each.withColumn("black", stats.is_black(F.col("range"), F.col("var_num"), F.col("n")))
    return Found(each, stats.moments(stats.merge_stats(stats.frame_stats(samples, [clip, frame], value), [clip])))
