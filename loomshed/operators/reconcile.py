"""Reconciling collections: diffs, audits with ordered verdicts, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomshed.operators.scans import Last, Next, scan
from loomshed.scratch import few


def first_of(*cases: tuple[Column, str], otherwise: str) -> Column:
    """The verdict of the first case that holds; order is part of every audit's contract."""
    out = F
    for condition, verdict in cases:
        out = out.when(F.coalesce(condition, F.lit(False)), verdict)
    return out.otherwise(otherwise)


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key, the last in order; the greatest of each task meets the others."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")


def diff(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Full outer diff: IDENTICAL, DELTA, FAILED (unreadable, null value) or MISSING."""
    left = a.select(*key, F.lit(True).alias("in_a"), F.col(value).alias("va"))
    right = b.select(*key, F.lit(True).alias("in_b"), F.col(value).alias("vb"))
    verdict = first_of(
        (F.col("in_a").isNull() | F.col("in_b").isNull(), "MISSING"),
        (F.col("va").isNull() | F.col("vb").isNull(), "FAILED"),
        (F.col("va") != F.col("vb"), "DELTA"),
        otherwise="IDENTICAL",
    )
    return left.join(right, key, "full").select(*key, "va", "vb", verdict.alias("verdict"))


def verdict_counts(rows: DataFrame, verdicts: list[str]) -> DataFrame:
    """One row: how many rows have each verdict."""
    return rows.agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in verdicts])


def run_verdict(counts: DataFrame, strict: bool = False) -> DataFrame:
    """FAIL for any missing or failed row, DELTA for any delta, else IDENTICAL; and the exit code."""
    bad, delta = F.col("n_missing") + F.col("n_failed") > 0, F.col("n_delta") > 0
    return counts.withColumns(
        {
            "run": F.when(bad, "FAIL").when(delta, "DELTA").otherwise("IDENTICAL"),
            "exit_code": F.when(bad | (delta & F.lit(strict)), 1).otherwise(0),
        }
    )


def audit(manifest: DataFrame, disk: DataFrame, key: str) -> DataFrame:
    """Manifest rows against disk, the first failing check: missing, unreadable, size, unreadable, sha256, crc32c, ok.

    manifest: key, size, sha256, crc32c or null. disk: key, d_size (null: not even its size can be
    had), d_sha256 (null: unreadable), d_crc32c. A size is known before a file is read, so a file of
    the wrong size that cannot be read has the wrong size.
    """
    seen = disk.withColumn("on_disk", F.lit(True))
    verdict = first_of(
        (F.col("on_disk").isNull(), "missing"),
        (F.col("d_size").isNull(), "unreadable"),
        (F.col("size") != F.col("d_size"), "size"),
        (F.col("d_sha256").isNull(), "unreadable"),
        (F.col("sha256") != F.col("d_sha256"), "sha256"),
        (F.col("crc32c").isNotNull() & (F.col("crc32c") != F.col("d_crc32c")), "crc32c"),
        otherwise="ok",
    )
    return manifest.join(seen, key, "left").select(key, verdict.alias("verdict"))


def archive_audit(manifest: DataFrame, members: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Manifest rows against members of archive parts: not found, missing part, unreadable, size, sha256, ok.

    members: key, part, d_size, d_sha256 (null: unreadable); parts: part. A
    member listed in two parts is an error, raised before anything is judged.
    """
    twice = members.groupBy(key).agg(F.countDistinct("part").alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"member listed in two parts: {twice[0][key]}")
    here = parts.select("part", F.lit(True).alias("part_here")).distinct()
    rows = manifest.join(members, key, "left").join(here, "part", "left")
    verdict = first_of(
        (F.col("part").isNull(), "not found"),
        (F.col("part_here").isNull(), "missing part"),
        (F.col("d_sha256").isNull(), "unreadable"),
        (F.col("size") != F.col("d_size"), "size"),
        (F.col("sha256") != F.col("d_sha256"), "sha256"),
        otherwise="ok",
    )
    return rows.select(key, verdict.alias("verdict"))


def repair_rows(
    manifest: DataFrame, dest: DataFrame, workspace: DataFrame, fresh: DataFrame, key: str, scope: list[str] | None = None
) -> DataFrame:
    """Both sides of every manifest row against the fresh source (key, f_size, f_sha256).

    The workspace side is left out for frames; rows outside ``scope`` are marked
    so; a drift of the recorded digest is only a note.
    """

    def side(rows, name):
        return manifest.join(rows, key, "left").withColumn("side", F.lit(name))

    both = side(dest, "dest").unionByName(
        side(workspace, "workspace").filter(~F.lower(F.col(key)).endswith(".dng"))
    ).join(fresh, key, "left")
    verdict = first_of(
        (F.col("d_sha256").isNull(), "Missing"),
        (F.col("f_size") != F.col("d_size"), "SizeMismatch"),
        (F.col("f_sha256") != F.col("d_sha256"), "ShaMismatch"),
        otherwise="Clean",
    )
    inside = F.lit(True) if scope is None else F.col(key).isin(*scope)
    return both.select(
        key,
        "side",
        verdict.alias("verdict"),
        inside.alias("in_scope"),
        F.coalesce(F.col("sha256") != F.col("f_sha256"), F.lit(False)).alias("drifted"),
    )


def repair_scope(manifest: DataFrame, key: str, scope: list[str]) -> None:
    """Every name of a scope must be a known row; raises with those that are not."""
    known = {r[0] for r in manifest.filter(F.col(key).isin(*scope)).select(key).distinct().collect()}
    if unknown := sorted(set(scope) - known):
        raise ValueError(f"unknown: {', '.join(unknown)}")


def source_classes(record: DataFrame, card: DataFrame, key: str) -> DataFrame:
    """Source re-verify: MISSING (or not a file), READ_ERROR, SIZE, SHA, OK."""
    verdict = first_of(
        (F.col("is_file").isNull() | ~F.col("is_file"), "MISSING"),
        (F.col("size") != F.col("d_size"), "SIZE"),
        (F.col("d_sha256").isNull(), "READ_ERROR"),
        (F.col("sha256") != F.col("d_sha256"), "SHA"),
        otherwise="OK",
    )
    return record.join(card, key, "left").select(key, verdict.alias("verdict"))


def repair_classes(manifest: DataFrame, dest: DataFrame, key: str) -> DataFrame:
    """Repair: Missing (also unreadable), SizeMismatch, ShaMismatch, Clean."""
    verdict = first_of(
        (F.col("d_sha256").isNull(), "Missing"),
        (F.col("size") != F.col("d_size"), "SizeMismatch"),
        (F.col("sha256") != F.col("d_sha256"), "ShaMismatch"),
        otherwise="Clean",
    )
    return manifest.join(dest, key, "left").select(key, verdict.alias("verdict"))


def member_verdicts(source: DataFrame, copy: DataFrame, key: str) -> DataFrame:
    """Copies against sources: SRC_UNREADABLE, MISSING, DST_UNREADABLE, SIZE, SHA, OK."""
    seen = copy.withColumn("on_disk", F.lit(True))
    verdict = first_of(
        (F.col("sha256").isNull(), "SRC_UNREADABLE"),
        (F.col("on_disk").isNull(), "MISSING"),
        (F.col("d_sha256").isNull(), "DST_UNREADABLE"),
        (F.col("size") != F.col("d_size"), "SIZE"),
        (F.col("sha256") != F.col("d_sha256"), "SHA"),
        otherwise="OK",
    )
    return source.join(seen, key, "left").select(key, verdict.alias("verdict"))


def reverify(record: DataFrame, disk: DataFrame, key: list[str], dests: DataFrame | None = None) -> DataFrame:
    """Recorded copies against disk: DEST_MISSING, MISSING, UNREADABLE, SIZE, UNREADABLE, SHA, OK.

    record: key, size, sha256 ('-' matches any). disk: key, d_size and d_sha256 (null: unreadable).
    ``dests`` holds the first columns of the key that are there; every row of another one is bad,
    whatever the disk says.
    """
    rows = record.join(disk.withColumn("on_disk", F.lit(True)), key, "left")
    gone = F.lit(False)
    if dests is not None:
        rows = rows.join(dests.withColumn("dest_here", F.lit(True)).distinct(), dests.columns, "left")
        gone = F.col("dest_here").isNull()
    verdict = first_of(
        (gone, "DEST_MISSING"),
        (F.col("on_disk").isNull(), "MISSING"),
        (F.col("d_size").isNull(), "UNREADABLE"),
        (F.col("size") != F.col("d_size"), "SIZE"),
        (F.col("sha256") == "-", "OK"),
        (F.col("d_sha256").isNull(), "UNREADABLE"),
        (F.col("sha256") != F.col("d_sha256"), "SHA"),
        otherwise="OK",
    )
    return rows.select(*key, verdict.alias("verdict"))


def rederived(recorded: DataFrame, derived: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer compare of recorded and re-derived rows; nulls equal nulls; one-sided rows are flagged."""
    r = recorded.select(key, F.lit(True).alias("in_r"), *[F.col(c).alias(f"r_{c}") for c in columns])
    d = derived.select(key, F.lit(True).alias("in_d"), *[F.col(c).alias(f"d_{c}") for c in columns])
    differing = F.array_compact(F.array(*[F.when(~F.col(f"r_{c}").eqNullSafe(F.col(f"d_{c}")), F.lit(c)) for c in columns]))
    verdict = F.when(F.col("in_d").isNull(), "recorded only").when(F.col("in_r").isNull(), "derived only").when(
        F.size(differing) > 0, F.array_join(differing, ",")
    ).otherwise("same")
    return r.join(d, key, "full").select(key, verdict.alias("verdict"))


def resume_plan(frames: DataFrame, outputs: DataFrame, sidecar: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Skip a frame iff its output exists, its sidecar row exists and agrees, and any known source digest agrees."""
    rows = frames.join(
        outputs.withColumn("has_output", F.lit(True)), key, "left"
    ).join(sidecar, key, "left").join(sources, key, "left")
    skip = F.col("has_output") & F.col("side_sha").isNotNull() & (F.col("side_sha") == F.col("out_sha")) & (
        F.col("map_sha").isNull() | (F.col("map_sha") == F.col("src_sha"))
    )
    return rows.select(key, F.coalesce(skip, F.lit(False)).alias("skip"))


def stale_rows(sidecar: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    return sidecar.join(frames, key, "left_anti").select(key)


#: Destinations of a copy: volumes attached to one machine.
MOST_DESTS = 1000


def each_dest(files: DataFrame, dests: DataFrame, dest: str) -> DataFrame:
    """Every file for every destination; destinations are few by nature, and their number is checked."""
    return files.withColumn(dest, F.explode(F.array(*[F.lit(n) for n in few(dests, dest, MOST_DESTS)])))


def fan_out(files: DataFrame, dests: DataFrame, existing: DataFrame, key: str, dest: str) -> DataFrame:
    """Every file for every destination, skipped where size and digest already agree."""
    held = existing.select(key, dest, F.col("size").alias("e_size"), F.col("sha256").alias("e_sha"))
    action = F.when((F.col("e_size") == F.col("size")) & (F.col("e_sha") == F.col("sha256")), "skip").otherwise("copy")
    return each_dest(files, dests, dest).join(held, [key, dest], "left").select(
        key, dest, F.coalesce(action, F.lit("copy")).alias("action")
    )


def nested_paths(paths: DataFrame, name: str, path: str) -> DataFrame:
    """(a, b, guard) of paths that are the same, or of which one contains the other; a before b by name.

    Each path meets its own prefixes, so no pairs are tried.
    """
    parts = F.split(F.col(path), "/")
    ups = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    low = paths.select(F.col(name).alias("low"), F.col(path).alias("low_path"), F.explode(ups).alias("up"))
    high = paths.select(F.col(name).alias("high"), F.col(path).alias("up"))
    pairs = high.join(low, "up").filter("high <> low")
    guard = F.when(F.col("up") == F.col("low_path"), "same").when(F.col("high") > F.col("low"), "inside").otherwise("contains")
    return pairs.select(F.least("high", "low").alias("a"), F.greatest("high", "low").alias("b"), guard.alias("guard")).distinct()


def known_digest(*sources: Column) -> Column:
    """The first known digest of several, '-' for none."""
    return F.coalesce(*sources, F.lit("-"))


def reel_rows(archives: DataFrame, disk: DataFrame) -> DataFrame:
    """Archives of reels (clip, archive, sha256) against disk (archive, d): missing, sha256, ok."""
    verdict = first_of((F.col("d").isNull(), "missing"), (F.col("d") != F.col("sha256"), "sha256"), otherwise="ok")
    return archives.join(disk, "archive", "left").select("clip", "archive", verdict.alias("verdict"))


def restore_actions(offenders: DataFrame, master: DataFrame, key: str, fine: str) -> DataFrame:
    """Offenders with what restores them: 'restore' from a master that verifies, 'master bad', or 'no master'."""
    found = offenders.join(master.select(key, F.col(fine).alias("_fine"), F.lit(True).alias("_held")), key, "left")
    action = first_of(
        (F.col("_held").isNull(), "no master"), (F.coalesce(~F.col("_fine"), F.lit(True)), "master bad"), otherwise="restore"
    )
    return found.withColumn("action", action).drop("_fine", "_held")


def pin_states(pins: DataFrame, found: DataFrame) -> DataFrame:
    """(component, expected, probe, state) of pins (component, expected, probe); the first word of a probe says how to compare.

    ``found`` is (component, name, value): what runs. 'version-contains' wants the expected text in
    every value of a component that can be resolved, and passes others as skipped. 'lock-grep NAME'
    wants the value of that name and component to be equal, and drifts where there is none.
    'toml-grep' is the tool itself; all other probes are another program's, passed as skipped.
    """
    kind, name = F.split_part("probe", F.lit(" "), F.lit(1)), F.split_part("probe", F.lit(" "), F.lit(2))
    rows = pins.withColumns({"_kind": kind, "_name": name})
    told = found.select(F.col("component").alias("_c"), F.col("name").alias("_n"), "value")
    same = (F.col("component") == F.col("_c")) & ((F.col("_kind") == "version-contains") | (F.col("_name") == F.col("_n")))
    fits = F.when(F.col("_kind") == "version-contains", F.contains("value", "expected")).otherwise(
        F.col("value") == F.col("expected")
    )
    joined = rows.join(told, same, "left").groupBy("component", "expected", "probe", "_kind").agg(
        F.count("value").alias("known"), F.bool_and(fits).alias("fits")
    )
    drift = F.when(F.coalesce("fits", F.lit(False)), "OK").otherwise("DRIFT")
    state = (
        F.when((F.col("_kind") == "version-contains") & (F.col("known") == 0), "skip-OK")
        .when(F.col("_kind").isin("version-contains", "lock-grep"), drift)
        .when(F.col("_kind") == "toml-grep", "OK")
        .otherwise("skip-OK")
    )
    return joined.select("component", "expected", "probe", state.alias("state"))


def completion(objects: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Whether the archive of each clip is complete, or the first reason why not.

    objects: key, object_sha (null: no object), sidecar_sha (null: no sidecar), has_manifest,
    file_count (null: unreadable). current: key, rows now.
    """
    rows = objects.join(current, key, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    verdict = first_of(
        (F.col("object_sha").isNull(), "no object"),
        (F.col("sidecar_sha").isNull(), "no sidecar"),
        (~F.col("has_manifest"), "no manifest"),
        (F.col("sidecar_sha") != F.col("object_sha"), "sha256"),
        (F.col("file_count").isNull(), "no count"),
        (F.col("file_count") != F.col("rows"), "stale"),
        otherwise="complete",
    )
    return rows.select(key, verdict.alias("verdict"))


def neighbour_frames(neighbours: DataFrame, frames: DataFrame, clip: str, ordinal: str) -> DataFrame:
    """Facts of each frame's neighbour (clip, ordinal, neighbour), by a join on its place; nulls where it has none."""
    facts = frames.withColumnRenamed(ordinal, "neighbour")
    return neighbours.join(facts, [clip, "neighbour"], "left")


def camera_line(frames: DataFrame, profiles: DataFrame | None, path: str, levels: list[list[str]]) -> str:
    """Verdict of a clip's camera by its first frame alone: ABSENT without frames, profiles or facts, else OK or UNKNOWN.

    Only that frame's row and its verdict reach the driver.
    """
    first = frames.orderBy(path).limit(1)
    if profiles is None:
        return "ABSENT"
    got = resolve_levels(first, profiles, levels).withColumn("_known", F.col(levels[0][0]).isNotNull()).select(
        "failed_level", "_known"
    ).collect()
    if not got or not got[0]["_known"]:
        return "ABSENT"
    return "OK" if got[0]["failed_level"] == 0 else "UNKNOWN"


def resolve_levels(frames: DataFrame, profiles: DataFrame, levels: list[list[str]]) -> DataFrame:
    """Cascading lookup: the class of the first level whose key no profile has, else 0.

    Each level's key extends the one before; each lookup is a join on the
    distinct keys of the profiles.
    """
    out, key, found = frames, [], []
    for i, columns in enumerate(levels, 1):
        key = key + columns
        known = profiles.select(*key).distinct().withColumn(f"_l{i}", F.lit(True))
        out = out.join(known, key, "left")
        found.append((F.col(f"_l{i}").isNull(), i))
    cls = F
    for condition, i in found:
        cls = cls.when(condition, i)
    return out.withColumn("failed_level", cls.otherwise(0)).drop(*[f"_l{i}" for i in range(1, len(levels) + 1)])


def nearest_verified(frames: DataFrame, clip: str, ordinal: str, verified: str) -> DataFrame:
    """For each frame the nearest verified one of the same parity in its clip, the earlier on a tie.

    Below the clip's start the walk clamps to ordinal 0, so a verified frame 0
    serves odd frames too, at one step more than their ordinal. Two ordered
    scans (last verified before, first verified after) stand for the walk:
    no row a pair, and a clip of any size.
    """
    mark = F.when(F.col(verified), F.col(ordinal))
    rows = frames.withColumn("_parity", F.pmod(F.col(ordinal), F.lit(2)))
    rows = scan(rows, [clip, "_parity"], [ordinal], {"low": Last(mark), "high": Next(mark)})
    first = frames.filter((F.col(ordinal) == 0) & F.col(verified)).select(clip).distinct().withColumn("zero", F.lit(1))
    rows = rows.join(first, clip, "left")
    o = F.col(ordinal)
    steps = F.array_compact(
        F.array(
            F.when(
                F.col("low").isNotNull(), F.struct((o - F.col("low")).alias("d"), F.lit(0).alias("side"), F.col("low").alias("n"))
            ),
            F.when(
                F.col("high").isNotNull(),
                F.struct((F.col("high") - o).alias("d"), F.lit(1).alias("side"), F.col("high").alias("n")),
            ),
            F.when(
                (F.pmod(o, F.lit(2)) == 1) & F.col("zero").isNotNull(),
                F.struct((o + 1).alias("d"), F.lit(0).alias("side"), F.lit(0).cast(frames.schema[ordinal].dataType).alias("n")),
            ),
        )
    )
    return rows.select(clip, ordinal, F.array_min(steps)["n"].alias("neighbour"))


def rotation(rows: DataFrame, window_days: int, now: int) -> DataFrame:
    """Reels not audited within the window: null or more than so many days ago.

    rows: created, command, input, output, verdict. Reels are outputs of ok bakes;
    an audit of any verdict counts.
    """
    reels = rows.filter(
        F.col("command").isin("bake", "bake-iso") & (F.col("verdict") == "OK")
    ).select(F.col("output").alias("reel")).distinct()
    last = rows.filter(F.col("command") == "audit").groupBy(F.col("input").alias("reel")).agg(F.max("created").alias("last"))
    age = F.expr(f"greatest({now} - last, 0) div 86400")
    return reels.join(last, "reel", "left").withColumn("age_days", age).filter(
        F.col("age_days").isNull() | (F.col("age_days") > window_days)
    ).select("reel", "age_days")


def union_fresh(prior: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """prior and fresh by key; fresh wins."""
    both = prior.withColumn("_p", F.lit(1)).unionByName(fresh.withColumn("_p", F.lit(0)))
    return both.groupBy(key).agg(F.min_by(F.struct(*both.columns), "_p").alias("_row")).select("_row.*").drop("_p")
