"""Hash lists of a folder tree: XML in, directory hashes by depth, verification against disk."""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from loomshed.functions.hashing import c4_bytes, c4_of_digest
from loomshed.operators.reconcile import first_of
from loomshed.scratch import stored

_ENTRY = T.ArrayType(
    T.StructType(
        [
            T.StructField("path", T.StringType()),
            T.StructField("is_dir", T.BooleanType()),
            T.StructField("size", T.LongType()),
            T.StructField("c4", T.StringType()),
            T.StructField("structure", T.StringType()),
        ]
    )
)


def parse_list(text: str) -> list[dict]:
    """Entries of a hash list; documents with entities, broken XML, paths that leave the folder and bad ids raise."""
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("document type declarations are refused")
    out = []

    def tag(e):
        return e.tag.rpartition("}")[2]

    for el in ET.fromstring(text).iter():
        kind = tag(el)
        if kind not in ("hash", "directoryhash"):
            continue
        path = next((c for c in el if tag(c) == "path"), None)
        if path is None or not path.text:
            raise ValueError("entry without a path")
        name = path.text
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"path leaves the folder: {name}")
        held = [p for p in el if tag(p) in ("c4", "content", "structure")]
        ids = {tag(p): next((c.text for c in p.iter() if tag(c) == "c4"), None) for p in held}
        for value in ids.values():
            c4_bytes(value or "")
        out.append(
            {
                "path": name,
                "is_dir": kind == "directoryhash",
                "size": int(path.get("size")) if path.get("size") else None,
                "c4": ids.get("c4") or ids.get("content"),
                "structure": ids.get("structure"),
            }
        )
    return out


@F.pandas_udf(_ENTRY)
def entries(texts: pd.Series) -> pd.Series:
    return texts.map(parse_list)


def read_hash_lists(spark: SparkSession, path: str) -> DataFrame:
    """(manifest, path, is_dir, size, c4, structure) of hash lists below ``path``."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("manifest"), "value")
    return raw.select("manifest", F.explode(entries("value")).alias("e")).select("manifest", "e.*")


def list_hashes(kids: DataFrame, name: str) -> DataFrame:
    """(dir, name): the C4 id over the ids (dir, id) of each folder, their bytes in sorted order.

    Folders are dealt out and sorted, and a task streams through theirs: a folder of
    any size takes one digest's memory.
    """

    def run(batches):
        now, digest = None, None
        for b in batches:
            dirs, ids = [], []
            for d, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if d != now or digest is None:
                    if digest is not None:
                        dirs.append(now)
                        ids.append(c4_of_digest(digest.digest()))
                    now, digest = d, hashlib.sha512()
                digest.update(c4_bytes(i))
            yield pa.RecordBatch.from_arrays([pa.array(dirs, pa.string()), pa.array(ids, pa.string())], names=["dir", name])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([c4_of_digest(digest.digest())], pa.string())], names=["dir", name])

    # The digits of an id are in the order of their characters, so ids sort as their bytes do.
    rows = kids.select("dir", "id").repartition("dir").sortWithinPartitions("dir", "id")
    return rows.mapInArrow(run, f"dir string, {name} string")


@F.pandas_udf(T.StringType())
def child_hash(names: pd.Series, ids: pd.Series) -> pd.Series:
    """C4 id of a child's name with its own hash, for structure."""
    return pd.Series([c4_of_digest(hashlib.sha512(n.encode() + c4_bytes(i)).digest()) for n, i in zip(names, ids, strict=True)])


def directory_hashes(files: DataFrame) -> DataFrame:
    """(dir, content, structure) of every folder above ``files`` (path, c4), '' the root.

    Folders are rolled up by depth, deepest first: one aggregation a level, as
    many rounds as the tree is deep, and no task holds a folder's children.
    """
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    name = F.substring_index("path", "/", -1)
    level = files.select(
        "path", F.col("c4").alias("content"), F.col("c4").alias("structure"), F.size(F.split("path", "/")).alias("depth")
    )
    deepest = level.agg(F.max("depth")).first()[0]
    found = None
    for depth in range(deepest or 0, 0, -1):
        kids = level.filter(F.col("depth") == depth).select(
            parent.alias("dir"), "content", child_hash(name, F.col("structure")).alias("structure")
        )
        content, structure = (list_hashes(kids.select("dir", F.col(c).alias("id")), c) for c in ("content", "structure"))
        dirs = stored(content.join(structure, "dir"), "folders")
        found = dirs if found is None else found.unionByName(dirs)
        level = level.filter(F.col("depth") < depth).unionByName(
            dirs.filter("dir <> ''").select(F.col("dir").alias("path"), "content", "structure", F.lit(depth - 1).alias("depth"))
        )
    return found if found is not None else files.sparkSession.createDataFrame([], "dir string, content string, structure string")


def verify(listed: DataFrame, disk: DataFrame) -> DataFrame:
    """Listed files against disk (path, d_size, d_c4): MISSING, SIZE, C4, OK."""
    seen = disk.withColumn("on_disk", F.lit(True))
    verdict = first_of(
        (F.col("on_disk").isNull(), "MISSING"),
        (F.col("size") != F.col("d_size"), "SIZE"),
        (F.col("c4") != F.col("d_c4"), "C4"),
        otherwise="OK",
    )
    return listed.filter(~F.col("is_dir")).join(seen, "path", "left").select("path", verdict.alias("verdict"))


def render(folder: str, rows: list[dict], root: dict) -> str:
    """A hash list of sorted rows (path, size, c4) and folders' hashes; the same rows give the same text."""
    top = ET.Element("hashlist", version="2.0")
    info = ET.SubElement(ET.SubElement(top, "processinfo"), "roothash")
    for kind in ("content", "structure"):
        ET.SubElement(ET.SubElement(info, kind), "c4").text = root[kind]
    ET.SubElement(top, "creatorinfo").text = folder
    hashes = ET.SubElement(top, "hashes")
    for r in sorted(rows, key=lambda r: r["path"].split("/")):
        el = ET.SubElement(hashes, "hash")
        ET.SubElement(el, "path", size=str(r["size"])).text = r["path"]
        ET.SubElement(el, "c4").text = r["c4"]
    return ET.tostring(top, encoding="unicode")


@F.pandas_udf(T.StringType())
def _render(paths: pd.Series, sizes: pd.Series, ids: pd.Series) -> pd.Series:
    out = []
    for p, s, c in zip(paths, sizes, ids, strict=True):
        rows = [{"path": a, "size": int(b), "c4": d} for a, b, d in zip(p, s, c, strict=True)]
        whole = c4_of_digest(hashlib.sha512(b"".join(sorted(c4_bytes(r["c4"]) for r in rows))).digest())
        out.append(render("", rows, {"content": whole, "structure": whole}))
    return pd.Series(out)


#: Files of one hash list, about; a folder of more is several lists.
LIST_FILES = 10_000


def render_lists(rows: DataFrame, folder: str) -> DataFrame:
    """(folder, part, text): hash lists of (folder, path, size, c4), a folder's files dealt to lists of bounded length."""
    total = rows.groupBy(folder).agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64("path"), F.ceil(F.col("_n") / LIST_FILES))
    dealt = rows.join(total, folder).withColumn("part", part)
    lists = dealt.groupBy(folder, "part").agg(F.array_sort(F.collect_list(F.struct("path", "size", "c4"))).alias("f"))
    return lists.select(folder, "part", _render(F.col("f.path"), F.col("f.size"), F.col("f.c4")).alias("text"))


_CHAIN = T.ArrayType(
    T.StructType(
        [T.StructField("sequence", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("c4", T.StringType())]
    )
)


def parse_chain(text: str) -> list[dict]:
    """Records of a chain file: a number, a path and an id each; anything else raises."""
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("document type declarations are refused")

    def name(e):
        return e.tag.rpartition("}")[2]

    root, out = ET.fromstring(text), []
    if name(root) != "ascmhldirectory":
        raise ValueError(f"a chain begins with {name(root)}")
    for el in root:
        held = {name(c): c.text for c in el}
        if name(el) != "hashlist" or set(held) != {"path", "c4"} or not (el.get("sequencenr") or "").isdigit():
            raise ValueError(f"no chain record: {name(el)} {sorted(held)}")
        out.append({"sequence": int(el.get("sequencenr", "0")), "path": held["path"], "c4": held["c4"]})
    return out


def render_chain(records: list[tuple[int, str, str]]) -> str:
    """A chain file of (sequence, path, c4), in order of the sequence."""
    root = ET.Element("ascmhldirectory")
    for number, path, c4 in sorted(records):
        el = ET.SubElement(root, "hashlist", sequencenr=str(number))
        ET.SubElement(el, "path").text = path
        ET.SubElement(el, "c4").text = c4
    return ET.tostring(root, encoding="unicode")


@F.pandas_udf(_CHAIN)
def chain(texts: pd.Series) -> pd.Series:
    return texts.map(parse_chain)


def append_generation(text: str | None, path: str, c4: str) -> str:
    """A chain with one more record, of the next number."""
    held = [(r["sequence"], r["path"], r["c4"]) for r in parse_chain(text)] if text else []
    return render_chain([*held, (max((n for n, *_ in held), default=0) + 1, path, c4)])
