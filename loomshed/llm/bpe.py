"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The driver reads the rank file once and ships its bytes with the task (under
1 MB for a 50k vocabulary); each Python worker builds the encoder once and
keeps it. Long texts are split at boundaries that no match of the pattern can
span: before a space or newline that follows other than white space, and around
long runs of white space. Such a run is one match up to its last character, which
goes with what follows it; its tokens are merged without the pattern, which the
library matches by recursion on white space and which ends in an overflow of the
stack beyond some 700,000 characters. What the library holds at once is a piece,
that is about ``PIECE_CHARS`` characters, or, where a text has no white space for
longer, all up to the next, or a run of white space; those are linear in time and
space. The cuts suit patterns in which no match goes on from other characters into
white space and a run before other text leaves its last character to it, as the
public one's; other patterns need other cuts, and long texts would get other ids.

Defined results: a null or empty text has no tokens (the digests are those of
no bytes); repeated rows stay repeated; other columns are left out, so clashing
names cannot matter; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Texts longer than this are split before encoding.
PIECE_CHARS = 1 << 15
#: A space or newline after other than white space: no match of the pattern holds
#: white space after other characters, so a text cut before it has the ids of its parts.
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")
# The characters that Unicode calls white space.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")
#: Runs of white space from here on are merged without the pattern.
RUN_CHARS = 1000

_encoders: dict[bytes, object] = {}


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The rank file's bytes; read by the driver, from a local path or any path Spark reads."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def encoder(ranks: bytes, pattern: str):
    """The worker's encoder for these ranks, built once."""
    key = hashlib.sha1(ranks + pattern.encode()).digest()
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """A long text in parts of about ``size`` characters, cut at the next safe boundary."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def parts(text: str) -> Iterator[tuple[str, bool]]:
    """A long text in pieces; each with whether it is a run of white space that is one match of the pattern."""
    at = 0
    for run in _SPACES.finditer(text):
        start, end = run.span()
        if end - start >= RUN_CHARS:
            stop = end if end == len(text) else end - 1
            yield from ((p, False) for p in pieces(text[at:start]) if p)
            yield text[start:stop], True
            at = stop
    yield from ((p, False) for p in pieces(text[at:]) if p)


def encode(enc, text: str) -> list[int]:
    """Token ids of one whole text, without special tokens."""
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    return [i for p, one in parts(text) for i in (enc._encode_single_piece(p.encode()) if one else enc.encode_ordinary(p))]


#: Rows of an output batch, so that ids of long texts do not gather.
ROWS = 500
SCHEMA = "doc_id long, n_tokens long, token_ids array<int>, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Encode ``text`` of (doc_id, text); also decode the ids to bytes and digest both.

    ``keep_ids=False`` leaves token_ids null, where only the digests are wanted.
    """

    def run(batches):
        import numpy as np

        enc = encoder(ranks, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                counts, kept, ids_sha, out_sha = [], [], [], []
                for text in batch.column(1).to_pylist():
                    ids = encode(enc, text or "")
                    counts.append(len(ids))
                    kept.append(np.array(ids, np.int32) if keep_ids else None)
                    ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                    out_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(counts, pa.int64()),
                        pa.array(kept, pa.list_(pa.int32())),
                        pa.array(ids_sha, pa.string()),
                        pa.array(out_sha, pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def decode_documents(tokens: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Raw bytes of ``token_ids`` of (doc_id, token_ids); null ids give no bytes."""

    def run(batches):
        enc = encoder(ranks, pattern)
        for batch in batches:
            data = [enc.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return tokens.selectExpr("cast(doc_id as long) doc_id", "token_ids").mapInArrow(run, "doc_id long, data binary")
