"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding by the library.

In byte-pair encoding whose merges are ranked by the merged piece, the encoding of every prefix ends
with one certain token, and it is the only token t for which two things hold: t is a piece that merging
itself makes whole, and t and the last token of what stands before it are compatible, which means that
the two together are encoded as just these two. So the table is filled from left to right: an automaton
over the pieces names all that end at a place, the pair test leaves one, and the ids are recovered from
the end backwards. That is linear in the text's length.

The driver reads the model once (half a megabyte) and ships its bytes; every Python worker builds the
automaton once. A normalised text falls apart before each mark of a space that follows another
character, where no piece of the model goes on, so that equal words are encoded once a worker and
what is kept of them is bounded (``WORDS``); a model with pieces across such a place is not cut. A text
without spaces is one word of any length, whose table takes a list entry a character.

Characters without a piece become the model's byte pieces, or its unknown id where it has none, once
for a run of such characters.

Defined results: a null or empty text has no ids (its digests are those of nothing); repeated rows stay
repeated; other columns are left out, so clashing names cannot matter; an empty table gives an empty
table. Models of another type than BPE, and those with user-defined or unused pieces, are refused.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: What stands for a space.
SPACE = "▁"
#: Words of a generation, of which a worker remembers two, and the longest that it does.
WORDS, LONGEST = 400_000, 64
#: Pairs that a worker remembers.
PAIRS = 2_000_000
#: Rows of an output batch, so that ids of long texts do not gather.
ROWS = 500
#: Marks of spaces and what follows up to the next of them.
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
SCHEMA = "doc_id long, n_tokens long, token_ids array<int>, ids_sha256 string, decoded_text string, decoded_sha256 string"


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file's bytes; read by the driver, from a local path or any path Spark reads."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def merged(symbols: list[str], rank: dict[str, float]) -> list[str]:
    """Neighbours merged by the best-ranked piece that they make, the leftmost of equals first, until none is left."""
    s = list(symbols)
    ranks = [rank.get(a + b, math.inf) for a, b in zip(s, s[1:])]
    while ranks and (best := min(ranks)) < math.inf:
        i = ranks.index(best)
        s[i : i + 2] = [s[i] + s[i + 1]]
        del ranks[i]
        if i:
            ranks[i - 1] = rank.get(s[i - 1] + s[i], math.inf)
        if i < len(ranks):
            ranks[i] = rank.get(s[i] + s[i + 1], math.inf)
    return s


@dataclass
class Table:
    """The automaton of a model and what was learned of pairs and words; pieces go by their ids."""

    #: Rank of every piece: smaller is merged sooner.
    rank: dict[str, float]
    ids: dict[str, int]
    #: Pieces and their lengths by id.
    pieces: list[str]
    lengths: list[int]
    #: Ids for a character without a piece, by its bytes; None where the model has no byte pieces.
    byte_ids: list[int] | None
    unknown: int
    #: Names the ids of all pieces that end at a place, the longest first.
    automaton: object
    #: Characters that are pieces.
    letters: frozenset[str]
    #: Whether no piece has a mark of a space behind another character.
    cuts: bool
    #: Whether two ids side by side (the first times the number of pieces, and the second) stay as they are.
    pairs: dict[int, bool] = field(default_factory=dict)
    words: Words = field(init=False)

    def __post_init__(self):
        self.words = Words(self.word_ids)

    def compatible(self, a: int, b: int) -> bool:
        """Whether two tokens side by side are encoded as just these two; remembered by ``pairs``."""
        x, y = self.pieces[a], self.pieces[b]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[a * len(self.pieces) + b] = merged([*x, *y], self.rank) == [x, y]
        return found

    def last_tokens(self, word: str) -> list[int]:
        """For the beginnings of a word of known characters, by length, the last token of each."""
        last = [-1] * (len(word) + 1)
        lengths, pairs, n = self.lengths, self.pairs, len(self.pieces)
        for end, piece in self.automaton.iter(word):
            if last[end + 1] < 0:
                before = end + 1 - lengths[piece]
                if not before:
                    last[end + 1] = piece
                elif (left := last[before]) >= 0:
                    fits = pairs.get(left * n + piece)
                    if self.compatible(left, piece) if fits is None else fits:
                        last[end + 1] = piece
        return last

    def tokens(self, word: str) -> list[int]:
        """The ids of a word of known characters, recovered from the end backwards."""
        last, out, at = self.last_tokens(word), [], len(word)
        while at:
            out.append(last[at])
            at -= self.lengths[last[at]]
        out.reverse()
        return out

    def _ids(self, word: str) -> Iterator[int]:
        """Ids of a word with characters that are no pieces."""
        start = 0
        for at, c in enumerate(word):
            if c not in self.letters:
                yield from self.tokens(word[start:at])
                yield from [self.unknown] if self.byte_ids is None else (self.byte_ids[b] for b in c.encode())
                start = at + 1
        yield from self.tokens(word[start:])

    def word_ids(self, word: str) -> tuple[int, ...]:
        """Ids of a word."""
        return tuple(self.tokens(word) if self.letters.issuperset(word) else self._ids(word))

    def encode(self, normalised: str) -> list[int]:
        """Ids of a whole normalised text."""
        found = _WORD.findall(normalised) if self.cuts else [normalised]
        out = list(chain.from_iterable(map(self.words.__getitem__, found)))
        if self.byte_ids is None:
            out = [i for n, i in enumerate(out) if i != self.unknown or not n or out[n - 1] != i]
        return out


class Words(dict):
    """Ids of words that were met lately: what was not met since the last ``WORDS`` new ones is forgotten in turn."""

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of, self.older = ids_of, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.older.get(word) or self.ids_of(word)
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


_tables: dict[bytes, tuple[object, Table]] = {}


def table_of(model: bytes) -> tuple[object, Table]:
    """The library's processor, which normalises and decodes, and the table of a model; built once a worker."""
    key = hashlib.sha1(model).digest()
    if key not in _tables:
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(sp.get_piece_size())
        special = {i for i in every if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        ids = {sp.id_to_piece(i): i for i in every if i not in special}
        if any(sp.is_unused(i) for i in ids.values()):
            raise ValueError("the model has unused pieces")
        rank = {p: -sp.get_score(i) for p, i in ids.items()}
        if strange := set("".join(ids)) - ids.keys():
            raise ValueError(f"pieces hold characters that are no pieces: {sorted(strange)[:5]}")
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece, i in ids.items():
            # A piece that merging does not make of its own characters is never a token.
            if len(piece) == 1 or merged(list(piece), rank) == [piece]:
                automaton.add_word(piece, i)
        automaton.make_automaton()
        pieces = [sp.id_to_piece(i) for i in every]
        table = Table(
            rank=rank,
            ids=ids,
            pieces=pieces,
            lengths=[len(p) for p in pieces],
            letters=frozenset(p for p in ids if len(p) == 1),
            byte_ids=[sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(map(sp.is_byte, every)) else None,
            unknown=sp.unk_id(),
            automaton=automaton,
            cuts=not any(b == SPACE != a for p in ids for a, b in zip(p, p[1:])),
        )
        _tables[key] = sp, table
    return _tables[key]


def encode_documents(docs: DataFrame, model: bytes, keep: bool = True) -> DataFrame:
    """Encode ``text`` of (doc_id, text), decode the ids, and digest both.

    ``keep=False`` leaves token_ids and decoded_text null, where only the digests are wanted.
    """

    def run(batches):
        import numpy as np

        sp, table = table_of(model)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                counts, kept, ids_sha, texts, text_sha = [], [], [], [], []
                for text in batch.column(1).to_pylist():
                    ids = table.encode(sp.normalize(text)) if text else []
                    back = sp.decode(ids) if ids else ""
                    counts.append(len(ids))
                    kept.append(np.array(ids, np.int32) if keep else None)
                    ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    texts.append(back if keep else None)
                    text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(counts, pa.int64()),
                        pa.array(kept, pa.list_(pa.int32())),
                        pa.array(ids_sha, pa.string()),
                        pa.array(texts, pa.string()),
                        pa.array(text_sha, pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_text", "decoded_sha256"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def decode_documents(tokens: DataFrame, model: bytes) -> DataFrame:
    """Text of ``token_ids`` of (doc_id, token_ids); null ids give an empty text."""

    def run(batches):
        sp, _ = table_of(model)
        for batch in batches:
            texts = [sp.decode(ids) if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.selectExpr("cast(doc_id as long) doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")
