"""Toxicity: misspelled lexicon terms by Levenshtein automata, weighed in context.

A lexicon of whole words and word stems is mined from labelled rows and held in
a trie. Tokens run through the product of that trie with the universal
Levenshtein automaton of one edit (insertion, deletion, substitution), made
deterministic as characters arrive and kept by the worker, so that most tokens
leave it after two or three characters. Words match whole, stems as prefixes, and
both may be one edit away if long enough (``Fit.fuzzy_from``). Each hit is scored
by its term's weight, then by its context: a hit inside quotation marks, or near a
word that reports speech, is a quotation and counts apart from abuse; a hit near a
word of address counts for abuse once more. A logistic model over the sums gives
the score.

Learning sees a bounded sample of labelled rows (``Fit.sample``; the rows least
in hash order, half of each class at most); document frequencies are counted by
Spark, and only the lexicon, which the sample's rows bound, and a few numbers a
sampled row reach the driver. The model is fitted on rows that neither the
lexicon nor its list of clean near-tokens was taken from, so that a kind of hit
that tells nothing gets no weight. Scoring works on every whole text. Labels,
language, source and ids are never inputs of a score.

Defined results: null and empty texts have no hits and get the model's base
score; repeated rows stay repeated; a quotation ends in the line it began in; with
no labelled rows, or with one class in them or in the half that is fitted on, the score is 0.5 less a margin for every text, so that none is predicted toxic.
"""

from __future__ import annotations

import bisect
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomshed.llm.common import free, stored

_TOKEN = re.compile(r"[^\W_]+")

# Marks that open a quotation with those that close it (apostrophes stand in words
# too, so they are none), words that report speech, words of address.
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "`": "`"}
REPORTING = frozenset(
    "said says wrote quoted reported called claims dit disait écrit dijo dice escribió sagte schrieb zitat citation cita quote".split()
)
ADDRESS = frozenset("you your u ur du dein dir ihr tu ton vous toi tú usted vosotros".split())


_OPENING = re.compile("[" + "".join(QUOTES) + "]")


def quotations(text: str) -> list[tuple[int, int]]:
    """Leftmost quotations within a line, from an opening mark to the next that closes it; linear, for what was found is looked for once."""
    after: dict[str, int] = {}

    def following(mark: str, at: int) -> int:
        if after.get(mark, -1) < at:
            found = text.find(mark, at)
            after[mark] = len(text) if found < 0 else found
        return after[mark]

    out, end = [], 0
    for m in _OPENING.finditer(text):
        at = m.start()
        if at < end:
            continue
        close = min(following(c, at + 1) for c in QUOTES[m[0]])
        if close < min(following("\n", at + 1), len(text)):
            end = close + 1
            out.append((at, end))
    return out


def unquoted(text: str) -> str:
    """The text with a space for each quotation."""
    out, at = [], 0
    for a, b in quotations(text):
        out += [text[at:a], " "]
        at = b
    return "".join(out) + text[at:] if out else text


@dataclass(frozen=True)
class Fit:
    """Bounds and thresholds of learning.

    ``sample``: labelled rows used at most. ``least_docs``: toxic rows of the
    sample that an entry must appear in. ``purity``: least smoothed odds against
    clean rows. ``fuzzy_from``: least length of a word or stem that may be
    misspelled. ``stems``: lengths of stems tried. ``window``: tokens of context
    on each side.
    """

    sample: int = 8000
    least_docs: int = 5
    purity: float = 20.0
    fuzzy_from: int = 5
    stems: tuple[int, int] = (4, 7)
    window: int = 6
    l2: float = 1.0


@dataclass
class Lexicon:
    """Terms with weights; ``words`` match whole, ``stems`` as prefixes, either also one edit away.

    ``clean`` holds tokens one edit from a term that clean rows use.
    """

    words: dict[str, float]
    stems: dict[str, float]
    clean: frozenset[str] = frozenset()
    fuzzy_from: int = 5


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float]
    window: int = 6


class Automaton:
    """Trie of the lexicon times the one-edit Levenshtein automaton, made deterministic lazily.

    A state is a set of (trie node, edits used); transitions are kept by state
    and character. ``limit``
    bounds the table: beyond it, it starts again.
    """

    def __init__(self, lexicon: Lexicon, limit: int = 50_000):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        for table, ends in ((lexicon.words, self.word), (lexicon.stems, self.stem)):
            for term in table:
                node = 0
                for ch in term:
                    if ch not in self.children[node]:
                        self.children[node][ch] = len(self.children)
                        self.children.append({})
                        self.word.append(None)
                        self.stem.append(None)
                    node = self.children[node][ch]
                ends[node] = term
        self.lexicon, self.limit = lexicon, limit
        # Edits are spent only on the way to a term long enough to be misspelled.
        self.fuzzy = [False] * len(self.children)
        for term in (*lexicon.words, *lexicon.stems):
            if len(term) >= lexicon.fuzzy_from:
                node = 0
                self.fuzzy[0] = True
                for ch in term:
                    node = self.children[node][ch]
                    self.fuzzy[node] = True
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[str, bool] | None] = []
        self.stems_at: list[str | None] = []
        self.near_stems_at: list[str | None] = []
        self.start = self._id(self._closed({(0, 0)}))

    def _closed(self, state: set) -> frozenset:
        """With deletions: a pattern character that the token leaves out."""
        for node, e in list(state):
            if e == 0 and self.fuzzy[node]:
                for nxt in self.children[node].values():
                    if self.fuzzy[nxt]:
                        state.add((nxt, 1))
        return frozenset(state)

    def _near(self, state: frozenset, ends: list[str | None]) -> str | None:
        """The first long enough term that ends in the state, one edit spent."""
        terms = (ends[n] for n, e in sorted(state) if e == 1)
        return next((t for t in terms if t and len(t) >= self.lexicon.fuzzy_from), None)

    def _id(self, state: frozenset) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            exact = next((self.word[n] for n, e in sorted(state) if e == 0 and self.word[n]), None)
            near, near_stem = self._near(state, self.word), self._near(state, self.stem)
            self.ends.append((exact, True) if exact else (near, False) if near else None)
            self.stems_at.append(next((self.stem[n] for n, e in sorted(state) if e == 0 and self.stem[n]), None))
            self.near_stems_at.append(near_stem)
        return self.ids[state]

    def _move(self, at: int, ch: str) -> int:
        nxt: set = set()
        for node, e in self.states[at]:
            to = self.children[node].get(ch)
            if to is not None:
                nxt.add((to, e))
            if e == 0 and self.fuzzy[node]:
                nxt.add((node, 1))  # the token has a character more
                for other in self.children[node].values():
                    if other != to and self.fuzzy[other]:
                        nxt.add((other, 1))  # the token has another character
        self.moves[at][ch] = found = self._id(self._closed(nxt)) if nxt else -1
        return found

    def match(self, token: str) -> tuple[str, str] | None:
        """(kind, term): an exact 'word' wins, then a 'stem', a 'near' word, a 'near stem'."""
        if len(self.states) > self.limit:
            self._reset()
        at, moves, stem, near_stem = self.start, self.moves, None, None
        end = None
        for ch in token:
            to = moves[at].get(ch)
            if to is None:
                to = self._move(at, ch)
            if to < 0:
                break
            at = to
            stem = self.stems_at[at] or stem
            near_stem = near_stem or self.near_stems_at[at]
        else:
            end = self.ends[at]
        if end and end[1]:
            return "word", end[0]
        if stem:
            return "stem", stem
        if (not end and not near_stem) or token in self.lexicon.clean:
            return None
        return ("near", end[0]) if end else ("near stem", near_stem)


def _lower(text: str) -> str:
    """Lower case that keeps every character's place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


#: Sums that the logistic model weighs, in this order.
FEATURES = ("words", "stems", "near", "near stems", "quoted", "address", "distinct", "dense")


@dataclass(frozen=True)
class Hit:
    """A term found at [start, end) of a text, with its context."""

    start: int
    end: int
    kind: str
    term: str
    weight: float
    quoted: bool
    address: bool


class Scorer:
    """Hits and feature sums of a text; keeps tokens that are known to match nothing."""

    def __init__(self, lexicon: Lexicon, window: int, keep: int = 100_000):
        self.auto, self.lexicon, self.window, self.keep = Automaton(lexicon), lexicon, window, keep
        self.known: dict[str, tuple[str, str] | None] = {}

    def _look(self, token: str):
        known = self.known
        if token in known:
            return known[token]
        if len(known) >= self.keep:
            known.clear()
        known[token] = found = self.auto.match(token)
        return found

    def hits(self, text: str | None) -> list[Hit]:
        """Every hit, in order."""
        low = _lower(text or "")
        distinct = set(_TOKEN.findall(low))
        found = {t: m for t in distinct if (m := self._look(t))}
        if not found:
            return []
        out = []
        quotes = quotations(low)
        starts = [q[0] for q in quotes]
        spans = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(low)]
        for i, (a, b, token) in enumerate(spans):
            if token in found:
                kind, term = found[token]
                weight = (self.lexicon.stems if kind.endswith("stem") else self.lexicon.words)[term]
                near = {s[2] for s in spans[max(0, i - self.window) : i + self.window + 1]}
                q = bisect.bisect_right(starts, a) - 1
                quoted = (q >= 0 and b <= quotes[q][1]) or not near.isdisjoint(REPORTING)
                out.append(Hit(a, b, kind, term, weight, quoted, not near.isdisjoint(ADDRESS)))
        return out

    def features(self, text: str | None, hits: list[Hit] | None = None) -> list[float]:
        """The sums of a text, from its hits if they are known."""
        hits = self.hits(text) if hits is None else hits
        plain = [h for h in hits if not h.quoted]

        def total(kind):
            return math.log1p(sum(h.weight for h in plain if h.kind == kind))

        sure = [h for h in plain if not h.kind.startswith("near")]
        return [
            total("word"),
            total("stem"),
            total("near"),
            total("near stem"),
            math.log1p(sum(h.weight for h in hits if h.quoted)),
            math.log1p(sum(h.weight for h in plain if h.address)),
            math.log1p(len({h.term for h in sure})),
            math.log1p(1000.0 * len(sure) / (len(text or "") + 1)),
        ]


def _chosen(labels: DataFrame, fit: Fit) -> DataFrame:
    """The sample: of each class, the ids least in hash order. At most ``fit.sample`` rows."""
    half = fit.sample // 2
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    return labels.filter("y = 1").orderBy(*by).limit(half).unionByName(labels.filter("y = 0").orderBy(*by).limit(half))


def mine(sample: DataFrame, fit: Fit, positives: int, negatives: int) -> Lexicon:
    """Entries that toxic rows of the sample have and clean ones hardly do; near copies count as one row, mostly."""
    low, high = fit.stems
    # What is quoted speaks neither for a term nor against it.
    own = F.lower("own")
    words = sample.select(
        "y", "copies", F.explode(F.array_distinct(F.regexp_extract_all(own, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("w")
    ).filter(F.length("w") >= low)
    whole_word = F.array(F.struct(F.lit(0).alias("stem"), F.col("w").alias("t")))
    prefixes = F.transform(
        F.sequence(F.lit(low), F.lit(high)),
        lambda n: F.struct(F.when(F.length("w") >= n, 1).otherwise(-1).alias("stem"), F.substring("w", F.lit(1), n).alias("t")),
    )
    entries = words.select(
        "y", "copies", F.explode(F.concat(whole_word, prefixes)).alias("e")
    ).select("y", "copies", "e.*").filter("stem >= 0").distinct()
    counts = entries.groupBy("stem", "t").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    odds = ((F.col("pos") + 0.0) / max(positives, 1)) / ((F.col("neg") + 0.5) / max(negatives, 1))
    # As many as the sample's rows have entries of their own, which its bound bounds.
    found = (
        counts.filter(F.col("pos") >= fit.least_docs)
        .withColumn("odds", odds)
        .filter(F.col("odds") >= fit.purity)
        .collect()
    )

    def weigh(r) -> float:
        """Evidence beyond what chance entries have."""
        return math.log(r["odds"]) - 0.8 * math.log(fit.purity)

    whole = {r["t"]: r for r in found if r["stem"] == 0}
    lengths = range(low, high + 1)
    # Of the words that begin with a stem, the number of rows that the commonest is in.
    most: dict[str, int] = {}
    for w, r in whole.items():
        for k in lengths:
            most[w[:k]] = max(most.get(w[:k], 0), r["pos"])

    def begun(w: str) -> bool:
        return any(w[:k] in stems for k in lengths)

    stems: dict[str, float] = {}
    for r in sorted((r for r in found if r["stem"] == 1), key=lambda r: (len(r["t"]), r["t"])):
        # A stem must stand for more than one word, and its own stem must not be in already.
        if most.get(r["t"], 0) < 0.9 * r["pos"] and not begun(r["t"]):
            stems[r["t"]] = weigh(r)
    words_kept = {w: weigh(r) for w, r in whole.items() if not begun(w)}
    return Lexicon(words_kept, stems, fuzzy_from=fit.fuzzy_from)


def _map_features(rows: DataFrame, lexicon: Lexicon, window: int) -> DataFrame:
    def run(batches):
        scorer = Scorer(lexicon, window)
        for b in batches:
            f = [scorer.features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.list_(pa.float64()))], names=["y", "f"])

    return rows.select("y", "text").mapInArrow(run, "y int, f array<double>")


def _with_copies(rows: DataFrame) -> DataFrame:
    """Adds ``copies``, the least hash of three words in a row, which near copies mostly share, and ``own``, the text without quotations."""

    def run(batches):
        import xxhash

        for b in batches:
            keys = []
            for t in b.column(1).to_pylist():
                w = t.split()
                keys.append(
                    min((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) >> 1 for i in range(max(1, len(w) - 2))), default=0)
                )
            own = [unquoted(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(keys, pa.int64()), pa.array(own, pa.string())], names=["doc_id", "text", "y", "copies", "own"]
            )

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y").mapInArrow(
        run, "doc_id long, text string, y int, copies long, own string"
    )


def _near_clean(rows: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Tokens of clean rows that are one edit from a term of the lexicon."""

    def run(batches):
        auto = Automaton(lexicon)
        for b in batches:
            near: set[str] = set()
            for t in b.column(0).to_pylist():
                near |= {w for w in set(_TOKEN.findall((t or "").lower())) if (m := auto.match(w)) and m[0].startswith("near")}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(near), pa.string())], names=["w"])

    return frozenset(r["w"] for r in rows.filter("y = 0").select("text").mapInArrow(run, "w string").distinct().collect())


def logistic(x: list[list[float]], y: list[int], fit: Fit) -> list[float]:
    """Weights (bias first) by Newton steps with an L2 penalty; classes weigh alike."""
    import numpy as np

    a = np.hstack([np.ones((len(x), 1)), np.array(x)])
    t = np.array(y, float)
    share = np.where(t == 1, 0.5 / max(t.sum(), 1), 0.5 / max((1 - t).sum(), 1)) * len(t)
    w = np.zeros(a.shape[1])
    ridge = fit.l2 * np.eye(a.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (share * (p - t)) + ridge @ w
        h = (a * (share * p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def nothing(fit: Fit) -> Model:
    """The model of labels that tell nothing: one score for all, below the half."""
    return Model(Lexicon({}, {}), [-1.0] + [0.0] * len(FEATURES), fit.window)


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1).

    The sample is drawn from the labels alone, so the texts are only filtered,
    by at most ``fit.sample`` broadcast ids, and never shuffled. Null ids and
    labels count not; an id labelled twice takes the greater label.
    """
    told = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("y")
    )
    ids = _chosen(told, fit)
    sample = stored(
        _with_copies(docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(ids), "doc_id")), "toxic-sample"
    )
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        free(sample)
        return nothing(fit)
    # Weights come from rows that the lexicon was not mined from, so chance entries
    # get no trust; the final lexicon is mined from both halves.
    part = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    lexicon = mine(sample.filter(part == 0), fit, n[1] // 2, n[0] // 2)
    lexicon.clean = _near_clean(sample.filter(part == 0), lexicon)
    told = _map_features(sample.filter(part == 1), lexicon, fit.window).collect()
    if len({r["y"] for r in told}) < 2:
        free(sample)
        return nothing(fit)
    weights = logistic([r["f"] for r in told], [r["y"] for r in told], fit)
    lexicon = mine(sample, fit, n[1], n[0])
    lexicon.clean = _near_clean(sample, lexicon)
    model = Model(lexicon, weights, fit.window)
    free(sample)
    return model


def _score(weights: list[float], f: list[float]) -> float:
    z = weights[0] + sum(u * v for u, v in zip(weights[1:], f, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_hits, n_near, n_quoted, hits) of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        scorer = Scorer(model.lexicon, model.window)
        w = model.weights
        for b in batches:
            score, n, near, quoted, spans = [], [], [], [], []
            for text in b.column(1).to_pylist():
                hits = scorer.hits(text)
                score.append(_score(w, scorer.features(text, hits)))
                n.append(len(hits))
                near.append(sum(h.kind.startswith("near") for h in hits))
                quoted.append(sum(h.quoted for h in hits))
                spans.append([{"start": h.start, "end": h.end, "kind": h.kind, "term": h.term, "quoted": h.quoted} for h in hits])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(score, pa.float64()), pa.array(n, pa.int32()), pa.array(near, pa.int32()), pa.array(quoted, pa.int32()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("term", pa.string()), ("quoted", pa.bool_())])))],
                names=["doc_id", "score", "n_hits", "n_near", "n_quoted", "hits"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run,
        "doc_id long, score double, n_hits int, n_near int, n_quoted int, hits array<struct<start:int,end:int,kind:string,term:string,quoted:boolean>>",
    )


def keep_clean(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``least``."""

    def run(batches):
        scorer = Scorer(model.lexicon, model.window)
        for b in batches:
            keep = [
                _score(model.weights, scorer.features(t)) < least for t in b.column(b.schema.get_field_index("text")).to_pylist()
            ]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
