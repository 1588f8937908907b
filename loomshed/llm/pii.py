"""Personal data by patterns and a skip-chain conditional random field.

Four patterns give base spans. The nodes of the field are tokens that hold a
digit, an ``@`` or a mark that stands for one (``[at]``, ``(dot)``), the tokens
beside a mark that stands alone, and tokens that repeat part of a base span. The
labels are other, email, ip, card and phone. Neighbours in the text share a chain
potential, and tokens that repeat or resemble each other anywhere in the document
share a skip potential. Base spans are evidence. Loopy belief propagation runs on
every document that has a node without evidence, and a run of tokens believed to
be personal data beyond ``Field.belief`` becomes a span of its own, tied to a base
span or not.

All potentials are learned together by pseudo-likelihood: a node's label given its
own shape, its neighbours' labels and the labels of the tokens it skips to, with a
penalty. The nodes learned from are those of the corpus, labelled by the patterns,
and those of altered copies of some of its texts (``alter``), in which a span or a
number is written in a way that the patterns miss, so that what is hidden has a
known label. Labels are counted over all nodes. Nodes that copies of a text repeat
are one context with a count; of each label, as it stands and altered, at most a
bounded number of contexts, least in hash order, is fitted on, weighted by their
counts and back to those of all.

Defined results: null and empty texts have no spans; repeated rows stay
repeated; positions are code points, ends exclusive; columns other than doc_id
and text are left alone; an empty table gives an empty table, and one without
personal data a field that adds nothing. Very long runs of one character class
cost linear time.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomshed.llm.common import free, stored

KINDS = ("email", "ip", "card", "phone")
N_LABELS = len(KINDS) + 1
#: Texts, and learning rows, that a task holds as Python's objects.
HELD = 500

# The patterns. Starts at run borders and possessive runs match the
# same spans as the plain forms, without their quadratic retries.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_MARK = re.compile(r"[\[({<](?:at|dot|punkt|punto|arobase)[\])}>]", re.IGNORECASE)
_NODE = re.compile(rf"[0-9@]|{_MARK.pattern}", re.IGNORECASE)
_TOKEN = re.compile(r"\S+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind, then start; matches that fail a check are dropped."""
    if not _HINT.search(text):
        return []
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _only_digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m[0])) <= 15]
    return out


@dataclass(frozen=True)
class Field:
    """Bounds and thresholds.

    ``sample`` nodes at most are fitted on, an equal share a label, half of them altered.
    About ``texts`` texts with a base span, and others at the same rate, are altered,
    those with a span in ``altered`` copies. ``rounds`` of message passing, and three
    a node, at most, with ``damping``. A span needs a ``belief``.
    ``least_digits`` make a number a key. ``l2`` is the penalty of a weight.
    """

    sample: int = 20_000
    texts: int = 4_000
    altered: int = 4
    rounds: int = 12
    damping: float = 0.3
    belief: float = 0.9
    least_digits: int = 6
    l2: float = 0.05


@dataclass
class Weights:
    """unary: labels x features; chain: label of a node x label of the next; skip: strength of agreement."""

    unary: list[list[float]]
    chain: list[list[float]]
    skip: float


_SIGNS = "@.+-()/:=_"
_EDGE = ".,;:!?()[]{}<>\"'%&$#*"
N_FEATURES = 1 + len(_SIGNS) + 20


def _groups(token: str) -> list[str]:
    """Runs of digits of a token."""
    return re.findall(r"[0-9]+", token)


def shape(token: str, beside: bool = False) -> list[float]:
    """Features of a token's shape; ``beside`` a mark that stands alone."""
    digits = _only_digits(token)
    n, letters = len(digits), sum(c.isalpha() for c in token)
    marks = _MARK.findall(token)
    rest = _MARK.sub("", token)
    groups = _groups(token)
    sums = 13 <= n <= 19 and luhn(digits)
    four = len(groups) == 4 and all(_octet(g) for g in groups)
    at = any(m[1:3].lower() in ("at", "ar") for m in marks)
    return (
        [1.0]
        + [float(min(rest.count(m), 3)) for m in _SIGNS]
        + [float(low < n <= high) for low, high in ((-1, 0), (0, 4), (4, 6), (6, 8), (8, 11), (11, 13), (13, 15), (15, 19), (19, 10**9))]
        + [
            letters / len(token),
            float(letters > 0 and n > 0),
            float(len(groups) == 1),
            float(len(groups) == 1 and digits.startswith("00")),
            float(sums),
            float(four),
            float(four and not letters),
        ]
        + [float(at), float(bool(marks) and not at), float(beside), float(bool(marks) and marks[0] == token.strip(",.;"))]
    )


def nodes(text: str, base: list[Span], least_digits: int = 6) -> tuple[list[tuple[int, int, int]], list[int], list[bool]]:
    """Nodes as (ordinal, start, end), their base labels (0: no evidence), and whether each stands beside a mark."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    alone = [bool(_MARK.fullmatch(text[a:b].strip(",.;"))) for a, b in tokens]
    beside = None
    if any(alone):
        beside = [before or after for before, after in zip([False, *alone[:-1]], [*alone[1:], False], strict=True)]
    known = {k for kind, a, b in base for k in _span_keys(kind, text[a:b], least_digits)}
    spans = sorted((a, b, KINDS.index(k) + 1) for k, a, b in base)
    found, labels, marked, j = [], [], [], 0
    for i, (a, b) in enumerate(tokens):
        token = text[a:b]
        near = beside is not None and beside[i]
        if not near and not _NODE.search(token) and not (known and known.intersection(_keys(token, least_digits))):
            continue
        while j < len(spans) and spans[j][1] <= a:
            j += 1
        found.append((i, a, b))
        labels.append(spans[j][2] if j < len(spans) and spans[j][0] < b else 0)
        marked.append(near)
    return found, labels, marked


def _keys(token: str, least_digits: int) -> list[str]:
    """What makes tokens the same or similar: the bare token, its digits, an address's local part."""
    bare = token.strip(_EDGE).lower()
    digits = _only_digits(bare)
    keys = ["t" + bare] if len(bare) >= 4 and any(c.isdigit() or c in "@._" for c in bare) else []
    if len(digits) >= least_digits:
        keys.append("d" + digits)
    local = re.split(r"@|[\[({<]at[\])}>]", bare)[0]
    if len(local) >= 5 and any(not c.isalpha() for c in local):
        keys.append("l" + local)
    return keys


def _span_keys(kind: str, span: str, least_digits: int) -> list[str]:
    """Keys of a whole base span: all its digits, and of a phone number also the last ten and seven."""
    digits = _only_digits(span)
    if kind == "email":
        return ["l" + span.split("@")[0].lower(), "t" + span.lower()]
    tails = {digits, digits[-10:], digits[-7:]} if kind == "phone" else {digits}
    return ["d" + t for t in sorted(tails) if len(t) >= least_digits]


def skip_edges(
    text: str, tokens: list[tuple[int, int, int]], least_digits: int, labels: list[int], base: list[Span] = ()
) -> list[tuple[int, int]]:
    """Each token tied to the one before it that has a key in common, and to the first base-labelled one of each label.

    At most four keys a token, so the edges grow with the tokens. The second kind hands the evidence
    of a base span to every repeat at one step, however many repeats lie between. The keys of a whole
    base span stand at its last token.
    """
    keys = [_keys(text[a:b], least_digits) for _, a, b in tokens]
    ends = {b: (kind, text[a:b]) for kind, a, b in base}
    for n, (_, a, b) in enumerate(tokens):
        for e in range(a + 1, b + 1) if labels[n] > 0 and ends else ():
            if e in ends:
                keys[n] = keys[n] + [k for k in _span_keys(*ends[e], least_digits) if k not in keys[n]]
    known: dict[str, dict[int, int]] = {}
    for n, y in enumerate(labels):
        if y > 0:
            for key in keys[n]:
                known.setdefault(key, {}).setdefault(y, n)
    last: dict[str, int] = {}
    edges = set()
    for n, mine in enumerate(keys):
        for key in mine:
            if key in last and last[key] != n:
                edges.add((last[key], n))
            last[key] = n
            if labels[n] <= 0:
                edges.update((min(m, n), max(m, n)) for m in known.get(key, {}).values())
    return sorted(edges)


def propagate(unary, chain, edges, skip: float, kinds, field: Field):
    """Beliefs (nodes x labels) by damped loopy sum-product in log space.

    ``edges`` is (m, 2); ``kinds`` marks each as chain (0) or skip (1); ``chain`` is labels
    x labels. Rounds go on until messages settle, ``field.rounds`` and three a node at most,
    so that the longest path is covered.
    """
    import numpy as np

    def norm(x):
        x = x - x.max(-1, keepdims=True)
        return x - np.log(np.exp(x).sum(-1, keepdims=True))

    if not len(edges):
        return np.exp(norm(unary))
    pot = np.where(kinds[:, None, None] == 0, np.asarray(chain)[None], skip * np.eye(unary.shape[1])[None])
    # Both directions of every edge: source, target, potential[source label, target label].
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    both = np.concatenate([pot, pot.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    msg = np.zeros((len(src), unary.shape[1]))
    for _ in range(field.rounds + 3 * len(unary)):
        total = unary.copy()
        np.add.at(total, dst, msg)
        out = (total[src] - msg[back])[:, :, None] + both
        top = out.max(1, keepdims=True)
        new = norm((np.log(np.exp(out - top).sum(1)) + top[:, 0]))
        change = np.abs(new - msg).max()
        msg = field.damping * msg + (1 - field.damping) * new
        if change < 1e-3:
            break
    total = unary.copy()
    np.add.at(total, dst, msg)
    return np.exp(norm(total))


def find_spans(text: str, weights: Weights, field: Field = Field()) -> tuple[list[Span], list[Span]]:
    """(base, added) spans of a text."""
    if not _NODE.search(text):
        return [], []
    base = base_spans(text)
    tokens, labels, marked = nodes(text, base, field.least_digits)
    if all(labels):
        return base, []
    import numpy as np

    skips = skip_edges(text, tokens, field.least_digits, labels, base)
    unary = np.array([shape(text[a:b], near) for (_, a, b), near in zip(tokens, marked, strict=True)]) @ np.array(weights.unary).T
    for i, y in enumerate(labels):
        if y:
            unary[i] = -1e6  # firm against any number of repeats that lean to other
            unary[i, y] = 0.0
    chains = [(i - 1, i) for i in range(1, len(tokens)) if tokens[i][0] == tokens[i - 1][0] + 1]
    edges = np.array(chains + skips, dtype=int).reshape(-1, 2)
    kinds = np.array([0] * len(chains) + [1] * len(skips))
    belief = propagate(unary, weights.chain, edges, weights.skip, kinds, field)
    best = belief.argmax(1)
    sure = [bool(not labels[i] and best[i] > 0 and belief[i, best[i]] >= field.belief) for i in range(len(tokens))]
    added: list[Span] = []
    for i, (n, a, b) in enumerate(tokens):
        if not sure[i]:
            continue
        while a < b and text[b - 1] in _EDGE and not _MARK.fullmatch(text[a:b]):
            b -= 1
        while a < b and text[a] in _EDGE and text[a] != "(" and not _MARK.match(text[a:b]):
            a += 1
        kind = KINDS[best[i] - 1]
        if added and sure[i - 1] and tokens[i - 1][0] == n - 1 and added[-1][0] == kind:
            added[-1] = (kind, added[-1][1], b)
        elif a < b:
            added.append((kind, a, b))
    return base, sorted(added, key=lambda s: (KINDS.index(s[0]), s[1]))


def disguise(kind: str, span: str, r: random.Random) -> str:
    """A span written in a way that the patterns miss."""
    if kind == "email":
        local, host = span.split("@")
        at, dot = r.choice(
            (("[at]", "."), ("(at)", "."), ("[at]", "[dot]"), (" [at] ", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "))
        )
        return local + at + host.replace(".", dot)
    digits = _only_digits(span)
    if kind == "ip":
        return span.replace(".", r.choice(("[.]", "(.)", "[dot]", ",")))
    if kind == "card":
        sep = r.choice(("/", ".", "_", ":"))
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    rest = digits[-10:]
    return r.choice(
        (
            f"({rest[:3]}) {rest[3:6]}-{rest[6:]}",
            f"{rest[:3]}.{rest[3:6]}.{rest[6:]}",
            f"{rest[:3]}-{rest[3:6]}-{rest[6:]}",
            f"00{digits}",
        )
    )


def _fake(r: random.Random) -> str:
    """Text with digits or dots that is no personal data, in the ways that spans are disguised."""
    number = "".join(r.choice("0123456789") for _ in range(16))
    if luhn(number):
        number = number[:-1] + str((int(number[-1]) + 1) % 10)
    sep = r.choice(("/", ".", "_", ":"))
    return r.choice(
        (
            number,
            sep.join(number[i : i + 4] for i in range(0, 16, 4)),
            f"{r.randrange(100, 999)}-{r.randrange(1000, 9999)}",
            f"{r.randrange(1, 9)}.{r.randrange(20)}.{r.randrange(20)}",
            f"{r.randrange(300, 999)}[.]{r.randrange(300, 999)}[.]{r.randrange(300, 999)}[.]{r.randrange(300, 999)}",
            f"{r.randrange(10, 99)}:{r.randrange(10, 59)}",
            f"{r.randrange(1900, 2100)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}",
            f"no. {r.randrange(10, 10**6)}",
            f"{r.randrange(10**8, 10**11)}",
        )
    )


def alter(text: str, base: list[Span], r: random.Random) -> tuple[str, list[Span], list[tuple[int, int]]]:
    """(text, hidden spans, places that are no data): a copy in which a span is disguised or repeated in part, or numbers are strewn in.

    One of: a span in disguise in its place, a disguised copy of a span further on,
    a part of a span further on, or, in a text without spans and in one of five
    with, a number that is no data, up to three times.
    """
    hidden: list[Span] = []

    def put(text: str, what: str) -> tuple[str, int]:
        """At the beginning of a token that no base span touches."""
        starts = [m.start() for m in _TOKEN.finditer(text)]
        held = base_spans(text)
        starts = [w for w in starts if not any(a - 2 <= w <= b + 1 for _, a, b in held)]
        at = r.choice(starts) if starts else len(text)
        return text[:at] + (" " if at == len(text) else "") + what + " " + text[at:], at + (at == len(text))

    if base and r.randrange(5):
        kind, a, b = r.choice(base)
        span, way = text[a:b], r.randrange(3)
        if way == 0:
            new = disguise(kind, span, r)
            text, hidden = text[:a] + new + text[b:], [(kind, a, a + len(new))]
            return text, hidden, []
        digits = _only_digits(span)
        part = {"phone": f"{digits[-7:-4]}-{digits[-4:]}", "card": digits, "ip": span, "email": span.split("@")[0]}[kind]
        new = disguise(kind, span, r) if way == 1 or len(part) < 6 or kind in ("ip", "card") else part
        text, at = put(text, new)
        return text, [(kind, at, at + len(new))], []
    new, none = _fake(r), []
    for _ in range(r.randrange(1, 4)):  # what is no data repeats, too
        text, at = put(text, new)
        none = [(a + (len(new) + 1) * (a >= at), b + (len(new) + 1) * (a >= at)) for a, b in none] + [(at, at + len(new))]
    return text, [], none


ROWS = "key long, y int, before int, after int, tied array<int>, f array<float>, based boolean, n long"


def _examples(text: str, field: Field, r: random.Random | None = None) -> list[dict]:
    """Learning rows of a text's nodes, or, with ``r``, of the altered nodes of an altered copy."""
    base = base_spans(text)
    hidden: list[Span] = []
    places: list[tuple[int, int]] | None = None
    if r is not None:
        text, hidden, none = alter(text, base, r)
        base = base_spans(text)
        places = [(a, b) for _, a, b in hidden] + none
    tokens, labels, marked = nodes(text, base, field.least_digits)
    truth = [y or next((KINDS.index(k) + 1 for k, c, d in hidden if c < b and a < d), 0) for (_, a, b), y in zip(tokens, labels, strict=True)]
    tied: list[list[int]] = [[] for _ in tokens]
    for i, j in skip_edges(text, tokens, field.least_digits, labels, base):
        tied[i].append(truth[j])
        tied[j].append(truth[i])
    rows = []
    for i, (n, a, b) in enumerate(tokens):
        if places is not None and (labels[i] or not any(c < b and a < d for c, d in places)):
            continue
        left = truth[i - 1] if i and tokens[i - 1][0] == n - 1 else -1
        right = truth[i + 1] if i + 1 < len(tokens) and tokens[i + 1][0] == n + 1 else -1
        key = int.from_bytes(hashlib.blake2b(f"{a}:{text[max(0, a - 20) : b + 20]}".encode(), digest_size=8).digest(), "big") >> 1
        counts = [tied[i].count(y) for y in range(N_LABELS)]
        rows.append(
            {
                "key": key,
                "y": truth[i],
                "before": left,
                "after": right,
                "tied": counts,
                "f": shape(text[a:b], marked[i]),
                "based": False,
            }
        )
    if rows and base:
        rows[0]["based"] = True  # one row of each text with a base span
    return rows


def learning_rows(docs: DataFrame, field: Field, altered: bool = False) -> DataFrame:
    """(key, y, before, after, tied, f, based, n) of every node of (text), or of the altered nodes of altered copies of every text.

    A row counts ``n`` times: the ``copies`` of its text, where docs has such a column, or once.
    """
    kinds = (
        ("key", pa.int64()),
        ("y", pa.int32()),
        ("before", pa.int32()),
        ("after", pa.int32()),
        ("tied", pa.list_(pa.int32())),
        ("f", pa.list_(pa.float32())),
        ("based", pa.bool_()),
        ("n", pa.int64()),
    )

    def run(batches):
        for batch in _parts(batches):
            rows = []
            for text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not text or not _NODE.search(text):
                    continue
                if altered:
                    seed = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")
                    new = [e for c in range(field.altered if base_spans(text) else 1) for e in _examples(text, field, random.Random(seed + c))]
                else:
                    new = _examples(text, field)
                rows += [e | {"n": n} for e in new]
                if len(rows) >= HELD:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    copies = F.col("copies") if "copies" in docs.columns else F.lit(1).cast("long")
    return docs.select(F.col("text").cast("string"), copies).mapInArrow(run, ROWS)


def minimise(value_and_slope, x, rounds: int = 200, kept: int = 12):
    """A minimum of a smooth convex function near ``x``: limited-memory quasi-Newton steps with halving."""
    import numpy as np

    value, slope = value_and_slope(x)
    moves: list[tuple] = []
    for _ in range(rounds):
        d, trail = slope.copy(), []
        for s, g, rho in reversed(moves):
            a = rho * (s @ d)
            trail.append(a)
            d -= a * g
        if moves:
            s, g, _ = moves[-1]
            d *= (s @ g) / (g @ g)
        for (s, g, rho), a in zip(moves, reversed(trail), strict=True):
            d += s * (a - rho * (g @ d))
        step = 1.0
        while True:
            new = x - step * d
            v, g = value_and_slope(new)
            if v <= value - 1e-4 * step * (slope @ d) or step < 1e-10:
                break
            step /= 2
        s, change = new - x, g - slope
        if s @ change > 1e-14:
            moves = [*moves[-kept + 1 :], (s, change, 1.0 / (s @ change))]
        x, done = new, abs(value - v) <= 1e-9 * max(1.0, abs(value))
        value, slope = v, g
        if done or np.abs(slope).max() < 1e-7:
            break
    return x


def fit(table: pa.Table, weight, field: Field) -> Weights:
    """Weights by pseudo-likelihood of rows (y, before, after, tied, f), each counted ``weight`` times.

    The logit of label y is unary[y] f + chain[before, y] + chain[y, after] + skip times the tied
    nodes of label y. One strength serves all labels, for with one each, nodes that are tied to each
    other alone would talk one another into the label with the strongest.
    """
    import numpy as np

    y = table.column("y").to_numpy()
    x = np.array(table.column("f").to_pylist(), float).reshape(len(y), N_FEATURES)
    tied = np.array(table.column("tied").to_pylist(), float).reshape(len(y), N_LABELS)
    hot = np.vstack([np.eye(N_LABELS), np.zeros(N_LABELS)])  # -1: no neighbour
    before, after = hot[table.column("before").to_numpy()], hot[table.column("after").to_numpy()]
    weight = np.asarray(weight, float) / np.sum(weight)
    k, n = N_LABELS, N_LABELS * N_FEATURES
    rows, ridge = np.arange(len(y)), field.l2 / len(y)

    def parts(w):
        return w[:n].reshape(k, -1), w[n : n + k * k].reshape(k, k), w[-1]

    def value_and_slope(w):
        u, c, s = parts(w)
        z = x @ u.T + before @ c + after @ c.T + s * tied
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        total = p.sum(1, keepdims=True)
        value = weight @ (np.log(total[:, 0]) - z[rows, y]) + ridge / 2 * (w @ w)
        p /= total
        p[rows, y] -= 1
        e = p * weight[:, None]
        return value, np.concatenate([(e.T @ x).ravel(), (before.T @ e + e.T @ after).ravel(), [(tied * e).sum()]]) + ridge * w

    u, c, s = parts(minimise(value_and_slope, np.zeros(n + k * k + 1)))
    return Weights(u.tolist(), c.tolist(), float(s))


def nothing() -> Weights:
    """A field that believes in nothing but other."""
    unary = [[0.0] * N_FEATURES for _ in range(N_LABELS)]
    unary[0][0] = 20.0
    return Weights(unary, [[0.0] * N_LABELS for _ in range(N_LABELS)], 0.0)


_WHOLE = 1 << 63


def _below(hash_: Column, share: float) -> Column:
    """Whether a 63-bit hash is in the lowest ``share`` of them."""
    return hash_ <= F.lit(min(_WHOLE - 1, int(_WHOLE * min(share, 1.0))))


def contexts(rows: DataFrame) -> DataFrame:
    """Learning rows by context (a node with its surroundings), with the number of nodes in it; copies of a text are one row each node.

    ``order`` is a hash of the whole row, so that no two contexts share it but by chance.
    """
    row = ("key", "y", "before", "after", "tied", "f")
    return rows.groupBy(*row).agg(F.sum("n").alias("n"), F.max("based").alias("based")).withColumn(
        "order", F.shiftrightunsigned(F.xxhash64(*row), 1)
    )


def _taken(rows: DataFrame, several: dict[int, int], share: int) -> pa.Table:
    """Of each label the ``share`` contexts least in hash order; a cut by their number leaves few more to choose from."""
    narrow = ("y", "before", "after", "tied", "f", "n")
    parts = [
        rows.filter((F.col("y") == y) & _below(F.col("order"), 2.0 * share / n)).orderBy("order", *narrow[1:3]).limit(share).select(*narrow)
        for y, n in sorted(several.items())
    ]
    return reduce(DataFrame.unionByName, parts).toArrow() if parts else rows.select(*narrow).limit(0).toArrow()


def train(docs: DataFrame, field: Field = Field()) -> Weights:
    """Learn the field from (doc_id, text): label counts over all nodes, and a bounded sample of contexts to fit on.

    At most ``field.sample`` contexts reach the driver, each with the number of its nodes. The texts that
    are altered are chosen by their hash, at a rate that the count of different texts with base spans sets;
    each is altered once for all its copies. Without a context to learn from the field adds nothing.
    """
    rows = stored(contexts(learning_rows(docs.select("text"), field)), "pii-contexts")
    told = _told(rows)
    based = sum(r["texts"] for r in told)
    if not based:
        free(rows)
        return nothing()
    rate = min(1.0, field.texts / based)
    text = F.col("text").cast("string")
    chosen = docs.select(text.alias("text")).filter(_below(F.shiftrightunsigned(F.xxhash64("text", F.lit("altered")), 1), rate))
    chosen = chosen.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    others = stored(contexts(learning_rows(chosen, field, altered=True)), "pii-altered")
    share, tables, weights = field.sample // (2 * N_LABELS), [], []
    for frame, counts, scale in ((rows, told, 1.0), (others, _told(others), 1.0 / rate)):
        taken = _taken(frame, {r["y"]: r["several"] for r in counts}, share)
        total = {r["y"]: r["n"] for r in counts}
        y, n = (taken.column(c).to_pylist() for c in ("y", "n"))
        got: dict[int, int] = {}
        for v, times in zip(y, n, strict=True):
            got[v] = got.get(v, 0) + times
        tables.append(taken)
        weights += [scale * total[v] * times / got[v] for v, times in zip(y, n, strict=True)]
    free(rows, others)
    return fit(pa.concat_tables(tables), weights, field) if weights else nothing()


def _told(rows: DataFrame) -> list:
    """Of each label: its nodes, its contexts, and the texts with base spans that begin in one."""
    return rows.groupBy("y").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("several"), F.count_if("based").alias("texts")).collect()


SCHEMA = "doc_id long, base array<struct<kind:string,start:int,end:int>>, added array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _parts(batches):
    """Batches in slices of ``HELD`` rows; an empty one is one."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), HELD):
            yield b.slice(at, HELD)


def _rows(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def find_documents(docs: DataFrame, weights: Weights, field: Field = Field()) -> DataFrame:
    """(doc_id, base, added): spans of every whole text."""

    def run(batches):
        for b in _parts(batches):
            found = [find_spans(t or "", weights, field) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([_rows(f[0]) for f in found], _ARROW), pa.array([_rows(f[1]) for f in found], _ARROW)],
                names=["doc_id", "base", "added"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span, or run of overlapping spans, as its first kind in brackets."""
    if not text or not spans:
        return text
    out, at, end = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < end:
            end = max(end, b)
            at = end
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = end = b
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, weights: Weights, field: Field = Field()) -> DataFrame:
    """All columns of ``docs`` with personal data in ``text`` replaced; n_chars, if there, follows."""
    schema = docs.schema

    def clean(text: str | None) -> str | None:
        if not text or not _NODE.search(text):
            return text
        base, added = find_spans(text, weights, field)
        return redact(text, base + added)

    def run(batches):
        for b in _parts(batches):
            at = b.schema.get_field_index("text")
            texts = [clean(t) for t in b.column(at).to_pylist()]
            b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield b

    out = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out
