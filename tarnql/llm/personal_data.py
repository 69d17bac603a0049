"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns find e-mail addresses, IPv4 addresses, card and phone numbers. The words of a text that hold a digit or an @
are the nodes of a field with the labels none, email, ip, card and phone. Neighbouring nodes are linked in a chain; distant nodes
are linked if they are the same word or similar (same half of a long number, same local part of an address), each
to the next such node, so links are as many as nodes. What the patterns found is fixed; loopy sum-product messages
carry it along the links, and words that then have a label with enough certainty are added as spans. A text in which no pattern found
anything is no exception.

The field is trained on a bounded sample of texts: as they are, with what the patterns find, and disguised, with the same labels: in a disguised
text spans are written as people write them where the patterns do not see them (perturbed), some of them once more at the
end. Node weights come by logistic regression, link weights as the logarithm of how much more often two labels meet on a link than
by chance. Both need counts only, so all nodes and links of the sampled texts take part.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._words import lean, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: none
CHAIN, SAME, ALIKE = range(3)
SAMPLE, KINDS_OF_NODES = 3000, 50_000  # documents the field is trained on, and different nodes (features and label) that come to the driver, at most
CERTAIN = 0.95
FIXED = 20.0
STEP = 1 << 22  # bytes of text that are worked on at a time

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match never ends inside digits, so none begins there
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NODE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
DIGITS = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")
EDGE = re.compile(r"^[^A-Za-z0-9+(@]+|[^A-Za-z0-9)]+$")
PLAIN = re.compile(r"[^a-z0-9@]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str):
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @ in linear time."""
    end, begin, at = 0, 0, text.find("@")
    while at >= 0:
        before = text[max(end, begin) : at]
        local = len(before) - len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if local else None
        if m:
            yield at - local, m.end()
            end = m.end()
        begin = at + 1
        at = text.find("@", max(end, at + 1))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind) by the patterns, in order of start, then kind; kind is a place in KINDS."""
    if not text:
        return []
    out = []
    if "@" in text:
        out += [(a, b, 0) for a, b in _emails(text)]
    if DIGITS.search(text):
        out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(x) < 4 or not x[:-3].strip("0") for x in m[0].split(".")) and max(int(x[-3:]) for x in m[0].split(".")) <= 255]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGITS.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


FEATURES = 64


def node_features(word: str, before: str, after: str) -> list[int]:
    """Numbers below FEATURES of what holds for a word; before and after are nodes beside it or empty."""
    core = EDGE.sub("", word)
    digits = NOT_DIGITS.sub("", core)
    n, dots, letters = len(digits), core.count("."), sum(c.isalpha() for c in core)
    bins = (0, 1, 2, 3, 4, 6, 8, 11, 14, 20)
    out = [sum(n >= b for b in bins), 12 + min(dots, 4), 18 + min(letters, 3), 22 + min(len(core) // 4, 7)]
    parts = core.split(".")
    tests = (
        "@" in core, bool(DOMAIN.search(core.partition("@")[2])), core[:1] == "+", core[:1] == "(", core[-1:] == ")", "-" in core, core.isdigit(),
        len(parts) == 4 and all(p.isdigit() for p in parts), 14 <= n <= 19 and luhn(digits), not letters and n > 0, before[:1] == "+", before[-1:] == ")",
        after[:1] == "(", bool(before), bool(after), "=" in word or '"' in word, "/" in core, ":" in core,
    )
    return out + [32 + k for k, t in enumerate(tests) if t]


def link_keys(word: str) -> list[tuple]:
    """What nodes share that are the same or alike; short words share nothing."""
    plain = PLAIN.sub("", word.lower())
    digits = NOT_DIGITS.sub("", plain)
    keys: list[tuple] = [(SAME, plain)] if len(plain) >= 4 else []
    if len(digits) >= 8:
        half = len(digits) // 2
        keys += [(ALIKE, "<" + digits[:half]), (ALIKE, ">" + digits[-half:])]
    local, at, _ = word.lower().partition("@")
    if at and len(local := PLAIN.sub("", local)) >= 4:
        keys.append((ALIKE, "@" + local))
    return keys


@dataclass
class Graph:
    """The nodes of a text: their places, features and fixed labels (0: not fixed), and links (from, to, kind)."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    fixed: list[int]
    links: list[tuple[int, int, int]]


def graph(text: str, base) -> Graph:
    spans = [m.span() for m in NODE.finditer(text)]
    words = [text[a:b] for a, b in spans]
    beside = [not text[spans[k][1] : spans[k + 1][0]].strip(" \t\n\v\f\r") for k in range(len(spans) - 1)] + [False]
    features = [node_features(w, words[k - 1] if k and beside[k - 1] else "", words[k + 1] if beside[k] else "") for k, w in enumerate(words)]
    fixed, at = [0] * len(spans), 0
    for k, (a, b) in enumerate(spans):
        while at < len(base) and max(s[1] for s in base[at : at + 1]) <= a:
            at += 1
        fixed[k] = next((s[2] + 1 for s in base[at : at + 4] if s[0] < b and s[1] > a), 0)
    links = [(k, k + 1, CHAIN) for k in range(len(spans) - 1) if beside[k]]
    last: dict[tuple, int] = {}
    for k, w in enumerate(words):
        for key in link_keys(w):
            if key in last:
                links.append((last[key], k, key[0]))
            last[key] = k
    return Graph(spans, features, fixed, links)


@dataclass
class Field:
    """Weights: node (FEATURES + 1, LABELS), the last row for all nodes; link (3, LABELS, LABELS)."""

    node: np.ndarray
    link: np.ndarray

    def marginals(self, features: list[list[int]], fixed: np.ndarray, links: np.ndarray, rounds: int = 12, damp: float = 0.3) -> np.ndarray:
        """Label probabilities of nodes by loopy sum-product; several texts may be one graph."""
        sizes = [len(f) for f in features]
        row = np.repeat(np.arange(len(sizes)), sizes)
        flat = np.array([x for f in features for x in f], np.int64)
        theta = np.repeat(self.node[-1:], len(sizes), 0)
        np.add.at(theta, row, self.node[flat])
        held = np.flatnonzero(fixed)
        theta[held] = -FIXED
        theta[held, fixed[held]] = FIXED
        if len(links):
            m = len(links)
            a, b = np.concatenate((links[:, 0], links[:, 1])), np.concatenate((links[:, 1], links[:, 0]))
            psi = np.concatenate((self.link[links[:, 2]], self.link[links[:, 2]].transpose(0, 2, 1)))
            back = np.concatenate((np.arange(m, 2 * m), np.arange(m)))
            message = np.zeros((2 * m, LABELS))
            for _ in range(rounds):
                belief = theta.copy()
                np.add.at(belief, b, message)
                z = (belief[a] - message[back])[:, :, None] + psi
                top = z.max(1)
                new = top + np.log(np.exp(z - top[:, None]).sum(1))
                new -= new.max(1, keepdims=True)
                moved = np.abs(new - message).max()
                message = damp * message + (1 - damp) * new
                if moved < 1e-3:
                    break
            np.add.at(theta, b, message)
        p = np.exp(theta - theta.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, texts: list[str | None], bases: list) -> list[list[tuple[int, int, int]]]:
        """For each text the spans that the field adds to what the patterns found."""
        out: list[list] = [[] for _ in texts]
        graphs = [(k, g) for k, (t, b) in enumerate(zip(texts, bases)) if t and NODE.search(t) and (g := graph(t, b)).spans]
        if not graphs:
            return out
        features = [f for _, g in graphs for f in g.features]
        fixed = np.array([x for _, g in graphs for x in g.fixed], np.int64)
        starts = np.cumsum([0] + [len(g.spans) for _, g in graphs])
        links = np.array([(a + s, b + s, kind) for (_, g), s in zip(graphs, starts.tolist()) for a, b, kind in g.links], np.int64).reshape(-1, 3)
        p = self.marginals(features, fixed, links)
        label, sure = p.argmax(1), p.max(1)
        # repeats of a word are no independent witnesses: without a link to what a pattern found, the word must be as certain on its own
        alone = self.marginals(features, fixed, links[:0])[np.arange(len(label)), label]
        sure = np.where(_anchored(fixed, links), sure, np.minimum(sure, alone))
        for (k, g), s in zip(graphs, starts.tolist()):
            chained = {a for a, _, kind in g.links if kind == CHAIN}
            text, run = texts[k], None
            for i, (a, b) in enumerate(g.spans):
                kind = int(label[s + i]) if sure[s + i] >= CERTAIN and not fixed[s + i] else 0
                if run and (kind != run[2] or i - 1 not in chained):
                    out[k].append(run)
                    run = None
                if kind:
                    run = (run[0] if run else a, b, kind)
            if run:
                out[k].append(run)
            trimmed = []
            for a, b, kind in out[k]:
                word = text[a:b]
                a, b = a + len(word) - len(re.sub(r"^[^A-Za-z0-9+(@]+", "", word)), a + len(re.sub(r"[^A-Za-z0-9)]+$", "", word))
                if a < b:
                    trimmed.append((a, b, kind - 1))
            out[k] = trimmed
        return out


def _anchored(fixed: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Nodes that links between the same or similar words connect to a fixed one."""
    links = links[links[:, 2] != CHAIN]
    on = fixed > 0
    while len(links):
        a, b = on[links[:, 0]], on[links[:, 1]]
        new = a != b
        if not new.any():
            break
        on[links[new, 0]] = on[links[new, 1]] = True
        links = links[~(a & b)]
    return on


def perturbed(text: str, base, seed: int) -> tuple[str, list[tuple[int, int, int]]]:
    """text with some spans written so that the patterns miss them, and all spans, where they are then; of each third span a
    second mention follows at the end. seed decides which and how."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out, spans, end, size = [], [], 0, 0

    def put(piece: str, kind: int | None = None):
        nonlocal size
        out.append(piece)
        if kind is not None:
            spans.append((size, size + len(piece), kind))
        size += len(piece)

    def disguised(x: str, kind: int) -> str:
        digits = NOT_DIGITS.sub("", x)
        if kind == 0:
            local, _, domain = x.partition("@")
            return (f"{local}@{domain.split('.')[0]}", f"{local}@{domain.replace('.', ',')}", f"{local}(@){domain}")[rng.integers(3)]
        if kind == 1:
            return (x.replace(".", "[.]"), ",".join(x.split(".")), "-".join(x.split(".")))[rng.integers(3)]
        if kind == 2:
            at = int(rng.integers(len(digits)))
            typo = digits[:at] + str((int(digits[at]) + 1) % 10) + digits[at + 1 :]
            return (typo, ".".join(digits[k : k + 4] for k in range(0, len(digits), 4)), "/".join(digits[k : k + 4] for k in range(0, len(digits), 4)))[rng.integers(3)]
        return (x.lstrip("+"), f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", f"00{digits}", f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}")[rng.integers(4)]

    again = []
    for a, b, kind in base:
        if a < end:
            continue
        put(text[end:a])
        x = text[a:b]
        put(disguised(x, kind) if rng.integers(2) else x, kind)
        if rng.integers(3) == 0:
            again.append((disguised(x, kind), kind))
        end = b
    put(text[end:])
    for x, kind in again:
        put(" and ")
        put(x, kind)
    return "".join(out), spans


def fit_field(nodes: list, labels: np.ndarray, times: np.ndarray, pairs: np.ndarray, steps: int = 300, rate: float = 0.2, decay: float = 1e-4) -> Field:
    """nodes: features; labels: 0 or a kind + 1; times: how often each of them occurs; pairs: counts by (kind of link, label, label).

    Each feature counts as seen twice more, by itself and without a label: what the sample lacks is no personal data.
    """
    nodes, labels, times = [*nodes, *([f] for f in range(FEATURES))], np.concatenate((labels, np.zeros(FEATURES, np.int64))), np.concatenate((times, np.full(FEATURES, 2.0)))
    sizes = [len(f) for f in nodes]
    row, flat = np.repeat(np.arange(len(sizes)), sizes), np.array([x for f in nodes for x in f], np.int64)
    w = np.zeros((FEATURES + 1, LABELS))
    target, share = np.eye(LABELS)[labels], (times / max(1, times.sum()))[:, None]
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1) if len(sizes) else ():
        z = np.repeat(w[-1:], len(sizes), 0)
        np.add.at(z, row, w[flat])
        p = np.exp(z - z.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - target) * share
        g = decay * w
        np.add.at(g, flat, error[row])
        g[-1] += error.sum(0)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    link = np.zeros((3, LABELS, LABELS))
    for kind in range(3):
        count = pairs[kind] + 0.5
        if kind != CHAIN:  # these links have no direction
            count = (count + count.T) / 2
        p = count / count.sum()
        link[kind] = np.clip(np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))), -4, 4)
    return Field(w, link)


def _counts(texts: list[str], seeds: list[int]):
    """Of texts and their disguised forms: how often each node (features, label) occurs, and each pair of labels on a link."""
    nodes, links = Counter(), Counter()
    for text, seed in zip(texts, seeds):
        base = base_spans(text)
        for t, spans in ((text, base), perturbed(text, base, seed)) if base else ((text, base),):
            g = graph(t, spans)
            nodes.update((tuple(f), y) for f, y in zip(g.features, g.fixed))
            links.update((k, g.fixed[x], g.fixed[y]) for x, y, k in g.links)
    return nodes, links


def train_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field:
    """A field from the sample documents with digits or an @ whose ids hash lowest; all rows of an id take part, with all their nodes.

    The driver gets counts of different nodes, the KINDS_OF_NODES most frequent, and not the nodes themselves.
    """
    text = F.col(text_col).cast("string")
    some = docs.where(F.col(id_col).isNotNull() & F.regexp_like(text, F.lit("[0-9@]"))).select(F.col(id_col).alias("_id"))
    some = some.select("_id", F.xxhash64("_id").alias("_h")).distinct().orderBy("_h", "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_of"), text.alias("text")).join(F.broadcast(some), F.col("_of") == F.col("_id")).select(F.col("_h").alias("h"), "text").where("text IS NOT NULL")

    def run(batches):
        for b in batches:
            nodes, links = _counts(b.column(1).to_pylist(), [h & (1 << 63) - 1 for h in b.column(0).to_pylist()])
            rows = [(list(f), y, -1, n) for (f, y), n in nodes.items()] + [([k], x, y, n) for (k, x, y), n in links.items()]
            kinds = (pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 4, kinds)], ["features", "x", "y", "n"])

    got = texts.mapInArrow(run, "features array<int>, x int, y int, n long").groupBy("features", "x", "y").agg(F.sum("n").alias("n"))
    got = got.orderBy(F.col("y") < 0, F.desc("n"), "features", "x", "y").limit(KINDS_OF_NODES + 3 * LABELS**2).collect()
    pairs = np.zeros((3, LABELS, LABELS))
    for r in got:
        if r["y"] >= 0:
            pairs[r["features"][0], r["x"], r["y"]] = r["n"]
    nodes = [r for r in got if r["y"] < 0]
    return fit_field([r["features"] for r in nodes], np.array([r["x"] for r in nodes], np.int64), np.array([r["n"] for r in nodes], float), pairs)


def redacted(text: str | None, spans) -> str | None:
    """text with [EMAIL], [IP], [CARD] or [PHONE] for each span; of overlapping ones their union, named by the first."""
    if not spans:
        return text
    out, end = [], 0
    for a, b, k in spans:
        if a >= end:
            out += [text[end:a], f"[{KINDS[k].upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def find_personal_data(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (long, by the patterns), base_spans and spans (as "kind:start:end,..", all);
    columns of these names are replaced, others pass through. redact: the text comes back with its spans replaced by their kind.

    Places are code points, ends exclusive. Null and empty texts have no spans (a null text stays null). Rows are judged
    one by one, so repeated rows, null ids and extra columns change nothing. field: None trains one on docs.
    """
    field = field or train_field(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # some thousand numbers
    new = ["n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"]
    docs = docs.drop(*new)
    at = docs.columns.index(text_col)
    names = [*docs.columns, *new]

    def run(batches):
        for b in (x for batch in batches for x in slices(batch, at, STEP)):
            texts = b.column(at).cast(pa.string()).to_pylist()
            bases = [base_spans(t) for t in texts]
            spans = [sorted(x + y, key=lambda s: (s[0], s[2])) if y else x for x, y in zip(bases, shared.value.added(texts, bases))]
            counts = [pa.array([sum(s[2] == k for s in x) for x in bases], pa.int64()) for k in range(len(KINDS))]
            columns = list(b.columns)
            if redact:
                columns[at] = pa.array([redacted(t, s) for t, s in zip(texts, spans)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *counts, *(pa.array([shown(s) for s in x], pa.string()) for x in (bases, spans))], names)

    schema = StructType(list(docs.schema.fields))
    for c in new:
        schema.add(c, "long" if c.startswith("n_") else "string")
    return docs.mapInArrow(lean(run), schema)
