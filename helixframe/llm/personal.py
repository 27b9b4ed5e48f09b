"""Personal data by patterns and a skip-chain conditional random field.

Four patterns (e-mail, IPv4, payment card, phone) find base spans, which always stay. The field looks at everything that
resembles one of them: mentions, which are phrases of digits and address-like phrases, however written. A mention's label is
one of the four kinds or none. Its potential comes from what it looks like; neighbours in the text share a potential that
favours equal labels (the chain); and mentions of a document that say the same (the same digits, or the same address) are
tied to one variable for what they say, however far they stand apart (the skips). Sum-product messages go round this loopy
graph `rounds` times, damped. Base spans and what they say are observed. A mention that is no base span becomes one of a kind if the kind's
probability is `least` or more. So "743.555.3824" is a phone number in a document that has "+1 (743) 555-3824" elsewhere, and
stays a number in others.

Weights are learned from all documents, without labels, by pseudo-likelihood: a mention's look is a few categories, so the
corpus is counted into one bounded table of (look, what its neighbours and its repeats are, label). A base span counts twice:
as it is, and rewritten as it is often hidden (without plus sign, with other separators, with a spelt-out "at"): with a repeat
of its kind this is the kind, alone it is none. The driver gets that table, which has at most 2 x 10 x 2 x 2 x 5 x 2 x 3 looks.

Nulls: a null text is empty and has no spans. A null doc_id is kept. Repeated rows have equal results. A document is labelled
by itself, so order and ties don't matter; a very long text is read whole, in time and memory in proportion to its length.
Other columns are not read. An empty table gives an empty one; without any base span nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import slices, texts_of

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
LABELS = NONE + 1

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")
#: Phrases that may be meant as one of the kinds.
_NUMBER = re.compile(r"[+(\[]{0,2}[0-9]++(?:[ ().\[\]/_-]{1,3}+[0-9]++)*+")
_AT = re.compile(r"[\[(<]at[\])>]| at ", re.I)
_ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[(<]at[\])>] ?| at |@)[A-Za-z0-9-]++(?:(?: ?[\[(<]dot[\])>] ?| dot |\.)[A-Za-z0-9-]++)++", re.I)
_SPELT_AT, _SPELT_DOT = re.compile(r" ?[\[(<]at[\])>] ?| at ", re.I), re.compile(r" ?[\[(<]dot[\])>] ?| dot ", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def is_octet(digits: str) -> bool:
    return len(x := digits.lstrip("0")) <= 3 and int(x or "0") <= 255


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches that hold, by kind, then start; each pattern in time linear in the text."""
    if not _ANY.search(text):
        return []
    found = []
    before, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > before and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((0, start, before := m.end()))
        at = text.find("@", max(before, at + 1))
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(is_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


# Mentions: (start, end, look, keys). A look is a tuple of categories, a key is what is said.

_SIZES = (7, 8, 10, 11, 12, 13, 16, 17, 20)


def look_of(surface: str, digits: str, glued: bool) -> tuple[int, ...]:
    """(address or number, number of digits, check digit, plus sign, separators, glued to letters, how "at" is written)"""
    if not digits:
        how = 0 if "@" in surface else 1 if re.search(r"[\[(<]at", surface, re.I) else 2
        return 1, 0, 0, 0, 0, int(glued), how
    between = {c for c in surface if not "0" <= c <= "9" and c != "+"}
    shape = 0 if not between else 1 if between == {"."} and is_quad(surface) else 2 if between & set("()") else 3 if between <= set(" -") else 4
    return 0, sum(len(digits) >= x for x in _SIZES), int(13 <= len(digits) <= 19 and luhn(digits)), int(surface.startswith("+")), shape, int(glued), 0


def is_quad(surface: str) -> bool:
    parts = _quad_parts(surface)
    return len(parts) == 4 and all(map(is_octet, parts))


def _quad_parts(surface: str) -> list[str]:
    return re.findall(r"[0-9]+", surface) if len(surface) <= 64 else []


def keys_of(surface: str, digits: str) -> list[str]:
    """What a mention says: the whole number, its last seven digits if it may be a phone number, four octets, an address."""
    if not digits:
        return ["a" + _SPELT_DOT.sub(".", _SPELT_AT.sub("@", surface)).lower()]
    keys = []
    if len(digits) >= 13:
        keys.append("c" + digits)
    elif len(digits) >= 7:
        keys.append("p" + digits[-7:])
    if is_quad(surface):
        keys.append("i" + ".".join(str(int(x)) for x in _quad_parts(surface)))
    return keys


def _numbers(text: str) -> Iterator[tuple[int, int]]:
    """Phrases of digits; a word that is a number of 13 digits or four octets by itself stands alone."""
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        if " " not in m[0]:
            yield a, b
            continue
        start = None
        at = a
        for word in m[0].split(" "):
            end = at + len(word)
            if len(digits_of(word)) >= 13 or "." in word and is_quad(word):
                if start is not None:
                    yield start, at - 1
                yield at, end
                start = None
            elif word and start is None:
                start = at
            at = end + 1
        if start is not None:
            yield start, b


def mentions(text: str) -> list[tuple[int, int, tuple[int, ...], list[str]]]:
    found = []
    if _DIGIT.search(text):
        for a, b in _numbers(text):
            surface = text[a:b]
            digits = digits_of(surface)
            if len(digits) >= 7 or len(digits) >= 4 and is_quad(surface):
                glued = a > 0 and (text[a - 1].isalnum() or text[a - 1] in "@_=") or b < len(text) and (text[b].isalnum() or text[b] in "@_=")
                found.append((a, b, look_of(surface, digits, glued), keys_of(surface, digits)))
    if "@" in text or _AT.search(text):
        found += [(m.start(), m.end(), look_of(m[0], "", False), keys_of(m[0], "")) for m in _ADDRESS.finditer(text)]
    return sorted(found)


def hidden(kind: int, surface: str) -> list[str]:
    """How a base span of the kind may be written so that its pattern fails."""
    if kind == 0:
        return [surface.replace("@", " [at] ").replace(".", " [dot] "), surface.replace("@", "(at)"), surface.replace("@", " at ").replace(".", " dot ")]
    if kind == 1:
        return [surface.replace(".", "-"), surface.replace(".", "[.]")]
    d = digits_of(surface)
    if kind == 2:
        return [".".join(d[i : i + 4] for i in range(0, len(d), 4)), "/".join(d[i : i + 4] for i in range(0, len(d), 4)), " ".join(d[i : i + 4] for i in range(0, len(d), 4)) + "_"]
    tail = d[-10:]
    return [tail, d[-7:-4] + "-" + d[-4:], ".".join((tail[:-7], tail[-7:-4], tail[-4:])), f"({tail[:-7]}) {tail[-7:-4]}-{tail[-4:]}", " ".join((tail[:-7], tail[-7:-4], tail[-4:]))]


@dataclass
class Graph:
    """The mentions of some documents. doc, start, end; observed: the label of those that overlap a base span, -1 of others;
    chain: whether the mention before is a neighbour; tie: (mention, what it says) by number."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    looks: list[tuple[int, ...]]
    observed: np.ndarray
    chain: np.ndarray
    tie: np.ndarray
    says: int

    @staticmethod
    def of(texts: list[str], base: list[list[tuple[int, int, int]]], near: int = 40) -> Graph:
        doc, start, end, looks, observed, chain, tie = [], [], [], [], [], [], []
        said: dict[tuple[int, str], int] = {}
        for d, (text, spans) in enumerate(zip(texts, base, strict=True)):
            by_start = sorted((a, b, k) for k, a, b in spans)
            i, last = 0, None
            for a, b, look, keys in mentions(text):
                while i < len(by_start) and by_start[i][1] <= a:
                    i += 1
                hit = i < len(by_start) and by_start[i][0] < b
                chain.append(last is not None and a - last <= near)
                last = b
                tie += [(len(doc), said.setdefault((d, k), len(said))) for k in keys]
                doc.append(d)
                start.append(a)
                end.append(b)
                looks.append(look)
                observed.append(by_start[i][2] if hit else -1)
        return Graph(np.array(doc, np.int64), np.array(start, np.int64), np.array(end, np.int64), looks, np.array(observed, np.int64), np.array(chain, bool), np.array(tie, np.int64).reshape(-1, 2), len(said))


# The model.

#: How many values each part of a look has.
PARTS = (2, 10, 2, 2, 5, 2, 3)
_OFFSETS = np.r_[0, np.cumsum(PARTS)[:-1]]
WIDTH = 1 + sum(PARTS)


@dataclass
class Field:
    look: np.ndarray  #: labels x (1 + categories)
    chain: float
    skip: float

    def unary(self, looks: list[tuple[int, ...]]) -> np.ndarray:
        return one_hot(looks) @ self.look.T


def one_hot(looks: list[tuple[int, ...]]) -> np.ndarray:
    x = np.zeros((len(looks), WIDTH))
    x[:, 0] = 1
    if looks:
        x[np.arange(len(looks))[:, None], 1 + _OFFSETS + np.array(looks)] = 1
    return x


def learn(table: list[tuple[tuple[int, ...], int, int, int, float]], steps: int = 400, ridge: float = 0.01) -> Field:
    """Weights from (look, label of the neighbour or -1, label of a repeat or -1, own label, weight) by the gradient of the
    log-pseudo-likelihood, with a penalty on squares. Without a table all weights are 0."""
    out = Field(np.zeros((LABELS, WIDTH)), 0.0, 0.0)
    if not table:
        return out
    table = sorted(table)
    x = one_hot([r[0] for r in table])
    around = np.zeros((2, len(table), LABELS))
    for k in range(2):
        own = np.array([r[1 + k] for r in table])
        around[k, np.flatnonzero(own >= 0), own[own >= 0]] = 1
    y = np.eye(LABELS)[[r[3] for r in table]]
    weight = np.log1p([r[4] for r in table])
    weight /= weight.sum()
    look, edge = out.look, np.zeros(2)
    speed = [np.zeros_like(look), np.zeros(2)]
    for _ in range(steps):
        z = x @ look.T + np.tensordot(edge, around, 1)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        off = (y - p) * weight[:, None]
        for have, slope, v in ((look, off.T @ x - ridge / len(table) * look, speed[0]), (edge, (around * off).sum((1, 2)) - ridge / len(table) * edge, speed[1])):
            v *= 0.9
            v += slope
            have += 2.0 * v
    return Field(look, max(0.0, float(edge[0])), max(0.0, float(edge[1])))


def _logs(x: np.ndarray) -> np.ndarray:
    """Logarithms of probabilities, each row's adding up to 1 again."""
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def _pass(belief: np.ndarray, weight: float) -> np.ndarray:
    """The message over an edge that favours equal labels by `weight`."""
    return _logs(np.log1p(np.expm1(weight) * np.exp(_logs(belief))))


def marginals(field: Field, g: Graph, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """The labels' probabilities of each mention. What observed mentions say is observed, too, so that no number of other
    repeats outvotes them."""
    n = len(g.doc)
    unary = _logs(field.unary(g.looks)) if n else np.zeros((0, LABELS))
    seen = np.flatnonzero(g.observed >= 0)
    unary[seen] = -50.0
    unary[seen, g.observed[seen]] = 0.0
    right = np.flatnonzero(g.chain)  # edges (right - 1, right)
    left = right - 1
    m, s = g.tie[:, 0], g.tie[:, 1]
    prior = np.zeros((g.says, LABELS))
    firm = g.observed[m] >= 0
    prior[s[firm]] = -50.0
    prior[s[firm], g.observed[m[firm]]] = 0.0
    to_right, to_left = np.zeros((len(right), LABELS)), np.zeros((len(right), LABELS))
    up, down = np.zeros((len(m), LABELS)), np.zeros((len(m), LABELS))
    belief = unary
    for _ in range(rounds if n else 0):
        belief = unary.copy()
        belief[right] += to_right
        belief[left] += to_left
        np.add.at(belief, m, down)
        said = prior.copy()
        np.add.at(said, s, up)
        seen_said = prior[s].min(1) < 0
        new_up, new_down = _pass(belief[m] - down, field.skip), _pass(np.where(seen_said[:, None], prior[s], said[s] - up), field.skip)
        new_right, new_left = _pass(belief[left] - to_left, field.chain), _pass(belief[right] - to_right, field.chain)
        to_right, to_left, up, down = (damping * a + (1 - damping) * b for a, b in ((to_right, new_right), (to_left, new_left), (up, new_up), (down, new_down)))
        belief = unary.copy()
        belief[right] += to_right
        belief[left] += to_left
        np.add.at(belief, m, down)
    return np.exp(_logs(belief)) if n else belief


def examples(texts: list[str]) -> Counter:
    """(look, neighbour's label or -1, a repeat's label or -1, own label) of the mentions and of base spans in hiding."""
    base = [base_spans(x) for x in texts]
    g = Graph.of(texts, base)
    label = np.where(g.observed >= 0, g.observed, NONE).tolist()
    repeat = [-1] * len(label)
    group: dict[int, list[int]] = {}
    for i, k in g.tie.tolist():
        group.setdefault(k, []).append(i)
    for own in group.values():
        for i, j in zip(own, own[1:] + own[:1], strict=True):
            if i != j:
                repeat[i] = label[j]
    out: Counter = Counter((look, label[i - 1] if c else -1, repeat[i], label[i]) for i, (look, c) in enumerate(zip(g.looks, g.chain.tolist(), strict=True)))
    for text, spans in zip(texts, base, strict=True):
        for kind, a, b in spans:
            for surface in hidden(kind, text[a:b]):
                look = look_of(surface, "" if kind == 0 else digits_of(surface), False)
                out[look, -1, kind, kind] += 1
                out[look, -1, -1, NONE] += 1
    return out


def fit_field(docs: DataFrame) -> Field:
    """The field's weights, from the counts of all documents; (look, neighbour, repeat, label) has bounded many values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = list(examples([x for x in part.column("text").to_pylist() if x]).items())
                columns = [pa.array([bytes(k[0]) for k, _ in found], pa.binary()), *(pa.array([k[i] for k, _ in found], pa.int32()) for i in (1, 2, 3)), pa.array([n for _, n in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["look", "beside", "repeat", "label", "n"])

    counted = texts_of(docs).mapInArrow(run, "look binary, beside int, repeat int, label int, n long").groupBy("look", "beside", "repeat", "label").agg(F.sum("n").alias("n"))
    return learn([(tuple(bytes(r["look"])), r["beside"], r["repeat"], r["label"], float(r["n"])) for r in counted.collect()])


def label_texts(texts: list[str], field: Field, least: float = 0.5, rounds: int = 12) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, spans that the field adds) of each text, by kind, then start."""
    base = [base_spans(x) for x in texts]
    g = Graph.of(texts, base)
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    p = marginals(field, g, rounds)
    for i in np.flatnonzero(g.observed < 0).tolist():
        kind = int(p[i].argmax())
        if kind != NONE and p[i, kind] >= least:
            added[g.doc[i]].append((kind, int(g.start[i]), int(g.end[i])))
    return [(b, sorted(a)) for b, a in zip(base, added, strict=True)]


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal(docs: DataFrame, field: Field, least: float = 0.5) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), a row per document. The counts are of base
    spans; spans are all, as kind:start:end in code points, by kind, then start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = label_texts([x or "" for x in part.column("text").to_pylist()], field, least)
                counts = [Counter(k for k, _, _ in base) for base, _ in got]
                columns = [part.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(NONE))]
                columns += [pa.array([hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in got]), pa.array([shown(base + more) for base, more in got]), pa.array([len(more) for _, more in got], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op11_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_personal(docs, fit_field(docs))
