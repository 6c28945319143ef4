"""Personal data by fixed patterns and a skip-chain conditional random field.

The base finds emails, addresses, card and phone numbers by pattern.  The field
labels a document's tokens that hold a digit or an at sign and the words beside
them.  Its features are a token's shape and surroundings.  Neighbouring tokens
share a chain potential.  Tokens of one document that are equal once case and
punctuation are gone share a skip potential with one variable for that form, and
tokens with the same last digits share another with one for those, so that all
occurrences are two steps apart however long the document is; both favour equal
labels, by a weight that all labels share.  Loopy belief
propagation passes messages along all of them until they settle, and a token
whose label is plain in one place is labelled alike where the pattern misses it.

All weights, of features, chain and both kinds of skip, are fitted together:
they maximise the pseudo-likelihood of the base's own labels, each token's given
those of its neighbours and of the other tokens of its form, on a bounded sample
of tokens.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neartide.llm import words

# fixed values: the kinds, in the order in which ties are listed
KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

SAMPLE = 20_000  # tokens that the weights are fitted to
SAMPLE_DOCS = 50_000  # documents, about, that these tokens are taken from
HASHES = 1 << 12
ROUNDS = 500  # at most, if the messages do not settle before
TOLERANCE = 1e-4  # of a message
SURE = 0.9
LAST = 7  # digits that tokens with similar numbers have in common

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ANY = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches around each at sign: the local part is the whole run before it, from the last match's end on."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
            at = text.find("@", done)
        else:
            # nothing before this sign can be part of a later match
            done = at + 1
            at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base match, in order."""
    found = []
    if "@" in text:
        found += [(s, 0, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- tokens and features

_EDGES = "\"'`.,;:!?#$%&*()[]{}<>|/\\=~^"


class Tokens:
    """The tokens of a text that the field labels: words with a digit or an at sign and the words beside them, without punctuation at their ends."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        spots = [m.span() for m in _WORD.finditer(text)]
        marked = [i for i, (b, e) in enumerate(spots) if _ANY.search(text, b, e)]
        use = sorted({j for i in marked for j in (i - 1, i, i + 1) if 0 <= j < len(spots)})
        plain = {}  # the words without punctuation
        for i in use:
            word = text[spots[i][0] : spots[i][1]]
            begin = spots[i][0] + len(word) - len(word.lstrip(_EDGES))
            plain[i] = (begin, begin + len(word.strip(_EDGES)))
        use = [i for i in use if plain[i][0] < plain[i][1]]
        self.text, self.spots = text, [plain[i] for i in use]
        self.chain = [j for j in range(len(use) - 1) if use[j + 1] == use[j] + 1]  # tokens that the next one follows
        around = lambda i: text[spots[i][0] : spots[i][1]].lower().strip(_EDGES) if 0 <= i < len(spots) else ""
        self.before, self.after = [around(i - 1) for i in use], [around(i + 1) for i in use]
        begins, ends = [b for b, _ in self.spots], [e for _, e in self.spots]
        self.label = [0] * len(use)  # the first kind of base match that covers a token
        for s, kind, e in base:
            for i in range(bisect_right(ends, s), bisect_left(begins, e)):
                self.label[i] = min(self.label[i] or kind + 1, kind + 1)
        self.forms: list[list[tuple[str, str]]] = [forms(text[b:e]) for b, e in self.spots]

    def __len__(self) -> int:
        return len(self.spots)

    def features(self, i: int) -> list[int]:
        begin, end = self.spots[i]
        token = self.text[begin:end]
        digits = sum(c.isdigit() for c in token)
        only = "".join(c for c in token if "0" <= c <= "9")
        shape = re.sub(r"a+", "a", re.sub(r"[^\W\d_]", "a", re.sub(r"\d+", "9", token)))
        names = (
            f"shape={shape}", f"digits={min(digits, 20)}", f"at={min(token.count('@'), 2)}", f"dots={min(token.count('.'), 4)}", f"plus={self.text[max(0, begin - 1):begin + 1].count('+')}",
            f"luhn={min(len(only), 20)}:{12 <= len(only) <= 19 and luhn(only)}", f"before={self.before[i]}", f"after={self.after[i]}", f"pure={only == token}", f"letters={min(sum(c.isalpha() for c in token), 8)}",
        )
        return [zlib.crc32(n.encode()) % HASHES for n in names]


FEATURES = 10
_BARE = re.compile(r"[\W_]+")
_DIGITS = re.compile(r"[^0-9]+")


def forms(token: str) -> list[tuple[str, str]]:
    """What a token shares with equal ones (its letters and digits) and with similar ones (its last digits); words without digit or at sign share nothing."""
    if not _ANY.search(token):
        return []
    found = [("skip", _BARE.sub("", token.lower()))]
    digits = _DIGITS.sub("", token)
    if len(digits) >= LAST:
        found.append(("like", digits[-LAST:]))
    return [f for f in found if f[1]]


# ---- the field

_PAIRS = ("chain", "skip", "like")


class Field:
    """Weights of the potentials: of features, and of the labels of two tokens or of a token and the variable of its form."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, like: np.ndarray | None = None):
        self.unary, self.pairs = unary, {"chain": chain, "skip": skip, "like": skip if like is None else like}

    def marginals(self, texts: list[Tokens]) -> list[np.ndarray]:
        """The tokens' label probabilities after loopy belief propagation; base matches are observed.  Documents share no edge, and each settles on its own."""
        k = len(LABELS)
        node, a, b, which, owner = [], [], [], [], []
        at, first = 0, []
        for d, tokens in enumerate(texts):
            first.append(at)
            for i, seen in enumerate(tokens.label):
                own = self.unary[tokens.features(i)].sum(0)
                if seen:
                    own = np.full(k, -40.0)
                    own[seen] = 0.0
                node.append(own)
            pairs = [(at + i, at + i + 1, 0) for i in tokens.chain]
            count = Counter(f for own in tokens.forms for f in own)
            hub: dict[tuple[str, str], int] = {}
            at += len(tokens)
            for i, own in enumerate(tokens.forms):
                for f in own:
                    if count[f] > 1:
                        if f not in hub:
                            hub[f] = at
                            node.append(np.zeros(k))
                            at += 1
                        pairs.append((first[d] + i, hub[f], _PAIRS.index(f[0])))
            for x, y, w in pairs:
                a.append(x), b.append(y), which.append(w), owner.append(d)
        node = np.array(node).reshape(-1, k)
        total = propagate(node, np.array(a, np.int64), np.array(b, np.int64), np.stack([self.pairs[p] for p in _PAIRS])[np.array(which, np.int64)], np.array(owner, np.int64))
        return [total[i : i + len(t)] for i, t in zip(first, texts)]


def propagate(node: np.ndarray, a: np.ndarray, b: np.ndarray, pair: np.ndarray, owner: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Label probabilities by damped sum-product messages along edges a - b with log potentials ``pair``; exact where there is no loop.

    The edges of one owner go on until none of its messages moves by more than
    ``tolerance``, or for ``rounds`` rounds; where edges do not settle, the last
    messages count.
    """
    right, left = np.zeros((len(a), node.shape[1])), np.zeros((len(a), node.shape[1]))  # messages to b and to a, as logs
    live = np.arange(len(a))
    for _ in range(rounds):
        if not len(live):
            break
        total = node.copy()
        np.add.at(total, b[live], right[live])
        np.add.at(total, a[live], left[live])
        x, y, p = a[live], b[live], pair[live]
        new_right = _log_sum((total[x] - left[live])[:, :, None] + p, 1)
        new_left = _log_sum((total[y] - right[live])[:, None, :] + p, 2)
        new_right = 0.5 * right[live] + 0.5 * (new_right - new_right.max(1, keepdims=True))
        new_left = 0.5 * left[live] + 0.5 * (new_left - new_left.max(1, keepdims=True))
        moved = np.maximum(np.abs(new_right - right[live]).max(1), np.abs(new_left - left[live]).max(1)) > tolerance
        right[live], left[live] = new_right, new_left
        restless = np.zeros(owner.max() + 1, bool)
        restless[owner[live][moved]] = True
        live = live[restless[owner[live]]]
    total = node.copy()
    np.add.at(total, b, right)
    np.add.at(total, a, left)
    return _softmax(total)


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(1, keepdims=True)) if len(x) else x
    return p / p.sum(1, keepdims=True) if len(x) else x


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


_SAMPLE = "pick long, label int, feature array<int>, before int, after int, skip int, like int"


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each token with its features, its base label and those of the tokens beside it and of most others of its forms (-1: none)."""
    for batch in batches:
        rows = []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text or not _ANY.search(text):
                continue
            tokens = Tokens(text, base_spans(text))
            by_form: dict[tuple[str, str], Counter] = {}
            for own, label in zip(tokens.forms, tokens.label):
                for f in own:
                    by_form.setdefault(f, Counter())[label] += 1
            linked = set(tokens.chain)
            for i, (label, own) in enumerate(zip(tokens.label, tokens.forms)):
                others = {"skip": -1, "like": -1}
                missed = False
                for f in own:
                    rest = by_form[f] - Counter([label])
                    if rest:
                        others[f[0]] = max(rest, key=lambda x: (rest[x], -x))
                    missed |= not label and f[0] == "skip" and any(x for x in rest)
                if missed:
                    continue  # what the base missed here it found elsewhere: no example of anything else
                before = tokens.label[i - 1] if i - 1 in linked else -1
                after = tokens.label[i + 1] if i in linked else -1
                rows.append((zlib.crc32(f"{k}:{tokens.spots[i][0]}".encode()), label, tokens.features(i), before, after, others["skip"], others["like"]))
        if rows:
            types = [pa.int64(), pa.int32(), pa.list_(pa.int32()), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in _SAMPLE.split(", ")])


def fitted(x: np.ndarray, y: np.ndarray, beside: dict[str, list[np.ndarray]], passes: int = 200, keep: float = 0.5) -> Field:
    """The field of greatest penalised pseudo-likelihood, by gradient steps scaled to how often each weight is used.

    ``beside`` has, for each kind of pair, the neighbours' labels of every
    token, -1 where there is none.  Chain weights are symmetric; skip and like
    have one weight each, for two labels that agree, whatever the label.  Each
    pass sees a share ``keep`` of every token's features, else these explain the
    labels alone and the pairs learn nothing; the features' weights are scaled
    to match.
    """
    k = len(LABELS)
    unary = np.zeros((HASHES, k))
    pairs = {name: np.zeros((k, k)) for name in _PAIRS}
    if not len(y):
        return Field(unary, *pairs.values())
    seen = np.bincount(x.ravel(), minlength=HASHES)[:, None]
    truth, rng = np.eye(k)[y], np.random.default_rng(11)
    met = {name: sum(np.bincount(n[n >= 0], minlength=k) for n in beside[name]) for name in _PAIRS}
    for _ in range(passes):
        use = (rng.random(x.shape) < keep).astype(float)
        score = (unary[x] * use[:, :, None]).sum(1)
        for name in _PAIRS:
            for n in beside[name]:
                score += np.where((n >= 0)[:, None], pairs[name][:, n].T, 0.0)
        error = truth - _softmax(score)
        step = np.zeros_like(unary)
        for f in range(x.shape[1]):
            np.add.at(step, x[:, f], error * use[:, f, None])
        unary += 1.2 * (step - 0.02 * unary) / (seen * keep + 4.0)
        for name in _PAIRS:
            slope = np.zeros((k, k))
            for n in beside[name]:
                some = n >= 0
                np.add.at(slope, n[some], error[some])  # by the neighbour's label
            if name == "chain":
                slope = slope + slope.T
                pairs[name] += 1.2 * (slope - 0.2 * pairs[name]) / (met[name][:, None] + met[name][None, :] + 20.0)
            else:
                weight = pairs[name][0, 0]
                pairs[name] = np.eye(k) * max(0.0, weight + 4.0 * (np.trace(slope) - 0.02 * weight) / (met[name].sum() + 4.0))
    return Field(unary * keep, *pairs.values())


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Fits the field to the ``sample`` tokens with the least hash of about SAMPLE_DOCS documents, chosen by hash."""
    share = int(min(1.0, SAMPLE_DOCS / max(1, docs.count())) * 1_000_000)
    docs = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(words.trimmed(_labelled), _SAMPLE).orderBy("pick", "label").limit(sample).collect()
    of = lambda name: np.array([r[name] for r in rows], np.int64)
    x = np.array([r["feature"] for r in rows], np.int64).reshape(-1, FEATURES)
    return fitted(x, of("label"), {"chain": [of("before"), of("after")], "skip": [of("skip")], "like": [of("like")]})


def _plausible(kind: int, token: str) -> bool:
    digits = sum("0" <= c <= "9" for c in token)
    return (
        (kind == 0 and "@" in token[1:-1] and "." in token) or (kind == 1 and token.count(".") >= 3 and digits >= 4)
        or (kind == 2 and 12 <= digits <= 19) or (kind == 3 and 9 <= digits <= 15 and digits * 2 >= len(token))
    )


def all_spans(texts: list[str | None], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text the base's matches, and all spans with those that the field adds."""
    found: list[tuple[list, list]] = [([], []) for _ in texts]
    some = [d for d, t in enumerate(texts) if t and _ANY.search(t)]
    tokens = []
    for d in some:
        base = base_spans(texts[d])
        found[d] = (base, base)
        tokens.append(Tokens(texts[d], base))
    for d, own, p in zip(some, tokens, field.marginals(tokens)):
        base, fresh = found[d][0], []
        kinds = p.argmax(1) - 1
        for i in np.flatnonzero((kinds >= 0) & (p.max(1) >= SURE)).tolist():
            b, e = own.spots[i]
            if not own.label[i] and _plausible(int(kinds[i]), own.text[b:e]):  # a token without base label meets no base match
                fresh.append((b, int(kinds[i]), e))
        found[d] = (base, sorted(base + fresh))
    return found


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and digest are of the base's matches; spans adds the field's.
    Places are code points, the end exclusive.  A null text is empty; very long
    texts are searched whole and their tokens are one field; ties of kinds go in
    the order of KINDS; repeated rows each get a row; an empty table gives no
    rows; other columns are not read.
    """
    field = field or fit(docs)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in words.parts(batch, 1, 1 << 20)):
            rows = []
            for k, (base, every) in zip(part.column(0).to_pylist(), all_spans(part.column(1).to_pylist(), field)):
                count = Counter(kind for _, kind, _ in base)
                rows.append((k, *(count[i] for i in range(4)), hashlib.sha256(_told(base).encode()).hexdigest(), _told(every), len(every) - len(base)))
            if rows:
                types = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(words.trimmed(run), schema)


def masked_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, done = [], 0
    for s, k, e in spans:
        if s >= done:
            out += [text[done:s], f"[{KINDS[k].upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets; all columns and rows stay, null texts stay null, overlapping spans become one."""
    field = field or fit(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in words.parts(batch, at, 1 << 20)):
            texts = part.column(at).to_pylist()
            columns = list(part.columns)
            columns[at] = pa.array([t if t is None else masked_text(t, every) for t, (_, every) in zip(texts, all_spans(texts, field))], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(words.trimmed(run), docs.schema)
