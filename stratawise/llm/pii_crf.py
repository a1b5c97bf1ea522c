"""Personal data: base patterns, and a linear-chain conditional random field on word shapes.

Base spans (leftmost, not overlapping within a kind; failing matches are dropped, not
retried) cover well-formed e-mail addresses, IP addresses, card and phone numbers.  The
CRF adds spans that the patterns miss: spelt-out or bracketed addresses, national phone
formats, cards with other separators.  Its features are the shapes of a word and its
neighbours; it is trained by gradient ascent on the small labelled table below and decoded
by Viterbi in numpy batches.

A word is a *marker* when it has a digit, an at sign or a bracketed sign anywhere in it, or
is a spelt-out sign.  Words more than ``REACH`` words from any marker can only be outside a
span; that is part of the model, and it makes decoding the stretches around markers equal to
decoding whole texts with it.  A plain "at" is no marker, so "bob at corp.com" is not looked
at.  An added span must hold what its kind needs and must not touch a base span.  Words of
one tag in succession may be several spans: they are cut between words and at commas,
semicolons, slashes and bars so that most of them is covered by pieces that pass.

Spans are code points, end exclusive.  Null texts count as empty; repeated rows give
repeated results; a very long text is read whole, its stretches decoded in batches of like
length; an empty table gives no rows.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stratawise.llm.common import WORD, doc_texts, released, slices

#: Kinds in their order and the base patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(WORD)

REACH = 3
_DOT = r"(\.| ?[(\[](\.|dot|punkt|punto|point)[)\]] ?| (dot|punkt|punto|point) )"
_LABELS = rf"([^\s@.()\[\],;|/]+{_DOT}(?=[^\W_]))++[a-z]{{2,}}(?!\w)"  # never given back, so long ones take linear time
_AT = r"\S+ ?(@|[(\[]at[)\]]| at ) ?"
_SPELT = re.compile(rf"{_AT}({_LABELS}|[^\s@]+ ?(\.| dot |[(\[]dot[)\]]) ?[a-z]{{2,}})", re.IGNORECASE)
_ADDRESS = re.compile(_AT + _LABELS, re.IGNORECASE)  # without its context: no space at a plain dot
_AT_SIGN = re.compile(r"@|[(\[]at[)\]]|(?<!\S)at(?!\S)", re.IGNORECASE)
_ATOM = re.compile(r"[^\s,;|/]+")
_MOST = {1: 12, 2: 19, 3: 15}  # digits of a span
_SIGN_WORDS = frozenset(("dot", "(dot)", "[dot]", "(at)", "[at]", "punkt", "punto", "point"))
_SIGN = re.compile(r"[(\[](at|dot|punkt|punto|point)[)\]]", re.IGNORECASE)
_INNER = re.compile(r"[^\W_][(\[]at[)\]][^\W_]", re.IGNORECASE)
_CUES = frozenset(("at", "dot", "punkt", "punto", "point", "com", "org", "net", "mail", "e-mail", "email", "phone", "tel", "call", "fax", "mobile", "card", "visa", "ip", "host", "version", "page", "isbn", "order", "password", "token"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, by kind, then start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:  # one at sign is in every match: its local part ends there
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, last := m.end()))
        at = text.find("@", m.end() if m else at + 1)
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.sub("", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# --- word shapes -----------------------------------------------------------------------------


def shape(word: str) -> str:
    """Letters as one x (X with a capital), digit runs as d and their length, all else as is."""
    out, i = [], 0
    while i < len(word) and len(out) < 12:
        j, c = i + 1, word[i]
        if c.isdigit():
            while j < len(word) and word[j].isdigit():
                j += 1
            out.append(f"d{min(j - i, 6)}")
        elif c.isalpha():
            while j < len(word) and word[j].isalpha():
                j += 1
            out.append("x" if word[i:j].islower() else "X")
        else:
            out.append(c)
        i = j
    return "".join(out)


def is_marker(word: str) -> bool:
    return any(c in "0123456789@" for c in word) or word.lower().strip(".,;:!?") in _SIGN_WORDS or _SIGN.search(word) is not None


def _features(words: list[str], i: int) -> list[str]:
    word, low = words[i], words[i].lower().strip(".,;:!?")
    before = shape(words[i - 1]) if i else "<"
    after = shape(words[i + 1]) if i + 1 < len(words) else ">"
    own = shape(word.strip(".,;:!?"))
    out = ["bias", f"0:{own}", f"00:{re.sub('d[0-6]', 'd', own)}", f"-1:{before}", f"+1:{after}", f"-1:{before}|0:{own}", f"0:{own}|+1:{after}", f"marker:{is_marker(word)}", f"at:{'@' in word}", f"inner:{_INNER.search(word) is not None}"]
    for name, k in (("w", i), ("w-", i - 1), ("w+", i + 1)):
        if 0 <= k < len(words) and (cue := words[k].lower().strip(".,;:!?()[]")) in _CUES:
            out.append(f"{name}:{cue}")
    digits = sum(c.isdigit() for c in low)
    out.append(f"digits:{min(digits, 20) if digits < 13 else '13+'}")
    return out


# --- the labelled table ------------------------------------------------------------------------

_FILL = "the of and onher erthat stion leaux menté der keit lich ciónes para los in with from ouré que heit".split()


def labelled_table(rows: int = 500, seed: int = 5) -> list[tuple[int, str, int]]:
    """(sentence, word, tag): invented sentences; tag 0 is outside, else kind number + 1."""
    rng = np.random.default_rng(seed)

    def n(a: int, b: int) -> str:
        return str(int(rng.integers(a, b)))

    def d(k: int) -> str:
        return "".join(str(int(x)) for x in rng.integers(0, 10, k))

    def name() -> str:
        return "".join("abcdefghklmnoprst"[int(x)] for x in rng.integers(0, 17, int(rng.integers(3, 8))))

    def host() -> str:
        return f"{name()}.{('com', 'org', 'net')[int(rng.integers(3))]}"

    def spelt() -> str:
        return ("dot", "punkt", "punto", "point")[int(rng.integers(4))]

    makers = {
        1: [lambda: f"{name()}.{d(2)}@{name()}{d(1)}.{host()}", lambda: f"{name()}@{host()}", lambda: f"{name()} [at] {name()} [dot] com", lambda: f"{name()} (at) {name()} (dot) org", lambda: f"{name()} at {name()} dot com", lambda: f"{name()}(at){d(1)}{host()}",
            lambda: f"{name()}(at){host()}", lambda: f"{name()}[at]{name()}[dot]net", lambda: f"{name()}.{name()}(at){name()}(dot)org",
            lambda: f"{name()} at {name()} {spelt()} {name()} {spelt()} net", lambda: f"{name()} at {name()} {spelt()} de", lambda: f"{name()} [at] {name()} {spelt()} {name()} {spelt()} org", lambda: f"{name()} (at) {name()} ({spelt()}) com"],
        2: [lambda: ".".join(n(1, 256) for _ in range(4)), lambda: "[.]".join(n(1, 256) for _ in range(4))],
        3: [lambda: d(16), lambda: " ".join(d(4) for _ in range(4)), lambda: "-".join(d(4) for _ in range(4)), lambda: ".".join(d(4) for _ in range(4))],
        4: [lambda: f"+{n(1, 99)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+{n(1, 99)} {d(2)} {d(7)}"],
        0: [lambda: f"version {n(1, 9)}.0.", lambda: f"{n(1, 9)}.{n(0, 9)}", lambda: f"Version {n(1, 9)}.{n(0, 9)}.{n(0, 9)}", lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{n(1, 24)}:{d(2)}", lambda: d(4), lambda: d(2), lambda: d(1), lambda: f"{d(2)}%", lambda: f"${d(2)}.{d(2)}",
            lambda: f"password={name()}{d(6)}{name()}{d(4)}", lambda: f'token = "{d(5)}{name()}{d(7)}{name()}{d(6)}"', lambda: f"AKIA{d(3)}{name().upper()}{d(2)}", lambda: f"{d(3)},{d(3)}", lambda: f"at {n(1, 12)}", lambda: f"{name()} at {name()}", lambda: f"dot {name()}", lambda: f"{name()} {spelt()} {name()}", lambda: f"{spelt()} {n(1, 30)}", lambda: f"isbn {d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
            lambda: f"{d(1)}) {name()}", lambda: f"#{d(4)}", lambda: f"{d(2)}.{d(2)}.20{d(2)}", lambda: f"{name()}{d(1)}", lambda: "CC BY-NC 4.0.", lambda: f"{n(1, 30)} {name()} {n(1, 30)}", lambda: f"{d(4)} {d(4)}", lambda: f"{d(3)} {d(3)}"],
    }
    out = []
    for s in range(rows):
        for _ in range(int(rng.integers(1, 3))):
            fill = [_FILL[int(x)] + ("." if rng.random() < 0.15 else "") for x in rng.integers(0, len(_FILL), int(rng.integers(0, 5)))]
            kind = int(rng.choice([0, 0, 1, 2, 3, 4]))
            out += [(s, w, 0) for w in fill]
            for _ in range(1 + int(rng.integers(1, 3)) * (rng.random() < 0.2)):  # some follow each other
                made = makers[kind][int(rng.integers(len(makers[kind])))]().split(" ")
                if rng.random() < 0.2:
                    made[-1] += ".,"[int(rng.integers(2))]
                out += [(s, w, kind) for w in made]
        out += [(s, _FILL[int(x)], 0) for x in rng.integers(0, len(_FILL), int(rng.integers(0, 4)))]
    return out


# --- the model -----------------------------------------------------------------------------------


class Crf:
    """Emission weights by feature and label, and transition weights; label 0 is outside."""

    def __init__(self, features: dict[str, int], emission: np.ndarray, transition: np.ndarray):
        self.features, self.emission, self.transition = features, emission, transition

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores; only the outside label is open far from markers."""
        out = np.zeros((len(words), self.emission.shape[1]))
        near = _near(words)
        for i in range(len(words)):
            if near[i]:
                known = [self.features[f] for f in _features(words, i) if f in self.features]
                out[i] = self.emission[known].sum(axis=0)
            else:
                out[i, 1:] = -np.inf
        return out

    def decode(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over many stretches at once; each begins and ends outside."""
        if not batch:
            return []
        length, labels = max(map(len, batch)), self.emission.shape[1]
        score = np.zeros((len(batch), length, labels))
        score[:, :, 1:] = -np.inf
        for k, s in enumerate(batch):
            score[k, : len(s)] = s
        best, back = score[:, 0] + self.transition[0], np.zeros((len(batch), length, labels), dtype=np.int8)
        for t in range(1, length):
            step = best[:, :, None] + self.transition[None]
            back[:, t] = step.argmax(axis=1)
            best = step.max(axis=1) + score[:, t]
        tags = np.zeros((len(batch), length), dtype=np.int64)
        tags[:, -1] = (best + self.transition[:, 0]).argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(len(batch)), t, tags[:, t]]
        return [tags[k, : len(s)] for k, s in enumerate(batch)]


def _near(words: list[str]) -> np.ndarray:
    near = np.zeros(len(words) + 2 * REACH, dtype=bool)
    for i, w in enumerate(words):
        if is_marker(w):
            near[i : i + 2 * REACH + 1] = True
    return near[REACH : REACH + len(words)]


def train(table: list[tuple[int, str, int]], rounds: int = 100, ridge: float = 0.02, rate: float = 0.15) -> Crf:
    """Maximum likelihood by Adam; forward and backward sums over all sentences at once."""
    sentences: dict[int, tuple[list[str], list[int]]] = {}
    for s, w, t in table:
        own = sentences.setdefault(s, ([], []))
        own[0].append(w)
        own[1].append(t)
    names: dict[str, int] = {}
    rows = [[[names.setdefault(f, len(names)) for f in _features(w, i)] for i in range(len(w))] for w, _ in sentences.values()]
    labels, count, length = len(KINDS) + 1, len(rows), max(map(len, rows))
    where = [(k, t, f) for k, r in enumerate(rows) for t, fs in enumerate(r) for f in fs]
    at, feature = np.array([k * length + t for k, t, _ in where]), np.array([f for _, _, f in where])
    gold, real, allowed = np.zeros((count, length), dtype=int), np.zeros((count, length), dtype=bool), np.zeros((count, length, labels))
    for k, (w, t) in enumerate(sentences.values()):
        gold[k, : len(t)], real[k, : len(t)] = t, True
        allowed[k, : len(w), 1:][~_near(w)] = -1e9
    allowed[~real, 1:] = -1e9  # after the end: outside
    emission, transition = np.zeros((len(names), labels)), np.zeros((labels, labels))
    target = np.zeros((count, length, labels))
    np.put_along_axis(target, gold[:, :, None], 1, axis=2)
    moments = [np.zeros_like(x) for x in (emission, emission, transition, transition)]
    for step in range(1, rounds + 1):
        score = np.zeros((count * length, labels))
        np.add.at(score, at, emission[feature])
        score = score.reshape(count, length, labels) + allowed
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0] + transition[0]
        for t in range(1, length):
            forward[:, t] = _logsum(forward[:, t - 1, :, None] + transition[None], 1) + score[:, t]
        backward[:, -1] = transition[:, 0]
        for t in range(length - 2, -1, -1):
            backward[:, t] = _logsum(transition[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        total = _logsum(forward[:, -1] + backward[:, -1], 1)[:, None, None]
        node = np.exp(forward + backward - total)
        error = ((target - node) * real[:, :, None]).reshape(-1, labels)
        grad_e = np.zeros_like(emission)
        np.add.at(grad_e, feature, error[at])
        grad_t = np.zeros_like(transition)
        for t in range(1, length):
            pair = np.exp(forward[:, t - 1, :, None] + transition[None] + (score[:, t] + backward[:, t])[:, None, :] - total)
            both = real[:, t]
            grad_t -= pair[both].sum(axis=0)
            np.add.at(grad_t, (gold[both, t - 1], gold[both, t]), 1)
        for x, g, m, v in ((emission, grad_e, *moments[:2]), (transition, grad_t, *moments[2:])):
            g = (g - ridge * count * 0.05 * x) / count
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(names, emission, transition)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


# --- spans -----------------------------------------------------------------------------------------


def _holds(kind: int, text: str) -> bool:
    """What an added span needs at least."""
    digits = len(_DIGIT.sub("", text))
    if kind == 0:
        return _SPELT.fullmatch(text) is not None
    if kind == 1:
        return len(p := re.findall(r"[0-9]+", text)) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in p)
    if kind == 2:
        return 13 <= digits <= 19 and luhn(_DIGIT.sub("", text)) and not re.search(r"[^\W\d_]", text)
    return 9 <= digits <= 15 and not re.search(r"[^\W\d_]", text)


def stretches(text: str) -> list[tuple[list[str], list[tuple[int, int]]]]:
    """Words around markers with their places: whole runs of near words and one more at each side."""
    found = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    words = [text[a:b] for a, b in found]
    wanted = np.flatnonzero(_near(words))
    out = []
    for run in np.split(wanted, np.flatnonzero(np.diff(wanted) > 1) + 1) if len(wanted) else ():
        a, b = max(0, int(run[0]) - 1), min(len(words), int(run[-1]) + 2)
        out.append((words[a:b], found[a:b]))
    return out


def added_spans(text: str, tags: list[np.ndarray], parts: list, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out, edges = [], sorted((s, e) for _, s, e in base)
    # Ends rise with starts only within a kind: the furthest end so far tells whether a base span is touched.
    starts, ends = [s for s, _ in edges], list(accumulate((e for _, e in edges), max))
    for (_, places), own in zip(parts, tags, strict=True):
        i = 0
        while i < len(own):
            j = i + 1
            while j < len(own) and own[j] == own[i]:
                j += 1
            if own[i]:
                kind = int(own[i]) - 1
                out += [(kind, a, b) for a, b in _pieces(kind, text, places[i][0], places[j - 1][1], starts, ends)]
            i = j
    return out


def _pieces(kind: int, text: str, start: int, end: int, starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Spans of one tag's run: the choice of passing pieces that covers most of it.

    Among equals, one that doesn't run over a comma or into a plus sign, then fewest and most even pieces."""

    def untouched(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return not k or ends[k - 1] <= a

    whole = end
    while whole > start and text[whole - 1] in ".,;:!?":
        whole -= 1
    fits = whole > start and untouched(start, whole) and _holds(kind, text[start:whole])
    if fits and (kind or len(_AT_SIGN.findall(text, start, whole)) < 2):
        return [(start, whole)]
    atoms = [(m.start(), m.end()) for m in _ATOM.finditer(text, start, end)]
    # What a piece costs that runs on over the gap before an atom.
    gap = [0] + [int(text[b] == "+" or any(c in ",;|" for c in text[a:b])) for (_, a), (b, _) in zip(atoms, atoms[1:], strict=False)]
    over = [0, *accumulate(gap)]
    # best[k]: (atoms left out, gaps run over, pieces, sum of squares), the next atom and the piece of atoms k..
    best: list[tuple] = [((0, 0, 0, 0), 0, None)] * (len(atoms) + 1)
    for k in range(len(atoms) - 1, -1, -1):
        left = best[k + 1][0]
        choices = [((left[0] + 1, *left[1:]), k + 1, None)]
        ahead = _candidates(kind, text, atoms, k, end)
        for n, a, b in [*ahead, (len(atoms), start, whole)] if fits and not k else ahead:
            if untouched(a, b):
                c = best[n][0]
                choices.append(((c[0], c[1] + over[n] - over[k + 1], c[2] + 1, c[3] + (n - k) ** 2), n, (a, b)))
        best[k] = min(choices, key=lambda x: x[0])
    out, k = [], 0
    while k < len(atoms):
        _, k, piece = best[k]
        if piece:
            out.append(piece)
    return out


def _candidates(kind: int, text: str, atoms: list[tuple[int, int]], k: int, end: int) -> list[tuple[int, int, int]]:
    """Passing pieces that begin with atom k: the number of the atom after it, start and end."""
    a = atoms[k][0]
    if kind == 0:
        if not any(_AT_SIGN.search(text, *x) for x in atoms[k : k + 2]):
            return []
        stop = end
        for n, m in enumerate(_AT_SIGN.finditer(text, a, end)):
            if n == 1:  # the next address: its local part may be read as a label, but not its sign
                stop = m.start()
                break
        m = _ADDRESS.match(text, a, stop)
        return [(next((n for n in range(k + 1, len(atoms)) if atoms[n][0] >= m.end()), len(atoms)), a, m.end())] if m else []
    out, digits = [], 0
    for n in range(k, len(atoms)):
        b = atoms[n][1]
        own = len(_DIGIT.sub("", text[atoms[n][0] : b]))
        digits += own
        if digits > _MOST[kind] or not digits:
            break
        while b > a and text[b - 1] in ".,;:!?":
            b -= 1
        if own and _holds(kind, text[a:b]):
            out.append((n + 1, a, b))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, n_added, n_spans."""
    crf = crf or train(labelled_table())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                texts = piece.column("text")
                marked = pc.match_substring_regex(texts, r"[0-9@]|(?i:\b(dot|punkt|punto|point)\b|[(\[]at[)\]])")
                base: list[list] = [[] for _ in range(len(texts))]
                spans = [x[:] for x in base]
                held, scores = [], []
                for i in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
                    text = texts[i].as_py()
                    base[i] = base_spans(text)
                    parts = stretches(text)
                    held.append((i, text, parts))
                    scores += [crf.scores(w) for w, _ in parts]
                tags, at = _decoded(crf, scores), 0
                for i, text, parts in held:
                    spans[i] = sorted(base[i] + added_spans(text, tags[at : at + len(parts)], parts, base[i]))
                    at += len(parts)
                counts = [[sum(k == n for k, _, _ in s) for s in base] for n in range(4)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column("doc_id"), **{f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, counts, strict=True)},
                    "base_sha256": pa.array([hashlib.sha256(_joined(s).encode()).hexdigest() for s in base], pa.string()), "spans": pa.array([_joined(s) for s in spans], pa.string()),
                    "n_added": pa.array([len(s) - len(b) for s, b in zip(spans, base, strict=True)], pa.int64()), "n_spans": pa.array([len(s) for s in spans], pa.int64()),
                })

    return doc_texts(docs).mapInArrow(released(find), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def _decoded(crf: Crf, scores: list[np.ndarray], most: int = 2048) -> list[np.ndarray]:
    """Decode in batches of like length, in the given order."""
    order = sorted(range(len(scores)), key=lambda k: len(scores[k]))
    out: list = [None] * len(scores)
    i = 0
    while i < len(order):
        own = order[i : i + most]
        if len(scores[own[-1]]) > 2 * len(scores[own[0]]) + 16:  # don't pad short ones to a very long one
            own = [k for k in own if len(scores[k]) <= 2 * len(scores[own[0]]) + 16]
        for k, tags in zip(own, crf.decode([scores[k] for k in own]), strict=True):
            out[k] = tags
        i += len(own)
    return out
