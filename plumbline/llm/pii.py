"""Personal data: pattern rules, and a linear-chain conditional random field that adds to them.

The field labels the words of a text with B, I or O for each kind, from the shapes of a word and
its neighbours. It is trained on a small labelled table by gradient ascent on the likelihood
(forward and backward sums over all paths), and every word of every text is scored. A stretch of
words whose scores cannot lift any label above O, whatever the labels around it, is O on the best
path; only what is left is decoded by Viterbi, which gives the best path of the whole text.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import text_slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

#: rows of the labelled table that training reads at most
MOST_LABELLED = 5_000
_REACH = 2
#: features of a word on its own, before those of its neighbours
_OWN = 6
#: words that are scored at once, and words whose kind a task remembers
_BLOCK, _REMEMBERED = 1 << 16, 1 << 20

_SIGNAL = np.zeros(256, bool)
_SIGNAL[[*b"0123456789@"]] = True

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ALIKE = str.maketrans(string.ascii_letters + string.digits, "x" * 26 + "X" * 26 + "9" * 10)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


# ---- rules


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` outwards, so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time from each run of dotted numbers."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts = [(run.start() + m.start(), run.start() + m.end()) for m in re.finditer("[0-9]+", run.group())]
        for k in range(0, len(parts) - 3, 4):
            if all(len(n := text[a:b].lstrip("0")) <= 3 and int(n or 0) <= 255 for a, b in parts[k : k + 4]):
                yield parts[k][0], parts[k + 3][1]


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", found.group())
        if 13 <= len(digits) <= 19 and _luhn(digits):
            yield found.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", found.group())) <= 15:
            yield found.span()


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the rules by kind, in code points, end exclusive."""
    return {
        "email": list(_emails(text)),
        "ip": list(_ips(text)),
        "card": list(_cards(text)),
        "phone": list(_phones(text)),
    }


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    """``kind:start:end`` by kind, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans.get(k, ())))


# ---- features


def shape(word: str) -> str:
    """Letters as ``x`` or ``X`` and other signs as they are, runs cut to one; digits by run length."""
    out, last = [], ""
    digits = 0
    for c in word[:64]:
        kind = "9" if c.isdigit() else ("X" if c.isupper() else "x") if c.isalpha() else c
        if kind == "9":
            digits += 1
            if last != "9":
                out.append("9")
        else:
            if last == "9":
                out.append(_length(digits))
            digits = 0
            if kind != last:
                out.append(kind)
        last = kind
    if last == "9":
        out.append(_length(digits))
    return "".join(out)


def _length(digits: int) -> str:
    return str(digits) if digits <= 4 else "5-7" if digits < 8 else "8-12" if digits < 13 else "13+"


def _plain(shaped: str) -> str:
    return re.sub("[0-9].*?(?=[^0-9+-]|$)", "9", shaped)


def _features(words: list[str]) -> list[list[str]]:
    shapes = ["^"] * _REACH + [shape(w) for w in words] + ["$"] * _REACH
    plain = [_plain(s) for s in shapes]
    found = []
    for k, w in enumerate(words, _REACH):
        core = words[k - _REACH].strip(".,;:!?\"'")
        digits = sum(c.isdigit() for c in core)
        found.append(
            [
                "bias",
                f"s={shape(core)}",
                f"d={_length(digits) if digits else 0}",
                f"@={'@' in w} +={w.startswith('+')} .={core.count('.')} :={min(core.count(':'), 3)}",
                f"(={'(' in w} -={min(w.count('-'), 3)}",
                f"a={any(c.isalpha() for c in core)} d={digits > 0}",
                f"p={shapes[k - 1]}",
                f"n={shapes[k + 1]}",
                f"pp={plain[k - 2]}",
                f"nn={plain[k + 2]}",
                f"s={plain[k]} n={plain[k + 1]}",
                f"s={plain[k]} p={plain[k - 1]}",
            ]
        )
    return found


# ---- the field


class ChainField:
    """A linear-chain conditional random field with weights per (feature, label) and transition."""

    def __init__(self, rounds: int = 120, rate: float = 0.5, penalty: float = 1e-3):
        self.rounds, self.rate, self.penalty = rounds, rate, penalty
        self.known: dict[str, int] = {}

    def _padded(self, sequences: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores ``(sequence, place, label)`` and the lengths."""
        lengths = np.array([len(s) for s in sequences])
        scores = np.zeros((len(sequences), int(lengths.max()), len(LABELS)))
        for i, s in enumerate(sequences):
            for t, ids in enumerate(s):
                scores[i, t] = self.weights[ids].sum(axis=0)
        return scores, lengths

    def fit(self, sentences: list[tuple[list[str], list[int]]]) -> "ChainField":
        """``sentences`` are words and their labels. Without any, everything is O."""
        counted: dict[str, int] = defaultdict(int)
        raw = [(_features(words), labels) for words, labels in sentences if words]
        for features, _ in raw:
            for fs in features:
                for f in fs:
                    counted[f] += 1
        self.known = {f: i for i, f in enumerate(sorted(counted))}
        self.weights = np.zeros((len(self.known), len(LABELS)))
        self.moves = np.zeros((len(LABELS), len(LABELS)))
        self.first = np.zeros(len(LABELS))
        for j, name in enumerate(LABELS):  # I follows B or I of its kind only
            if name[0] == "I":
                self.first[j] = -50.0
                for i, before in enumerate(LABELS):
                    self.moves[i, j] = 0.0 if before[2:] == name[2:] and before != "O" else -50.0
        if not raw:
            return self
        free = self.moves > -50.0
        ids = [[[self.known[f] for f in fs] for fs in features] for features, _ in raw]
        flat = [(i, t, f) for i, s in enumerate(ids) for t, fs in enumerate(s) for f in fs]
        seq, place, feature = (np.array(x) for x in zip(*flat))
        lengths = np.array([len(s) for s in ids])
        longest = int(lengths.max())
        inside = np.arange(longest)[None, :] < lengths[:, None]
        truth = np.zeros((len(ids), longest, len(LABELS)))
        for i, (_, labels) in enumerate(raw):
            truth[i, np.arange(len(labels)), labels] = 1.0
        true_moves = np.einsum("sti,stj->ij", truth[:, :-1], truth[:, 1:])
        speed_w, speed_m = np.full_like(self.weights, 1e-8), np.full_like(self.moves, 1e-8)
        for _ in range(self.rounds):
            scores = np.zeros_like(truth)
            np.add.at(scores, (seq, place), self.weights[feature])
            chance, moves = self._expected(scores, inside)
            slope = np.zeros_like(self.weights)
            np.add.at(slope, feature, (truth - chance)[seq, place])
            slope -= self.penalty * len(ids) * self.weights
            speed_w += slope**2
            self.weights += self.rate * slope / np.sqrt(speed_w)
            slope = np.where(free, true_moves - moves - self.penalty * len(ids) * self.moves, 0.0)
            speed_m += slope**2
            self.moves += self.rate * slope / np.sqrt(speed_m)
        return self

    def _expected(self, scores: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances of labels per place and expected moves, by forward and backward sums."""

        def summed(x, axis):
            top = x.max(axis=axis, keepdims=True)
            return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

        longest = scores.shape[1]
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0] + self.first
        for t in range(1, longest):
            step = summed(ahead[:, t - 1, :, None] + self.moves, 1) + scores[:, t]
            ahead[:, t] = np.where(inside[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = summed(self.moves + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(inside[:, t + 1, None], step, 0.0)
        total = summed(ahead[:, -1], 1)
        chance = np.where(inside[:, :, None], np.exp(ahead + behind - total[:, None, None]), 0.0)
        moves = np.zeros_like(self.moves)
        for t in range(1, longest):
            joint = (
                ahead[:, t - 1, :, None] + self.moves + (scores[:, t] + behind[:, t])[:, None, :]
                - total[:, None, None]
            )
            moves += (np.exp(joint) * inside[:, t, None, None]).sum(axis=0)
        return chance, moves

    def decode(self, windows: list[list[str]]) -> list[np.ndarray]:
        """The best label path of each window, by Viterbi over windows of one length at a time."""
        best: list[np.ndarray] = [np.zeros(len(w), np.int64) for w in windows]
        if not self.known:
            return best
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(windows):
            if w:
                by_length[len(w)].append(i)
        for length, members in by_length.items():
            for at in range(0, len(members), 4096):
                some = members[at : at + 4096]
                ids = [
                    [[self.known[f] for f in fs if f in self.known] for fs in _features(windows[i])]
                    for i in some
                ]
                scores, _ = self._padded(ids)
                for i, path in zip(some, self.paths(scores, self.first, 0.0)):
                    best[i] = path
        return best

    def paths(self, scores: np.ndarray, first: np.ndarray, last: np.ndarray | float) -> np.ndarray:
        """The best path for each ``(sequence, place, label)``; ``first`` and ``last`` add at the ends."""
        count, length = scores.shape[:2]
        value = scores[:, 0] + first
        back = np.zeros((count, length, len(LABELS)), np.int8)
        for t in range(1, length):
            step = value[:, :, None] + self.moves
            back[:, t] = step.argmax(axis=1)
            value = step.max(axis=1) + scores[:, t]
        label = (value + last).argmax(axis=1)
        paths = np.empty((count, length), np.int64)
        for t in range(length - 1, -1, -1):
            paths[:, t] = label
            label = back[np.arange(count), t, label]
        return paths


class _Kinds(dict):
    """Words to the number of their kind: words of a kind are equal in all that the field knows."""

    def __init__(self, model: ChainField):
        self.model, self.none = model, len(model.known)
        joint = [(f[2:].split(f" {side}="), side, i) for f, i in model.known.items() for side in "np"
                 if f.startswith("s=") and f" {side}=" in f]
        self.plains = {p: i for i, p in enumerate(sorted({p for both, _, _ in joint for p in both}))}
        self.wide = len(self.plains) + 1
        self.joint = {}
        for side in "np":
            own = sorted((self.plains[a] * self.wide + self.plains[b], i) for (a, b), s, i in joint if s == side)
            self.joint[side] = np.array(own, np.int64).reshape(-1, 2)
        self.weights = np.vstack([model.weights, np.zeros(len(LABELS))])
        self.numbers: dict[tuple, int] = {}
        self.own: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.start, self.end = self._numbered((), "^"), self._numbered((), "$")

    def _numbered(self, own: tuple[int, ...], shaped: str) -> int:
        known, plain = self.model.known, _plain(shaped)
        around = (f"p={shaped}", f"n={shaped}", f"pp={plain}", f"nn={plain}")
        kind = (own, *(known.get(f, self.none) for f in around), self.plains.get(plain, self.wide - 1))
        number = self.numbers.setdefault(kind, len(self.numbers))
        if number == len(self.own):
            self.own.append(self.weights[list(own)].sum(axis=0))
        return number

    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        # words that differ only in which letters and digits they hold are of one kind
        alike = word.translate(_ALIKE)
        if alike != word:
            number = self[alike]
        else:
            known = self.model.known
            own = tuple(known[f] for f in _features([word])[0][:_OWN] if f in known)
            number = self._numbered(own, shape(word))
        self[word] = number
        return number

    def of(self, text: str) -> np.ndarray:
        """Kinds of the words of a text, between those that stand for its start and its end."""
        words = map(re.Match.group, _WORD.finditer(text))
        kinds = np.fromiter(map(self.__getitem__, words), np.int32)
        return np.concatenate(([self.start] * _REACH, kinds, [self.end] * _REACH)).astype(np.int32)

    def scores(self, kinds: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``(place, label)`` of some places of ``kinds``."""
        if not self.tables or len(self.tables[0]) < len(self.own):
            around = np.array([k[1:] for k in self.numbers], np.int64)
            self.tables = [np.array(self.own), *(self.weights[around[:, i]] for i in range(4)), around[:, 4]]
        own, p, n, pp, nn, plain = self.tables
        found = own[kinds[at]]
        for table, step in ((p, -1), (n, 1), (pp, -2), (nn, 2)):
            found += table[kinds[at + step]]
        for side, step in (("n", 1), ("p", -1)):
            joint = self.joint[side]
            if len(joint):
                code = plain[kinds[at]] * self.wide + plain[kinds[at + step]]
                row = np.minimum(np.searchsorted(joint[:, 0], code), len(joint) - 1)
                found += self.weights[np.where(joint[row, 0] == code, joint[row, 1], self.none)]
        return found


class _Reader:
    """Finds the words of whole texts that the best path labels with a kind."""

    def __init__(self, model: ChainField):
        self.model = model
        if not model.known:
            return
        self.kinds = _Kinds(model)
        stays = model.moves[0, 0]
        #: the most that a label other than O can add by the move to it, and by the move back to O
        self.enter = np.maximum(model.first - model.first[0], model.moves.max(axis=0) - stays)[1:]
        self.leave = max(0.0, float(model.moves[1:, 0].max() - stays))

    def labelled(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """``text, first word, labels`` of stretches of words outside of which all are O."""
        if not self.model.known:
            return
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            held.append((i, self.kinds.of(text)))
            size += len(held[-1][1])
            if size >= _BLOCK:
                yield from self._block(held)
                held, size = [], 0
        if held:
            yield from self._block(held)

    def _block(self, held: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, np.ndarray]]:
        flat = np.concatenate([k for _, k in held])
        ends = np.cumsum([len(k) for _, k in held])
        gain = np.empty(len(flat))
        for a in range(_REACH, len(flat) - _REACH, _BLOCK):
            b = min(a + _BLOCK, len(flat) - _REACH)
            scores = self.kinds.scores(flat, np.arange(a, b))
            gain[a:b] = (scores[:, 1:] - scores[:, :1] + self.enter).max(axis=1)
        runs: dict[tuple, list[tuple[int, int, int]]] = defaultdict(list)
        for (i, kinds), end in zip(held, ends.tolist()):
            first, last = end - len(kinds) + _REACH, end - _REACH
            own = gain[first:last]
            if not len(own) or own.max() + self.leave < -1e-6:
                continue
            # the most that any stretch of words around each word can gain
            sums = np.concatenate(([0.0], np.cumsum(own)))
            most = np.maximum.accumulate(sums[:0:-1])[::-1] - np.minimum.accumulate(sums[:-1])
            open_ = np.flatnonzero(most + self.leave >= -1e-6)
            for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
                if len(run):
                    a, b = int(run[0]), int(run[-1])
                    runs[b - a + 1, a == 0, b == len(own) - 1].append((i, a, first + a))
        for (length, starts, ends_), some in runs.items():
            for k in range(0, len(some), 4096):
                part = some[k : k + 4096]
                at = np.array([place for _, _, place in part])[:, None] + np.arange(length)
                paths = self.model.paths(
                    self.kinds.scores(flat, at.ravel()).reshape(len(part), length, len(LABELS)),
                    self.model.first if starts else self.model.moves[0],
                    0.0 if ends_ else self.model.moves[:, 0],
                )
                for (i, a, _), path in zip(part, paths):
                    if path.any():
                        yield i, a, path


def labelled_words(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[str], list[int]]:
    """The words of a labelled text, and the label of each."""
    words, labels, last = [], [], None
    for found in _WORD.finditer(text):
        own = next((s for s in spans if s[1] < found.end() and found.start() < s[2]), None)
        words.append(found.group())
        labels.append(0 if own is None else LABELS.index(f"{'I' if own == last else 'B'}-{own[0]}"))
        last = own
    return words, labels


def train(labelled: DataFrame, most_rows: int = MOST_LABELLED) -> ChainField:
    """Trains on ``labelled(text, spans array<struct<kind, start, end>>)``, at most ``most_rows`` of it.

    Null texts are left out, null spans mean none.
    """
    rows = labelled.where("text IS NOT NULL").select("text", "spans").limit(most_rows).collect()
    return ChainField().fit([labelled_words(r.text, [tuple(s) for s in r.spans or ()]) for r in rows])


def _plausible(kind: str, value: str) -> bool:
    """Numbers that the rules rejected by their digits stay rejected."""
    digits = re.sub("[^0-9]", "", value)
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "ip":
        return ":" in value or all(int(d) <= 255 for d in re.findall("[0-9]{1,9}", value))
    return True


def added_spans(
    model: ChainField,
    texts: list[str],
    base: list[dict[str, list[tuple[int, int]]]],
    reader: _Reader | None = None,
) -> list[dict[str, list[tuple[int, int]]]]:
    """Spans that the field finds in each text and that touch none of ``base``.

    ``reader`` may be one that has read other texts with the same ``model``.
    """
    by_text: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
    for i, first, path in (reader or _Reader(model)).labelled(texts):
        by_text[i].append((first, path))
    runs = []
    for i, parts in by_text.items():
        words, at = _WORD.finditer(texts[i]), 0
        for first, path in sorted(parts, key=lambda x: x[0]):
            run = [m.span() for m in islice(words, first - at, first - at + len(path))]
            runs.append((i, run, path))
            at = first + len(path)
    found: list[dict[str, list[tuple[int, int]]]] = [defaultdict(list) for _ in texts]
    for i, run, path in runs:
        t = 0
        while t < len(run):
            if path[t] == 0:
                t += 1
                continue
            kind, first = LABELS[path[t]][2:], t
            t += 1
            while t < len(run) and LABELS[path[t]] == f"I-{kind}":
                t += 1
            a, b = run[first][0], run[t - 1][1]
            while a < b and texts[i][b - 1] in ".,;:!?\"')]":
                b -= 1
            while a < b and texts[i][a] in "\"'[,;":
                a += 1
            taken = [s for spans in base[i].values() for s in spans]
            if a < b and _plausible(kind, texts[i][a:b]) and not any(x < b and a < y for x, y in taken):
                found[i][kind].append((a, b))
    return found


_RESULT = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
)


def find_personal_data(docs: DataFrame, model: ChainField) -> DataFrame:
    """Per row: ``doc_id``, counts by kind of the rules, ``base_sha256`` and all ``spans``.

    Spans are ``kind:start:end`` in code points, by kind and start; the hash is over those of the
    rules. The field adds spans and never changes one of the rules. Null and empty texts have
    none; a null ``doc_id`` is kept; repeated rows are all returned; other columns are ignored.
    Each task holds one Arrow batch; long texts are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(model)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            carries = np.zeros(len(ids), bool)
            for first, last, data, offsets in text_slices(texts):
                seen = np.concatenate(([0], np.cumsum(_SIGNAL[data])))
                carries[first:last] = seen[offsets[1:]] > seen[offsets[:-1]]
            some = [t or "" for t in texts.to_pylist()]
            # no rule finds anything in a text without a digit or ``@``
            base = [base_spans(t) if c else {k: [] for k in KINDS} for t, c in zip(some, carries)]
            more = added_spans(model, some, base, reader)
            counts = np.zeros((len(KINDS), len(ids)), np.int64)
            hashes = [hashlib.sha256(b"").hexdigest()] * len(ids)
            spans = [""] * len(ids)
            for i, (b, m) in enumerate(zip(base, more)):
                if not carries[i] and not m:
                    continue
                counts[:, i] = [len(b[k]) for k in KINDS]
                hashes[i] = hashlib.sha256(listed(b).encode()).hexdigest()
                spans[i] = listed({k: b[k] + m.get(k, []) for k in KINDS})
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c) for c in counts), pa.array(hashes), pa.array(spans)],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(text AS string) AS text").mapInArrow(
        run, _RESULT
    )
